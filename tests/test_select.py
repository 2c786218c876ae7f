import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import select as S


def cand(unit, score, kw, pages=(1,), tool="keyword_search", seq=0, level="UNIT", intent="locate", satisfied=False, succeeded=False, crop=True, texts=()):
    return {"sample_idx": 1, "unit": unit, "score": score, "kw_scores": list(kw), "pages": list(pages), "tool": tool, "seq": seq, "level": level, "intent": intent, "satisfied": satisfied,
            "succeeded": succeeded, "crop": crop, "texts": [{"id": i, "words": w, "related": r} for i, w, r in texts]}


def picked(rows, **rules):
    return [x["c"]["unit"] for x in S.choose(rows, S.Rules(**rules))]


def test_gain_for_each_image():
    rows = [cand("a", 0.9, [0.6], [1, 2, 3]), cand("b", 0.8, [0.5], [1]), cand("c", 0.7, [0.01], [1])]
    assert picked(rows)[0] == "b" and "c" not in picked(rows)


def test_ties():
    # Any density that is clearly higher wins, however little; densities as close go to the score, then to less text.
    assert picked([cand("a", 0.5, [0.5]), cand("b", 0.4, [0.503])], k=1) == ["b"]
    assert picked([cand("a", 0.6, [0.503]), cand("b", 0.5, [0.5])], k=1) == ["a"]
    assert picked([cand("a", 0.5, [0.5], texts=[("x", 900, False)]), cand("b", 0.5, [0.5], texts=[("y", 90, False)], seq=1)], k=1) == ["b"]


def test_hard_hits_come_first():
    rows = [cand("soft", 0.99, [1.0]), cand("id", 0.5, [0.1], tool="find_by_id"), cand("page", 0.4, [0.1], tool="find_by_page")]
    assert picked(rows, k=1)[0] == "id" and picked([{**r, "satisfied": True} for r in rows], k=5) == ["id", "page"]
    counted = [cand("n", 0.0, [], tool="global_count", succeeded=True, intent="count", level="DOCUMENT"), cand("soft", 0.9, [1.0], intent="count", level="DOCUMENT")]
    assert picked(counted) == ["n"]


def test_modes():
    many = [cand("a", 0.9, [1.0, 0.0], level="MULTI_UNIT"), cand("b", 0.8, [1.0, 0.0], level="MULTI_UNIT"), cand("c", 0.7, [0.0, 0.6], [2], level="MULTI_UNIT")]
    assert picked(many) == ["a", "c"]  # b adds nothing to a
    everything = [cand(str(i), 0.5, [s], [i], level="DOCUMENT", intent="enumerate") for i, s in enumerate((0.9, 0.5, 0.06, 0.04))]
    assert picked(everything, by_cost=False) == ["0", "1", "2"]
    assert picked(everything, k=9, density_share=0.0) == ["0", "1", "2"]


def test_budget():
    rows = [cand(str(i), 0.5, [0.5], [i, i + 1], texts=[(f"t{i}", 480, False)]) for i in range(0, 20, 2)]
    assert S.effective_k(rows, S.Rules(budget=10.0)) == 3  # crop, two pages and 0.2 of text each
    assert len(picked(rows, budget=10.0)) == 3 and len(picked(rows, budget=None)) == 5
    assert S.effective_k([], S.Rules(budget=1.0)) == 5


def brute(rows, rules, multi):
    """The greedy choice written out with plain sums."""
    pages, best, out, pool, first = set(), {}, [], sorted(rows, key=lambda c: (-c["score"], c["seq"])), None
    while pool and len(out) < rules.k:
        top = None
        for c in pool:
            g = sum(max(0.0, s - (best.get(i, 0.0) if multi else 0.0)) for i, s in enumerate(c["kw_scores"])) / max(1, len(c["kw_scores"]))
            d = g / max(1, 1 + len(set(c["pages"]) - pages))
            if top is None or d > top[0] + 1e-9 or abs(d - top[0]) <= rules.near and c["score"] > top[2]["score"] + 1e-9:
                top = (d, g, c)
        d, g, c = top
        if g < (0.01 if multi or first is None else max(0.01, 0.8 * first[1])) or first and first[0] and len(out) >= (2 if multi else 0) and d < 0.9 * first[0]:
            break
        first = first or top
        out.append(c["unit"])
        pages |= set(c["pages"])
        for i, s in enumerate(c["kw_scores"]):
            best[i] = max(best.get(i, 0.0), s)
        pool = [x for x in pool if x is not c]
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_against_brute_force(seed, multi):
    rng = random.Random(seed)
    rows = [cand(f"u{i}", round(rng.random(), 2), [rng.choice([0.0, 0.3, 0.5, 0.505, 1.0]) for _ in range(3)], rng.sample(range(6), rng.randint(0, 3)), seq=i, level="MULTI_UNIT" if multi else "UNIT") for i in range(rng.randint(0, 9))]
    assert picked(rows) == brute(rows, S.Rules(), multi)


def test_pruning():
    assert S.marginal_blocks([[1, 0, 0], [1, 1, 0], [0, 0, 1]], [0, 0, 1], [False] * 3) == [1]
    assert S.marginal_blocks([[0.0], [0.0]], [1.0], [False, True]) == [1]
    assert S.marginal_blocks([], [], []) == []


def test_frames(spark):
    rows = [cand("a", 0.9, [0.6], [1, 2, 3]), cand("b", 0.8, [0.5], [1]), {**cand("n", None, [], []), "kw_scores": None, "pages": None, "texts": None}]
    kinds = ("sample_idx bigint, unit string, score double, kw_scores array<double>, pages array<int>, tool string, seq int, level string, intent string, satisfied boolean, succeeded boolean, crop boolean, "
             "texts array<struct<id:string,words:int,related:boolean>>, rank string")
    df = spark.createDataFrame([(*r.values(), "clash") for r in rows + [{**r, "sample_idx": 2} for r in rows]], kinds)
    got = [(r.sample_idx, r.unit, r["rank"]) for r in S.select_evidence(df).orderBy("sample_idx", "rank").collect()]
    assert got[0] == (1, "b", 1) and {x[0] for x in got} == {1, 2}
    assert S.select_evidence(df.limit(0)).count() == 0
    t = spark.createDataFrame([(1, "u", 0, False, [1.0, 0.0]), (1, "u", 1, False, [1.0, 1.0]), (2, "u", 5, False, None)], "sample_idx bigint, unit string, pos int, is_title boolean, scores array<double>")
    seeds = spark.createDataFrame([(1, "u", [0.0, 0.0])], "sample_idx bigint, unit string, scores array<double>")
    assert {tuple(r) for r in S.prune_blocks(t, seeds).collect()} == {(1, "u", 1), (2, "u", 5)}
