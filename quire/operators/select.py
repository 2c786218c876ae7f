"""Order-dependent selection of evidence: hard hits first, then greedy choice by gain per image; block pruning.

Small grouped kernels: each call gets the candidates of one question.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.schema import AGGREGATION_TOOLS, HARD_TOOLS

TINY = 1e-9


@dataclass(frozen=True)
class Rules:
    """Settings of the selection. ``budget`` (input units) replaces ``k`` by what it pays for, at the
    dearest (``max``) or mean (``avg``) candidate's cost."""

    k: int = 5
    least_gain: float = 0.01
    gain_share: float = 0.80  # of the first gain, for questions on one unit
    density_share: float = 0.90  # of the first density
    least_picks: int = 2  # before the density may end a question on several units
    least_mean: float = 0.05  # mean keyword score where everything is collected
    unit_words: int = 240
    text_weight: float = 0.1
    related_share: float = 0.35  # weight of a related text's words
    near: float = 0.005  # densities so close are decided by score, then by text
    by_cost: bool = True
    budget: float | None = None
    budget_stat: str = "max"


class _Chosen:
    """What the chosen candidates of a question already show."""

    def __init__(self, rules: Rules):
        self.rules, self.pages, self.texts, self.best = rules, set(), set(), {}

    def images(self, c) -> int:
        return max(1, bool(c["crop"]) + len(set(c["pages"]) - self.pages))

    def text(self, c) -> float:
        """Cost of the texts that are not shown yet, each counted once."""
        r = self.rules
        new = {t["id"]: t["words"] * (r.related_share if t["related"] else 1.0) for t in reversed(list(c["texts"])) if t["words"] > 0 and t["id"] not in self.texts}
        return r.text_weight * sum(new.values()) / max(1, r.unit_words)

    def gain(self, c, multi: bool) -> float:
        scores = list(c["kw_scores"])
        if not scores:
            return 0.0
        return sum(max(0.0, s - self.best.get(i, 0.0)) if multi else s for i, s in enumerate(scores)) / len(scores)

    def add(self, c) -> None:
        self.pages |= set(c["pages"])
        self.texts |= {t["id"] for t in c["texts"]}
        for i, s in enumerate(c["kw_scores"]):
            self.best[i] = max(self.best.get(i, 0.0), s)


def effective_k(pool: list, rules: Rules) -> int:
    """``k``, or how many candidates the budget pays for at their usual cost; at least one."""
    if rules.budget is None or rules.budget <= 0 or not pool:
        return max(1, rules.k)
    blank = _Chosen(rules)
    costs = [max(1.0, blank.images(c) + blank.text(c)) for c in pool]
    usual = sum(costs) / len(costs) if rules.budget_stat == "avg" else max(costs)
    return max(1, int(rules.budget // max(1.0, usual)))


def _prefer(near: float, a, b):
    """Of two priced candidates the better: clearly denser, or as dense with a higher score or less text."""
    if b["density"] > a["density"] + TINY:
        return b
    if abs(b["density"] - a["density"]) <= near:
        if b["score"] > a["score"] + TINY or abs(b["score"] - a["score"]) <= TINY and b["text"] < a["text"] - TINY:
            return b
    return a


def _greedy(pool: list, k: int, rules: Rules, chosen: _Chosen, multi: bool, maximize: bool) -> list[dict]:
    """Picks one after another until the gain or its density falls, or ``k`` are picked."""
    out, first = [], None
    while pool and len(out) < k:
        priced = []
        for c in pool:
            gain = chosen.gain(c, multi)
            priced.append({"c": c, "gain": gain, "density": gain / chosen.images(c), "score": c["score"], "text": chosen.text(c)})
        if rules.by_cost:
            top = reduce(partial(_prefer, rules.near), priced)
        else:
            top = reduce(lambda a, b: b if b["gain"] > a["gain"] + TINY else a, priced)
        if maximize:
            least, patience = rules.least_mean, 0
        else:
            least = rules.least_gain if multi or first is None else max(rules.least_gain, rules.gain_share * first["gain"])
            patience = rules.least_picks if multi else 0
        thin = rules.by_cost and first is not None and first["density"] > 0 and len(out) >= patience and top["density"] < rules.density_share * first["density"]
        if top["gain"] < least or thin:
            break
        first = first or top
        out.append(top)
        chosen.add(top["c"])
        pool.remove(top["c"])
    return out


def choose(rows: list[dict], rules: Rules) -> list[dict]:
    """The chosen candidates of one question, in order, each with ``phase``, ``gain`` and ``density``.

    Hard hits (by number, page, section; counts and lists) come first, those
    that count or list never dropped, the others up to the budget. Nothing is
    added to a question whose hard constraints they satisfy, or which they
    count or list. A count or list over a whole document takes all candidates
    above a floor, any other question greedily the best. Equal scores keep
    their order of arrival.
    """
    cands = sorted(rows, key=lambda c: (-c["score"], c["seq"]))
    if not cands:
        return []
    level, intent = cands[0]["level"], cands[0]["intent"]
    multi, collects = level == "MULTI_UNIT", intent in ("count", "enumerate")
    maximize = collects and level == "DOCUMENT"
    k = effective_k(cands, rules)
    hard = [c for c in cands if c["tool"] in HARD_TOOLS or c["tool"] in AGGREGATION_TOOLS]
    locked = [c for c in hard if c["tool"] in AGGREGATION_TOOLS and c["succeeded"]]
    phase1 = locked + [c for c in hard if not any(c is x for x in locked)][:max(0, k - len(locked))]
    chosen = _Chosen(rules)
    for c in phase1:
        chosen.add(c)
    pool = [c for c in cands if not any(c is x for x in phase1)]
    if locked and collects or not maximize and cands[0]["satisfied"]:
        soft = []
    elif maximize and not rules.by_cost:
        soft = [{"c": c, "gain": chosen.gain(c, False), "density": None} for c in pool if chosen.gain(c, False) >= rules.least_mean]
    else:
        soft = _greedy(pool, k, rules, chosen, multi, maximize)
    return [{"c": c, "gain": None, "density": None, "phase": 1} for c in phase1] + [{**x, "phase": 2} for x in soft]


def select_evidence(candidates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``sample_idx, unit, phase, rank, gain, density`` of the chosen candidates of each question.

    ``candidates``: sample_idx, level, intent, satisfied (its hard constraints are met by the hard hits),
    unit, seq, tool, succeeded (a count or list came out), score, kw_scores array<double>,
    pages array<int>, crop, texts array<struct<id:string,words:int,related:boolean>>. Null arrays are empty,
    null scores 0. Candidates of a question are handled by one task; other columns are not read.
    """
    kind = candidates.schema["unit"].dataType.simpleString()
    key = candidates.schema["sample_idx"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        for r in rows:
            for name in ("kw_scores", "pages", "texts"):
                r[name] = [] if r[name] is None else list(r[name])
            r["score"] = 0.0 if pd.isna(r["score"]) else float(r["score"])
        picks = choose(rows, rules)
        return pd.DataFrame([(x["c"]["sample_idx"], x["c"]["unit"], x["phase"], n + 1, None if x["gain"] is None else round(x["gain"], 9), None if x["density"] is None else round(x["density"], 9))
                             for n, x in enumerate(picks)], columns=["sample_idx", "unit", "phase", "rank", "gain", "density"])

    cols = ["sample_idx", "level", "intent", "satisfied", "unit", "seq", "tool", "succeeded", "score", "kw_scores", "pages", "crop", "texts"]
    return candidates.select(*cols).groupBy("sample_idx").applyInPandas(run, f"sample_idx {key}, unit {kind}, phase int, rank int, gain double, density double")


def marginal_blocks(scores: list[list[float]], seed: list[float], titles: list[bool], share: float = 0.5, least: float = 0.01) -> list[int]:
    """Places of the texts to keep, in their order: greedily those that raise the keywords' best scores
    most, down to a share of the first rise; titles always. ``scores``: one list of keyword scores a text."""
    best, kept, first = list(seed), set(), None
    while len(kept) < len(scores) and best:
        rises = [(sum(max(0.0, s - b) for s, b in zip(row, best)) / len(best), -i) for i, row in enumerate(scores) if i not in kept]
        rise, i = max(rises)
        if rise < max(least, share * (first or 0.0)):
            break
        first = first or rise
        kept.add(-i)
        best = [max(s, b) for s, b in zip(scores[-i], best)]
    return sorted(kept | {i for i, t in enumerate(titles) if t})


def prune_blocks(texts: DataFrame, seeds: DataFrame, keep_titles: bool = False, share: float = 0.5, least: float = 0.01) -> DataFrame:
    """``sample_idx, unit, pos`` of the related texts worth showing beside a unit's anchor and caption.

    ``texts``: sample_idx, unit, pos, is_title, scores array<double> (of the question's keywords, in one order);
    ``seeds``: sample_idx, unit, scores of what is shown anyway. Units without a seed start at nothing;
    questions without keywords keep all their texts.
    """
    unit, key = texts.schema["unit"].dataType.simpleString(), texts.schema["sample_idx"].dataType.simpleString()
    rows = texts.groupBy("sample_idx", "unit").agg(F.array_sort(F.collect_list(F.struct("pos", "is_title", "scores"))).alias("t"))
    rows = rows.join(seeds.select("sample_idx", "unit", F.col("scores").alias("seed")), ["sample_idx", "unit"], "left")

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                scores = [list(x["scores"]) if x["scores"] is not None else [] for x in r.t]
                n = max(map(len, scores), default=0)
                seed = list(r.seed) if r.seed is not None else [0.0] * n
                keep = marginal_blocks(scores, seed, [keep_titles and bool(x["is_title"]) for x in r.t], share, least) if n else range(len(scores))
                out += [(r.sample_idx, r.unit, int(r.t[i]["pos"])) for i in keep]
            yield pd.DataFrame(out, columns=["sample_idx", "unit", "pos"])

    return rows.mapInPandas(run, f"sample_idx {key}, unit {unit}, pos int")
