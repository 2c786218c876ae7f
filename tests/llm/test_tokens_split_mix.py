import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import mix, split, tokens

if not os.path.exists(tokens.TOKENIZER):
    pytest.skip("no tokenizer file", allow_module_level=True)
ENC, SIZE = tokens.load()


def check(text, limit, overlap):
    raw = text.encode()
    pieces = split.split_text(text, ENC, SIZE, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(raw)
    for a, z, n in pieces:
        assert len(ENC.encode_ordinary(raw[a:z].decode())) <= limit or z - a <= 4
    for (a, z, _), (b, y, _) in zip(pieces, pieces[1:]):
        assert a <= b <= z < y


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence end. ", "\n", "\n\n", "漢字。", "x", "é", "  ", "it's ", "12,345 ", "“q” "]), max_size=300))
def test_pieces_cover_and_fit(parts):
    check("".join(parts), 40, 6)


@pytest.mark.parametrize("text", ["", "a", "a" * 9000, "漢" * 3000, " " * 5000, "\n" * 4000, "ab " * 4000])
def test_odd_texts(text):
    check(text, 128, 16)


def test_doubling_equals_walking():
    rng = random.Random(3)
    import numpy as np
    for _ in range(50):
        n = rng.randint(1, 400)
        nxt = np.array([min(n, i + rng.randint(1, 9)) for i in range(n)] + [n])
        walk, at = [0], 0
        while at < n:
            at = int(nxt[at])
            walk.append(at)
        assert split.cuts_by_doubling(nxt).tolist() == walk


def test_overlap_is_in_tokens():
    text = "The lamps along the quay were lit before dusk. " * 400
    pieces = split.split_text(text, ENC, SIZE)
    raw = text.encode()
    for (a, z, _), (b, _, _) in zip(pieces, pieces[1:]):
        assert len(ENC.encode_ordinary(raw[b:z].decode())) in (63, 64, 65)


def test_split_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "A sentence here. " * 900, "x"), (4, "A sentence here. " * 900, "x")], "doc_id bigint, text string, tokens string")
    got = split.split_oversized(df, "doc_id", "text").toPandas()
    assert set(got.doc_id) == {3, 4} and got.tokens.max() <= 1024
    assert [r.doc_id for r in split.oversized(df, "doc_id", "text").collect()] == [4]
    assert split.oversized(df.limit(0), "doc_id", "text").count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big", "big", "big", " Big", "small", "other"]), rng.randint(1, 400)) for i in range(4000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("source", mix.source_name(spark_col("source")))
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen = mix.mix(sized, targets, bucket_rows=100)
    rep = {r.source: r for r in mix.mix_report(sized, targets, chosen).collect()}
    total = sum(r[2] for r in rows)
    assert abs(rep["big"].actual_tokens - 0.5 * total) < 0.02 * total
    small = sum(t for _, s, t in rows if s == "small")
    assert abs(rep["small"].actual_tokens - min(3 * small, 0.4 * total)) < 0.02 * total
    assert rep["absent"].actual_tokens == 0 and rep["other"].actual_tokens == 0 and rep["other"].have_records > 0
    top = chosen.groupBy("source").max("copies").collect()
    assert all(r[1] <= {"big": 1, "small": 3}[r[0]] for r in top)
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in mix.mix(sized.repartition(3), targets, bucket_rows=100).collect()}
    assert mix.mix(sized.limit(0), targets).count() == 0


def test_copies_against_brute_force(spark, monkeypatch):
    """Every record is used the whole number of times below or above its expected copies, and their sum
    is that of the systematic draw: the integer boundaries that all expected copies cross from the offset on."""
    monkeypatch.setattr(mix, "BLOCK", 3)
    rng = random.Random(9)
    rows = [(i, rng.choice(["a"] * 6 + ["b"]), rng.choice([0, 1, 7, 300, 5000])) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 5), ("b", 0.3, 4)], "source string, target_share double, max_repeats int")
    chosen = {r.doc_id: r.copies for r in mix.mix(sized, targets, bucket_rows=20).collect()}
    total = sum(t for _, _, t in rows)
    for name, share, most in (("a", 0.7, 5), ("b", 0.3, 4)):
        mine = [(i, t) for i, s, t in rows if s == name]
        each = min(share * total / sum(t for _, t in mine), most)
        step = int(each * mix.ONE)
        used = [chosen.get(i, 0) for i, _ in mine]
        assert set(used) <= {int(each), int(each) + 1}
        assert abs(sum(used) - step * len(mine) / mix.ONE) <= 1
        assert abs(sum(t * c for (_, t), c in zip(mine, used)) / (each * sum(t for _, t in mine)) - 1) < 0.05


def test_runs_without_blanks_are_doubled_too():
    import numpy as np
    for text in ("根据图六有道路和桥梁建设" * 900, "日本語テキスト" * 900, "a" * 9000, "根据图6，有道路。" * 900):
        ends = np.cumsum(SIZE[np.asarray(ENC.encode_ordinary(text))])
        assert split.successors(text.encode(), ends, split.LIMIT, split.OVERLAP, text) is not None
        check(text, split.LIMIT, split.OVERLAP)


def test_sizes_count_null_as_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, "two words", "A b")], "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.tokens, r.source) for r in mix.sized_documents(df).collect()} == {(1, 0, None), (2, 2, "a_b")}


def spark_col(name):
    from pyspark.sql import functions as F
    return F.col(name)
