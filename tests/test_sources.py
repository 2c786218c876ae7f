import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators.monitor import window_rollup
from quire.sources import readers as R
from quire.streaming.rollup import append_to, read_stream, stream_rollup


def test_ocr_round_trip(spark, tmp_path):
    doc = {"document_id": "d", "pdf_path": "d.pdf", "total_pages": 1, "max_pages_processed": 1, "created_at": "x",
           "blocks": [{"block_id": 0, "page": 0, "bbox": [0, 0, 1, 1], "type": "text", "text": "a", "rec_conf": 0.9}, {"block_id": 1, "page": 0, "bbox": None, "type": "figure", "text": None, "rec_conf": None}]}
    (tmp_path / "d_ocr.json").write_text(json.dumps(doc, indent=1))
    b = R.ocr_blocks(R.read_ocr_documents(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(x.block_id, x.type, x.text) for x in b] == [(0, "text", "a"), (1, "figure", None)]
    assert R.read_ocr_documents(spark, str(tmp_path), doc_id="other").count() == 0


def test_samples_and_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"doc_id": "a", "question": "q0"}, {"doc_id": "b", "question": "q1"}]))
    assert [(r.sample_idx, r.question) for r in R.read_samples(spark, str(tmp_path / "s.json")).orderBy("sample_idx").collect()] == [(0, "q0"), (1, "q1")]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in R.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()) == [1, 2]


def test_environment_and_unfinished(spark, monkeypatch):
    monkeypatch.setenv("ROOT_OF_IT", "/x")
    assert R.expand_env({"p": ["$ROOT_OF_IT/a", 3], "q": "5$"}) == {"p": ["/x/a", 3], "q": "5$"}
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert [r.k for r in R.unfinished(a, b, "k").collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") * 97).cast("timestamp").alias("ts"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("event_type"), F.lit(1.5).alias("value"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    append_to(stream_rollup(read_stream(spark, str(tmp_path / "in"), e.schema), late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start, r.stage, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.stage, r.n) for r in window_rollup(e).collect()}
    last = max(r.ts for r in e.collect())
    assert got == {w for w in want if w[0] + timedelta(hours=1) <= last} and len(want - got) <= 3  # the open windows stay in the state


def test_page_listings(spark, tmp_path):
    for folder, names in (("a", ["x_1.png", "y_0.png"]), ("b", ["x_0.png", "x_1.png", "x_10.png", "y_0.png"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"p")
    p = R.first_listing(spark, [str(tmp_path / "none"), str(tmp_path / "a"), str(tmp_path / "b")])
    got = sorted((r.doc_id, r.page, r.path.split("/")[-2]) for r in p.collect())
    assert got == [("x", 0, "b"), ("x", 1, "b"), ("x", 10, "b"), ("y", 0, "a")]
    assert sorted((r.doc_id, r.page) for r in R.pick_pages(p, start=1, most=1).collect()) == [("x", 1)]
    assert {(r.doc_id, r.pages) for r in R.page_count(p).collect()} == {("x", 3), ("y", 1)}
    with pytest.raises(FileNotFoundError):
        R.pick_pages(p, only=[99], required=True)
    with pytest.raises(FileNotFoundError):
        R.first_listing(spark, [str(tmp_path / "none")])


def test_document_filter_is_exact(spark, tmp_path):
    for name in ("a", "a1"):
        (tmp_path / f"{name}_ocr.json").write_text(json.dumps({"document_id": name}))
    assert [r.document_id for r in R.read_ocr_documents(spark, str(tmp_path), doc_id="a").collect()] == ["a"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("d", 2), ("e", 1)], "document_id string, total_pages int")
    blocks = spark.createDataFrame([("d", 1, 0, [0.0], "text", "b", 0.9), ("d", 0, 0, None, "title", "a", None)], "doc_id string, block_id int, page int, bbox array<double>, block_type string, text string, rec_conf double")
    R.write_ocr(docs, blocks, str(tmp_path / "ocr"))
    back = {r.document_id: r for r in spark.read.json(str(tmp_path / "ocr")).collect()}
    assert [b.text for b in back["d"].blocks] == ["a", "b"] and back["d"].statistics.title == 1 and back["e"].blocks is None
    s = R.with_ranked_pages(docs.selectExpr("total_pages as sample_idx"), spark.createDataFrame([(2, 7, 0.1), (2, 3, 0.9)], "sample_idx int, page int, score double"), 1)
    assert {(r.sample_idx, tuple(r.image_top_1_question)) for r in s.collect()} == {(2, (3,)), (1, ())}
    R.write_edge_list(spark.createDataFrame([(1, 2, 0.5, "before")], "src int, dst int, weight double, kind string"), str(tmp_path / "arcs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "arcs")).collect()] == ['1 2 {"weight":0.5,"kind":"before"}']


def test_cache_computes_once(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.selectExpr("k", "k * 10 as v")

    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.v) for r in R.cached(a, str(tmp_path / "c"), "k", compute).collect()} == {(1, 10), (2, 20)}
    assert {(r.k, r.v) for r in R.cached(b, str(tmp_path / "c"), "k", compute).collect()} == {(2, 20), (3, 30)}
    assert seen == [2, 1]
