"""Coverage, packing, rerank and matching queries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import evidence as Ev
from quire.operators import layout as L
from quire.operators import retrieval as Rt
from quire.plans.retrieval import _TU, K, _cands, _matched, _s, _scored
from quire.session import table


def coverage(spark, d):
    w, found = _matched(spark, d)
    held = w.join(found, ["doc_id", "keyword"]).select("sample_idx", F.col("keyword").alias("constraint"))
    want = _s(spark, d).select("sample_idx").join(w.select("sample_idx", F.col("keyword").alias("constraint")), "sample_idx", "left")
    return Ev.coverage(want, held).withColumn("coverage", F.round("coverage", 6))


def evidence_packing(spark, d):
    return Ev.pack(_cands(spark, d), "tool_seq", 6)


def rerank_mix(spark, d):
    s = _scored(spark, d).select(F.col("sample_idx").alias("query_id"), F.col("block_id").alias("unit"), "score", "coverage")
    return Ev.rerank(s, "score", "coverage").select("query_id", "unit", F.round("mixed", 6).alias("mixed"), "rank")


def neighbour_avg(spark, d):
    b = L.layout(table(spark, d, "ocr_blocks"))
    arcs = L.reading_order(b).filter("next_id is not null").select("doc_id", "page", F.col("block_id").alias("src"), F.col("next_id").alias("dst"))
    s = b.filter("x1 is not null").select("doc_id", "page", "block_id", F.coalesce("rec_conf", F.lit(0.5)).alias("score"))
    return Ev.neighbour_average(s, arcs, ["doc_id", "page"]).withColumn("score", F.round("score", 6))


def caption_matching(spark, d):
    return Ev.match_captions(L.layout(table(spark, d, "ocr_blocks")))


QUERIES = {f.__name__: f for f in (coverage, evidence_packing, rerank_mix, neighbour_avg, caption_matching)}
SQL = {
    "coverage": K + ", f AS (SELECT DISTINCT kw.sample_idx, kw.keyword FROM kw JOIN mt USING (doc_id, keyword)) SELECT s.sample_idx, count(kw.keyword) AS constraints, count(f.keyword) AS satisfied, round(CASE WHEN count(kw.keyword) = 0 THEN 1.0 ELSE count(f.keyword)/count(kw.keyword)::DOUBLE END, 6) AS coverage FROM (SELECT DISTINCT sample_idx FROM s) s LEFT JOIN kw USING (sample_idx) LEFT JOIN f ON f.sample_idx = kw.sample_idx AND f.keyword = kw.keyword GROUP BY s.sample_idx",
    "evidence_packing": _TU + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample_idx, tool_seq ORDER BY unit) AS turn, min(unit) OVER (PARTITION BY sample_idx, tool_seq) AS arrival FROM tu), x AS (SELECT *, dense_rank() OVER (PARTITION BY sample_idx ORDER BY arrival) AS number, row_number() OVER (PARTITION BY sample_idx ORDER BY turn, arrival, unit) AS place FROM r) SELECT sample_idx, chr(CAST(64 + number AS INTEGER)) AS label, place, unit FROM x WHERE place <= 6",
    "rerank_mix": K + ", m AS (SELECT sample_idx AS query_id, block_id AS unit, round(0.7*score + (1 - 0.7)*coverage, 9) AS mixed FROM sc) SELECT query_id, unit, round(mixed, 6) AS mixed, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, unit) AS rank FROM m QUALIFY rank <= 5",
    "neighbour_avg": """WITH b AS (SELECT DISTINCT doc_id, block_id, page, bbox[1] AS x1, bbox[2] AS y1, rec_conf FROM (SELECT DISTINCT * FROM ocr_blocks)),
 o AS (SELECT doc_id, page, block_id AS a, lead(block_id) OVER (PARTITION BY doc_id, page ORDER BY round_even(y1/8, 0), x1, block_id) AS z FROM b WHERE x1 IS NOT NULL),
 g AS (SELECT doc_id, page, a, z FROM o WHERE z IS NOT NULL UNION SELECT doc_id, page, z, a FROM o WHERE z IS NOT NULL), s AS (SELECT doc_id, page, block_id, coalesce(rec_conf, 0.5) AS score FROM b WHERE x1 IS NOT NULL),
 n AS (SELECT g.doc_id, g.page, g.a AS block_id, avg(s.score) AS near FROM g JOIN s ON s.doc_id = g.doc_id AND s.page = g.page AND s.block_id = g.z GROUP BY ALL)
 SELECT s.doc_id, s.page, s.block_id, round(s.score + 0.2*coalesce(near, 0.0), 6) AS score FROM s LEFT JOIN n USING (doc_id, page, block_id)""",
}
