"""Page queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import pages as P
from quire.operators.tools import infer_by_sequence
from quire.plans.layout import _CAPTION, B, B1, MERGED, VIS
from quire.session import table


def _b(spark, d):
    return L.layout(table(spark, d, "ocr_blocks"))


def _probes(spark, d):
    """What each page's footers print: the least number, and a double page where two that follow each other stand with a dash."""
    text = F.coalesce("text", F.lit(""))
    n = F.regexp_extract(text, r"([0-9]{1,4})", 1).try_cast("int")
    second = F.regexp_extract(text, r"[0-9]{1,4}\s*[-–]\s*([0-9]{1,4})", 1).try_cast("int")
    f = _b(spark, d).filter(F.col("type") == "footer").select("doc_id", "page", n.alias("n"), F.coalesce(second == n + 1, F.lit(False)).alias("two")).filter("n is not null")
    return f.groupBy("doc_id", "page").agg(F.min("n").alias("n"), F.max("two").alias("two")).select("doc_id", "page", F.when(F.col("two"), "double").otherwise("single").alias("layout"), F.array("n").alias("printed"))


def pagination_vote(spark, d):
    return P.pagination(_probes(spark, d)).select("doc_id", "layout", F.round("confidence", 6).alias("confidence"), "offset", F.col("stride").cast("bigint").alias("stride"), F.col("intercept").cast("bigint").alias("intercept"))


def page_mapping(spark, d):
    s = table(spark, d, "samples").distinct()
    n = F.regexp_extract_all(F.coalesce("evidence_pages", F.lit("")), F.lit("[0-9]{1,6}"), F.lit(0))
    asked = s.select("doc_id", F.col("sample_idx").alias("key"), F.explode(F.array_distinct(n)).alias("p")).select("doc_id", "key", F.col("p").cast("int").alias("printed"))
    return P.to_physical(asked, P.pagination(_probes(spark, d)))


def sequence_infer(spark, d):
    """Every number up to the greatest that a figure's caption names, looked for by its place between numbered figures."""
    b = _b(spark, d)
    v = L.merge_adjacent(b)
    c = L.captions(v, b).select("doc_id", "page", "block_id", "caption_id").join(b.select("doc_id", F.col("block_id").alias("caption_id"), F.col("text").alias("caption")), ["doc_id", "caption_id"])
    u = v.join(c.select("doc_id", "block_id", "caption"), ["doc_id", "block_id"], "left").select(
        "doc_id", F.col("block_id").cast("string").alias("edge_id"), F.col("block_id").alias("seq"), F.lower("type").alias("type"), "page", F.col("y1").alias("top"), "caption")
    most = u.withColumn("n", F.regexp_extract(F.lower(F.coalesce("caption", F.lit(""))), r"(?:figure|fig)\s*([0-9]{1,9})", 1).try_cast("int")).filter("n is not null").groupBy("doc_id", F.col("type").alias("kind")).agg(F.max("n").alias("n"))
    wanted = most.select(F.lit(0).alias("sample_idx"), "doc_id", "kind", F.explode(F.sequence(F.lit(1), "n")).alias("id")).withColumn("id", F.col("id").cast("string"))
    return infer_by_sequence(u, wanted).select("kind", "id", "edge_id", "score").distinct()


def cross_page_arcs(spark, d):
    b = _b(spark, d).filter(F.col("type").isin("title", "figure_caption", "table_caption")).withColumn("text", F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " "))
    return P.cross_page_arcs(b).withColumn("weight", F.round("weight", 6))


def neighbour_expansion(spark, d):
    b = _b(spark, d)
    return P.expand_by_page(b.filter("type = 'table'").select("doc_id", "page", "block_id"), b).groupBy("doc_id", "new").agg(F.count("*").alias("n"))


def visual_floor(spark, d):
    return P.visual_floor(_b(spark, d).withColumn("score", F.coalesce("rec_conf", F.lit(0.5))), 3, 0.34).select("doc_id", "page", "block_id", "type")


def modality_diag(spark, d):
    m = P.modality(_b(spark, d).withColumn("score", F.coalesce("rec_conf", F.lit(0.5))))
    return m.select("doc_id", "type", "n", "share", F.round(F.col("mean_score") * F.col("n"), 4).alias("score_sum"))


QUERIES = {f.__name__: f for f in (pagination_vote, page_mapping, sequence_infer, cross_page_arcs, neighbour_expansion, visual_floor, modality_diag)}

_PR = B + r"""f AS (SELECT doc_id, page, try_cast(nullif(regexp_extract(coalesce(text,''), '([0-9]{1,4})', 1), '') AS INTEGER) AS n, try_cast(nullif(regexp_extract(coalesce(text,''), '[0-9]{1,4}\s*[-–]\s*([0-9]{1,4})', 1), '') AS INTEGER) AS n2 FROM b WHERE type = 'footer'),
 p0 AS (SELECT doc_id, page, CASE WHEN bool_or(coalesce(n2 = n + 1, false)) THEN 'double' ELSE 'single' END AS layout, min(n) AS n FROM f WHERE n IS NOT NULL GROUP BY doc_id, page),
 lv AS (SELECT doc_id, layout, count(*) AS k, min(page) AS first, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM p0 GROUP BY doc_id, layout), ly AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first, layout DESC) = 1),
 pr AS (SELECT p0.* FROM p0 JOIN ly USING (doc_id, layout)),
 off AS (SELECT doc_id, page - (n - 1) AS "offset", count(*) AS c, min(page) AS first FROM pr GROUP BY ALL),
 o AS (SELECT doc_id, "offset" FROM off QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first, "offset" DESC) = 1),
 fi AS (SELECT doc_id, page AS p1, n AS n1, lead(page) OVER w AS p2, lead(n) OVER w AS n2 FROM pr WINDOW w AS (PARTITION BY doc_id ORDER BY page, n) QUALIFY row_number() OVER w = 1),
 st AS (SELECT doc_id, p1, n1, CASE WHEN p2 IS NULL THEN 2 ELSE CAST(floor((n2 - n1)/(p2 - p1)::DOUBLE) AS BIGINT) END AS stride FROM fi)"""
_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '[^a-z0-9]+'), lambda x: length(x) >= 2))"
SQL = {
    "pagination_vote": _PR + " SELECT doc_id, layout, round(k/total::DOUBLE*CASE WHEN layout = 'double' AND k = 1 THEN 0.5 ELSE 1.0 END, 6) AS confidence, \"offset\", stride, n1 - stride*p1 AS intercept FROM ly JOIN o USING (doc_id) JOIN st USING (doc_id)",
    "page_mapping": _PR + ", s AS (SELECT DISTINCT * FROM samples), a AS (SELECT DISTINCT doc_id, sample_idx AS key, CAST(p AS INTEGER) AS printed FROM (SELECT doc_id, sample_idx, unnest(regexp_extract_all(coalesce(evidence_pages,''), '[0-9]{1,6}')) AS p FROM s)) SELECT * FROM (SELECT doc_id, key, printed, CAST(printed - 1 + coalesce(\"offset\", 0) AS INTEGER) AS page FROM a LEFT JOIN o USING (doc_id)) WHERE page >= 0",
    "sequence_infer": B + MERGED + ", " + _CAPTION + r""", u AS (SELECT m.doc_id, m.block_id, lower(m.type) AS kind, m.page, m.y1, TRY_CAST(nullif(regexp_extract(lower(coalesce(b.text,'')), '(?:figure|fig)\s*([0-9]{1,9})', 1), '') AS INTEGER) AS number
   FROM m LEFT JOIN cap USING (doc_id, page, block_id) LEFT JOIN b ON b.doc_id = m.doc_id AND b.block_id = cap.caption_id),
 pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY page, y1, block_id) AS place FROM u),
 pr AS (SELECT doc_id, kind, place, number, lead(place) OVER o AS np, lead(number) OVER o AS nn FROM pl WHERE number IS NOT NULL WINDOW o AS (PARTITION BY doc_id, kind ORDER BY place)),
 mx AS (SELECT doc_id, kind, unnest(range(1, top + 1)) AS num FROM (SELECT doc_id, kind, max(number) AS top FROM pl WHERE number IS NOT NULL GROUP BY doc_id, kind)),
 fs AS (SELECT mx.*, place, number, np, nn FROM mx JOIN pr ON pr.doc_id = mx.doc_id AND pr.kind = mx.kind AND number < num AND num < nn AND np > place + 1 QUALIFY row_number() OVER (PARTITION BY mx.doc_id, mx.kind, num ORDER BY place) = 1),
 sp AS (SELECT *, CASE WHEN np - place = 2 THEN place + 1 ELSE place + CAST(floor((num - number)/(nn - number)::DOUBLE*(np - place)) AS BIGINT) END AS spot FROM fs)
 SELECT DISTINCT sp.kind, CAST(num AS VARCHAR) AS id, CAST(pl.block_id AS VARCHAR) AS edge_id, CASE WHEN np - sp.place = 2 THEN 0.75 ELSE 0.65 END AS score FROM sp JOIN pl ON pl.doc_id = sp.doc_id AND pl.kind = sp.kind AND pl.place = sp.spot WHERE spot > sp.place AND spot < np""",
    "cross_page_arcs": B + f"t AS (SELECT doc_id, page, block_id, {_TOK} AS k FROM b WHERE type IN ('title','figure_caption','table_caption') AND length(trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' ')) > 0), p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, round(CASE WHEN len(a.k) > 0 AND len(c.k) > 0 THEN len(list_intersect(a.k, c.k))::DOUBLE/len(list_distinct(list_concat(a.k, c.k))) ELSE 0.0 END, 9) AS weight FROM t a JOIN t c ON a.doc_id = c.doc_id AND c.page = a.page + 1) SELECT doc_id, page, src, dst, round(weight, 6) AS weight FROM p WHERE weight >= 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, page, src ORDER BY weight DESC, dst) <= 3",
    "neighbour_expansion": B + "s AS (SELECT doc_id, page, block_id FROM b WHERE type = 'table'), n AS (SELECT DISTINCT b.doc_id, b.block_id FROM b JOIN s ON b.doc_id = s.doc_id AND abs(b.page - s.page) <= 1 WHERE b.type <> 'table') SELECT doc_id, \"new\", count(*) AS n FROM (SELECT doc_id, false AS \"new\" FROM s UNION ALL SELECT doc_id, true FROM n) GROUP BY ALL",
    "visual_floor": B + f"v AS (SELECT *, coalesce(rec_conf, 0.5) AS score, coalesce({VIS}, false) AS visual FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, visual ORDER BY score DESC, block_id) AS own FROM v) SELECT doc_id, page, block_id, type FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY (visual AND own <= 2) DESC, score DESC, block_id) <= 3",
    "modality_diag": B1 + "SELECT doc_id, type, count(*) AS n, round(count(*)/(sum(count(*)) OVER (PARTITION BY doc_id))::DOUBLE, 6) AS share, round(sum(coalesce(rec_conf, 0.5)), 4) AS score_sum FROM b GROUP BY doc_id, type",
}
