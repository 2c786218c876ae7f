"""Queries of arcs and links by likeness, of the block graph and its ranks, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.jsonx import page_probe
from quire.operators import layout as L
from quire.operators import ranking as Rk
from quire.operators import similarity as Si
from quire.plans.layout import _CAPTION, B, MERGED
from quire.plans.layout import SQL as LAYOUT
from quire.session import cut, table


def _b(spark, d):
    return cut(L.layout(table(spark, d, "ocr_blocks")))


def similar_next(spark, d):
    b = _b(spark, d)
    arcs = L.page_knn(b)
    return Si.similar_next(b, arcs).withColumn("weight", F.round("weight", 6))


def co_occurrence(spark, d):
    b = _b(spark, d)
    return Si.co_occurrence(b, L.title_children(b)).withColumn("weight", F.round("weight", 6))


def related_texts(spark, d):
    b = _b(spark, d)
    v = L.merge_adjacent(b)
    return Si.related_texts(v, L.captions(v, b), b).withColumn("similarity", F.round("similarity", 6))


def block_graph(spark, d):
    return L.block_graph(_b(spark, d)).withColumn("weight", F.round("weight", 4))


def document_rank(spark, d):
    """Ranks of all blocks in the graph of their whole document, titles preferred, mixed with their confidence."""
    b = _b(spark, d).filter("x1 is not null")
    n = b.select("doc_id", "block_id", F.when(F.col("type") == "title", 2.0).otherwise(1.0).alias("personal"))
    ranks = Rk.document_rank(n, L.block_graph(b), ["doc_id"], rounds=8)
    scores = b.groupBy("doc_id", "block_id").agg(F.max(F.coalesce("rec_conf", F.lit(0.0))).alias("score"))
    return Rk.mix_ranks(ranks, scores, ["doc_id"]).withColumn("score", F.round("score", 6))


def spatial_hints(spark, d):
    h = L.spatial_hint(F.col("question"))
    return table(spark, d, "samples").select("sample_idx", "question").distinct().select("sample_idx", h["relation"].alias("relation"), h["unit"].alias("unit"), *[h[k].alias(k) for k in L.DIRECTIONS])


def page_probes(spark, d):
    """Replies of a page probe, read: here made of each page's footer texts."""
    n = F.regexp_extract(F.coalesce("text", F.lit("")), r"([0-9]{1,4})", 1)
    f = table(spark, d, "ocr_blocks").filter("block_type = 'footer'").select("doc_id", "block_id", "text").distinct()
    reply = F.concat(F.lit("It reads:\n{\"found_pages\": [\""), n, F.lit("\", \"iv\"], \"layout\":\n\"double\"} so far"))
    p = page_probe(F.when(n != "", reply).otherwise("no number"))
    return f.select("doc_id", "block_id", p["layout"].alias("layout"), F.array_join(p["found_pages"], ",").alias("pages"))


QUERIES = {f.__name__: f for f in (similar_next, co_occurrence, related_texts, block_graph, document_rank, spatial_hints, page_probes)}

_TOKENS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({},'')), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2))"
_VEC = "list_transform(range(16), lambda d: len(list_filter(list_transform({}, lambda w: (ascii(w)*31 + length(w)) % 16), lambda s: s = d))::DOUBLE)"
_COS = "CASE WHEN list_dot_product({a}, {a})*list_dot_product({c}, {c}) > 0 THEN list_dot_product({a}, {c})/(sqrt(list_dot_product({a}, {a}))*sqrt(list_dot_product({c}, {c}))) ELSE 0.0 END"
_PLACED = f"""o AS (SELECT doc_id, page, block_id, type, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y1/8, 0), x1, block_id) AS place, {_TOKENS.format('text')} AS tk
   FROM b WHERE x1 IS NOT NULL AND type IN ('text','list','title','section_header') AND trim(text) <> ''), ov AS (SELECT *, {_VEC.format('tk')} AS v FROM o)"""
_SIM = "(1.0 + " + _COS.format(a="a.v", c="c.v") + ")/2"
_KNN = LAYOUT["page_knn"]
SQL = {
    "similar_next": B + _PLACED + f""", p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, c.place, {_SIM} AS sim FROM ov a JOIN ov c ON a.doc_id = c.doc_id AND a.page = c.page AND a.place < c.place),
 t AS (SELECT * FROM p WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id, page, src ORDER BY round(sim, 9) DESC, place) <= 2), k AS ({_KNN})
 SELECT t.doc_id, t.page, t.src, t.dst, round(0.6*sim, 6) AS weight FROM t ANTI JOIN k ON k.doc_id = t.doc_id AND k.page = t.page AND k.src = t.src AND k.dst = t.dst""",
    "co_occurrence": B + _PLACED + f""", tc AS ({LAYOUT['title_child']}), x AS (SELECT ov.*, coalesce(tc.title_id, -1) AS tid FROM ov LEFT JOIN tc USING (doc_id, page, block_id) WHERE type IN ('text','list')),
 p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, c.place, {_SIM} AS sim, CASE WHEN len(a.tk) > 0 AND len(c.tk) > 0 THEN len(list_intersect(a.tk, c.tk))::DOUBLE/len(list_distinct(list_concat(a.tk, c.tk))) ELSE 0.0 END AS jac
   FROM x a JOIN x c ON a.doc_id = c.doc_id AND a.page = c.page AND a.tid = c.tid AND a.place < c.place)
 SELECT doc_id, page, src, dst, round((sim + jac)/2, 6) AS weight FROM p WHERE sim >= 0.4 AND jac >= 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, page, src ORDER BY round((sim + jac)/2, 9) DESC, place) = 1""",
    "related_texts": B + MERGED + ", " + _CAPTION + f""", cv AS (SELECT cap.doc_id, cap.page, cap.block_id, {_VEC.format(_TOKENS.format('b.text'))} AS v FROM cap JOIN b ON b.doc_id = cap.doc_id AND b.block_id = cap.caption_id),
 tx AS (SELECT b.doc_id, b.page, b.block_id AS text_id, {_VEC.format(_TOKENS.format('text'))} AS w FROM b ANTI JOIN cap ON cap.doc_id = b.doc_id AND cap.caption_id = b.block_id WHERE b.type = 'text' AND length(trim(text)) > 5 AND rec_conf >= 0.9),
 p AS (SELECT cv.doc_id, cv.block_id, text_id, tx.page AS look, {_COS.format(a='cv.v', c='tx.w')} AS s FROM cv JOIN tx ON cv.doc_id = tx.doc_id AND tx.page BETWEEN cv.page - 2 AND cv.page + 2)
 SELECT doc_id, block_id, text_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY round(s, 9) DESC, look, text_id) AS rank FROM p WHERE s > 0.25 QUALIFY rank <= 3""",
    "spatial_hints": r"""SELECT DISTINCT sample_idx, nullif(regexp_extract(q, '(below|above|under|over|next to|beside)\s+(?:figure|table|chart)\s*[0-9]+', 1), '') AS relation,
   nullif(regexp_extract(q, '(?:below|above|under|over|next to|beside)\s+((?:figure|table|chart)\s*[0-9]+)', 1), '') AS unit,
   contains(q, 'top') OR contains(q, 'upper') OR contains(q, 'above') AS top, contains(q, 'bottom') OR contains(q, 'lower') OR contains(q, 'below') AS bottom, contains(q, 'left') AS "left", contains(q, 'right') AS "right",
   contains(q, 'center') OR contains(q, 'middle') AS center FROM (SELECT sample_idx, lower(coalesce(question,'')) AS q FROM samples)""",
    "page_probes": "SELECT doc_id, block_id, CASE WHEN n <> '' THEN 'double' END AS layout, CASE WHEN n <> '' THEN n END AS pages FROM (SELECT DISTINCT doc_id, block_id, text, regexp_extract(coalesce(text,''), '([0-9]{1,4})', 1) AS n FROM ocr_blocks WHERE block_type = 'footer')",
    "block_graph": "WITH al AS (" + " UNION ALL ".join((
        f"SELECT doc_id, block_id AS src, next_id AS dst, 0 AS no, 'before' AS kind, 1.0::DOUBLE AS weight FROM ({LAYOUT['reading_order']}) WHERE next_id IS NOT NULL",
        f"SELECT doc_id, src, dst, 1, 'spatial', 1.5/(1.0 + distance/300.0) FROM ({_KNN})",
        f"SELECT doc_id, title_id, block_id, 2, 'title', 0.8 FROM ({LAYOUT['title_child']})",
        f"SELECT doc_id, src, dst, 3, 'caption', 0.9 FROM ({LAYOUT['caption_below']})",
        f"SELECT doc_id, src, dst, 4, 'list', 0.7 FROM ({LAYOUT['list_next']})",
        f"SELECT doc_id, src, dst, 5, 'page', 0.5 FROM ({LAYOUT['page_chain']})")) + ") SELECT doc_id, src, dst, kind, round(weight, 4) AS weight FROM al QUALIFY row_number() OVER (PARTITION BY doc_id, src, dst ORDER BY no, weight) = 1",
}
