"""Layout queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import layout as L
from quire.session import table

B = """WITH b AS (SELECT DISTINCT doc_id, block_id, page, bbox[1] AS x1, bbox[2] AS y1, bbox[3] AS x2, bbox[4] AS y2, block_type AS type, text, rec_conf
 FROM ocr_blocks), """
B1 = B.rstrip(", ") + " "
VIS = "lower(type) IN ('figure','table','chart','map','diagram','graph')"
CAPS = "'figure_caption','table_caption','chart_caption','map_caption','diagram_caption','graph_caption'"
OVER = "greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1))"
MERGED = f"""v AS (SELECT *, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2, lag(type) OVER w AS pt FROM b
   WHERE {VIS} AND x1 IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page ORDER BY y1, block_id)),
 i AS (SELECT *, sum(CASE WHEN type = pt AND y1 - py2 < 20 AND least(x2 - x1, px2 - px1) > 0
     AND least(x2, px2) - greatest(x1, px1) > 0.8 * least(x2 - x1, px2 - px1) THEN 0 ELSE 1 END)
   OVER (PARTITION BY doc_id, page ORDER BY y1, block_id ROWS UNBOUNDED PRECEDING) AS isle FROM v),
 m AS (SELECT doc_id, page, arg_min(block_id, (y1, block_id)) AS block_id, arg_min(type, (y1, block_id)) AS type, min(x1) AS x1, min(y1) AS y1,
   max(x2) AS x2, max(y2) AS y2, count(*) AS merged FROM i GROUP BY doc_id, page, isle)"""


def _b(spark, d, text=True):
    return L.layout(table(spark, d, "ocr_blocks"), text)


def blocks_by_type_page(spark, d):
    return _b(spark, d, text=False).groupBy("doc_id", "page", "type").agg(F.count("*").alias("n"))


def type_histogram(spark, d):
    return _b(spark, d, text=False).groupBy("type").agg(F.count("*").alias("n"))


def ocr_doc_stats(spark, d):
    return L.document_stats(_b(spark, d))


def semantic_markers(spark, d):
    return L.markers(_b(spark, d))


def caption_refine(spark, d):
    b = _b(spark, d)
    return b.select("doc_id", "block_id", "type", X.refine_type(F.col("type"), F.col("text")).alias("refined")).groupBy("type", "refined").agg(F.count("*").alias("n"))


def merge_adjacent(spark, d):
    return L.merge_adjacent(_b(spark, d, text=False))


def caption_join(spark, d):
    b = _b(spark, d, text=False)
    return L.captions(L.merge_adjacent(b), b)


def title_asof(spark, d):
    b = _b(spark, d, text=False)
    return L.nearest_titles(L.merge_adjacent(b), b)


def visual_types(spark, d):
    b = _b(spark, d)
    c = L.captions(L.merge_adjacent(b), b).join(b.select("doc_id", F.col("block_id").alias("caption_id"), "text"), ["doc_id", "caption_id"])
    v = L.merge_adjacent(b).select("doc_id", "block_id", "type").join(c.select("doc_id", "block_id", "text"), ["doc_id", "block_id"], "left")
    return v.select("doc_id", "block_id", X.visual_type(F.col("type"), F.col("text")).alias("visual_type"))


def reading_order(spark, d):
    return L.reading_order(_b(spark, d, text=False))


def page_chain(spark, d):
    return L.page_chain(_b(spark, d, text=False))


def spatial_pairs(spark, d):
    return L.spatial_pairs(_b(spark, d, text=False)).select("doc_id", "page", "src", "dst", F.round("distance", 6).alias("distance"), F.round("iou", 6).alias("iou"), "direction",
                                                F.round("weight", 6).alias("weight"))


def page_knn(spark, d):
    return L.page_knn(_b(spark, d, text=False)).withColumn("distance", F.round("distance", 6))


def title_child(spark, d):
    return L.title_children(_b(spark, d, text=False))


def caption_below(spark, d):
    return L.below_of(_b(spark, d, text=False), ("figure", "table", "chart", "map", "diagram", "graph"), L.CAPTION_TYPES, 0.2 * 1584)


def list_next(spark, d):
    return L.below_of(_b(spark, d, text=False), ("list",), ("list",), 0.1 * 1584, 0.2)


def point_in_box(spark, d):
    b = _b(spark, d).filter("x1 is not null")
    return L.text_of_boxes(b, b).withColumn("conf", F.round("conf", 6)).select("doc_id", "page", "block_id", "conf", "lines", F.length("joined").alias("joined_length"))


def box_features(spark, d):
    f = G.features(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    k = G.crop(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 1224.0, 1584.0)
    return _b(spark, d).select("doc_id", "block_id", *[F.round(c, 6).alias(n) for n, c in {**f, **k}.items()])


def spatial_locate(spark, d):
    return L.locate(_b(spark, d, text=False), "top left")


def page_dimensions(spark, d):
    return L.page_extent(_b(spark, d, text=False))


QUERIES = {f.__name__: f for f in (blocks_by_type_page, type_histogram, ocr_doc_stats, semantic_markers, caption_refine, merge_adjacent, caption_join, title_asof, visual_types,
                                   reading_order, page_chain, spatial_pairs, page_knn, title_child, caption_below, list_next, point_in_box, box_features, spatial_locate,
                                   page_dimensions)}

_DIST = "sqrt(((a.x1+a.x2-c.x1-c.x2)/2)*((a.x1+a.x2-c.x1-c.x2)/2) + ((a.y1+a.y2-c.y1-c.y2)/2)*((a.y1+a.y2-c.y1-c.y2)/2))"
_INTER = "(greatest(0.0, least(a.x2,c.x2)-greatest(a.x1,c.x1)) * greatest(0.0, least(a.y2,c.y2)-greatest(a.y1,c.y1)))"
_UNION = f"((a.x2-a.x1)*(a.y2-a.y1) + (c.x2-c.x1)*(c.y2-c.y1) - {_INTER})"
_RATIO = f"(CASE WHEN least(a.x2-a.x1, c.x2-c.x1) > 0 THEN {OVER}/least(a.x2-a.x1, c.x2-c.x1) ELSE 0 END)"
_CAPTION = f"""pc AS (SELECT a.doc_id, a.page, a.block_id, c.block_id AS cid, CASE WHEN c.type = 'text' THEN 1 ELSE 0 END AS plain,
   CASE WHEN c.y1 >= a.y2 THEN 0 ELSE 1 END AS side, CASE WHEN c.y1 >= a.y2 THEN c.y1 - a.y2 ELSE a.y1 - c.y2 END AS gap
   FROM m a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page AND a.block_id <> c.block_id
   WHERE c.type IN ({CAPS},'caption','text') AND c.x1 IS NOT NULL AND (c.y1 >= a.y2 OR a.y1 >= c.y2) AND {OVER} >= 0.3 * (a.x2 - a.x1)),
 cap AS (SELECT doc_id, page, block_id, cid AS caption_id, plain, side FROM pc WHERE gap < 300
   QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY plain, side, gap, cid) = 1)"""
_CASES = " ".join(f"WHEN type IN ('text','unknown','caption') AND regexp_matches(h, '^(?:{n})\\.?\\s+[0-9]+') THEN '{t}'" for n, t in X._CAPTION_NOUNS)
_VCASES = " ".join(f"WHEN regexp_matches(h, '(?:^|[^a-z]){p}') THEN '{n}'" for n, p in (
    ("table", "table"), ("figure", "(?:figure|fig\\.)"), ("chart", "chart"), ("graph", "graph"), ("map", "map"), ("diagram", "diagram")))

SQL = {
    "blocks_by_type_page": B1 + "SELECT doc_id, page, type, count(*) AS n FROM b GROUP BY ALL",
    "type_histogram": B1 + "SELECT type, count(*) AS n FROM b GROUP BY ALL",
    "ocr_doc_stats": B1 + f"SELECT doc_id, count(*) AS blocks, CAST(max(page) + 1 AS BIGINT) AS pages, count(*) FILTER (WHERE {VIS}) AS visuals, count(*) FILTER (WHERE text IS NULL) AS textless FROM b GROUP BY doc_id",
    "semantic_markers": B1 + f"SELECT doc_id, count(*) FILTER (WHERE type IN ('title','section_header')) AS titles, count(*) FILTER (WHERE type IN ({CAPS})) AS captions, count(*) FILTER (WHERE type IN ('text','list')) AS texts FROM b WHERE trim(text) <> '' GROUP BY doc_id",
    "caption_refine": B + f"h AS (SELECT *, lower(substring(trim(coalesce(text,'')), 1, 50)) AS h FROM b) SELECT type, refined, count(*) AS n FROM (SELECT type, CASE {_CASES} ELSE type END AS refined FROM h) GROUP BY ALL",
    "merge_adjacent": B + MERGED + " SELECT doc_id, page, block_id, type, x1, y1, x2, y2, merged FROM m",
    "caption_join": B + MERGED + ", " + _CAPTION + " SELECT doc_id, page, block_id, caption_id, plain, side FROM cap",
    "title_asof": B + MERGED + """, t AS (SELECT * FROM b WHERE type IN ('title','section_header') AND x1 IS NOT NULL),
 p AS (SELECT a.doc_id, a.page, a.block_id, c.block_id AS title_id, c.page AS title_page,
   round(CASE WHEN c.page = a.page THEN abs(a.y1 - c.y2)/1000.0 ELSE CAST(a.page - c.page AS DOUBLE) END, 9) AS score
   FROM m a JOIN t c ON a.doc_id = c.doc_id AND c.page BETWEEN a.page - 3 AND a.page WHERE c.page < a.page OR c.y2 <= a.y1 OR """ + OVER + """ < 50)
 SELECT doc_id, page, block_id, title_id, title_page FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY score, -title_page, title_id) = 1""",
    "visual_types": B + MERGED + ", " + _CAPTION + f""", h AS (SELECT m.doc_id, m.block_id, m.type, lower(substring(coalesce(b.text,''), 1, 150)) AS h FROM m LEFT JOIN cap USING (doc_id, block_id)
   LEFT JOIN b ON b.doc_id = m.doc_id AND b.block_id = cap.caption_id) SELECT doc_id, block_id, CASE {_VCASES} ELSE type END AS visual_type FROM h""",
    "reading_order": B1 + "SELECT doc_id, page, block_id, row_number() OVER w AS place, lead(block_id) OVER w AS next_id FROM b WHERE x1 IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page ORDER BY round_even(y1/8, 0), x1, block_id)",
    "page_chain": B + "e AS (SELECT doc_id, page, arg_max(block_id, (y2, block_id)) AS last, arg_min(block_id, (y1, block_id)) AS first FROM b WHERE x1 IS NOT NULL GROUP BY ALL) SELECT a.doc_id, a.page, a.last AS src, c.first AS dst FROM e a JOIN e c ON a.doc_id = c.doc_id AND c.page = a.page + 1",
    "spatial_pairs": B + f"""p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, {_DIST} AS distance, CASE WHEN {_UNION} > 0 THEN {_INTER}/{_UNION} ELSE 0 END AS iou,
   degrees(atan2((c.y1+c.y2-a.y1-a.y2)/2, (c.x1+c.x2-a.x1-a.x2)/2)) AS g FROM b a JOIN b c USING (doc_id, page) WHERE a.block_id <> c.block_id AND a.x1 IS NOT NULL AND c.x1 IS NOT NULL)
 SELECT doc_id, page, src, dst, round(distance, 6) AS distance, round(iou, 6) AS iou, CASE WHEN abs(g) <= 30 THEN 'right' WHEN abs(g) >= 150 THEN 'left' WHEN g >= 60 AND g <= 120 THEN 'below'
   WHEN g >= -120 AND g <= -60 THEN 'above' ELSE 'near' END AS direction, round(greatest(1.0/(1.0+distance/300.0)+iou, 1e-8), 6) AS weight FROM p WHERE distance < 300 OR iou > 0.05""",
    "page_knn": B + f"""p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, {_DIST} AS distance FROM b a JOIN b c USING (doc_id, page) WHERE a.block_id <> c.block_id AND a.x1 IS NOT NULL AND c.x1 IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, src ORDER BY distance, dst) AS rank FROM p) SELECT doc_id, page, src, dst, round(distance, 6) AS distance, rank FROM r WHERE rank <= 6 AND src < dst""",
    "title_child": B + f"""p AS (SELECT a.doc_id, a.page, a.block_id, c.block_id AS tid, c.y1 AS ty FROM b a JOIN b c USING (doc_id, page) WHERE a.type NOT IN ('title','section_header') AND c.type IN ('title','section_header')
   AND a.x1 IS NOT NULL AND c.x1 IS NOT NULL AND c.y2 <= a.y1 AND a.y1 - c.y2 <= 0.25*1584.0 AND {_RATIO} >= 0.2) SELECT doc_id, page, block_id, arg_max(tid, (ty, tid)) AS title_id FROM p GROUP BY ALL""",
    "caption_below": B + f"""p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, c.y1 - a.y2 AS gap FROM b a JOIN b c USING (doc_id, page) WHERE {VIS.replace('type', 'a.type')} AND c.type IN ({CAPS}) AND a.block_id <> c.block_id
   AND a.x1 IS NOT NULL AND c.x1 IS NOT NULL AND c.y1 >= a.y2 AND c.y1 - a.y2 <= 0.2*1584) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page, src ORDER BY gap, dst) = 1""",
    "list_next": B + f"""p AS (SELECT a.doc_id, a.page, a.block_id AS src, c.block_id AS dst, c.y1 - a.y2 AS gap FROM b a JOIN b c USING (doc_id, page) WHERE a.type = 'list' AND c.type = 'list' AND a.block_id <> c.block_id
   AND a.x1 IS NOT NULL AND c.x1 IS NOT NULL AND c.y1 >= a.y2 AND c.y1 - a.y2 <= 0.1*1584 AND {_RATIO} >= 0.2) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page, src ORDER BY gap, dst) = 1""",
    "point_in_box": B + """p AS (SELECT a.doc_id, a.page, a.block_id, c.rec_conf, coalesce(c.text, '') AS t FROM b a JOIN b c USING (doc_id, page) WHERE a.x1 IS NOT NULL AND c.x1 IS NOT NULL
   AND (c.x1+c.x2)/2 BETWEEN a.x1 AND a.x2 AND (c.y1+c.y2)/2 BETWEEN a.y1 AND a.y2)
 SELECT doc_id, page, block_id, round(avg(rec_conf), 6) AS conf, count(*) AS lines, CAST(sum(length(t)) + count(*) - 1 AS INTEGER) AS joined_length FROM p GROUP BY ALL""",
    "box_features": B1 + """SELECT doc_id, block_id, round(x2-x1,6) AS width, round(y2-y1,6) AS height, round((x1+x2)/2,6) AS cx, round((y1+y2)/2,6) AS cy, round((x2-x1)*(y2-y1),6) AS area,
   round(CASE WHEN y2-y1 = 0 THEN 0.0 ELSE (x2-x1)/(y2-y1) END,6) AS aspect_ratio, round(CASE WHEN x1 IS NULL THEN 0.0 ELSE greatest(0.0, x1-(x2-x1)*0.1) END,6) AS "left",
   round(CASE WHEN x1 IS NULL THEN 0.0 ELSE greatest(0.0, y1-(y2-y1)*0.1) END,6) AS top, round(CASE WHEN x1 IS NULL THEN 1224.0 ELSE least(1224.0, x2+(x2-x1)*0.1) END,6) AS "right",
   round(CASE WHEN x1 IS NULL THEN 1584.0 ELSE least(1584.0, y2+(y2-y1)*0.1) END,6) AS bottom FROM b""",
    "spatial_locate": B + f"""e AS (SELECT doc_id, page, max(x2) AS w, max(y2) AS h FROM b GROUP BY ALL), s AS (SELECT doc_id, page, block_id, round(1.0 - ((y1+y2)/2/h + (x1+x2)/2/w)/2, 9) AS score FROM b JOIN e USING (doc_id, page)
   WHERE {VIS} AND x1 IS NOT NULL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, block_id) = 1""",
    "page_dimensions": B1 + "SELECT doc_id, page, max(x2) AS width, max(y2) AS height FROM b GROUP BY ALL",
}
