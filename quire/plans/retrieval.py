"""Retrieval and selection queries and their SQL twins. Units are captions and titles of the blocks' pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import normalize_dashes
from quire.operators import retrieval as Rt
from quire.session import table

CAPS = ("figure_caption", "table_caption", "chart_caption", "map_caption", "diagram_caption", "graph_caption", "title")


def _s(spark, d):
    return table(spark, d, "samples").distinct()


def _u(spark, d):
    return table(spark, d, "ocr_blocks").filter(F.col("block_type").isin(*CAPS)).select("doc_id", "block_id", "page", "text").distinct()


def _matched(spark, d):
    kw, u = Rt.keywords(_s(spark, d)), _u(spark, d)
    found = Rt.matches(kw, u, "block_id", "text")
    return Rt.idf(kw, found, u, "block_id"), found


def _scored(spark, d):
    return Rt.keyword_scores(*_matched(spark, d), "block_id")


def idf_weights(spark, d):
    return _matched(spark, d)[0].withColumn("idf", F.round("idf", 6))


def keyword_score(spark, d):
    return _scored(spark, d).groupBy("sample_idx").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.max("matched").alias("most"))


def keyword_topk(spark, d):
    return Rt.top_k(_scored(spark, d), ["sample_idx"], [F.col("score").desc(), F.col("block_id")], 5).select("sample_idx", "block_id", F.round("score", 6).alias("score"), "rank")


def keyword_fuzzy_topk(spark, d):
    """Top units where words like a keyword count by their likeness; misread words are found."""
    kw, u = Rt.keywords(_s(spark, d)), _u(spark, d)
    index = Rt.index_words(u, "block_id", "text")
    found = Rt.like_words(kw, index).join(index, "word").groupBy("doc_id", "keyword", "block_id").agg(F.max("likeness").alias("strength"))
    s = Rt.keyword_scores(Rt.idf(kw, found, u, "block_id"), found, "block_id")
    return Rt.top_k(s, ["sample_idx"], [F.col("score").desc(), F.col("block_id")], 5).select("sample_idx", "block_id", F.round("score", 6).alias("score"), "rank")


def occurrence_count(spark, d):
    """How often each keyword stands in its document's blocks, dashes read as blanks, and on how many pages."""
    kw = Rt.keywords(_s(spark, d), normalize_dashes)
    b = table(spark, d, "ocr_blocks").select("doc_id", "block_id", "page", "text").distinct()
    j = Rt.matches(kw, b, "block_id", "text", normalize_dashes).join(b, ["doc_id", "block_id"]).withColumn("t", normalize_dashes(F.col("text")))
    times = ((F.length("t") - F.length(F.replace("t", "keyword"))) / F.length("keyword")).cast("bigint")
    n = j.withColumn("n", times).filter("n > 0").groupBy("doc_id", "keyword").agg(F.sum("n").alias("times"), F.count_distinct("page").alias("pages"))
    return kw.join(n, ["doc_id", "keyword"]).select("sample_idx", "keyword", "times", "pages")


def typed_count(spark, d):
    b = table(spark, d, "ocr_blocks").select("doc_id", "block_id", "page", "block_type").distinct()
    return b.groupBy("doc_id", F.col("block_type").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))


def _visuals(spark, d):
    return table(spark, d, "ocr_blocks").select("doc_id", "block_id", "page", "block_type").distinct().filter(F.lower("block_type").isin("figure", "table", "chart", "map", "diagram", "graph"))


def filter_type_fallback(spark, d):
    """Visual blocks of the type a question names; all of its document's where there is none. The blocks
    of a document are filtered once for each type asked for, not for each question."""
    want = _s(spark, d).select("sample_idx", "doc_id", F.regexp_extract(F.lower("question"), "(figure|table|chart|map|diagram|graph)", 1).alias("type"))
    kept = Rt.keep_or_all(want.select("doc_id", "type").distinct().join(_visuals(spark, d), "doc_id"), ["doc_id", "type"], F.lower("block_type") == F.col("type"))
    per = kept.groupBy("doc_id", "type").agg(F.array_sort(F.collect_set("block_id")).alias("units"), F.first("fell_back").alias("fell_back"))
    return want.join(per, ["doc_id", "type"]).select("sample_idx", "fell_back", F.md5(F.array_join(F.col("units").cast("array<string>"), ",")).alias("units"))


def filter_page_fallback(spark, d):
    """Visual blocks on the pages a question's evidence names; all of its document's where there are none."""
    s = _s(spark, d).select("sample_idx", "doc_id", "evidence_pages")
    pages = Rt.user_pages(_s(spark, d)).groupBy("sample_idx").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    want = s.join(pages, "sample_idx", "left").select("sample_idx", "doc_id", F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))
    kept = Rt.keep_or_all(want.select("doc_id", "pages").distinct().join(_visuals(spark, d), "doc_id"), ["doc_id", "pages"], F.array_contains("pages", F.col("page")))
    per = kept.groupBy("doc_id", "pages").agg(F.array_sort(F.collect_set("block_id")).alias("units"), F.first("fell_back").alias("fell_back"))
    return want.join(per, ["doc_id", "pages"]).select("sample_idx", "fell_back", F.md5(F.array_join(F.col("units").cast("array<string>"), ",")).alias("units"))


def find_by_page(spark, d):
    return Rt.user_pages(_s(spark, d)).join(_visuals(spark, d), ["doc_id", "page"]).select("sample_idx", "page", "block_id", "block_type")


def visual_page_nodes(spark, d):
    return Rt.page_scores(_s(spark, d)).withColumn("score", F.round("score", 6))


def dedupe_paths(spark, d):
    c = F.col("image_top_10_question")
    return _s(spark, d).filter(c.isNotNull()).select("sample_idx", F.size(F.array_distinct(c)).alias("distinct_pages"), (F.size(c) - F.size(F.array_distinct(c))).alias("repeats"),
                                                    F.array_join(F.array_union(F.slice(c, 4, 3), F.slice(c, 1, 3)).cast("array<string>"), ",").alias("focused_first"))


def tool_union_dedupe(spark, d):
    k = keyword_topk(spark, d).select("sample_idx", F.col("block_id").alias("unit"), F.lit(2).alias("tool_seq"), F.col("rank").alias("seq"), "score")
    p = find_by_page(spark, d).select("sample_idx", F.col("block_id").alias("unit"), F.lit(1).alias("tool_seq"), F.col("block_id").cast("int").alias("seq"), F.lit(0.95).alias("score"))
    return Rt.merge_tools(p.unionByName(k)).select("sample_idx", "unit", "tool_seq", F.round("score", 6).alias("score"))


def _cands(spark, d):
    return tool_union_dedupe(spark, d).withColumn("seq", F.col("unit")).withColumn("locked", F.col("tool_seq") == 1)


def select_hard(spark, d):
    return Rt.select_hard(_cands(spark, d), 3).select("sample_idx", "unit", "rank")


def select_unit(spark, d):
    return Rt.select_soft(_cands(spark, d).withColumn("gain", F.col("score")), 5).select("sample_idx", "unit", "rank")


def round_robin(spark, d):
    return Rt.round_robin(_cands(spark, d), "tool_seq", 4).select("sample_idx", "unit", "rank")


QUERIES = {f.__name__: f for f in (idf_weights, keyword_score, keyword_topk, keyword_fuzzy_topk, occurrence_count, typed_count, filter_type_fallback, filter_page_fallback, find_by_page, visual_page_nodes, dedupe_paths,
                                   tool_union_dedupe, select_hard, select_unit, round_robin)}

_C = ",".join(f"'{c}'" for c in CAPS)
S = "WITH s AS (SELECT DISTINCT * FROM samples)"
_FOLD = "replace(translate(lower({}), '01|', 'oll'), 'rn', 'm')"
_DASH = r"trim(regexp_replace(regexp_replace(lower({}), '[-–—]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_KW = (r"kw AS (SELECT DISTINCT * FROM (SELECT sample_idx, doc_id, regexp_replace({}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS keyword FROM (SELECT sample_idx, doc_id, "
       r"unnest(string_split(coalesce(nullif(trim(retrieval_key), ''), replace(question, ' ', ',')), ',')) AS k FROM s)) WHERE length(keyword) > 1)")
K = S + ", " + _KW.format(_FOLD.format("k")) + f""",
 u AS (SELECT DISTINCT doc_id, block_id, page, text FROM ocr_blocks WHERE block_type IN ({_C})),
 mt AS (SELECT DISTINCT q.doc_id, q.keyword, u.block_id FROM (SELECT DISTINCT doc_id, keyword FROM kw) q JOIN u ON u.doc_id = q.doc_id AND contains({_FOLD.format("coalesce(u.text,'')")}, q.keyword)),
 df AS (SELECT doc_id, keyword, count(DISTINCT block_id) AS df FROM mt GROUP BY ALL), nn AS (SELECT doc_id, count(DISTINCT block_id) AS n FROM u GROUP BY doc_id),
 w AS (SELECT kw.sample_idx, kw.doc_id, keyword, coalesce(n, 0) AS units, coalesce(df, 0) AS df, CASE WHEN coalesce(n,0) = 0 THEN 1.0 WHEN df IS NULL THEN ln(n+1) ELSE ln((n+1)/(df+1)::DOUBLE) END AS w0
   FROM kw LEFT JOIN nn USING (doc_id) LEFT JOIN df USING (doc_id, keyword)),
 wi AS (SELECT *, CASE WHEN max(w0) OVER (PARTITION BY sample_idx) > 0 THEN w0/max(w0) OVER (PARTITION BY sample_idx) ELSE w0 END AS idf FROM w),
 tt AS (SELECT sample_idx, sum(idf) AS ai, count(*) AS ak FROM wi GROUP BY sample_idx),
 sc AS (SELECT wi.sample_idx, wi.doc_id, mt.block_id, round(CASE WHEN any_value(ai) > 0 THEN sum(idf)/any_value(ai) ELSE 0.0 END, 9) AS score, count(*) AS matched, round(count(*)/any_value(ak)::DOUBLE, 9) AS coverage
   FROM wi JOIN mt ON mt.doc_id = wi.doc_id AND mt.keyword = wi.keyword JOIN tt ON tt.sample_idx = wi.sample_idx GROUP BY wi.sample_idx, wi.doc_id, mt.block_id),
 tk AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY score DESC, block_id) AS rank FROM sc QUALIFY rank <= 5)"""
_VB = "v AS (SELECT DISTINCT doc_id, block_id, page, block_type FROM ocr_blocks WHERE lower(block_type) IN ('figure','table','chart','map','diagram','graph'))"
_UP = "up AS (SELECT DISTINCT sample_idx, doc_id, CAST(p AS INTEGER) - 1 AS page FROM (SELECT sample_idx, doc_id, unnest(regexp_extract_all(coalesce(evidence_pages,''), '[0-9]{1,6}')) AS p FROM s) WHERE CAST(p AS INTEGER) >= 1)"
_FB = "up.sample_idx, up.page, v.block_id, v.block_type FROM up JOIN v USING (doc_id, page)"
_TU = K + ", " + _VB + ", " + _UP + f""", al AS (SELECT sample_idx, block_id AS unit, 1 AS tool_seq, CAST(block_id AS INTEGER) AS seq, 0.95::DOUBLE AS score FROM (SELECT {_FB})
   UNION ALL SELECT sample_idx, block_id, 2, CAST(rank AS INTEGER), round(score, 6) FROM tk),
 tu AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY sample_idx, unit ORDER BY tool_seq, seq) = 1)"""
SQL = {
    "idf_weights": K + " SELECT sample_idx, doc_id, keyword, units, df, round(idf, 6) AS idf FROM wi",
    "keyword_score": K + " SELECT sample_idx, count(*) AS n, round(max(score), 6) AS best, max(matched) AS most FROM sc GROUP BY sample_idx",
    "keyword_topk": K + " SELECT sample_idx, block_id, round(score, 6) AS score, rank FROM tk",
    "occurrence_count": S + ", " + _KW.format(_DASH.format("k")) + f", b AS (SELECT DISTINCT doc_id, block_id, page, {_DASH.format('text')} AS t FROM ocr_blocks), c AS (SELECT q.doc_id, q.keyword, b.page, (length(t) - length(replace(t, keyword, '')))//length(keyword) AS n FROM (SELECT DISTINCT doc_id, keyword FROM kw) q JOIN b ON b.doc_id = q.doc_id AND contains(t, keyword)), g AS (SELECT doc_id, keyword, CAST(sum(n) AS BIGINT) AS times, count(DISTINCT page) AS pages FROM c GROUP BY ALL) SELECT kw.sample_idx, kw.keyword, times, pages FROM kw JOIN g USING (doc_id, keyword)",
    "typed_count": "WITH b AS (SELECT DISTINCT doc_id, block_id, page, block_type FROM ocr_blocks) SELECT doc_id, block_type AS type, count(*) AS n, count(DISTINCT page) AS pages FROM b GROUP BY ALL",
    "filter_type_fallback": S + ", " + _VB + """, q AS (SELECT sample_idx, doc_id, regexp_extract(lower(question), '(figure|table|chart|map|diagram|graph)', 1) AS type FROM s), j AS (SELECT q.sample_idx, v.block_id, coalesce(lower(v.block_type) = q.type, false) AS hit FROM q JOIN v USING (doc_id)),
 k AS (SELECT *, NOT bool_or(hit) OVER (PARTITION BY sample_idx) AS fell_back FROM j) SELECT sample_idx, fell_back, md5(string_agg(DISTINCT block_id::VARCHAR, ',' ORDER BY block_id)) AS units FROM (SELECT DISTINCT sample_idx, fell_back, block_id FROM k WHERE hit OR fell_back) GROUP BY ALL""".replace("DISTINCT block_id::VARCHAR", "block_id::VARCHAR"),
    "filter_page_fallback": S + ", " + _VB + ", " + _UP + """, j AS (SELECT s.sample_idx, v.block_id, EXISTS (SELECT 1 FROM up WHERE up.sample_idx = s.sample_idx AND up.page = v.page) AS hit FROM s JOIN v USING (doc_id)),
 k AS (SELECT *, NOT bool_or(hit) OVER (PARTITION BY sample_idx) AS fell_back FROM j) SELECT sample_idx, fell_back, md5(string_agg(block_id::VARCHAR, ',' ORDER BY block_id)) AS units FROM (SELECT DISTINCT sample_idx, fell_back, block_id FROM k WHERE hit OR fell_back) GROUP BY ALL""",
    "find_by_page": S + ", " + _VB + ", " + _UP + " SELECT " + _FB,
    "visual_page_nodes": S + ", p AS (SELECT sample_idx, len(image_top_10_question) AS n, unnest(range(len(image_top_10_question))) AS place, unnest(image_top_10_question) AS page FROM s) SELECT sample_idx, page, place, round(greatest(0.1, 1.0 - place/n::DOUBLE), 6) AS score FROM p",
    "dedupe_paths": S + ", p AS (SELECT sample_idx, image_top_10_question AS c FROM s WHERE image_top_10_question IS NOT NULL) SELECT sample_idx, len(list_distinct(c)) AS distinct_pages, len(c) - len(list_distinct(c)) AS repeats, array_to_string(list_concat(c[4:6], list_filter(c[1:3], lambda x: NOT list_contains(c[4:6], x))), ',') AS focused_first FROM p",
    "tool_union_dedupe": _TU + " SELECT sample_idx, unit, tool_seq, round(score, 6) AS score FROM tu",
    "select_hard": _TU + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY (tool_seq = 1) DESC, score DESC, unit) AS rank FROM tu) SELECT sample_idx, unit, rank FROM r WHERE tool_seq = 1 OR rank <= 3",
    "select_unit": _TU + ", r AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS f FROM tu WINDOW w AS (PARTITION BY sample_idx ORDER BY score DESC, unit)) SELECT sample_idx, unit, rank FROM r WHERE rank <= 5 AND score >= greatest(0.01, 0.8*f)",
    "round_robin": _TU + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample_idx, tool_seq ORDER BY unit) AS turn, min(unit) OVER (PARTITION BY sample_idx, tool_seq) AS arrival FROM tu), x AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY turn, arrival, unit) AS rank FROM r) SELECT sample_idx, unit, rank FROM x WHERE rank <= 4",
}
