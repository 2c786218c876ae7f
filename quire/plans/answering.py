"""Question-to-answer queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import answering as An
from quire.operators import evidence as Ev
from quire.operators import layout as L
from quire.operators import retrieval as Rt
from quire.plans.layout import B
from quire.plans.retrieval import _KW, _TU, K, S, _cands, _s, _u, find_by_page, visual_page_nodes
from quire.session import table


def _b(spark, d):
    return L.layout(table(spark, d, "ocr_blocks"))


def question_intents(spark, d):
    i = An.intents(_s(spark, d))
    return i.select("sample_idx", "intent_type", "scope", "widen", An.intent_summary(F.col("intent_type"), F.col("scope"), F.split(F.coalesce("question", F.lit("")), " ")).alias("summary"))


def pages_by_keywords(spark, d):
    kw, b = Rt.keywords(_s(spark, d), F.lower), _b(spark, d)
    return An.pages_by_keywords(kw, Rt.matches(kw, b, "block_id", "text", F.lower), b)


def image_caps(spark, d):
    v = find_by_page(spark, d).select("sample_idx", "page", F.col("block_id").alias("rank"))
    return An.image_caps(v, 2, 5)


def supplement_pages(spark, d):
    return An.supplement_pages(visual_page_nodes(spark, d), find_by_page(spark, d))


def rerank_by_anchor(spark, d):
    """Candidates clustered by the page their unit stands on."""
    pages = table(spark, d, "ocr_blocks").groupBy("doc_id", F.col("block_id").alias("unit")).agg(F.min("page").alias("anchor"))
    c = _cands(spark, d).join(_s(spark, d).select("sample_idx", "doc_id").distinct(), "sample_idx").join(pages, ["doc_id", "unit"])
    return An.by_anchor(c).select("sample_idx", "unit", "place")


def supporting_subgraph(spark, d):
    b = _b(spark, d)
    arcs = L.reading_order(b).filter("next_id is not null").select("doc_id", "page", F.col("block_id").alias("src"), F.col("next_id").alias("dst"))
    s = b.filter("x1 is not null").select("doc_id", "page", "block_id", F.coalesce("rec_conf", F.lit(0.1)).alias("score"))
    return An.supporting_subgraph(s, arcs, ["doc_id", "page"], k=1, least=0.9)


def matched_types(spark, d):
    return find_by_page(spark, d).groupBy("sample_idx", F.col("block_type").alias("type")).agg(F.count("*").alias("n"))


def answer_pipeline(spark, d):
    s = _s(spark, d)
    c = _cands(spark, d)
    texts = c.select("sample_idx", "unit").join(s.select("sample_idx", "doc_id"), "sample_idx").join(_u(spark, d).select("doc_id", F.col("block_id").alias("unit"), "text"), ["doc_id", "unit"]).select("sample_idx", "unit", "text")
    return An.answer(s, Ev.pack(c, "tool_seq", 6), texts).select("sample_idx", "intent_type", "status", F.length("answer").alias("n"))


QUERIES = {f.__name__: f for f in (question_intents, pages_by_keywords, image_caps, supplement_pages, rerank_by_anchor, supporting_subgraph, matched_types, answer_pipeline)}

_VB = "v AS (SELECT DISTINCT doc_id, block_id, page, block_type FROM ocr_blocks WHERE lower(block_type) IN ('figure','table','chart','map','diagram','graph'))"
_UP = "up AS (SELECT DISTINCT sample_idx, doc_id, CAST(p AS INTEGER) - 1 AS page FROM (SELECT sample_idx, doc_id, unnest(regexp_extract_all(coalesce(evidence_pages,''), '[0-9]{1,6}')) AS p FROM s) WHERE CAST(p AS INTEGER) >= 1)"
_F = S + ", " + _VB + ", " + _UP + ", f AS (SELECT up.sample_idx, up.page, v.block_id, v.block_type FROM up JOIN v USING (doc_id, page))"
_KIND = "CASE WHEN regexp_matches(lower(question), '^list') THEN 'enumerate' WHEN coalesce(regexp_matches(lower(question), 'how many|number of|count of|total number'), false) OR coalesce(regexp_matches(lower(question), 'how many pages (does|do|are|in|did|has)|total (number of )?pages|pages (does|do) (the )?(document|report|paper|file|newspaper) (have|contain|consist)'), false) THEN 'count' WHEN regexp_matches(lower(question), 'differ|change between|compare') THEN 'compare' ELSE 'locate' END"
SQL = {
    "question_intents": S + f""", q AS (SELECT sample_idx, {_KIND} AS intent_type, CASE WHEN regexp_matches(lower(coalesce(question,'')), 'any of|among all|overall|distribution|proportion across|throughout|in total') THEN 'global' WHEN regexp_matches(lower(coalesce(question,'')), 'according to figure|according to table|in figure|in table|in section') THEN 'local' ELSE 'default' END AS scope,
   coalesce(regexp_matches(lower(question), '\\b(?:calculate|sum|combined|difference|increase|decrease|total|amount|revenue|expenditure|income|assets|liabilities|equity|gains|loss|quantity|capacity|percentage|percent|rate|value|days|shares|responses|skipped|how\\s+much|operating earnings|ebit|cash flow|dcf)\\b'), false) AS ar, string_split(coalesce(question,''), ' ') AS w FROM s)
 SELECT sample_idx, intent_type, scope, intent_type IN ('count','compare') AND ar AS widen, intent_type || ' | ' || scope || ' | ' || array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN '...' ELSE '' END AS summary FROM q""",
    "pages_by_keywords": S + ", " + _KW.format("lower(k)") + ", b AS (SELECT DISTINCT doc_id, block_id, page, block_type AS type, text FROM ocr_blocks), pp AS (SELECT sample_idx, page, CAST(sum(CASE WHEN coalesce(type = 'title', false) OR length(text) < 100 THEN 3 ELSE 1 END) AS BIGINT) AS points FROM kw JOIN b ON b.doc_id = kw.doc_id AND contains(lower(coalesce(text,'')), keyword) GROUP BY ALL) SELECT sample_idx, page, points, row_number() OVER (PARTITION BY sample_idx ORDER BY points DESC, page) AS rank FROM pp QUALIFY rank <= 3",
    "image_caps": _F + ", p AS (SELECT sample_idx, page, block_id AS rank FROM f QUALIFY row_number() OVER (PARTITION BY sample_idx, page ORDER BY block_id) <= 2) SELECT sample_idx, page, rank, row_number() OVER (PARTITION BY sample_idx ORDER BY rank, page) AS place FROM p QUALIFY place <= 5",
    "supplement_pages": _F + ", r AS (SELECT sample_idx, unnest(range(len(image_top_10_question))) AS place, unnest(image_top_10_question) AS page FROM s), n AS (SELECT * FROM r WHERE (sample_idx, page) NOT IN (SELECT (sample_idx, page) FROM f)) SELECT sample_idx, page, place FROM n QUALIFY row_number() OVER (PARTITION BY sample_idx ORDER BY place, page) <= 3",
    "rerank_by_anchor": _TU + ", bp AS (SELECT doc_id, block_id AS unit, min(page) AS anchor FROM ocr_blocks GROUP BY ALL), a AS (SELECT tu.*, min(unit) OVER (PARTITION BY sample_idx, anchor) AS arrival FROM tu JOIN (SELECT DISTINCT sample_idx, doc_id FROM s) USING (sample_idx) JOIN bp USING (doc_id, unit)) SELECT sample_idx, unit, row_number() OVER (PARTITION BY sample_idx ORDER BY arrival, score DESC, unit) AS place FROM a",
    "supporting_subgraph": B + """o AS (SELECT doc_id, page, block_id AS a, lead(block_id) OVER (PARTITION BY doc_id, page ORDER BY round_even(y1/8, 0), x1, block_id) AS z FROM b WHERE x1 IS NOT NULL),
 g AS (SELECT doc_id, page, a, z FROM o WHERE z IS NOT NULL UNION ALL SELECT doc_id, page, z, a FROM o WHERE z IS NOT NULL), s AS (SELECT doc_id, page, block_id, coalesce(rec_conf, 0.1) AS score FROM b WHERE x1 IS NOT NULL),
 sd AS (SELECT doc_id, page, block_id FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, block_id) <= 1),
 k AS (SELECT doc_id, page, block_id, max(seed) AS seed FROM (SELECT doc_id, page, block_id, true AS seed FROM sd UNION ALL SELECT g.doc_id, g.page, g.z, false FROM g JOIN sd ON g.doc_id = sd.doc_id AND g.page = sd.page AND g.a = sd.block_id) GROUP BY ALL)
 SELECT doc_id, page, block_id, seed, score FROM k JOIN s USING (doc_id, page, block_id) WHERE seed OR score >= 0.9""",
    "matched_types": _F + " SELECT sample_idx, block_type AS type, count(*) AS n FROM f GROUP BY ALL",
}
