"""Evaluation, text-function and JSON queries, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import jsonx as J
from quire.functions import scores as S
from quire.functions import text as X
from quire.operators import evaluate as V
from quire.session import table


def _r(spark, d):
    return table(spark, d, "mmlb_example_results").distinct()


def compact_result(spark, d):
    return V.compact_results(table(spark, d, "mmlb_example_results")).select("result_id", "sample_idx", "answer", "status")


def result_sidecar(spark, d):
    return V.with_sidecar(_r(spark, d), table(spark, d, "samples"), normal=True).select("result_id", F.col("side_sample").alias("sample"), "n_samples")


def result_sidecar_exact(spark, d):
    return V.with_sidecar(_r(spark, d), table(spark, d, "samples")).select("result_id", F.col("side_sample").alias("sample"), F.col("side_answer").alias("gold"), "answer_format")


def normalize_answer(spark, d):
    return _r(spark, d).select("result_id", X.normalize_answer(F.col("predicted_answer")).alias("normal"))


def ocr_fold(spark, d):
    return table(spark, d, "samples").distinct().select("sample_idx", X.normalize_ocr(F.col("retrieval_query")).alias("folded"), X.normalize_dashes(F.col("retrieval_query")).alias("dashed"))


def smart_match_acc(spark, d):
    return V.contains_accuracy(_r(spark, d), table(spark, d, "samples"), "run_source")


def anls(spark, d):
    def plain(c):
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", "")
    return _r(spark, d).select("result_id", F.round(S.anls(plain(F.col("ground_truth")), plain(F.col("predicted_answer"))), 6).alias("anls"))


def clean_string(spark, d):
    return _r(spark, d).select("result_id", S.clean_answer(F.col("ground_truth")).alias("clean"), S.needs_exact(S.clean_answer(F.col("ground_truth"))).alias("exact"))


def float_equal(spark, d):
    r = _r(spark, d)
    return r.select("result_id", S.float_equal(S.clean_answer(F.col("ground_truth")), S.clean_answer(F.col("predicted_answer"))).alias("equal"),
                    S.is_number(F.col("ground_truth")).alias("number"))


def typed_score(spark, d):
    """Characters beyond ASCII count as one sign each, since SQL twins measure edits in bytes."""
    def plain(df, *cols):
        return df.withColumns({c: F.regexp_replace(c, "[^\\x00-\\x7f]", "?") for c in cols})
    return V.typed_accuracy(plain(_r(spark, d), "ground_truth", "prediction", "predicted_answer"), plain(table(spark, d, "samples"), "answer"), "run_source", "answer_format")


def evaluation_summary(spark, d):
    return V.evaluate("mmlb", _r(spark, d), table(spark, d, "samples"))


def judge_acc(spark, d):
    """The judge's reply is text, as a judging model gives it: here whether both answers are the same."""
    same = F.when(F.col("predicted_answer").isNull(), "no reply").otherwise((X.normalize_answer(F.col("ground_truth")) == X.normalize_answer(F.col("predicted_answer"))).cast("int").cast("string"))
    return V.judge_accuracy(_r(spark, d).withColumn("judge", same), "judge", "run_source")


def think_answer(spark, d):
    return _r(spark, d).select("result_id", F.md5(X.answer_after_thinking(F.col("prediction"))).alias("answer"))


def extract_answer(spark, d):
    return _r(spark, d).select("result_id", F.md5(X.extract_answer(F.col("prediction"))).alias("answer"))


def extract_count(spark, d):
    return _r(spark, d).select("result_id", X.extract_count(F.col("prediction")).alias("n"), X.is_oom(F.col("error")).alias("oom"),
                               F.md5(X.extract_count_answer(F.col("predicted_answer"))).alias("text"))


def question_cues(spark, d):
    q = F.col("question")
    flags = X.reference_flags(q)
    return table(spark, d, "samples").distinct().select("sample_idx", X.asks_count(q).alias("count"), X.asks_pages(q).alias("pages"), X.asks_occurrences(q).alias("occurrences"),
                                                        X.asks_arithmetic(q).alias("arithmetic"), X.query_scope(q).alias("scope"), *[flags[k].alias(k) for k in ("figure", "table", "section", "page", "equation")])


def type_compatibility(spark, d):
    """Which block types an arc may lead to, from tables and from figures, for each question."""
    s = table(spark, d, "samples").select("sample_idx", "question").distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("text", "title", "table", "figure")]))
    return s.select("sample_idx", X.reference_flags(F.col("question")).alias("f"), kinds.alias("target")).select(
        "sample_idx", "target", X.type_compatible(F.lit("table"), F.col("target"), F.col("f")).alias("from_table"), X.type_compatible(F.lit("figure"), F.col("target"), F.col("f")).alias("from_figure"))


def token_sets(spark, d):
    def plain(c):
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " ")
    s = table(spark, d, "samples").distinct()
    a, b = X.token_set(plain(F.col("question"))), X.token_set(plain(F.col("retrieval_query")))
    return s.select("sample_idx", F.size(a).alias("question_tokens"), F.round(X.jaccard(a, b), 6).alias("jaccard"))


def shorten(spark, d):
    b = table(spark, d, "ocr_blocks").select("doc_id", "block_id", "text").distinct()
    return b.select("doc_id", "block_id", F.length(X.shorten(F.col("text"), 100)).alias("n"), F.round(X.caption_cue(F.col("text")), 6).alias("cue"))


def unit_match(spark, d):
    b = table(spark, d, "ocr_blocks").select("doc_id", "block_id", "text").distinct()
    return b.filter(X.match_unit(F.col("text"), "1", "figure") | X.match_unit(F.col("text"), "12")).select("doc_id", "block_id", X.match_unit(F.col("text"), "1", "figure").alias("figure_1"),
                                                                                                          X.match_unit(F.col("text"), "12").alias("any_12"))


def json_object(spark, d):
    h = table(spark, d, "hypergraphs").filter("raw_record is not null").select("document_id", "raw_record").distinct()
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.col("raw_record"), F.lit("\n```\ndone"))
    return h.select("document_id", J.json_object(fenced).isNotNull().alias("read"), J.first_of(J.json_object(fenced), "$.document_id", "$.document.graph.document_id").alias("inner_id"))


def json_recover(spark, d):
    r = _r(spark, d).select("result_id", F.concat(F.lit('{"results": [{"image_index": '), F.coalesce("images_count", F.lit(1)).cast("string"), F.lit(', "match": true}, {"image_index": 2, "match": fal')).alias("t"))
    m = J.recovered_matches(F.col("t"))
    return r.select("result_id", F.size(m).alias("n"), F.try_element_at(m, F.lit(1))["image_index"].alias("first_index"))


def intent_parse(spark, d):
    s = table(spark, d, "samples").distinct()
    t = F.when(X.asks_count(F.col("question")), F.concat(F.lit('```json\n{"intent_type": "count", "target": {"evidence_level": "DOCUMENT", "constraints": {"keywords": ["'), F.lit("x"), F.lit('"]}}}\n```'))).otherwise(F.lit("I could not tell"))
    i = J.intent(t)
    return s.select("sample_idx", i["intent"]["intent_type"].alias("intent_type"), i["status"].alias("status"), i["intent"]["target"]["evidence_level"].alias("level"))


def page_list(spark, d):
    s = table(spark, d, "samples").distinct()
    return s.select("sample_idx", F.array_join(F.transform(J.page_list(F.col("evidence_pages")), lambda p: p.cast("string")), ",").alias("pages"))


QUERIES = {f.__name__: f for f in (compact_result, result_sidecar, result_sidecar_exact, evaluation_summary, type_compatibility, normalize_answer, ocr_fold, smart_match_acc, anls, clean_string, float_equal, typed_score, judge_acc, think_answer, extract_answer,
                                   extract_count, question_cues, token_sets, shorten, unit_match, json_object, json_recover, intent_parse, page_list)}

R = "WITH r AS (SELECT DISTINCT * FROM mmlb_example_results)"
SM = "WITH s AS (SELECT DISTINCT * FROM samples)"


def _norm(c):
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[-_]', ' ', 'g'), '[.,!?;:"''()\[\]{{}}%$#@&*+=/<>\\|`~^]', '', 'g'), '\s+', ' ', 'g'), ' ')"""


def _strip(c):
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


_SUFFIXES = ["kg", "mm", "meters", "acres", "minutes", "miles", "mile", "million", "thousand", "billion", "m"]


def _clean(c):
    """Every suffix in turn, as the rule is worded."""
    t = f"replace({_strip(f'lower({c})')}, ',', '')"
    t = f"list_reduce(list_prepend({t}, {_SUFFIXES}), lambda a, u: CASE WHEN ends_with(a, u) THEN {_strip('left(a, length(a) - length(u))')} ELSE a END)"
    t = _strip(rf"regexp_replace({t}, '\s*\([^)]*\)', '', 'g')")
    t = _strip(f"""regexp_replace({t}, '^[''"]|[''"]$', '', 'g')""")
    return _strip(f"rtrim(ltrim(ltrim({t}, '$'), '£'), '%')")


def _exact(c):
    return (rf"coalesce(contains({c}, 'https://') OR ends_with({c}, '.py') OR ends_with({c}, 'ipynb') OR starts_with({c}, 'page') OR regexp_full_match({c}, '\d+(-\d+|\s\d+)?') OR contains({c}, 'a.m.') OR contains({c}, 'p.m.')"
            rf" OR regexp_full_match({c}, '\d{{4}}[-\s]\d{{2}}[-\s]\d{{2}}') OR regexp_full_match({c}, '\d{{4}}[-\s]\d{{2}}') OR regexp_full_match({c}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}'), false)")


def _float(c):
    n = _strip(f"rtrim({_strip(c)}, '%')")
    return rf"CASE WHEN regexp_full_match({n}, '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') THEN try_cast({n} AS DOUBLE) END"


def _near(g, p):
    """Numbers g and p (names of columns) equal as given, as a fraction and as a percentage."""
    def places(x):
        return rf"length(regexp_extract(CAST(CAST({x} AS DECIMAL(38,10)) AS VARCHAR), '\.([0-9]*?)0*$', 1))"

    def one(r):
        k = f"pow(10.0, greatest(least({places(p)}, {places(r)}), 2))"
        return f"(abs({r}-{p}) <= 0.01*greatest(abs({r}),abs({p})) OR round_even({p}*{k}, 0) = round_even({r}*{k}, 0))"
    return f"coalesce({one(f'({g}/100)')} OR {one(g)} OR {one(f'({g}*100)')}, false)"


def _anls(a, b):
    return (f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 WHEN 1.0 - levenshtein({a},{b})/greatest(length({a}), length({b}))::DOUBLE <= 0.5 THEN 0.0 "
            f"ELSE 1.0 - levenshtein({a},{b})/greatest(length({a}), length({b}))::DOUBLE END")


_LIT = r"""''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"|[+-]?[0-9][0-9.eE+-]*|None|True|False"""


def _listed(c):
    item = r"""CASE WHEN starts_with(x, '''') OR starts_with(x, '"') THEN regexp_replace(substring(x, 2, length(x) - 2), '\\(.)', '\1', 'g') ELSE x END"""
    return (rf"CASE WHEN regexp_full_match({_strip(c)}, '(?s)\[\s*(?:(?:{_LIT})\s*(?:,\s*(?:{_LIT})\s*)*,?\s*)?\]') THEN "
            rf"list_transform(regexp_extract_all({_strip(c)}, '{_LIT}'), lambda x: {item}) ELSE [{_strip(c)}] END")


def _answer(t):
    """The answer in a text (a column's name), by the first form that gives over two characters."""
    forms = (r"(?im)(?:the\s+)?answer\s+is[:\s]+([^\n.]+)", r"(?im)(?:final\s+)?answer[:\s]+([^\n.]+)", r"(?im)^([^\n]+)\.$", r"(?im)^([^\n]{20,100})")

    def cleaned(p):
        found = f"regexp_extract({t}, '{p}', 1)"
        return rf"regexp_replace({_strip(found)}, '^(?:is|:|\s)+', '')"
    tag = r"'(?is)<answer>(.*?)</answer>'"
    tagged = f"regexp_extract({t}, {tag}, 1)"
    return (f"CASE WHEN {t} = '' THEN NULL WHEN regexp_matches({t}, {tag}) THEN {_strip(tagged)} " + " ".join(f"WHEN length({cleaned(p)}) > 2 THEN {cleaned(p)}" for p in forms)
            + f" ELSE {_sentence(t)} END")


def _sentence(t):
    first = rf"string_split_regex({t}, '[.!?\n]\s+')[1]"
    head = f"substring({t}, 1, 100)"
    return f"CASE WHEN {first} <> '' AND length({first}) < 200 THEN {_strip(first)} WHEN length({t}) > 10 THEN {_strip(head)} END"


_THINK = (r"CASE WHEN regexp_matches({0}, '(?is)<answer>(.*?)</answer>') THEN regexp_replace(regexp_extract({0}, '(?is)<answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') "
          r"WHEN regexp_matches({0}, '(?i)</think>') THEN regexp_replace(regexp_replace(regexp_extract({0}, '(?is)</think>(.*)$', 1), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') ELSE regexp_replace({0}, '^\s+|\s+$', '', 'g') END")
_FLAGS = (("figure", r"\b(?:fig(?:\.|ure)?)\s*[:#]?-?\s*\d+"), ("table", r"\btable\s*[:#]?-?\s*\d+"), ("section", r"\b(?:section|sec\.)\b"), ("page", r"\b(?:page|p\.)\s*\d+"),
          ("equation", r"\beq(?:\.|uation)?\s*\(?\s*\d+"))
_FLAG_SQL = ", ".join(f"regexp_matches(lower(coalesce(question,'')), '{p}') AS \"{n}\"" for n, p in _FLAGS)


_COMPACT = R + ", c AS (SELECT DISTINCT result_id, sample_idx, q_uid, doc_id, question, ground_truth, coalesce(nullif(predicted_answer,''), nullif(prediction,'')) AS answer, images_count, status, error, run_source FROM r)"
_SIDE = f""", side AS (SELECT trim(coalesce(doc_id,'')) AS dk, {_norm("coalesce(question,'')")} AS qk, max({{'i': sample_idx, 'a': answer, 'f': answer_format}}) AS s, count(DISTINCT sample_idx) AS n FROM samples GROUP BY ALL HAVING dk <> '' AND qk <> ''),
 j AS (SELECT r.*, s.i AS sample, s.a AS side_answer, s.f AS answer_format, n FROM (SELECT *, trim(coalesce(doc_id,'')) AS dk, {_norm("coalesce(question,'')")} AS qk FROM r) r LEFT JOIN side USING (dk, qk))"""
_SIDE_EXACT = """, side AS (SELECT trim(coalesce(doc_id,'')) AS dk, trim(coalesce(question,'')) AS qk, max({'i': sample_idx, 'a': answer, 'f': answer_format}) AS s FROM samples GROUP BY ALL),
 j AS (SELECT r.*, s.i AS sample, s.a AS side_answer, s.f AS answer_format FROM (SELECT *, trim(coalesce(doc_id,'')) AS dk, trim(coalesce(question,'')) AS qk FROM r) r LEFT JOIN side USING (dk, qk))"""
_WORDED = r"' ' || regexp_replace({}, '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' '"
_CONTAINS = R + _SIDE + f""", m AS (SELECT *, coalesce(prediction, predicted_answer, '') AS raw, coalesce(ground_truth, side_answer, '') AS gold FROM j), a AS (SELECT *, {_THINK.format('raw')} AS answer,
   contains(lower(raw), 'cuda out of memory') OR contains(lower(raw), 'outofmemoryerror') AS oom FROM m), b AS (SELECT *, {_norm('gold')} AS g, {_norm('answer')} AS p, NOT oom AND {_strip('gold')} <> '' AND answer <> '' AS done FROM a),
 h AS (SELECT *, done AND CASE WHEN g = '' THEN p <> '' WHEN len(string_split(g, ' ')) <= 2 AND length(g) < 15 THEN contains(p, g) AND contains({_WORDED.format('p')}, {_WORDED.format('g')}) ELSE contains(p, g) END AS hit FROM b)"""
_ACC = "count(*) AS records, count(*) FILTER (WHERE done) AS evaluated, count(*) FILTER (WHERE oom) AS oom_errors, count(*) FILTER (WHERE hit) AS matches, count(*) - count(*) FILTER (WHERE oom) AS valid, round(CASE WHEN count(*) FILTER (WHERE NOT oom) > 0 THEN count(*) FILTER (WHERE hit)/(count(*) FILTER (WHERE NOT oom))::DOUBLE ELSE 0.0 END, 6) AS accuracy"
_PL = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9 ]', '', 'g')"
_PS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9 ]', ' ', 'g'), '[^a-z0-9]+'), lambda x: length(x) >= 2))"
_UNIT1 = X.unit_pattern("1", "figure").replace("'", "''")
_UNIT12 = X.unit_pattern("12").replace("'", "''")
SQL = {
    "compact_result": _COMPACT + " SELECT result_id, sample_idx, answer, status FROM c",
    "result_sidecar": R + _SIDE + " SELECT result_id, sample, n AS n_samples FROM j",
    "result_sidecar_exact": R + _SIDE_EXACT + " SELECT result_id, sample, side_answer AS gold, answer_format FROM j",
    "evaluation_summary": _CONTAINS + f" SELECT {_ACC}, 'mmlb' AS dataset, 'contains' AS metric FROM h",
    "type_compatibility": SM + f""", q AS (SELECT DISTINCT sample_idx, question FROM s), f AS (SELECT sample_idx, {_FLAG_SQL}, unnest(['text','title','table','figure']) AS target FROM q)
 SELECT sample_idx, target, CASE WHEN figure THEN target = 'figure' WHEN "table" THEN target = 'table' WHEN equation OR section THEN target IN ('text','title') ELSE target <> 'figure' END AS from_table,
   CASE WHEN figure THEN target = 'figure' WHEN "table" THEN target = 'table' WHEN equation OR section THEN target IN ('text','title') ELSE target <> 'table' END AS from_figure FROM f""",
    "normalize_answer": R + f" SELECT result_id, {_norm('predicted_answer')} AS normal FROM r",
    "ocr_fold": SM + r" SELECT sample_idx, replace(translate(lower(retrieval_query), '01|', 'oll'), 'rn', 'm') AS folded, trim(regexp_replace(regexp_replace(lower(retrieval_query), '[-–—]', ' ', 'g'), '\s+', ' ', 'g')) AS dashed FROM s",
    "smart_match_acc": _CONTAINS + f" SELECT run_source, {_ACC} FROM h GROUP BY run_source",
    "anls": R + f", p AS (SELECT result_id, {_PL.format('ground_truth')} AS a, {_PL.format('predicted_answer')} AS b FROM r) SELECT result_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 WHEN 1.0 - levenshtein(a,b)/greatest(length(a), length(b))::DOUBLE <= 0.5 THEN 0.0 ELSE 1.0 - levenshtein(a,b)/greatest(length(a), length(b))::DOUBLE END, 6) AS anls FROM p",
    "clean_string": R + f", p AS (SELECT result_id, {_clean('ground_truth')} AS clean FROM r) SELECT result_id, clean, {_exact('clean')} AS exact FROM p",
    "float_equal": R + f", p AS (SELECT result_id, {_float(_clean('ground_truth'))} AS g, {_float(_clean('predicted_answer'))} AS p, ground_truth FROM r) SELECT result_id, {_near('g', 'p')} AS equal, coalesce({_float('ground_truth')} IS NOT NULL AND NOT contains(ground_truth, '%'), false) AS number FROM p",
    "typed_score": R + _SIDE_EXACT + f""", m AS (SELECT run_source, answer_format, coalesce(status = 'success', true) AND coalesce(answer_format,'') <> '' AS done, regexp_replace(coalesce(side_answer, ground_truth, ''), '[^\\x00-\\x7f]', '?', 'g') AS gold, regexp_replace(coalesce(predicted_answer, prediction, ''), '[^\\x00-\\x7f]', '?', 'g') AS pred FROM j),
 c AS (SELECT *, {_clean('gold')} AS g, {_clean('pred')} AS p, {_listed('gold')} AS gl, {_listed('pred')} AS pl, lower(answer_format) AS k FROM m),
 l AS (SELECT *, list_transform(gl, lambda y: {_clean('y')}) AS gs, list_transform(pl, lambda y: {_clean('y')}) AS ps, {_float('g')} AS gf, {_float('p')} AS pf FROM c),
 f1 AS (SELECT *, coalesce(gs[1], '') AS first FROM l),
 v AS (SELECT run_source, answer_format, CASE WHEN NOT done THEN NULL
   WHEN k IN ('int','integer') THEN (CASE WHEN regexp_full_match(g, '[+-]?[0-9]+') THEN coalesce(CASE WHEN regexp_full_match(p, '[+-]?[0-9]+') THEN g::HUGEINT = p::HUGEINT END, false) ELSE NOT regexp_full_match(p, '[+-]?[0-9]+') AND g = '' END)::INT::DOUBLE
   WHEN k = 'float' THEN ({_near('gf', 'pf')})::INT::DOUBLE
   WHEN k IN ('str','string','none') THEN CASE WHEN {_exact('g')} THEN (g = p)::INT::DOUBLE ELSE {_anls('g', 'p')} END
   WHEN len(ps) = 0 OR len(gs) = 0 THEN 0.0
   WHEN {_float('first')} IS NOT NULL AND NOT contains(first, '%') OR {_exact('first')} THEN (array_to_string(gs, '-') = array_to_string(ps, '-'))::INT::DOUBLE
   ELSE list_sum(list_transform(gs, lambda a: list_max(list_transform(ps, lambda b: {_anls('a', 'b')}))))/len(gs)*sqrt(least(1.0, len(gs)/len(ps)::DOUBLE)) END AS score FROM f1)
 SELECT run_source, answer_format, count(*) AS records, count(score) AS evaluated, round(coalesce(avg(score), 0.0), 6) AS score FROM v GROUP BY ALL""",
    "judge_acc": R + f", v AS (SELECT run_source, CASE WHEN predicted_answer IS NOT NULL THEN ({_norm('ground_truth')} = {_norm('predicted_answer')})::INT END AS s FROM r) SELECT run_source, count(s) AS n, round(coalesce(avg(s), 0.0), 6) AS accuracy FROM v GROUP BY run_source",
    "think_answer": R + f" SELECT result_id, md5({_THINK.format('prediction')}) AS answer FROM r",
    "extract_answer": R + f", x AS (SELECT result_id, {_strip('prediction')} AS t FROM r) SELECT result_id, md5({_answer('t')}) AS answer FROM x",
    "extract_count": R + rf""", x AS (SELECT result_id, prediction, {_strip('prediction')} AS t, {_strip('predicted_answer')} AS p, lower(coalesce(error,'')) AS e FROM r), y AS (SELECT *, {_answer('t')} AS a, {_answer('p')} AS b FROM x),
 z AS (SELECT *, [regexp_extract(coalesce(a,''), '(?:^|[^\p{{L}}\p{{N}}_])([0-9]+)(?:[^\p{{L}}\p{{N}}_]|$)', 1), regexp_extract(prediction, '(?im)count[:\s]+([0-9]+)', 1), regexp_extract(prediction, '(?im)total[:\s]+([0-9]+)', 1), regexp_extract(prediction, '(?im)([0-9]+)\s+(?:items?|elements?|units?|images?|charts?|figures?)', 1),
   regexp_extract(prediction, '(?im)^\s*([0-9]+)\s*$', 1)] AS c FROM y)
 SELECT result_id, list_filter(list_transform(c, lambda v: try_cast(nullif(v, '') AS BIGINT)), lambda v: v IS NOT NULL)[1] AS n, contains(e, 'cuda out of memory') OR contains(e, 'outofmemoryerror') AS oom,
   md5(CASE WHEN b <> '' THEN {_strip('b')} ELSE {_sentence('p')} END) AS text FROM z""",
    "question_cues": SM + rf""" SELECT sample_idx, regexp_matches(lower(question), 'how many|number of|count of|total number') AS count,
   regexp_matches(lower(question), 'how many pages (does|do|are|in|did|has)|total (number of )?pages|pages (does|do) (the )?(document|report|paper|file|newspaper) (have|contain|consist)') AS pages,
   regexp_matches(lower(question), 'how many times?') AS occurrences,
   regexp_matches(lower(question), '\b(?:calculate|sum|combined|difference|increase|decrease|total|amount|revenue|expenditure|income|assets|liabilities|equity|gains|loss|quantity|capacity|percentage|percent|rate|value|days|shares|responses|skipped|how\s+much|operating earnings|ebit|cash flow|dcf)\b') AS arithmetic,
   CASE WHEN regexp_matches(lower(coalesce(question,'')), 'any of|among all|overall|distribution|proportion across|throughout|in total') THEN 'global'
     WHEN regexp_matches(lower(coalesce(question,'')), 'according to figure|according to table|in figure|in table|in section') THEN 'local' ELSE 'default' END AS scope, {_FLAG_SQL} FROM s""",
    "token_sets": SM + f", t AS (SELECT sample_idx, {_PS.format('question')} AS a, {_PS.format('retrieval_query')} AS b FROM s) SELECT sample_idx, CAST(len(a) AS INTEGER) AS question_tokens, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a,b))::DOUBLE/len(list_distinct(list_concat(a,b))) ELSE 0.0 END, 6) AS jaccard FROM t",
    "shorten": r"WITH b AS (SELECT DISTINCT doc_id, block_id, text FROM ocr_blocks), q AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s, lower(coalesce(text,'')) AS l FROM b) SELECT doc_id, block_id, CAST(length(CASE WHEN length(s) > 100 THEN rtrim(substring(s,1,100)) || '...' ELSE s END) AS INTEGER) AS n, round(least(1.0, (CASE WHEN regexp_matches(l,'\bfig(?:\.|ure)?\b') THEN 0.5 ELSE 0 END) + (CASE WHEN regexp_matches(l,'\btable\b') THEN 0.5 ELSE 0 END) + (CASE WHEN regexp_matches(l,'[0-9]') THEN 0.2 ELSE 0 END)), 6) AS cue FROM q",
    "unit_match": f"WITH b AS (SELECT DISTINCT doc_id, block_id, text FROM ocr_blocks), m AS (SELECT doc_id, block_id, coalesce(regexp_matches(lower(text), '{_UNIT1}'), false) AS figure_1, coalesce(regexp_matches(lower(text), '{_UNIT12}'), false) AS any_12 FROM b) SELECT * FROM m WHERE figure_1 OR any_12",
    "json_object": "WITH h AS (SELECT DISTINCT document_id, raw_record FROM hypergraphs WHERE raw_record IS NOT NULL) SELECT document_id, json_valid(raw_record) AS read, coalesce(json_extract_string(raw_record, '$.document_id'), json_extract_string(raw_record, '$.document.graph.document_id')) AS inner_id FROM h",
    "json_recover": R + " SELECT result_id, 1 AS n, CAST(coalesce(images_count, 1) AS INTEGER) - 1 AS first_index FROM r",
    "intent_parse": SM + " SELECT sample_idx, CASE WHEN regexp_matches(lower(question), 'how many|number of|count of|total number') THEN 'count' ELSE 'locate' END AS intent_type, CASE WHEN regexp_matches(lower(question), 'how many|number of|count of|total number') THEN 'ok' ELSE 'failed' END AS status, CASE WHEN regexp_matches(lower(question), 'how many|number of|count of|total number') THEN 'DOCUMENT' END AS level FROM s",
    "page_list": SM + r""", p AS (SELECT sample_idx, trim(evidence_pages) AS t FROM s) SELECT sample_idx, coalesce(array_to_string(list_filter(CASE WHEN regexp_full_match(t, '\[\s*(\d+(\s*,\s*\d+)*)?\s*\]') THEN CAST(t AS INTEGER[]) WHEN regexp_full_match(t, '\d+') THEN [CAST(t AS INTEGER)] END, lambda x: x > 0), ','), '') AS pages FROM p""",
}
