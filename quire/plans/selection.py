"""The router's tools executed for all questions, and the selection over what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import graph as H
from quire.operators import retrieval as Rt
from quire.operators import select as S
from quire.operators import tools as T
from quire.operators.retrieval import merge_tools
from quire.plans import tools as Q
from quire.schema import TITLE_TYPES
from quire.session import cut


def _results(a):
    """Units of every tool the plan names, in the plan's order: sample_idx, unit, tool, tool_seq, seq, score."""
    plan = T.route(a.wanted, a.keywords)
    rows = a.search().select("sample_idx", F.col("edge_id").alias("unit"), "score", F.lit("keyword_search").alias("tool"))
    for name, frame in (("find_by_id", a.by_id().groupBy("sample_idx", "edge_id").agg(F.max("score").alias("score"))), ("find_by_page", a.by_page()), ("find_by_section", a.by_section()),
                        ("enumerate", a.items().withColumn("score", F.lit(1.0)))):
        rows = rows.unionByName(frame.select("sample_idx", F.col("edge_id").alias("unit"), "score", F.lit(name).alias("tool")))
    return merge_tools(cut(rows.join(plan.withColumnRenamed("seq", "tool_seq"), ["sample_idx", "tool"]).withColumn("seq", F.col("unit"))))


def execute_route(spark, d):
    return _results(Q.Asked(spark, d)).select("sample_idx", "unit", "tool", F.round("score", 6).alias("score"))


def _candidates(spark, d):
    a = Q.Asked(spark, d)
    c = cut(_results(a).select("sample_idx", "unit", "tool", "tool_seq", "score"))
    w = a.wanted.select("sample_idx", "doc_id", "intent", "level", (F.size("ids") + F.size("pages")).alias("hard"), F.col("section").isNotNull().alias("in_section"))
    c = c.join(w, "sample_idx")
    # One score a keyword of the question and unit: whether the unit holds it.
    found = a.held.withColumnRenamed("edge_id", "unit").withColumn("_h", F.lit(1.0))
    s = c.select("sample_idx", "doc_id", "unit").join(a.keywords, ["sample_idx", "doc_id"]).join(found, ["doc_id", "keyword", "unit"], "left")
    s = s.groupBy("sample_idx", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("keyword", F.coalesce("_h", F.lit(0.0)).alias("h")))), lambda x: x["h"]).alias("kw_scores"))
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    r = H.related(a.edges, a.nodes).select(F.col("edge_id").alias("unit"), F.struct(F.col("block_id").alias("id"), words.alias("words"), (~F.contains("type", F.lit("caption"))).alias("related")).alias("t"))
    t = r.groupBy("unit").agg(F.array_sort(F.collect_set("t")).alias("texts"))
    hard = c.filter(F.col("tool").isin("find_by_id", "find_by_page", "find_by_section")).groupBy("sample_idx").agg(F.count("*").alias("hits"))
    return cut(c.join(s, ["sample_idx", "unit"], "left").join(t, "unit", "left").join(a.units.select(F.col("edge_id").alias("unit"), F.array("page").alias("pages")), "unit", "left").join(hard, "sample_idx", "left")
               .withColumn("satisfied", ((F.col("hard") > 0) | F.col("in_section")) & (F.coalesce("hits", F.lit(0)) > 0)).withColumn("succeeded", F.col("tool") == "enumerate")
               .withColumn("crop", F.lit(True)).withColumn("seq", F.row_number().over(Rt.Window.partitionBy("sample_idx").orderBy("tool_seq", F.col("score").desc(), "unit"))))


def select_density(spark, d):
    return S.select_evidence(_candidates(spark, d), S.Rules())


def select_budget(spark, d):
    """As ``select_density``, within a budget of eight input units."""
    return S.select_evidence(_candidates(spark, d), S.Rules(budget=8.0))


def prune_related(spark, d):
    """Related texts worth showing beside each candidate of the keyword search."""
    a = Q.Asked(spark, d)
    top = a.search().select("sample_idx", F.col("edge_id").alias("unit"))
    r = H.related(a.edges, a.nodes).select(F.col("edge_id").alias("unit"), "pos", "type", Rt.normalize_ocr(F.coalesce("text", F.lit(""))).alias("text"))
    per = a.keywords.groupBy("sample_idx").agg(F.array_sort(F.collect_set("keyword")).alias("k"))
    x = top.join(r, "unit").join(per, "sample_idx").withColumn("scores", F.transform("k", lambda w: F.contains("text", w).cast("double")))
    is_caption = F.contains("type", F.lit("caption"))
    seed = x.filter(is_caption).groupBy("sample_idx", "unit").agg(F.max_by("scores", F.aggregate("scores", F.lit(0.0), lambda a, b: a + b)).alias("scores"))
    rest = x.filter(~is_caption).select("sample_idx", "unit", "pos", F.col("type").isin(*TITLE_TYPES).alias("is_title"), "scores")
    return S.prune_blocks(rest, seed)


QUERIES = {f.__name__: f for f in (execute_route, select_density, select_budget, prune_related)}

SQL = {
    "execute_route": "SELECT sample_idx, unit, tool, round(score, 6) AS score FROM (SELECT p.sample_idx, p.seq AS tool_seq, p.tool, a.unit, a.score FROM (" + Q.SQL["route_plan"] + ") p JOIN (" + " UNION ALL ".join(
        f"SELECT sample_idx, edge_id AS unit, {score} AS score, '{tool}' AS tool FROM ({Q.SQL[q]}) {group}" for tool, q, score, group in (
            ("keyword_search", "unit_keyword_topk", "score", ""), ("find_by_id", "find_by_id", "max(score)", "GROUP BY sample_idx, edge_id"), ("find_by_page", "find_by_page_units", "score", ""),
            ("find_by_section", "find_by_section", "score", ""), ("enumerate", "enumerate_items", "1.0", ""))) + ") a USING (sample_idx, tool)) QUALIFY row_number() OVER (PARTITION BY sample_idx, unit ORDER BY tool_seq, unit) = 1",
}
