"""Printed and physical pages, missing numbers, page-level selections and cross-page arcs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_visual, jaccard, token_set


def pagination(probes: DataFrame) -> DataFrame:
    """Layout and offset of each document by vote over probes ``doc_id, page, layout, printed array<int>``.

    ``layout``: most frequent, the first seen among equals; ``confidence``: its
    share. Single pages: ``offset`` is the mode of physical less printed page
    (counted from 0). Double pages: the left page of the first two probes gives
    ``stride`` and ``intercept``; one probe gives stride 2 and half the confidence.
    """
    votes = probes.groupBy("doc_id", "layout").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    total = votes.groupBy("doc_id").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("first")).alias("f"), "layout")).alias("m"))
    lay = total.select("doc_id", F.col("m.layout").alias("layout"), (F.col("m.n") / F.col("all")).alias("confidence"))
    p = probes.join(lay, ["doc_id", "layout"]).filter(F.size("printed") > 0).withColumn("left", F.array_min(F.slice("printed", 1, 2)))
    single = p.groupBy("doc_id", (F.col("page") - (F.col("left") - 1)).alias("offset")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    single = single.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "offset")).alias("m")).select("doc_id", F.col("m.offset").alias("offset"))
    two = p.groupBy("doc_id").agg(F.min(F.struct("page", "left")).alias("a"), F.slice(F.array_sort(F.collect_set(F.struct("page", "left"))), 1, 2).alias("ab"))
    stride = F.when(F.size("ab") > 1, F.floor((F.col("ab")[1]["left"] - F.col("ab")[0]["left"]) / (F.col("ab")[1]["page"] - F.col("ab")[0]["page"]))).otherwise(F.lit(2))
    two = two.select("doc_id", stride.alias("stride"), (F.col("a.left") - stride * F.col("a.page")).alias("intercept"), (F.size("ab") == 1).alias("lonely"))
    out = lay.join(single, "doc_id", "left").join(two, "doc_id", "left")
    return out.select("doc_id", "layout", F.when((F.col("layout") == "double") & F.coalesce("lonely", F.lit(True)), F.col("confidence") / 2).otherwise(F.col("confidence")).alias("confidence"),
                      F.coalesce("offset", F.lit(0)).alias("offset"), "stride", "intercept")


def to_physical(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """Physical pages of printed pages ``doc_id, key, printed``; without a rule, printed less one."""
    j = asked.join(rules, "doc_id", "left")
    u, a, b = F.col("printed"), F.col("intercept"), F.col("stride")
    left = F.when((u - a) % b == 0, (u - a) / b)
    right = F.when((u - 1 - a) % b == 0, (u - 1 - a) / b)
    page = F.when(F.col("layout") == "single", u - 1 + F.col("offset")).when((F.col("layout") == "double") & (b > 0), F.coalesce(left, right)).when(F.col("layout") == "double", F.lit(None)).otherwise(u - 1)
    return j.select("doc_id", "key", "printed", page.cast("int").alias("page")).filter(F.col("page") >= 0).distinct()


def infer_missing(anchors: DataFrame) -> DataFrame:
    """Numbers of unnumbered visuals between numbered ones of a page: ``doc_id, page, type, number, block_id, score``.

    ``anchors``: doc_id, page, type, y1, block_id, number (null where not read).
    Between neighbours n1 < n2 with the numbers n1+1..n2-1 missing: a lone
    visual takes them at 0.75, several take proportional places at 0.65.
    """
    w = Window.partitionBy("doc_id", "page", "type").orderBy("y1", "block_id")
    a = anchors.withColumn("place", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("number").isNotNull(), F.struct("place", "number"))
    g = a.withColumn("lo", F.last(known, ignorenulls=True).over(before)).withColumn("hi", F.first(known, ignorenulls=True).over(after)).filter(
        F.col("number").isNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("hi.number") - F.col("lo.number") > 1))
    free = F.col("hi.place") - F.col("lo.place") - 1
    t = g.withColumn("free", free).withColumn("number", F.explode(F.sequence(F.col("lo.number") + 1, F.col("hi.number") - 1)))
    share = (F.col("number") - F.col("lo.number")) / (F.col("hi.number") - F.col("lo.number"))
    want = F.when(F.col("free") == 1, F.col("lo.place") + 1).otherwise(F.col("lo.place") + 1 + F.least(F.floor(share * F.col("free")), F.col("free") - 1))
    return t.filter(F.col("place") == want).select("doc_id", "page", "type", "number", "block_id", F.when(F.col("free") == 1, 0.75).otherwise(0.65).alias("score"))


def cross_page_arcs(blocks: DataFrame, least: float = 0.2, k: int = 3) -> DataFrame:
    """Arcs to the most alike texts of the next page by shared words, at most k out of a block:
    ``doc_id, page, src, dst, weight``."""
    t = blocks.filter(F.length(F.trim("text")) > 0).select("doc_id", "page", "block_id", token_set(F.col("text")).alias("tokens"))
    nxt = t.select("doc_id", (F.col("page") - 1).cast("int").alias("page"), F.col("block_id").alias("dst"), F.col("tokens").alias("other"))
    p = t.join(nxt, ["doc_id", "page"]).withColumn("weight", F.round(jaccard(F.col("tokens"), F.col("other")), 9)).filter(F.col("weight") >= least)
    w = Window.partitionBy("doc_id", "page", "block_id").orderBy(F.col("weight").desc(), "dst")
    return p.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("doc_id", "page", F.col("block_id").alias("src"), "dst", "weight")


def expand_by_page(selected: DataFrame, blocks: DataFrame) -> DataFrame:
    """Selected blocks and those of the pages beside them: ``doc_id, block_id, new``."""
    pages = selected.select("doc_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct()
    near = blocks.join(pages, ["doc_id", "page"], "left_semi").select("doc_id", "block_id").join(selected.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")
    return selected.select("doc_id", "block_id", F.lit(False).alias("new")).unionByName(near.withColumn("new", F.lit(True)))


def visual_floor(ranked: DataFrame, k: int, share: float) -> DataFrame:
    """Top k blocks of each page by score with at least ``share`` visuals where there are that many:
    the best unseen visuals take the places of the lowest others."""
    need = math.ceil(share * k)
    v = ranked.withColumn("visual", is_visual(F.col("type")))
    own = Window.partitionBy("doc_id", "page", "visual").orderBy(F.col("score").desc(), "block_id")
    v = v.withColumn("own", F.row_number().over(own))
    w = Window.partitionBy("doc_id", "page").orderBy((F.col("visual") & (F.col("own") <= need)).desc(), F.col("score").desc(), "block_id")
    return v.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("doc_id", "page", "block_id", "type", "score")


def modality(ranked: DataFrame) -> DataFrame:
    """How the types share a document's blocks, and their mean scores."""
    g = ranked.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    t = ranked.groupBy("doc_id").agg(F.count("*").alias("all"))
    return g.join(t, "doc_id").select("doc_id", "type", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "mean_score")
