"""Arcs and links by likeness of texts: encoders as columns, neighbours in reading order, co-occurrence, related texts.

Pairs are met within a page, or within a stated number of pages, never over a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import jaccard, token_set
from quire.operators.layout import PAGE
from quire.schema import TITLE_TYPES

DIMENSIONS = 16


def hashed_words(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Stand-in for a text encoder: counts of a text's tokens by a hash of their first letter and length. Built-in
    expressions only, the same everywhere; an encoder's vectors of any kind take its place."""
    slots = F.transform(token_set(text), lambda w: F.pmod(F.ascii(w) * 31 + F.length(w), F.lit(dimensions)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is missing or has no length."""
    def total(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.coalesce(F.when(norm > 0, total(a, b) / norm), F.lit(0.0))


def _ordered(blocks: DataFrame, text: str, vector: str | None) -> DataFrame:
    """Text blocks with their place in the page's reading order, and their vector."""
    b = blocks.filter(F.col("x1").isNotNull() & F.col("type").isin("text", "list", *TITLE_TYPES) & (F.trim(text) != ""))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y1") / 8), "x1", "block_id"))
    return b.select(*PAGE, "block_id", "type", F.col(text).alias("_t"), place.alias("place"), (F.col(vector) if vector else hashed_words(F.col(text))).alias("_v"))


def _pairs(rows: DataFrame, *keys: str) -> DataFrame:
    r = rows.select(*keys, F.col("block_id").alias("dst"), F.col("place").alias("dst_place"), F.col("_v").alias("_w"), F.col("_t").alias("_u"))
    return rows.withColumnRenamed("block_id", "src").join(r, list(keys)).filter("place < dst_place").withColumn("sim", (F.lit(1.0) + cosine(F.col("_v"), F.col("_w"))) / 2)


def similar_next(blocks: DataFrame, arcs: DataFrame | None = None, vector: str | None = None, least: float = 0.3, k: int = 2) -> DataFrame:
    """Arcs from each text of a page to the ``k`` most alike texts behind it in reading order: ``doc_id, page, src, dst, weight``
    (0.6 of the likeness from 0 to 1). Arcs that exist already (``arcs``: doc_id, page, src, dst) are left out after the choice."""
    p = _pairs(_ordered(blocks, "text", vector), *PAGE).filter(F.col("sim") >= least)
    w = Window.partitionBy(*PAGE, "src").orderBy(F.round("sim", 9).desc(), "dst_place")
    out = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select(*PAGE, "src", "dst", (0.6 * F.col("sim")).alias("weight"))
    return out.join(arcs.select(*PAGE, "src", "dst").distinct(), [*PAGE, "src", "dst"], "left_anti") if arcs is not None else out


def co_occurrence(blocks: DataFrame, titles: DataFrame, vector: str | None = None, least: float = 0.4, shared: float = 0.2) -> DataFrame:
    """Arc from each text to the most alike one behind it below the same title, or on the page outside titles:
    both likeness and shared tokens must reach their floors; the weight is their mean.
    ``titles``: doc_id, page, block_id, title_id."""
    b = _ordered(blocks, "text", vector).filter(~F.col("type").isin(*TITLE_TYPES)).join(titles.select(*PAGE, "block_id", "title_id"), [*PAGE, "block_id"], "left")
    b = b.withColumn("title_id", F.coalesce("title_id", F.lit(-1)))
    p = _pairs(b, *PAGE, "title_id").withColumn("overlap", jaccard(token_set(F.col("_t")), token_set(F.col("_u"))))
    p = p.filter((F.col("sim") >= least) & (F.col("overlap") >= shared)).withColumn("weight", (F.col("sim") + F.col("overlap")) / 2)
    w = Window.partitionBy(*PAGE, "src").orderBy(F.round("weight", 9).desc(), "dst_place")
    return p.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*PAGE, "src", "dst", "weight")


def related_texts(visuals: DataFrame, captions: DataFrame, blocks: DataFrame, vector: str | None = None, pages: int = 2, least: float = 0.25, k: int = 3) -> DataFrame:
    """Texts that speak of a visual: ``doc_id, block_id, text_id, similarity, rank`` of the ``k`` most alike plain texts
    within ``pages`` pages, read with confidence, of more than five characters, and no caption of any
    visual. A visual is told by its caption's text; one without a caption has no vector and no texts.
    The pages looked at are spelled out, so the join is an equi-join."""
    text = blocks.select("doc_id", F.col("block_id").alias("caption_id"), (F.col(vector) if vector else hashed_words(F.col("text"))).alias("_v"))
    v = visuals.select("doc_id", "page", "block_id").join(captions.select("doc_id", "page", "block_id", "caption_id"), [*PAGE, "block_id"]).join(text, ["doc_id", "caption_id"])
    v = v.withColumn("look", F.explode(F.sequence(F.greatest(F.lit(0), F.col("page") - pages), F.col("page") + pages)))
    t = blocks.filter((F.col("type") == "text") & (F.length(F.trim("text")) > 5) & (F.col("rec_conf") >= 0.9)).join(captions.select("doc_id", F.col("caption_id").alias("block_id")).distinct(), ["doc_id", "block_id"], "left_anti")
    t = t.select("doc_id", F.col("page").alias("look"), F.col("block_id").alias("text_id"), (F.col(vector) if vector else hashed_words(F.col("text"))).alias("_w"))
    p = v.join(t, ["doc_id", "look"]).withColumn("similarity", cosine(F.col("_v"), F.col("_w"))).filter(F.col("similarity") > least)
    w = Window.partitionBy("doc_id", "block_id").orderBy(F.round("similarity", 9).desc(), "look", "text_id")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("doc_id", "block_id", "text_id", "similarity", "rank")


