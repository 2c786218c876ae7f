"""Layout blocks: filters, merged visuals, captions, titles, reading order, spatial arcs.

All joins are equi-joins on document and page with range predicates behind
them, and all windows are partitioned by page, so no document is ever handled
by one task however many pages it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions.text import is_visual
from quire.schema import CAPTION_TYPES, TITLE_TYPES

PAGE = ["doc_id", "page"]


def layout(blocks: DataFrame, text: bool = True) -> DataFrame:
    """Distinct blocks with box corners as columns (null where the box is null). Without ``text`` only the
    columns of the layout are read, compared and moved."""
    b = blocks.select("doc_id", "block_id", "page", "bbox", "block_type", *(["text", "rec_conf"] if text else [])).distinct()
    return b.select("doc_id", "block_id", "page", *[c.alias(k) for k, c in G.box(F.col("bbox")).items()], F.col("block_type").alias("type"), *(["text", "rec_conf"] if text else []))


def of_type(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.filter(F.col("type").isin(*types))


def on_page(blocks: DataFrame, page: int) -> DataFrame:
    return blocks.filter(F.col("page") == page)


def markers(blocks: DataFrame) -> DataFrame:
    """Section titles, captions and body texts by document, as counts of non-blank blocks."""
    t = blocks.filter(F.trim("text") != "")
    return t.groupBy("doc_id").agg(F.count_if(F.col("type").isin(*TITLE_TYPES)).alias("titles"), F.count_if(F.col("type").isin(*CAPTION_TYPES)).alias("captions"),
                                   F.count_if(F.col("type").isin("text", "list")).alias("texts"))


def document_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), (F.max("page") + 1).cast("bigint").alias("pages"),
                                        F.count_if(is_visual(F.col("type"))).alias("visuals"), F.count_if(F.col("text").isNull()).alias("textless"))


def merge_adjacent(blocks: DataFrame, gap: float = 20.0, share: float = 0.8) -> DataFrame:
    """Stacked visuals of one type merged (gaps and islands): id of the first, union of the boxes.
    Blocks without a box stay out."""
    v = blocks.filter(is_visual(F.col("type")) & F.col("x1").isNotNull())
    w = Window.partitionBy(*PAGE).orderBy("y1", "block_id")
    prev = {c: F.lag(c).over(w) for c in ("x1", "x2", "y2", "type")}
    wide = F.least(F.col("x2") - F.col("x1"), prev["x2"] - prev["x1"])
    joined = ((F.col("type") == prev["type"]) & (F.col("y1") - prev["y2"] < gap) & (wide > 0)
              & (F.least("x2", prev["x2"]) - F.greatest("x1", prev["x1"]) > share * wide))
    isle = v.withColumn("_break", F.when(joined, 0).otherwise(1)).withColumn("_isle", F.sum("_break").over(w))
    return isle.groupBy(*PAGE, "_isle").agg(
        F.min_by("block_id", F.struct("y1", "block_id")).alias("block_id"), F.min_by("type", F.struct("y1", "block_id")).alias("type"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("merged")).drop("_isle")


def _two(left: DataFrame, right: DataFrame, names=("block_id", "type", "x1", "y1", "x2", "y2")) -> DataFrame:
    r = right.select(*PAGE, *[F.col(n).alias(f"b_{n}") for n in names])
    return left.join(r, PAGE)


def captions(visuals: DataFrame, blocks: DataFrame, reach: float = 300.0) -> DataFrame:
    """Best caption of each visual on its page: typed before plain text, below before above, then nearest."""
    c = blocks.filter(F.col("type").isin(*CAPTION_TYPES, "caption", "text") & F.col("x1").isNotNull())
    p = _two(visuals.select(*PAGE, "block_id", "x1", "y1", "x2", "y2"), c)
    below, above = F.col("b_y1") >= F.col("y2"), F.col("y1") >= F.col("b_y2")
    gap = F.when(below, F.col("b_y1") - F.col("y2")).otherwise(F.col("y1") - F.col("b_y2"))
    p = p.withColumn("gap", gap).withColumn("side", F.when(below, 0).otherwise(1)).withColumn("rank", F.when(F.col("b_type") == "text", 1).otherwise(0))
    p = p.filter((F.col("block_id") != F.col("b_block_id")) & (below | above) & (F.col("gap") < reach)
                 & (G.overlap(F.col("x1"), F.col("x2"), F.col("b_x1"), F.col("b_x2")) >= 0.3 * (F.col("x2") - F.col("x1"))))
    best = p.groupBy("doc_id", "page", "block_id").agg(F.min(F.struct("rank", "side", "gap", "b_block_id")).alias("m"))
    return best.select("doc_id", "page", "block_id", F.col("m.b_block_id").alias("caption_id"), F.col("m.rank").alias("plain"), F.col("m.side").alias("side"))


def nearest_titles(visuals: DataFrame, blocks: DataFrame, back: int = 3) -> DataFrame:
    """Nearest title of each visual, as-of its page: above it or beside it on the page, or up to
    ``back`` pages before. The pages looked at are spelled out, so the join is an equi-join."""
    t = blocks.filter(F.col("type").isin(*TITLE_TYPES) & F.col("x1").isNotNull()).select(
        "doc_id", F.col("page").alias("look"), F.col("block_id").alias("title_id"), F.col("x1").alias("tx1"), F.col("x2").alias("tx2"), F.col("y1").alias("ty1"), F.col("y2").alias("ty2"))
    v = visuals.select("doc_id", "page", "block_id", "x1", "x2", "y1").withColumn("look", F.explode(F.sequence(F.greatest(F.lit(0), F.col("page") - back), F.col("page"))))
    same = F.col("look") == F.col("page")
    p = v.join(t, ["doc_id", "look"]).filter(~same | (F.col("ty2") <= F.col("y1")) | (G.overlap(F.col("x1"), F.col("x2"), F.col("tx1"), F.col("tx2")) < 50))
    score = F.when(same, F.abs(F.col("y1") - F.col("ty2")) / 1000.0).otherwise((F.col("page") - F.col("look")).cast("double"))
    best = p.groupBy("doc_id", "page", "block_id").agg(F.min(F.struct(F.round(score, 9).alias("score"), (-F.col("look")).alias("p"), "title_id")).alias("m"))
    return best.select("doc_id", "page", "block_id", F.col("m.title_id").alias("title_id"), (-F.col("m.p")).alias("title_page"))


def reading_order(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y1") / 8), "x1", "block_id")
    b = blocks.filter(F.col("x1").isNotNull())
    return b.select("doc_id", "page", "block_id", F.row_number().over(w).alias("place"), F.lead("block_id").over(w).alias("next_id"))


def page_chain(blocks: DataFrame) -> DataFrame:
    """Arc from the lowest block of a page to the highest of the next page that has any."""
    b = blocks.filter(F.col("x1").isNotNull())
    ends = b.groupBy(*PAGE).agg(F.max_by("block_id", F.struct("y2", "block_id")).alias("last"), F.min_by("block_id", F.struct("y1", "block_id")).alias("first"))
    nxt = ends.select("doc_id", (F.col("page") - 1).cast("int").alias("page"), F.col("first").alias("dst"))
    return ends.join(nxt, PAGE).select("doc_id", "page", F.col("last").alias("src"), "dst")


def spatial_pairs(blocks: DataFrame, near: float = 300.0, least_iou: float = 0.05) -> DataFrame:
    """Both directions of every close or overlapping pair of boxes of a page, with distance,
    overlap, direction and arc weight."""
    b = blocks.filter(F.col("x1").isNotNull()).select(*PAGE, "block_id", "type", "x1", "y1", "x2", "y2")
    p = _two(b, b).filter(F.col("block_id") != F.col("b_block_id"))
    a, c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2")}, {k: F.col(f"b_{k}") for k in ("x1", "y1", "x2", "y2")}
    p = p.withColumn("distance", G.centre_distance(a, c)).withColumn("iou", G.iou(a, c))
    p = p.filter((F.col("distance") < near) | (F.col("iou") > least_iou))
    return p.select(*PAGE, F.col("block_id").alias("src"), F.col("b_block_id").alias("dst"), "distance", "iou", G.direction(a, c).alias("direction"),
                    G.arc_weight(F.col("distance"), F.col("iou")).alias("weight"))


def page_knn(blocks: DataFrame, k: int = 6) -> DataFrame:
    """Arcs to the k nearest boxes of the page, kept from the smaller to the larger id."""
    b = blocks.filter(F.col("x1").isNotNull()).select(*PAGE, "block_id", "type", "x1", "y1", "x2", "y2")
    p = _two(b, b).filter(F.col("block_id") != F.col("b_block_id"))
    a, c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}, {n: F.col(f"b_{n}") for n in ("x1", "y1", "x2", "y2")}
    w = Window.partitionBy(*PAGE, "block_id").orderBy("distance", "b_block_id")
    p = p.withColumn("distance", G.centre_distance(a, c)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return p.filter(F.col("block_id") < F.col("b_block_id")).select(*PAGE, F.col("block_id").alias("src"), F.col("b_block_id").alias("dst"), "distance", "rank")


def title_children(blocks: DataFrame, page_height: float = 1584.0) -> DataFrame:
    """Arc from the nearest title above a block, in reach, not cut off by another title between."""
    t = blocks.filter(F.col("type").isin(*TITLE_TYPES) & F.col("x1").isNotNull())
    c = blocks.filter(~F.col("type").isin(*TITLE_TYPES) & F.col("x1").isNotNull()).select(*PAGE, "block_id", "type", "x1", "y1", "x2", "y2")
    p = _two(c, t).filter((F.col("b_y2") <= F.col("y1")) & (F.col("y1") - F.col("b_y2") <= 0.25 * page_height)
                          & (G.overlap_ratio(F.col("x1"), F.col("x2"), F.col("b_x1"), F.col("b_x2")) >= 0.2))
    # The nearest title cannot have another that starts between: that one would be nearer.
    best = p.groupBy(*PAGE, "block_id").agg(F.max_by("b_block_id", F.struct("b_y1", "b_block_id")).alias("title_id"))
    return best


def below_of(blocks: DataFrame, upper: tuple[str, ...], lower: tuple[str, ...], reach: float, least: float = 0.0) -> DataFrame:
    """Nearest block of the ``lower`` types below each block of the ``upper`` types (visual to
    caption, list to next list item)."""
    u = blocks.filter(F.col("type").isin(*upper) & F.col("x1").isNotNull()).select(*PAGE, "block_id", "type", "x1", "y1", "x2", "y2")
    d = blocks.filter(F.col("type").isin(*lower) & F.col("x1").isNotNull())
    p = _two(u, d).filter((F.col("block_id") != F.col("b_block_id")) & (F.col("b_y1") >= F.col("y2")) & (F.col("b_y1") - F.col("y2") <= reach)
                          & (G.overlap_ratio(F.col("x1"), F.col("x2"), F.col("b_x1"), F.col("b_x2")) >= least))
    best = p.groupBy(*PAGE, "block_id").agg(F.min(F.struct((F.col("b_y1") - F.col("y2")).alias("gap"), "b_block_id")).alias("m"))
    return best.select(*PAGE, F.col("block_id").alias("src"), F.col("m.b_block_id").alias("dst"), F.col("m.gap").alias("gap"))


def text_of_boxes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """Spatial join: recognised lines whose centre lies in a box, their text joined in reading
    order, their confidence averaged. ``boxes``: blocks; ``lines``: ids, boxes, text, rec_conf."""
    ln = lines.select(*PAGE, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.col("text").alias("line"),
                      F.col("rec_conf").alias("conf"), F.col("block_id").alias("line_id"))
    p = boxes.select(*PAGE, "block_id", "x1", "y1", "x2", "y2").join(ln, PAGE).filter(F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2")))
    parts = F.array_sort(F.collect_list(F.struct(F.bround(F.col("cy") / 8).alias("row"), "cx", "line_id", F.coalesce("line", F.lit("")).alias("line"))))
    return p.groupBy(*PAGE, "block_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("joined"), F.avg("conf").alias("conf"), F.count("*").alias("lines"))


def page_extent(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.max("x2").alias("width"), F.max("y2").alias("height"))


def locate(blocks: DataFrame, hint: str) -> DataFrame:
    """The visual of each page that fits a spatial hint best."""
    v = blocks.filter(is_visual(F.col("type")) & F.col("x1").isNotNull()).join(page_extent(blocks), PAGE)
    s = G.location_score((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("width"), F.col("height"), hint)
    best = v.withColumn("score", s).groupBy(*PAGE).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("block_id")).alias("b"))).alias("m"))
    return best.select(*PAGE, (-F.col("m.b")).alias("block_id"), F.col("m.score").alias("score"))


def block_graph(blocks: DataFrame, page_height: float = 1584.0) -> DataFrame:
    """The graph of a document's blocks: ``doc_id, src, dst, kind, weight``, one arc a pair, of the first kind that gives
    it: reading order (``before``), nearest boxes (``spatial``), title to content, visual to caption,
    list item to the next, lowest block to the next page's highest."""
    near = page_knn(blocks)
    parts = (
        reading_order(blocks).filter("next_id is not null").select("doc_id", F.col("block_id").alias("src"), F.col("next_id").alias("dst"), F.lit("before").alias("kind"), F.lit(1.0).alias("weight")),
        near.select("doc_id", "src", "dst", F.lit("spatial").alias("kind"), (1.5 / (1.0 + F.col("distance") / 300.0)).alias("weight")),
        title_children(blocks, page_height).select("doc_id", F.col("title_id").alias("src"), F.col("block_id").alias("dst"), F.lit("title").alias("kind"), F.lit(0.8).alias("weight")),
        below_of(blocks, ("figure", "table", "chart", "map", "diagram", "graph"), CAPTION_TYPES, 0.2 * page_height).select("doc_id", "src", "dst", F.lit("caption").alias("kind"), F.lit(0.9).alias("weight")),
        below_of(blocks, ("list",), ("list",), 0.1 * page_height, 0.2).select("doc_id", "src", "dst", F.lit("list").alias("kind"), F.lit(0.7).alias("weight")),
        page_chain(blocks).select("doc_id", "src", "dst", F.lit("page").alias("kind"), F.lit(0.5).alias("weight")))
    every = None
    for no, part in enumerate(parts):
        part = part.withColumn("_no", F.lit(no))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("doc_id", "src", "dst").agg(F.min(F.struct("_no", "kind", "weight")).alias("m"))
    return best.select("doc_id", "src", "dst", "m.kind", "m.weight")


# How a hint names a place beside another unit, and the words of directions.
BESIDE = r"(below|above|under|over|next to|beside)\s+((?:figure|table|chart)\s*[0-9]+)"
DIRECTIONS = {"top": ("top", "upper", "above"), "bottom": ("bottom", "lower", "below"), "left": ("left",), "right": ("right",), "center": ("center", "middle")}


def spatial_hint(hint):
    """The unit a hint refers to and the relation to it (null where it names none), and which directions it names."""
    low = F.lower(F.coalesce(hint, F.lit("")))

    def names(words):
        found = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(low, F.lit(w))
        return found

    return F.struct(F.nullif(F.regexp_extract(low, BESIDE, 1), F.lit("")).alias("relation"), F.nullif(F.regexp_extract(low, BESIDE, 2), F.lit("")).alias("unit"),
                    *[names(words).alias(d) for d, words in DIRECTIONS.items()])
