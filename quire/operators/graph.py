"""Document hypergraphs as tables: nodes, pages, edges, members, and the units they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_visual
from quire.operators.nested import edge_tables
from quire.schema import RELATED_TYPES, TITLE_TYPES, VISUAL_TYPES


def edges(graphs: DataFrame) -> DataFrame:
    """One row an edge: those of the ``hyperedges`` column in the order written, and, where that
    column is null, those of ``raw_record``, nested ones too; ``seq`` is an edge's place in its own list.
    Repeated documents count once."""
    e = graphs.select("document_id", F.posexplode("hyperedges").alias("seq", "e"))
    e = e.groupBy("document_id", "seq", F.col("e.edge_id")).agg(F.first("e").alias("e"))  # repeated rows count once
    m = F.col("e.meta")
    own = e.select(F.col("document_id").alias("doc_id"), "seq", F.col("e.edge_id").alias("edge_id"), F.col("e.edge_type").alias("edge_type"),
                   F.col("e.members").alias("members"), m["relation"].alias("relation"), m["page_num"].alias("page"), m["section_title"].alias("section_title"),
                   m["num_visuals"].alias("num_visuals"), m["visual_types"].alias("visual_types"), m["statistics"].alias("statistics"))
    return own.unionByName(_raw_edges(graphs)) if "raw_record" in graphs.columns else own


def _raw_edges(graphs: DataFrame) -> DataFrame:
    """The edges of ``raw_record``, from the flat tables that its nested records are turned into."""
    t = edge_tables(graphs.filter("hyperedges is null and raw_record is not null"))

    def gathered(name, *cols):
        rows = F.array_sort(F.collect_list(F.struct("ordinal", "sk", *cols)))
        return t[name].groupBy("parent_sk").agg(rows.alias(name))

    types = gathered("visual_types", "type", "n").select("parent_sk", F.map_from_entries(F.transform("visual_types", lambda x: F.struct(x["type"], x["n"].cast("int")))).alias("visual_types"))
    in_order = gathered("members", "block_id").select("parent_sk", F.transform("members", lambda x: x["block_id"]).alias("members"))
    e = (t["edges"].withColumnRenamed("parent_sk", "_around").withColumnRenamed("sk", "parent_sk").join(in_order, "parent_sk", "left").join(types, "parent_sk", "left"))
    meta = {name: F.try_variant_get("meta", f"$.{name}", kind) for name, kind in (("relation", "string"), ("page_num", "int"), ("section_title", "string"), ("num_visuals", "int"))}
    stats = F.struct(*[F.try_variant_get("meta", f"$.statistics.{n}", k).alias(n) for n, k in (
        ("has_caption", "boolean"), ("has_title", "boolean"), ("num_related_texts", "int"), ("total_blocks", "int"), ("page_span_size", "int"), ("is_cross_page", "boolean"), ("is_merged_block", "boolean"))])
    return e.filter("edge_id is not null").select(
        F.col("document_id").alias("doc_id"), F.col("ordinal").cast("int").alias("seq"), "edge_id", "edge_type", F.coalesce("members", F.array().cast("array<string>")).alias("members"),
        meta["relation"].alias("relation"), meta["page_num"].alias("page"), meta["section_title"].alias("section_title"), meta["num_visuals"].alias("num_visuals"), "visual_types",
        F.when(F.try_variant_get("meta", "$.statistics", "variant").isNotNull(), stats).alias("statistics"))


def members(edge_rows: DataFrame) -> DataFrame:
    """Bridge rows ``doc_id, edge_id, pos, block_id`` (null members left out, places kept)."""
    return edge_rows.select("doc_id", "edge_id", F.posexplode("members").alias("pos", "block_id")).filter(F.col("block_id").isNotNull())


def nodes(graphs: DataFrame) -> DataFrame:
    b = graphs.select("document_id", "blocks").distinct().select(F.col("document_id").alias("doc_id"), F.explode("blocks").alias("b"))
    return b.select("doc_id", F.col("b.block_id").alias("block_id"), F.col("b.block_type").alias("type"), F.col("b.page").alias("page"), F.col("b.bbox").alias("bbox"),
                    F.col("b.text").alias("text"), F.col("b.rec_conf").alias("rec_conf")).distinct()


def pages(graphs: DataFrame) -> DataFrame:
    p = graphs.select("document_id", "pages").distinct().select(F.col("document_id").alias("doc_id"), F.explode("pages").alias("p"))
    return p.select("doc_id", F.col("p.page_id").alias("page_id"), F.col("p.page_num").alias("page"), F.col("p.page_image_path").alias("image_path")).distinct()


def edges_of(edge_rows: DataFrame, edge_type: str, relation: str | None = None) -> DataFrame:
    out = edge_rows.filter(F.col("edge_type") == edge_type)
    return out.filter(F.col("relation") == relation) if relation else out


def sub_graph(edge_rows: DataFrame, node_rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Edges that satisfy ``keep``, and the nodes that are members of any of them."""
    e = edge_rows.filter(keep)
    return e, node_rows.join(members(e).select("doc_id", "block_id").distinct(), ["doc_id", "block_id"], "left_semi")


def _joined(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    return members(edge_rows).join(node_rows.select("doc_id", "block_id", "type", "page", "text"), ["doc_id", "block_id"])


def _anchor(kind: Column, block_id: Column) -> Column:
    return is_visual(kind) | F.contains(F.lower(block_id), F.lit("anchor"))


def anchors(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """First member of each edge that is visual or named an anchor."""
    a = _joined(edge_rows, node_rows).filter(_anchor(F.col("type"), F.col("block_id")))
    m = a.groupBy("doc_id", "edge_id").agg(F.min(F.struct("pos", "block_id", "type", "page")).alias("m"))
    return m.select("doc_id", "edge_id", F.col("m.block_id").alias("anchor_id"), F.col("m.type").alias("type"), F.col("m.page").alias("page"))


def edge_captions(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """First member of each edge that is a caption by type or name, and is no anchor."""
    j = _joined(edge_rows, node_rows)
    c = j.filter(~_anchor(F.col("type"), F.col("block_id")) & (F.contains(F.lower("type"), F.lit("caption")) | F.contains(F.lower("block_id"), F.lit("caption"))))
    m = c.groupBy("doc_id", "edge_id").agg(F.min(F.struct("pos", "block_id", "text")).alias("m"))
    return m.select("doc_id", "edge_id", F.col("m.block_id").alias("caption_id"), F.col("m.text").alias("caption"))


def related(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """All other members of text-like types, in member order (caption and title among them)."""
    j = _joined(edge_rows, node_rows).filter(~_anchor(F.col("type"), F.col("block_id")) & F.col("type").isin(*RELATED_TYPES))
    return j.select("doc_id", "edge_id", "pos", "block_id", "type", "text")


def edge_text(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Texts of an edge's members in order, blank ones left out, joined by blanks."""
    j = _joined(edge_rows, node_rows).filter(F.trim("text") != "")
    t = j.groupBy("doc_id", "edge_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "text"))).alias("t"))
    return t.select("doc_id", "edge_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def co_members(edge_rows: DataFrame, of: DataFrame) -> DataFrame:
    """Blocks that share an edge with the asked-for blocks (``of``: doc_id, block_id)."""
    m = members(edge_rows)
    mine = m.join(of.select("doc_id", "block_id").distinct(), ["doc_id", "block_id"]).select("doc_id", "edge_id", F.col("block_id").alias("asked"))
    return mine.join(m, ["doc_id", "edge_id"]).filter(F.col("asked") != F.col("block_id")).select("doc_id", "asked", "block_id").distinct()


def section_titles(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Title of each anchor: the first title member of the first containment edge that holds it."""
    c = _joined(edges_of(edge_rows, "containment"), node_rows)
    t = c.filter(F.col("type").isin(*TITLE_TYPES)).groupBy("doc_id", "edge_id").agg(F.min(F.struct("pos", "block_id", "text")).alias("t"))
    a = c.filter(_anchor(F.col("type"), F.col("block_id"))).select("doc_id", "edge_id", F.col("block_id").alias("anchor_id"))
    seq = edge_rows.select("doc_id", "edge_id", "seq")
    p = a.join(t, ["doc_id", "edge_id"]).join(seq, ["doc_id", "edge_id"])
    return p.groupBy("doc_id", "anchor_id").agg(F.min_by("t", F.struct("seq", "edge_id")).alias("t")).select("doc_id", "anchor_id", F.col("t.block_id").alias("title_id"), F.col("t.text").alias("title"))


def edge_statistics(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("doc_id").agg(
        F.count("*").alias("edges"), F.count_if(F.col("edge_type") == "contextual").alias("contextual"), F.count_if(F.col("edge_type") == "containment").alias("containment"),
        *[F.count_if(F.col("relation") == r).alias(r) for r in ("page_contains_visual", "section_contains_visual", "page_contains_visuals", "section_contains_visuals", "document_contains_visuals")])


def grouping_edges(anchor_rows: DataFrame, by: str = "page", key: str | None = None) -> DataFrame:
    """One edge over all anchors of a page, section or document: ``doc_id, [key,] members`` (ordered),
    ``num_visuals`` and ``visual_types``. ``by``: page (key ``page``), section (key ``title_id``, anchors
    without one stay out) or document. ``anchor_rows``: doc_id, anchor_id, type and the key.
    Ids are gathered per group; a document's anchors are as many as its visuals."""
    keys = ["doc_id", *([key or {"page": "page", "section": "title_id"}[by]] if by != "document" else [])]
    a = anchor_rows.select(*keys, "anchor_id", "type").distinct()
    a = a.filter(F.col(keys[-1]).isNotNull()) if by == "section" else a
    kinds = a.groupBy(*keys, "type").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("visual_types"))
    m = a.groupBy(*keys).agg(F.count("*").alias("num_visuals"), F.array_sort(F.collect_set("anchor_id")).alias("members"))
    return m.join(kinds, keys)


# ------------------------------------------------------- building from layout

def build_units(visuals: DataFrame, captions: DataFrame, titles: DataFrame) -> DataFrame:
    """Visual units: each merged visual with its caption and context title, numbered in its page."""
    u = visuals.select("doc_id", "page", "block_id", "type", "merged").join(captions.select("doc_id", "page", "block_id", "caption_id"), ["doc_id", "page", "block_id"], "left")
    u = u.join(titles.select("doc_id", "page", "block_id", "title_id", "title_page"), ["doc_id", "page", "block_id"], "left")
    return u.withColumn("total_blocks", 1 + F.col("caption_id").isNotNull().cast("int") + F.col("title_id").isNotNull().cast("int")) \
            .withColumn("is_cross_page", F.coalesce(F.col("title_page") != F.col("page"), F.lit(False))) \
            .withColumn("page_span_size", 1 + F.col("is_cross_page").cast("int"))


def build_edges(units: DataFrame) -> DataFrame:
    """The three edge families of each unit: page, section (where titled) and contextual, with members."""
    def node(role, c):
        return F.when(c.isNotNull(), F.concat_ws("_", F.col("doc_id"), F.lit("block"), F.col("block_id").cast("string"), F.lit(role)))
    anchor, cap, title = node("anchor", F.col("block_id")), node("caption", F.col("caption_id")), node("title", F.col("title_id"))
    page = F.concat_ws("_", F.col("doc_id"), F.lit("page"), F.col("page").cast("string"))
    rows = F.array_compact(F.array(
        F.struct(F.lit("containment").alias("edge_type"), F.lit("page_contains_visual").alias("relation"), F.array(page, anchor).alias("members")),
        F.when(F.col("title_id").isNotNull(), F.struct(F.lit("containment").alias("edge_type"), F.lit("section_contains_visual").alias("relation"), F.array(title, anchor).alias("members"))),
        F.struct(F.lit("contextual").alias("edge_type"), F.lit("contextual").alias("relation"), F.array_compact(F.array(anchor, cap, title)).alias("members"))))
    e = units.select("doc_id", "page", "block_id", "type", F.explode(rows).alias("e"))
    return e.select("doc_id", "page", F.concat_ws("_", F.col("doc_id"), F.lit("edge"), F.col("block_id").cast("string"), F.col("e.relation")).alias("edge_id"), "e.edge_type", "e.relation", "e.members", F.col("type").alias("visual_type"))


VISUALS = VISUAL_TYPES
