"""Nested documents to related flat tables.

``merged_schema`` infers one schema over all documents (conflicting types stay
open), ``array_levels`` lists every array level in it, and ``flatten_levels``
explodes each level into a child table that carries the parent's surrogate key
and the array ordinal, all arrays of one depth in one pass. ``edge_tables``
applies this to document hypergraphs, whichever exporter wrote them, and
``edge_children`` joins the tables by their keys.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

ITEM, FIELDS = "array<variant>", "map<string,variant>"


# ------------------------------------------------------------- merged schema

def merged_schema(docs: DataFrame, doc: str):
    """Merged type of the variant column ``doc`` over all rows, as nested
    ``("object", {name: type})``, ``("array", type)`` or ``("value", name)``.

    One aggregation; only the schema text reaches the driver. Empty input
    gives ``("value", "VOID")``.
    """
    text = docs.agg(F.schema_of_variant_agg(F.col(doc)).alias("s")).first()["s"]
    return _parse_type(text or "VOID")


def _parse_type(text: str):
    tokens = re.findall(r"`(?:[^`]|``)*`|[^<>:,\s]+|[<>:,]", text)
    pos = 0

    def one():
        nonlocal pos
        word = tokens[pos]
        pos += 1
        if word == "ARRAY":
            pos += 1
            inner = one()
            pos += 1
            return ("array", inner)
        if word == "OBJECT":
            fields = {}
            if pos < len(tokens) and tokens[pos] == "<":
                pos += 1
                while tokens[pos] != ">":
                    name = tokens[pos].strip("`").replace("``", "`")
                    pos += 2
                    fields[name] = one()
                    if tokens[pos] == ",":
                        pos += 1
                pos += 1
            return ("object", fields)
        while pos < len(tokens) and tokens[pos] == "<":  # e.g. a decimal's parameters
            while tokens[pos] != ">":
                pos += 1
            pos += 1
        return ("value", word)

    return one()


def array_levels(schema, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all array levels; ``[]`` stands for an array's elements."""
    kind, inner = schema
    if kind == "array":
        return [path, *array_levels(inner, (*path, "[]"))]
    if kind == "object":
        return [p for name, t in inner.items() for p in array_levels(t, (*path, name))]
    return []


def _at(schema, path):
    for step in path:
        schema = schema[1] if step == "[]" else schema[1][step]
    return schema


def _step(names) -> str:
    return "$" + "".join("['" + n.replace("'", "\\'") + "']" for n in names)


# --------------------------------------------------- generic recursive explode

def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _open(v: Column) -> Column:
    """A value written as JSON text is opened; any other stays. Objects and arrays are told
    first, since as text they would be written out whole."""
    text = _get(v, "$", "string")
    return F.when(_get(v, "$", ITEM).isNotNull() | _get(v, "$", FIELDS).isNotNull(), v).otherwise(
        F.coalesce(F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text)), v))


def _walk(v: Column, names) -> Column:
    """The value under ``names``, one step after another, each opened where it is JSON text."""
    for n in names:
        v = _open(_get(v, _step([n]), "variant"))
    return v


_ROW = "array<struct<level:int,ordinal:int,name:string,value:variant>>"


def _elements(value: Column, no: int, names, entries: bool) -> Column:
    """Elements of the array under ``names`` as rows of level ``no``; with ``entries`` also the
    fields of an object there, named and in the order of the names."""
    path, above = _step(names), _step(names[:-1])
    # Text is looked into only where the plain path ends early: below anything but an object.
    closed = _get(value, path, ITEM).isNull() & ((_get(value, above, FIELDS).isNull() | _get(value, path, FIELDS).isNull()) if names[:-1] else F.lit(True))
    inner = _walk(value, names)

    def row(i, name, x):
        return F.struct(F.lit(no).alias("level"), i.cast("int").alias("ordinal"), name.cast("string").alias("name"), x.alias("value"))

    listed = F.transform(F.coalesce(_get(value, path, ITEM), F.when(closed, _get(inner, "$", ITEM))), lambda x, i: row(i, F.lit(None), x))
    if entries:
        fields = F.map_entries(F.coalesce(_get(value, path, FIELDS), F.when(closed, _get(inner, "$", FIELDS))))
        listed = F.coalesce(F.transform(fields, lambda e, i: row(i, e["key"], e["value"])), listed)
    return F.coalesce(listed, F.array().cast(_ROW))


def flatten(docs: DataFrame, key: str, doc: str, levels: list[tuple[str, ...]], entries: frozenset[str] = frozenset(), root: str | None = None) -> list[DataFrame]:
    """Rows of all ``levels`` of the variant column ``doc``, one frame for each depth of nesting:
    ``key, level (place in levels), parent_sk, ordinal, sk, name, value``.

    The arrays that start at the same depth are exploded in one pass, and every
    depth is kept, so that the next one is exploded from it and no document is
    read again. A level whose array lies inside another's elements must follow
    it in ``levels``. Names in ``entries`` are levels whose objects give a row
    for each field. ``root`` names a column with the documents' surrogate key;
    without it the key is a hash of ``key``. Equal documents get equal keys.
    """
    sk = F.col(root) if root else _key(F.lit("$"), F.col(key).cast("string"))
    frame = docs.select(F.col(key), F.lit(-1).alias("level"), sk.alias("sk"), F.col(doc).alias("value"))
    split = [max((i for i, s in enumerate(p) if s == "[]"), default=-1) for p in levels]
    parents = [-1 if s < 0 else levels.index(p[:s]) for p, s in zip(levels, split)]
    out, depth = [], {-1}
    while True:
        here = [k for k in range(len(levels)) if parents[k] in depth]
        if not here:
            return out
        rows = None
        for parent in sorted({parents[k] for k in here}):
            found = F.concat(*[_elements(F.col("value"), k, levels[k][split[k] + 1:], levels[k][-1] in entries) for k in here if parents[k] == parent])
            rows = F.when(F.col("level") == parent, found) if rows is None else rows.when(F.col("level") == parent, found)
        made = frame.select(F.col(key), F.col("sk").alias("parent_sk"), F.explode(rows).alias("r")).select(key, "parent_sk", "r.*")
        frame = cut(made.select(key, "level", "parent_sk", "ordinal", _key("parent_sk", F.col("level").cast("string"), F.col("ordinal").cast("string")).alias("sk"), "name", "value"))
        out.append(frame)
        depth = set(here)


def _key(*parts) -> Column:
    """Surrogate key: 128 bits of a hash of the parts, so that it is the same in every run."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def flatten_levels(docs: DataFrame, key: str, doc: str, schema=None) -> dict[tuple[str, ...], DataFrame]:
    """Child tables of the variant column ``doc``, one per array level.

    Each has ``key``, ``parent_sk``, ``ordinal`` (from 0), ``sk`` and ``value``
    (variant). A top-level array's parent is the document itself; the surrogate
    key is a hash of key, path and ordinals, so it is the same in every run.
    Null elements keep their place and give a row with null ``value``; absent,
    null or empty arrays give none; rows whose document is null give none.
    """
    levels = array_levels(schema or merged_schema(docs, doc))
    split = {p: sum(s == "[]" for s in p) for p in levels}
    frames = flatten(docs, key, doc, levels)
    return {p: frames[split[p]].filter(F.col("level") == k).select(key, "parent_sk", "ordinal", "sk", "value") for k, p in enumerate(levels)}


# ----------------------------------------------------------- hypergraph edges

# The parts of an edge that are tables of their own, and where members nest their id.
MEMBERS, TYPES, STATISTICS = ("members",), ("meta", "visual_types"), ("meta", "statistics")
MEMBER_IDS = ("$.block_id", "$.ref.block.id", "$.ref.block.block_id", "$.block.id", "$.block.block_id", "$.ref.id", "$.ref.block_id", "$.id", "$.member_id")


def _text(v: Column) -> Column:
    """The id in a member: a string, or the first string under the keys exporters nest it in."""
    plain = F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(None).cast("string")).otherwise(_get(v, "$", "string"))
    return F.coalesce(plain, *[_get(v, p, "string") for p in MEMBER_IDS])


def _whole(v: Column) -> Column:
    """3, "3", 3.0, true and "true" as a whole number."""
    text = F.lower(F.trim(_get(v, "$", "string")))
    return F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0)).otherwise(text.try_cast("double")).cast("bigint")


def edge_levels(schema) -> list[tuple[str, ...]]:
    """Array levels whose elements have an ``edge_id``, with the levels that lead to them."""
    every = array_levels(schema)

    def element(p):
        return _at(schema, (*p, "[]"))

    own = [p for p in every if element(p)[0] == "object" and "edge_id" in element(p)[1]]
    return [p for p in every if p in own or any(o[:len(p) + 1] == (*p, "[]") for o in own)]


def edge_tables(graphs: DataFrame, key: str = "document_id", edges: str = "hyperedges", raw: str = "raw_record") -> dict[str, DataFrame]:
    """Document hypergraphs, whichever exporter wrote them, as related flat tables:
    ``edges`` (document_id, sk, parent_sk, ordinal, edge_id, edge_type, meta), and below them
    ``members`` (parent_sk, ordinal, sk, block_id), ``visual_types`` (type, n) and
    ``statistics`` (name, value), which name their edge by ``parent_sk``.

    A nested edge's ``parent_sk`` is that of the edge around it, a top edge's that
    of its document. ``raw`` is read where ``edges`` is null; broken JSON gives no
    rows. Documents given twice count once.
    """
    content = F.when(F.col(edges).isNotNull(), F.to_json(F.struct(F.col(edges)))).otherwise(F.col(raw))
    src = (graphs.select(F.col(key).alias("document_id"), F.col(edges).alias("e"), F.col(raw).alias("r"), _key(F.coalesce(F.col(key), F.lit("")), content).alias("doc_sk")))
    doc = F.coalesce(F.to_variant_object(F.when(F.col("e").isNotNull(), F.struct(F.col("e").alias("hyperedges")))), F.try_parse_json("r")).alias("doc")
    schema = merged_schema(src.select(doc), "doc")
    once = src.groupBy("doc_sk").agg(*[F.first(c).alias(c) for c in ("document_id", "e", "r")])  # also spreads the documents over the tasks
    docs = once.select("document_id", doc, "doc_sk").filter(F.col("doc").isNotNull())
    top = edge_levels(schema)
    own = [p for p in top if _at(schema, (*p, "[]"))[0] == "object" and "edge_id" in _at(schema, (*p, "[]"))[1]]
    levels = [*top, *[(*p, "[]", *part) for p in own for part in (MEMBERS, TYPES, STATISTICS)]]
    frames = flatten(docs, "document_id", "doc", levels, frozenset(("visual_types", "statistics")), "doc_sk")
    kinds = {"edges": own, "members": [(*p, "[]", *MEMBERS) for p in own], "visual_types": [(*p, "[]", *TYPES) for p in own], "statistics": [(*p, "[]", *STATISTICS) for p in own]}
    if not frames:
        blank = docs.select("document_id", F.lit(0).alias("level"), F.lit("").alias("parent_sk"), F.lit(0).alias("ordinal"), F.lit("").alias("sk"),
                            F.lit("").alias("name"), F.col("doc").alias("value")).limit(0)
        frames = [blank]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    at = {k: every.filter(F.col("level").isin([levels.index(p) for p in paths])) for k, paths in kinds.items()}
    v = F.col("value")
    # Where edges nest in several arrays of one edge, these are counted on in the order of the schema.
    several = len({p[:max((i for i, s in enumerate(p) if s == "[]"), default=0)] for p in own}) < len(own)
    place = F.row_number().over(Window.partitionBy("parent_sk").orderBy("level", "ordinal")) - 1 if several else F.col("ordinal")
    return {
        "edges": at["edges"].select("document_id", "sk", "parent_sk", place.cast("bigint").alias("ordinal"), _get(v, "$.edge_id", "string").alias("edge_id"),
                                    _get(v, "$.edge_type", "string").alias("edge_type"), _walk(v, ["meta"]).alias("meta")),
        "members": at["members"].select("document_id", "parent_sk", "ordinal", "sk", _text(v).alias("block_id")),
        "visual_types": at["visual_types"].select("document_id", "parent_sk", "ordinal", "sk", F.coalesce("name", _get(v, "$.type", "string")).alias("type"),
                                                  _whole(F.when(F.col("name").isNull(), _get(v, "$.count", "variant")).otherwise(v)).alias("n")),
        "statistics": at["statistics"].select("document_id", "parent_sk", "ordinal", "sk", "name", _whole(v).alias("value")).filter("name is not null"),
    }


def edge_children(graphs: DataFrame, key: str = "document_id", edges: str = "hyperedges",
                  raw: str = "raw_record") -> DataFrame:
    """Members, visual types, statistics and nested edges of every edge, each linked to it.

    Returns distinct ``document_id, edge_id, child_kind, child_no, child_id``:
    the child tables of ``edge_tables``, joined with their edges by surrogate
    key. A null member keeps its place but gives no row; repeated members all
    count; null, absent or unreadable parts give no rows; edges without an id
    give none, their nested edges do. Documents given twice count once. Broken
    JSON gives no rows. Other columns of the input are not read, whatever their
    names. Edges of one document with the same id are kept apart by their keys
    until the end, where equal rows are one.
    """
    t = edge_tables(graphs, key, edges, raw)

    def child(kind, frame, no, cid):
        return frame.select("parent_sk", F.lit(kind).alias("child_kind"), F.col(no).cast("bigint").alias("child_no"), F.col(cid).alias("child_id"))

    rows = (child("member", t["members"], "ordinal", "block_id").unionByName(child("visual_type", t["visual_types"], "n", "type"))
            .unionByName(child("statistic", t["statistics"], "value", "name")).unionByName(child("child_edge", t["edges"], "ordinal", "edge_id")))
    parent = t["edges"].filter(F.col("edge_id").isNotNull()).select(F.col("sk").alias("parent_sk"), "document_id", "edge_id")
    return (rows.filter(F.col("child_id").isNotNull() & F.col("child_no").isNotNull()).join(parent, "parent_sk")
            .select("document_id", "edge_id", "child_kind", "child_no", "child_id").distinct())
