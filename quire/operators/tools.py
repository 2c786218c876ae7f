"""Retrieval tools over visual units: by number, page and section, enumeration and counting.

A unit is a contextual edge of a hypergraph with its anchor, caption and related
texts. Every tool answers all questions at once with equi-joins on document and
number, page, title or keyword; no question meets all units of its document,
but where a filter falls back to them by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import asks_count, asks_occurrences, asks_pages, is_visual, match_title
from quire.operators.graph import _anchor, members
from quire.schema import CAPTION_TYPES, RELATED_TYPES, TITLE_TYPES

# How questions and captions name units, and the nouns a spelling of a caption begins with.
NAMED = r"(figure|table|chart|map|graph)\s*([0-9]+)"
SPELLINGS = (("figure", r"f[il1!|][gq9]ure"), ("figure", r"f[il1!|][gq9]"), ("table", r"t[a@]ble"), ("table", r"t[a@]b"), ("chart", "chart"), ("map", r"m[a@]p"), ("graph", "graph"))
# What a number's characters may be read as, folded to digits.
READ, DIGITS = "li|!joqzs", "111110025"
FIRST_UNITS = 40  # units of a large document an enumeration looks at
VALUE_CUES = (r"^\s*calculate\b|\bsum\s+the\b|\bhow\s+much\b|\btotal\s+sum\b|\bcombined\s+(?:total|value|percentage|proportion|amount|cost|revenue|expenditure)\b|"
              r"\btotal\s+(?:expenditure|revenues?|compensation|depreciation|charge|profit|loss|costs?|salary|budget|income|receipts|assets|liabilities|equity|gains|savings|value|amount|"
              r"reportable|quantity|consumption|production|capacity|lengths?|audit\s+fees?|operating\s+revenue|area|score)\b|"
              r"\baverage\s+(?:\w+\s+)*(?:percentage|expenditure|cost|price|rate|salary|income|value|revenue|amount|pass|marks?|budget)|"
              r"\band\b.{1,80}\bcombined\b|\b(?:both\s+categories|from\s+both)\b|\bhow\s+many\b.{3,80}\band\b.{3,60}\b(?:in\s+total|altogether)\b|\btotal\s+number\s+of\b.{5,120}\band\b")
STRUCTURE_CUES = (r"\btotal\s+number\s+of\s+(?:tables?|figures?|images?|charts?|diagrams?|pages?|sections?|chapters?|items?|papers?|exhibits?|occurrences?|words?|footnotes?|samples?|instances?|"
                  r"data\s*points?|records?|features?|tokens?|sentences?|paragraphs?|questions?|answers?|references?|citations?|equations?|appendi(?:x|ces))\b|"
                  r"\bhow\s+many\s+(?:tables?|figures?|images?|charts?|diagrams?|pages?|sections?|chapters?|words?|footnotes?|references?|equations?)\b")


def units(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Contextual edges that have an anchor: ``doc_id, edge_id, seq, anchor_id, type, page, top, caption,
    text`` (caption and related texts, joined by blanks). One pass over the members."""
    e = edge_rows.filter("edge_type = 'contextual' and relation = 'contextual'").select("doc_id", "edge_id", "seq", "members").dropDuplicates(["doc_id", "edge_id"])
    j = members(e).join(node_rows.select("doc_id", "block_id", "type", "page", "text", F.try_element_at("bbox", F.lit(2)).alias("top")), ["doc_id", "block_id"])
    anchor = _anchor(F.col("type"), F.col("block_id"))
    named = F.contains(F.lower("type"), F.lit("caption")) | F.contains(F.lower("block_id"), F.lit("caption"))
    u = j.groupBy("doc_id", "edge_id").agg(
        F.min(F.when(anchor, F.struct("pos", "block_id", "type", "page", "top"))).alias("a"), F.min(F.when(~anchor & named, F.struct("pos", "block_id", "text"))).alias("c"),
        F.array_sort(F.collect_set(F.when(~anchor & F.col("type").isin(*RELATED_TYPES) & (F.trim("text") != ""), F.struct("pos", "block_id", "text")))).alias("r"))
    related = F.array_join(F.transform("r", lambda x: x["text"]), " ")
    return u.filter("a is not null").join(e.select("doc_id", "edge_id", "seq"), ["doc_id", "edge_id"]).select(
        "doc_id", "edge_id", "seq", F.col("a.block_id").alias("anchor_id"), F.lower("a.type").alias("type"), F.col("a.page").alias("page"), F.col("a.top").alias("top"),
        F.col("c.text").alias("caption"), F.concat_ws(" ", F.col("c.text"), F.nullif(related, F.lit(""))).alias("text"))


def asks(samples: DataFrame) -> DataFrame:
    """Constraints each question names: ``sample_idx, doc_id, question, ids (kind, id), type, pages, section, intent, level``."""
    q = F.lower(F.coalesce("question", F.lit("")))
    ids = F.arrays_zip(F.regexp_extract_all(q, F.lit(NAMED), F.lit(1)).alias("kind"), F.regexp_extract_all(q, F.lit(NAMED), F.lit(2)).alias("id"))
    pages = F.concat(F.regexp_extract_all(q, F.lit(r"page\s*([0-9]{1,6})"), F.lit(1)), F.array_compact(F.array(F.when(F.contains(q, F.lit("last page")), "LAST"), F.when(F.contains(q, F.lit("first page")), "FIRST"))))
    intent = F.when(q.rlike("^list"), "enumerate").when(asks_count(q) | asks_pages(q), "count").when(q.rlike("differ|change between|compare"), "compare").otherwise("locate")
    out = samples.select("sample_idx", "doc_id", "question", F.array_distinct(ids).alias("ids"), F.nullif(F.regexp_extract(q, "(figure|table|chart|map|diagram|graph)", 1), F.lit("")).alias("type"),
                         F.array_distinct(pages).alias("pages"), F.nullif(F.regexp_extract(q, r"section on ([\p{L}]+)", 1), F.lit("")).alias("section"), intent.alias("intent"))
    return out.withColumn("level", F.when(F.col("intent").isin("enumerate", "count") & (F.size("ids") == 0), "DOCUMENT").when(F.size("ids") > 1, "MULTI_UNIT").otherwise("UNIT"))


def explicit_multi_ids(q: Column) -> Column:
    """Whether a text names two units or more."""
    return F.size(F.regexp_extract_all(F.lower(F.coalesce(q, F.lit(""))), F.lit(NAMED), F.lit(0))) >= 2


def route(wanted: DataFrame, keywords: DataFrame) -> DataFrame:
    """Plan ``sample_idx, seq, tool`` by intent, evidence level and constraints; every tool is one of this module's
    or the keyword search, which comes where keywords are given or nothing else applies."""
    has_kw = keywords.select("sample_idx").distinct().withColumn("_kw", F.lit(True))
    w = wanted.join(has_kw, "sample_idx", "left").withColumn("_kw", F.coalesce("_kw", F.lit(False)))
    whole = F.col("level") == "DOCUMENT"
    by_id, by_page, by_section = F.size("ids") > 0, F.size("pages") > 0, F.col("section").isNotNull()
    search = F.when(F.col("_kw") | ~(by_id | by_page | by_section), F.lit("keyword_search"))
    tools = (F.when(whole & (F.col("intent") == "count"), F.array(F.lit("global_count")))
             .when(whole & (F.col("intent") == "enumerate"), F.array_compact(F.array(F.lit("enumerate"), F.when(F.col("_kw"), F.lit("keyword_search")))))
             .otherwise(F.array_compact(F.array(F.when(by_id, F.lit("find_by_id")), F.when(by_page, F.lit("find_by_page")), F.when(by_section, F.lit("find_by_section")), search))))
    return w.select("sample_idx", F.posexplode(tools).alias("seq", "tool"))


def caption_numbers(unit_rows: DataFrame) -> DataFrame:
    """``doc_id, edge_id, noun, id``: numbers a caption may be read to name, characters that recognition
    confuses with digits read as such; a number ends before any character but a digit."""
    low = F.lower(F.coalesce("caption", F.lit("")))

    def named(noun):
        return lambda t: F.struct(F.lit(noun).alias("noun"), t.alias("token"))

    tokens = F.concat(*[F.transform(F.regexp_extract_all(low, F.lit(rf"{p}[^0-9a-zA-Z]*([0-9{READ}]+[0-9a-z]?)"), F.lit(1)), named(noun)) for noun, p in SPELLINGS])
    u = unit_rows.select("doc_id", "edge_id", F.explode(F.array_distinct(tokens)).alias("t")).select("doc_id", "edge_id", "t.noun", "t.token")
    read = F.regexp_extract("token", rf"^([0-9{READ}]+)", 1)
    ends = F.filter(F.sequence(F.lit(1), F.length(read)), lambda k: (k == F.length("token")) | ~F.col("token").substr(k + 1, F.lit(1)).rlike("[0-9]"))
    return u.select("doc_id", "edge_id", "noun", F.explode(F.transform(ends, lambda k: F.translate(read.substr(F.lit(1), k), READ, DIGITS))).alias("id")).distinct()


def typed_or_all(asked: DataFrame, unit_rows: DataFrame) -> DataFrame:
    """``asked`` (doc_id, kind) with ``any_type``: whether its document has no unit of the kind, so that any will do."""
    have = unit_rows.select("doc_id", F.col("type").alias("kind")).distinct().withColumn("_has", F.lit(True))
    return asked.join(have, ["doc_id", "kind"], "left").withColumn("any_type", F.col("_has").isNull()).drop("_has")


def find_by_id(unit_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sample_idx, kind, id, edge_id, score``: units whose caption names an asked number (score 1), else the
    unit that stands where the number is missing in the sequence of its kind (0.75, or 0.65 where its
    place is estimated). Only units of the kind are taken if the document has any. Several numbers
    of a question are all looked for; questions without numbers give no row."""
    a = wanted.select("sample_idx", "doc_id", F.explode("ids").alias("x")).select("sample_idx", "doc_id", "x.kind", "x.id").distinct()
    a = typed_or_all(a, unit_rows)
    named = caption_numbers(unit_rows).join(unit_rows.select("doc_id", "edge_id", "type"), ["doc_id", "edge_id"])
    hit = a.join(named, (a.doc_id == named.doc_id) & (a.id == named.id) & (a.kind == named.noun)).filter((named.type == a.kind) | a.any_type)
    hit = hit.select("sample_idx", a.kind, a.id, "edge_id", F.lit(1.0).alias("score")).distinct()
    missing = a.join(hit.select("sample_idx", "kind", "id").distinct(), ["sample_idx", "kind", "id"], "left_anti")
    return hit.unionByName(infer_by_sequence(unit_rows, missing))


def infer_by_sequence(unit_rows: DataFrame, missing: DataFrame) -> DataFrame:
    """Units at the places of missing numbers: between two neighbouring numbered figures with smaller and
    greater number, the one unit between them, or of several the one at the number's share of the way.
    ``missing``: sample_idx, doc_id, kind, id."""
    order = Window.partitionBy("doc_id", "type").orderBy("page", F.coalesce("top", F.lit(0.0)), "seq", "edge_id")
    number = F.regexp_extract(F.lower(F.coalesce("caption", F.lit(""))), r"(?:figure|fig)\s*([0-9]{1,9})", 1).try_cast("int")
    u = unit_rows.withColumn("place", F.row_number().over(order)).withColumn("number", number)
    numbered = u.filter("number is not null")
    after = Window.partitionBy("doc_id", "type").orderBy("place")
    pairs = numbered.select("doc_id", F.col("type").alias("kind"), "place", "number", F.lead("place").over(after).alias("next_place"), F.lead("number").over(after).alias("next_number"))
    pairs = pairs.filter((F.col("next_number") > F.col("number") + 1) & (F.col("next_place") > F.col("place") + 1))
    ids = missing.select("doc_id", "kind", F.col("id").try_cast("int").alias("n")).filter("n is not null").distinct()
    greatest = ids.groupBy("doc_id", "kind").agg(F.max("n").alias("most"))
    # Every missing number up to the greatest asked for, so that numbers are met by equality.
    gaps = pairs.join(greatest, ["doc_id", "kind"]).filter(F.col("most") > F.col("number")).withColumn(
        "n", F.explode(F.sequence(F.col("number") + 1, F.least(F.col("next_number") - 1, F.col("most")))))
    first = gaps.groupBy("doc_id", "kind", "n").agg(F.min(F.struct("place", "number", "next_place", "next_number")).alias("g")).select("doc_id", "kind", "n", "g.*")
    one = F.col("next_place") - F.col("place") == 2
    share = (F.col("n") - F.col("number")) / (F.col("next_number") - F.col("number"))
    at = F.when(one, F.col("place") + 1).otherwise(F.col("place") + F.floor(share * (F.col("next_place") - F.col("place"))))
    spot = first.withColumn("at", at.cast("int")).filter((F.col("at") > F.col("place")) & (F.col("at") < F.col("next_place"))).select("doc_id", "kind", "n", "at", F.when(one, 0.75).otherwise(0.65).alias("score"))
    found = spot.join(u.select("doc_id", F.col("type").alias("kind"), F.col("place").alias("at"), "edge_id"), ["doc_id", "kind", "at"])
    m = missing.withColumn("n", F.col("id").try_cast("int"))
    return m.join(found, ["doc_id", "kind", "n"]).select("sample_idx", "kind", "id", "edge_id", "score")


def find_by_page(unit_rows: DataFrame, wanted: DataFrame, totals: DataFrame) -> DataFrame:
    """``sample_idx, edge_id, page, score``: units on the asked pages. Without a page mapping the printed page p
    is looked for on the physical pages p-1 and p; LAST and FIRST are the document's last and first
    page (``totals``: doc_id, total_pages; without a total LAST finds nothing). Units of the asked type
    score 0.95; where there are none, units of any type 0.75."""
    w = wanted.select("sample_idx", "doc_id", "type", F.explode("pages").alias("p")).join(totals.select("doc_id", "total_pages").groupBy("doc_id").agg(F.max("total_pages").alias("total_pages")), "doc_id", "left")
    n = F.col("p").try_cast("int")
    pages = F.when(F.col("p") == "LAST", F.array(F.col("total_pages") - 1)).when(F.col("p") == "FIRST", F.array(F.lit(0))).otherwise(F.array(n - 1, n))
    w = w.select("sample_idx", "doc_id", F.col("type").alias("asked"), F.explode(F.filter(pages, lambda x: x >= 0)).alias("page")).distinct()
    j = w.join(unit_rows.select("doc_id", "page", "edge_id", "type"), ["doc_id", "page"])
    exact = F.col("asked").isNull() | (F.col("asked") == F.col("type"))
    j = j.withColumn("_any", F.max(exact).over(Window.partitionBy("sample_idx")))
    return j.filter(exact | ~F.col("_any")).select("sample_idx", "edge_id", "page", F.when(exact, 0.95).otherwise(0.75).alias("score"))


def section_units(edge_rows: DataFrame, node_rows: DataFrame, unit_rows: DataFrame) -> DataFrame:
    """``doc_id, title, edge_id, type``: units below section titles. A section edge's last title and last
    visual member count; a visual without a contextual edge is a unit of its own."""
    sections = edge_rows.filter(F.col("edge_type") == "containment").filter(F.col("relation").isin("containment", "section_contains_visual", "section_contains_visuals"))
    j = members(sections.select("doc_id", "edge_id", "members").dropDuplicates(["doc_id", "edge_id"])).join(node_rows.select("doc_id", "block_id", "type", "text"), ["doc_id", "block_id"])
    s = j.groupBy("doc_id", "edge_id").agg(F.max(F.when(F.col("type").isin(*TITLE_TYPES), F.struct("pos", "block_id", "text"))).alias("t"), F.max(F.when(is_visual(F.col("type")), F.struct("pos", "block_id", "type"))).alias("v"))
    s = s.filter("t is not null and v is not null").select("doc_id", F.col("t.text").alias("title"), F.col("v.block_id").alias("block_id"), F.lower("v.type").alias("kind")).distinct()
    context = edge_rows.filter("edge_type = 'contextual' and relation = 'contextual'").select("doc_id", "edge_id", "seq", "members").dropDuplicates(["doc_id", "edge_id"])
    first = members(context).join(context.select("doc_id", "edge_id", "seq"), ["doc_id", "edge_id"]).groupBy("doc_id", "block_id").agg(F.min_by("edge_id", F.struct("seq", "edge_id")).alias("edge_id"))
    out = s.join(first, ["doc_id", "block_id"], "left").join(unit_rows.select("doc_id", "edge_id", F.col("type").alias("unit_type")), ["doc_id", "edge_id"], "left")
    return out.filter("edge_id is null or unit_type is not null").select("doc_id", "title", F.coalesce("edge_id", F.concat("block_id", F.lit("_section_synthetic"))).alias("edge_id"), F.coalesce("unit_type", "kind").alias("type")).distinct()


def find_by_section(sections: DataFrame, unit_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sample_idx, edge_id, score, fell_back``: units below a title that holds the asked one or is like it; all
    units of the document where no title matches. Then units of the asked type, if there are any.
    Distinct titles meet distinct wishes of their document, not rows each other."""
    w = wanted.filter("section is not null").select("sample_idx", "doc_id", "section", "type")
    titles = sections.select("doc_id", "title").filter("title is not null").distinct()
    pairs = w.select("doc_id", "section").distinct().join(titles, "doc_id").filter(match_title(F.col("title"), F.col("section"))).select("doc_id", "section", "title")
    below = pairs.join(sections, ["doc_id", "title"]).select("doc_id", "section", "edge_id", F.col("type").alias("kind"), F.lit(False).alias("fell_back")).distinct()
    none = w.select("doc_id", "section").distinct().join(below.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
    rest = none.join(unit_rows.select("doc_id", "edge_id", F.col("type").alias("kind")), "doc_id").withColumn("fell_back", F.lit(True))
    j = w.join(below.unionByName(rest.select(*below.columns)), ["doc_id", "section"])
    fits = F.coalesce(F.col("kind") == F.col("type"), F.lit(False))
    j = j.withColumn("_any", F.max(fits).over(Window.partitionBy("sample_idx")))
    return j.filter(fits | ~F.col("_any")).select("sample_idx", "edge_id", F.lit(0.9).alias("score"), "fell_back")


def candidates(unit_rows: DataFrame, wanted: DataFrame, keywords: DataFrame, found: DataFrame, most: int = FIRST_UNITS) -> DataFrame:
    """Units an enumeration or count of a document looks at: all of a document of at most ``most``
    units; of a larger one the first ``most`` that hold a keyword, or its first where a question has
    none; then those of the asked type, if any. The limit is part of the rule.
    ``found``: doc_id, keyword, edge_id, as ``retrieval.matches`` gives them."""
    u = unit_rows.withColumn("_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "edge_id"))).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id")))
    kw = keywords.select("sample_idx", "doc_id", "keyword")
    w = wanted.select("sample_idx", "doc_id", "type").join(kw.groupBy("sample_idx").agg(F.count("*").alias("asked")), "sample_idx", "left").na.fill(0, ["asked"])
    hits = w.select("sample_idx").join(kw, "sample_idx").join(found, ["doc_id", "keyword"]).groupBy("sample_idx", "edge_id").agg(F.count("*").alias("held"))
    cols = ["doc_id", "edge_id", F.col("type").alias("kind"), "page", "caption", "text", "seq", "_no", "_n"]
    early = w.join(u.filter(F.col("_no") <= most).select(*cols), "doc_id").filter((F.col("_n") <= most) | (F.col("asked") == 0)).join(hits, ["sample_idx", "edge_id"], "left")
    late = hits.join(w, "sample_idx").filter("asked > 0").join(u.filter(F.col("_n") > most).select(*cols), ["doc_id", "edge_id"])
    late = late.withColumn("_r", F.row_number().over(Window.partitionBy("sample_idx").orderBy("_no"))).filter(F.col("_r") <= most)
    c = early.select(*late.columns[:-1]).unionByName(late.drop("_r")).na.fill(0, ["held"])
    fits = F.coalesce(F.col("kind") == F.col("type"), F.lit(False))
    return c.withColumn("_any", F.max(fits).over(Window.partitionBy("sample_idx"))).filter(fits | ~F.col("_any")).drop("_any", "_no", "_n")


def enumerate_items(cands: DataFrame) -> DataFrame:
    """``sample_idx, item_no, item, edge_id, type, page``: candidates that hold all keywords of their question, in
    document order, named by their caption's number, else by their place; pages from 1."""
    held = cands.filter(F.col("held") >= F.col("asked"))
    no = F.row_number().over(Window.partitionBy("sample_idx").orderBy("seq", "edge_id"))
    name = r"(figure|table|chart)\s*([0-9]+)"
    low = F.lower(F.coalesce("caption", F.lit("")))
    item = F.when(low.rlike(name), F.concat(F.initcap(F.regexp_extract(low, name, 1)), F.lit(" "), F.regexp_extract(low, name, 2)))
    return held.select("sample_idx", no.alias("item_no"), item.alias("item"), "edge_id", F.col("kind").alias("type"), (F.col("page") + 1).alias("page")).withColumn(
        "item", F.coalesce("item", F.concat(F.lit("Item "), F.col("item_no").cast("string"))))


def global_count(wanted: DataFrame, cands: DataFrame, occurrences: DataFrame, totals: DataFrame) -> DataFrame:
    """``sample_idx, path, n`` of each counting question: the document's pages, how often its keywords stand in
    its texts, nothing where a value is asked for rather than a count, else the candidates that hold
    all its keywords; nothing (``none``) where there are no candidates.
    ``occurrences``: sample_idx, times; ``totals``: doc_id, total_pages."""
    q = F.lower(F.coalesce("question", F.lit("")))
    value = q.rlike(VALUE_CUES) & ~q.rlike(STRUCTURE_CUES)
    plain = F.col("type").isNull()
    path = F.when(asks_pages(q) & plain & (F.size("pages") == 0), "pages").when(asks_occurrences(q) & plain & (F.size("pages") == 0), "occurrences").when(value, "value").otherwise("units")
    n = cands.groupBy("sample_idx").agg(F.count("*").alias("candidates"), F.count_if(F.col("held") >= F.col("asked")).alias("held"))
    times = occurrences.groupBy("sample_idx").agg(F.sum("times").alias("times"))
    pages = totals.groupBy("doc_id").agg(F.max("total_pages").cast("bigint").alias("total_pages"))
    w = wanted.withColumn("path", path).join(n, "sample_idx", "left").join(times, "sample_idx", "left").join(pages, "doc_id", "left")
    count = (F.when(F.col("path") == "pages", F.col("total_pages")).when(F.col("path") == "occurrences", F.coalesce("times", F.lit(0)))
             .when((F.col("path") == "units") & F.col("candidates").isNotNull(), F.col("held")))
    return w.select("sample_idx", F.when((F.col("path") == "units") & F.col("candidates").isNull(), "none").otherwise(F.col("path")).alias("path"), count.alias("n"))


def entity_key(reason: Column, page: Column) -> Column:
    """Group of a candidate: the number its match names, else its page."""
    number = F.nullif(F.regexp_extract(F.coalesce(reason, F.lit("")), r"Matched ID\s+(\S+)\s+in", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("entity_"), number), F.concat(F.lit("page_"), page.cast("string")))


def unit_text(unit_rows: DataFrame, node_rows: DataFrame, edge_rows: DataFrame, caption: bool = True, title: bool = True, related: bool = True) -> DataFrame:
    """``doc_id, edge_id, text`` of the chosen parts of each unit: caption, titles, other related texts, in that order."""
    e = edge_rows.filter("edge_type = 'contextual' and relation = 'contextual'").select("doc_id", "edge_id", "members").dropDuplicates(["doc_id", "edge_id"])
    j = members(e).join(node_rows.select("doc_id", "block_id", "type", "text"), ["doc_id", "block_id"]).filter(~_anchor(F.col("type"), F.col("block_id")) & (F.trim("text") != ""))
    part = F.when(F.col("type").isin(*CAPTION_TYPES), 0).when(F.col("type").isin(*TITLE_TYPES), 1).otherwise(2)
    j = j.withColumn("part", part).filter(F.col("part").isin([k for k, on in enumerate((caption, title, related)) if on]))
    t = j.groupBy("doc_id", "edge_id").agg(F.array_sort(F.collect_set(F.struct("part", "pos", "block_id", "text"))).alias("t"))
    return unit_rows.select("doc_id", "edge_id").join(t, ["doc_id", "edge_id"], "left").select("doc_id", "edge_id", F.array_join(F.transform(F.coalesce("t", F.array().cast(t.schema["t"].dataType)), lambda x: x["text"]), " ").alias("text"))


