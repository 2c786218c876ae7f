"""JSON in model output: tolerant parsing, recovery, intents, page lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import INTENT


def json_object(t: Column) -> Column:
    """The JSON object of a model answer as text: the whole, else a fenced block, else the outermost braces; else null."""
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), F.trim(c)) for c in (t, fenced, braces)])


def recovered_matches(t: Column) -> Column:
    """``(image_index, match)`` pairs from JSON too broken to parse; indexes from 0."""
    pattern = r"(?is)\"image_index\"\s*:\s*(\d+)[^{}]*?\"match(?:es)?\"\s*:\s*(true|false)"
    a = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    b = F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(a.alias("i"), b.alias("m")), lambda x: F.struct((x["i"].cast("int") - 1).alias("image_index"), (F.lower(x["m"]) == "true").alias("match")))


def intent(t: Column) -> Column:
    """Intent of an answer in JSON; what cannot be read is a plain ``locate``."""
    parsed = F.from_json(json_object(t), INTENT)
    ok = F.coalesce(parsed["intent_type"].isin("locate", "count", "enumerate", "compare", "cross_reasoning"), F.lit(False))
    empty = F.from_json(F.lit('{"intent_type":"locate","target":null}'), INTENT)
    return F.struct(F.when(ok, parsed).otherwise(empty).alias("intent"), F.when(ok, "ok").otherwise("failed").alias("status"))


def page_list(t: Column) -> Column:
    """Page numbers above 0 of a list, a number or a text holding either; else an empty list."""
    many = F.from_json(t, "array<int>")
    one = F.when(F.trim(t).rlike(r"^[0-9]+$"), F.array(F.trim(t).try_cast("int")))
    return F.filter(F.coalesce(F.when(F.trim(t).startswith("["), many), one, F.array().cast("array<int>")), lambda p: p > 0)


def page_probe(t: Column) -> Column:
    """Layout (``single`` where not named) and printed page numbers of a page probe's reply: what stands between its
    outermost braces, numbers only; nulls where that cannot be read."""
    body = F.regexp_replace(F.regexp_extract(t, r"(?s)(\{.*\})", 1), r"[\r\n]", " ")
    r = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "layout string, found_pages array<string>")
    return F.struct(F.when(r.isNotNull(), F.coalesce(r["layout"], F.lit("single"))).alias("layout"), F.filter(F.when(r.isNotNull(), r["found_pages"]), lambda p: p.rlike("^[0-9]+$")).alias("found_pages"))


def page_constraint(pages: Column) -> Column:
    """Positive numbers sorted, then LAST and FIRST sorted, each once."""
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform(pages, lambda p: p.try_cast("int")), lambda p: p > 0)))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(pages, F.upper), lambda p: p.isin("LAST", "FIRST"))))
    return F.concat(F.transform(numbers, lambda n: n.cast("string")), names)


def physical_pages(pages: Column, total: Column) -> Column:
    """0-based physical pages of a constraint; LAST is the last page (page 998 where unknown)."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(pages, lambda p: F.when(F.upper(p) == "LAST", F.coalesce(total, F.lit(999)) - 1)
                                                               .when(F.upper(p) == "FIRST", F.lit(0)).otherwise(p.try_cast("int") - 1)), lambda x: x >= 0)))


def first_of(t: Column, *paths: str) -> Column:
    """First value found under any of the paths."""
    return F.coalesce(*[F.get_json_object(t, p) for p in paths])


def payload_key(*cols: Column) -> Column:
    """Short key of a record: the start of the hash of its JSON."""
    return F.substring(F.sha1(F.to_json(F.struct(*cols))), 1, 16)
