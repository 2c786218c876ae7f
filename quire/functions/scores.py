"""Rule-based answer scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import normalize_answer

# Suffixes taken off an answer, each once and in this order.
UNITS = ("kg", "mm", "meters", "acres", "minutes", "miles", "mile", "million", "thousand", "billion", "m")
# Forms of answers that only count when equal.
EXACT = (r"^[0-9]+(-[0-9]+|\s[0-9]+)?$", r"^[0-9]{4}[-\s][0-9]{2}[-\s][0-9]{2}$", r"^[0-9]{4}[-\s][0-9]{2}$", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
         r"https://", r"\.py$", r"ipynb$", r"^page", r"a\.m\.", r"p\.m\.")
# What is taken off one suffix after the other is the longest tail of them in reverse order.
UNIT_TAIL = "".join(rf"(?:\s*{u})?" for u in reversed(UNITS)) + r"\s*$"
_OTHER = r"[^\p{L}\p{N}_]"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def smart_match(gold: Column, prediction: Column) -> Column:
    """Gold answers of at most two words and under 15 characters must stand in the prediction
    between word boundaries, longer ones anywhere; both in normal form. Null gives false."""
    g, p = normalize_answer(gold), normalize_answer(prediction)
    short = (F.size(F.split(g, " ")) <= 2) & (F.length(g) < 15)
    spaced = F.concat(F.lit(" "), F.regexp_replace(p, _OTHER, " "), F.lit(" "))
    bounded = F.contains(p, g) & F.contains(spaced, F.concat(F.lit(" "), F.regexp_replace(g, _OTHER, " "), F.lit(" ")))
    return F.coalesce(F.when(g == "", p != "").when(short, bounded).otherwise(F.contains(p, g)), F.lit(False))


def anls(a: Column, b: Column, least: float = 0.5) -> Column:
    """Edit similarity; 0 at or below ``least``; 1 for two empty texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    s = F.lit(1.0) - F.levenshtein(a, b) / longest
    return F.when(longest == 0, 1.0).when(s <= least, 0.0).otherwise(s)


def clean_answer(t: Column) -> Column:
    """Lower case, commas off, units off in order, parentheses, an outer quote at each end, then
    dollar and pound signs in front and percent signs behind. Null gives null."""
    t = F.replace(strip(F.lower(t)), F.lit(","), F.lit(""))
    t = F.regexp_replace(t, UNIT_TAIL, "")
    t = strip(F.regexp_replace(t, r"\s*\([^)]*\)", ""))
    t = strip(F.regexp_replace(t, "^['\"]|['\"]$", ""))
    return strip(F.regexp_replace(F.regexp_replace(t, r"^\$*£*", ""), r"%+$", ""))


def needs_exact(t: Column) -> Column:
    """Answers that only count when equal: links, files, pages, whole numbers, times, dates, mail addresses."""
    return F.coalesce(t.rlike("|".join(EXACT)), F.lit(False))


def is_number(t: Column) -> Column:
    return F.coalesce(strip(t).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.lit(False))


def _number(t: Column) -> Column:
    n = strip(F.regexp_replace(strip(t), r"%+$", ""))
    return F.when(is_number(n), n.try_cast("double"))


def _places(x: Column) -> Column:
    """Decimal places of a number, at most ten."""
    return F.length(F.regexp_extract(x.try_cast("decimal(38,10)").cast("string"), r"\.([0-9]*?)0*$", 1))


def float_equal(gold: Column, pred: Column) -> Column:
    """Numbers equal within 1 %, or when rounded to the places both have (two at least), with gold
    as it is, as a fraction and as a percentage. False where either is no number."""
    g, p = _number(gold), _number(pred)

    def near(r):
        scale = F.pow(F.lit(10.0), F.greatest(F.least(_places(p), _places(r)), F.lit(2)))
        return (F.abs(r - p) <= 0.01 * F.greatest(F.abs(r), F.abs(p))) | (F.rint(p * scale) == F.rint(r * scale))

    return F.coalesce(near(g / 100) | near(g) | near(g * 100), F.lit(False))


_ITEM = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[+-]?[0-9][0-9.eE+-]*|None|True|False"


def listed(t: Column) -> Column:
    """Items of a list literal of quoted texts and numbers; any other text is a list of one."""
    t = strip(t)
    items = F.transform(F.regexp_extract_all(t, F.lit(_ITEM), F.lit(0)), lambda x: F.when(
        x.rlike("^['\"]"), F.regexp_replace(F.regexp_replace(x, "(?s)^.|.$", ""), r"\\(.)", "$1")).otherwise(x))
    return F.when(t.rlike(rf"(?s)^\[\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*,?\s*)?\]$"), items).otherwise(F.array(t))


def typed_score(gold: Column, pred: Column, kind: Column) -> Column:
    """Score by answer format: whole numbers equal, floats near, texts by edit similarity, anything
    else as lists, by the mean best similarity of the gold items with a penalty for surplus items;
    lists that begin with a number or an exact form must be equal in order. Nulls are empty texts."""
    gold, pred = F.coalesce(gold, F.lit("")), F.coalesce(pred, F.lit(""))
    g, p = clean_answer(gold), clean_answer(pred)

    def whole(t):
        return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("decimal(38,0)"))

    integer = F.when(whole(g).isNotNull(), F.coalesce(whole(g) == whole(p), F.lit(False))).otherwise(whole(p).isNull() & (g == "")).cast("double")
    real = float_equal(g, p).cast("double")
    text = F.when(needs_exact(g), (g == p).cast("double")).otherwise(anls(g, p))

    def cleaned(items):  # array_sort-free: the order counts
        return F.transform(items, clean_answer)

    pairs = F.struct(cleaned(listed(gold)).alias("g"), cleaned(listed(pred)).alias("p"))
    # Both lists are built once: the one element of an array that ``transform`` walks over.
    def score(x):
        gs, ps = x["g"], x["p"]
        first = F.coalesce(F.try_element_at(gs, F.lit(1)), F.lit(""))
        best = F.aggregate(gs, F.lit(0.0), lambda s, a: s + F.coalesce(F.array_max(F.transform(ps, lambda b: anls(a, b))), F.lit(0.0)))
        return F.when(F.size(ps) == 0, 0.0).when(F.size(gs) == 0, 0.0).when(
            is_number(first) | needs_exact(first), (F.array_join(gs, "-") == F.array_join(ps, "-")).cast("double")).otherwise(
            best / F.size(gs) * F.sqrt(F.least(F.lit(1.0), F.size(gs) / F.size(ps))))

    many = F.element_at(F.transform(F.array(pairs), score), 1)
    k = F.lower(F.coalesce(kind, F.lit("none")))
    return F.when(k.isin("int", "integer"), integer).when(k == "float", real).when(k.isin("str", "string", "none"), text).otherwise(many)
