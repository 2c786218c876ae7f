"""Several values packed in one field: choose a dialect per field by minimum description length.

Every distinct field text is parsed under all delimiter-and-quote dialects that
apply to it. A parse costs its dialect plus the code lengths of its items, where
an item's code length follows from how often the item occurs over all distinct
texts and from spelling it out once in the dictionary. The cheapest parse wins;
lengths are re-estimated from the winners once and the choice is repeated.
All parsing is done by built-in expressions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import join_lookup
from quire.session import cut

# Dialect, pattern that shows it may apply, characters that end an
# item, word that ends an item, number of delimiters it allows (its choice costs bits).
DIALECTS = [
    ("whole", r"", "", "", 0),
    ("comma", r",", r",", "", 1),
    ("semicolon", r";", r";", "", 1),
    ("pipe", r"\|", r"|", "", 1),
    ("slash", r"/", r"/", "", 1),
    ("tab", r"\t", r"\t", "", 1),
    ("line", r"\n", r"\r\n", "", 1),
    ("ampersand", r"&", r"&", "", 1),
    ("and", r"\s(?:and|AND|And)\s", "", r"\s(?:and|AND|And)\s", 1),
    ("blank", r"\S\s+\S", r"\s", "", 1),
    ("mixed", r"[,;|\t\n&]|\sand\s", r",;|\t\r\n&", r"\s(?:and|AND|And)\s", 7),
    ("mixed_slash", r"/", r",;|\t\r\n&/", r"\s(?:and|AND|And)\s", 8),
]
BLANKS = " \t\r\n\x0b\f"
QUOTED = r""""(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.|'')*'"""


def _body(raw: Column) -> Column:
    """Text without outer blanks and one pair of list brackets around the whole."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    wrapped = t.rlike(r"^(?s)(?:\[.*\]|\{.*\}|\([^()]*\))$")
    return F.when(wrapped, F.regexp_replace(F.expr("substring(_t, 2, length(_t) - 2)"), r"^\s+|\s+$", "")).otherwise(t)


def _items(body: Column, ends: str, word: str, quoted: bool) -> Column:
    run = (rf"(?!{word})" if word else "") + (rf"[^{ends}]" if ends else r"[\s\S]")
    pattern = rf"(?:{run})+"
    if quoted:
        pattern = rf"(?:[ \t\r\n]*(?:{QUOTED})[ \t]*)|{pattern}"
    parts = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    trimmed = F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS)))
    if word:  # what follows a delimiter word still starts with it
        trimmed = F.transform(trimmed, lambda x: F.regexp_replace(x, r"^(?:and|AND|And)(?:\s+|$)", ""))
    return F.filter(trimmed, lambda x: F.length(x) > 0)


def _plain(item: Column) -> Column:
    """Item without its enclosing quotes; doubled and escaped quotes stand for one."""
    inner = F.regexp_replace(item, r"^(?s).|.$", "")
    double = F.regexp_replace(F.regexp_replace(inner, r'""', '"'), r"\\(.)", "$1")
    single = F.regexp_replace(F.regexp_replace(inner, r"''", "'"), r"\\(.)", "$1")
    full = rf"^(?:{QUOTED})$"
    text = (F.when(item.rlike(full) & item.startswith('"'), double)
            .when(item.rlike(full) & item.startswith("'"), single).otherwise(item))
    return F.btrim(text, F.lit(BLANKS))


def _spelling(item: Column) -> Column:
    """Bits to spell an item out once: digits, letters, and dear other characters."""
    n = F.length(item)
    digits = F.length(F.regexp_replace(item, r"[^0-9]", ""))
    letters = F.length(F.regexp_replace(item, r"[^\p{L}]", ""))
    return digits * 3.3 + letters * 4.7 + (n - digits - letters) * 10.0 + 2.0


def split_packed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per packed value: ``key, field_name, item_no, item_text``.

    Null, blank and empty-list fields give no row; empty items give none and
    take no number; repeated values all count; rows repeated as a whole count
    once; rows with a null key are kept under the null key. Other columns of
    ``df`` are not read. Texts of any length are parsed whole.
    """
    long = df.select(F.col(key), *[F.col(f) for f in fields]).distinct().select(
        F.col(key).alias("_key"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields])).alias("_f"),
    ).select("_key", "_f.field_name", "_f.raw").filter(F.col("raw").rlike(r"\S"))

    texts = (cut(long.groupBy("field_name", "raw").agg(F.count("*").alias("n")))
             .withColumn("_t", F.regexp_replace("raw", r"^\s+|\s+$", ""))
             .withColumn("body", _body(F.col("_t"))))
    has_quote = F.col("body").rlike("[\"']")
    parses = []
    for k, (name, applies, ends, word, choices) in enumerate(DIALECTS):
        for q in (True, False):
            ok = (F.col("body").rlike(applies) if applies else F.lit(True)) & (F.lit(q) | has_quote)
            bare = _items(F.col("body"), ends, word, False)
            # Texts without quotes are parsed the plain way, which costs a quarter.
            plain = F.when(has_quote, F.transform(_items(F.col("body"), ends, word, True), _plain)).otherwise(bare) if q else bare
            parses.append(F.when(ok, F.struct(F.lit(2 * k + (not q)).alias("dialect"), F.lit(choices).alias("choices"),
                                              plain.alias("items"))))
    cand = texts.select("field_name", "raw", "n", F.array_compact(F.array(*parses)).alias("p"))
    # Equal parses of different dialects are one candidate: the first, which is the cheapest, stands for them.
    items = F.transform("p", lambda x: x["items"])
    cand = cand.withColumn("_i", items).withColumn("p", F.filter("p", lambda x, k: F.array_position("_i", x["items"]) == k + 1))
    # An outer explode (there always is a parse): a plain one would leave its filter, which is
    # all the parsing, as a constraint that is then checked on every row joined by ``raw``.
    cand = cut(cand.select("field_name", "raw", "n", F.size("p").alias("n_parses"), F.explode_outer("p").alias("p"))
               .select("field_name", "raw", "n", "n_parses", "p.*"))
    best = _choose(cand, None)
    best = _choose(cand, best)
    best = cut(best)
    total = best.agg(F.sum("n").alias("_all"))
    look = best.crossJoin(F.broadcast(total))  # one row: a scalar
    rows = join_lookup(long, look, ["field_name", "raw"], F.col("n"), F.col("_all"))
    return rows.select(F.col("_key").alias(key), "field_name", F.posexplode("items").alias("item_no", "item_text"))


def _choose(cand: DataFrame, won: DataFrame | None) -> DataFrame:
    """The cheapest parse of every text under code lengths from all parses, or from the winners."""
    base = cand.withColumn("w", 1.0 / F.col("n_parses")) if won is None else won.withColumn("w", F.lit(1.0))
    counts = (base.select("field_name", "w", F.explode(F.array_distinct("items")).alias("item"))
              .groupBy("field_name", "item").agg(F.sum("w").alias("c")))
    totals = counts.groupBy("field_name").agg(F.sum("c").alias("t"))
    occ = cand.select("field_name", "raw", "dialect", F.explode("items").alias("item"))
    weights = occ.groupBy("field_name", "item").agg(F.count("*").alias("uses"))
    codes = (weights.join(counts, ["field_name", "item"], "left").join(F.broadcast(totals), "field_name")
             .withColumn("c", F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.5)))
             .withColumn("bits", -F.log2(F.col("c") / F.col("t")) + _spelling(F.col("item")) / F.col("c"))
             .select("field_name", "item", "uses", "bits"))
    n_uses = weights.agg(F.sum("uses").alias("_all"))
    codes = cut(codes.crossJoin(F.broadcast(n_uses)))  # one row: a scalar
    priced = join_lookup(occ, codes, ["field_name", "item"], F.col("uses"), F.col("_all")).drop("_all")
    cost = priced.groupBy("field_name", "raw", "dialect").agg(F.sum("bits").alias("item_bits"), F.count("*").alias("k"))
    full = cand.join(cost, ["field_name", "raw", "dialect"], "left")
    price = (F.coalesce("item_bits", F.lit(0.0))
             + F.coalesce("k", F.lit(1)) * F.log2(F.greatest(F.col("choices"), F.lit(1)).cast("double"))
             + F.when(F.col("choices") > 0, 1.0).otherwise(0.0))
    return (full.withColumn("price", F.round(price, 6))
            .groupBy("field_name", "raw")
            .agg(F.first("n").alias("n"), F.min_by("items", F.struct("price", "dialect")).alias("items"))
            .withColumn("w", F.lit(1.0)))
