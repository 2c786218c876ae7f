"""One consistent form for texts that read alike but differ in their characters.

Irregular texts are look-alike mapped by built-in expressions (widths, spaces,
letters of other alphabets inside Latin words). All texts, regular ones as they
stand, are grouped under the accent-sensitive collation UNICODE, in which
composed and decomposed accents are equal and invisible characters do not
count. Every class is given one deterministic member, a regular one if it has
any, which is joined back. Only a class without a regular member is given a
form made from its least member, without marks and with accents composed.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import join_lookup
from quire.session import cut

# Letters of other alphabets and the Latin letters they look like.
CYRILLIC = "аеорсухіјѕһԁԛԝӏАВЕЅІЈКМНОРСТУХԌԚԜ"
CYRILLIC_AS = "aeopcyxijshdqwlABESIJKMHOPCTYXGQW"
GREEK = "οαινκρυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϷ"
GREEK_AS = "oaivkpucjABEZHIKMNOPTYXCP"
LOOKALIKE = CYRILLIC + GREEK
LOOKALIKE_AS = CYRILLIC_AS + GREEK_AS
INVISIBLE = r"­᠎​-‏‪-‮⁠-⁤﻿"
SPACES = r"   -   　"
WIDE = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
WIDE_AS = unicodedata.normalize("NFKC", WIDE)


def _signs() -> dict[str, str]:
    """Compatibility signs that stand for Latin letters: long s, letterlike signs such as
    the Kelvin sign, Latin ligatures and font variants; no super- or subscripts,
    fractions or enclosed letters."""
    out = {}
    for c in map(chr, [0x17F, *range(0x2100, 0x2150), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D800)]):
        plain = unicodedata.normalize("NFKC", c)
        kind = unicodedata.decomposition(c).split(" ")[0]
        if unicodedata.category(c)[0] == "L" and kind not in ("<super>", "<sub>", "") and (plain.isascii() or plain == "\u00c5") and plain.isalpha():
            out[c] = plain
    return out


def _pairs() -> list[tuple[str, str]]:
    """Letter and accent kept apart, with their composed form; longest first."""
    out = []
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c:
            out.append((apart, c))
    return sorted(out, key=lambda p: (-len(p[0]), p[0]))


SIGNS = _signs()
_SINGLE = "".join(c for c in SIGNS if len(SIGNS[c]) == 1)
_SINGLE_AS = "".join(SIGNS[c] for c in _SINGLE)
_LIGATURES = {c: v for c, v in SIGNS.items() if len(v) > 1}


SIGN_CLASS = r"ſ℀-⅏ﬀ-ﬆ\x{1D400}-\x{1D7FF}"
WORD = rf"[\p{{L}}\p{{M}}{INVISIBLE}]+"
_LATIN = rf"[\p{{IsLatin}}&&[^{SIGN_CLASS}]]"
_FOREIGN = rf"[{LOOKALIKE}{SIGN_CLASS}]"
_SKIP = rf"[\p{{M}}{INVISIBLE}]*"
# One character class that every irregular text meets: cheap to test, and false for most texts.
SUSPECT = rf"[{WIDE[0]}-{WIDE[9]}{WIDE[10]}-{WIDE[35]}{WIDE[36]}-{WIDE[61]}\u0300-\u03FF\u0400-\u052F{INVISIBLE}{SPACES}{SIGN_CLASS}]"
IRREGULAR = (rf"[{WIDE[0]}-{WIDE[9]}{WIDE[10]}-{WIDE[35]}{WIDE[36]}-{WIDE[61]}̀-ͯ{INVISIBLE}{SPACES}]"
             rf"|{_LATIN}{_FOREIGN}|{_FOREIGN}{_LATIN}"
             rf"|(?<![\p{{L}}\p{{M}}])[{CYRILLIC}{GREEK}{SIGN_CLASS}]+(?![\p{{L}}\p{{M}}])")


def mapped(text: Column) -> Column:
    """Look-alike mapped text: plain spaces, plain widths, Latin letters in Latin words."""
    t = F.regexp_replace(text, rf"[{SPACES}]", " ")
    t = F.translate(t, WIDE, WIDE_AS)
    # Genuine words of another alphabet hold letters that no Latin letter looks like.
    foreign_text = t.rlike(rf"[[\p{{IsCyrillic}}\p{{IsGreek}}]&&[^{LOOKALIKE}]][\p{{L}}]|[\p{{L}}][[\p{{IsCyrillic}}\p{{IsGreek}}]&&[^{LOOKALIKE}]]")
    latin_text = t.rlike(_LATIN)
    inside = rf"^(?=.*{_LATIN})(?=.*{_FOREIGN})(?:[\p{{IsLatin}}{LOOKALIKE}\p{{M}}{INVISIBLE}]|{_FOREIGN})+$"
    alone = rf"^(?:[{CYRILLIC}{INVISIBLE}]+|[{LOOKALIKE}{SIGN_CLASS}{INVISIBLE}]{{2,}})$"

    def plain(w: Column) -> Column:
        out = F.translate(w, LOOKALIKE + _SINGLE, LOOKALIKE_AS + _SINGLE_AS)
        for c, v in _LIGATURES.items():
            out = F.replace(out, F.lit(c), F.lit(v))
        return out

    words = F.regexp_extract_all(t, F.lit(rf"{WORD}|[^\p{{L}}\p{{M}}{INVISIBLE}]+"), F.lit(0))
    fixed = F.array_join(F.transform(words, lambda w: F.when(
        w.rlike(inside) | (w.rlike(alone) & w.rlike(r"\p{L}") & latin_text & ~foreign_text), plain(w)).otherwise(w)), "")
    return F.when(t.rlike(_FOREIGN), fixed).otherwise(t)


def composed(text: Column) -> Column:
    """Text without invisible characters, accents composed with their letters."""
    t = F.regexp_replace(text, rf"[{INVISIBLE}]", "")
    pairs = [p for p in _pairs() if p[0][-1] in _COMMON]
    table = F.arrays_zip(F.split(F.lit(" ".join(a for a, _ in pairs)), " ").alias("a"),
                         F.split(F.lit(" ".join(c for _, c in pairs)), " ").alias("c"))
    once = F.aggregate(table, t, lambda acc, p: F.replace(acc, p["a"], p["c"]))
    return F.when(t.rlike(r"[̀-ͯ]"), once).otherwise(t)


# The accents of alphabets in use.
_COMMON = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030A\u030B\u030C\u0323\u0327\u0328"


_FOLD = {ord(a): b for a, b in zip(LOOKALIKE, LOOKALIKE_AS)}
_LATIN_LETTER = re.compile(r"[A-Za-z]")
_OTHER_LETTER = re.compile(r"[бвгджзийклмнптфцчшщъыьэюяё]", re.I)
_RUN = re.compile(r"([^\W_]+)")


def one_form(text: str) -> str:
    """The consistent form of a text inside Python kernels, for comparisons only: also
    folds compatibility characters that ``canonical`` keeps."""
    if text.isascii():
        return text
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    if not _LATIN_LETTER.search(text):
        return text
    out = []
    for w in _RUN.split(text):
        latin = w if w.isascii() else w.translate(_FOLD)
        out.append(latin if latin is w or _LATIN_LETTER.search(latin) and not _OTHER_LETTER.search(latin) else w)
    return "".join(out)


def canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the one consistent form of ``text`` in ``out`` (replaced if there).

    Null stays null and empty stays empty; regular texts, whole Cyrillic,
    Greek or Chinese texts with their own punctuation, superscripts, fractions,
    quotes, dashes and line ends stay as they are, but for regular texts that
    are equal under the collation, which take the least of them. Equal texts
    get equal forms in any row, and running the operator on its own output
    changes nothing; no texts are dropped, whatever their number or length.
    """
    rows = df.drop(out)
    odd, classes = _classes(rows, text)
    regular = rows.filter(~_irregular(text))
    same = regular.withColumn(out, F.col(text))
    return same.unionByName(_joined(odd, classes, "_q_odds", out).select(*rows.columns, out)) if _settled(classes) else \
        _joined(regular.withColumn("_q_class", F.collate(F.col(text), "UNICODE")), classes.filter("_q_several"), "_q_regulars", "_q_c").select(
            *rows.columns, F.coalesce("_q_c", F.col(text)).alias(out)).unionByName(_joined(odd, classes, "_q_odds", out).select(*rows.columns, out))


def _irregular(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(SUSPECT) & F.col(text).rlike(IRREGULAR), F.lit(False))


def _classes(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Irregular ``rows`` with their class, mapped once and kept; and the classes that
    hold an irregular or several different regular texts, with their member."""
    odd = cut(rows.filter(_irregular(text)).withColumn("_q_v", mapped(F.col(text))).withColumn("_q_class", F.collate("_q_v", "UNICODE")))
    marks = F.length("v") - F.length(F.regexp_replace("v", rf"[\u0300-\u036F{INVISIBLE}]", ""))
    ours = odd.select(F.col("_q_v").alias("v"), F.lit(1).alias("odd"), _irregular("_q_v").alias("bad"))
    theirs = rows.filter(F.col(text).isNotNull() & ~_irregular(text)).select(F.col(text).alias("v"), F.lit(0).alias("odd"), F.lit(False).alias("bad"))
    every = ours.unionByName(theirs)
    rank = F.struct("bad", F.when(F.col("bad"), marks).otherwise(0), F.length("v"), "v")
    own = F.when(F.col("odd") == 0, F.col("v"))
    made = every.groupBy(F.collate("v", "UNICODE").alias("_q_class")).agg(
        F.min(F.struct(rank.alias("r"), F.col("v").alias("m"))).alias("b"), F.sum("odd").alias("_q_odds"), F.count(own).alias("_q_regulars"), F.min(own).alias("lo"), F.max(own).alias("hi"))
    member = F.when(F.col("b.r.bad"), composed(F.col("b.m"))).otherwise(F.col("b.m"))
    several = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    return odd, cut(made.filter((F.col("_q_odds") > 0) | several).select("_q_class", member.alias("_q_m"), "_q_odds", "_q_regulars", several.alias("_q_several")))


def _settled(classes: DataFrame) -> bool:
    """Whether no two different regular texts share a class, so that regular rows need no join."""
    return classes.filter("_q_several").isEmpty()


def _joined(rows: DataFrame, classes: DataFrame, weight: str, out: str) -> DataFrame:
    total = classes.agg(F.sum(weight).alias("_q_all"))
    look = classes.select("_q_class", F.col("_q_m").alias(out), F.col(weight).alias("_q_w")).crossJoin(F.broadcast(total))  # one row: a scalar
    return join_lookup(rows, look, ["_q_class"], F.col("_q_w"), F.col("_q_all"), "left")


def changed(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` whose text is not in the consistent form."""
    odd, classes = _classes(df, text)
    out = _joined(odd, classes, "_q_odds", "_canonical")
    if not _settled(classes):
        regular = df.filter(~_irregular(text)).withColumn("_q_class", F.collate(F.col(text), "UNICODE")).withColumn("_q_v", F.col(text))
        out = out.unionByName(_joined(regular, classes.filter("_q_several"), "_q_regulars", "_canonical"))
    return out.filter(F.col("_canonical") != F.col(text)).select(*df.columns)
