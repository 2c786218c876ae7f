"""String functions: normal forms, matching, extraction from model answers, tokens."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.schema import VISUAL_TYPES


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# Signs an answer's normal form leaves out.
SIGNS = r"""[.,!?;:"'()\[\]{}%$#@&*+=/<>\\|`~^]"""


def normalize_answer(t: Column) -> Column:
    """Lower case, hyphens and underscores as blanks, signs off, blanks squeezed (null: null)."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(t), r"[-_]", " "), SIGNS, ""))


def normalize_ocr(t: Column) -> Column:
    """Characters that recognition confuses folded into one: 0 o, 1 and bar l, rn m."""
    return F.replace(F.translate(F.lower(t), "01|", "oll"), F.lit("rn"), F.lit("m"))


def normalize_dashes(t: Column) -> Column:
    """Lower case, every dash a blank, blanks squeezed: for counting occurrences."""
    return squeeze(F.regexp_replace(F.lower(t), "[-–—]", " "))


def words(t: Column) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_set(t: Column) -> Column:
    """Distinct lower-case tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens of two token sets; 0 where either is empty."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / union).otherwise(0.0)


def shorten(t: Column, limit: int = 400) -> Column:
    s = squeeze(t)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("..."))).otherwise(s)


def document_name(t: Column) -> Column:
    """Base name of a document path without its suffix."""
    return F.regexp_replace(F.regexp_replace(t, r"^.*/", ""), r"\.pdf$", "")


# ---------------------------------------------------------------- captions

_CAPTION_NOUNS = (("table", "table_caption"), ("figure|fig", "figure_caption"), ("chart", "chart_caption"), ("map", "map_caption"),
                  ("diagram", "diagram_caption"), ("graph", "graph_caption"))


def refine_type(kind: Column, text: Column) -> Column:
    """Type of a text-like block by the caption noun and number it begins with."""
    head = F.lower(F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 50))
    out = F.when(F.lit(False), kind)
    for noun, name in _CAPTION_NOUNS:
        out = out.when(kind.isin("text", "unknown", "caption") & head.rlike(rf"^(?:{noun})\.?\s+[0-9]+"), F.lit(name))
    return out.otherwise(kind)


def visual_type(kind: Column, caption: Column) -> Column:
    """Visual type named first, by priority, in a caption's beginning; else the block's own type."""
    head = F.lower(F.substring(F.coalesce(caption, F.lit("")), 1, 150))
    out = F.when(F.lit(False), kind)
    for noun in ("table", "figure", "chart", "graph", "map", "diagram"):
        pattern = r"(?:figure|fig\.)" if noun == "figure" else noun
        out = out.when(head.rlike(rf"(?:^|[^a-z]){pattern}"), F.lit(noun))
    return out.otherwise(kind)


def is_visual(kind: Column) -> Column:
    return F.coalesce(F.lower(kind).isin(*VISUAL_TYPES), F.lit(False))


# Characters recognition confuses in a unit's number, and how it spells the nouns before it.
CONFUSED = (("1li", "1lI|i!j"), ("0o", "0OoQ"), ("2z", "2Zz"), ("5s", "5Ss"), ("8b", "8B"))
NOUNS = (("figure", r"f[il1!|][gq9](?:ure)?\.?"), ("table", r"t[a@]b(?:le)?\.?"), ("chart", r"chart\.?"), ("map", r"m[a@]p\.?"), ("graph", r"graph\.?"))


def _number_pattern(unit: str) -> str:
    """Pattern of a unit's number: a character of a confused set stands for the whole set."""
    out = []
    for c in unit.lower():
        sets = [seen for members, seen in CONFUSED if c in members]
        out.append(f"[{sets[0]}]" if sets else re.escape(c))
    return "".join(out)


def unit_pattern(unit: str, kind: str | None = None) -> str:
    """Pattern of a caption that names unit ``unit``, tolerant of misread characters; no digit follows it."""
    nouns = dict(NOUNS) | {"fig": NOUNS[0][1]}
    noun = nouns.get((kind or "").lower()) or "|".join(p for _, p in NOUNS)
    return rf"(?:{noun})[^0-9a-zA-Z]*{_number_pattern(unit)}(?:[^0-9]|$)"


def match_unit(text: Column, unit: str, kind: str | None = None) -> Column:
    """Whether a caption names the unit ("Figure 1" does not match "Figure 10")."""
    return F.coalesce(F.lower(text).rlike(unit_pattern(unit, kind)), F.lit(False))


# How questions name places, and what asks for counts, sums and pages.
REFERENCES = (("figure", r"\b(?:fig(?:\.|ure)?)\s*[:#]?-?\s*[0-9]+"), ("table", r"\btable\s*[:#]?-?\s*[0-9]+"), ("section", r"\b(?:section|sec\.)\b"),
              ("page", r"\b(?:page|p\.)\s*[0-9]+"), ("equation", r"\beq(?:\.|uation)?\s*\(?\s*[0-9]+"))
GLOBAL_CUES = ("any of", "among all", "overall", "distribution", "proportion across", "throughout", "in total")
LOCAL_CUES = ("according to figure", "according to table", "in figure", "in table", "in section")
PAGE_COUNT = r"how many pages (?:does|do|are|in|did|has)|total (?:number of )?pages|pages (?:does|do) (?:the )?(?:document|report|paper|file|newspaper) (?:have|contain|consist)"
ARITHMETIC = (r"\b(?:calculate|sum|combined|difference|increase|decrease|total|amount|revenue|expenditure|income|assets|liabilities|equity|gains|loss|quantity|capacity|"
              r"percentage|percent|rate|value|days|shares|responses|skipped|how\s+much|operating earnings|ebit|cash flow|dcf)\b")


def reference_flags(q: Column) -> Column:
    """Which kinds of places a question names explicitly; null names none."""
    q = F.lower(F.coalesce(q, F.lit("")))
    return F.struct(*[q.rlike(pattern).alias(name) for name, pattern in REFERENCES])


def type_compatible(source: Column, target: Column, flags: Column) -> Column:
    """Whether an arc may lead from a block of one type to one of another, under a question's flags."""
    s, d = F.lower(F.coalesce(source, F.lit("unknown"))), F.lower(F.coalesce(target, F.lit("unknown")))
    return (F.when(flags["figure"], d.isin("figure", "image")).when(flags["table"], d == "table").when(flags["equation"], d.isin("text", "title", "list"))
            .when(flags["section"], d.isin("title", "text", "list")).when(s.isin("text", "list"), d.isin("text", "list", "title", "table", "figure", "image"))
            .when(s == "title", d.isin("text", "list", "title")).when(s == "table", d.isin("text", "list", "title", "table"))
            .when(s.isin("figure", "image"), d.isin("text", "list", "title", "figure", "image")).otherwise(F.lit(True)))


def caption_cue(t: Column) -> Column:
    """How much a text looks like a caption, 0 to 1."""
    t = F.lower(F.coalesce(t, F.lit("")))
    return F.least(F.lit(1.0), F.when(t.rlike(r"\bfig(?:\.|ure)?\b"), 0.5).otherwise(0.0) + F.when(t.rlike(r"\btable\b"), 0.5).otherwise(0.0)
                   + F.when(t.rlike(r"[0-9]"), 0.2).otherwise(0.0))


def asks_count(q: Column) -> Column:
    return F.lower(q).rlike(r"how many|number of|count of|total number")


def asks_pages(q: Column) -> Column:
    """Whether a question asks for the number of pages."""
    return F.lower(q).rlike(PAGE_COUNT)


def asks_occurrences(q: Column) -> Column:
    return F.lower(q).rlike(r"how many times?")


def asks_arithmetic(q: Column) -> Column:
    """Whether a question asks for a value to be computed or read off."""
    return F.lower(q).rlike(ARITHMETIC)


def query_scope(q: Column) -> Column:
    """``global`` for questions about the whole document, ``local`` for those about a named place, else ``default``."""
    q = F.lower(F.coalesce(q, F.lit("")))

    def any_of(cues):
        return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(q, c))

    return F.when(any_of(GLOBAL_CUES), "global").when(any_of(LOCAL_CUES), "local").otherwise("default")


def scope_settings(scope: Column, pages: Column) -> Column:
    """How many blocks a question gets and the damping of its ranking, by scope and number of pages."""
    k = F.when(pages <= 1, 6).when(pages == 2, 12).otherwise(F.least(5 * pages, F.lit(10)))
    return F.struct(F.when(scope == "global", F.least(8 * F.greatest(pages, F.lit(1)), F.lit(15))).otherwise(k).alias("k"),
                    F.when(scope == "global", 0.70).when(scope == "local", 0.80).otherwise(0.75).alias("damping"))


# ------------------------------------------------------------ model answers

def _unix(pattern: str) -> str:
    """A pattern whose line ends are line feeds only."""
    return pattern.replace("(?im)", "(?imd)")


def _bare(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def answer_after_thinking(t: Column) -> Column:
    """Answer tag; else what follows the closing thinking tag, without tags; else the text itself."""
    tagged = _bare(F.regexp_extract(t, r"(?is)<answer>(.*?)</answer>", 1))
    after = _bare(F.regexp_replace(F.regexp_extract(t, r"(?is)</think>(.*)$", 1), r"<[^>]+>", ""))
    return F.coalesce(F.when(t.rlike(r"(?is)<answer>(.*?)</answer>"), tagged), F.when(t.rlike(r"(?i)</think>"), after), _bare(t))


# Where an answer stands in a text, in the order they are tried.
ANSWER_FORMS = (r"(?im)(?:the\s+)?answer\s+is[:\s]+([^\n.]+)", r"(?im)(?:final\s+)?answer[:\s]+([^\n.]+)", r"(?im)^([^\n]+)\.$", r"(?im)^([^\n]{20,100})")
COUNT_FORMS = (r"(?im)count[:\s]+([0-9]+)", r"(?im)total[:\s]+([0-9]+)", r"(?im)([0-9]+)\s+(?:items?|elements?|units?|images?|charts?|figures?)", r"(?im)^\s*([0-9]+)\s*$")


def _first_sentence(t: Column) -> Column:
    """The text up to its first sentence or line end; the first 100 characters of one too long."""
    first = F.element_at(F.split(t, r"[.!?\n]\s+", 2), 1)
    return F.when((first != "") & (F.length(first) < 200), _bare(first)).when(F.length(t) > 10, _bare(F.substring(t, 1, 100)))


def extract_answer(t: Column) -> Column:
    """Cascade: answer tag, "answer is", "answer:", a line that ends in a full stop, the first 20 to
    100 characters of a line, each if it has over two characters; else the first sentence; else null."""
    t = _bare(t)

    def form(pattern):
        c = F.regexp_replace(_bare(F.regexp_extract(t, _unix(pattern), 1)), r"^(?:is|:|\s)+", "")
        return F.when(F.length(c) > 2, c)

    tag = r"(?is)<answer>(.*?)</answer>"
    return F.when(t != "", F.coalesce(F.when(t.rlike(tag), _bare(F.regexp_extract(t, tag, 1))), *[form(p) for p in ANSWER_FORMS], _first_sentence(t)))


def extract_count(t: Column) -> Column:
    """First whole number in the answer, else behind or before count words, else null."""
    answer = F.coalesce(extract_answer(t), F.lit(""))
    return F.coalesce(*[c.try_cast("bigint") for c in (F.regexp_extract(answer, r"(?<![\p{L}\p{N}_])([0-9]+)(?![\p{L}\p{N}_])", 1), *[F.regexp_extract(t, _unix(p), 1) for p in COUNT_FORMS])])


def extract_count_answer(t: Column) -> Column:
    """Answer of a counting question as text: the extracted answer, else the first sentence."""
    answer = extract_answer(t)
    return F.when(answer != "", _bare(answer)).otherwise(_first_sentence(_bare(t)))


# What names a memory failure.
MEMORY_CUES = ("cuda out of memory", "outofmemoryerror")


def is_oom(t: Column) -> Column:
    t = F.lower(F.coalesce(t, F.lit("")))
    return F.contains(t, F.lit(MEMORY_CUES[0])) | F.contains(t, F.lit(MEMORY_CUES[1]))


def first_text(*cols: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def estimate_tokens(t: Column) -> Column:
    """Tokens by size: the larger of characters / 4 and 1.3 a word, rounded up; null and empty 0."""
    t = F.coalesce(t, F.lit(""))
    return F.ceil(F.greatest(F.length(t) / 4.0, F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))) * 1.3)).cast("bigint")


# ------------------------------------------------------------------- fuzzy

class Likeness:
    """Share of matching characters of two texts in their longest common blocks, each pair computed
    once. ``least`` lets a caller skip pairs whose lengths or characters cannot reach it."""

    def __init__(self, room: int = 200_000):
        self.room, self.known, self.counts = room, {}, {}

    def _bag(self, text: str) -> Counter:
        if text not in self.counts:
            if len(self.counts) >= self.room:
                self.counts.clear()
            self.counts[text] = Counter(text)
        return self.counts[text]

    def bound(self, a: str, b: str) -> float:
        """No pair is more alike than the characters both have."""
        size = len(a) + len(b)
        return 1.0 if not size else 2.0 * sum((self._bag(a) & self._bag(b)).values()) / size

    def __call__(self, a: str, b: str, least: float = 0.0) -> float:
        """The ratio, or 0 where it cannot exceed ``least``."""
        if a == b:
            return 1.0
        if 2.0 * min(len(a), len(b)) <= least * (len(a) + len(b)) or self.bound(a, b) <= least:
            return 0.0
        if (a, b) not in self.known:
            if len(self.known) >= self.room:
                self.known.clear()
            self.known[a, b] = difflib.SequenceMatcher(None, a, b).ratio()
        return self.known[a, b]


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching characters in the longest common blocks (order of arguments matters)."""
    alike = Likeness()
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else alike(x, y) for x, y in zip(a, b)])


def match_title(text: Column, wanted: Column, least: float = 0.8) -> Column:
    """Whether a title holds the wanted one, or is like it to ``least``; nulls and empty texts do not match.
    Lengths that rule it out never leave the JVM."""
    t, w = F.lower(text), F.lower(wanted)
    possible = 2 * F.least(F.length(t), F.length(w)) >= least * (F.length(t) + F.length(w))
    ratio = sequence_ratio(F.when(possible & ~F.contains(t, w), t), F.when(possible & ~F.contains(t, w), w))
    return F.coalesce((t != "") & (w != "") & (F.contains(t, w) | (F.coalesce(ratio, F.lit(0.0)) >= least)), F.lit(False))


def best_span(keyword: list[str], text: list[str], threshold: float, alike: Likeness) -> float:
    """Best likeness of a keyword's words with the text's: of one word with any word (three
    characters or fewer must be equal), of several with a run of as many words, or, where no run
    reaches ``threshold``, nine tenths of the mean over their words."""
    n, vocabulary = len(keyword), sorted(set(text))

    def word(k):
        if len(k) <= 3:
            return float(k in vocabulary)
        best = 0.0
        for w in sorted(vocabulary, key=lambda w: -alike.bound(k, w)):
            if alike.bound(k, w) <= best:
                break
            best = max(best, alike(k, w, best))
        return best

    if n == 0:
        return 0.0
    if n == 1:
        return word(keyword[0])
    phrase, best = " ".join(keyword), 0.0
    for i in range(len(text) - n + 1):
        best = max(best, alike(phrase, " ".join(text[i:i + n]), best))
    return best if best >= threshold else max(best, 0.9 * sum(map(word, keyword)) / n)


@F.pandas_udf(T.DoubleType())
def _likeness_of_words(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    alike = Likeness()
    for keyword, text, threshold in batches:
        yield pd.Series([None if k is None or t is None else best_span(k.split(), t.split(), h, alike) for k, t, h in zip(keyword, text, threshold)])


def fuzzy_score(keyword: Column, text: Column, threshold: float = 0.85, exact_only: bool = False) -> Column:
    """Fuzzy match of a keyword in a text: 1 where contained after folding, else the best word
    or span ratio. Containment never leaves the JVM; ``exact_only`` stops there. Nulls are empty texts,
    and an empty keyword is contained in any text."""
    k, t = normalize_ocr(F.coalesce(keyword, F.lit(""))), normalize_ocr(F.coalesce(text, F.lit("")))
    held = F.contains(t, k)
    kw, tw = F.array_join(words(k), " "), F.array_join(words(t), " ")
    rest = _likeness_of_words(F.when(~held, kw), F.when(~held, tw), F.lit(threshold))
    return F.when(held, 1.0).otherwise(F.lit(0.0) if exact_only else F.coalesce(rest, F.lit(0.0)))
