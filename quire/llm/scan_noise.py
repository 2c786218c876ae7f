"""Noise in text read from scanned pages: broken words, misread characters, running lines, page numbers.

Word counts over the whole corpus give a lexicon. A block's text is one stream
of characters, and the cheapest path by code length decodes it into words of
the lexicon. Its edges let a word stand, join its parts across a hyphen, a
stray blank or a line end, split words that run together, and read any of these
through the confusions of recognition. Page furniture is found over all pages
of a document, and paragraphs are chosen by dynamic programming over the lines
that are left.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.lookalike import one_form
from quire.operators.joins import join_lookup
from quire.session import cut

PAGE_HEIGHT, TOP, BOTTOM = 1584.0, 0.075, 0.95

# What recognition reads (left) for what is printed (right), in lower case.
CONFUSIONS = [
    ("c", "e"), ("@", "a"), ("5", "s"), ("f", "t"), ("!", "i"), ("1", "l"), ("0", "o"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("9", "g"),
    ("b", "h"), ("6", "b"), ("vv", "w"), ("m", "in"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("8", "b"), ("3", "e"), ("|", "l"), ("$", "s"),
    ("1", "i"), ("e", "c"), ("rm", "nn"), ("nn", "m"), ("q", "g"), ("2", "z"), ("7", "t"),
]
CONFUSED = 8.0  # bits of a confusion
PARTED = 12.0  # bits of a blank too many or too few
APART = 200.0  # bits of two words that keep a hyphen and a blank or line end between them, where they could be one
COMMON = 1 / 500  # share of all running words from which a word is no part of a compound
SUSPENDED = frozenset("and or to und oder bis et ou y o e".split())
WORD = r"\p{L}+(?:['’-]\p{L}+)*"
_TOKEN = re.compile(r"[^\W_](?:[\w@!|$]*[\w@$])?|[@!$|][\w@!|$]*\w")
_GAP = re.compile(r"([-¬‐])?(?:[ \t]{1,2}|([ \t]*\r?\n[ \t]*))")
BLANK, LINE, HYPHEN, HYPHEN_LINE = 1, 2, 3, 4  # what may stand between the parts of a word
TIES = frozenset("'’-")
_SIGN = re.compile(r"[@!0-9|$]")
_BY_END = {}
for _seen, _meant in CONFUSIONS:
    _BY_END.setdefault(_seen, []).append(_meant)

# Page numbers in any dress; the words as they may be misread.
DRESSED = (r"^\W*(?:(?:[Pp][a@][g9][ec]|[S5][ec][i!1l]t[ec]|[Pp]|[S5]|[Pp][g9]|[Nn]o|[Pp][a@][g9][i!1l]n[a@])[.:]?\s*\d+(?:\s*(?:/|of|von|sur|de)\s*\d+)?"
           r"|\[\s*\d+\s*\]|\(\s*\d+\s*\)|[-–—~*·]+\s*\d+\s*[-–—~*·]+|\d+\s*/\s*\d+)\W*$")
PLAIN = r"^\s*\d{1,5}\s*$"
ROMAN = r"^\s*[-–\[(]?\s*(?:x{0,3}(?:ix|iv|v?i{0,3}))\s*[-–\])]?\s*$"


# ------------------------------------------------------------------- lexicon

def lexicon(blocks: DataFrame, text: str = "text", share: float = 1e-6, least: int = 3) -> dict[str, int]:
    """Counts of the words with at least ``share`` of all running words: at most
    ``1 / share`` of them, whatever the corpus, so the table may be broadcast.
    Words broken at line ends are left out of the counts."""
    whole = F.regexp_replace(F.lower(F.col(text)), r"\p{L}+[-¬‐]\s+\p{L}+", " ")
    words = blocks.select(F.explode(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))).alias("w"))
    counts = cut(words.groupBy("w").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    floor = max(least, int(total * share))
    return {r.w: r.n for r in counts.filter(F.col("n") >= floor).collect()}


# ------------------------------------------------------------------ decoding

class Decoder:
    """Reads words through the lexicon; results are kept per word, up to a bound of memory."""

    def __init__(self, counts: dict[str, int], room: int = 200_000):
        self.counts, self.room, self.seen = counts, room, {}
        self.total = max(sum(counts.values()), 1)
        self.top = max(counts.values(), default=0)
        self.order = sorted(counts)

    def bits(self, word: str) -> float:
        n = self.counts.get(word, 0)
        return math.log2(self.total / n) if n else 5.0 * len(word) + 10.0

    def readings(self, word: str, start: int = 0) -> list[tuple[int, str, int]]:
        """``(end, reading, confusions)`` of all words of the lexicon that recognition may have read
        as the characters from ``start`` to ``end``: a search along prefixes the lexicon has."""
        out, order = [], self.order
        todo = [(start, "", 0)]
        while todo:
            i, made, k = todo.pop()
            if made:
                at = bisect_left(order, made)
                if at == len(order) or not order[at].startswith(made):
                    continue
                if order[at] == made:
                    out.append((i, made, k))
            if i < len(word):
                todo.append((i + 1, made + word[i], k))
                for n in (1, 2):
                    for meant in _BY_END.get(word[i:i + n], ()) if i + n <= len(word) else ():
                        todo.append((i + n, made + meant, k + 1))
        return out

    def worth(self, word: str, cost: float) -> bool:
        """Whether a reading of so many bits is shorter than the word spelled out."""
        return cost < 5.0 * len(word) + 10.0

    def pieces(self, word: str) -> tuple[str, ...] | None:
        """The word as two words of the lexicon, the cheaper split first (merged words, compounds)."""
        best = None
        for i in range(3, len(word) - 2):
            a, b = word[:i], word[i:]
            if a in self.counts and b in self.counts:
                cost = self.bits(a) + self.bits(b)
                if best is None or cost < best[0]:
                    best = (cost, (a, b))
        return best[1] if best else None

    def read(self, word: str, doubt: float = 1.0) -> str | None:
        """What ``word`` (lower case) should be, if it is misread; None if it stands as it is."""
        key = (word, doubt)
        if key in self.seen:
            return self.seen[key]
        out = self._read(word, doubt)
        if len(self.seen) < self.room:
            self.seen[key] = out
        return out

    def _read(self, word: str, doubt: float) -> str | None:
        signs = bool(_SIGN.search(word))
        n = self.counts.get(word, 0)
        letters = sum(c.isalpha() for c in word)
        if letters < 2 or len(word) < 3 or signs and (not word.isascii() and letters < 3 or re.fullmatch(r"[a-z]?\d[\d.,]*[a-z]{0,2}", word)):
            return None
        if not word.isascii() and not re.search(r"[a-zà-ÿ]", word):
            return None
        ratio = 1.0 if signs else 30.0 / doubt
        least = max(1.0, n * ratio, n + 1)
        if least > self.top:  # no word is that much more frequent
            return None
        found = [(r, k) for end, r, k in self.readings(word) if end == len(word) and k and self.counts[r] >= least]
        # A few confusions are common; more of them must pay for themselves.
        few = [(self.counts[r], r) for r, k in found if k <= 2 or k == 3 and signs or self.worth(word, self.bits(r) + CONFUSED * k)]
        if few:
            return max(few)[1]
        if n == 0 and (signs or not self.pieces(word)):
            # Compounds and inflected words: the reading may be two words of the lexicon in one.
            best = None
            for i, x, k in self.readings(word):
                if i < len(word) and len(x) >= 3:
                    for end, y, m in self.readings(word, i):
                        if end == len(word) and len(y) >= 3 and k + m and len(x) + len(y) >= 8:
                            cost = self.bits(x) + self.bits(y)
                            if (k + m <= 2 or self.worth(word, cost + CONFUSED * (k + m))) and (best is None or cost < best[0]):
                                best = cost, x + y
            return best and best[1]
        return None


    def token(self, low: str, doubt: float) -> tuple[float, tuple[str, bool] | None]:
        """Bits of a token of its own, and ``(words, misread)`` if it should read otherwise."""
        key = (low, doubt, "token")
        if key not in self.seen:
            out = (self.bits(low), None)
            if any(c.isalpha() for c in low):
                right = self.read(low, doubt)
                apart = None if low in self.counts or right in self.counts else self.split(low)
                if apart:
                    out = apart
                elif right is not None:
                    bits = self.bits(right) if right in self.counts else sum(map(self.bits, self.pieces(right) or (right,)))
                    out = (bits + CONFUSED, (right, True))
            if len(self.seen) >= self.room:
                return out
            self.seen[key] = out
        return self.seen[key]

    def split(self, low: str) -> tuple[float, tuple[str, bool]] | None:
        """Words run together, read through confusions where need be: the cheapest path over
        the characters. Of two neighbours one is a common word, else they may be a compound."""
        if not low.isascii() and not re.search(r"[a-zà-ÿ]", low) or sum(c.isalpha() for c in low) < 5:
            return None
        common = COMMON * self.total
        best = {(0, True): (0.0, (), 0)}  # by place, and whether a common word stands before it
        for i in range(len(low)):
            here = [(was, best[i, was]) for was in (True, False) if (i, was) in best]
            if not here:
                continue
            for end, word, k in self.readings(low, i):
                now = self.counts[word] >= common
                if len(word) < 2 or len(word) < 3 and not now:
                    continue
                for was, (cost, words, n) in here:
                    if i and not (now or was):
                        continue
                    c = cost + self.bits(word) + CONFUSED * k + (PARTED if i else 0.0)
                    if (end, now) not in best or c < best[end, now][0]:
                        best[end, now] = (c, (*words, word), n + k)
        ends = [best[len(low), x] for x in (True, False) if (len(low), x) in best and len(best[len(low), x][1]) > 1]
        if not ends:
            return None
        cost, words, k = min(ends)
        return (cost, (" ".join(words), k > 0)) if self.worth(low, cost) else None

    def joined(self, parts: tuple[str, ...], doubt: float) -> tuple[float, tuple[str, bool]] | None:
        """Bits and ``(word, misread)`` of tokens that are one word in parts."""
        low = "".join(parts)
        if low in self.counts:
            return self.bits(low) + PARTED * (len(parts) - 1), (low, False)
        if len(low) < 5 or all(x in self.counts for x in parts) or not all(any(c.isalpha() for c in x) for x in parts):
            return None
        right = self.read(low, doubt)
        if right is None or right not in self.counts:
            return None
        return self.bits(right) + CONFUSED + PARTED * (len(parts) - 1), (right, True)

    def hyphened(self, a: str, b: str, line_end: bool, doubt: float) -> tuple[float, tuple[str | None, bool]] | None:
        """Bits and ``(word, misread)`` of two tokens with a hyphen and a blank or line end between them, if
        they may be one word; the word is None if it reads as its parts do. Suspended compounds, compounds
        known with their hyphen and names behind a hyphen are no such words, nor two known words on one
        line that are none together."""
        if not (any(map(str.isalpha, a)) and any(map(str.isalpha, b))) or b[0].isupper() and not a.isupper():
            return None
        counts, left, right = self.counts, a.lower(), b.lower()
        low = left + right
        known = low in counts or self.read(low, 3.0) is not None
        if not known and not (a[-1].isalpha() and b[0].isalpha()):
            return None
        if right in SUSPENDED and not (known and counts.get(low, 0) * 20 > counts.get(left, 0)):
            return None
        if not known and (f"{left}-{right}" in counts or not line_end and left in counts and right in counts):
            return None
        if not known and left in counts and right in counts:  # a compound that keeps its hyphen
            return self.bits(left) + self.bits(right), (f"{left}-{right}", False)
        bits, change = self.token(low, doubt)
        return bits, change or (None, False)


def _alike(word: str, model: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word.capitalize() if model[:1].isupper() else word


def _gap(stream: str, a: int, b: int) -> int:
    """What stands between two tokens that may be parts of one word; 0 for anything else."""
    if b - a == 1 and stream[a] == " ":
        return BLANK
    m = _GAP.fullmatch(stream, a, b) if b > a else None
    return 0 if m is None else (HYPHEN_LINE if m[2] is not None else HYPHEN) if m[1] else LINE if m[2] is not None else BLANK


def segment(stream: str, dec: Decoder, doubt: float) -> list[tuple[int, int, str, bool, bool]]:
    """``(start, end, words, misread, broken)`` of the places of a stream that should read otherwise.

    The cheapest path over the tokens by code length: a token stands, is read
    through confusions, or is split into words; tokens parted by a hyphen at a
    line end, a blank or a line end are joined, and the joined word is read
    through confusions too. A word that is only joined keeps its characters.
    """
    starts, ends, lows = [], [], []
    for m in _TOKEN.finditer(stream):
        starts.append(m.start())
        ends.append(m.end())
        lows.append(m.group().lower())
    counts = dec.counts
    known = [x in counts for x in lows]
    gaps = [0] * len(lows)
    best: list[tuple] = [(0.0, -1, None)]
    for j, low in enumerate(lows):
        cost, change = dec.token(low, doubt)
        top = (best[j][0] + cost, j, change)
        kind = gaps[j] = _gap(stream, ends[j - 1], starts[j]) if j else 0
        if kind >= HYPHEN:
            got = dec.hyphened(stream[starts[j - 1]:ends[j - 1]], stream[starts[j]:ends[j]], kind == HYPHEN_LINE, doubt)
            if got:
                top = min((top[0] + APART, j, change), (best[j - 1][0] + got[0], j - 1, got[1]), key=lambda x: x[0])
        elif kind and (not (known[j] and known[j - 1]) or lows[j - 1] + low in counts) and _joinable(stream, starts, ends, j - 1, j):
            got = dec.joined((lows[j - 1], low), doubt)
            if got and best[j - 1][0] + got[0] < top[0]:
                top = (best[j - 1][0] + got[0], j - 1, got[1])
        if kind and j > 1 and gaps[j - 1] and (not (known[j] and known[j - 1] and known[j - 2]) or lows[j - 2] + lows[j - 1] + low in counts) and _joinable(stream, starts, ends, j - 2, j):
            got = dec.joined((lows[j - 2], lows[j - 1], low), doubt)
            if got and best[j - 2][0] + got[0] < top[0]:
                top = (best[j - 2][0] + got[0], j - 2, got[1])
        best.append(top)
    out, j = [], len(lows)
    while j > 0:
        _, i, change = best[j]
        if change:
            start, end = starts[i], ends[j - 1]
            words = change[0] or "".join(stream[starts[k]:ends[k]] for k in range(i, j))
            out.append((start, end, _alike(words, stream[start:end]) if change[0] else words, change[1], max(gaps[i + 1:j], default=0) > BLANK))
        j = i
    return out[::-1]


def _joinable(stream, starts, ends, i: int, j: int) -> bool:
    """Whether tokens i to j may be parts of one word: not tied to others by a sign, no capital inside."""
    if ends[j] < len(stream) and stream[ends[j]] in TIES or starts[i] and stream[starts[i] - 1] in TIES:
        return False
    return all(not stream[starts[k]].isupper() or stream[ends[i] - 1].isupper() for k in range(i + 1, j + 1))


def decode(text: str, conf: float | None, dec: Decoder) -> tuple[str, bool, bool]:
    """``(repaired stream, has broken words, has misread words)`` of one text."""
    stream = one_form(text)
    doubt = 1.0 if conf is None or conf >= 0.9 else 2.0
    out, at, broken, misread = [], 0, False, False
    for a, b, words, wrong, parted in segment(stream, dec, doubt):
        out += [stream[at:a], words]
        at = b
        misread |= wrong
        broken |= parted
    return "".join(out) + stream[at:], broken, misread


_ENDED = re.compile(r"[.!?。！？:][\"'”»’)\]]*$")
_LISTED = re.compile(r"(?:[•*–-]|\d+[.)])\s")
STUMP = 1.5  # cost of a paragraph of one line that ends no sentence


def paragraphs(lines: list[str]) -> list[str]:
    """Continuous paragraphs from the lines of a block, boundaries by dynamic programming.

    A boundary after a line costs little where the line ends a sentence, is
    short and the next begins with a capital or a list mark; joining across
    such a place, or parting in mid-sentence, costs much, and so does a line
    left alone. The state is whether the paragraph has one line so far, so the
    time grows with the lines. Every blank line parts.
    """
    text = [(i, x) for i, x in enumerate(x.strip() for x in lines) if x]
    if not text:
        return []
    usual = sorted(len(x) for _, x in text)[len(text) // 2]
    ended = [bool(_ENDED.search(x)) for _, x in text]
    one, more = (1.0, ()), (math.inf, ())  # cost and cuts so far; cuts as linked pairs
    for k in range(1, len(text)):
        (p, x), (q, y) = text[k - 1], text[k]
        join = (8.0 if q > p + 1 else 0.0) + (2.5 if ended[k - 1] and len(x) < 0.7 * usual and y[:1].isupper() else 0.0) + (6.0 if ended[k - 1] and _LISTED.match(y) else 0.0)
        part = 1.0 + (0.0 if ended[k - 1] or q > p + 1 else 4.0) + (0.0 if y[:1].isupper() or not y[:1].isalpha() else 4.0)
        stump = 0.0 if ended[k - 1] else STUMP
        closed = min((one[0] + stump, one[1]), more, key=lambda c: c[0])
        one, more = (closed[0] + part, (closed[1], k)), min((one[0] + join, one[1]), (more[0] + join, more[1]), key=lambda c: c[0])
    cuts, at = [len(text)], min((one[0] + (0.0 if ended[-1] else STUMP), one[1]), more, key=lambda c: c[0])[1]
    while at:
        at, k = at
        cuts.append(k)
    cuts = [0, *sorted(cuts)]
    return [" ".join(x for _, x in text[a:b]) for a, b in zip(cuts, cuts[1:])]


# ------------------------------------------------------------- page furniture

def _skeleton(line: Column) -> Column:
    """A line in a form that misread and true characters share, without page numbers."""
    t = F.lower(line)
    t = F.when(~t.rlike("[0-9]"), t).otherwise(F.regexp_replace(t, r"^\s*\d{1,4}\s{2,}|\s{2,}\d{1,4}\s*$|\s*\|\s*\d{1,4}\s*$|^\s*\d{1,4}\s*\|\s*", ""))
    t = F.translate(t, "!105@96cfh8", "ilosagbetbb")
    for seen, meant in (("ii", "u"), ("rn", "m"), ("in", "m"), ("li", "b"), ("el", "d"), ("vv", "w")):
        t = F.replace(t, F.lit(seen), F.lit(meant))
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def page_lines(blocks: DataFrame) -> DataFrame:
    """Every line of every block with its place on the page (``blocks``: distinct blocks
    with doc_id, block_id, page, bbox, block_type, text)."""
    lines = F.split(F.col("text"), r"\r?\n")
    y1, y2 = F.try_element_at("bbox", F.lit(2)), F.try_element_at("bbox", F.lit(4))
    return (blocks.filter(F.col("text").isNotNull())
            .select("doc_id", "block_id", "page", "block_type", (F.size(F.filter(lines, lambda x: x.rlike(r"\S"))) == 1).alias("alone"),
                    F.when(F.col("bbox").isNull(), F.lit(None).cast("boolean"))
                    .otherwise((y2 <= TOP * PAGE_HEIGHT) | (y1 >= BOTTOM * PAGE_HEIGHT)).alias("margin"),
                    F.posexplode(lines).alias("line_no", "line"))
            .filter(F.col("line").rlike(r"\S")))


def furniture(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_id, line_no, noise`` of header and footer lines and page numbers.

    A running line is one that stands in the margin of a page and recurs, apart
    from its number and misread characters, on another page of its document;
    then its copies inside blocks are running lines too, but no title on the
    first page. A dressed number on a line of its own is a page number; a bare
    one is so in the margin, or elsewhere if it keeps the document's distance
    between printed and physical page.
    """
    lines = cut(page_lines(blocks).withColumn("dressed", F.col("line").rlike(DRESSED)).withColumn("bare", F.col("line").rlike(PLAIN))
                .withColumn("roman", F.when(F.col("alone") & F.coalesce("margin", F.lit(False)), F.lower("line").rlike(ROMAN)).otherwise(False))
                .withColumn("number", F.when(F.col("dressed") | F.col("bare") | F.col("roman"), F.regexp_extract("line", r"(\d+)", 1).try_cast("int")))
                .withColumn("key", F.when(~(F.col("dressed") | F.col("bare") | F.col("roman")), _skeleton(F.col("line")))))
    is_number = F.col("dressed") | F.col("bare") | F.col("roman")
    edge = F.col("block_type").isin("header", "footer")
    # Page numbers.
    placed = lines.filter(is_number)
    sure = placed.filter(F.col("alone") & F.col("margin") & F.col("number").isNotNull())
    offsets = (sure.groupBy("doc_id", (F.col("number") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"))
               .groupBy("doc_id").agg(F.max_by("offset", F.struct("n", "offset")).alias("offset")))
    numbered = placed.join(offsets, "doc_id", "left")
    fits = F.coalesce(F.col("number") - F.col("page") == F.col("offset"), F.lit(False))
    at_edge = F.col("alone") & (F.coalesce("margin", F.lit(False)) | F.col("margin").isNull() & (edge | fits))
    numbers = (numbered.filter(F.col("dressed") & (at_edge | ~F.col("alone") | F.col("margin").isNull() | fits)
                               | F.col("bare") & (at_edge | ~F.col("alone") & fits) | F.col("roman"))
               .select("doc_id", "block_id", "line_no", F.lit("page_number").alias("noise")))
    # Running lines.
    texts = lines.filter(~is_number & (F.length("key") >= 4))
    keys = (texts.filter(F.col("alone")).groupBy("doc_id", "key", "page").agg(F.max((F.coalesce("margin", F.lit(False))).cast("int")).alias("m"), F.count("*").alias("n"))
            .groupBy("doc_id", "key").agg(F.count("*").alias("pages"), F.sum("m").alias("margin_pages"), F.sum("n").alias("n"))
            .filter("margin_pages >= 1 and pages >= 2 and margin_pages * 2 >= pages"))
    uses = texts.groupBy("doc_id", "key").agg(F.count("*").alias("uses"))
    keys = keys.join(uses, ["doc_id", "key"]).select("doc_id", "key", "uses")
    total = texts.agg(F.count("*").alias("_all"))
    running = join_lookup(texts, keys.crossJoin(F.broadcast(total)), ["doc_id", "key"], F.col("uses"), F.col("_all"))  # total: one row
    running = running.filter(~(F.col("alone") & ~F.coalesce("margin", F.lit(True)))
                             & ~(F.col("alone") & F.col("margin").isNull() & (F.col("page") == 0) & (F.col("block_type") == "title")))
    return numbers.unionByName(running.select("doc_id", "block_id", "line_no", F.lit("running_line").alias("noise")))


def _distinct(blocks: DataFrame) -> DataFrame:
    """One row a block: repeated rows are dropped, the first of differing ones (by text) stays."""
    b = blocks.select("doc_id", "block_id", "page", "bbox", "block_type", "text", "rec_conf")
    return b.groupBy("doc_id", "block_id").agg(F.min_by(F.struct("page", "bbox", "block_type", "text", "rec_conf"),
                                                        F.struct(F.col("text").isNull(), "text", "page")).alias("b")).select("doc_id", "block_id", "b.*")


_DECODERS: dict[int, Decoder] = {}


def _decoder(shared) -> Decoder:
    """The decoder of a lexicon, kept by a worker for the tasks that follow."""
    if id(shared.value) not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[id(shared.value)] = Decoder(shared.value)
    return _DECODERS[id(shared.value)]


def _kernel(spark, counts):
    shared = spark.sparkContext.broadcast(counts)  # at most 1 / share words, see lexicon()

    def run(batches):
        dec = _decoder(shared)
        for b in batches:
            texts, confs = b.column(2).to_pylist(), b.column(3).to_pylist()
            skip = b.column(4).to_pylist()
            cols = ([], [])
            for i, (t, c) in enumerate(zip(texts, confs)):
                lines = re.split(r"\r?\n", t)
                drop = set(skip[i] or ())
                body = "\n".join(x for k, x in enumerate(lines) if k not in drop)
                _, broken, misread = decode(body, c, dec)
                if drop:  # furniture is read too, but does not stand between the lines around it
                    misread |= any(decode(lines[k], c, dec)[2] for k in drop if k < len(lines))
                cols[0].append(broken)
                cols[1].append(misread)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.bool_())],
                                             names=["doc_id", "block_id", "hyphen", "misread"])

    return run


def _with_furniture(blocks: DataFrame):
    base = cut(_distinct(blocks))
    lines = cut(furniture(base))
    per = lines.groupBy("doc_id", "block_id").agg(F.collect_set("line_no").alias("skip"))
    texts = base.filter(F.col("text").rlike(r"\S")).join(per, ["doc_id", "block_id"], "left").select("doc_id", "block_id", "text", "rec_conf", "skip")
    # Decoding is Python work: enough tasks for all slots, and no task of more than some 20,000 blocks.
    tasks = max(2 * blocks.sparkSession.sparkContext.defaultParallelism, base.count() // 20_000)
    return base, lines, texts.repartition(tasks)


def noise(blocks: DataFrame) -> DataFrame:
    """Distinct ``doc_id, block_id, noise``: hyphen, misread, running_line, page_number.

    Null and blank texts give no rows; a null rec_conf is read as sure; a null
    bbox is placed by its type and its page's numbering; a block given twice
    counts once. An empty table gives no rows. Other columns are not read.
    """
    base, lines, texts = _with_furniture(blocks)
    kinds = T.StructType([base.schema["doc_id"], base.schema["block_id"], T.StructField("hyphen", T.BooleanType()), T.StructField("misread", T.BooleanType())])
    found = texts.mapInArrow(_kernel(blocks.sparkSession, lexicon(base)), kinds)
    words = found.select("doc_id", "block_id", F.explode(F.array_compact(F.array(F.when(F.col("hyphen"), F.lit("hyphen")),
                                                                                F.when(F.col("misread"), F.lit("misread"))))).alias("noise"))
    return words.unionByName(lines.select("doc_id", "block_id", "noise")).distinct()


def repaired(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_id, paragraph_no, paragraph``: continuous readable paragraphs, without
    lines that belong to the page only, words mended. Blocks of furniture only give no row."""
    base, _, texts = _with_furniture(blocks)
    shared = blocks.sparkSession.sparkContext.broadcast(lexicon(base))  # at most 1 / share words

    def run(batches):
        dec = _decoder(shared)
        for b in batches:
            take, no, text = [], [], []
            for i, (t, c, s) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))):
                drop = set(s or ())
                lines = [x for k, x in enumerate(re.split(r"\r?\n", t)) if k not in drop]
                # Words are joined over the whole stream first; line ends that remain part paragraphs.
                stream = decode("\n".join(lines), c, dec)[0]
                for k, p in enumerate(paragraphs(re.split(r"\r?\n", stream))):
                    take.append(i)
                    no.append(k)
                    text.append(p)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(text, pa.string())],
                                             names=["doc_id", "block_id", "paragraph_no", "paragraph"])

    kinds = T.StructType([base.schema["doc_id"], base.schema["block_id"], T.StructField("paragraph_no", T.IntegerType()), T.StructField("paragraph", T.StringType())])
    return texts.mapInArrow(run, kinds)
