"""Held-out evaluation passages inside a training corpus.

One Aho-Corasick automaton over the short word runs of all passages, built once and
sent to the tasks, scans every document once. Its hits name a passage and a diagonal (place in the document
less place in the passage); along each diagonal the passage is compared word by
word, matching runs are chained over replaced, misread, split and merged words,
and chains that are long and dense enough, or pieces that together make up the
passage, are leaks. Word places are mapped back to offsets of the original text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.lookalike import one_form
from quire.session import cut, spread

SEED = 4  # words a run of the automaton
RUN = 16  # running words that make a leak
EDGE = 2  # replaced words that may stand at the two ends of such a run
DENSITY = 0.8  # share of words that match: about one in seven differs, unevenly spread
# Bits by which a run must speak for a quotation against a chance meeting in a stock frame.
SURE = 14.0
REPLACED = 1 / 7  # chance that a quoted word is replaced or misread
MATCHED = 13  # words of such a run that match: sixteen less about one in seven
WHOLE = 0.75  # share of a passage that its pieces must make up
BLOCK_ITEMS = 20_000  # items of an automaton, roughly: larger sets are scanned in blocks

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_WORDS = re.compile(r"[^\W_]+")


_IRREGULAR = re.compile("[\u00a0\u00aa\u00ad\u00ba\u017f\u0300-\u03ff\u0400-\u052f\u1680\u180e\u2000-\u200f\u202a-\u202f\u205f-\u2064\u2100-\u214f"
                        "\u3000\ufb00-\ufb06\ufeff\uff10-\uff5a\U0001d400-\U0001d7ff]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u00ac\u2010][ \t]*\r?\n[ \t>]*(?=[^\W\d_A-Z])")
_HAN = re.compile("[\u4e00-\u9fff]")


def words_of(text: str) -> list[str]:
    """Words in lower case: words broken at line ends joined, character forms made one,
    signs off, Han characters one by one. Texts without irregular characters, found by
    one fast search, skip the slow folding."""
    if not text.isascii() and _IRREGULAR.search(text):
        text = one_form(text)
    if "-" in text or "\u00ac" in text or "\u2010" in text:
        text = _BROKEN.sub("", text)
    words = _WORDS.findall(text.lower())
    return _han(words) if not text.isascii() and _HAN.search(text) else words


def _han(words: list[str]) -> list[str]:
    out = []
    for w in words:
        out += re.findall(r"[\u4e00-\u9fff]|[^\u4e00-\u9fff]+", w) if not w.isascii() else [w]
    return out


def passages(items: DataFrame, item: str, passage: str) -> DataFrame:
    """``i, words`` of each item's passage without stock sentences (those of two or more items).
    A passage that several items share as a whole is theirs, not a stock sentence.
    Null items and passages, and passages without a word of their own, give no row."""
    kind = items.schema[item].dataType.simpleString()

    def sentences(batches):
        for b in batches:
            take, cols = [], ([], [], [])
            for n, p in enumerate(b.column(1).to_pylist()):
                for no, words in enumerate([words_of(s) for s in _SENTENCE.split(p) if s and s.strip()]):
                    take.append(n)
                    for c, v in zip(cols, (p, no, words)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.list_(pa.string()))], names=["i", "p", "no", "words"])

    src = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).filter("i is not null and p is not null").distinct()
    parts = src.mapInArrow(sentences, f"i {kind}, p string, no int, words array<string>").withColumn("key", F.array_join("words", " ")).filter("key <> ''")
    parts = cut(parts)
    stock = parts.groupBy("key").agg(F.count_distinct("i").alias("n")).filter("n > 1").select("key", F.lit(True).alias("stock"))
    shared = src.groupBy("p").agg(F.count_distinct("i").alias("n")).filter("n > 1").select("p", F.lit(True).alias("shared"))
    kept = parts.join(stock, "key", "left").join(shared, "p", "left").filter("stock is null or shared")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", "words"))), lambda x: x["words"])
    return kept.groupBy("i", "p").agg(F.flatten(ordered).alias("words")).select("i", "words")


def information(items) -> list[tuple[list[float], list[float]]]:
    """For each item, what each word of its passage speaks for a quotation, in bits: if it matches, and if it differs.

    A word that its neighbours foretell, as other passages show, belongs to a
    stock frame: that it matches says little, that it differs is no sign of the
    frame. Any other word counts by its rarity.
    """
    words = Counter(x for _, w in items for x in w)
    total = sum(words.values()) + 1
    known, pairs = Counter(), Counter()
    sides = (-2, -1, 1, 2)
    contexts = []
    for _, w in items:
        n = len(w)
        own = {(i, e): (e, w[i + e]) for i in range(n) for e in sides if 0 <= i + e < n}
        contexts.append(own)
        known.update(set(own.values()))  # passages count, not places
        pairs.update({(c, w[i]) for (i, _), c in own.items()})
    out = []
    for (_, w), own in zip(items, contexts):
        match, differ = [], []
        for i, x in enumerate(w):
            bits = np.log2(total / words[x])
            for e in sides:
                c = own.get((i, e))
                if c is not None and pairs[c, x] > 1:  # seen in other passages too
                    bits = min(bits, np.log2((known[c] - 1) / (pairs[c, x] - 1)))
            match.append(float(bits + np.log2(1 - REPLACED)))
            differ.append(float(np.log2(REPLACED) - np.log2(max(1 - 2.0 ** -bits, 0.125))))
        out.append((match, differ))
    return out


def _automaton(items):
    """Runs of ``SEED`` words of all passages, shorter passages whole, each with its places ``(item, word, length)``."""
    import ahocorasick

    grams = defaultdict(list)
    for k, (_, w) in enumerate(items):
        n = min(SEED, len(w))
        for i in range(len(w) - n + 1):
            grams[f" {' '.join(w[i:i + n])} "].append((k, i, n))
    a = ahocorasick.Automaton()
    for g, at in grams.items():
        a.add_word(g, at)
    if len(a):
        a.make_automaton()
    return a if len(a) else None


def _runs(p: list[str], w: list[str], diagonal: int) -> list[tuple[int, int, int]]:
    """Matching runs ``(first passage word, last, diagonal)`` along a diagonal."""
    lo, hi = max(0, -diagonal), min(len(p), len(w) - diagonal)
    out, start = [], None
    for i in range(lo, hi):
        if p[i] == w[i + diagonal]:
            start = i if start is None else start
        elif start is not None:
            out.append((start, i - 1, diagonal))
            start = None
    if start is not None:
        out.append((start, hi - 1, diagonal))
    return out


def _chains(runs: list[tuple[int, int, int]], match, differ) -> list[tuple[int, int, int, int, int, float]]:
    """Runs linked over at most three differing words and a shift of at most two places: the
    densest chain ending at each run, from each of its runs on, as ``(first, last, matched, doc first, doc last, bits)``."""
    best: dict[tuple[int, int], tuple] = {}  # by last word and diagonal, which name one run
    out = []
    for a, b, d in sorted(runs):
        n = b - a + 1
        score, before = -math.inf, None
        for last in range(a - 4, a):
            for dd in range(d - 2, d + 3):
                x = best.get((last, dd))
                if x is not None and a + d > last + dd:
                    s = x[0] + n - 1.5 * max(a - last - 1, 1) - abs(d - dd)
                    if s > score:
                        score, before = s, x
        at = best[b, d] = (max(score, float(n)), a, b, d, before)
        matched, bits, end = 0, 0.0, b
        while at is not None:
            _, first, last, dd, at = at
            matched += last - first + 1
            bits += match[last + 1] - match[first] + differ[end] - differ[min(last + 1, end)]
            out.append((first, b, matched, first + dd, b + d, bits))
            end = first
            if matched + first < DENSITY * (b + 1):  # not dense enough even if all words before match
                break
    return out


def leaks(w: list[str], items, automaton, bits=None) -> list[tuple[int, int, int, int]]:
    """``(index of item, matched words, first word, last word)`` of the leaks in a text of the words ``w``."""
    hits = list(automaton.iter(f" {' '.join(w)} "))
    if not hits:
        return []
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)  # blank behind each word
    at = np.searchsorted(ends, np.fromiter((h[0] for h in hits), np.int64, len(hits))) + 1
    seen: dict[int, set[int]] = defaultdict(set)
    for (_, where), word in zip(hits, at.tolist()):
        for k, i, n in where:
            seen[k].add(word - n - i)
    out = []
    for k, diagonals in seen.items():
        p = items[k][1]
        if len(p) < SEED:  # short passages leak whole or not at all
            out.append((k, len(p), min(diagonals), min(diagonals) + len(p) - 1))
            continue
        found = _judge(p, w, diagonals, bits and bits[k])
        if found:
            out.append((k, *found))
    return out


def _sums(values) -> list[float]:
    return [0.0, *accumulate(values)]


def _judge(p, w, diagonals, bits=None):
    near = {e for d in diagonals for e in (d - 2, d - 1, d, d + 1, d + 2)}
    runs = [r for d in near for r in _runs(p, w, d) if r[1] - r[0] >= 1 or d in diagonals]
    need = min(RUN, len(p)) - EDGE
    matched = sum(b - a + 1 for a, b, _ in runs)
    # No chain has more matching words than all runs have, nor do pieces cover more than those allow.
    if matched < min(max(min(MATCHED, need), DENSITY * need), DENSITY * WHOLE * len(p)):
        return None
    match, differ = map(_sums, bits or ([1.0] * len(p), [0.0] * len(p)))
    sure = SURE if bits else 0.0
    chains = [c for c in _chains(runs, match, differ) if c[2] >= DENSITY * (c[1] - c[0] + 1)]
    good = [c for c in chains if c[1] - c[0] + 1 >= need and c[2] >= min(MATCHED, need) and (c[5] >= sure or RUN <= c[2] == c[1] - c[0] + 1)]
    if good:
        c = min(good, key=lambda c: (-c[2], c[3]))
        return c[2], c[3], c[4]
    # The whole passage in pieces: chains of a few words that say more than a choice among the places of the text.
    least = math.log2(len(w)) if bits else 0.0
    parts = sorted((c for c in chains if c[2] >= 5 and c[5] >= least), key=lambda c: c[3])
    if len(set().union(*(range(c[0], c[1] + 1) for c in parts))) < WHOLE * len(p):
        return None
    # The shortest stretch of the text that holds enough of them.
    held, covered, x, stretch = Counter(), 0, 0, None
    for y, c in enumerate(parts):
        for i in range(c[0], c[1] + 1):
            held[i] += 1
            covered += held[i] == 1
        while covered >= WHOLE * len(p):
            size = max(q[4] for q in parts[x:y + 1]) - parts[x][3]
            if stretch is None or size < stretch[0]:
                stretch = size, covered, parts[x][3], parts[x][3] + size
            for i in range(parts[x][0], parts[x][1] + 1):
                held[i] -= 1
                covered -= held[i] == 0
            x += 1
    return stretch[1:]


def word_offsets(original: str) -> list[tuple[int, int]]:
    """Start and end of each word of ``original``, as ``words_of`` splits it."""
    out = []
    skip = "­᠎​-‏‪-‮⁠-⁤﻿̀-ͯ"
    for m in re.finditer(rf"[^\W_](?:[^\W_]|[{skip}]|[-¬‐][ \t]*\r?\n[ \t>]*(?=[^\W\d_A-Z]))*", original):
        a = m.start()
        for part in re.finditer(r"[一-鿿]|[^一-鿿]+", m.group()):
            out.append((a + part.start(), a + part.end()))
    return out


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, offsets: bool = True) -> DataFrame:
    """``key, item, matched_words, start_char, end_char`` of the passages that documents carry.

    A document carries a passage if at least sixteen running words of it, or
    the whole of it in one or more pieces, stand in the document, with up to
    about one word in seven different. Null and empty texts and passages give
    nothing; repeated documents are all reported; items of one passage are all
    reported. Offsets count characters of the original text, and are null where
    its words cannot be mapped. ``items`` is the query set: its passages are
    gathered and scanned in blocks of some ``BLOCK_ITEMS``; documents stay where they are.
    """
    spark = docs.sparkSession
    known = cut(passages(items, item, passage))
    blocks = -(-known.count() // BLOCK_ITEMS)
    src = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0))
    kinds = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, items.schema[item].dataType),
                          T.StructField("matched_words", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    out = spark.createDataFrame([], kinds)
    id_type = pa.int64() if isinstance(items.schema[item].dataType, T.LongType) else pa.int32() if isinstance(items.schema[item].dataType, T.IntegerType) else pa.string()
    for n in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n).collect()  # some BLOCK_ITEMS passages
        mine = sorted(((r.i, list(r.words)) for r in rows), key=lambda x: (str(x[0]), x[1]))
        shared = spark.sparkContext.broadcast((mine, _automaton(mine), information(mine)))

        def scan(batches, shared=shared):
            mine, automaton, bits = shared.value
            for b in batches:
                take, cols = [], ([], [], [], [])
                texts = b.column(1)
                for i in range(b.num_rows):
                    original = texts[i].as_py()
                    found = leaks(words_of(original), mine, automaton, bits) if automaton else []
                    if not found:
                        continue
                    places = word_offsets(original) if offsets else []
                    for k, m, first, last in found:
                        ok = last < len(places)
                        take.append(i)
                        for c, v in zip(cols, (mine[k][0], m, places[first][0] if ok else None, places[last][1] if ok else None)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()),
                                                  pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                                                 names=[key, item, "matched_words", "start_char", "end_char"])

        part = src.mapInArrow(scan, kinds)
        out = part if n == 0 else out.unionByName(part)
    return out
