"""Split oversized texts at natural boundaries, consecutive pieces overlapping.

Every token end of a text is a possible boundary. Each is joined to its
farthest legal successor (the last natural boundary whose piece, overlap
included, stays within the limit), the successor table is squared again and
again, and the boundaries reached from the start are all the cuts: after k
squarings 2**k of them are known. The tables are numpy arrays of one text, so
a text is cut in a logarithmic number of vector steps in the task that holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import SPLIT_PATTERN, TOKENIZER, load
from quire.session import spread

LIMIT, OVERLAP = 1024, 64
LONG_RUN = 256  # bytes a run may grow by when it is tokenized anew before its word boundaries are looked up

_KIND = np.full(256, 3, np.uint8)  # other
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = 2
_KIND[128:] = 2
_WORDS = regex.compile(SPLIT_PATTERN)
_STOP, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSE[list(b"\"')]")] = True
_CJK_STOPS = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xef\xbc\x9b")  # ideographic full stop, !, ?, ;


def boundaries(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Rank of each token end: 3 line end, 2 sentence end, 1 between words, 0 inside a
    word, -1 inside a character."""
    raw = np.frombuffer(data + b"\n\n", np.uint8)
    prev, nxt, nxt2 = raw[ends - 1], raw[ends], raw[np.minimum(ends + 1, len(raw) - 1)]
    rank = np.where((nxt & 0xC0) == 0x80, -1, 0).astype(np.int8)
    space_next, space_prev = _KIND[nxt] == 0, _KIND[prev] == 0
    rank[(rank == 0) & (space_next | space_prev)] = 1
    stop = _STOP[prev]
    stop |= _CLOSE[prev] & _STOP[raw[np.maximum(ends - 2, 0)]]
    wide = np.flatnonzero((prev >= 0x80) & (rank >= 0))
    wide = wide[ends[wide] >= 3]
    if len(wide):
        e = ends[wide]
        three = raw[e - 3].astype(np.int64) << 16 | raw[e - 2].astype(np.int64) << 8 | raw[e - 1]
        rank[wide[np.isin(three, [int.from_bytes(s, "big") for s in _CJK_STOPS])]] = 2
    rank[(rank >= 0) & stop & space_next] = 2
    rank[(rank >= 0) & ((prev == 10) | ((nxt == 10) & (nxt2 == 10)))] = 3
    rank[-1] = 3
    return rank


def word_starts(text: str) -> np.ndarray:
    """Byte offsets at which the tokenizer starts a new word, whatever stands before it."""
    sizes = np.fromiter((len(m.encode("utf-8", "surrogatepass")) for m in _WORDS.findall(text)), np.int64)
    return np.cumsum(sizes)


def successors(data: bytes, ends: np.ndarray, limit: int, overlap: int, text: str | None = None):
    """``(nxt, begin)``: the farthest legal cut after each boundary, and where the
    piece that starts there begins. Boundary i lies before token i; n is the end.
    ``None`` where a run without any boundary has tokens so long that no bound of
    its size allows a step."""
    n = len(ends)
    rank = np.concatenate([[3], boundaries(data, ends)])  # rank of boundary i
    pos = np.concatenate([[0], ends])
    node = np.arange(n + 1)
    # Overlap: exactly `overlap` tokens back, or a token or two more inside a character.
    whole = np.where(rank >= 0, node, 0)
    last_whole = np.maximum.accumulate(whole)
    begin = last_whole[np.maximum(node - overlap, 0)]
    begin[0] = 0
    # A piece that begins inside a word may tokenize longer there: at most one token a byte.
    raw = np.frombuffer(data, np.uint8)
    at = np.minimum(pos, len(raw) - 1)
    here, back = raw[at], raw[np.maximum(at - 1, 0)]
    sure = (_KIND[here] != _KIND[back]) & (back != 39) & (here != 39) & (_KIND[back] != 0)
    sure[0] = sure[-1] = True

    def growth():
        next_sure = np.minimum.accumulate(np.where(sure, node, n)[::-1])[::-1]
        return np.where(sure, 0, (pos[next_sure] - pos) - (next_sure - node))[begin]

    grow = growth()
    if grow.max(initial=0) > LONG_RUN:  # scripts without blanks: look the words up
        sure |= np.isin(pos, word_starts(text if text is not None else data.decode("utf-8", "replace"))) & (_KIND[back] != 0)
        grow = growth()
    # Within a longer run a piece of at most `limit` bytes has at most `limit` tokens.
    reach = np.maximum(begin + limit - grow, np.searchsorted(pos, pos[begin] + limit, "right") - 1)
    nxt = np.full(n + 1, -1)
    for least in (2, 1, 0):
        legal = node[rank >= least]
        far = legal[np.searchsorted(legal, reach, "right") - 1]
        nxt = np.where((nxt < 0) & (far > node), far, nxt)
    nxt = np.where(reach >= n, n, nxt)
    nxt[n] = n
    if (nxt < 0).any():
        return None
    return nxt, begin


def cuts_by_doubling(nxt: np.ndarray) -> np.ndarray:
    """All boundaries on the way from 0, by squaring the successor table."""
    end = len(nxt) - 1
    known, jump = np.array([0]), nxt
    while known[-1] != end:
        known = np.unique(np.concatenate([known, jump[known]]))
        jump = jump[jump]
    return known


def split_text(text: str, enc, size, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of one text as ``(first byte, byte after the last, tokens)``; one piece if it fits."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return []
    ids = np.asarray(enc.encode_ordinary(text), np.int64)
    ends = np.cumsum(size[ids])
    if len(ids) <= limit:
        return [(0, len(data), len(ids))]
    found = successors(data, ends, limit, overlap, text)
    if found is None:
        return _measured(data, ends, enc, limit, overlap)
    nxt, begin = found
    cuts = cuts_by_doubling(nxt)
    pos = np.concatenate([[0], ends])
    return [(int(pos[begin[a]]), int(pos[b]), int(b - begin[a])) for a, b in zip(cuts[:-1], cuts[1:])]


def _measured(data: bytes, ends: np.ndarray, enc, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """For texts with runs of signs whose tokens are so long that ``overlap`` of them fill a piece
    of ``limit`` bytes: cut by cut, each piece's size measured."""
    rank = np.concatenate([[3], boundaries(data, ends)])
    pos = np.concatenate([[0], ends])
    n, at, out = len(ends), 0, []
    while at < n:
        b = max(at - overlap, 0)
        while rank[b] < 0:
            b -= 1
        reach = min(n, b + limit)
        while True:
            stop = reach if reach == n else -1
            for least in (2, 1, 0):
                if stop < 0:
                    near = np.flatnonzero(rank[at + 1:reach + 1] >= least)
                    stop = at + 1 + int(near[-1]) if len(near) else -1
            if stop < 0:  # one character of more tokens than are left
                stop = at + 1
                while stop < n and rank[stop] < 0:
                    stop += 1
            size = len(enc.encode_ordinary(data[pos[b]:pos[stop]].decode("utf-8", "replace")))
            if size <= limit or reach <= at + 1:
                break
            reach = max(at + 1, min(reach, stop) - (size - limit))
        out.append((int(pos[b]), int(pos[stop]), size))
        at = stop
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP,
                    tokenizer: str = TOKENIZER, with_text: bool = True) -> DataFrame:
    """Pieces of every text: ``key, piece_no, n_pieces, first_byte, end_byte, tokens[, piece]``.

    Pieces have at most ``limit`` tokens and each begins ``overlap`` tokens
    before its predecessor's end (a token or two more where that would fall
    inside a character). Texts within the limit give one piece; null and empty
    texts give none; repeated rows give repeated pieces. Cuts fall at line or
    sentence ends, else between words, else between characters. Offsets are
    bytes of UTF-8. Other columns of ``df`` are not read.
    """
    src = spread(df.select(F.col(key), F.col(text).alias("_text")).filter(F.length("_text") > 0))
    kind = df.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, piece_no int, n_pieces int, first_byte bigint, end_byte bigint, tokens int"
    ddl += ", piece string" if with_text else ""

    def run(batches):
        enc, size = load(tokenizer)
        for b in batches:
            take, cols = [], [[], [], [], [], []]
            texts = []
            for row, t in enumerate(b.column(1).to_pylist()):
                pieces = split_text(t, enc, size, limit, overlap)
                raw = t.encode("utf-8", "surrogatepass") if with_text else b""
                for no, (a, z, n) in enumerate(pieces):
                    take.append(row)
                    for c, v in zip(cols, (no, len(pieces), a, z, n)):
                        c.append(v)
                    if with_text:
                        texts.append(raw[a:z].decode("utf-8", "replace"))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            arrays = [b.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            names = [key, "piece_no", "n_pieces", "first_byte", "end_byte", "tokens"]
            if with_text:
                arrays.append(pa.array(texts, pa.string()))
                names.append("piece")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return src.mapInArrow(run, ddl)


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP,
              tokenizer: str = TOKENIZER) -> DataFrame:
    """Keys of the texts that have to be cut. A text of at most ``limit`` bytes has at
    most ``limit`` tokens in a byte-level vocabulary, so it is passed by unread."""
    long = df.filter(F.octet_length(text) > limit)
    pieces = split_oversized(long, key, text, limit, overlap, tokenizer, with_text=False)
    return pieces.filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select(key).distinct()
