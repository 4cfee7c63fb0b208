"""Byte-level BPE encoding and decoding with a public rank file.

A text is cut into the pattern's pieces and each piece's bytes are folded by the merge of
least rank until none applies.  A worker folds the new distinct pieces of some texts together
and keeps their ids in tables of bounded size, so encoding needs no shuffle.  Decoding
concatenates the ids' binary pieces.

`fold_words` is the same fold in Spark's higher-order functions over a frame of distinct
words; README.md says why whole corpora don't go that way.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, short_batches

#: Distinct pieces in each of a worker's two generations of folded pieces.
CACHE = 150_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines: a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank merges, leftmost first.

    Parts are linked by their ends and pairs wait in a heap, so n bytes take n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        # A pair is stale if its left part is gone or either part has grown since.
        j = stop[i]
        if not j or j >= n or stop[j] != end:
            continue
        stop[i], stop[j] = end, 0
        if end < n:
            before[end] = i
        for left in (before[i], i):
            if left >= 0 and stop[left] < n:
                right = stop[stop[left]]
                r = ranks.get(piece[left:right])
                if r is not None:
                    heappush(heap, (r, left, right))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class _Merges:
    """The fold of many pieces at once: a numpy row a piece, a merge a row a step.

    A merge of two tokens is known by their ids; the table holds each cut of a token into two.
    """

    NONE = np.int64(1 << 40)
    #: Bytes of padded pieces folded together, and the longest piece folded this way.
    CELLS, LONG = 1 << 17, 256

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        cuts = ((ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t)))
        table = np.array([(a << 32 | b, r) for a, b, r in cuts if a is not None and b is not None] or [(-1, 0)], dtype=np.int64)
        self.keys, self.values = table[table[:, 0].argsort()].T.copy()
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)

    def fold(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian ids of each piece."""
        out, rest = {}, []
        for piece in set(pieces):
            if piece in self.ranks or len(piece) > self.LONG:
                ids = fold(piece, self.ranks)
                out[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(piece)
        rest.sort(key=len)
        while rest:
            n = max(1, self.CELLS // len(rest[-1]))
            out.update(self._block(rest[-n:]))
            del rest[-n:]
        return out

    def _block(self, pieces: list[bytes]):
        width = len(pieces[-1])
        sizes = np.array([len(p) for p in pieces])
        parts = self.byte[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(-1, width)
        pairs = np.full(parts.shape, self.NONE)
        r, c = np.nonzero(np.arange(1, width)[None, :] < sizes[:, None])
        pairs[r, c] = self.rank(parts[r, c], parts[r, c + 1])
        place, live = np.arange(width), np.arange(len(pieces))
        while len(live):
            at = pairs[live].argmin(1)
            best = pairs[live, at]
            go = best < self.NONE
            live, at, best = live[go], at[go], best[go]
            move = np.minimum(place + (place > at[:, None]), width - 1)
            p, q = np.take_along_axis(parts[live], move, 1), np.take_along_axis(pairs[live], move, 1)
            sizes[live] -= 1
            row = np.arange(len(live))
            p[row, at] = best
            q[row, at] = self.NONE
            for k, on in ((at, at + 1 < sizes[live]), (at - 1, at > 0)):
                i, j = row[on], k[on]
                q[i, j] = self.rank(p[i, j], p[i, j + 1])
            parts[live], pairs[live] = p, q
        raw, step = parts.astype("<u4").tobytes(), 4 * width
        return ((piece, raw[i * step : i * step + 4 * n]) for i, (piece, n) in enumerate(zip(pieces, sizes.tolist(), strict=True)))


def _cutter(pattern: str):
    """findall of the pattern: by re for texts below U+0250 where it can be said there (twice as fast), else by regex."""
    import regex

    full = regex.compile(pattern).findall
    if regex.search(r"\\(?!p\{[LN]\}|[sS])|\(\?(?![!=:])|&&|\[\[", pattern):
        return full
    below = [chr(i) for i in range(0x250)]
    sets = {x: "".join(re.escape(c) for c in below if regex.fullmatch(x, c)) for x in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside = "", False
    for token in regex.findall(r"\\p\{.\}|\\.|.", pattern):
        inside = token == "[" or (inside and token != "]")
        out += token if token not in sets else sets[token] if inside else f"[{sets[token]}]"
    narrow, wide = re.compile(out).findall, re.compile("[^\0-\u024f]").search
    return lambda text: full(text) if wide(text) else narrow(text)


class _Pieces:
    """Little-endian ids of pieces, each folded when first met.

    A full table becomes the old generation, from which pieces in use come back.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.cut, self.ids, self.old = _Merges(ranks), _cutter(pattern), {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts' new pieces are folded together."""
        cut = [self.cut(x) for x in texts]
        pieces = set().union(*cut)
        new = pieces - self.ids.keys()
        if len(self.ids) + len(new) > CACHE:
            self.old, self.ids, new = self.ids, {}, pieces
        for piece in new & self.old.keys():
            self.ids[piece] = self.old[piece]
        names = list(new - self.ids.keys())
        raw = [x.encode() for x in names]
        folded = self.merges.fold(raw)
        self.ids.update(zip(names, map(folded.__getitem__, raw), strict=True))
        return [b"".join(map(self.ids.__getitem__, x)) for x in cut]


def _groups(texts, chars: int = 1 << 20):
    """Runs of texts of some characters in all; a longer text is a run alone."""
    group, n = [], 0
    for text in texts:
        if group and n + len(text) > chars:
            yield group
            group, n = [], 0
        group.append(text)
        n += len(text)
    if group:
        yield group


#: The last tables used in this worker, by broadcast id; tasks after the first find them filled.
_kept: dict[int, _Pieces] = {}


def _pieces(key: int, ranks: dict[bytes, int], pattern: str) -> _Pieces:
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Pieces(ranks, pattern)
    return _kept[key]


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ids_col, the ids of each text as binary, four little-endian bytes an id.

    No special tokens: their strings are ordinary text.  Null text encodes as empty; very long
    texts and pieces are whole, a piece of n bytes taking n log n steps; a column called
    ids_col is replaced; each row gives one; empty: empty.  The rank table has a fixed size (that of
    the vocabulary) and is broadcast.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop(ids_col)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    number = uuid.uuid4().int

    def run(batches):
        pieces = _pieces(number, shared.value, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            ids = [x for group in _groups(t.as_py() or "" for t in texts) for x in pieces.encode(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, ids_col])

    return docs.mapInArrow(run, extended(docs.schema, f"`{ids_col}` binary"))


def bpe_decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds bytes_col, the concatenated binary pieces of each row's ids (null: null).

    An id outside the vocabulary is an error.  A column called bytes_col is replaced.
    """
    tokens = tokens.drop(bytes_col)
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        pieces = [b""] * (max(shared.value.values(), default=-1) + 1)
        for token, rank in shared.value.items():
            pieces[rank] = token
        table, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces], np.int64)
        starts = sizes.cumsum() - sizes

        def text(raw: bytes) -> bytes:
            ids, out = np.frombuffer(raw, "<u4"), []
            for i in range(0, len(ids), 1 << 16):
                some = ids[i : i + (1 << 16)]
                n = sizes[some]
                ends = n.cumsum()
                out.append(table[np.repeat(starts[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
            return b"".join(out)

        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col))
            out = [text(x.as_py()) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, bytes_col])

    return tokens.mapInArrow(run, extended(tokens.schema, f"`{bytes_col}` binary"))


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", ids_col: str = "ids") -> DataFrame:
    """Adds ids_col (array of int) to a frame of distinct words, in higher-order functions only.

    The rank map is a literal: an array of small maps by a hash of the token, so that a
    lookup reads one map.  Each fold step merges the leftmost pair of least rank.
    """
    size = 1 << 16
    buckets: list[list[str]] = [[] for _ in range(size)]
    seen = words.sparkSession.createDataFrame([(t, r) for t, r in ranks.items()], "t binary, r int")
    for token, rank, slot in seen.select("t", "r", F.pmod(F.hash("t"), F.lit(size))).collect():
        buckets[slot].append(f'"{token.hex().upper()}":{rank}')
    text = "[" + ",".join("{" + ",".join(b) + "}" for b in buckets) + "]"
    table = F.from_json(F.lit(text), "array<map<string,int>>")

    def rank(token):
        return F.coalesce(F.try_element_at(F.get(table, F.pmod(F.hash(token), F.lit(size))), F.hex(token)), F.lit(1 << 30))

    raw = F.col(word_col).cast("binary")
    parts = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substring(raw, i, F.lit(1)))

    def step(parts, _):
        pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: rank(F.concat(x, F.get(parts, i + 1))))
        at = F.array_position(pairs, F.array_min(pairs)).cast("int")
        merged = F.concat(
            F.slice(parts, 1, at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts))
        )
        return F.when((F.size(parts) < 2) | (F.array_min(pairs) >= 1 << 30), parts).otherwise(merged)

    folded = F.aggregate(F.sequence(F.lit(1), F.length(raw)), parts, step)
    empty = F.array().cast("array<int>")
    return words.withColumn(ids_col, F.when(F.length(raw) > 0, F.transform(folded, lambda x: rank(x))).otherwise(empty))
