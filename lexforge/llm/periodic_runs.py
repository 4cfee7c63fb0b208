"""Maximal periodic runs of words, by tiles scaled to the period.

Periods are taken by octaves.  A document is cut into overlapping tiles at each octave, long
in proportion to its periods, so that every stretch of three periods lies within some tile.
A tile is solved alone: hashes of words a period long are compared from aligned boundaries to
find where a period may hold, and Z-functions forwards and backwards from such a boundary
give, for all its periods at once, how far each one holds and whether a smaller one does as
well.  The fragments are shuffled by document and period and stitched where they overlap by a
period or more.

A document that fits one tile is its only tile at every octave and is solved where it is read.
Tiles of longer ones are dealt out over the cluster; octaves of short periods share a tile.
Hashes only choose boundaries; what is reported rests on comparing the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, short_batches, staged

#: A run is at least so many words, and so many periods, long.
LEAST, POWER = 24, 3
#: Words of the least hash and spacing of boundaries: a stretch of LEAST words holds one whole.
_GRAM = 8
_FRAGMENT = "struct<start:bigint,period:bigint,end:bigint>"


def z_function(s: list[int]) -> list[int]:
    """For each i how many items from i on equal those from 0 on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] if n > 1 else out


def _extents(ids: np.ndarray, at: int, periods: list[int]) -> tuple[list[int], list[int]]:
    """How far each shift of the boundary `at` agrees with it: forwards from it, and backwards
    from the word before it, by shift up to the greatest of periods.

    The stretch looked at is doubled until none of the periods reaches its end."""
    top, reach = max(periods) + 1, 4 * max(periods)
    while True:
        ahead = z_function(ids[at : at + top + reach].tolist())
        ahead += [0] * (top - len(ahead))
        seen = min(len(ids), at + top + reach) - at
        before = ids[max(0, at - reach) : at][::-1].tolist()
        text = ids[max(0, at - reach) : min(len(ids), at + top)][::-1].tolist()
        z = z_function(before + [-1] + text)
        back = [0] * top
        # The word before at + p stands at index len(text) - len(before) - p of the reversed text.
        for p in range(1, min(top, len(text) - len(before) + 1)):
            back[p] = z[len(before) + 1 + len(text) - len(before) - p]
        cut_ahead = at + seen < len(ids) and any(p + ahead[p] >= seen for p in periods)
        cut_back = len(before) < at and any(back[p] >= len(before) for p in periods)
        if not cut_ahead and not cut_back:
            return ahead, back
        reach *= 2


def tile_fragments(ids: np.ndarray, first: int, last: int | None = None) -> list[tuple[int, int, int]]:
    """(start, period, end) of each longest stretch of a tile with a period of octaves first to
    last - 1 (None: all that fit) that is long enough for a run and has no smaller period."""
    n, out = len(ids), []
    if n < LEAST:
        return out
    width, octave = 1, 0
    h = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = np.uint64(0xD1342543DE82EF93)
    while width < _GRAM:
        h, width = h[:-width] * step + h[width:], width * 2
    while (last is None or octave < last) and POWER * (width if octave else 1) <= n and len(h):
        if octave >= first:
            if octave:
                place = np.flatnonzero(h[width:] == np.repeat(h[: len(h) - width : width], width)[: max(0, len(h) - width)]) if len(h) > width else np.empty(0, np.int64)
                found = list(zip((place // width * width).tolist(), (place % width + width).tolist(), strict=True))
            else:
                found = sorted((int(j) * width, p) for p in range(1, 2 * width) for j in np.flatnonzero(h[: max(0, len(h) - p) : width] == h[p::width]))
            out += _solved(ids, found)
        if len(h) <= width:
            break
        h, width, octave = h[:-width] * step + h[width:], width * 2, octave + 1
    return out


def _solved(ids: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The fragments round (boundary, period) candidates, which come by boundary."""
    out, done, i = [], {}, 0
    while i < len(found):
        at, j = found[i][0], i
        while j < len(found) and found[j][0] == at:
            j += 1
        open_ = [p for _, p in found[i:j] if at + p >= done.get(p, 0)]
        i = j
        if not open_:
            continue
        ahead, back = _extents(ids, at, open_)
        for p in open_:
            start, end = at - back[p], at + p + ahead[p]
            done[p] = end
            if end - start < max(LEAST, POWER * p):
                continue
            smaller = (p // d for d in _prime_factors(p))
            if not any(ahead[s] >= end - at - s and back[s] >= at - start for s in smaller):
                out.append((start, p, end))
    return out


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    number = {w: i for i, w in enumerate(set(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def tiles(n: int, tile: int) -> Iterator[tuple[int, int | None, int, int]]:
    """(first octave, octave behind the last, start, end) of the tiles of n words: tiles of
    `tile` words for periods under tile / 16, then at each octave tiles of 16 of its least
    periods.  Neighbours share POWER of the octave's greatest periods, at least LEAST words."""
    if n <= tile:
        yield 0, None, 0, n
        return
    octave = (tile // (16 * _GRAM)).bit_length() - 1
    bound, first, size = _GRAM << octave, 0, tile
    while True:
        shared = max(POWER * bound, LEAST)
        for start in range(0, max(1, n - shared), size - shared):
            yield first, octave, start, min(n, start + size)
        if POWER * bound > n:
            return
        first, octave, size, bound = octave, octave + 1, 16 * bound, 2 * bound


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = 1 << 16) -> DataFrame:
    """Every run of each document: (id_col, n_words, runs, collapsed), one row a row of docs.

    runs: (start, period, length) by start, then period; words count from 0.  A run is a
    stretch of at least LEAST words and POWER periods, its period the smallest, that no
    neighbouring word extends keeping it.  collapsed: the words joined by one space, without
    those that stand behind the first period of some run.

    Null and empty texts have no words, no runs and an empty collapsed text.  Null and
    repeated ids are rows of their own, equal texts are solved each.  Other columns are not
    read.  Very long texts are dealt out in tiles of `tile` words and more, a power of two of
    at least 256; the row itself has to fit a task.  No rows: empty.
    """
    if tile < 256 or tile & (tile - 1):
        raise ValueError("tile must be a power of two of at least 256")
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    fragment = pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("end", pa.int64())]))

    def listed(found):
        return pa.array([None if f is None else [{"start": s, "period": p, "end": e} for s, p, e in f] for f in found], fragment)

    def read(batches):
        """Words joined by one space, their number, and the fragments of a document of one tile."""
        for batch in batches:
            number, found, flat = [], [], []
            for text in batch.column(2).to_pylist():
                words = (text or "").encode().split()
                number.append(len(words))
                found.append(tile_fragments(word_ids(words), 0) if len(words) <= tile else None)
                flat.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(number, pa.int64()), pa.array(flat, pa.string()), listed(found)], names=["row", "id", "n_words", "flat", "found"]
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(rows.mapInArrow(read, f"row long, id {kind}, n_words long, flat string, found array<{_FRAGMENT}>"), "words")

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = word_ids(text.encode().split())
                for first, last, start, end in tiles(len(ids), tile):
                    parts = [pa.array([x], pa.int64()) for x in (row, first, last, start)] + [pa.array([ids[start:end].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(parts, names=["row", "first", "last", "start", "ids"])

    def solve(batches):
        for batch in batches:
            row, first, last, start, ids = (c.to_pylist() for c in batch.columns)
            found = [
                [(s + at, p, e + at) for s, p, e in tile_fragments(np.frombuffer(raw, np.int32), a, b)]
                for a, b, at, raw in zip(first, last, start, ids, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), listed(found)], names=["row", "found"])

    far = (
        rows.filter("found IS NULL").select("row", "flat").mapInArrow(cut, "row long, first long, last long, start long, ids binary")
        .repartition("row", "first", "start").mapInArrow(solve, f"row long, found array<{_FRAGMENT}>")
    )
    pieces = rows.filter("size(found) > 0").select("row", "found").unionByName(far).select("row", F.inline("found"))
    in_order = W.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("long")
    stitched = pieces.withColumn("apart", apart).withColumn("run", F.sum("apart").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    stitched = stitched.groupBy("row", "period", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    runs = stitched.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))

    def collapse(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if found:
                    words, edge = text.split(" "), None
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["start"] + r["period"] for r in found], 1)
                    np.add.at(edge, [r["start"] + r["length"] for r in found], -1)
                    text = " ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    held = rows.filter("found IS NULL OR size(found) > 0").join(runs, "row", "left").select("id", "n_words", "flat", F.coalesce("runs", none).alias("runs"))
    held = held.mapInArrow(collapse, f"id {kind}, n_words long, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed string")
    plain = rows.filter("size(found) = 0").select("id", "n_words", none.alias("runs"), F.col("flat").alias("collapsed"))
    return plain.unionByName(held).withColumnRenamed("id", id_col)
