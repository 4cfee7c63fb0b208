"""Approximate nearest neighbours by shifted space-filling curves.

Distinct vectors are projected to a few axes fitted on a bounded sample, each time after
another rotation and shift, and laid along a Hilbert curve.  Each curve is cut into windows of
equal counts, by percentiles over all rows; Spark range-partitions the vectors by curve and
window.  A query reads its own window and its neighbours on every curve, on 16-bit copies of
the vectors; the merged candidates are reranked by the exact inner product in double precision
on the vectors themselves, which are stored once.

Windows are a fixed share of the rows (a twelfth), since on vectors without structure recall
depends on the share that is read; README.md has the figures.  Equal vectors are one point
with their least k + 1 ids, which is all that any answer can use, so a vector that a third of
the rows repeat costs one point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import skew_join, staged


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (n, axes); axes * bits <= 62."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def fit_curves(sample: np.ndarray, curves: int, axes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, low, span) of each curve: rotated leading directions and a random shift.

    A vector is taken with a last coordinate that brings it to the sample's greatest length,
    so that the largest inner products are the nearest points.
    """
    rng = np.random.default_rng(seed)
    lifted = lift(sample, np.linalg.norm(sample, axis=1).max())
    _, s, v = np.linalg.svd(lifted - lifted.mean(axis=0), full_matrices=False)
    lead = v[: max(axes, min(len(s), int(np.searchsorted(np.cumsum(s**2) / np.sum(s**2), 0.95)) + 1))]
    out = []
    for _ in range(curves):
        turn = np.linalg.qr(rng.normal(size=(len(lead), len(lead))))[0][:, :axes]
        p = lead.T @ turn
        got = lifted @ p
        low, high = got.min(axis=0), got.max(axis=0)
        span = np.maximum(high - low, 1e-12) * 1.5
        out.append((p, low - rng.uniform(0, 1 / 3, p.shape[1]) * span, span))
    return out


def lift(x: np.ndarray, length: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(length**2 - (x * x).sum(axis=1), 0))])


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit copies of rows and the scale of each."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 32767
    return np.rint(x / scale[:, None]).astype("<i2"), scale


def _best(ask: np.ndarray, have: np.ndarray, scale: np.ndarray, names: np.ndarray, most: int, tile: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ask the names and products of its `most` largest products with have, 16-bit rows of a scale each."""
    near, score = np.empty((len(ask), 0), np.int64), np.empty((len(ask), 0), np.float32)
    for i in range(0, len(have), tile):
        got = ask @ (have[i : i + tile].astype(np.float32) * scale[i : i + tile, None]).T
        near = np.concatenate([near, np.broadcast_to(names[i : i + tile], got.shape)], axis=1)
        score = np.concatenate([score, got], axis=1)
        if score.shape[1] > most:
            top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            near, score = np.take_along_axis(near, top, 1), np.take_along_axis(score, top, 1)
    return near, score


def hilbert_search(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, curves: int = 6, axes: int = 6,
    bits: int = 10, windows: int = 12, least_window: int = 1024, spare: int = 11, chunk: int = 1 << 20, sample_rows: int = 4096, seed: int = 3,
) -> DataFrame:
    """The k largest inner products of each query row with all other rows, nearly.

    is_query is a condition on the rows.  Returns (query_id, rank, vec_id, score), rank from
    1, ties to the smaller id, fewer rows where there are fewer candidates.  A vector that is
    null, zero, of another length than the first sampled ones or holds null or non-finite
    parts takes no part, nor does a null id; rows that repeat an id count once for each
    different vector.  Other columns are not read.  Empty: empty.

    Only axes and bounds are fitted on sample_rows rows; every row is indexed.  A curve has
    `windows` windows, fewer where they would hold under least_window vectors, and a query
    reads three of them.  The k + 1 + spare best candidates by 16-bit copies are reranked.
    A window is searched in chunks of about `chunk` vectors.
    """
    spark = vectors.sparkSession
    usable = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable & F.col("id").isNotNull())
    rows = rows.withColumn("mark", F.unhex(F.md5(F.concat_ws(",", F.transform("vec", lambda x: (x.cast("double") + 0.0).cast("string"))).cast("binary"))))
    sample = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    answer = "query_id long, rank int, vec_id long, score double"
    if sample.empty:
        return spark.createDataFrame([], answer)
    width = int(sample["vec"].map(len).mode()[0])
    fitted = np.stack([v for v in sample["vec"] if len(v) == width]).astype(np.float64)
    length = float(np.linalg.norm(fitted, axis=1).max())
    made = fit_curves(fitted, curves, min(axes, width), seed)
    rows = rows.filter(F.size("vec") == width)
    most = k + 1 + spare

    least = rows.withColumn("n", F.row_number().over(W.partitionBy("mark").orderBy("id"))).filter(F.col("n") <= k + 1)
    asking = rows.groupBy("mark").agg(F.max("asks").alias("asks"))
    points = staged(
        least.groupBy("mark").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids"))
        .join(asking, "mark").withColumn("point", F.monotonically_increasing_id()),
        "points",
    )

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)

    def places(at: np.ndarray):
        for p, low, span in made:
            yield hilbert_keys(np.clip((at @ p - low) / span * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in places(lift(matrix(batch.column(0)), length))], names=[f"c{i}" for i in range(curves)])

    # Window bounds: curves * windows numbers, from percentiles over every row.
    n = points.count()
    share = max(1, min(windows, n // least_window))
    cut = F.lit([i / share for i in range(1, share)] or [0.5])
    laid = points.select("vec").mapInArrow(keys, ", ".join(f"c{i} long" for i in range(curves)))
    found = laid.agg(*[F.percentile_approx(f"c{i}", cut, F.lit(20_000)).alias(f"c{i}") for i in range(curves)]).first()
    bounds = [np.array(x if share > 1 else [], np.int64) for x in found]
    chunks = -(-n // (share * chunk))

    def dealt(batches):
        """Each point in its window of each curve, and a query, at the common length with lift
        0, in the three around its own, as (place, asks, point, scale, code)."""
        for batch in batches:
            x, points = matrix(batch.column(1)), batch.column(0).to_numpy()
            ask = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            code, scale = coded(x)
            lifted = lift(x, length)
            flat = np.column_stack([x[ask] * (length / np.linalg.norm(x[ask], axis=1, keepdims=True)), np.zeros(len(ask))])
            for c, (own, other) in enumerate(zip(places(lifted), places(flat), strict=True)):
                window = np.searchsorted(bounds[c], own, side="right")
                first = np.clip(np.searchsorted(bounds[c], other, side="right") - 1, 0, max(0, share - 3))
                target = (first[:, None] + np.arange(min(3, share)))[:, :, None] * chunks + np.arange(chunks)
                target = target.reshape(len(ask), min(3, share) * chunks)
                at = np.concatenate([window * chunks + points % chunks, target.ravel()]) + c * share * chunks
                row = np.concatenate([np.arange(len(x)), np.repeat(ask, target.shape[1])])
                asks = np.arange(len(row)) >= len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(asks), pa.array(points[row]), pa.array(scale[row]), pa.array([code[i].tobytes() for i in row], pa.binary())],
                    names=["place", "asks", "point", "scale", "code"],
                )

    def search(batches):
        """The best candidates of each query in each place; candidates come first, queries stream by."""
        last, held, have = None, [], None
        for batch in batches:
            place, asks, points, scale = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<i2").reshape(-1, width)
            scale = (scale / length).astype(np.float32)
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                if a == b:
                    continue
                if place[a] != last:
                    last, held, have = place[a], [], None
                if not asks[a]:
                    held.append((x[a:b], scale[a:b], points[a:b]))
                elif held:
                    if have is None:
                        have = [np.concatenate(part) for part in zip(*held, strict=True)]
                        held = [tuple(have)]
                    for i in range(a, b, 256):
                        ask = x[i : min(i + 256, b)] * scale[i : min(i + 256, b), None]
                        near, score = _best(ask, *have, most)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(points[i : min(i + 256, b)]), pa.array(list(near), pa.list_(pa.int64())), pa.array(list(score), pa.list_(pa.float32()))],
                            names=["query", "near", "score"],
                        )

    lists = (
        points.select("point", "vec", "asks").mapInArrow(dealt, "place long, asks boolean, point long, scale double, code binary")
        .repartitionByRange("place").sortWithinPartitions("place", "asks")
        .mapInArrow(search, "query long, near array<long>, score array<float>")
    )

    def merged(group: pa.Table) -> pa.Table:
        """The best of one query's candidates over all its windows."""
        near = group.column("near").combine_chunks().flatten().to_numpy()
        score = group.column("score").combine_chunks().flatten().to_numpy()
        order = np.lexsort((near, -score))
        _, first = np.unique(near[order], return_index=True)
        near = near[order][np.sort(first)[:most]]
        return pa.table([pa.array(np.full(len(near), group.column("query")[0].as_py())), pa.array(near)], names=["query", "point"])

    pairs = lists.groupBy("query").applyInArrow(merged, "query long, point long")
    near = pairs.join(points.select("point", "vec", "ids"), "point").select("query", "vec", "ids", F.lit(None).cast("binary").alias("mark"))
    own = points.filter("asks").select(F.col("point").alias("query"), "vec", F.lit(None).cast("array<long>").alias("ids"), "mark")

    def rerank(group: pa.Table) -> pa.Table:
        """The k + 1 best (vec_id, score) of one query by the exact product."""
        mine = np.flatnonzero(group.column("mark").is_valid().to_numpy(zero_copy_only=False))[0]
        x = matrix(group.column("vec"))
        # einsum adds in one order for all rows, so equal vectors tie exactly.
        score = np.einsum("d,nd->n", x[mine], x)
        hits = sorted((-s, i) for s, ids in zip(score.tolist(), group.column("ids").to_pylist(), strict=True) for i in ids or ())[: k + 1]
        hit = pa.array([[{"vec_id": i, "score": -s} for s, i in hits]], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))
        return pa.table([pa.array([group.column("mark")[int(mine)].as_py()], pa.binary()), hit], names=["mark", "list"])

    best = near.unionByName(own).groupBy("query").applyInArrow(rerank, "mark binary, list array<struct<vec_id:bigint,score:double>>")
    asks = rows.filter("asks").select(F.col("id").alias("query_id"), "mark").distinct()
    others = F.slice(F.filter("list", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return skew_join(asks, best, "mark", "query_id").select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
