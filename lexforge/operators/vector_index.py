"""Vectors in lists around centroids: each query's nearest chunks without given candidates."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import new_folder, written

#: Rows that centroids are fitted on, most lists, rows of a part of a list, queries that meet a part together.
SAMPLE, LISTS, PART, BLOCK = 20_000, 1_024, 16_384, 512
#: Share of the lists that a query reads.  On vectors without structure recall follows this share.
SHARE = 0.6
_KEY = ["list", "part", "block"]
_HITS = "query_id long, chunk_id string, document_id string, score double"


class VectorIndex(NamedTuple):
    """rows: (list, part, chunk_id, document_id, year, jurisdiction, vector); centroids: (list, centroid), LISTS at most."""

    rows: DataFrame
    centroids: DataFrame


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector, as doubles, has only finite parts and some length."""
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>")).filter("vector IS NOT NULL")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~odd).filter(_norm(F.col("vector")) > 0)


def _unit(vector: Column) -> Column:
    norm = _norm(vector)
    return array_to_vector(F.transform(vector, lambda x: x / norm))


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that vector_index wrote to a folder."""
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centroids"))


def vector_index(vectors: DataFrame, path: str | None = None, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index of (chunk_id, document_id, vector) and, where given, year and jurisdiction, written to `path`.

    Centroids are fitted on at most `sample` rows, those of least hash of chunk_id; every usable
    row is then put into the list of its nearest one.  Vectors null, zero, with null or
    non-finite parts, or of another length than the most frequent (ties: the longest) have no
    row.  `lists` is the square root of the rows if not given, LISTS at most.  A list is dealt
    into parts of about PART rows by chunk_id, so a list that holds a third of all rows, as one
    vector repeated does, is as many parts.  Without a path a new folder of the shared one is used.
    """
    spark, path = vectors.sparkSession, path or new_folder(vectors.sparkSession, "vector-index")
    for name, kind in (("year", "int"), ("jurisdiction", "string")):
        vectors = vectors.withColumn(name, F.col(name).cast(kind) if name in vectors.columns else F.lit(None).cast(kind))
    rows = _usable(vectors.select("chunk_id", "document_id", "year", "jurisdiction", "vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length, total = (sizes.n, sizes["count"]) if sizes else (0, 0)
    rows = rows.filter(F.size("vector") == length).withColumn("features", _unit(F.col("vector")))
    if total:
        fitted = written(rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("features"), "fitted")
        k = max(2, min(LISTS, lists or math.ceil(math.sqrt(total)), total, sample))
        if total == 1:
            # Fitting asks for as many rows as lists.
            fitted = fitted.unionByName(fitted)
        model = KMeans(k=k, seed=7, maxIter=10, featuresCol="features", predictionCol="list").fit(fitted)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        rows = model.transform(rows).drop("features")
    else:
        centres, rows = [], rows.withColumn("list", F.lit(0)).drop("features")
    spark.createDataFrame(centres, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    rows = written(rows, "listed")
    # At most LISTS rows: broadcast.
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/rows")
    return read_vector_index(spark, path)


def _nearest(top: int):
    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("document_id", pa.string()), ("score", pa.float64())])
        if not asked.num_rows or not own.num_rows:
            return schema.empty_table()
        own = own.sort_by("chunk_id")
        chunks, docs = (np.array(own[c].to_pylist(), dtype=object) for c in ("chunk_id", "document_id"))
        table, ask = (np.stack(t["vector"].to_numpy()).astype(np.float64) for t in (own, asked))
        table /= np.linalg.norm(table, axis=1, keepdims=True)
        ask /= np.linalg.norm(ask, axis=1, keepdims=True)
        years, places = (np.array(own[c].to_pylist(), dtype=object) for c in ("year", "jurisdiction"))
        scores = ask @ table.T
        out = ([], [], [], [])
        for row, query, year, place in zip(scores, asked["query_id"].to_pylist(), asked["year"].to_pylist(), asked["jurisdiction"].to_pylist(), strict=True):
            fit = np.ones(len(row), bool)
            if year is not None:
                fit &= years == year
            if place is not None:
                fit &= places == place
            at = np.flatnonzero(fit)
            if len(at) > top:
                # All that may round to the last place's score; rows stand by chunk_id, so a stable sort breaks ties.
                at = at[row[at] >= np.partition(row[at], len(at) - top)[len(at) - top] - 2e-9]
            rounded = np.round(row[at], 9)
            best = np.argsort(-rounded, kind="stable")[:top]
            out[0].extend([query] * len(best))
            out[1].extend(chunks[at[best]])
            out[2].extend(docs[at[best]])
            out[3].extend(rounded[best])
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def open_search(queries: DataFrame, index: VectorIndex, top: int, share: float = SHARE) -> DataFrame:
    """Each query's `top` nearest chunks by cosine of all that are indexed; ties go to the smaller chunk_id.

    queries: (query_id long, vector) and, where given, year and jurisdiction, which a chunk must
    then have (null: any).  A query reads the `share` of the lists whose centroids are nearest
    to it, 1 for exact results.  Queries and rows of a list meet in blocks of about BLOCK
    queries by PART rows, each a group of its own with at most `top` hits a query.  Queries
    whose vector is null, zero, not finite or of another length find nothing.
    """
    spark = queries.sparkSession
    for name, kind in (("year", "int"), ("jurisdiction", "string")):
        queries = queries.withColumn(name, F.col(name).cast(kind) if name in queries.columns else F.lit(None).cast(kind))
    # At most LISTS rows.
    centres = [(r["list"], r.centroid) for r in index.centroids.orderBy("list").collect()]
    if not centres:
        return spark.createDataFrame([], _HITS + ", rnk int, source string")
    names, table = np.array([c[0] for c in centres]), np.array([c[1] for c in centres])
    probes, length = max(1, math.ceil(share * len(names))), table.shape[1]

    @F.pandas_udf("array<int>")
    def lists_of(vectors):
        near = np.stack(vectors.to_numpy()) @ table.T
        return type(vectors)(list(names[np.argsort(-near, axis=1, kind="stable")[:, :probes]]))

    asked = _usable(queries.select("query_id", "year", "jurisdiction", "vector")).filter(F.size("vector") == length)
    probed = written(asked.withColumn("list", F.explode(lists_of("vector"))), "probed")
    # At most LISTS rows each: broadcast.
    blocks = F.broadcast(probed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    parts = F.broadcast(index.rows.groupBy("list").agg((F.max("part") + 1).alias("parts")))
    sent = probed.join(blocks, "list").join(parts, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    own = index.rows.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    hits = sent.groupBy(*_KEY).cogroup(own.groupBy(*_KEY)).applyInArrow(_nearest(top), _HITS)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= top).withColumn("source", F.lit("vector"))
