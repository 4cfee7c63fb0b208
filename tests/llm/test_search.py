"""Recall of the curve search where windows cover a share of the table, and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm.hilbert_search import hilbert_search
from lexforge.llm.queries import op4_hilbert_search

VECTORS = "vec_id long, embedding array<float>"


def recall(spark, x, every, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], VECTORS).repartition(8)
    got = {}
    for r in hilbert_search(df, F.col("vec_id") % every == 0, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = total = 0
    for q in range(0, len(x), every):
        score = x @ x[q]
        score[q] = -np.inf
        found += len(set(np.argpartition(-score, 20)[:20].tolist()) & got[q])
        total += 20
    print(f"{len(x)} vectors, recall {found / total:.3f}")
    return found / total


@pytest.mark.parametrize("spread", [0.0, 0.7])
def test_recall_with_narrow_windows(spark, spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    x *= np.exp(rng.normal(size=(3000, 1)) * spread) / np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, 60, least_window=16, windows=40) >= 0.9


def test_recall_at_a_hundred_thousand(spark):
    """Isotropic vectors of 64 parts, the hardest kind, at the query's own parameters."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, 500) >= 0.9


def test_awkward_rows(spark, tmp_path):
    """Short tables give all candidates; ties go to the smaller id; bad vectors take no part."""
    one, two = [1.0, 0.0], [0.5, 0.5]
    rows = [(i, one) for i in range(30)] + [(30, two), (40, None), (41, [0.0, 0.0]), (42, [1.0, None]), (43, [float("nan"), 1.0]), (44, [float("inf"), 1.0]), (None, one), (45, [1.0])]
    rows += [(5, one), (60, [2.0, 0.0]), (60, [0.0, 3.0])]
    spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("query_id", F.lit("clash")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op4_hilbert_search(spark, str(tmp_path)).collect()
    own = [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)]
    assert own == [60, *range(1, 20)] and {r.query_id for r in got} == {0, 20, 60}
    assert [r.rank for r in got if r.query_id == 20] and max(r.rank for r in got) == 20
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (7, [3.0, 0.1])], VECTORS)
    small = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert_search(few, F.col("vec_id") % 20 == 0).collect())
    assert [x[:3] for x in small] == [(0, 1, 20), (0, 2, 7), (20, 1, 7), (20, 2, 0)] and small[0][3] == 4.0
    assert hilbert_search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("batch", ["1", "16"])
def test_batches_without_a_query(spark, batch):
    """Batches and partitions that hold no query, one query in the table, and none."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(7)
        for asked in ([123], [7, 399], []):
            got = hilbert_search(df, F.col("vec_id").isin(asked) if asked else F.lit(False), least_window=16).collect()
            assert sorted({r.query_id for r in got}) == asked and len(got) == 20 * len(asked)
    finally:
        spark.conf.set(key, before)
