"""Search by centroid lists against all pairs: exact, filtered, with odd vectors and a list of equal rows; recall at 100,000."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.operators import vector_index as vi

ROWS, ASKED = "chunk_id string, document_id string, vector array<float>, year int, jurisdiction string", "query_id long, vector array<float>, year int, jurisdiction string"


def made(n, seed, copies=0):
    rng, np_rng = random.Random(seed), np.random.default_rng(seed)
    vectors = np_rng.normal(size=(n, 6)).round(3).tolist()
    vectors[: n // 10] = [vectors[0]] * (n // 10)
    vectors += [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * copies
    vectors[-4:] = [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    vectors[5] = [float("nan")] * 6
    return [(f"c{i:05}", f"d{i // 3}", v, rng.choice([None, 2001, 2002]), rng.choice([None, "AP", "IN"])) for i, v in enumerate(vectors)]


def fine(v):
    return v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def by_hand(queries, rows, top):
    out = set()
    rows = [r for r in rows if fine(r[2])]
    table = np.array([np.float32(r[2]) for r in rows], dtype=np.float64)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    for q, v, year, place in queries:
        if fine(v):
            own = np.array(np.float32(v), dtype=np.float64)
            scores = np.round(table @ (own / np.linalg.norm(own)), 9)
            fit = sorted((-s, r[0]) for s, r in zip(scores, rows, strict=True) if (year is None or r[3] == year) and (place is None or r[4] == place))
            out |= {(q, c, n) for n, (_, c) in enumerate(fit[:top], 1)}
    return out


@pytest.mark.parametrize("top", [1, 7, 1000])
def test_all_lists_give_what_all_pairs_give(spark, monkeypatch, top):
    """Parts of fifty rows and blocks of four queries, and a vector that a third of the rows hold."""
    monkeypatch.setattr(vi, "PART", 50)
    monkeypatch.setattr(vi, "BLOCK", 4)
    rows = made(300, top, copies=150)
    queries = [(i, r[2], r[3] if i % 2 else None, r[4] if i % 3 else None) for i, r in enumerate(rows[::17] + rows[-5:])]
    index = vi.vector_index(spark.createDataFrame(rows, ROWS))
    assert index.rows.count() == sum(fine(r[2]) for r in rows) and index.rows.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 120
    got = vi.open_search(spark.createDataFrame(queries, ASKED), index, top, 1.0).collect()
    assert {(r.query_id, r.chunk_id, r.rnk) for r in got} == by_hand(queries, rows, top) and len(got) == len({(r.query_id, r.chunk_id) for r in got})


def test_empty_and_single_rows_and_columns_left_out(spark, tmp_path):
    plain = "chunk_id string, document_id string, vector array<double>"
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    none = vi.vector_index(spark.createDataFrame([], plain))
    assert vi.open_search(asked, none, 3).count() == 0
    vi.vector_index(spark.createDataFrame([("a", "d", [2.0, 0.0])], plain), str(tmp_path / "one"))
    one = vi.read_vector_index(spark, str(tmp_path / "one"))
    assert [(r.query_id, r.chunk_id, r.score, r.rnk) for r in vi.open_search(asked, one, 3).collect()] == [(1, "a", 1.0, 1)]
    assert vi.open_search(asked.filter("query_id = 2"), one, 3).count() == 0


@pytest.mark.parametrize("parts, share", [(64, vi.SHARE), (8, 0.1)])
def test_recall_at_a_hundred_thousand(spark, parts, share):
    """Vectors without structure at the default share, and of few directions at a tenth of the lists."""
    rng = np.random.default_rng(3)
    table = rng.normal(size=(100_000, parts)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"chunk_id": [f"c{i:06}" for i in range(len(table))], "document_id": ["d"] * len(table), "vector": pa.array(table.tolist(), pa.list_(pa.float32()))}))
    index = vi.vector_index(rows)
    ask = rng.normal(size=(100, parts)).astype(np.float32)
    got = vi.open_search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)], "query_id long, vector array<float>"), index, 20, share)
    found = {i: set() for i in range(100)}
    for r in got.collect():
        found[r.query_id].add(int(r.chunk_id[1:]))
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    best = np.argsort(-(ask @ table.T), axis=1)[:, :20]
    recall = np.mean([len(found[i] & set(b.tolist())) / 20 for i, b in enumerate(best)])
    print("recall", parts, share, recall)
    assert recall >= 0.9
