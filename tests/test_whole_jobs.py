"""Jobs over whole groups and over every hit, against their SQL or brute force."""

from pathlib import Path

import duckdb
import pytest

from lexforge import registry
from lexforge.operators import ranges
from lexforge.operators import relations as r
from lexforge.operators import retrieval as t

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    got = [tuple(x) for x in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["ops_02_latency_stats", "grf_09_thread_members"])
def test_large_groups_match_sql(spark, name):
    same_as_sql(spark, name)


@pytest.mark.parametrize("name", ["ret_12_timeline", "ret_17_answer_confidence", "rsk_01_risk_signals", "rsk_02_risk_score"])
def test_every_hit_counts(spark, name):
    """No rank cuts the hits; the longer names, from when the others were cut, give the same."""
    assert not any("rnk <=" in registry.ORACLE_SQL[n] for n in (name, f"{name}_every_hit"))
    same_as_sql(spark, f"{name}_every_hit")
    first, every = ({str(x) for x in registry.QUERIES[n](spark, DATA).collect()} for n in (name, f"{name}_every_hit"))
    assert first == every


def test_one_group_is_dealt_out(spark, monkeypatch):
    laid = []
    real = ranges.written
    monkeypatch.setattr(ranges, "written", lambda df, name: laid.append(real(df, name)) or laid[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).selectExpr("IF(id < 3990, 'p', NULL) AS pipeline_used", "CAST(id * 7 % 4001 AS DOUBLE) AS latency_ms", "id AS request_id")
        got = {x.pipeline_used: x for x in t.latency_stats(rows).collect()}
        for key, ids in (("p", range(3990)), (None, range(3990, 4000))):
            own = sorted(float(i * 7 % 4001) for i in ids)
            assert (got[key].n, got[key].min_ms, got[key].max_ms, got[key].p95_ms) == (len(own), own[0], own[-1], own[int(len(own) * 0.95)])
        threads = spark.range(4000).selectExpr("'t' AS thread_id", "CAST(id AS STRING) AS go_id")
        orders = spark.range(4000).selectExpr("CAST(id AS STRING) AS go_id", "date_add(DATE'2000-01-01', CAST(id % 100 AS INT)) AS go_date")
        members = {x.go_id: x.place for x in r.thread_members(threads, orders).collect()}
        assert members == {k: i + 1 for i, k in enumerate(sorted(map(str, range(4000)), key=lambda k: (int(k) % 100, k)))}
        assert all(x.select("_part").distinct().count() == 4 for x in laid)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
