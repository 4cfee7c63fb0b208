"""Commits of several tables: a run that dies changes nothing, a rerun adds nothing twice."""

import pytest
from lexforge.operators import packages
from lexforge.sources import commits
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("note", T.StringType())])


def test_a_run_that_dies_between_two_tables_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path)
    commits.create_tables(spark, root, "make", {"a": SCHEMA, "b": SCHEMA})
    rows = spark.range(10).withColumn("note", F.lit("x"))
    assert commits.append_committed(spark, root, "one", {"a": rows, "b": rows})
    broken = rows.withColumn("note", F.when(F.col("id") > 5, F.raise_error(F.lit("lost"))).otherwise("y"))
    with pytest.raises(Exception, match="lost"):
        commits.append_committed(spark, root, "two", {"a": rows, "b": broken})
    count = lambda: [commits.read_committed(spark, root, t).count() for t in "ab"]
    assert count() == [10, 10]
    assert commits.append_committed(spark, root, "two", {"a": rows, "b": rows}) and count() == [20, 20]
    assert not commits.append_committed(spark, root, "two", {"a": rows, "b": rows}) and count() == [20, 20]


def test_required_columns_drops_and_unknown_tables(spark, tmp_path):
    root = str(tmp_path)
    commits.create_tables(spark, root, "make", {"a": SCHEMA})
    assert commits.read_committed(spark, root, "a").count() == 0
    commits.append_committed(spark, root, "one", {"a": spark.createDataFrame([("1", 2), (None, 3), ("x", 4)], "id string, other int")})
    assert [tuple(r) for r in commits.read_committed(spark, root, "a").collect()] == [(1, None)]
    bad = commits.read_committed(spark, root, "quarantine").collect()
    assert [(r.table, r.run_id, r.error_type) for r in bad] == [("a", "one", "id")] * 2
    commits.create_tables(spark, root, "keep", {"a": SCHEMA})
    assert commits.read_committed(spark, root, "a").count() == 1
    commits.create_tables(spark, root, "drop", {"a": SCHEMA}, drop=True)
    assert commits.read_committed(spark, root, "a").count() == 0
    with pytest.raises(KeyError):
        commits.append_committed(spark, root, "two", {"b": spark.range(1)})


def test_ingested_tables_hold_what_the_job_makes(spark, tmp_path):
    text = "THE EDUCATION ACT, 2001\nSection 1. Title — This Act may be called so. " + "The school shall keep a register of fees. " * 20
    texts = spark.createDataFrame([("d1", "a.txt", text), ("d2", "b.txt", "short"), ("d3", "c.txt", None)], "document_id string, file_name string, text string")
    registry = spark.createDataFrame([], "ref_type string, number string, year string, canonical_id string, source_document string, seq long")
    assert packages.ingest_to_tables(texts, registry, str(tmp_path), "night")
    assert not packages.ingest_to_tables(texts, registry, str(tmp_path), "night")
    made = packages.ingest_corpus(texts, registry)
    for name, frame in made.items():
        assert sorted(map(repr, commits.read_committed(spark, str(tmp_path), name).collect())) == sorted(map(repr, frame.collect())), name
    assert {r.document_id: r.status for r in made["results"].collect()} == {"d1": "success", "d2": "failed", "d3": "failed"}
