"""Tables of declared schemas whose states are committed together.

A root folder holds parts of tables and manifests.  Each run writes its parts first, under a
name of its own, and then one manifest row that lists every table's schema and parts; readers
take the last manifest.  A run that dies before has changed nothing that is read, and a run id
that was committed is not written again.  One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import load_table
from .staging import written

_MANIFEST = "run_id string, seq long, tables map<string, struct<table_schema: string, parts: array<string>>>"
QUARANTINE = T.StructType([T.StructField("table", T.StringType(), False), T.StructField("run_id", T.StringType(), False), T.StructField("error_type", T.StringType()), T.StructField("raw_payload", T.StringType())])


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests; none if the root is new."""
    folder = f"{root.rstrip('/')}/manifests"
    spark.createDataFrame([], _MANIFEST).write.mode("append").json(folder)
    return spark.read.schema(_MANIFEST).json(folder)


def _state(spark: SparkSession, root: str, run_id: str | None = None) -> tuple[int, dict, bool]:
    """Number and tables of the last manifest, and whether run_id is committed: one row to the driver."""
    last, known = _manifests(spark, root).agg(F.max_by(F.struct("seq", "tables"), F.col("seq")), F.max(F.col("run_id") == F.lit(run_id))).first()
    tables = {k: (v["table_schema"], list(v["parts"])) for k, v in last["tables"].items()} if last else {}
    return (last["seq"] if last else 0), tables, bool(known)


def _publish(spark: SparkSession, root: str, run_id: str, seq: int, tables: dict) -> None:
    # One row, so one file, which appears by the commit of its only task.
    spark.createDataFrame([(run_id, seq, tables)], _MANIFEST).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/manifests")


def is_committed(spark: SparkSession, root: str, run_id: str) -> bool:
    return _state(spark, root, run_id)[2]


def create_tables(spark: SparkSession, root: str, run_id: str, schemas: dict[str, T.StructType], drop: bool = False) -> None:
    """Empty tables of the schemas; those that exist keep their schema and rows unless dropped."""
    seq, tables, known = _state(spark, root, run_id)
    if not known:
        new = {k: (s.json(), []) for k, s in schemas.items()}
        _publish(spark, root, run_id, seq + 1, {**tables, **new} if drop else {**new, **tables})


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as the last whole run left it; an unknown one raises KeyError."""
    schema, parts = _state(spark, root)[1][name]
    kind = T.StructType.fromJson(json.loads(schema))
    return spark.read.schema(kind).parquet(*[f"{root.rstrip('/')}/{p}" for p in parts]) if parts else spark.createDataFrame([], kind)


def append_committed(spark: SparkSession, root: str, run_id: str, rows: dict[str, DataFrame]) -> bool:
    """Append to several tables at once; False if the run was committed before.

    Rows are cast to their table's schema; those that lack a required column go to the table
    `quarantine` of the same commit.
    """
    seq, tables, known = _state(spark, root, run_id)
    if known:
        return False
    attempt = f"parts/{uuid.uuid4().hex}"
    tables = {"quarantine": (QUARANTINE.json(), []), **tables}
    for name, frame in rows.items():
        schema, parts = tables[name]
        good, bad = load_table(written(frame, f"append-{name}"), T.StructType.fromJson(json.loads(schema)))
        good.write.parquet(f"{root.rstrip('/')}/{attempt}/{name}")
        bad.select(F.lit(name).alias("table"), F.lit(run_id).alias("run_id"), "error_type", "raw_payload").write.parquet(f"{root.rstrip('/')}/{attempt}/quarantine-{name}")
        tables[name] = (schema, [*parts, f"{attempt}/{name}"])
        tables["quarantine"] = (tables["quarantine"][0], [*tables["quarantine"][1], f"{attempt}/quarantine-{name}"])
    _publish(spark, root, run_id, seq + 1, tables)
    return True
