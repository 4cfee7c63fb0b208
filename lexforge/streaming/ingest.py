"""Incremental ingest: each run takes the files that no run before it has taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> DataFrame:
    """Append the new files' rows to the Parquet folder target and return all of target.

    Files already in the checkpoint are skipped; a run that was cut off is taken up again
    without loss or repetition (file sink's log).  Rows without text are left out.
    """
    rows = spark.readStream.schema(schema).parquet(source).filter("text IS NOT NULL").withColumn("text_sha256", F.sha2("text", 256))
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


def not_yet_ingested(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Batch form: rows whose key is not in done; rows without a key stay."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
