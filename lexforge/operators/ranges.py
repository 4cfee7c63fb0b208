"""Places and values in large groups, dealt out so that no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import written


def counted_before(rows: DataFrame, by: str, order: list[str], weight: str | None = None) -> DataFrame:
    """Adds before: the rows, or the sum of weight, ahead of each row of its group in order.

    Rows are sorted in range partitions; a group's counts by partition give each partition's
    offset.  Order must be total within a group.  Nulls come first; a null group is a group.
    """
    laid = written(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    size = F.col(weight) if weight else F.lit(1)
    parts = laid.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_at")).agg(F.sum(size).alias("_sum"))
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(W.partitionBy("_by").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy(by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = laid.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    found = found.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return found.select(*rows.columns, (F.col("_inside") + F.col("_offset")).cast("long").alias("before"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds place: each row's number from 1 in order, which must be total.

    Rows are sorted in range partitions and written; the partitions' counts give their offsets,
    so no task holds all rows, as an unpartitioned window would.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}), "places")
    counts = laid.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_offset", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return laid.join(F.broadcast(counts.select("_part", "_offset")), "_part").select(*rows.columns, (F.col("_offset") + F.col("_at") + 1).alias("place"))


#: Parts that a key's rows are dealt into.
SALTS = 64


def told(rows: DataFrame, values: DataFrame, key: list[str], spread: str) -> DataFrame:
    """Rows joined to values, which has one row a key; rows without one go.

    A key's rows are dealt into parts by a hash of `spread`, and its value goes to the parts
    that there are, so a key that a third of all rows share is no task of its own.  Null keys
    match nothing.  Joins are merged: stored rows that compress well look small enough to
    broadcast and are not.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = dealt.select(*key, "_salt").distinct().join(values.hint("merge"), key)
    return dealt.join(parts.hint("merge"), [*key, "_salt"]).drop("_salt")
