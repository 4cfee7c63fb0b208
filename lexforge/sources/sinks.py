"""Writers: partitioned output, tables under a declared schema, payloads for a vector store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Collection of a vertical, name space of point ids, length of a payload's text.
COLLECTIONS = {"go": "government_orders", "legal": "legal_documents", "judicial": "judicial_documents", "data": "data_reports", "scheme": "schemes"}
NAMESPACE, PAYLOAD_TEXT = "6ba7b8109dad11d180b400c04fd430c8", 8000
FLAGS = ["is_most_recent", "is_superseded", "is_current", "overrides_by_date", "is_table", "has_table"]


def write_partitioned(rows: DataFrame, path: str, by: str = "vertical", salts: int = 8, form: str = "parquet") -> None:
    """Append rows in folders by a column; a large value's rows are spread over `salts` tasks."""
    rows.repartition(F.col(by), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).write.mode("append").partitionBy(by).format(form).save(path)


def load_table(rows: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, quarantine): columns cast by name, missing ones null, others dropped.

    A row whose required column (not nullable) is missing, null or can't be cast is quarantined
    with the names of these columns and its content as JSON.
    """
    cast = [(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    required = [f.name for f in schema.fields if not f.nullable]
    raw = F.to_json(F.struct(*rows.columns)).alias("raw_payload")
    made = rows.select(*cast, raw)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required])) if required else F.array().cast("array<string>")
    made = made.withColumn("missing", missing)
    return made.filter(F.size("missing") == 0).select(*schema.names), made.filter(F.size("missing") > 0).select(F.array_join("missing", ",").alias("error_type"), "raw_payload")


def append_table(rows: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    """Append the good rows to a Parquet table; returns the quarantine."""
    good, bad = load_table(rows, schema)
    good.write.mode("append").parquet(path)
    return bad


def point_id(document_id: Column, chunk_id: Column) -> Column:
    """Version 5 UUID of document and chunk, the same in every run."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.concat_ws("|", document_id, chunk_id).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8)))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def vector_payload(chunks: DataFrame) -> DataFrame:
    """(point_id, collection, payload): all columns as JSON without nulls, flags as text, long text cut.

    chunks: chunk_id, document_id, text, vertical and any others.  An unknown vertical has no
    collection.
    """
    table = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > PAYLOAD_TEXT, F.concat(F.substring(text, 1, PAYLOAD_TEXT), F.lit("..."))).otherwise(text)
    kinds = dict(chunks.dtypes)
    flag = lambda c: F.when(F.col(c), "true").when(~F.col(c), "false") if kinds[c] == "boolean" and c in FLAGS else F.col(c)
    others = [flag(c).alias(c) for c in chunks.columns if c not in ("document_id", "chunk_id", "text", "vertical", "char_count")]
    defaults = [F.lit("false").alias("has_relations")] if "has_relations" not in chunks.columns else []
    fields = [F.col("document_id").alias("doc_id"), F.col("chunk_id"), cut.alias("text"), F.length(text).alias("char_count"), F.coalesce("vertical", F.lit("unknown")).alias("vertical"), *others, *defaults]
    return chunks.select(point_id(F.col("document_id"), F.col("chunk_id")).alias("point_id"), F.try_element_at(table, F.lower(F.trim("vertical"))).alias("collection"), F.to_json(F.struct(*fields)).alias("payload"))
