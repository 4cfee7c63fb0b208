"""Warehouse jobs: migration between table families, reports, deletion by pattern, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relation types of orders as judgment relations.
JUDGMENT_TYPES = {"supersedes": "overrules", "cancels": "overrules", "overrules": "overrules", "amends": "followed", "clarifies": "distinguished"}


def go_to_documents(orders: DataFrame, threads: DataFrame, present: DataFrame) -> DataFrame:
    """Orders as document rows with their first primary thread, those present left out."""
    domain = threads.filter("role = 'primary'").groupBy("go_id").agg(F.min("thread_id").alias("domain"))
    rows = orders.join(domain, "go_id", "left").select(
        F.col("go_id").alias("document_id"), F.concat(F.lit("GO "), F.col("go_number")).alias("title"), F.lit("go").alias("doc_type"),
        F.coalesce("domain", F.lit("general")).alias("domain"), F.col("go_date").alias("doc_date"),
    )
    return rows.join(present.select("document_id"), "document_id", "left_anti").distinct()


def clauses_to_chunks(clauses: DataFrame, present: DataFrame) -> DataFrame:
    rows = clauses.select(F.col("clause_id").alias("chunk_id"), F.col("go_id").alias("document_id"), F.col("section_path").alias("section"))
    return rows.join(present.select("chunk_id"), "chunk_id", "left_anti")


def relations_to_judgments(relations: DataFrame, docs: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Relations between two judgments, with the types of judgment relations, once each.

    Those that `present` (from_doc_id, to_doc_id, relation_type) holds are left out, so a
    second run adds none.
    """
    kind = None
    for k, v in JUDGMENT_TYPES.items():
        kind = F.when(F.col("relation_type") == k, v) if kind is None else kind.when(F.col("relation_type") == k, v)
    judgments = docs.filter("doc_type = 'judgment'").select("document_id")
    ends = relations.select(F.col("source_id").alias("from_doc_id"), F.col("target_id").alias("to_doc_id"), kind.alias("relation_type"))
    for end in ("from_doc_id", "to_doc_id"):
        ends = ends.join(judgments.withColumnRenamed("document_id", end), end, "left_semi")
    rows = ends.filter("relation_type IS NOT NULL").distinct()
    key = ["from_doc_id", "to_doc_id", "relation_type"]
    return rows if present is None else rows.join(present.select(key), key, "left_anti")


def threads_to_domains(threads: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Primary and other domains of each document that has a primary one; documents in `present` are left out."""
    if present is not None:
        threads = threads.join(present.select(F.col("document_id").alias("go_id")), "go_id", "left_anti")
    return threads.groupBy(F.col("go_id").alias("document_id")).agg(
        F.max(F.when(F.col("role") == "primary", F.col("thread_id"))).alias("primary_domain"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") != "primary", F.col("thread_id")))), ",").alias("secondary_domains"),
        F.max("confidence").cast("double").alias("confidence"),
    ).filter("primary_domain IS NOT NULL")


def ingestion_report(relations: DataFrame, known: DataFrame) -> DataFrame:
    """Resolved and unresolved relations by type."""
    ids = known.select(F.col("go_id").alias("target_id")).distinct().withColumn("_known", F.lit(True))
    state = F.when(F.col("_known"), "Resolved").otherwise("Unresolved").alias("state")
    return relations.join(ids, "target_id", "left").groupBy(state, "relation_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_sources"))


def delete_by_patterns(table: DataFrame, id_col: str, patterns: list[str]) -> DataFrame:
    """Rows whose id is like none of the patterns; rows without an id stay."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col(id_col).like(p), F.lit(False))
    return table.filter(~hit)


def validate_vectors(vectors: DataFrame, vec_col: str, dimension: int) -> DataFrame:
    """Adds reason: null for a good vector, else the first rule that it breaks.  A null part is not finite."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    reason = (
        F.when(v.isNull() | (F.size(v) != dimension), "dimension").when(F.exists(v, lambda x: x.isNull()), "not_finite").when(F.forall(v, lambda x: x == 0), "all_zero")
        .when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(norm < 0.01, "norm_small").when(norm > 100, "norm_large")
    )
    return vectors.withColumn("reason", reason)


def embed_cost(chunks: DataFrame, text_col: str, by: str) -> DataFrame:
    chars = F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("long")
    return chunks.groupBy(by).agg(F.count("*").alias("n"), chars.alias("chars"), (chars / 1000 * F.lit(0.00001)).alias("cost"))


def reuse_by_hash(chunks: DataFrame, text_col: str, task: str, model: str) -> DataFrame:
    """One row a distinct content key, with how many rows share it (hits once it is cached)."""
    key = F.sha2(F.concat(F.lit(f"{task}:{model}:"), F.coalesce(text_col, F.lit(""))), 256)
    return chunks.groupBy(key.alias("cache_key")).agg(F.count("*").alias("n"), (F.count("*") - 1).alias("hits"))
