"""Relations between documents: filters, precedence, resolution, routing and legal status.

Frames have source_id, target_id, relation_type, confidence, scope, section and seq (the
order of discovery).  All ranking has total orders, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import counted_before

#: Precedence of the allowed types.
PRECEDENCE = {"overrules": 6, "supersedes": 5, "cancels": 4, "amends": 3, "clarifies": 2, "references": 1, "overruled_by": 0}
#: Authority of a document type.
AUTHORITY = {"judicial_supreme": 1.0, "judicial_high": 0.9, "act": 0.85, "rules": 0.8, "go": 0.7, "circular": 0.5, "memo": 0.4}


def lookup(values: dict, key: Column, other) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other))


def allowed_types(relations: DataFrame) -> DataFrame:
    return relations.filter(F.col("relation_type").isin(list(PRECEDENCE)))


def drop_self_refs(relations: DataFrame) -> DataFrame:
    """Without relations to the source itself or to a number that its id holds.

    A target without digits, such as a case name, has no number to compare; relations with a
    null id on either side stay.
    """
    number = F.nullif(F.regexp_extract("target_id", "[0-9]+", 0), F.lit(""))
    own = (F.col("source_id") == F.col("target_id")) | F.col("source_id").contains(number)
    return relations.filter(~F.coalesce(own, F.lit(False)))


def precedence(relations: DataFrame) -> DataFrame:
    """For each source and target the relation of highest precedence, then confidence."""
    rank = lookup(PRECEDENCE, F.col("relation_type"), 0)
    order = W.partitionBy("source_id", "target_id").orderBy(rank.desc(), F.desc("confidence"), "seq", "scope", "section")
    return relations.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def dedupe(relations: DataFrame) -> DataFrame:
    """The first found of each source, target and type."""
    order = W.partitionBy("source_id", "target_id", "relation_type").orderBy("seq", F.desc("confidence"), "scope", "section")
    return relations.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def summary(relations: DataFrame) -> DataFrame:
    """Counts by type and flags for each source."""
    is_ = lambda t: (F.col("relation_type") == t).cast("long")
    return relations.groupBy("source_id").agg(
        *[F.sum(is_(t)).alias(f"n_{t}") for t in ("supersedes", "amends", "cancels", "references")],
        F.max(F.col("relation_type") == "supersedes").alias("has_supersession"),
        F.max(F.col("relation_type") == "amends").alias("has_amendment"),
        F.sum((F.col("scope") == "partial").cast("long")).alias("n_partial"),
    )


def resolve_go(references: DataFrame, registry: DataFrame) -> DataFrame:
    """References (ref_id, number, year) to ids of the registry (number, year, canonical_id).

    The year named wins (0.95); else the only year (0.90) or the latest (0.70); else failed.
    The registry is summed up by number first, so the join meets one row for each number.
    """
    by_number = registry.groupBy(F.col("number").alias("_n")).agg(
        F.count("*").alias("_years"), F.max_by("canonical_id", "year").alias("_latest")
    )
    exact = registry.select(F.col("number").alias("_en"), F.col("year").alias("_ey"), F.col("canonical_id").alias("_exact"))
    digits = F.regexp_replace("number", "[^0-9]", "")
    joined = (
        references.withColumn("_d", digits)
        .join(by_number, F.col("_d") == F.col("_n"), "left")
        .join(exact, (F.col("_d") == F.col("_en")) & (F.col("year") == F.col("_ey")), "left")
    )
    method = (
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_years") == 1, "inferred_single_year")
        .when(F.col("_years") > 1, "inferred_most_recent").otherwise("failed")
    )
    confidence = {"exact": 0.95, "inferred_single_year": 0.9, "inferred_most_recent": 0.7}
    return joined.withColumn("method", method).select(
        "ref_id", "number", "year", F.coalesce("_exact", "_latest").alias("canonical_id"), "method",
        lookup(confidence, F.col("method"), 0.0).alias("confidence"),
    )


def route(relations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved relations with their source, candidates): by whether the target is known."""
    ids = known.select(F.col("go_id").alias("target_id")).distinct()
    resolved = relations.join(ids, "target_id", "left_semi").withColumn("origin", F.when(F.col("confidence") > 0.9, "llm").otherwise("rule"))
    return resolved, relations.join(ids, "target_id", "left_anti")


def chain_flags(orders: DataFrame, relations: DataFrame) -> DataFrame:
    """Whether each order is superseded and by whom (the first incoming edge)."""
    into = relations.filter(F.col("relation_type").isin("supersedes", "amends")).groupBy(F.col("target_id").alias("go_id")).agg(
        F.min(F.struct("seq", "source_id")).alias("_first")
    )
    return orders.join(into, "go_id", "left").select(
        "go_id", F.col("_first").isNotNull().alias("is_superseded"), F.col("_first.source_id").alias("superseded_by"),
        F.col("_first").isNull().alias("is_most_recent"),
    )


def active_status(orders: DataFrame, relations: DataFrame) -> DataFrame:
    """INACTIVE if a relation of full scope supersedes or cancels the order."""
    hit = relations.filter("scope = 'full' AND relation_type IN ('supersedes', 'cancels')").select(F.col("target_id").alias("go_id")).distinct()
    return orders.join(hit.withColumn("_hit", F.lit(True)), "go_id", "left").select(
        "go_id", "go_number", F.when(F.col("_hit"), "INACTIVE").otherwise("ACTIVE").alias("status")
    )


def legal_status(docs: DataFrame, relations: DataFrame) -> DataFrame:
    """Earlier lineage, whether it amends only in part, and authority of each document."""
    own = relations.groupBy(F.col("source_id").alias("document_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("relation_type").isin("supersedes", "amends"), F.col("target_id")))).alias("lineage"),
        F.max(F.col("relation_type") == "amends").alias("_amends"),
    )
    return docs.join(own, "document_id", "left").select(
        "document_id", F.coalesce(F.array_join("lineage", ","), F.lit("")).alias("previous_lineage"),
        F.when(F.col("_amends"), "partial").otherwise("full").alias("valid_scope"),
        lookup(AUTHORITY, F.col("doc_type"), 0.5).cast("double").alias("authority"),
    )


def authority_conflict(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Which end of each relation has more authority."""
    kinds = docs.select("document_id", lookup(AUTHORITY, F.col("doc_type"), 0.5).alias("w"))
    a = kinds.select(F.col("document_id").alias("source_id"), F.col("w").alias("_a"))
    b = kinds.select(F.col("document_id").alias("target_id"), F.col("w").alias("_b"))
    pairs = relations.select("source_id", "target_id").distinct().join(a, "source_id").join(b, "target_id")
    return pairs.select("source_id", "target_id", F.when(F.col("_a") > F.col("_b"), "source").when(F.col("_b") > F.col("_a"), "target").otherwise("equal").alias("winner"))


def section_key(path: Column) -> Column:
    """A section path without dots and the words rule, section, para and phrase."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(path), r"rule|section|para|phrase", ""), r"\.", ""))


def resolve_threads(threads: DataFrame, orders: DataFrame, relations: DataFrame, clauses: DataFrame, as_of: str) -> DataFrame:
    """Status of each order in each of its threads, from its clauses' states.

    A clause is superseded by a normative order of the same thread that supersedes, amends,
    cancels or replaces its order: all clauses, or with partial scope those of the section
    named.  Others are inactive once expired at as_of.
    """
    t = threads.select("thread_id", "go_id").distinct()
    normative = orders.filter("go_type = 'normative'").select(F.col("go_id").alias("source_id"))
    strong = relations.filter(F.col("relation_type").isin("supersedes", "amends", "cancels", "replaces")).join(normative, "source_id", "left_semi")
    inside = (
        strong.join(t.withColumnRenamed("go_id", "source_id"), "source_id")
        .join(t.withColumnRenamed("go_id", "target_id"), ["thread_id", "target_id"])
        .select("thread_id", F.col("target_id").alias("go_id"), F.when(F.col("scope") == "partial", section_key(F.col("section"))).alias("_section")).distinct()
    )
    whole = inside.filter("_section IS NULL").select("thread_id", "go_id").distinct().withColumn("_whole", F.lit(True))
    part = inside.filter("_section IS NOT NULL").distinct().withColumn("_part", F.lit(True))
    state = (
        t.join(clauses.select("go_id", "clause_id", "effective_to_date", section_key(F.col("section_path")).alias("_section")), "go_id")
        .join(whole, ["thread_id", "go_id"], "left").join(part, ["thread_id", "go_id", "_section"], "left")
        .withColumn("state", F.when(F.coalesce("_whole", "_part"), "SUPERSEDED").when(F.col("effective_to_date") < F.lit(as_of).cast("date"), "INACTIVE").otherwise("ACTIVE"))
    )
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return state.groupBy("thread_id", "go_id").agg(F.count("*").alias("n_clauses"), n("ACTIVE").alias("n_active"), n("SUPERSEDED").alias("n_superseded")).withColumn(
        "status", F.when(F.col("n_active") == F.col("n_clauses"), "ACTIVE").when(F.col("n_active") > 0, "PARTIALLY_ACTIVE").otherwise("SUPERSEDED")
    )


def thread_rollup(threads: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of each thread by date, as one text; a row a thread (kept apart from exploded tables)."""
    rows = threads.select("thread_id", "go_id").distinct().join(orders.select("go_id", "go_date"), "go_id")
    return rows.groupBy("thread_id").agg(
        F.count("*").alias("n_orders"), F.min("go_date").alias("first_date"), F.max("go_date").alias("last_date"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("go_date", "go_id"))), lambda x: x["go_id"]), ",").alias("go_ids"),
    )


def thread_members(threads: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of each thread by date, a row an order with its place from 1, however large the thread."""
    rows = threads.select("thread_id", "go_id").distinct().join(orders.select("go_id", "go_date"), "go_id").select("thread_id", "go_id", "go_date")
    return counted_before(rows, "thread_id", ["go_date", "go_id"]).select("thread_id", (F.col("before") + 1).alias("place"), "go_id")
