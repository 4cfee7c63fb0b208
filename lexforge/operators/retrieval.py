"""Ranking of hits, answers' evaluation and operations figures, for whole sets of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import counted_before

#: Court and binding weights, short court names.
COURTS = {"supreme court": 1.5, "sc": 1.5, "supreme court of india": 1.5, "high court": 1.2, "hc": 1.2}
BINDING = {"binding": 1.3, "persuasive": 1.1}


def _ranked(df: DataFrame, *order) -> Column:
    return F.row_number().over(W.partitionBy("query_id").orderBy(*order))


def exclude_overruled(hits: DataFrame, relations: DataFrame) -> DataFrame:
    bad = relations.filter("relation_type = 'overrules'").select(F.col("target_id").alias("document_id")).distinct()
    return hits.join(bad, "document_id", "left_anti")


def rrf(hits: DataFrame, top: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of each query's lists; ties by chunk id."""
    fused = hits.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rnk"))).alias("fused"), F.count("*").alias("n_lists"))
    rounded = fused.withColumn("fused", F.round("fused", 12))
    return rounded.withColumn("rank", _ranked(rounded, F.desc("fused"), "chunk_id")).filter(F.col("rank") <= top)


def authority_boost(hits: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """Scores times court and binding weights, ranked anew."""
    court = F.coalesce(_lookup(COURTS, F.lower(F.trim("court"))), F.lit(1.0))
    binding = F.coalesce(_lookup(BINDING, F.lower("binding_strength")), F.lit(1.0))
    scored = hits.join(docs.select("document_id", "court", "binding_strength"), "document_id", "left")
    scored = scored.withColumn("boosted", F.round(F.col("score") * court * binding, 6))
    return scored.withColumn("rank", _ranked(scored, F.desc("boosted"), "chunk_id", "source")).filter(F.col("rank") <= top).select(
        "query_id", "chunk_id", "source", "boosted", "rank"
    )


def _lookup(values: dict, key: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def source_priority(hits: DataFrame, docs: DataFrame, priorities: list[str], top: int) -> DataFrame:
    """By the place of the document's type in the list (999 if not in it), then score."""
    place = F.array_position(F.array(*map(F.lit, priorities)), F.col("doc_type"))
    place = F.when(place > 0, place).otherwise(999).cast("int")
    rows = hits.join(docs.select("document_id", "doc_type"), "document_id").withColumn("place", place)
    return rows.withColumn("rank", _ranked(rows, "place", F.desc("score"), "chunk_id", "source")).filter(F.col("rank") <= top).select(
        "query_id", "chunk_id", "source", "doc_type", "rank"
    )


def temporal_context(queries: DataFrame, text_col: str) -> DataFrame:
    """First year of the text and the operator of the first keyword that it holds."""
    low = F.lower(text_col)
    operator = (
        F.when(low.contains("before"), "before").when(low.contains("after") | low.contains("since"), "after")
        .when(low.contains("until"), "before").when(low.contains("during") | low.contains("in"), "during").otherwise("exact")
    )
    year = F.regexp_extract(text_col, r"\b(19[0-9]{2}|20[0-9]{2})\b", 1)
    return queries.withColumn("year", F.when(year != "", year.cast("int"))).withColumn("operator", F.when(F.col("year").isNotNull(), operator))


def temporal_filter(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits that fit their query's (year, operator); hits without a date stay."""
    y, q = F.year("doc_date"), F.col("q_year")
    fits = (
        F.when((F.col("operator") == "before"), y < q).when(F.col("operator") == "after", y > q)
        .when(F.col("operator") == "during", F.abs(y - q) <= 2).otherwise(y == q)
    )
    rows = hits.join(docs.select("document_id", "doc_date"), "document_id", "left").join(queries, "query_id")
    return rows.filter(y.isNull() | q.isNull() | fits).select("query_id", "chunk_id", "source", y.alias("year"))


def compare_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    rows = hits.join(docs.select("document_id", "title", "doc_date"), "document_id")
    return rows.groupBy("query_id", "document_id").agg(F.min("title").alias("title"), F.min("doc_date").alias("doc_date"), F.count("*").alias("n_chunks"), F.max("score").alias("best"))


def answer_confidence(hits: DataFrame, docs: DataFrame) -> DataFrame:
    rows = hits.join(docs.select("document_id", "binding_strength"), "document_id", "left")
    n, b = F.count("*"), F.sum((F.coalesce("binding_strength", F.lit("")) == "binding").cast("long"))
    return rows.groupBy("query_id").agg(n.alias("n"), b.alias("n_binding")).withColumn(
        "confidence", F.round(F.least(F.col("n") / 5, F.lit(1.0)) * 0.4 + F.least(F.col("n_binding") / 3, F.lit(1.0)) * 0.6, 9)
    )


def _both(expected: DataFrame, actual: DataFrame, how: str) -> DataFrame:
    e = expected.select("query_id", "document_id", F.col("authority").alias("e_authority"), F.col("doc_date").alias("e_date"), F.lit(1).alias("_e"))
    a = actual.select("query_id", "document_id", F.col("authority").alias("a_authority"), F.col("doc_date").alias("a_date"), F.lit(1).alias("_a"))
    return e.join(a, ["query_id", "document_id"], how)


def citation_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Correct, incorrect and missing citations of each query."""
    e, a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    n = lambda c: F.sum(c.cast("long"))
    got = _both(expected, actual, "full_outer").groupBy("query_id").agg(
        n(e & a).alias("correct"), n(a & ~e).alias("incorrect"), n(e & ~a).alias("missing"), n(e).alias("_expected"), n(a).alias("_actual")
    )
    total = F.when(F.col("_expected") > 0, F.col("_expected")).otherwise(F.col("_actual"))
    return got.select("query_id", "correct", "incorrect", "missing", total.alias("total"), F.round(F.col("correct") / total, 9).alias("accuracy"))


def match_rate(expected: DataFrame, actual: DataFrame, left: Column, right: Column) -> DataFrame:
    """Of each query's documents in both lists, how many agree in an attribute."""
    rows = _both(expected, actual, "inner").groupBy("query_id").agg(F.count("*").alias("total"), F.sum((left == right).cast("long")).alias("correct"))
    return rows.withColumn("rate", F.round(F.col("correct") / F.col("total"), 9))


def risk_detection(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: how often the actual risk level is the expected one, and which way it errs.

    Both hold (query_id, risk_level).  Queries without an expected level are skipped.  A
    level of risk where none is expected is a false positive, none where some is expected a
    false negative; an unknown or missing level is only incorrect.
    """
    risky = ("low", "medium", "high", "critical")
    want, got = F.col("want"), F.col("got")
    both = expected.select("query_id", F.col("risk_level").alias("want")).dropna(subset=["want"]).join(actual.select("query_id", F.col("risk_level").alias("got")), "query_id", "left")
    right = F.count_if(want.eqNullSafe(got))
    return both.agg(
        F.count("*").alias("total_queries"), right.alias("correct"), (F.count("*") - right).alias("incorrect"),
        F.count_if((want == "none") & got.isin(*risky)).alias("false_positives"), F.count_if(want.isin(*risky) & (got == "none")).alias("false_negatives"),
        F.round(F.coalesce(right / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 9).alias("accuracy"),
    )


def trace_metrics(traces: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 9)
    return traces.groupBy("pipeline_used").agg(
        F.count("*").alias("n"), rate("fallback_used").alias("fallback_rate"), rate("failed").alias("error_rate"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms")
    )


def latency_stats(traces: DataFrame, percent: float = 0.95) -> DataFrame:
    """Exact rank statistics by pipeline: the value at place int(n * percent) counted from 0."""
    totals = traces.groupBy(F.col("pipeline_used").alias("_by")).agg(
        F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms")
    )
    steps = counted_before(traces.groupBy("pipeline_used", "latency_ms").agg(F.count("*").alias("_m")), "pipeline_used", ["latency_ms"], "_m")
    place = F.floor(F.col("n") * percent)
    at = F.col("pipeline_used").eqNullSafe(F.col("_by")) & (F.col("before") <= place) & (place < F.col("before") + F.col("_m"))
    return totals.join(steps, at, "left").select(F.col("_by").alias("pipeline_used"), "n", "avg_ms", "min_ms", "max_ms", F.col("latency_ms").alias("p95_ms"))


#: Weights of the overall score; the hallucination rate counts as one minus itself.
SCORE_WEIGHTS = {"citation_accuracy": 0.3, "authority_correctness": 0.25, "temporal_correctness": 0.15, "hallucination_rate": 0.2, "risk_detection": 0.1}


def overall_score(citations: DataFrame, authority: DataFrame, dates: DataFrame, claims: DataFrame, risks: DataFrame) -> DataFrame:
    """One row: each metric over all queries (sums of counts, not means of rates) and their weighted score.

    The frames are those of citation_accuracy, match_rate (twice), claim support (n_claims,
    n_supported) and risk_detection.  A metric without anything to count is 0.
    """
    part = lambda df, good, total, name: df.agg(F.round(F.coalesce(F.sum(good) / F.nullif(F.sum(total), F.lit(0)), F.lit(0.0)), 9).alias(name))
    rows = (
        part(citations, "correct", "total", "citation_accuracy").join(part(authority, "correct", "total", "authority_correctness"))
        .join(part(dates, "correct", "total", "temporal_correctness"))
        .join(claims.agg(F.round(F.coalesce(1 - F.sum("n_supported") / F.nullif(F.sum("n_claims"), F.lit(0)), F.lit(0.0)), 9).alias("hallucination_rate")))
        .join(risks.agg(F.round(F.coalesce(F.max("accuracy"), F.lit(0.0)), 9).alias("risk_detection")))
    )
    score = sum(w * ((1 - F.col(n)) if n == "hallucination_rate" else F.col(n)) for n, w in SCORE_WEIGHTS.items())
    return rows.withColumn("overall_score", F.round(score, 6))


def evaluation_results(runs: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A row a query of an evaluation: whether it ran, its error, and its citation counts.

    runs: every query's query_id and error (null: it ran).  A query that failed has no counts
    and takes no part in the metrics; neither do answers to queries outside the runs.
    """
    counts = citation_accuracy(expected, actual)
    ran = F.col("error").isNull()
    rows = runs.select("query_id", "error").join(counts, "query_id", "left")
    return rows.select("query_id", ran.alias("success"), "error", *[F.when(ran, F.coalesce(c, F.lit(0))).alias(c) for c in ("correct", "incorrect", "missing")], F.when(ran, F.coalesce("accuracy", F.lit(0.0))).alias("accuracy"))


def evaluation_counts(results: DataFrame) -> DataFrame:
    """One row: how many queries there were, ran and failed, and the share of expected citations found by those that ran."""
    total = F.sum(F.col("correct") + F.col("missing"))
    return results.agg(
        F.count("*").alias("total_queries"), F.count_if("success").alias("successful_queries"), F.count_if(~F.col("success")).alias("failed_queries"),
        F.round(F.coalesce(F.sum("correct") / F.nullif(total, F.lit(0)), F.lit(0.0)), 9).alias("recall"),
    )
