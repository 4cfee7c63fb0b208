"""What is said about whole sets of queries' hits: timelines, layers, checks, citations, context and risk.

Hits have query_id, chunk_id, document_id, source, score and rnk; docs have document_id, title,
doc_type, doc_date, court, binding_strength and status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Authority weights of citations, weights of risk signals, least score of each level.
CITATION_WEIGHTS = {"Supreme Court": 10.0, "High Court": 7.0, "Statutory Law": 8.0, "Government Order": 5.0, "Policy Document": 4.0, "Scheme": 3.0}
RISK_WEIGHTS = {"overruled_precedent": 6.0, "conflicts_with_sc_judgment": 10.0, "conflicts_with_legal_act": 8.0, "temporal_conflict": 5.0}
RISK_LEVELS = {"critical": 80, "high": 60, "medium": 40, "low": 20}


def _table(values: dict, key, other):
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def timeline(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Each query's dated documents by date, numbered; a document once."""
    rows = hits.select("query_id", "document_id").distinct().join(docs.filter("doc_date IS NOT NULL").select("document_id", "title", "doc_date"), "document_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("doc_date", "document_id"))
    return rows.select("query_id", place.alias("place"), F.year("doc_date").alias("year"), "document_id", "title")


def layered(hits: DataFrame, docs: DataFrame, layers: dict[str, tuple[float, list[str]]], top: int) -> DataFrame:
    """Each layer's best share of `top`, a chunk in its first layer only, then the best of all.

    layers: name to (share, document types), first layers first.
    """
    number, quota = F.lit(None).cast("int"), F.lit(0)
    for i, (share, kinds) in reversed(list(enumerate(layers.values()))):
        number = F.when(F.col("doc_type").isin(kinds), i).otherwise(number)
        quota = F.when(F.col("_layer") == i, int(top * share)).otherwise(quota)
    rows = hits.join(docs.select("document_id", "doc_type"), "document_id").withColumn("_layer", number).filter("_layer IS NOT NULL")
    rows = rows.groupBy("query_id", "chunk_id").agg(F.min("_layer").alias("_layer"), F.max("score").alias("score"))
    order = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))
    rows = rows.withColumn("_n", order("query_id", "_layer")).filter(F.col("_n") <= quota)
    names = F.array(*map(F.lit, layers))
    return rows.select("query_id", "chunk_id", F.get(names, F.col("_layer")).alias("layer"), "score", order("query_id").alias("rank"))


def judicial_validation(hits: DataFrame, relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Each query's documents that another overrules, with both titles and the binding strength."""
    pairs = relations.filter("relation_type = 'overrules'").select(F.col("target_id").alias("document_id"), F.col("source_id").alias("overruled_by")).distinct()
    titles = docs.select(F.col("document_id").alias("overruled_by"), F.col("title").alias("overruling_title"))
    return (
        hits.select("query_id", "document_id").distinct().join(pairs, "document_id").join(titles, "overruled_by", "left")
        .join(docs.select("document_id", "title", "binding_strength"), "document_id", "left")
        .select("query_id", "document_id", "title", "overruled_by", "overruling_title", F.coalesce("binding_strength", F.lit("unknown")).alias("binding_strength"))
    )


def citations(hits: DataFrame, docs: DataFrame, top: int = 5) -> DataFrame:
    """Each query's documents of most authority (then best score), with a formatted citation."""
    authority = (
        F.when(F.col("doc_type") == "judgment", F.when(F.col("court") == "Supreme Court", "Supreme Court").when(F.col("court") == "hc", "High Court").otherwise("Tribunal"))
        .when(F.col("doc_type") == "regulation", "Statutory Law").when(F.col("doc_type") == "go", "Government Order").otherwise("Policy Document")
    )
    best = hits.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    rows = best.join(docs, "document_id").withColumn("authority", authority).withColumn("weight", _table(CITATION_WEIGHTS, F.col("authority"), 1.0))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), F.desc("score"), "document_id"))
    text = F.concat_ws(", ", "title", "authority", F.year("doc_date").cast("string"), "binding_strength")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "document_id", "authority", text.alias("citation"))


def context_pack(hits: DataFrame, docs: DataFrame, top: int = 10) -> DataFrame:
    """One text a query: its best chunks, numbered, with title and date."""
    rows = hits.join(docs.select("document_id", "title", "doc_date"), "document_id", "left")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "source"))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", "document_id"), F.lit(" ("), F.coalesce(F.col("doc_date").cast("string"), F.lit("undated")), F.lit("): "), F.col("chunk_id"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), joined.alias("context"))


def risk_signals(hits: DataFrame, relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Signals of each query and how often each occurs.

    A hit on an overruled document and one on a superseded document count each; several
    Supreme Court hits, and orders beside regulations, once a query.
    """
    bad = relations.filter("relation_type = 'overrules'").select(F.col("target_id").alias("document_id")).distinct().withColumn("_bad", F.lit(True))
    rows = hits.join(docs.select("document_id", "doc_type", "court", "status"), "document_id", "left").join(bad, "document_id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    counts = rows.groupBy("query_id").agg(
        n(F.col("_bad")).alias("overruled_precedent"), n(F.col("status") == "superseded").alias("temporal_conflict"),
        (n((F.col("doc_type") == "judgment") & (F.col("court") == "Supreme Court")) > 1).cast("long").alias("conflicts_with_sc_judgment"),
        ((n(F.col("doc_type") == "go") > 0) & (n(F.col("doc_type") == "regulation") > 0)).cast("long").alias("conflicts_with_legal_act"),
    )
    return counts.unpivot("query_id", list(RISK_WEIGHTS), "signal", "n").filter("n > 0")


def risk_score(signals: DataFrame) -> DataFrame:
    """Five times the sum of the signals' weights, at most 100, and its level."""
    total = F.sum(F.col("n") * _table(RISK_WEIGHTS, F.col("signal"), 1.0))
    level = F.lit("none")
    for name, least in reversed(RISK_LEVELS.items()):
        level = F.when(F.col("risk_score") >= least, name).otherwise(level)
    return signals.groupBy("query_id").agg(F.sum("n").alias("n_signals"), F.least(total * 5, F.lit(100.0)).alias("risk_score")).withColumn("risk_level", level)


def claim_support(answers: DataFrame, context: DataFrame, share: float = 0.3) -> DataFrame:
    """Claims of each answer and those that its query's context supports.

    answers: query_id, answer; context: query_id, context.  Claims are the answer's parts
    between full stops of over 20 characters; one is supported if at least `share` of its
    distinct words of over 3 characters stand in the context.  An answer without context has
    no supported claim.  Claims without such words are not supported.
    """
    space = r"[ \t\n\r\f\x0B]"
    parts = F.filter(F.transform(F.split("answer", r"\.", -1), lambda x: F.regexp_replace(x, rf"\A{space}+|{space}+\z", "")), lambda x: F.length(x) > 20)
    rows = answers.join(context, "query_id", "left").select("query_id", F.lower(F.coalesce("context", F.lit(""))).alias("_c"), F.explode(parts).alias("claim"))
    words = F.filter(F.array_distinct(F.split(F.lower("claim"), rf"{space}+", -1)), lambda w: F.length(w) > 3)
    rows = rows.withColumn("_w", words)
    found = F.size(F.filter("_w", lambda w: F.col("_c").contains(w)))
    good = (F.size("_w") > 0) & (found >= F.size("_w") * share)
    return rows.groupBy("query_id").agg(F.count("*").alias("n_claims"), F.sum(good.cast("long")).alias("n_supported")).withColumn(
        "hallucination_rate", F.round(1 - F.col("n_supported") / F.col("n_claims"), 9)
    )
