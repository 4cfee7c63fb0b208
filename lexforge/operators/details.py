"""Fuller forms of some jobs: excerpts, groups, totals, caches and the rest of what they report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import strip
from .relations import AUTHORITY, PRECEDENCE, lookup, section_key

#: Signals that only answers and jurisdictions show, their weights and levels.
ANSWER_WORDS = ["unconstitutional", "violates article", "fundamental right", "discrimination", "arbitrary", "violates constitution"]
SIGNAL_WEIGHTS = {"overruled_precedent": 6.0, "conflicts_with_sc_judgment": 10.0, "conflicts_with_legal_act": 8.0, "jurisdiction_mismatch": 9.0, "constitutional_violation": 15.0, "temporal_conflict": 5.0}
SIGNAL_LEVELS = {"overruled_precedent": "medium", "conflicts_with_sc_judgment": "high", "conflicts_with_legal_act": "high", "jurisdiction_mismatch": "high", "constitutional_violation": "critical", "temporal_conflict": "medium"}
#: Top k, depth and source priorities of a query's type; filters that are read from the query.
QUERY_PARAMETERS = {
    "factual": (15, "standard", "judicial,legal,go,scheme"), "comparative": (30, "deep", "go,legal,judicial"), "risk_analysis": (25, "deep", "judicial,legal,go"),
    "judicial_constraint": (20, "deep", "judicial,legal"), "temporal": (20, "standard", ""), "jurisdictional": (20, "standard", ""),
}
#: Archetypes, in long and short form, whose orders change no clauses.
NOT_NORMATIVE = ["administrative_action", "procedural_notice", "financial_sanction", "administrative", "procedural", "financial"]
#: Patterns of departments and schemes.
DEPARTMENTS_IN_TEXT = [r"(?i)(?:Department|Ministry|Directorate)\s+of\s+([A-Z][A-Za-z\s&,]+?)(?:\s+Department|\s+Ministry|\.|\,|\z)", r"(?i)((?:[A-Z][a-z]+\s+){1,8}(?:Department|Ministry|Directorate|Board|Commission))"]
SCHEMES_IN_TEXT = [r"(?i)(Jagananna\s+[A-Z][A-Za-z\s]+(?:Scheme)?)", r"(?i)((?:[A-Z][a-z]+\s+){1,4}Scheme)", r"(?i)(Midday\s+Meal\s+Scheme)", r"(?i)(Sarva\s+Shiksha\s+Abhiyan)"]
#: Load test's limits of mean and 95th percentile, in milliseconds.
MEAN_LIMIT, P95_LIMIT = 3500, 5000


def target_key(relations: DataFrame) -> Column:
    """What a relation points at: the resolved id, else the number, else the lower-cased raw text."""
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in relations.columns else F.lit(None).cast("string")
    return F.coalesce(text("target_id"), text("go_number"), F.lower(strip(text("raw_text"))))


def precedence_by_key(relations: DataFrame) -> DataFrame:
    """The relation of highest precedence, then confidence, of each source and target key."""
    rank = lookup(PRECEDENCE, F.col("relation_type"), 0)
    rows = relations.withColumn("target_key", target_key(relations))
    order = W.partitionBy("source_id", "target_key").orderBy(rank.desc(), F.desc("confidence"), "seq")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def dedupe_by_key(relations: DataFrame) -> DataFrame:
    """The first relation of each source, target key and type."""
    rows = relations.withColumn("target_key", target_key(relations))
    order = W.partitionBy("source_id", "target_key", "relation_type").orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def corpus_summary(relations: DataFrame) -> DataFrame:
    """Relations, sources and partial ones of each type over the corpus, all seven types present."""
    counted = relations.groupBy("relation_type").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"), F.count_if(F.col("scope") == "partial").alias("n_partial"))
    types = relations.sparkSession.createDataFrame([(t,) for t in PRECEDENCE], "relation_type string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return types.join(counted, "relation_type", "left").select("relation_type", zero("n"), zero("n_sources"), zero("n_partial"))


def go_alternatives(references: DataFrame, registry: DataFrame) -> DataFrame:
    """ref_id and the other years' ids of references whose number has several years and whose own
    year, if any, is not among them: in the order of years, the most recent, which is taken, left out."""
    years = registry.groupBy(F.col("number").alias("_d")).agg(F.array_sort(F.collect_set(F.col("year"))).alias("years"))
    rows = references.withColumn("_d", F.regexp_replace("number", "[^0-9]", "")).join(years, "_d").filter(F.size("years") > 1)
    rows = rows.filter(~F.coalesce(F.array_contains("years", F.col("year")), F.lit(False)))
    others = F.transform(F.slice("years", 1, F.size("years") - 1), lambda y: F.concat(F.lit("GO.MS.No."), F.col("_d"), F.lit("_"), y.cast("string")))
    return rows.select("ref_id", others.alias("alternatives"))


def overridden_by(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that a judgment governs: document_id, the judgments, and the document's own authority."""
    judged = docs.filter("doc_type = 'judgment'").select(F.col("document_id").alias("target_id"))
    own = relations.filter("relation_type = 'governed_by'").join(judged, "target_id", "left_semi").groupBy(F.col("source_id").alias("document_id")).agg(F.array_sort(F.collect_set("target_id")).alias("overridden_by"))
    return own.join(docs.select("document_id", lookup(AUTHORITY, F.col("doc_type"), 0.5).cast("double").alias("authority")), "document_id", "left")


def thread_records(threads: DataFrame, orders: DataFrame, relations: DataFrame, clauses: DataFrame, as_of: str) -> DataFrame:
    """A row a thread and order that is still active in it, with the number of clauses in effect and the thread's status.

    Orders of administrative, procedural and financial archetypes, in either form of the name,
    supersede nothing.  Effective clauses are rows of effective_clauses.
    """
    state = effective_clauses(threads, orders, relations, clauses, as_of)
    counted = state.groupBy("thread_id", "go_id").agg(F.count("*").alias("n_effective"))
    whole = threads.select("thread_id", "go_id").distinct().groupBy("thread_id").agg(F.count("*").alias("n_orders"))
    active = counted.groupBy("thread_id").agg(F.count("*").alias("n_active"))
    status = whole.join(active, "thread_id", "left").select("thread_id", F.when(F.coalesce("n_active", F.lit(0)) == 0, "SUPERSEDED").when(F.col("n_active") < F.col("n_orders"), "PARTIALLY_ACTIVE").otherwise("ACTIVE").alias("thread_status"))
    return counted.join(status, "thread_id")


def effective_clauses(threads: DataFrame, orders: DataFrame, relations: DataFrame, clauses: DataFrame, as_of: str) -> DataFrame:
    """(thread_id, go_id, clause_id) of the clauses that nothing supersedes and that have not expired at as_of."""
    t = threads.select("thread_id", "go_id").distinct()
    acting = orders.filter(~F.lower(F.coalesce("go_type", F.lit(""))).isin(*NOT_NORMATIVE)).select(F.col("go_id").alias("source_id"))
    strong = relations.filter(F.col("relation_type").isin("supersedes", "amends", "cancels", "replaces")).join(acting, "source_id", "left_semi")
    inside = (
        strong.join(t.withColumnRenamed("go_id", "source_id"), "source_id").join(t.withColumnRenamed("go_id", "target_id"), ["thread_id", "target_id"])
        .select("thread_id", F.col("target_id").alias("go_id"), F.when(F.col("scope") == "partial", section_key(F.col("section"))).alias("_section")).distinct()
    )
    whole, part = inside.filter("_section IS NULL").select("thread_id", "go_id"), inside.filter("_section IS NOT NULL")
    rows = t.join(clauses.select("go_id", "clause_id", "effective_to_date", section_key(F.col("section_path")).alias("_section")), "go_id")
    rows = rows.filter(F.col("effective_to_date").isNull() | (F.col("effective_to_date") >= F.lit(as_of).cast("date")))
    return rows.join(whole.distinct(), ["thread_id", "go_id"], "left_anti").join(part, ["thread_id", "go_id", "_section"], "left_anti").select("thread_id", "go_id", "clause_id")


def fused_rows(hits: DataFrame, first: str, top: int, k: int = 60) -> DataFrame:
    """Rank fusion that keeps, of each chunk, the row of the list called `first` where it has one."""
    own = F.min_by(F.struct("source", "document_id", "score"), F.struct((F.col("source") != first).alias("o"), F.col("source").alias("s")))
    fused = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rnk"))), 12).alias("fused"), own.alias("row"))
    order = W.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "chunk_id", "fused", "rank", "row.*")


def timeline_excerpts(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Each query's dated hits by year with title, authority and the first 150 characters."""
    rows = hits.select("query_id", "chunk_id").distinct().join(chunks.select("chunk_id", "document_id", F.substring("text", 1, 150).alias("excerpt")), "chunk_id")
    rows = rows.join(docs.filter("doc_date IS NOT NULL").select("document_id", "title", F.year("doc_date").alias("year"), F.coalesce("court", F.lit("Government")).alias("authority")), "document_id")
    order = W.partitionBy("query_id").orderBy("year", "chunk_id")
    return rows.select("query_id", F.row_number().over(order).alias("place"), "year", "chunk_id", "title", "authority", "excerpt")


def compared_chunks(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """A row a hit, with its place in its document's list, the document's title and date and how many documents the query compares."""
    rows = hits.select("query_id", "document_id", "chunk_id").distinct()
    compared = rows.groupBy("query_id").agg(F.count_distinct("document_id").alias("documents_compared"))
    order = W.partitionBy("query_id", "document_id").orderBy("chunk_id")
    return rows.withColumn("place", F.row_number().over(order)).join(compared, "query_id").join(docs.select("document_id", "title", F.col("doc_date").cast("string").alias("doc_date")), "document_id", "left")


def validation_summary(hits: DataFrame, relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each query: documents checked, judgments among them by court, overruled ones and a warning for each, joined."""
    bad = relations.filter("relation_type = 'overrules'").groupBy(F.col("target_id").alias("document_id")).agg(F.min("source_id").alias("by"))
    rows = hits.select("query_id", "document_id").distinct().join(docs.select("document_id", "title", "doc_type", "court"), "document_id", "left").join(bad, "document_id", "left")
    warning = F.when(F.col("by").isNotNull(), F.concat(F.coalesce("title", "document_id"), F.lit(" is overruled by "), F.col("by")))
    judged = F.when(F.col("doc_type") == "judgment", F.coalesce("court", F.lit("unknown")))
    return rows.groupBy("query_id").agg(
        F.count("*").alias("documents_checked"), F.count(judged).alias("n_judgments"), F.array_join(F.array_sort(F.collect_set(judged)), ",").alias("courts"), F.count("by").alias("n_overruled"),
        F.array_join(F.array_sort(F.collect_set(warning)), "; ").alias("warnings"),
    )


def citation_title(metadata: list[str]) -> Column:
    """The first filled one of title, subject, case, act, scheme, number and citation, else the document."""
    order = ["title", "subject", "case_name", "act_name", "scheme_name", "go_number", "citation"]
    return F.coalesce(*[F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("None")) for c in order if c in metadata], F.col("document_id"), F.lit("Unknown Document"))


def source_hierarchy(citations: DataFrame) -> DataFrame:
    """Of each query the cited documents by strength: binding, persuasive and other, joined in order of rank."""
    def group(name: str, own: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("rank", "document_id")))), lambda c: c["document_id"]), ",").alias(name)

    strength = F.coalesce("strength", F.lit("other"))
    return citations.groupBy("query_id").agg(group("binding", strength == "binding"), group("persuasive", strength == "persuasive"), group("other", ~strength.isin("binding", "persuasive")))


def context_excerpts(hits: DataFrame, chunks: DataFrame, docs: DataFrame, top: int = 10, length: int = 500) -> DataFrame:
    """A row a passage of a query's prompt context: rank, source, date and excerpt of its best chunks."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    rows = rows.join(chunks.select("chunk_id", "document_id", F.substring("text", 1, length).alias("excerpt")), "chunk_id").join(docs.select("document_id", "title", "doc_date"), "document_id", "left")
    text = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", "document_id"), F.lit(" ("), F.coalesce(F.col("doc_date").cast("string"), F.lit("undated")), F.lit("): "), F.col("excerpt"))
    return rows.select("query_id", "rank", "chunk_id", text.alias("passage"))


def more_signals(hits: DataFrame, docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Signals of mixed jurisdictions (once a query) and of constitutional words in its answer (each)."""
    places = hits.join(docs.select("document_id", "jurisdiction"), "document_id").filter("jurisdiction IS NOT NULL").groupBy("query_id").agg(
        F.max(F.col("jurisdiction").rlike("State|Andhra|Telangana|^AP$")).alias("state"), F.max(F.lower("jurisdiction").isin("india", "central")).alias("central"))
    mixed = places.filter("state AND central").select("query_id", F.lit("jurisdiction_mismatch").alias("signal"), F.lit(1).cast("long").alias("n"))
    low = F.lower(F.coalesce("answer", F.lit("")))
    said = answers.select("query_id", reduce(lambda a, b: a + b, (low.contains(w).cast("long") for w in ANSWER_WORDS)).alias("n")).filter("n > 0")
    return mixed.unionByName(said.select("query_id", F.lit("constitutional_violation").alias("signal"), "n"))


def risk_levels(signals: DataFrame) -> DataFrame:
    """Score and number of signals of each level of each query's (signal, n)."""
    weight = F.try_element_at(F.create_map(*[F.lit(x) for p in SIGNAL_WEIGHTS.items() for x in p]), F.col("signal"))
    level = F.try_element_at(F.create_map(*[F.lit(x) for p in SIGNAL_LEVELS.items() for x in p]), F.col("signal"))
    rows = signals.withColumns({"_w": F.coalesce(weight, F.lit(1.0)), "_l": level})
    n = lambda name: F.coalesce(F.sum(F.when(F.col("_l") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}")
    return rows.groupBy("query_id").agg(F.least(F.sum(F.col("n") * F.col("_w")) * 5, F.lit(100.0)).alias("risk_score"), n("critical"), n("high"), n("medium"), n("low"))


def last_requests(traces: DataFrame, last: int) -> DataFrame:
    """Totals and rates of the last requests by time, and how many went to each pipeline, as rows."""
    recent = traces.orderBy(F.desc("ts"), F.desc("request_id")).limit(last)
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 9)
    total = recent.agg(F.count("*").alias("total_requests"), rate(F.col("routed")).alias("router_usage_rate"), rate(F.col("fallback_used")).alias("fallback_rate"), rate(F.col("failed")).alias("error_rate"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"))
    by = recent.groupBy(F.coalesce("pipeline_used", F.lit("unknown")).alias("pipeline")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(total))


def load_report(stats: DataFrame, traces: DataFrame) -> DataFrame:
    """Latency statistics by pipeline with the success rate and whether mean and 95th percentile keep the limits."""
    rate = traces.groupBy(F.col("pipeline_used").alias("_by")).agg(F.round(1 - F.avg(F.coalesce("failed", F.lit(False)).cast("int")), 9).alias("success_rate"))
    rows = stats.join(rate, F.col("pipeline_used").eqNullSafe(F.col("_by"))).drop("_by")
    return rows.withColumn("passed", (F.col("avg_ms") < MEAN_LIMIT) & (F.col("p95_ms") < P95_LIMIT))


def run_metrics(chunks: DataFrame, batch: int) -> DataFrame:
    """One row of an embedding run: chunks, batches, characters, cost, failed and blank ones."""
    chars = F.length(F.coalesce("text", F.lit("")))
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) == ""
    return chunks.agg(F.count("*").alias("n_chunks"), F.ceil(F.count("*") / batch).alias("n_batches"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"), F.coalesce(F.sum(chars) / 1000 * F.lit(0.00001), F.lit(0.0)).alias("cost"), F.count_if(blank).alias("n_blank"))


def cache_lookup(chunks: DataFrame, cache: DataFrame, task: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(distinct keys that the cache lacks with one text each, a row of hits, misses and hit rate).

    A repeated content is one miss and then hits.
    """
    keyed = chunks.select(F.sha2(F.concat(F.lit(f"{task}:{model}:"), F.coalesce("text", F.lit(""))), 256).alias("cache_key"), "text")
    distinct = keyed.groupBy("cache_key").agg(F.count("*").alias("n"), F.min("text").alias("text")).join(cache.select("cache_key", F.lit(True).alias("cached")), "cache_key", "left")
    missed = F.sum(F.when(F.col("cached"), 0).otherwise(1))
    stats = distinct.agg(F.sum("n").alias("requests"), missed.alias("misses"), (F.sum("n") - missed).alias("hits")).withColumn("hit_rate", F.round(F.col("hits") / F.col("requests"), 9))
    return distinct.filter("cached IS NULL").select("cache_key", "text"), stats


def purge_cache(cache: DataFrame, as_of: str, days: int) -> DataFrame:
    """Entries no older than `days` at as_of; undated ones stay."""
    return cache.filter(F.col("created").isNull() | (F.datediff(F.lit(as_of).cast("date"), F.col("created")) <= days))


def delete_from_tables(tables: dict[str, DataFrame], ids: dict[str, str], patterns: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows whose id column, by the table's name, is like a pattern; tables without an id column stay."""
    out = {}
    for name, frame in tables.items():
        hit = reduce(lambda a, b: a | b, (F.coalesce(F.col(ids[name]).like(p), F.lit(False)) for p in patterns)) if name in ids else F.lit(False)
        out[name] = frame.filter(~hit)
    return out


def query_parameters(kind: Column) -> dict[str, Column]:
    """top_k, depth, source priorities and which filters are read from the query, of a query's type."""
    pick = lambda i, other: reduce(lambda a, kv: a.when(kind == kv[0], F.lit(kv[1][i])), QUERY_PARAMETERS.items(), F.when(F.lit(False), other)).otherwise(other)
    return {"top_k": pick(0, 20), "depth": pick(1, "standard"), "source_priorities": F.filter(F.split(pick(2, ""), ","), lambda x: x != ""), "temporal_from_query": kind == "temporal", "jurisdiction_from_query": kind == "jurisdictional"}


def extraction_gate(text: Column, pages: Column) -> dict[str, Column]:
    """Words, characters and pages of a text, and whether it is enough, needs recognition or is garbled."""
    text = F.coalesce(text, F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))
    return {
        "n_words": words, "n_chars": F.length(text), "n_pages": pages, "ok": words > 50, "needs_ocr": (strip(text) == "") | (words < 10 * pages), "garbled": F.substring(text, 1, 2000).rlike(r"\(cid:[0-9]+\)"),
    }


def departments_and_schemes(text: Column) -> tuple[Column, Column]:
    """Sorted distinct departments and schemes that a text names, ten at most each."""
    text = F.coalesce(text, F.lit(""))
    every = lambda patterns: F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    tidy = F.transform(every(DEPARTMENTS_IN_TEXT), lambda d: F.regexp_replace(F.regexp_replace(strip(d), "^,+|,+$", ""), r"^\.+|\.+$", ""))
    pick = lambda found: F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda d: F.length(d) > 5))), 1, 10)
    return pick(tidy), pick(F.transform(every(SCHEMES_IN_TEXT), strip))


def documents_with_authority(documents: DataFrame, authorities: DataFrame) -> DataFrame:
    """Migrated documents with their first authority by name; State Government where there is none."""
    first = authorities.groupBy(F.col("go_id").alias("document_id")).agg(F.min("authority_name").alias("authority"))
    return documents.join(first, "document_id", "left").withColumn("authority", F.coalesce("authority", F.lit("State Government")))


def report_totals(orders: DataFrame, effects: DataFrame, links: DataFrame, pattern: str) -> DataFrame:
    """(section, name, n, n_documents) of an ingestion report over ids like a pattern: orders and their
    archetypes, effects by role, distinct acts."""
    own = lambda df: df.filter(F.col("go_id").like(pattern))
    part = lambda df, section, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.count_distinct("go_id").alias("n_documents")).select(F.lit(section).alias("section"), "name", "n", "n_documents")
    total = own(orders).agg(F.count("*").alias("n"), F.count_distinct("go_id").alias("n_documents")).select(F.lit("orders").alias("section"), F.lit("all").alias("name"), "n", "n_documents")
    return total.unionByName(part(own(orders), "archetype", F.col("go_type"))).unionByName(part(own(effects), "effect", F.col("effect_role"))).unionByName(part(own(links), "act", F.col("act_name")))
