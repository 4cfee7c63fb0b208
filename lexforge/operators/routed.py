"""Retrieval whose settings differ by query: layers of one query and pipelines P1 to P5, all in one pass.

A run is one search: query_id, text, domains, top_k, priorities (document types that come
first, null for none) and, where given, since_date and jurisdiction.  The searches take the
largest top_k and each run is cut to its own, which is a prefix of what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import written
from .answers import citations, judicial_validation, risk_score, risk_signals, timeline
from .postings import LexicalIndex
from .retrieval import answer_confidence, authority_boost, compare_documents, exclude_overruled, rrf
from .search import lexical_search, route_pipelines, vector_search, vertical_domains

#: Each layer's share of the hits, first layers first.
LAYER_SHARES = {"primary": 0.5, "binding": 0.3, "impact": 0.2}
#: Document types of the judicial and legal verticals, which come first among binding constraints.
BINDING_FIRST = ("judgment", "regulation")


def _optional(queries: DataFrame) -> list[str]:
    return [c for c in ("since_date", "jurisdiction") if c in queries.columns]


def search_runs(runs: DataFrame, chunks: DataFrame, docs: DataFrame, vectors: DataFrame, run_vectors: DataFrame, relations: DataFrame, index: LexicalIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, score, rank): each run's best top_k.

    Lexical search, overruled documents out, vector search among what is left, rank fusion,
    authority weights, prior document types first.  Only the largest top_k comes to the driver.
    Runs without lexical hits, or with a null top_k, get no rows.
    """
    runs = written(runs.filter("top_k > 0"), "runs")
    most = runs.agg(F.max("top_k")).first()[0] or 0
    limits = runs.select("query_id", "top_k", "priorities")

    def cut(rows: DataFrame, rank: str) -> DataFrame:
        return rows.join(limits.drop("priorities"), "query_id").filter(F.col(rank) <= 2 * F.col("top_k")).drop("top_k")

    lexical = written(exclude_overruled(cut(lexical_search(runs, chunks, docs, most, index), "rnk"), relations), "lexical")
    near = cut(vector_search(run_vectors, vectors, lexical, 2 * most), "rnk")
    columns = ["query_id", "chunk_id", "document_id", "source", "score", "rnk"]
    both = written(lexical.select(columns).unionByName(near.select(columns)), "both")
    owners = both.groupBy("query_id", "chunk_id").agg(F.min("document_id").alias("document_id"))
    fused = cut(rrf(both, 2 * most), "rank").join(owners, ["query_id", "chunk_id"]).withColumns({"source": F.lit("hybrid"), "score": F.col("fused")})
    boosted = authority_boost(fused, docs, 2 * most).drop("rank").join(owners, ["query_id", "chunk_id"])
    rows = boosted.join(docs.select("document_id", "doc_type"), "document_id", "left").join(limits, "query_id")
    place = F.coalesce(F.nullif(F.array_position("priorities", F.col("doc_type")), F.lit(0)), F.lit(999))
    order = W.partitionBy("query_id").orderBy(F.when(F.size(F.coalesce("priorities", F.array())) > 0, place).otherwise(0), F.desc("boosted"), "chunk_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter("rank <= top_k")
    return ranked.select("query_id", "chunk_id", "document_id", F.col("boosted").alias("score"), "rank")


def layered_retrieve(
    queries: DataFrame, chunks: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, relations: DataFrame, index: LexicalIndex | None = None, binding_first: tuple[str, ...] = BINDING_FIRST
) -> DataFrame:
    """(query_id, chunk_id, document_id, layer, score, rank): a search by layer, joined.

    queries: query_id, text, top_k, and an array of verticals for each layer
    (primary_verticals, binding_verticals, impact_verticals; null or empty: not searched).
    A layer gets its share of top_k, rounded down.  A chunk stays in its first layer only;
    the best top_k of all layers are kept, ties to the first layer and the smaller chunk_id.
    """
    first = F.array(*map(F.lit, binding_first))
    layers = [
        F.struct(F.lit(i).alias("layer"), F.col(f"{name}_verticals").alias("verticals"), F.floor(F.col("top_k") * share).cast("int").alias("k"), F.when(F.lit(name == "binding"), first).alias("priorities"))
        for i, (name, share) in enumerate(LAYER_SHARES.items())
    ]
    rows = queries.select("query_id", "text", *_optional(queries), F.inline(F.array(*layers))).filter(F.size(F.coalesce("verticals", F.array().cast("array<string>"))) > 0)
    runs = rows.select(F.struct("query_id", "layer").alias("query_id"), "text", *_optional(queries), vertical_domains(F.col("verticals")).alias("domains"), F.col("k").alias("top_k"), "priorities")
    own = rows.select("query_id", "layer").join(query_vectors, "query_id").select(F.struct("query_id", "layer").alias("query_id"), "vector")
    hits = search_runs(runs, chunks, docs, vectors, own, relations, index)
    kept = hits.groupBy(F.col("query_id.query_id").alias("query_id"), "chunk_id").agg(F.min(F.struct("query_id.layer", "score", "document_id")).alias("_h")).select("query_id", "chunk_id", "_h.*")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "layer", "chunk_id"))
    names = F.array(*map(F.lit, LAYER_SHARES))
    kept = kept.withColumn("rank", rank).join(queries.select("query_id", "top_k"), "query_id").filter("rank <= top_k")
    return kept.select("query_id", "chunk_id", "document_id", F.get(names, F.col("layer")).alias("layer"), "score", "rank")


def pipeline_retrieve(queries: DataFrame, chunks: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, relations: DataFrame, index: LexicalIndex | None = None) -> DataFrame:
    """Each query's best hits by the settings of its pipeline, in the domains of its domains' verticals.

    queries: query_id, text, pipeline, domains.  An unknown pipeline finds nothing.
    """
    routed = route_pipelines(queries).withColumns({"domains": vertical_domains(F.col("verticals")), "priorities": F.lit(None).cast("array<string>")})
    return search_runs(routed.select("query_id", "text", *_optional(queries), "domains", "top_k", "priorities"), chunks, docs, vectors, query_vectors, relations, index)


def _as_text(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    """One text a query of its lines in order; a query has at most a pipeline's top_k of them."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "; ").alias(name))


def pipeline_package(queries: DataFrame, hits: DataFrame, relations: DataFrame, docs: DataFrame) -> DataFrame:
    """One row a query: what its pipeline requires, from the hits of pipeline_retrieve.

    Citations and confidence always; risk, timeline and comparison where the pipeline requires
    them (else null), overruled documents for P5.  No hits: an empty package of confidence 0;
    an unknown pipeline has a null name and an empty package too.
    """
    asked = route_pipelines(queries.select("query_id", "pipeline", "domains"))
    hits = written(hits.withColumn("source", F.lit("hybrid")).withColumn("rnk", F.col("rank")), "hits")
    need = lambda flag: hits.join(asked.filter(flag).select("query_id"), "query_id", "left_semi")
    years = timeline(need("requires_timeline"), docs)
    compared = compare_documents(need("requires_comparison"), docs)
    risk = risk_score(risk_signals(need("requires_risk"), relations, docs)).select("query_id", "risk_score", "risk_level")
    bad = judicial_validation(need("pipeline = 'P5'"), relations, docs)
    parts = (
        answer_confidence(hits, docs).select("query_id", F.col("n").alias("n_hits"), "confidence"),
        _as_text(citations(hits, docs), "rank", F.col("citation"), "citations"),
        _as_text(years, "place", F.concat_ws(" ", F.col("year").cast("string"), "title"), "timeline"),
        _as_text(compared, "document_id", F.concat_ws(" ", "title", F.year("doc_date").cast("string"), F.col("n_chunks").cast("string")), "comparison"),
        _as_text(bad.groupBy("query_id", "document_id").agg(F.min("overruled_by").alias("by")), "document_id", F.concat_ws(" overruled by ", "document_id", "by"), "constraints"),
        risk,
    )
    out = asked
    for part in parts:
        out = out.join(part, "query_id", "left")
    wanted = lambda flag, c, empty: F.when(F.col(flag), F.coalesce(c, F.lit(empty))).alias(c)
    return out.select(
        "query_id", "pipeline", "pipeline_name", F.array_join("verticals", ",").alias("verticals"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("citations", F.lit("")).alias("citations"), wanted("requires_timeline", "timeline", ""), wanted("requires_comparison", "comparison", ""),
        F.when(F.col("pipeline") == "P5", F.coalesce("constraints", F.lit(""))).alias("constraints"), wanted("requires_risk", "risk_score", 0.0), wanted("requires_risk", "risk_level", "none"),
    )


def audit_rows(hits: DataFrame, docs: DataFrame, top: int = 5) -> DataFrame:
    """What is logged of each query's first hits: document, court, binding strength and score."""
    rows = hits.filter(F.col("rank") <= top).join(docs.select("document_id", "court", "binding_strength"), "document_id", "left")
    return rows.select("query_id", "rank", "document_id", F.coalesce("court", F.lit("N/A")).alias("court"), F.coalesce("binding_strength", F.lit("N/A")).alias("binding_strength"), F.round("score", 4).alias("final_score"))


def filtered_candidates(queries: DataFrame, candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (query_id, document_id) of the query's year and jurisdiction (null: any), for vector_search."""
    asked = queries.select("query_id", F.col("year").alias("_year"), F.col("jurisdiction").alias("_place"))
    rows = candidates.select("query_id", "document_id").distinct().join(asked, "query_id").join(docs.select("document_id", "doc_date", "jurisdiction"), "document_id")
    return rows.filter("(_year IS NULL OR year(doc_date) = _year) AND (_place IS NULL OR jurisdiction = _place)").select("query_id", "document_id").distinct()
