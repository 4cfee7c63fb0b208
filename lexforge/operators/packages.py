"""Whole jobs put together: answers' packages for a set of queries, and the ingestion of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, entities, mentions
from ..functions.segments import query_type
from ..functions.unicode import clean_text
from ..sources.commits import append_committed, create_tables, is_committed
from ..sources.staging import written
from . import chunking, extraction, resolution
from .answers import citations, risk_score, risk_signals, timeline
from .relations import drop_self_refs
from .retrieval import answer_confidence, temporal_context, temporal_filter


def answer_package(queries: DataFrame, hits: DataFrame, relations: DataFrame, docs: DataFrame) -> DataFrame:
    """One row a query: type, domains, hits kept, citations, confidence, risk, and a timeline.

    queries: query_id, text; hits: the retrieved chunks.  Temporal queries keep the hits of
    their years, comparative ones get a timeline, and a query without hits an empty package
    of confidence 0.
    """
    kind, sure, _ = query_type(F.col("text"))
    asked = queries.select("query_id", "text", kind.alias("query_type"), F.round(sure, 9).alias("type_confidence"))
    asked = asked.withColumn("domains", F.array_join(F.transform(classify.query_domains(F.col("text"), F.col("query_type"))["domains"], lambda d: d["domain"]), ","))
    context = temporal_context(asked, "text").select("query_id", F.when(F.col("query_type") == "temporal", F.col("year")).alias("q_year"), "operator")
    fits = temporal_filter(hits, docs, context).select("query_id", "chunk_id", "source")
    kept = written(hits.join(fits.distinct(), ["query_id", "chunk_id", "source"], "left_semi"), "answers")
    cited = citations(kept, docs).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda c: c["citation"]), "; ").alias("citations"))
    sure = answer_confidence(kept, docs).select("query_id", F.col("n").alias("n_hits"), "confidence")
    risk = risk_score(risk_signals(kept, relations, docs)).select("query_id", "risk_score", "risk_level")
    comparative = asked.filter("query_type = 'comparative'").select("query_id")
    years = timeline(kept.join(comparative, "query_id", "left_semi"), docs).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "year", "title"))), lambda t: F.concat_ws(" ", t["year"].cast("string"), t["title"])), "; ").alias("timeline"))
    out = asked.join(sure, "query_id", "left").join(cited, "query_id", "left").join(risk, "query_id", "left").join(years, "query_id", "left")
    return out.select(
        "query_id", "query_type", "type_confidence", "domains", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("citations", F.lit("")).alias("citations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("risk_level", F.lit("none")).alias("risk_level"), "timeline",
    )


def ingest_corpus(texts: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """From raw texts (document_id, file_name, text) to tables in one job.

    Cleaned texts are written once and read by every later step.  Returns documents, chunks,
    entities, relations (resolved, of eligible documents) and results: a row a document with
    its status, the stage that failed and counts.
    """
    words = F.size(F.regexp_extract_all(F.col("clean"), F.lit(r"(\S+)"), F.lit(1)))
    kind, sure = classify.vertical(F.col("clean"), F.col("file_name"))
    cleaned = texts.withColumn("clean", clean_text(F.col("text"))).select("document_id", "file_name", F.col("clean").alias("text"), words.alias("n_words"), kind.alias("vertical"), F.round(sure, 9).alias("confidence"))
    cleaned = written(cleaned, "cleaned")
    good = cleaned.filter("n_words > 50")
    type_, _, category = classify.document_type(F.col("text"), F.col("vertical"), F.col("file_name"))
    documents = good.select("document_id", "vertical", "confidence", type_.alias("doc_type"), category.alias("category"), F.element_at(F.array(entities.policy_domains(F.col("text"))[1]), 1).alias("primary_domain"))
    own = lambda v: good.filter(F.col("vertical") == v)
    columns = ["document_id", "chunk_id", "chunk_index", "content"]
    parts = [job(own(v)).select(columns) for v, job in (
        ("go", chunking.chunk_go), ("legal", chunking.chunk_legal), ("judicial", chunking.chunk_judicial), ("data", chunking.chunk_data), ("scheme", chunking.chunk_scheme))]
    chunks = parts[0]
    for part in parts[1:]:
        chunks = chunks.unionByName(part)
    chunks = written(chunks, "chunks")
    found = good.select("document_id", *[entities.found_entities(F.col("text"), k).alias(k) for k in entities.ENTITIES], mentions.act_mentions(F.col("text")).alias("acts"))
    eligible = good.filter(extraction.qualifies(F.col("vertical"), F.col("text")))
    raw = written(extraction.extract_relations(eligible), "relations")
    checked = extraction.validate_relations(raw, eligible).withColumn("rel_id", F.concat_ws("/", "document_id", "seq.pattern", "seq.start")).withColumn("year", F.lit(None).cast("string"))
    resolved = resolution.resolve_relations(written(checked, "checked"), registry)
    relations = drop_self_refs(resolved.withColumns({"source_id": F.col("document_id"), "target_id": F.coalesce("canonical_id", F.concat(F.lit("No. "), F.col("go_number")), F.col("raw_text"))}))
    relations = written(relations.select("rel_id", "source_id", "target_id", "relation_type", F.round("confidence", 9).alias("confidence"), "scope", "status", "method"), "resolved")
    n_chunks = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    n_relations = relations.groupBy(F.col("source_id").alias("document_id")).agg(F.count("*").alias("n_relations"))
    results = cleaned.select("document_id", "n_words", "vertical").join(n_chunks, "document_id", "left").join(n_relations, "document_id", "left")
    failed = F.when(F.col("n_words") <= 50, "extraction").when(F.col("n_chunks").isNull(), "chunking")
    results = results.select(
        "document_id", "vertical", F.when(failed.isNull(), "success").otherwise("failed").alias("status"), failed.alias("failed_stage"), "n_words", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_relations", F.lit(0)).alias("n_relations")
    )
    return {"documents": documents, "chunks": chunks, "entities": found, "relations": relations, "results": results}


#: Columns that an ingested table can't do without.
REQUIRED = {"documents": ["document_id"], "chunks": ["document_id", "chunk_id"], "entities": ["document_id"], "relations": ["rel_id", "source_id"], "results": ["document_id", "status"]}


def ingest_to_tables(texts: DataFrame, registry: DataFrame, root: str, run_id: str) -> bool:
    """ingest_corpus with its tables appended under `root` in one commit; False if run_id is there.

    A run that dies leaves all tables as they were; rerun it under the same id.
    """
    if is_committed(texts.sparkSession, root, run_id):
        return False
    made = ingest_corpus(texts, registry)
    schemas = {k: T.StructType([T.StructField(f.name, f.dataType, f.name not in REQUIRED[k]) for f in v.schema]) for k, v in made.items()}
    create_tables(texts.sparkSession, root, f"{run_id}/create", schemas)
    return append_committed(texts.sparkSession, root, run_id, made)
