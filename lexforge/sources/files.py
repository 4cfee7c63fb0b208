"""Readers of documents, chunk files and golden queries, and what a path says about a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a path's folders and names say.
GO_NAME, COURT_NAME, YEAR_NAME = r"(?i)G\.?O\.?", r"(?i)(supreme|high|district|tribunal)", r"\b(19\d{2}|20\d{2})\b"
CHUNK = "chunk_id string, doc_id string, text string, content string, chunk_index long, word_count long, metadata map<string,string>"
GOLDEN = (
    "query_id string, query string, expected_answer string, expected_citations array<struct<doc_id:string,title:string,authority:string,date:string>>, expected_risk_level string, query_type string, "
    "domain string, temporal_context struct<date:int,operator:string>, notes string"
)


def document_id(path: Column) -> Column:
    """Lower-cased stem of a file name, blanks and hyphens as underscores."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), r"[ \-]", "_")


def corpus_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt",), most: int | None = None) -> DataFrame:
    """One row a file below a folder or prefix: doc_id, path, bytes and whole text.

    Only files of the extensions; empty files give no row; `most`, a parameter of the reader,
    keeps the first paths.
    """
    pattern = "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    # Spark gives paths as URLs.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = rows.select(document_id(path).alias("doc_id"), path.alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))
    return rows if most is None else rows.orderBy("path").limit(most)


def path_signals(path: Column, size: Column) -> dict[str, Column]:
    """Extension, kilobytes, folders and hints of authority, year and family; of the last four folders."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    folders = F.transform(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda f: f != ""), F.lower)
    folders = F.when(F.size(folders) > 4, F.slice(folders, -4, 4)).otherwise(folders)
    extension = F.when(name.contains("."), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise("")
    go, court = F.exists(folders, lambda f: f.rlike(GO_NAME)), F.exists(folders, lambda f: f.rlike(COURT_NAME))
    return {
        "file_extension": extension, "file_size_kb": F.round(size / 1024).cast("long"), "source_type": F.when(extension == ".pdf", "pdf").otherwise("document"),
        "folder_depth": F.size(folders), "top_folder": F.coalesce(F.try_element_at(folders, F.lit(1)), F.lit("")), "immediate_parent": F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit("")),
        "contains_go": go, "contains_court": court, "contains_budget": F.exists(folders, lambda f: f.contains("budget")),
        "authority_hint": F.when(court, "judicial").when(go, "executive").otherwise("informational"),
        "year_hint": F.nullif(F.regexp_extract(stem, YEAR_NAME, 1), F.lit("")).cast("int"),
        "doc_family": F.when(stem.rlike(GO_NAME), "go").when(stem.rlike(COURT_NAME), "judicial").when(stem.contains("budget"), "financial").otherwise("general"),
    }


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with text, doc_id and chunk_id, quarantined lines) of JSON lines; blank texts go."""
    rows = spark.read.schema(f"{CHUNK}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    text = F.coalesce("text", "content")
    whole = F.col("_broken").isNull() & text.isNotNull() & F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull()
    marked = rows.withColumns({"text": text, "_whole": F.coalesce(whole, F.lit(False))})
    good = marked.filter("_whole").filter(F.trim(F.regexp_replace("text", r"\s", "")) != "").drop("_broken", "_whole", "content")
    return good, marked.filter("NOT _whole").select(F.coalesce("_broken", F.to_json(F.struct("chunk_id", "doc_id", "text"))).alias("raw_payload"), F.lit("chunk").alias("error_type"))


def golden_set(spark: SparkSession, path: str, query_type: str | None = None, domain: str | None = None) -> DataFrame:
    """Golden queries of a JSON array, of one type or domain if asked."""
    rows = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    wanted = [F.col(c) == v for c, v in (("query_type", query_type), ("domain", domain)) if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, wanted)) if wanted else rows
