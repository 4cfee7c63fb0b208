"""Retrieval for whole sets of queries: lexical and vector search, their composition and routing.

Queries have query_id, text and domains (array); chunks have chunk_id, document_id and text;
docs have document_id, status, doc_date, jurisdiction, primary_domain and doc_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import written
from .postings import LexicalIndex, chunk_words, dealt, first_chunks, small, word_grams
from .retrieval import authority_boost, exclude_overruled, rrf, source_priority

#: Domain of a vertical, verticals of a domain, document type of a vertical.
VERTICAL_DOMAINS = {"go": "education", "judicial": "judicial", "legal": "constitution", "scheme": "state_governance", "data": "finance"}
DOMAIN_VERTICALS = {
    "education": ["go", "legal", "scheme"], "healthcare": ["go", "legal"], "labor": ["go", "legal"], "agriculture": ["go", "scheme"],
    "constitution": ["legal", "judicial"], "judicial": ["judicial"],
}
OTHER_VERTICALS = ["go", "legal"]
#: Name, risk, timeline, comparison, most domains, top k and most milliseconds of each pipeline.
PIPELINES = {
    "P1": ("Factual/Clarification", False, False, False, 1, 15, 2000),
    "P2": ("Comparative/Evolution", False, True, True, 1, 30, 3000),
    "P3": ("Risk/Constitutionality", True, False, False, 2, 25, 3500),
    "P4": ("Multi-Domain Impact", True, True, True, 3, 40, 4000),
    "P5": ("Judicial Constraint", True, False, False, 2, 30, 4000),
}
PIPELINE_FIELDS = "pipeline string, pipeline_name string, requires_risk boolean, requires_timeline boolean, requires_comparison boolean, max_domains int, top_k int, max_latency_ms int"
TERMS, TERM_LENGTH = 5, 3


def query_terms(text: Column, first: bool = False) -> Column:
    """Lower-cased words longer than three characters, five at most; of the first five words if asked."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\S+)"), F.lit(1))
    long = lambda x: F.length(x) > TERM_LENGTH
    found = F.filter(F.slice(words, 1, TERMS), long) if first else F.slice(F.filter(words, long), 1, TERMS)
    return F.array_distinct(found)


#: Queries of one term that meet its list in one part, and rows of lists a task makes on average.
PART, TASK = 1000, 500_000


def _dealt(asked: DataFrame, lists: DataFrame, on: list[str], places: int) -> DataFrame:
    """Each query's rows of its terms' lists, dealt by query.  A term that many queries ask is dealt
    into parts of a thousand of them, to each of which its list, which is short, goes."""
    size = asked.count() * places // TASK
    parts = written(asked.groupBy(*on).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")), "parts")
    salted = asked.join(parts, on).withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")).drop("_parts")
    spread = lists.join(parts, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    key = [*on, "_salt"]
    return dealt(dealt(salted, size, *key).join(dealt(spread, size, *key).hint("merge"), key), size, "query_id")


def _postings(chunks: DataFrame, index: LexicalIndex | None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks and their postings, those of the known documents with their columns, and the words' grams.

    Without an index the words of each chunk are stored as one row, and words are told apart as
    they are read: nothing is dealt or sorted by word that is for one set of queries.
    """
    told = lambda rows: rows if known is None else rows.join(known, "document_id")
    if index is not None:
        ids = [F.col(c).cast("string").alias(c) for c in ("chunk_id", "document_id")]
        return told(chunks.select(*ids)), told(index.postings.drop("salt")), index.grams
    held = written(told(chunk_words(chunks)), "words")
    postings = held.withColumn("word", F.explode("words")).drop("words")
    return held.drop("words"), postings, written(word_grams(postings.select("word").distinct()), "grams")


def lexical_search(queries: DataFrame, chunks: DataFrame, docs: DataFrame, top: int, index: LexicalIndex | None = None) -> DataFrame:
    """Each query's first 2 * top chunks that contain any of its terms, the latest documents first.

    Only active documents of the query's domains, and where the query has since_date or
    jurisdiction (null: any) of that date or later and that place.  Scores are 1 / rank.
    Queries without terms or with null domains find nothing; ties go to the smaller chunk_id.

    `index` is that of the chunks; without one their words are read.  A term's chunks are cut
    to the first 2 * top of each domain and jurisdiction before they meet the queries: whatever
    is among a query's first is among the first of each of these lists that it stands in.
    """
    optional = [c for c in ("since_date", "jurisdiction") if c in queries.columns]
    # Ages rise as dates fall, nulls last; a group is a domain and a jurisdiction, which may be null.
    never = 2**31 - 1
    age = F.coalesce(-F.unix_date("doc_date"), F.lit(never)).alias("age")
    group = F.concat(F.col("primary_domain"), F.coalesce(F.concat(F.lit("\n"), "jurisdiction"), F.lit(""))).alias("grp")
    living = docs.filter("status = 'active' AND primary_domain IS NOT NULL")
    groups = F.broadcast(written(living.select("primary_domain", F.col("jurisdiction").alias("_place"), group).distinct(), "groups"))
    asked = queries.select("query_id", F.array_distinct("domains").alias("domains"), *[F.col(c).alias(f"q_{c}") for c in optional], F.explode(query_terms(F.col("text"))).alias("term"))
    asked = asked.withColumn("primary_domain", F.explode("domains")).join(groups, "primary_domain").drop("domains", "primary_domain")
    if "jurisdiction" in optional:
        asked = asked.filter("q_jurisdiction IS NULL OR _place = q_jurisdiction").drop("q_jurisdiction")
    asked = written(asked.drop("_place"), "asked")
    known = small(living.select(F.col("document_id").cast("string").alias("document_id"), age, group), "known")
    held, postings, grams = _postings(chunks, index, known)
    # A chunk_id of m dates takes m places of a list, so lists are m times as long.
    places = 2 * top * (held.groupBy("chunk_id").agg(F.count_distinct("age").alias("n")).agg(F.max("n")).first()[0] or 1)
    lists = first_chunks(postings, held, grams, asked.select("term", "grp").distinct(), ["age", "chunk_id"], places)
    hits = _dealt(asked, lists, ["term", "grp"], places).withColumn("doc_date", F.when(F.col("age") < never, F.date_from_unix_date(-F.col("age"))))
    if "since_date" in optional:
        hits = hits.filter("q_since_date IS NULL OR doc_date >= q_since_date")
    hits = hits.groupBy("query_id", "chunk_id").agg(F.max(F.struct("doc_date", "document_id")).alias("_d")).select("query_id", "chunk_id", "_d.doc_date", "_d.document_id")
    order = W.partitionBy("query_id").orderBy(F.col("doc_date").desc_nulls_last(), "chunk_id")
    return hits.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= 2 * top).select(
        "query_id", "chunk_id", "document_id", F.lit("lexical").alias("source"), (1.0 / F.col("rnk")).alias("score"), "rnk"
    )


def clause_search(queries: DataFrame, clauses: DataFrame, top: int, index: LexicalIndex | None = None) -> DataFrame:
    """Each query's first `top` clauses, by id, that contain a long word among its first five.

    `index` is that of the clauses; without one their words are read.  A term's clauses are
    cut to its first `top` before they meet the queries.
    """
    asked = written(queries.select("query_id", F.lit("").alias("grp"), F.explode(query_terms(F.col("text"), first=True)).alias("term")), "asked")
    held, postings, grams = _postings(clauses, index)
    held, postings = held.withColumn("grp", F.lit("")), postings.withColumn("grp", F.lit(""))
    lists = first_chunks(postings, held, grams, asked.select("term", "grp").distinct(), ["chunk_id", "document_id"], top)
    hits = _dealt(asked, lists, ["term", "grp"], top).select("query_id", "chunk_id", "document_id").distinct()
    order = W.partitionBy("query_id").orderBy("chunk_id", "document_id")
    return hits.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= top).withColumn("score", 1.0 / F.col("rnk"))


def vertical_domains(verticals: Column) -> Column:
    """Domains of an array of verticals in order, each once; education if there are none."""
    table = F.create_map(*[F.lit(x) for pair in VERTICAL_DOMAINS.items() for x in pair])
    found = F.array_distinct(F.filter(F.transform(verticals, lambda v: F.try_element_at(table, v)), lambda d: d.isNotNull()))
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, found).otherwise(F.array(F.lit("education")))


def vector_search(queries: DataFrame, vectors: DataFrame, candidates: DataFrame, top: int) -> DataFrame:
    """Each query's `top` nearest chunks by cosine among its candidate documents.

    queries: (query_id, vector); vectors: (chunk_id, document_id, vector); candidates:
    (query_id, document_id).  Zero and null vectors and other lengths take no part.  Candidates
    come first, so only vectors of candidate documents are compared.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = queries.select("query_id", F.col("vector").alias("_q"), norm(F.col("vector")).alias("_qn")).filter("_qn > 0")
    own = vectors.select("chunk_id", "document_id", F.col("vector").alias("_v"), norm(F.col("vector")).alias("_vn")).filter("_vn > 0")
    pairs = candidates.select("query_id", "document_id").distinct().join(own, "document_id").join(asked, "query_id").filter(F.size("_q") == F.size("_v"))
    dot = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.select("query_id", "chunk_id", "document_id", F.round(dot / F.col("_qn") / F.col("_vn"), 9).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= top).withColumn("source", F.lit("vector"))


def hybrid_retrieve(
    queries: DataFrame, chunks: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, relations: DataFrame, top: int, priorities: list[str] | None = None
) -> DataFrame:
    """Lexical search, overruled documents out, vector search among what is left, rank fusion,
    authority weights and, where priorities are given, document types first; the best `top`.

    A query without lexical candidates gets no rows.
    """
    lexical = exclude_overruled(lexical_search(queries, chunks, docs, top), relations)
    near = vector_search(query_vectors, vectors, lexical, 2 * top)
    columns = ["query_id", "chunk_id", "document_id", "source", "score", "rnk"]
    both = lexical.select(columns).unionByName(near.select(columns))
    owners = both.groupBy("query_id", "chunk_id").agg(F.first("document_id").alias("document_id"))
    fused = rrf(both, 2 * top).join(owners, ["query_id", "chunk_id"]).withColumns({"source": F.lit("hybrid"), "score": F.col("fused")})
    if not priorities:
        boosted = authority_boost(fused, docs, top)
        return boosted.select("query_id", "chunk_id", "boosted", "rank")
    boosted = authority_boost(fused, docs, 2 * top).join(owners, ["query_id", "chunk_id"]).withColumn("score", F.col("boosted"))
    return source_priority(boosted, docs, priorities, top).select("query_id", "chunk_id", "doc_type", "rank")


def pipeline_settings(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PIPELINES.items()], PIPELINE_FIELDS)


def route_pipelines(queries: DataFrame) -> DataFrame:
    """Adds to (query_id, pipeline, domains) the pipeline's settings and the verticals to search,
    those of every domain, sorted.  An unknown pipeline gets null settings."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in DOMAIN_VERTICALS.items() for x in pair])
    other = F.array(*map(F.lit, OTHER_VERTICALS))
    verticals = F.array_sort(F.array_distinct(F.flatten(F.transform("domains", lambda d: F.coalesce(F.try_element_at(table, d), other)))))
    # Five rows: broadcast.
    settings = F.broadcast(pipeline_settings(queries.sparkSession))
    return queries.withColumn("verticals", verticals).join(settings, "pipeline", "left")
