"""Warehouse tables from ingested documents: one frame of documents in, one table out.

A document row has doc_id, file_path, vertical, go_number, go_date, go_archetype and arrays of
entities (policy_domains, departments, authorities, acts, dates, ...).  Empty strings in arrays
and null arrays count as nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Document type of a vertical, chunk type of a clause's effect, relations of judgments.
DOC_TYPES = {"go": "go", "judicial": "judgment", "legal": "regulation", "scheme": "policy", "data": "report"}
CHUNK_TYPES = {"preamble": "paragraph"}
JUDGMENT_RELATIONS = {"supersedes": "overrules", "cancels": "overrules", "amends": "followed", "clarifies": "distinguished"}
#: Court codes, document types and chunk types of canonical ids.
COURT_CODES = {"SUPREME COURT": "SC", "HIGH COURT": "HC", "DISTRICT COURT": "DC", "TRIBUNAL": "TRIB"}
ID_TYPES = ["go", "judgment", "regulation", "policy", "report"]
NO_DATE = "1970-01-01"
_NONE = "array<string>"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def some(name: str) -> Column:
    """An array column without empty strings; empty for null."""
    return F.filter(F.coalesce(F.col(name), F.array().cast(_NONE)), lambda x: F.coalesce(x, F.lit("")) != "")


def _first(column: Column) -> Column:
    return F.try_element_at(column, F.lit(1))


def iso_date(text: Column, formats: tuple[str, ...] = ("d-M-yyyy", "yyyy-M-d", "d.M.yyyy", "d/M/yyyy")) -> Column:
    """yyyy-MM-dd by the first format that fits, of MM-yyyy the month's first day; else null."""
    parsed = F.coalesce(*[F.try_to_date(text, f) for f in formats])
    month = F.when(text.rlike(r"^\d{2}-\d{4}$"), F.concat(F.substring(text, 4, 4), F.lit("-"), F.substring(text, 1, 2), F.lit("-01")))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), month)


def _dates(name: str = "dates") -> Column:
    """array<struct<value, role>> of "value|role" texts."""
    return F.transform(some(name), lambda d: F.struct(F.element_at(F.split(d, r"\|"), 1).alias("value"), F.try_element_at(F.split(d, r"\|"), F.lit(2)).alias("role")))


def go_master(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an identity, quarantined rows without a number or a date)."""
    date = F.coalesce(iso_date(F.coalesce("go_date", _first(_dates())["value"])), F.lit(NO_DATE))
    rows = docs.select(
        F.col("doc_id").alias("go_id"), F.coalesce("go_number", F.lit("UNKNOWN")).alias("go_number"), date.alias("go_date"), F.coalesce(_first(some("departments")), F.lit("UNKNOWN")).alias("department"),
        F.coalesce("go_archetype", F.lit("unknown")).alias("go_type"), F.col("file_path").alias("raw_pdf_uri"),
    )
    lost = (F.col("go_number") == "UNKNOWN") | (F.col("go_date") == NO_DATE)
    return rows.filter(~lost), rows.filter(lost).select("go_id", F.lit("invalid identity").alias("error_type"))


def go_clauses(docs: DataFrame) -> DataFrame:
    """Clause rows of (go_id, preamble, orders, paragraphs, sections), arrays of para_no, text and legal_effect.

    Preamble and orders count; only where there is neither the first of the other arrays that
    holds any.  Clause ids are the order's id, the paragraph and its place.
    """
    kind = "array<struct<para_no:string,text:string,legal_effect:string>>"
    none = F.array().cast(kind)
    head = F.when(F.coalesce("preamble", F.lit("")) != "", F.array(F.struct(F.lit("PREAMBLE").alias("para_no"), F.col("preamble").alias("text"), F.lit("preamble").alias("legal_effect")))).otherwise(none)
    main = F.concat(head, F.coalesce(F.col("orders").cast(kind), none))
    other = lambda c: F.coalesce(F.col(c).cast(kind), none)
    chosen = F.when(F.size(main) > 0, main).when(F.size(other("paragraphs")) > 0, other("paragraphs")).otherwise(other("sections"))
    rows = docs.select("go_id", F.posexplode(chosen).alias("place", "c"))
    return rows.select(
        F.concat_ws("_", "go_id", F.coalesce("c.para_no", F.lit("")), "place").alias("clause_id"), "go_id", F.col("c.para_no").alias("section_path"), F.col("c.text").alias("clause_text"),
        F.coalesce("c.legal_effect", F.lit("introduce")).alias("clause_effect_type"),
    )


def functional_threads(docs: DataFrame) -> DataFrame:
    """One row a policy domain, the first primary, others secondary; general where there is none."""
    domains = F.when(F.size(some("policy_domains")) > 0, some("policy_domains")).otherwise(F.array(F.lit("general")))
    rows = docs.select(F.col("doc_id").alias("go_id"), F.posexplode(domains).alias("place", "thread_name"))
    slug = F.translate(F.lower("thread_name"), " /()", "__")
    return rows.select(slug.alias("thread_id"), "go_id", "thread_name", F.when(F.col("place") == 0, "primary").otherwise("secondary").alias("role"), F.lit(0.9).alias("confidence"), F.lit("llm").alias("source"))


def act_links(docs: DataFrame) -> DataFrame:
    """One row an act mention "name|year"; nameless ones dropped."""
    rows = docs.select(F.col("doc_id").alias("go_id"), F.explode(some("acts")).alias("act"))
    name, year = F.element_at(F.split("act", r"\|"), 1), F.nullif(F.try_element_at(F.split("act", r"\|"), F.lit(2)), F.lit(""))
    return rows.select("go_id", name.alias("act_name"), year.alias("act_year"), F.lit("references").alias("relation_type"), F.lit(0.8).alias("confidence")).filter("act_name <> ''")


def _unpivoted(docs: DataFrame, parts: dict[str, Column], kind: str, name: str) -> DataFrame:
    """(go_id, kind, name): a row an element of each named array."""
    one = reduce(lambda a, b: F.concat(a, b), [_tagged(values, label) for label, values in parts.items()])
    return docs.select(F.col("doc_id").alias("go_id"), F.explode(one).alias("x")).select("go_id", F.col("x.kind").alias(kind), F.col("x.name").alias(name))


def _tagged(values: Column, label: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(label).alias("kind"), v.alias("name")))


def beneficiaries(docs: DataFrame) -> DataFrame:
    """Types and organisations; the old list only where there is neither."""
    new = F.size(some("beneficiary_types")) + F.size(some("beneficiary_orgs")) > 0
    old = F.when(~new, some("beneficiaries")).otherwise(F.array().cast(_NONE))
    return _unpivoted(docs, {"beneficiary_types": some("beneficiary_types"), "specific_orgs": some("beneficiary_orgs"), "general": old}, "beneficiary_type", "beneficiary_name")


def applicability(docs: DataFrame) -> DataFrame:
    return _unpivoted(docs, {"district": some("districts"), "mandal": some("mandals"), "village": some("villages")}, "region_type", "region_name")


def authorities(docs: DataFrame) -> DataFrame:
    return _unpivoted(docs, {"department": some("departments"), "signatory": some("authorities")}, "authority_role", "authority_name")


def financials(docs: DataFrame) -> DataFrame:
    """One row an amount with the first budget head; amounts stay unparsed and so null."""
    rows = docs.select(F.col("doc_id").alias("go_id"), _first(some("budget_heads")).alias("budget_head"), F.posexplode(some("amounts")).alias("place", "raw"))
    return rows.select("go_id", "place", F.lit(None).cast("double").alias("amount"), "budget_head")


def effects(docs: DataFrame) -> DataFrame:
    """One row a structured date with its role."""
    rows = docs.select(F.col("doc_id").alias("go_id"), F.explode(_dates()).alias("d")).filter("d.role <> ''")
    return rows.select("go_id", F.lit("date").alias("effect_type"), F.col("d.value").alias("effect_value"), F.col("d.role").alias("effect_role"))


def documents(docs: DataFrame) -> DataFrame:
    """Unified document rows of the documents that have an identity."""
    master, _ = go_master(docs)
    own = docs.select(
        F.col("doc_id").alias("go_id"), F.coalesce(F.try_element_at(_map(DOC_TYPES), F.col("vertical")), F.lit("go")).alias("doc_type"), F.coalesce(_first(some("policy_domains")), F.lit("general")).alias("domain"),
        F.coalesce(_first(some("departments")), _first(some("authorities")), F.lit("State Government")).alias("authority"),
    )
    return master.join(own, "go_id").select(
        F.col("go_id").alias("document_id"), F.col("go_number").alias("title"), "doc_type", "domain", "authority", F.lit("AP").alias("jurisdiction"), F.col("go_date").alias("date"), F.lit("active").alias("status"), "raw_pdf_uri"
    )


def chunks_from_clauses(clauses: DataFrame) -> DataFrame:
    kind = F.coalesce(F.try_element_at(_map(CHUNK_TYPES), F.col("clause_effect_type")), F.lit("clause"))
    page = F.col("visual_anchor_page") if "visual_anchor_page" in clauses.columns else F.lit(None).cast("int")
    return clauses.filter("clause_id <> ''").select(
        F.col("clause_id").alias("chunk_id"), F.col("go_id").alias("document_id"), kind.alias("chunk_type"), F.coalesce("clause_text", F.lit("")).alias("text"), page.alias("page_start"), page.alias("page_end")
    )


def domain_mapping(threads: DataFrame) -> DataFrame:
    """Primary domain (that of the primary thread of the smallest name, else of any) and the others, sorted."""
    primary = F.col("role") == "primary"
    rows = threads.groupBy(F.col("go_id").alias("document_id")).agg(
        F.min(F.when(primary, F.struct("thread_name", "confidence", "source"))).alias("p"), F.min(F.struct("thread_name", "confidence", "source")).alias("any"),
        F.array_sort(F.collect_set(F.when(~primary, F.col("thread_name")))).alias("secondary_domains"),
    )
    p = F.coalesce("p", "any")
    return rows.select("document_id", p["thread_name"].alias("primary_domain"), "secondary_domains", p["confidence"].alias("confidence"), p["source"].alias("source"))


def judgments_metadata(judgments: DataFrame) -> DataFrame:
    """(document_id, identity fields, metadata fields prefixed meta_, sections) with fallbacks and whether a ratio is present."""
    ratio = F.exists(F.coalesce(F.col("sections"), F.array().cast("array<struct<section_type:string,title:string>>")), lambda s: (s["section_type"] == "ratio") | F.lower(F.coalesce(s["title"], F.lit(""))).contains("ratio"))
    return judgments.select(
        "document_id", F.coalesce("court", "meta_court", "meta_authority", F.lit("Unknown Court")).alias("court"), F.coalesce("bench_strength", "meta_bench_strength").alias("bench_strength"),
        F.coalesce("case_number", "meta_case_number").alias("case_number"), F.coalesce(ratio, F.lit(False)).alias("ratio_present"), F.coalesce("binding_strength", "meta_binding_strength", F.lit("informative")).alias("binding_strength"),
        "petition_result", "order_type",
    )


def judgment_relations(relations: DataFrame) -> DataFrame:
    kind = F.coalesce(F.try_element_at(_map(JUDGMENT_RELATIONS), F.col("relation_type")), F.col("relation_type"))
    return relations.select(F.col("source_id").alias("from_doc_id"), F.col("target_id").alias("to_doc_id"), kind.alias("relation_type"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))


def canonical_ids(docs: DataFrame) -> DataFrame:
    """Canonical ids of (doc_type, number, dated, authority, case_type, case_year, shortcode, content) or fallback ids for review.

    An id without its parts, of another type or with a case year outside 1900 to 2100 becomes
    type_unknown_date_hash and needs_review.
    """
    date = F.coalesce(iso_date(F.col("dated"), ("yyyy-M-d", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy", "yyyy-M", "M-yyyy")), F.when(F.col("dated").rlike(r"^\d{4}$"), F.concat("dated", F.lit("-01-01"))))
    plain = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    lined = lambda c: F.regexp_replace(F.upper(c), "[^A-Za-z0-9]", "_")
    edges = lambda c: F.regexp_replace(c, "^_+|_+$", "")
    filled = lambda c: F.nullif(c, F.lit(""))
    upper = F.upper("authority")
    court = F.coalesce(*[F.when(upper.contains(k), v) for k, v in COURT_CODES.items()], F.substring(plain(upper), 1, 5))
    number = filled(plain(F.col("number")))
    case_number = filled(F.substring(edges(F.regexp_replace(lined(F.col("number")), r"(?i)^(NO|NO\.|OF|OF\.|CASE|CASE\.)\s*", "")), 1, 30))
    code = filled(F.coalesce(F.substring(edges(lined(F.col("shortcode"))), 1, 30), F.substring(lined(F.col("number")), 1, 30)))
    year = F.when(F.col("case_year").between(1900, 2100), F.col("case_year").cast("string"))
    join = lambda *parts: reduce(lambda a, b: F.concat(a, F.lit("_"), b), parts)  # noqa: E731  (null if any part is)
    made = (
        F.when(F.col("doc_type") == "go", join(F.lit("go_AP"), F.when(number != "UNKNOWN", number), date))
        .when(F.col("doc_type") == "judgment", join(F.lit("judgment"), court, filled(F.substring(plain(F.upper("case_type")), 1, 10)), case_number, year, date))
        .when(F.col("doc_type") == "regulation", join(F.lit("regulation"), F.substring(plain(upper), 1, 20), code, date))
    )
    other = join(F.col("doc_type"), F.lit("unknown"), F.coalesce(date, F.lit("unknown")), F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 8))
    return docs.withColumns({"document_id": F.coalesce(made, other), "needs_review": made.isNull()})


def document_of_chunk(chunk_id: Column) -> Column:
    """The document id in a canonical chunk id, document_type_nnn; null for other ids."""
    fits = chunk_id.rlike(rf"^(?:{'|'.join(ID_TYPES)})_.+_\d{{4}}-\d{{2}}-\d{{2}}_[a-z]+_\d{{3}}$")
    return F.when(fits, F.regexp_extract(chunk_id, r"^(.*)_[a-z]+_\d{3}$", 1))


def chunk_metadata(chunks: DataFrame, docs: DataFrame, relations: DataFrame, status: DataFrame) -> DataFrame:
    """A denormalised row a chunk: position, counts, vertical, relation types and targets, status, domains.

    Relations are summed up by document before the join: distinct types, and the first five
    distinct targets.  Documents without any of these get the defaults.
    """
    related = relations.groupBy(F.col("source_id").alias("document_id")).agg(F.array_sort(F.collect_set("relation_type")).alias("relation_types"), F.count("*").alias("relation_count"))
    nearest = relations.select(F.col("source_id").alias("document_id"), "target_id").distinct()
    nearest = nearest.withColumn("_n", F.row_number().over(W.partitionBy("document_id").orderBy("target_id"))).filter("_n <= 5")
    nearest = nearest.groupBy("document_id").agg(F.array_sort(F.collect_list("target_id")).alias("related_docs"))
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1)))
    rows = chunks.join(docs, "document_id", "left").join(related, "document_id", "left").join(nearest, "document_id", "left").join(status, "document_id", "left")
    none = F.array().cast(_NONE)
    return rows.select(
        "chunk_id", "document_id", "vertical", words.alias("word_count"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"),
        F.when(F.col("relation_count") > 0, "true").otherwise("false").alias("has_relations"), F.coalesce("relation_types", none).alias("relation_types"), F.coalesce("related_docs", none).alias("related_docs"),
        F.when(F.col("is_superseded"), "true").otherwise("false").alias("is_superseded"), F.when(F.coalesce("is_most_recent", F.lit(True)), "true").otherwise("false").alias("is_most_recent"),
        F.coalesce("domain", F.lit("general")).alias("primary_domain"),
    )


def document_metadata(docs: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a document: number of chunks, entities a type and relations, relation types, primary domain."""
    related = relations.groupBy(F.col("source_id").alias("doc_id")).agg(F.count("*").alias("relations_count"), F.array_sort(F.collect_set("relation_type")).alias("relation_types"))
    counted = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks_count"))
    rows = docs.join(related, "doc_id", "left").join(counted, "doc_id", "left")
    counts = [F.size(some(c)).cast("long").alias(f"n_{c}") for c in ("departments", "authorities", "acts", "districts", "dates")]
    return rows.select(
        "doc_id", "file_path", "vertical", F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"), *counts, F.coalesce("relations_count", F.lit(0)).alias("relations_count"),
        F.coalesce("relation_types", F.array().cast(_NONE)).alias("relation_types"), F.coalesce(_first(some("policy_domains")), F.lit("general")).alias("primary_domain"),
    )


def merge_sidecars(chunks: DataFrame, by_chunk: DataFrame, by_document: DataFrame, general: DataFrame) -> DataFrame:
    """Chunks with their entities: those of the chunk, else those of the document; counts, types and metadata.

    by_chunk: (chunk_id, entities); by_document: (document_id, entities), arrays of type and
    value; general: (document_id, extra map).  Keys that a chunk's metadata has already win.
    """
    rows = chunks.join(by_chunk.withColumnRenamed("entities", "_own"), "chunk_id", "left").join(by_document.withColumnRenamed("entities", "_doc"), "document_id", "left").join(general, "document_id", "left")
    held = F.coalesce("_own", "_doc", F.array().cast("array<struct<type:string,value:string>>"))
    none = F.create_map().cast("map<string,string>")
    meta, extra = F.coalesce(F.col("metadata"), none), F.coalesce(F.col("extra"), none)
    fresh = F.map_filter(extra, lambda k, _: ~F.map_contains_key(meta, k))
    return rows.select(
        "chunk_id", "document_id", F.size(held).alias("entity_count"), F.array_sort(F.array_distinct(F.transform(held, lambda e: F.coalesce(e["type"], F.lit("unknown"))))).alias("entity_types"), F.map_concat(fresh, meta).alias("metadata")
    )


def enrich_results(hits: DataFrame, metadata: DataFrame, tables: DataFrame) -> DataFrame:
    """Search hits with their metadata by document and chunk, and table text where the chunk is a table."""
    return hits.join(metadata, ["document_id", "chunk_id"], "left").join(tables.withColumnRenamed("table_text", "_table"), ["document_id", "chunk_id"], "left").withColumn(
        "table_text", F.when(F.col("is_table") == "true", F.col("_table"))).drop("_table")
