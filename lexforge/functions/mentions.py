"""Entities after extraction: acts, departments and dates cleaned, merged and checked against the contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spans import strip

_NAME = r"[A-Z][A-Za-z\s,]+?\bAct\b"
#: Where a name can start: behind the match before, or at the first letter of its run of letters, commas and white
#: space.  Where that fails no later letter of the run can do better, as a name takes in all that stands before Act.
_START = r"(?:\G[\s,]*+|(?<![A-Za-z][\s,]{0,3}))"
#: Patterns of act names, and what marks a false one.
ACTS = [rf"(?i){_START}(?:The\s+)?({_NAME},?\s+\d{{4}})", rf"(?i){_START}(?:The\s+)?({_NAME})(?:,|:|\.)(?:\s|$)", rf"(?i){_START}({_NAME}\s+No\.?\s+\d+\s+of\s+\d{{4}})", rf"(?i)under\s+(?:the\s+)?({_NAME})(?:\s+of\s+\d{{4}}|,|:|\.)"]
ACT_WORD = r"(?i)\bAct\b"
FALSE_ACTS = r"officers.*for.*act|state.*for.*act|for\s+\w+\s+act|providing\s+\w+.*act|necessary\s+act|attract\w*|exact\w*|nutritious.*act"
NO_ACTS = ["necessary", "nutritious", "attract", "exact", "impact", "contact", "practical", "actual", "officers", "state", "providing"]
SMALL_WORDS = ["the", "and", "of", "for", "in", "to", "a", "an"]
#: Marks of signature blocks and distribution lists.
NO_DEPARTMENT = r"(?i)SECRETARY TO GOVERNMENT|To\n|\n\n+|Copy to|Forwarded|/Sd/-|\(Sd\)|Date:|From:|Subject:"
#: The contract of extracted entities.
FORBIDDEN = ["go_effect", "legal_effect", "authority_level", "applicability_scope", "years", "effective_until"]
ARCHETYPES = ["normative", "administrative", "financial", "procedural"]
DATE_ROLES = ["issue_date", "effective_from", "retrospective_from", "reference_date"]
#: Long names of archetypes that model answers use.
LONG_ARCHETYPES = {"administrative_action": "administrative", "procedural_notice": "procedural", "financial_sanction": "financial"}
TOP = 10


def act_mentions(text: Column) -> Column:
    """Names of acts in a text, sorted, ten at most, without the false ones."""
    text = F.coalesce(text, F.lit(""))
    # Most texts don't have the word that every pattern ends on, and the patterns try each letter before it.
    found = F.when(F.regexp_like(text, F.lit(ACT_WORD)), F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ACTS])).otherwise(F.array().cast("array<string>"))
    tidy = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(strip(x), r"^,+|,+$", ""), r"^\.+|\.+$", ""))

    def real(act: Column) -> Column:
        low = F.lower(act)
        before = F.filter(F.split(strip(F.regexp_replace(act, r"(?i)\s+act\s*$", "")), r"\s+"), lambda w: w != "")
        solid = F.filter(before, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*SMALL_WORDS))
        return (
            (F.length(act) > 10) & low.rlike(r"\bact\s*$") & ~low.rlike(FALSE_ACTS) & (F.size(solid) >= 2)
            & F.exists(before, lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}")) & ~reduce(lambda a, b: a | b, (low.contains(w) for w in NO_ACTS))
        )

    return F.slice(F.array_sort(F.array_distinct(F.filter(tidy, real))), 1, TOP)


def normalized_acts(acts: Column) -> Column:
    """array<struct<act_name, act_year>> of act strings, each once, in order; nameless ones dropped."""
    def one(act: Column) -> Column:
        year = F.nullif(F.regexp_extract(act, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
        return F.struct(F.regexp_replace(strip(F.regexp_replace(act, r",?\s*(19|20)\d{2}", "")), r"^,+|,+$", "").alias("act_name"), year.alias("act_year"))

    return F.array_distinct(F.filter(F.transform(acts, one), lambda a: a["act_name"] != ""))


def sane_departments(departments: Column, allowed: list[str] | None = None) -> Column:
    """Departments without signature blocks, lists and fragments, single-spaced; only those that
    hold one of the `allowed` words where these are given."""
    trimmed = F.transform(departments, lambda d: strip(d))
    kept = F.filter(trimmed, lambda d: d.isNotNull() & ~d.rlike(NO_DEPARTMENT) & F.length(d).between(5, 200) & (F.length(d) - F.length(F.replace(d, F.lit("\n"), F.lit(""))) <= 2))
    clean = F.transform(kept, lambda d: F.regexp_replace(d, r"\s+", " "))
    return clean if allowed is None else F.filter(clean, lambda d: reduce(lambda a, b: a | b, (F.lower(d).contains(w.lower()) for w in allowed)))


def structured_date(text: Column) -> Column:
    """yyyy-MM-dd of a raw date, by year first or by day first; null for other forms."""
    parts = [F.regexp_extract(text, r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", i) for i in (1, 2, 3)]
    day_first = F.when(parts[2] != "", F.concat(parts[2], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[0], 2, "0")))
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), day_first)


def structured_dates(dates: Column) -> Column:
    """array<struct<value, role>> of raw dates in order, a value once, unrecognised ones dropped."""
    values = F.array_distinct(F.array_compact(F.transform(dates, structured_date)))
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit("reference_date").alias("role")))


def merge_entities(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, entity_type, pos, value) of two sources: the second adds what the first lacks, in order.

    Forbidden types and empty values go; of go_archetype the second source's first value counts.
    """
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    both = both.filter(~F.col("entity_type").isin(*FORBIDDEN) & (F.coalesce("value", F.lit("")) != ""))
    single = F.col("entity_type") == "go_archetype"
    rank = F.row_number().over(W.partitionBy("doc_id", "entity_type", F.when(single, "").otherwise(F.col("value"))).orderBy(F.when(single, -F.col("source")).otherwise(F.col("source")), "pos"))
    kept = both.withColumn("_n", rank).filter("_n = 1")
    place = F.row_number().over(W.partitionBy("doc_id", "entity_type").orderBy("source", "pos", "value")) - 1
    return kept.select("doc_id", "entity_type", place.alias("pos"), "value")


def contract_errors(columns: list[str]) -> Column:
    """array<string> of contract violations of a row with archetype, dates (value, role), departments and acts.

    columns: the row's column names, of which forbidden ones with a value are violations.
    """
    checks = [F.when(F.col(c).isNotNull(), F.lit(f"forbidden field {c}")) for c in FORBIDDEN if c in columns]
    checks += [
        F.when(F.col("go_archetype").isNotNull() & ~F.col("go_archetype").isin(*ARCHETYPES), "archetype"),
        F.when(F.exists("dates", lambda d: ~F.coalesce(d["value"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))), "date format"),
        F.when(F.exists("dates", lambda d: ~F.coalesce(d["role"].isin(*DATE_ROLES), F.lit(False))), "date role"),
        F.when(F.exists("departments", lambda d: d.rlike(r"(?i)SECRETARY TO GOVERNMENT") | d.rlike(r"To\n")), "department"),
        F.when(F.exists("acts", lambda a: F.coalesce(a["act_name"], F.lit("")) == ""), "act"),
    ]
    return F.array_compact(F.array(*checks))


def validate_contract(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, quarantine rows of doc_id and errors)."""
    rows = entities.withColumn("errors", contract_errors(entities.columns))
    return rows.filter(F.size("errors") == 0).drop("errors"), rows.filter(F.size("errors") > 0).select("doc_id", F.array_join("errors", "; ").alias("errors"))


def parse_model_output(answers: DataFrame) -> DataFrame:
    """Typed columns of stored model answers (doc_id, answer): JSON, with or without code fences.

    The archetype takes its short name; actions without a known verb, dates of unknown roles or
    forms and repeated roles go; lists keep their first ten.  Broken JSON gives parse_error.
    """
    bare = F.regexp_replace(strip(F.col("answer")), r"(?is)\A```(?:json)?\s*|\s*```\z", "")
    schema = "go_archetype string, legal_actions array<struct<action:string,target:string>>, dates array<struct<value:string,role:string>>, policy_domain string, specialized_terms array<string>, _broken string"
    parsed = answers.select("doc_id", F.from_json(bare, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("j"))
    table = F.create_map(*[F.lit(x) for pair in LONG_ARCHETYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(table, F.col("j.go_archetype")), F.col("j.go_archetype"))
    verbs = ("supersedes", "amends", "cancels", "clarifies", "references", "repeals", "revokes")
    list_of = lambda c, t: F.coalesce(c, F.array().cast(t))
    actions = F.slice(F.filter(list_of(F.col("j.legal_actions"), "array<struct<action:string,target:string>>"), lambda a: a["action"].isin(*verbs) & (F.coalesce(a["target"], F.lit("")) != "")), 1, TOP)
    dates = F.filter(list_of(F.col("j.dates"), "array<struct<value:string,role:string>>"), lambda d: d["value"].rlike(r"^\d{4}-\d{2}-\d{2}$") & d["role"].isin(*DATE_ROLES))
    once = F.filter(dates, lambda d, i: ~F.exists(F.slice(dates, 1, i), lambda e: e["role"] == d["role"]))
    return parsed.select(
        "doc_id", F.when(kind.isin(*ARCHETYPES), kind).alias("go_archetype"), actions.alias("legal_actions"), once.alias("dates"), F.col("j.policy_domain").alias("policy_domain"),
        F.slice(list_of(F.col("j.specialized_terms"), "array<string>"), 1, TOP).alias("specialized_terms"), (F.col("j").isNull() | F.col("j._broken").isNotNull()).alias("parse_error"),
    )


def thesaurus(terms: DataFrame) -> DataFrame:
    """acronym and its distinct definitions, sorted, of "ACRONYM: definition" terms; others are dropped."""
    parts = F.split("term", ":", 2)
    rows = terms.filter(F.col("term").contains(":")).select(F.upper(strip(parts[0])).alias("acronym"), strip(parts[1]).alias("definition"))
    return rows.groupBy("acronym").agg(F.array_sort(F.collect_set("definition")).alias("definitions"))


def chunks_with_entity(entities: DataFrame, kind: str, first: int | None = None) -> DataFrame:
    """Chunks of (chunk_id, entities: array of type and value) with a type, their matches and number; the first ones by id if asked."""
    own = F.filter("entities", lambda e: e["type"] == kind)
    rows = entities.filter(F.exists("entities", lambda e: e["type"] == kind)).select("chunk_id", F.transform(own, lambda e: e["value"]).alias("matches"), F.size(own).alias("n"))
    return rows if first is None else rows.orderBy("chunk_id").limit(first)


#: Most entities of a type in a chunk and whether case counts.
CHUNK_LIMITS = {"go_numbers": (3, True), "sections": (3, True), "departments": (2, False), "schemes": (2, False)}


def chunk_entities(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Document entities that occur in each chunk: (chunk_id, and an array a type).

    chunks: chunk_id, document_id, text; entities: document_id and an array a type.
    """
    joined = chunks.join(entities, "document_id", "left")
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    out = []
    for kind, (most, exact) in CHUNK_LIMITS.items():
        held = F.filter(F.coalesce(F.col(kind), F.array().cast("array<string>")), _in(text) if exact else _in_low(low))
        out.append(F.slice(held, 1, most).alias(kind))
    return joined.select("chunk_id", *out)


def _in(text: Column):
    return lambda e: text.contains(e)


def _in_low(low: Column):
    return lambda e: low.contains(F.lower(e))
