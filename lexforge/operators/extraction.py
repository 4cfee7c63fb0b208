"""Relations from text: extraction by patterns, validation and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import around, spans, strip

_GO = r"(?:G\.?O\.?(?:MS|RT)?\.?\s*No\.?\s*)?(\d+)"
_CASE = r"(?:judgment|case|decision|precedent|ruling)\s+(?:in\s+)?(?:[A-Z][a-z]+\s+)?v\.?\s+(?:[A-Z][a-z]+)"
#: Patterns of each relation type, base confidence, scope and whether only judgments are read.
RELATIONS = {
    "supersedes": ([rf"supersedes?\s+{_GO}", rf"in supersession of\s+{_GO}", rf"{_GO}\s+(?:is|are)\s+hereby\s+(?:rescinded|superseded)"], 0.95, "full", False),
    "cancels": ([rf"cancels?\s+{_GO}", rf"{_GO}\s+(?:is|are)\s+hereby\s+cancelled", rf"in cancellation of\s+{_GO}"], 0.95, "full", False),
    "amends": ([rf"amends?\s+{_GO}", rf"in\s+(?:partial\s+)?amendment\s+(?:of|to)\s+{_GO}", r"(?:Section|Rule)\s+(\d+)\s+(?:is|are)\s+(?:hereby\s+)?amended"], 0.9, "partial", False),
    "clarifies": ([rf"clarifies\s+{_GO}", rf"in clarification of\s+{_GO}"], 0.9, "full", False),
    "references": ([rf"(?:as per|under|in accordance with)\s+{_GO}", rf"vide\s+{_GO}", rf"in terms of\s+{_GO}", rf"(?:read with|with reference to)\s+{_GO}"], 0.85, "partial", False),
    "overrules": ([rf"overrules?\s+(?:the\s+)?{_CASE}", rf"overruled?\s+(?:by|in)\s+(?:the\s+)?{_CASE}", rf"{_CASE}\s+(?:is|has been|was)\s+overruled", rf"overruling\s+(?:the\s+)?{_CASE}"], 0.85, "full", True),
    "overruled_by": (
        [rf"(?:this|the)\s+(?:judgment|case|decision|precedent|ruling)\s+(?:is|has been|was)\s+overruled\s+(?:by|in)\s+(?:the\s+)?{_CASE}", r"overruled\s+(?:by|in)\s+(?:[A-Z][a-z]+\s+)?v\.?\s+(?:[A-Z][a-z]+)"],
        0.85, "full", True,
    ),
}
#: A word that every match of a type holds in lower case, to pass over other texts cheaply.
KEY_WORDS = {"supersedes": ["supersed", "supersession", "rescinded"], "cancels": ["cancel"], "amends": ["amend"], "clarifies": ["clarif"],
             "references": ["as per", "under", "accordance", "vide", "terms", "read with", "reference"], "overrules": ["overrul"], "overruled_by": ["overrul"]}
#: Relation of a legal action; other actions are dropped.
ACTIONS = {"amends": "amends", "supersedes": "supersedes", "repeals": "supersedes", "revokes": "supersedes", "cancels": "cancels", "clarifies": "clarifies", "references": "references"}
#: Documents that qualify, priority of a relation, words that a target must hold.
QUALIFIED, LEAST_TEXT = ("go", "legal", "judicial"), 500
PRIORITY = {"supersedes": 5, "amends": 4, "implements": 3, "governed_by": 2, "cites": 1}


def _described(hits: Column, kind: str, number: int, confidence: float, scope: str, judicial: bool) -> Column:
    """Spans of one pattern as relations."""
    return F.transform(hits, lambda h: F.struct(
        F.lit(kind).alias("relation_type"), F.lit(number).alias("pattern"), h["start"].alias("start"), h["matched"].alias("matched"),
        (F.lit(None).cast("string") if judicial else h["value"]).alias("go_number"), F.lit(confidence).alias("confidence"), F.lit(scope).alias("scope"),
        F.lit(100 if judicial else 50).alias("reach"),
    ))


def _typed(numbers: Column, kind: str) -> Column:
    return F.transform(F.array_distinct(numbers), lambda x: F.struct(F.lit(kind).alias("relation_type"), x.alias("n")))


def extract_relations(docs: DataFrame) -> DataFrame:
    """Relations that the patterns find in (document_id, vertical, text).

    Returns document_id, relation_type, seq (pattern number and start), raw_text, go_number
    (null for cases), confidence, scope and context: 50 characters on both sides, 100 for
    judgments' relations.  Null texts give none.
    """
    low = F.lower("text")
    found, searched, number = [], [], 0
    for kind, (patterns, confidence, scope, judicial) in RELATIONS.items():
        may = reduce(lambda a, b: a | b, (low.contains(w) for w in KEY_WORDS[kind]))
        if judicial:
            may = may & (F.col("vertical") == "judicial")
        searched.append(F.when(may, F.col("text")).alias(f"_{kind}"))
        for pattern in patterns:
            group = 0 if judicial else 1
            hits = spans(F.col(f"_{kind}"), f"(?i){pattern}", group)
            found.append(_described(hits, kind, number, confidence, scope, judicial))
            number += 1
    rows = docs.select("document_id", "text", *searched).select("document_id", "text", F.explode(F.concat(*found)).alias("r")).select("document_id", "text", "r.*")
    context = strip(F.when(F.col("reach") == 100, around(F.col("text"), F.col("start"), F.length("matched"), 100)).otherwise(around(F.col("text"), F.col("start"), F.length("matched"), 50)))
    named = F.col("relation_type").isin("supersedes", "cancels")
    return rows.withColumn("context", context).select(
        "document_id", "relation_type", F.struct("pattern", "start").alias("seq"),
        F.when(named, F.concat(F.lit("G.O.MS.No."), F.col("go_number"))).otherwise(F.col("matched")).alias("raw_text"), "go_number", "confidence",
        F.when((F.col("relation_type") == "supersedes") & F.lower("context").contains("partially"), "partial").otherwise(F.col("scope")).alias("scope"), "context",
    )


def validate_relations(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations whose number is a token of the document's text or whose raw text is in it, or of
    confidence over 0.98; those of copy lists dropped, doubtful readings at half confidence.

    Relations have document_id, go_number, raw_text, confidence and context; adds ocr_risk.
    """
    tokens = F.regexp_extract_all("text", F.lit(r"\b([A-Za-z0-9.-]+)\b"), F.lit(1))
    number, raw, low = F.col("go_number"), F.col("raw_text"), F.lower("context")
    # A text is cut into tokens last, since that is dear and few relations need it.
    token = F.coalesce(F.col("text").contains(number) & F.array_contains(tokens, number), F.lit(False))
    seen = F.coalesce((raw != "") & F.col("text").contains(raw), F.lit(False)) | (F.col("confidence") > 0.98) | token
    risk = F.coalesce(number.isNotNull() & (~number.rlike("^[0-9]+$") | F.col("context").rlike(r"\b[0-9][A-Z]\b")), F.lit(False))
    rows = relations.join(docs.select("document_id", "text"), "document_id")
    rows = rows.filter((number.isNull() | seen) & ~low.contains("copy to") & ~low.contains("forwarded"))
    return rows.withColumn("ocr_risk", risk).withColumn("confidence", F.when(F.col("ocr_risk"), F.col("confidence") * 0.5).otherwise(F.col("confidence"))).drop("text")


_ORDER = r"G\.?O\.?\s*(?:MS|RT|Rt)\.?\s*No\.?\s*(\d+)"
#: Patterns of relations between orders with their confidence.
GO_RELATIONS = {
    "supersedes": ([rf"supersede[sd]?\s+{_ORDER}", rf"in\s+supersession\s+of\s+{_ORDER}", rf"replaces?\s+{_ORDER}"], 0.95),
    "amends": ([rf"amend[sment]*\s+{_ORDER}", rf"in\s+(?:partial\s+)?modification\s+of\s+{_ORDER}", rf"modif(?:y|ies|ied)\s+{_ORDER}"], 0.95),
    "clarifies": ([rf"clarif(?:y|ies|ied|ication)\s+(?:of\s+)?{_ORDER}", rf"for\s+clarification\s+of\s+{_ORDER}"], 0.9),
    "references": ([_ORDER], 0.7),
}
#: Marks of a partial change; all but the first name the part.
PARTIAL = [r"(?i)\bpartial\s+modification\b", r"(?i)\bpara(?:graph)?\s+(\d+[A-Z]?)", r"(?i)\bsection\s+(\d+[A-Z]?)", r"(?i)\bclause\s+(\d+[A-Z]?)"]


def go_relations(docs: DataFrame) -> DataFrame:
    """Relations between orders in (document_id, text): type, target, scope, section, confidence.

    Plain references count only where a text has none of the other kinds.  Scope and section
    come from 200 characters round the first place of the target's full name.
    """
    text = F.col("text")
    numbers = {k: F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}"), F.lit(1)) for p in v[0]]) for k, v in GO_RELATIONS.items()}
    special = F.concat(*[_typed(n, k) for k, n in numbers.items() if k != "references"])
    plain = _typed(numbers["references"], "references")
    rows = docs.withColumn("_special", special).select("document_id", "text", F.explode(F.when(F.size("_special") > 0, F.col("_special")).otherwise(plain)).alias("r"))
    rows = rows.select("document_id", "text", "r.relation_type", F.concat(F.lit("G.O.MS.No."), F.col("r.n")).alias("target_go"))
    at = F.instr("text", F.col("target_go")) - 1
    near = F.when(at >= 0, around(text, at, F.lit(0), 200))
    rows = rows.withColumn("_near", near)
    partial = reduce(lambda a, b: a | b, (F.col("_near").rlike(p) for p in PARTIAL))
    part = F.coalesce(*[F.nullif(F.regexp_extract("_near", p, 0), F.lit("")) for p in PARTIAL[1:]])
    changes = F.col("relation_type").isin("supersedes", "amends")
    scope = F.when(F.col("relation_type") == "clarifies", "full").when(~changes | F.col("_near").isNull(), "unknown").when(partial, "partial").otherwise("full")
    confidence = reduce(lambda a, kv: a.when(F.col("relation_type") == kv[0], kv[1][1]), GO_RELATIONS.items(), F.when(F.lit(False), 0.0))
    return rows.select("document_id", "relation_type", "target_go", scope.alias("scope"), F.when(changes, part).alias("section"), confidence.alias("confidence"))


def actions_to_relations(actions: DataFrame) -> DataFrame:
    """Relations of (document_id, legal_actions: array of action and target); other actions dropped."""
    rows = actions.select("document_id", F.posexplode("legal_actions").alias("seq", "a")).filter("a.action <> '' AND a.target <> ''")
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    kind = F.try_element_at(table, F.col("a.action"))
    return rows.select(
        "document_id", "seq", kind.alias("relation_type"), F.col("a.target").alias("raw_text"), F.nullif(F.regexp_extract("a.target", r"(\d+)", 1), F.lit("")).alias("go_number"),
        F.lit(0.99).alias("confidence"), F.concat(F.lit("Legal Action: "), F.col("a.action"), F.lit(" "), F.col("a.target")).alias("context"), F.lit("full").alias("scope"),
    ).filter("relation_type IS NOT NULL")


def qualifies(vertical: Column, text: Column) -> Column:
    """Whether relations are sought in a document."""
    return F.coalesce(vertical.isin(*QUALIFIED) & (F.length(text) >= LEAST_TEXT), F.lit(False))


def valid_target(kind: Column, target: Column) -> Column:
    """Whether a target fits its relation type."""
    t = F.trim(target)
    has = lambda *words: reduce(lambda a, b: a | b, (t.contains(w) for w in words))
    rule = (
        F.when(kind == "supersedes", has("G.O", "GO") | t.rlike("^[0-9]+$")).when(kind == "amends", has("G.O", "GO", "Section", "Rule"))
        .when(kind == "cites", F.lit(True)).when(kind.isin("implements", "governed_by"), has("Act", "Rule", "Policy", "Scheme") | (F.length(t) > 10)).otherwise(F.lit(False))
    )
    return F.coalesce((F.length(t) >= 3) & rule, F.lit(False))


def normalized_target(target: Column) -> Column:
    """A target with single spaces, G.O. for GO and capitalised Act and Rule."""
    t = F.trim(F.regexp_replace(target, r"\s+", " "))
    t = F.when(F.upper(t).contains("GO") & ~t.contains("G.O"), F.replace(t, F.lit("GO"), F.lit("G.O."))).otherwise(t)
    for low, high in (("act", "Act"), ("rule", "Rule")):
        t = F.when(F.lower(t).contains(low), F.replace(F.replace(t, F.lit(low), F.lit(high)), F.lit(f" {high} {high}"), F.lit(f" {high}"))).otherwise(t)
    return t


def relation_priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))
