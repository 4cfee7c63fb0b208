"""Registered queries of relation extraction, resolution and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as x
from ..operators import lineage
from ..operators import relations as r
from ..operators import resolution as res
from ..operators import warehouse as w
from ..plans.registering import Register
from ..sources.staging import written

register = Register()

_O = r"(?:G\.?O\.?(?:MS|RT)?\.?\s*No\.?\s*)?([0-9]+)"
_C = r"(?:judgment|case|decision|precedent|ruling)\s+(?:in\s+)?(?:[A-Z][a-z]+\s+)?v\.?\s+(?:[A-Z][a-z]+)"
#: (type, pattern, confidence, scope, characters of context), in the order of discovery.
_RULES = (
    [("supersedes", p, 0.95, "full", 50) for p in (rf"supersedes?\s+{_O}", rf"in supersession of\s+{_O}", rf"{_O}\s+(?:is|are)\s+hereby\s+(?:rescinded|superseded)")]
    + [("cancels", p, 0.95, "full", 50) for p in (rf"cancels?\s+{_O}", rf"{_O}\s+(?:is|are)\s+hereby\s+cancelled", rf"in cancellation of\s+{_O}")]
    + [("amends", p, 0.9, "partial", 50) for p in (rf"amends?\s+{_O}", rf"in\s+(?:partial\s+)?amendment\s+(?:of|to)\s+{_O}", r"(?:Section|Rule)\s+([0-9]+)\s+(?:is|are)\s+(?:hereby\s+)?amended")]
    + [("clarifies", p, 0.9, "full", 50) for p in (rf"clarifies\s+{_O}", rf"in clarification of\s+{_O}")]
    + [("references", p, 0.85, "partial", 50) for p in (rf"(?:as per|under|in accordance with)\s+{_O}", rf"vide\s+{_O}", rf"in terms of\s+{_O}", rf"(?:read with|with reference to)\s+{_O}")]
    + [("overrules", p, 0.85, "full", 100) for p in (rf"overrules?\s+(?:the\s+)?{_C}", rf"overruled?\s+(?:by|in)\s+(?:the\s+)?{_C}", rf"{_C}\s+(?:is|has been|was)\s+overruled", rf"overruling\s+(?:the\s+)?{_C}")]
    + [("overruled_by", p, 0.85, "full", 100) for p in (rf"(?:this|the)\s+(?:judgment|case|decision|precedent|ruling)\s+(?:is|has been|was)\s+overruled\s+(?:by|in)\s+(?:the\s+)?{_C}", r"overruled\s+(?:by|in)\s+(?:[A-Z][a-z]+\s+)?v\.?\s+(?:[A-Z][a-z]+)")]
)


def _extracted() -> str:
    parts = []
    for i, (kind, pattern, confidence, scope, reach) in enumerate(_RULES):
        value = "NULL::VARCHAR[]" if reach == 100 else f"regexp_extract_all(text, '(?i){pattern}', 1)"
        only = "WHERE vertical = 'judicial'" if reach == 100 else ""
        parts.append(f"""SELECT document_id, text, '{kind}' AS relation_type, {i} AS pattern, regexp_extract_all(text, '(?i){pattern}') AS m, {value} AS v, regexp_split_to_array(text, '(?i){pattern}') AS g,
{confidence}::DOUBLE AS confidence, '{scope}' AS scope, {reach} AS reach FROM filings {only}""")
    return f"""
WITH p AS ({' UNION ALL '.join(parts)}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p WHERE len(m) > 0),
s AS (SELECT *, m[i] AS matched, v[i] AS go_number, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM u),
c AS (SELECT *, regexp_replace(substr(text, greatest(start - reach, 0) + 1, start + length(matched) + reach - greatest(start - reach, 0)), '^\\s+|\\s+$', '', 'g') AS context FROM s),
e AS (SELECT document_id, relation_type, pattern, start, CASE WHEN relation_type IN ('supersedes', 'cancels') THEN 'G.O.MS.No.' || go_number ELSE matched END AS raw_text, go_number, confidence,
CASE WHEN relation_type = 'supersedes' AND contains(lower(context), 'partially') THEN 'partial' ELSE scope END AS scope, context FROM c)
"""


def _relations(v):
    return x.extract_relations(v("filings")).select("document_id", "relation_type", "seq.pattern", "seq.start", "raw_text", "go_number", "confidence", "scope", "context")


register("rel_01_extract_relations", _relations, _extracted() + "SELECT document_id, relation_type, pattern, CAST(start AS INT) AS start, raw_text, go_number, confidence, scope, context FROM e")
register("rel_04_drop_named_self_refs", lambda v: r.drop_self_refs(v("named_relations")), r"""
SELECT * FROM named_relations WHERE target_id IS NULL OR (source_id <> target_id AND (regexp_extract(target_id, '[0-9]+') = '' OR NOT contains(source_id, regexp_extract(target_id, '[0-9]+'))))""")


def _validated(v):
    more = _relations(v).filter("pattern < 15").withColumn("go_number", F.when(F.col("start") % 5 == 0, F.concat("go_number", F.lit("9X"))).otherwise(F.col("go_number"))).withColumn("raw_text", F.lit(""))
    return x.validate_relations(more, v("filings")).select("document_id", "relation_type", "pattern", "start", "go_number", F.round("confidence", 9).alias("confidence"), "ocr_risk")


register("rel_05_validate_relations", _validated, _extracted() + r""",
d AS (SELECT * REPLACE (CASE WHEN start % 5 = 0 THEN go_number || '9X' ELSE go_number END AS go_number) FROM e WHERE pattern < 15),
t AS (SELECT document_id, regexp_extract_all(text, '\b[A-Za-z0-9.-]+\b') AS tokens FROM filings)
SELECT d.document_id, relation_type, pattern, CAST(start AS INT) AS start, go_number, round(CASE WHEN NOT regexp_full_match(go_number, '[0-9]+') OR regexp_matches(context, '\b[0-9][A-Z]\b') THEN confidence * 0.5 ELSE confidence END, 9) AS confidence,
NOT regexp_full_match(go_number, '[0-9]+') OR regexp_matches(context, '\b[0-9][A-Z]\b') AS ocr_risk FROM d JOIN t USING (document_id)
WHERE list_contains(tokens, go_number) AND NOT contains(lower(context), 'copy to') AND NOT contains(lower(context), 'forwarded')""")

_N = r"G\.?O\.?\s*(?:MS|RT|Rt)\.?\s*No\.?\s*([0-9]+)"
_GO_RULES = {
    "supersedes": (rf"supersede[sd]?\s+{_N}", rf"in\s+supersession\s+of\s+{_N}", rf"replaces?\s+{_N}"),
    "amends": (rf"amend[sment]*\s+{_N}", rf"in\s+(?:partial\s+)?modification\s+of\s+{_N}", rf"modif(?:y|ies|ied)\s+{_N}"),
    "clarifies": (rf"clarif(?:y|ies|ied|ication)\s+(?:of\s+)?{_N}", rf"for\s+clarification\s+of\s+{_N}"),
}
register("rel_08_go_relations", lambda v: x.go_relations(v("filings")), "WITH n AS (" + " UNION ".join(
    f"SELECT document_id, text, '{k}' AS relation_type, unnest(regexp_extract_all(text, '(?i){p}', 1)) AS n FROM filings" for k, ps in _GO_RULES.items() for p in ps) + rf"""),
a AS (SELECT * FROM n UNION SELECT document_id, text, 'references', unnest(regexp_extract_all(text, '(?i){_N}', 1)) FROM filings WHERE document_id NOT IN (SELECT document_id FROM n)),
b AS (SELECT *, 'G.O.MS.No.' || n AS target_go, CASE WHEN instr(text, 'G.O.MS.No.' || n) > 0 THEN substr(text, greatest(instr(text, 'G.O.MS.No.' || n) - 201, 0) + 1, instr(text, 'G.O.MS.No.' || n) + 199 - greatest(instr(text, 'G.O.MS.No.' || n) - 201, 0)) END AS near FROM a)
SELECT document_id, relation_type, target_go, CASE WHEN relation_type = 'clarifies' THEN 'full' WHEN relation_type = 'references' OR near IS NULL THEN 'unknown'
WHEN regexp_matches(near, '(?i)\bpartial\s+modification\b|\bpara(?:graph)?\s+[0-9]|\bsection\s+[0-9]|\bclause\s+[0-9]') THEN 'partial' ELSE 'full' END AS scope,
CASE WHEN relation_type IN ('supersedes', 'amends') THEN coalesce(nullif(regexp_extract(near, '(?i)\bpara(?:graph)?\s+[0-9]+[A-Z]?'), ''), nullif(regexp_extract(near, '(?i)\bsection\s+[0-9]+[A-Z]?'), ''), nullif(regexp_extract(near, '(?i)\bclause\s+[0-9]+[A-Z]?'), '')) END AS section,
CASE relation_type WHEN 'clarifies' THEN 0.9 WHEN 'references' THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence FROM b""")


def _actions(v):
    kind = F.element_at(F.array(*map(F.lit, ("repeals", "amends", "issues", "revokes", "clarifies"))), (F.col("k") % 5 + 1).cast("int"))
    one = F.struct(kind.alias("action"), F.concat(F.lit("G.O. No "), F.col("k")).alias("target"))
    return x.actions_to_relations(v("filings").select("document_id", F.array(one, F.struct(F.lit("references").alias("action"), F.lit("the Act").alias("target"))).alias("legal_actions")))


register("rel_09_actions_to_relations", _actions, """
WITH a AS (SELECT document_id, 0 AS seq, ['repeals', 'amends', 'issues', 'revokes', 'clarifies'][k % 5 + 1] AS action, 'G.O. No ' || k AS target FROM filings UNION ALL SELECT document_id, 1, 'references', 'the Act' FROM filings)
SELECT document_id, seq, CASE WHEN action IN ('repeals', 'revokes') THEN 'supersedes' ELSE action END AS relation_type, target AS raw_text, nullif(regexp_extract(target, '[0-9]+'), '') AS go_number, 0.99::DOUBLE AS confidence,
'Legal Action: ' || action || ' ' || target AS context, 'full' AS scope FROM a WHERE action <> 'issues'""")


def _rules(v):
    target = F.element_at(F.array(*map(F.lit, (" GO  Ms 7 ", "the act and rule", "12", "Policy", "G.O. 5"))), (F.col("k") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("supersedes", "amends", "cites", "governed_by", "other"))), (F.col("k") % 11 % 5 + 1).cast("int"))
    rows = v("filings").withColumns({"target": target, "kind": kind})
    return rows.select("document_id", x.qualifies(F.col("vertical"), F.col("text")).alias("qualifies"), x.valid_target(F.col("kind"), F.col("target")).alias("valid"),
                       x.normalized_target(F.col("target")).alias("normalized"), x.relation_priority(F.col("kind")).alias("priority"))


register("rel_12_relation_rules", _rules, """
WITH r AS (SELECT *, [' GO  Ms 7 ', 'the act and rule', '12', 'Policy', 'G.O. 5'][k % 5 + 1] AS target, ['supersedes', 'amends', 'cites', 'governed_by', 'other'][k % 11 % 5 + 1] AS kind FROM filings )
SELECT document_id, vertical IN ('go', 'legal', 'judicial') AND length(text) >= 500 AS qualifies,
length(trim(target)) >= 3 AND CASE kind WHEN 'supersedes' THEN contains(target, 'G.O') OR contains(target, 'GO') WHEN 'amends' THEN contains(target, 'G.O') OR contains(target, 'GO') OR contains(target, 'Section') OR contains(target, 'Rule')
WHEN 'cites' THEN true WHEN 'governed_by' THEN contains(target, 'Policy') OR length(trim(target)) > 10 ELSE false END AS valid,
['G.O. Ms 7', 'the Act and Rule', '12', 'Policy', 'G.O. 5'][k % 5 + 1] AS normalized, CASE kind WHEN 'supersedes' THEN 5 WHEN 'amends' THEN 4 WHEN 'cites' THEN 1 WHEN 'governed_by' THEN 2 ELSE 0 END AS priority FROM r""")


def _registry_json(v):
    rows = v("books").groupBy("ref_type", "number").agg(F.sort_array(F.collect_list(F.struct("year", "canonical_id", "source_document", "seq"))).alias("all"))
    inner = lambda kind: F.concat(F.lit('{"' + {"section": "acts", "rule": "rules"}[kind] + '":{'), F.array_join(F.transform("all", lambda b: F.concat(F.lit('"b'), b["seq"].cast("string"), F.lit('":{"full_name":"'), b["source_document"], F.lit('","' + kind + 's":{"'), F.col("number"), F.lit('":{"canonical_id":"'), b["canonical_id"], F.lit('"}}}'))), ","), F.lit("}}"))
    years = F.array_join(F.transform("all", lambda b: F.concat(F.lit('"'), b["year"], F.lit('":{"canonical_id":"'), b["canonical_id"], F.lit('","subject":"order"}'))), ",")
    one = F.concat(F.lit('"year":'), F.col("all")[0]["year"], F.lit(',"canonical_id":"'), F.col("all")[0]["canonical_id"], F.lit('","subject":"order"'))
    orders = F.concat(F.lit('{"go_index":{"'), F.col("number"), F.lit('":{'), F.when(F.size("all") == 1, one).otherwise(years), F.lit("}}}"))
    return rows.select(F.when(F.col("ref_type") == "section", inner("section")).when(F.col("ref_type") == "rule", inner("rule")).otherwise(orders).alias("registry"))


register("res_01_flatten_registry", lambda v: res.flatten_registry(_registry_json(v)), "SELECT ref_type, number, year, canonical_id, source_document FROM books")


def _parts(v, kind):
    refs = v("mentions").select(F.col("rel_id").alias("ref_id"), "raw_text", "context").filter(F.lower("raw_text").contains(kind))
    return res.resolve_parts(refs, v("books"), kind).withColumn("alternatives", F.array_join("alternatives", ","))


_PARTS = """
WITH m AS (SELECT rel_id AS ref_id, raw_text, lower(coalesce(context, '')) AS low, regexp_extract(raw_text, '{0} ([0-9]+)', 1) AS base FROM mentions WHERE contains(lower(raw_text), lower('{0}'))),
j AS (SELECT m.*, canonical_id, seq, CASE WHEN low <> '' AND contains(low, lower(source_document)) THEN 10 ELSE 0 END + CASE WHEN contains(low, 'rte') AND contains(lower(source_document), 'rte') THEN 5 ELSE 0 END
  + CASE WHEN contains(low, 'education act') AND contains(lower(source_document), 'education act') THEN 5 ELSE 0 END AS score FROM m LEFT JOIN books b ON b.ref_type = lower('{0}') AND b.number = base),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, seq) AS i, count(canonical_id) OVER (PARTITION BY ref_id) AS n FROM j)
"""
for _kind in ("Section", "Rule"):
    register(f"res_03_resolve_{_kind.lower()}", lambda v, k=_kind.lower(): _parts(v, k), _PARTS.format(_kind) + """
SELECT ref_id, max(raw_text) AS raw_text, max(canonical_id) FILTER (i = 1) AS canonical_id, CASE max(n) WHEN 0 THEN 'failed' WHEN 1 THEN 'exact' ELSE 'exact_with_disambiguation' END AS method,
CASE max(n) WHEN 0 THEN 0.0 WHEN 1 THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence, coalesce(string_agg(canonical_id, ',' ORDER BY seq) FILTER (i > 1), '') AS alternatives FROM k GROUP BY 1""")


def _misread(v):
    return v("mentions").filter("raw_text LIKE 'G.O.Ms%'").select(F.regexp_extract("raw_text", "No. ([0-9]+)", 1).alias("number")).distinct().join(
        v("books").filter("ref_type = 'go'").select("number"), "number", "left_anti")


register("res_04_resolve_fuzzy", lambda v: res.resolve_fuzzy(_misread(v), v("books"), "go"))
register("res_05_resolve_relations", lambda v: res.resolve_relations(written(v("mentions"), "mentions"), v("books")).select("rel_id", "canonical_id", "method", F.round("resolution_confidence", 9).alias("resolution_confidence"), F.round("confidence", 9).alias("confidence"), "status"))
register("grf_02_newer_same_topic", lambda v: lineage.newer_same_topic(v("topics")), r"""
WITH t AS (SELECT go_id, department, go_date, seq, unnest(list_distinct(list_filter(string_split(subject, ' '), lambda x: length(x) > 4))) AS w FROM topics),
p AS (SELECT a.go_id, b.go_id AS later, b.seq FROM t a JOIN t b ON a.w = b.w AND a.department IS NOT DISTINCT FROM b.department AND b.go_date > a.go_date GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT go_id, arg_min(later, seq) AS superseded_by FROM p GROUP BY 1""")
register("grf_04_detect_cycles", lambda v: lineage.detect_cycles(v("rings")).select("node"), """
WITH RECURSIVE reach AS (SELECT src, dst FROM rings UNION SELECT reach.src, e.dst FROM reach JOIN rings e ON e.src = reach.dst)
SELECT src AS node FROM reach WHERE src = dst""")

register("grf_04_cycle_groups", lambda v: lineage.detect_cycles(v("rings")), """
WITH RECURSIVE reach AS (SELECT src, dst FROM rings UNION SELECT reach.src, e.dst FROM reach JOIN rings e ON e.src = reach.dst)
SELECT a.src AS node, max(a.dst) AS cycle_group FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY 1""")


def _again(v):
    rows = w.relations_to_judgments(v("relations"), v("docs"))
    return w.relations_to_judgments(v("relations"), v("docs"), rows.filter("to_doc_id LIKE '%1'"))


register("mig_03_second_run", _again, """
WITH j AS (SELECT document_id FROM docs WHERE doc_type = 'judgment')
SELECT DISTINCT source_id AS from_doc_id, target_id AS to_doc_id, CASE WHEN relation_type IN ('supersedes', 'cancels', 'overrules') THEN 'overrules' WHEN relation_type = 'amends' THEN 'followed' ELSE 'distinguished' END AS relation_type
FROM relations WHERE source_id IN (SELECT document_id FROM j) AND target_id IN (SELECT document_id FROM j) AND relation_type <> 'references' AND target_id NOT LIKE '%1'""")
register("mig_04_second_run", lambda v: w.threads_to_domains(v("threads"), v("docs").filter("doc_type = 'go'")), """
SELECT go_id AS document_id, max(thread_id) FILTER (role = 'primary') AS primary_domain, coalesce(array_to_string(list_sort(list_distinct(list(thread_id) FILTER (role <> 'primary'))), ','), '') AS secondary_domains,
CAST(max(confidence) AS DOUBLE) AS confidence FROM threads WHERE go_id NOT IN (SELECT document_id FROM docs WHERE doc_type = 'go') GROUP BY 1 HAVING max(thread_id) FILTER (role = 'primary') IS NOT NULL""")
register("emb_01_validate_odd_vectors", lambda v: w.validate_vectors(v("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(None).cast("float")))).otherwise(F.col("embedding"))), "embedding", 64).select("vec_id", "reason"),
         "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'not_finite' END AS reason FROM embeddings")
