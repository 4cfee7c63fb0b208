"""Registered queries of the policy-document operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import cleaning
from .functions import entities as e
from .functions import segments as g
from .operators import answers as a
from .operators import lineage
from .operators import relations as r
from .operators import retrieval as t
from .operators import warehouse as w
from .plans.fixtures import view, with_sql
from .registered import relations as linked
from .registered import details, jobs, routed, search, structure, tables
from .registered import text as texts
from .sources.staging import new_folder
from .streaming.ingest import ingest, not_yet_ingested

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, job, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: job(lambda table: view(spark, sf_dir, table))
    if sql:
        ORACLE_SQL[name] = with_sql(sql)


def _sql_chain(rules) -> str:
    out = "text"
    for pattern, to in rules:
        flags = "g"
        if pattern.startswith("(?i)"):
            pattern, flags = pattern[4:], "gi"
        to = to.replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3")
        to = to.replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern.replace(chr(10), chr(92) + 'n')}', '{to}', '{flags}')"
    return out


for _name, _rules in cleaning.STEPS.items():
    _register(
        _name,
        lambda v, n=_name: v("dirty").select("doc_id", F.md5(cleaning.step(n, F.col("text"))).alias("cleaned_md5"), F.length(cleaning.step(n, F.col("text"))).cast("long").alias("n_chars")),
        f"SELECT doc_id, md5({_sql_chain(_rules)}) AS cleaned_md5, length({_sql_chain(_rules)}) AS n_chars FROM dirty",
    )

_WORDS = r"len(regexp_extract_all({}, '[^ \t\n\r\f\x0B]+'))"
_CLEAN = _sql_chain([x for k in ("HYPHENS", "PAGE_MARKERS", "ARTIFACTS", "SPACES", "OCR_WORDS") for x in getattr(cleaning, k)])
_register(
    "cln_10_cleaning_stats",
    lambda v: v("dirty").withColumn("cleaned", cleaning.clean(F.col("text"))).select(
        "doc_id", cleaning.words(F.col("text")).alias("words_before"), cleaning.words(F.col("cleaned")).alias("words_after"),
        F.length("text").cast("long").alias("chars_before"), F.length("cleaned").cast("long").alias("chars_after"),
        F.round((1 - F.length("cleaned") / F.length("text")) * 100, 6).alias("reduction"),
    ),
    f"SELECT doc_id, {_WORDS.format('text')} AS words_before, {_WORDS.format('c')} AS words_after, length(text) AS chars_before, length(c) AS chars_after, "
    f"round((1 - length(c) / length(text)) * 100, 6) AS reduction FROM (SELECT doc_id, text, {_CLEAN} AS c FROM dirty) x",
)
_register(
    "qlt_01_extraction_gate",
    lambda v: v("documents").withColumn("n_words", cleaning.words(F.col("text"))).select(
        "doc_id", "n_words", (F.col("n_words") > 50).alias("ok"), (F.col("n_words") < 10 * F.greatest(F.lit(1), F.ceil(F.length("text") / 2000))).alias("needs_ocr"),
        F.substring("text", 1, 2000).rlike(r"\(cid:[0-9]+\)").alias("garbled"),
    ),
    f"SELECT doc_id, n_words, n_words > 50 AS ok, n_words < 10 * greatest(1, ceil(length(text) / 2000)) AS needs_ocr, "
    f"regexp_matches(substr(text, 1, 2000), '\\(cid:[0-9]+\\)') AS garbled FROM (SELECT *, {_WORDS.format('text')} AS n_words FROM documents) x",
)

_PREC = "CASE relation_type WHEN 'overrules' THEN 6 WHEN 'supersedes' THEN 5 WHEN 'cancels' THEN 4 WHEN 'amends' THEN 3 WHEN 'clarifies' THEN 2 WHEN 'references' THEN 1 ELSE 0 END"
_COLS = "source_id, target_id, relation_type, confidence, scope, section"
_AUTH = "CASE doc_type WHEN 'go' THEN 0.7 WHEN 'rules' THEN 0.8 WHEN 'act' THEN 0.85 ELSE 0.5 END"
_cols = [c.strip() for c in _COLS.split(",")]

_register("rel_03_allowed_types", lambda v: r.allowed_types(v("relations")).groupBy("relation_type").agg(F.count("*").alias("n")),
          "SELECT relation_type, count(*) AS n FROM relations WHERE relation_type IN ('overrules','supersedes','cancels','amends','clarifies','references','overruled_by') GROUP BY 1")
_register("rel_04_drop_self_refs", lambda v: r.drop_self_refs(v("relations")).select(*_cols),
          f"SELECT {_COLS} FROM relations WHERE source_id <> target_id AND NOT contains(source_id, regexp_extract(target_id, '[0-9]+'))")
_register("rel_06_precedence", lambda v: r.precedence(v("relations")).select(*_cols),
          f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY {_PREC} DESC, confidence DESC, seq, scope, section) AS n FROM relations ) x WHERE n = 1")
_register("rel_07_dedupe_relations", lambda v: r.dedupe(v("relations")).select(*_cols),
          f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation_type ORDER BY seq, confidence DESC, scope, section) AS n FROM relations ) x WHERE n = 1")
_register("rel_11_relation_summary", lambda v: r.summary(v("relations")),
          "SELECT source_id, " + ", ".join(f"count(*) FILTER (relation_type = '{x}') AS n_{x}" for x in ("supersedes", "amends", "cancels", "references"))
          + ", bool_or(relation_type = 'supersedes') AS has_supersession, bool_or(relation_type = 'amends') AS has_amendment, count(*) FILTER (scope = 'partial') AS n_partial FROM relations GROUP BY 1")


def _resolve(v):
    known = v("go_master")
    registry = known.filter("k % 11 <> 0").groupBy(F.col("go_number").alias("number"), F.year("go_date").alias("year")).agg(F.max_by("go_id", F.struct("go_date", "go_id")).alias("canonical_id"))
    refs = v("relations").select("target_id", "seq").distinct().join(known.select(F.col("go_id").alias("target_id"), "go_number", "go_date"), "target_id")
    refs = refs.select(F.concat_ws("/", "target_id", "seq").alias("ref_id"), F.concat(F.lit("No. "), "go_number").alias("number"), F.when(F.col("seq") % 3 == 0, F.year("go_date")).alias("year"))
    return r.resolve_go(refs, registry)


_register("res_02_resolve_go", _resolve, """
WITH registry AS (SELECT go_number AS number, year(go_date) AS year, arg_max(go_id, (go_date, go_id)) AS canonical_id FROM go_master WHERE k % 11 <> 0 GROUP BY 1, 2),
refs AS (SELECT DISTINCT target_id || '/' || seq AS ref_id, 'No. ' || go_number AS number, CASE WHEN seq % 3 = 0 THEN year(go_date) END AS year, go_number AS d FROM relations JOIN go_master ON target_id = go_id),
nums AS (SELECT number AS n, count(*) AS years, arg_max(canonical_id, year) AS latest FROM registry GROUP BY 1),
j AS (SELECT refs.*, years, latest, e.canonical_id AS exact FROM refs LEFT JOIN nums ON d = n LEFT JOIN registry e ON e.number = d AND e.year = refs.year)
SELECT ref_id, number, year, coalesce(exact, latest) AS canonical_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN years = 1 THEN 'inferred_single_year' WHEN years > 1 THEN 'inferred_most_recent' ELSE 'failed' END AS method,
CASE WHEN exact IS NOT NULL THEN 0.95 WHEN years = 1 THEN 0.9 WHEN years > 1 THEN 0.7 ELSE 0.0 END AS confidence FROM j""")


def _route(v):
    known = v("go_master").filter("k % 3 <> 0")
    resolved, candidates = r.route(v("relations"), known)
    both = resolved.select(*_cols, "origin", F.lit("legal_relations").alias("routed_to"))
    return both.unionByName(candidates.select(*_cols, F.lit(None).cast("string").alias("origin"), F.lit("relation_candidates").alias("routed_to")))


_register("res_06_route_relations", _route, f"""
SELECT {_COLS}, CASE WHEN go_id IS NULL THEN NULL WHEN confidence > 0.9 THEN 'llm' ELSE 'rule' END AS origin, CASE WHEN go_id IS NULL THEN 'relation_candidates' ELSE 'legal_relations' END AS routed_to
FROM relations LEFT JOIN (SELECT go_id FROM go_master WHERE k % 3 <> 0) g ON target_id = go_id""")
_register("grf_01_chain_flags", lambda v: r.chain_flags(v("go_master"), v("relations")), """
WITH f AS (SELECT target_id, arg_min(source_id, (seq, source_id)) AS s FROM relations WHERE relation_type IN ('supersedes', 'amends') GROUP BY 1)
SELECT go_id, s IS NOT NULL AS is_superseded, s AS superseded_by, s IS NULL AS is_most_recent FROM go_master LEFT JOIN f ON target_id = go_id""")
_register("grf_05_legal_status", lambda v: r.legal_status(v("docs"), v("relations")), f"""
WITH o AS (SELECT source_id, list_sort(list_distinct(list(target_id) FILTER (relation_type IN ('supersedes', 'amends')))) AS l, bool_or(relation_type = 'amends') AS a FROM relations GROUP BY 1)
SELECT document_id, coalesce(array_to_string(l, ','), '') AS previous_lineage, CASE WHEN a THEN 'partial' ELSE 'full' END AS valid_scope, CAST({_AUTH} AS DOUBLE) AS authority FROM docs LEFT JOIN o ON document_id = source_id""")
_register("grf_06_authority_conflict", lambda v: r.authority_conflict(v("relations"), v("docs")), f"""
WITH x AS (SELECT document_id, {_AUTH} AS w FROM docs), p AS (SELECT DISTINCT source_id, target_id FROM relations)
SELECT source_id, target_id, CASE WHEN a.w > b.w THEN 'source' WHEN b.w > a.w THEN 'target' ELSE 'equal' END AS winner FROM p JOIN x a ON a.document_id = source_id JOIN x b ON b.document_id = target_id""")
_register("grf_07_resolve_threads", lambda v: r.resolve_threads(v("threads"), v("go_master"), v("relations"), v("go_clauses"), "1997-01-01"), """
WITH t AS (SELECT DISTINCT thread_id, go_id FROM threads),
h AS (SELECT DISTINCT a.thread_id, x.target_id AS go_id, CASE WHEN scope = 'partial' THEN section END AS s FROM relations x JOIN go_master m ON m.go_id = x.source_id AND m.go_type = 'normative'
      JOIN t a ON a.go_id = x.source_id JOIN t b ON b.go_id = x.target_id AND a.thread_id = b.thread_id WHERE relation_type IN ('supersedes', 'amends', 'cancels', 'replaces')),
c AS (SELECT t.thread_id, t.go_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.thread_id = t.thread_id AND h.go_id = t.go_id AND (h.s IS NULL OR 'Rule ' || h.s = k.section_path)) THEN 'S'
      WHEN effective_to_date < DATE '1997-01-01' THEN 'I' ELSE 'A' END AS st FROM t JOIN go_clauses k ON k.go_id = t.go_id)
SELECT thread_id, go_id, count(*) AS n_clauses, count(*) FILTER (st = 'A') AS n_active, count(*) FILTER (st = 'S') AS n_superseded,
CASE WHEN count(*) FILTER (st = 'A') = count(*) THEN 'ACTIVE' WHEN count(*) FILTER (st = 'A') > 0 THEN 'PARTIALLY_ACTIVE' ELSE 'SUPERSEDED' END AS status FROM c GROUP BY 1, 2""")
_register("grf_08_match_section", lambda v: v("go_clauses").withColumn("section_key", r.section_key(F.col("section_path"))).join(
    v("relations").select(F.col("target_id").alias("go_id"), r.section_key(F.col("section")).alias("section_key")).distinct(), ["go_id", "section_key"]).select("clause_id", "section_key"),
    "SELECT clause_id, section AS section_key FROM go_clauses c JOIN (SELECT DISTINCT target_id, section FROM relations ) x ON x.target_id = c.go_id AND 'Rule ' || x.section = c.section_path")
_register("grf_09_thread_rollup", lambda v: r.thread_rollup(v("threads"), v("go_master")).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")}), """
WITH t AS (SELECT DISTINCT thread_id, go_id FROM threads)
SELECT thread_id, count(*) AS n_orders, CAST(min(go_date) AS VARCHAR) AS first_date, CAST(max(go_date) AS VARCHAR) AS last_date, string_agg(go_id, ',' ORDER BY go_date, go_id) AS go_ids FROM t JOIN go_master USING (go_id) GROUP BY 1""")
_register("grf_09_thread_members", lambda v: r.thread_members(v("threads"), v("go_master")), """
SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY go_date, go_id) AS place, go_id FROM (SELECT DISTINCT thread_id, go_id FROM threads) t JOIN go_master USING (go_id)""")
_register("grf_10_active_status", lambda v: r.active_status(v("go_master"), v("relations")), """
SELECT go_id, go_number, CASE WHEN EXISTS (SELECT 1 FROM relations WHERE target_id = g.go_id AND scope = 'full' AND relation_type IN ('supersedes', 'cancels')) THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM go_master g""")

_register("mig_01_go_to_documents", lambda v: w.go_to_documents(v("go_master"), v("threads"), v("docs").filter("doc_type = 'report'")).withColumn("doc_date", F.col("doc_date").cast("string")), """
WITH d AS (SELECT go_id, min(thread_id) AS domain FROM threads WHERE role = 'primary' GROUP BY 1)
SELECT DISTINCT go_id AS document_id, 'GO ' || go_number AS title, 'go' AS doc_type, coalesce(domain, 'general') AS domain, CAST(go_date AS VARCHAR) AS doc_date FROM go_master LEFT JOIN d USING (go_id)
WHERE NOT EXISTS (SELECT 1 FROM docs WHERE document_id = go_id AND docs.doc_type = 'report')""")
_register("mig_02_clauses_to_chunks", lambda v: w.clauses_to_chunks(v("go_clauses"), v("go_clauses").filter("clause_id LIKE '%_3'").withColumnRenamed("clause_id", "chunk_id")),
          "SELECT clause_id AS chunk_id, go_id AS document_id, section_path AS section FROM go_clauses WHERE clause_id NOT LIKE '%_3'")
_register("mig_03_relations_to_judgments", lambda v: w.relations_to_judgments(v("relations"), v("docs")), """
WITH j AS (SELECT document_id FROM docs WHERE doc_type = 'judgment')
SELECT DISTINCT source_id AS from_doc_id, target_id AS to_doc_id, CASE WHEN relation_type IN ('supersedes', 'cancels', 'overrules') THEN 'overrules' WHEN relation_type = 'amends' THEN 'followed' ELSE 'distinguished' END AS relation_type
FROM relations WHERE source_id IN (SELECT document_id FROM j) AND target_id IN (SELECT document_id FROM j) AND relation_type <> 'references'""")
_register("mig_04_threads_to_domains", lambda v: w.threads_to_domains(v("threads")), """
SELECT go_id AS document_id, max(thread_id) FILTER (role = 'primary') AS primary_domain, coalesce(array_to_string(list_sort(list_distinct(list(thread_id) FILTER (role <> 'primary'))), ','), '') AS secondary_domains,
CAST(max(confidence) AS DOUBLE) AS confidence FROM threads GROUP BY 1 HAVING max(thread_id) FILTER (role = 'primary') IS NOT NULL""")
_register("qa_01_ingestion_report", lambda v: w.ingestion_report(v("relations"), v("go_master").filter("k % 3 <> 0")), """
SELECT CASE WHEN go_id IS NULL THEN 'Unresolved' ELSE 'Resolved' END AS state, relation_type, count(*) AS n, count(DISTINCT source_id) AS n_sources
FROM relations LEFT JOIN (SELECT go_id FROM go_master WHERE k % 3 <> 0) g ON target_id = go_id GROUP BY 1, 2""")
_register("snk_03_delete_by_id_pattern", lambda v: w.delete_by_patterns(v("go_clauses"), "clause_id", ["go_1%_2", "%99_1"]).select("clause_id"),
          "SELECT clause_id FROM go_clauses WHERE NOT (clause_id LIKE 'go_1%_2' OR clause_id LIKE '%99_1')")
_register("emb_01_validate_vectors", lambda v: w.validate_vectors(v("embeddings"), "embedding", 64).select("vec_id", "reason"), """
SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'all_zero' WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 THEN 'not_finite'
WHEN sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) < 0.01 THEN 'norm_small' WHEN sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) > 100 THEN 'norm_large' END AS reason FROM embeddings""")
_register("emb_02_embed_cost", lambda v: w.embed_cost(v("documents"), "text", "source"),
          "SELECT source, count(*) AS n, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, sum(coalesce(length(text), 0)) / 1000 * 0.00001 AS cost FROM documents GROUP BY 1")
_register("emb_04_reuse_by_hash", lambda v: w.reuse_by_hash(v("documents"), "text", "embed", "m1"),
          "SELECT sha256('embed:m1:' || coalesce(text, '')) AS cache_key, count(*) AS n, count(*) - 1 AS hits FROM documents GROUP BY 1")

_register("ret_04_exclude_overruled", lambda v: t.exclude_overruled(v("hits"), v("relations")).select("query_id", "chunk_id", "source", "score"),
          "SELECT query_id, chunk_id, source, score FROM hits WHERE document_id NOT IN (SELECT target_id FROM relations WHERE relation_type = 'overrules')")
_register("ret_06_rrf", lambda v: t.rrf(v("hits"), 20), """
WITH f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS fused, count(*) AS n_lists FROM hits GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM f) x WHERE rank <= 20""")
_BOOST = "round(score * CASE lower(trim(court)) WHEN 'supreme court' THEN 1.5 WHEN 'hc' THEN 1.2 ELSE 1.0 END::DOUBLE * CASE lower(binding_strength) WHEN 'binding' THEN 1.3 WHEN 'persuasive' THEN 1.1 ELSE 1.0 END::DOUBLE, 6)"
_register("ret_07_authority_boost", lambda v: t.authority_boost(v("hits"), v("docs"), 20), f"""
WITH b AS (SELECT query_id, chunk_id, source, {_BOOST} AS boosted FROM hits LEFT JOIN docs USING (document_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, chunk_id, source) AS rank FROM b) x WHERE rank <= 20""")
_register("ret_08_source_priority", lambda v: t.source_priority(v("hits"), v("docs"), ["judgment", "regulation", "go"], 20), """
WITH b AS (SELECT query_id, chunk_id, source, doc_type, score, CASE doc_type WHEN 'judgment' THEN 1 WHEN 'regulation' THEN 2 WHEN 'go' THEN 3 ELSE 999 END AS p FROM hits JOIN docs USING (document_id))
SELECT query_id, chunk_id, source, doc_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, score DESC, chunk_id, source) AS rank FROM b) x WHERE rank <= 20""")


def _temporal(v):
    ops = F.array(*map(F.lit, ("before", "after", "during", "exact")))
    queries = v("hits").select("query_id").distinct().select("query_id", (F.lit(1993) + F.col("query_id") % 5).alias("q_year"), F.element_at(ops, (F.col("query_id") % 4 + 1).cast("int")).alias("operator"))
    return t.temporal_filter(v("hits"), v("docs"), queries)


_register("ret_11_temporal_filter", _temporal, """
WITH q AS (SELECT DISTINCT query_id, 1993 + query_id % 5 AS q FROM hits ), j AS (SELECT h.*, year(doc_date) AS year, q, query_id % 4 AS o FROM hits h LEFT JOIN docs USING (document_id) JOIN q USING (query_id))
SELECT query_id, chunk_id, source, year FROM j WHERE year IS NULL OR CASE o WHEN 0 THEN year < q WHEN 1 THEN year > q WHEN 2 THEN abs(year - q) <= 2 ELSE year = q END""")
_register("ret_13_compare_documents", lambda v: t.compare_documents(v("hits"), v("docs")).withColumn("doc_date", F.col("doc_date").cast("string")),
          "SELECT query_id, document_id, min(title) AS title, CAST(min(doc_date) AS VARCHAR) AS doc_date, count(*) AS n_chunks, max(score) AS best FROM hits JOIN docs USING (document_id) GROUP BY 1, 2")
_register("ret_17_answer_confidence", lambda v: t.answer_confidence(v("hits"), v("docs")), """
WITH g AS (SELECT query_id, count(*) AS n, count(*) FILTER (binding_strength = 'binding') AS n_binding FROM hits LEFT JOIN docs USING (document_id) GROUP BY 1)
SELECT *, round(least(n / 5, 1.0) * 0.4 + least(n_binding / 3, 1.0) * 0.6, 9) AS confidence FROM g""")
_register("evl_01_citation_accuracy", lambda v: t.citation_accuracy(v("golden"), v("answered")), """
WITH j AS (SELECT coalesce(e.query_id, a.query_id) AS query_id, e.document_id AS e, a.document_id AS a FROM golden e FULL JOIN answered a ON e.query_id = a.query_id AND e.document_id = a.document_id),
g AS (SELECT query_id, count(*) FILTER (e IS NOT NULL AND a IS NOT NULL) AS correct, count(*) FILTER (e IS NULL) AS incorrect, count(*) FILTER (a IS NULL) AS missing, CASE WHEN count(e) > 0 THEN count(e) ELSE count(a) END AS total FROM j GROUP BY 1)
SELECT *, round(correct / total, 9) AS accuracy FROM g""")
for _n, _col, _l in (("evl_02_authority_correctness", "authority", "{}.authority"), ("evl_03_temporal_correctness", "date", "left({}.doc_date, 4)")):
    _register(
        _n,
        lambda v, c=_col: t.match_rate(v("golden"), v("answered"), *([F.col("e_authority"), F.col("a_authority")] if c == "authority" else [F.substring("e_date", 1, 4), F.substring("a_date", 1, 4)])),
        f"SELECT e.query_id, count(*) AS total, count(*) FILTER ({_l.format('e')} = {_l.format('a')}) AS correct, round(count(*) FILTER ({_l.format('e')} = {_l.format('a')}) / count(*), 9) AS rate "
        "FROM golden e JOIN answered a ON e.query_id = a.query_id AND e.document_id = a.document_id GROUP BY 1",
    )
_register("ops_01_trace_metrics", lambda v: t.trace_metrics(v("traces")), """
SELECT pipeline_used, count(*) AS n, round(avg(CAST(fallback_used AS INT)), 9) AS fallback_rate, round(avg(CAST(failed AS INT)), 9) AS error_rate, round(avg(latency_ms), 4) AS mean_latency_ms FROM traces GROUP BY 1""")
_register("ops_02_latency_stats", lambda v: t.latency_stats(v("traces")), """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY pipeline_used ORDER BY latency_ms, request_id) AS i, count(*) OVER (PARTITION BY pipeline_used) AS n FROM traces )
SELECT pipeline_used, count(*) AS n, round(avg(latency_ms), 4) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, max(latency_ms) FILTER (i = floor(n * 0.95) + 1) AS p95_ms FROM o GROUP BY 1""")


_SP = g.SPACE
_TRIM = rf"regexp_replace({{}}, '^{_SP}+|{_SP}+$', '', 'g')"


def _others(x: str, pattern: str) -> str:
    return f"length(regexp_replace({x}, '{pattern}', '', 'g'))"


_T = f"length({_TRIM.format('x')})"
_ASCII, _LETTERS = _others("x", r"[^\x20-\x7E]"), _others("x", r"[^\p{L}]")
_KEEP = (
    f"CASE WHEN {_T} = 0 THEN true WHEN {_ASCII} >= {_T} * 0.7 THEN true WHEN {_others('x', g.SYMBOLS)} > {_T} * 0.15 THEN false WHEN {_ASCII} < {_T} * 0.4 AND {_LETTERS} < 5 THEN false "
    f"WHEN {_T} < 10 AND {_ASCII} < {_T} * 0.5 THEN false WHEN {_LETTERS} < {_T} * 0.3 THEN " + "(" + " OR ".join(f"contains(lower(x), '{k}')" for k in g.KEEP_WORDS) + ") ELSE true END"
)
_register("cln_02_drop_ocr_garbage_lines", lambda v: v("dirty").withColumn("kept", g.drop_garbage_lines(F.col("text"))).select("doc_id", F.md5("kept").alias("kept_md5"), F.length("kept").cast("long").alias("n_chars")),
          f"SELECT doc_id, md5(k) AS kept_md5, length(k) AS n_chars FROM (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_KEEP}), chr(10)) AS k FROM dirty) y")


def _split_sql(marked: str) -> str:
    return f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS l FROM dirty)
SELECT doc_id, CAST(i AS BIGINT) AS place, md5(l[i + 1]) AS part_md5 FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM p) y"""


def _parts(v, cut):
    return g.numbered(v("dirty"), cut(F.col("text")), "doc_id").select("doc_id", F.col("place").cast("long").alias("place"), F.md5("part").alias("part_md5"))


_register("chk_01_split_paragraphs", lambda v: _parts(v, g.paragraphs), _split_sql(
    rf"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{_SP}*\n', chr(1), 'g'), '\n({_SP}*(?:[0-9]+\.|[•*-]){_SP}+)', chr(1) || '\1', 'g')"))
_register("chk_03_split_sentences", lambda v: _parts(v, g.sentences), _split_sql(rf"regexp_replace(text, '([.!?]){_SP}+([A-Z])', '\1' || chr(1) || '\2', 'g')"))


def _query_types(v):
    kind, confidence, others = g.query_type(F.col("text"))
    return v("conversations").filter("role = 'user'").select("conv_id", "turn", kind.alias("query_type"), confidence.alias("confidence"), others.alias("others"))


def _query_types_sql() -> str:
    score = {}
    for name, patterns in g.QUERY_TYPES.items():
        hits = " + ".join(f"CAST(regexp_matches(q, '{p}') AS INT)" for p in patterns)
        score[name] = f"CASE WHEN {hits} > 1 THEN least(1.0::DOUBLE, ({hits}) * 1.5::DOUBLE / {len(patterns)}) ELSE ({hits})::DOUBLE / {len(patterns)} END AS {name}"
    best = f"greatest({', '.join(score)})"
    top = "CASE " + " ".join(f"WHEN {n} = {best} THEN '{n}'" for n in score) + " END"
    others = f"concat_ws(',', {', '.join(f"CASE WHEN {n} > 0.3 AND top <> '{n}' THEN '{n}' END" for n in score)})"
    return f"""
WITH s AS (SELECT conv_id, turn, {', '.join(score.values())} FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations WHERE role = 'user') x),
t AS (SELECT *, {best} AS best, {top} AS top FROM s)
SELECT conv_id, turn, CASE WHEN best < 0.2 THEN 'factual' ELSE top END AS query_type, round(CASE WHEN best < 0.2 THEN 0.5::DOUBLE ELSE best END, 9) AS confidence, {others} AS others FROM t"""


_register("cls_06_query_type", _query_types, _query_types_sql())

_register("grf_03_trace_lineage", lambda v: lineage.trace_lineage(v("go_master"), v("relations")), """
WITH RECURSIVE f AS MATERIALIZED (SELECT source_id AS s, arg_min(target_id, (seq, target_id)) AS t FROM relations WHERE relation_type IN ('supersedes', 'amends') GROUP BY 1),
w AS (SELECT go_id, go_id AS node, CAST(0 AS BIGINT) AS depth FROM go_master UNION ALL SELECT go_id, t, depth + 1 FROM w JOIN f ON s = node)
SELECT go_id, arg_max(node, depth) AS root, max(depth) AS depth FROM w GROUP BY 1""")



def _ordered(v):
    """The chain of every order at which a way back ends."""
    roots = lineage.trace_lineage(v("go_master"), v("relations")).filter("root IS NOT NULL").select(F.col("root").alias("go_id")).distinct()
    return lineage.ordered_ways(roots, lineage.following(v("relations"))).select(F.col("start").alias("root"), "place", "go_id")


_register("grf_03_ordered_lineage", _ordered, """
WITH RECURSIVE f AS MATERIALIZED (SELECT source_id AS s, arg_min(target_id, (seq, target_id)) AS t FROM relations WHERE relation_type IN ('supersedes', 'amends') GROUP BY 1),
w AS (SELECT go_id, go_id AS node, 0 AS depth FROM go_master UNION ALL SELECT go_id, t, depth + 1 FROM w JOIN f ON s = node),
n AS MATERIALIZED (SELECT target_id AS s, arg_min(source_id, (seq, source_id)) AS t FROM relations WHERE relation_type IN ('supersedes', 'amends') GROUP BY 1),
c AS (SELECT root, CAST(0 AS BIGINT) AS place, root AS go_id, [root] AS seen FROM (SELECT DISTINCT arg_max(node, depth) AS root FROM w GROUP BY go_id)
  UNION ALL SELECT root, place + 1, t, list_append(seen, t) FROM c JOIN n ON n.s = c.go_id WHERE NOT list_contains(seen, t))
SELECT root, place, go_id FROM c""")
_register("grf_03_lineage_chains", lambda v: lineage.lineage_chains(v("relations")))

_register("ret_12_timeline", lambda v: a.timeline(v("hits"), v("docs")), """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_date, document_id) AS place, year(doc_date) AS year, document_id, title
FROM (SELECT DISTINCT query_id, document_id FROM hits) x JOIN docs USING (document_id)""")
_LAYERS = {"primary": (0.5, ["go", "regulation"]), "binding": (0.3, ["judgment"]), "impact": (0.2, ["policy", "report"])}
_register("ret_10_layered_retrieve", lambda v: a.layered(v("hits"), v("docs"), _LAYERS, 20), """
WITH l AS (SELECT query_id, chunk_id, min(CASE WHEN doc_type IN ('go', 'regulation') THEN 0 WHEN doc_type = 'judgment' THEN 1 ELSE 2 END) AS n, max(score) AS score FROM hits JOIN docs USING (document_id) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, chunk_id) AS i FROM l)
SELECT query_id, chunk_id, ['primary', 'binding', 'impact'][n + 1] AS layer, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k WHERE i <= [10, 6, 4][n + 1]""")
_register("ret_14_judicial_validation", lambda v: a.judicial_validation(v("hits"), v("relations"), v("docs")), """
SELECT h.query_id, h.document_id, d.title, p.source_id AS overruled_by, o.title AS overruling_title, coalesce(d.binding_strength, 'unknown') AS binding_strength
FROM (SELECT DISTINCT query_id, document_id FROM hits) h JOIN (SELECT DISTINCT source_id, target_id FROM relations WHERE relation_type = 'overrules') p ON p.target_id = h.document_id
LEFT JOIN docs d ON d.document_id = h.document_id LEFT JOIN docs o ON o.document_id = p.source_id""")
_register("ret_16_citations", lambda v: a.citations(v("hits"), v("docs")), """
WITH b AS (SELECT query_id, document_id, max(score) AS score FROM hits GROUP BY 1, 2),
j AS (SELECT b.*, title, doc_date, binding_strength, CASE WHEN doc_type = 'judgment' THEN CASE court WHEN 'Supreme Court' THEN court WHEN 'hc' THEN 'High Court' ELSE 'Tribunal' END WHEN doc_type = 'regulation' THEN 'Statutory Law' WHEN doc_type = 'go' THEN 'Government Order' ELSE 'Policy Document' END AS authority FROM b JOIN docs USING (document_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE authority WHEN 'Supreme Court' THEN 10 WHEN 'High Court' THEN 7 WHEN 'Statutory Law' THEN 8 WHEN 'Government Order' THEN 5 WHEN 'Policy Document' THEN 4 ELSE 1 END DESC, score DESC, document_id) AS rank FROM j)
SELECT query_id, rank, document_id, authority, concat_ws(', ', title, authority, CAST(year(doc_date) AS VARCHAR), binding_strength) AS citation FROM k WHERE rank <= 5""")
_register("ret_18_context_pack", lambda v: a.context_pack(v("hits"), v("docs")), """
WITH k AS (SELECT query_id, chunk_id, coalesce(title, document_id) AS t, coalesce(CAST(doc_date AS VARCHAR), 'undated') AS d, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, source) AS rank FROM hits LEFT JOIN docs USING (document_id))
SELECT query_id, count(*) AS n, string_agg('[' || rank || '] ' || t || ' (' || d || '): ' || chunk_id, chr(10) ORDER BY rank) AS context FROM k WHERE rank <= 10 GROUP BY 1""")
_SIGNALS = """
WITH c AS (SELECT query_id, count(*) FILTER (document_id IN (SELECT target_id FROM relations WHERE relation_type = 'overrules')) AS overruled_precedent, count(*) FILTER (status = 'superseded') AS temporal_conflict,
CAST(count(*) FILTER (doc_type = 'judgment' AND court = 'Supreme Court') > 1 AS BIGINT) AS conflicts_with_sc_judgment, CAST(count(*) FILTER (doc_type = 'go') > 0 AND count(*) FILTER (doc_type = 'regulation') > 0 AS BIGINT) AS conflicts_with_legal_act
FROM hits LEFT JOIN docs USING (document_id) GROUP BY 1),
s AS (SELECT query_id, 'overruled_precedent' AS signal, overruled_precedent AS n, 6.0::DOUBLE AS w FROM c UNION ALL SELECT query_id, 'temporal_conflict', temporal_conflict, 5 FROM c
UNION ALL SELECT query_id, 'conflicts_with_sc_judgment', conflicts_with_sc_judgment, 10 FROM c UNION ALL SELECT query_id, 'conflicts_with_legal_act', conflicts_with_legal_act, 8 FROM c)
"""
_signals = lambda v: a.risk_signals(v("hits"), v("relations"), v("docs"))
_register("rsk_01_risk_signals", _signals, _SIGNALS + "SELECT query_id, signal, n FROM s WHERE n > 0")
_register("rsk_02_risk_score", lambda v: a.risk_score(_signals(v)), _SIGNALS + """, z AS (SELECT query_id, CAST(sum(n) AS BIGINT) AS n_signals, least(sum(n * w) * 5, 100.0::DOUBLE) AS risk_score FROM s WHERE n > 0 GROUP BY 1)
SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' WHEN risk_score >= 20 THEN 'low' ELSE 'none' END AS risk_level FROM z""")

# The same over every hit; the SQL of the four names above takes the first 3 or 20.
_every_signal = lambda v: a.risk_signals(v("hits"), v("relations"), v("docs"))
for _n, _job in {
    "ret_12_timeline": lambda v: a.timeline(v("hits"), v("docs")),
    "ret_17_answer_confidence": lambda v: t.answer_confidence(v("hits"), v("docs")),
    "rsk_01_risk_signals": _every_signal,
    "rsk_02_risk_score": lambda v: a.risk_score(_every_signal(v)),
}.items():
    QUERIES[f"{_n}_every_hit"] = lambda spark, sf_dir, job=_job: job(lambda table: view(spark, sf_dir, table))
    ORACLE_SQL[f"{_n}_every_hit"] = ORACLE_SQL[_n].replace(" WHERE rnk <= 20", "").replace(" WHERE rnk <= 3", "")


def _claims(v):
    said = v("conversations").groupBy(F.col("conv_id").alias("query_id"))
    joined = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), ". ")
    rows = said.agg(joined("assistant").alias("answer"), joined("user").alias("context"))
    return a.claim_support(rows.select("query_id", "answer"), rows.select("query_id", "context"))


_register("evl_04_claim_support", _claims, rf"""
WITH r AS (SELECT conv_id AS query_id, coalesce(string_agg(text, '. ' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS answer, lower(coalesce(string_agg(text, '. ' ORDER BY turn, text) FILTER (role = 'user'), '')) AS context FROM conversations GROUP BY 1),
c AS (SELECT query_id, context, unnest(list_filter(list_transform(string_split(answer, '.'), lambda x: {_TRIM.format('x')}), lambda x: length(x) > 20)) AS claim FROM r),
w AS (SELECT query_id, context, list_filter(list_distinct(regexp_split_to_array(lower(claim), '{_SP}+')), lambda x: length(x) > 3) AS words FROM c),
n AS (SELECT query_id, len(words) AS total, len(list_filter(words, lambda x: contains(context, x))) AS found FROM w)
SELECT query_id, count(*) AS n_claims, count(*) FILTER (total > 0 AND found >= total * 0.3) AS n_supported, round(1 - count(*) FILTER (total > 0 AND found >= total * 0.3) / count(*), 9) AS hallucination_rate FROM n GROUP BY 1""")


def _ingested(spark, sf_dir):
    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    either = source[:-1] + "[t]"  # a pattern, since the table may be a file or a folder
    return ingest(spark, either, schema, new_folder(spark, "ingested"), new_folder(spark, "ingest-log")).select("doc_id", "text_sha256")


QUERIES["snk_05_incremental_ingest"] = _ingested
ORACLE_SQL["snk_05_incremental_ingest"] = "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL"
_register("snk_05_not_yet_ingested", lambda v: not_yet_ingested(v("documents"), v("labels"), "doc_id").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")

_register(
    "ent_01_regex_entities",
    lambda v: v("letters").select("doc_id", *[F.array_join(e.found_entities(F.col("text"), k), " | ").alias(k) for k in e.ENTITIES]),
    "SELECT doc_id, " + ", ".join(
        "array_to_string(list_sort(list_distinct(list_transform(" + " || ".join(f"regexp_extract_all(coalesce(text, ''), '{p}', 1)" for p in patterns)
        + f", lambda x: CASE WHEN starts_with(x, '{before.strip()}') THEN x ELSE '{before}' || x END))), ' | ') AS {kind}"
        for kind, (before, patterns) in e.ENTITIES.items()
    ) + " FROM letters",
)


def _domains(v):
    listed, primary = e.policy_domains(F.col("text"))
    return v("letters").select("doc_id", F.array_join(listed, ",").alias("domains"), primary.alias("primary_domain"))


_register("cls_03_policy_domains", _domains, "WITH n AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{e.domain_pattern(d)}')) AS {d}" for d in e.DOMAINS)
    + " FROM letters) SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {d} > 0 THEN '{d}' END" for d in e.DOMAINS) + ") AS domains, CASE WHEN greatest(" + ", ".join(e.DOMAINS)
    + ") = 0 THEN 'general' " + " ".join(f"WHEN {d} = greatest({', '.join(e.DOMAINS)}) THEN '{d}'" for d in e.DOMAINS) + " END AS primary_domain FROM n")
_register("ent_08_normalize_department", lambda v: v("offices").select("go_id", e.department(F.col("department")).alias("department"), e.order_type(F.col("go_type")).alias("go_type")),
    "SELECT go_id, CASE " + " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(f"contains(upper(coalesce(department, '')), '{x}')" for x in words) + ')' for words in ways)} THEN '{name}'" for name, ways in e.DEPARTMENTS.items())
    + " ELSE 'UNKNOWN' END AS department, CASE WHEN go_type IS NULL OR lower(go_type) = 'unknown' THEN 'administrative' ELSE go_type END AS go_type FROM offices")
_register("rel_02_ocr_confidence", lambda v: v("letters").select("doc_id", F.round(e.ocr_confidence(F.col("text"), F.lit(0.9)), 9).alias("confidence")),
    f"SELECT doc_id, round(CASE WHEN regexp_matches(coalesce(text, ''), '{e.OCR_NOISE}') THEN 0.9::DOUBLE * 0.6 WHEN contains(lower(coalesce(text, '')), 'vide') THEN 0.9::DOUBLE * 0.8 ELSE 0.9::DOUBLE END, 9) AS confidence FROM letters")
_register("rel_10_candidate_sentences", lambda v: v("letters").select("doc_id", F.posexplode(e.candidate_sentences(F.col("text"))).alias("place", "sentence")).withColumn("place", F.col("place") + 1),
    f"WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{e.SENTENCE_GAP}'), lambda x: {' OR '.join(f"contains(lower(x), '{w}')" for w in e.RELATION_WORDS)})[1:20] AS found FROM letters), "
    + f"u AS (SELECT doc_id, unnest(found) AS x, generate_subscripts(found, 1) AS place FROM c) SELECT doc_id, CAST(place AS INT) AS place, {_TRIM.format('x')} AS sentence FROM u")
_register("evl_05_risk_detection", lambda v: t.risk_detection(v("risks").select("query_id", F.col("expected").alias("risk_level")), v("risks").select("query_id", F.col("actual").alias("risk_level"))), """
WITH b AS (SELECT x.expected, y.actual FROM risks x LEFT JOIN risks y USING (query_id) WHERE x.expected IS NOT NULL)
SELECT count(*) AS total_queries, count(*) FILTER (expected = actual) AS correct, count(*) FILTER (expected IS DISTINCT FROM actual) AS incorrect,
count(*) FILTER (expected = 'none' AND actual IN ('low', 'medium', 'high', 'critical')) AS false_positives, count(*) FILTER (expected IN ('low', 'medium', 'high', 'critical') AND actual = 'none') AS false_negatives,
round(coalesce(count(*) FILTER (expected = actual) / nullif(count(*), 0), 0), 9) AS accuracy FROM b""")

for _family in (search, linked, structure, texts, tables, jobs, details, routed):
    QUERIES.update(_family.register.queries)
    ORACLE_SQL.update(_family.register.sql)
