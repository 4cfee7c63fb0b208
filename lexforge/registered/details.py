"""Registered queries of the fuller forms of some jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import unicode as u
from ..operators import answers as a
from ..operators import details as d
from ..operators import retrieval as r
from ..operators import tables as t
from ..operators import warehouse as w
from ..plans.registering import Register

register = Register()
_PREC = "CASE relation_type WHEN 'overrules' THEN 6 WHEN 'supersedes' THEN 5 WHEN 'cancels' THEN 4 WHEN 'amends' THEN 3 WHEN 'clarifies' THEN 2 WHEN 'references' THEN 1 ELSE 0 END"


def _keyed(v):
    """Relations of which a third is resolved, a third has a number, the rest raw text."""
    part = F.col("seq") % 3
    return v("relations").select("source_id", "relation_type", "confidence", "scope", F.struct("seq", "section", "confidence", "scope", "target_id").alias("seq"),
                                 F.when(part == 0, F.col("target_id")).alias("target_id"), F.when(part == 1, F.substring("target_id", 4, 9)).alias("go_number"), F.upper("target_id").alias("raw_text"))


_KEYED = """
WITH k AS (SELECT source_id, relation_type, confidence, scope, seq, section, target_id AS t, CASE seq % 3 WHEN 0 THEN target_id WHEN 1 THEN substr(target_id, 4, 9) ELSE lower(target_id) END AS target_key FROM relations ),
"""
_KEY_COLS = ["source_id", "target_key", "relation_type", "confidence"]
register("rel_06_precedence_any_key", lambda v: d.precedence_by_key(_keyed(v)).select(*_KEY_COLS), _KEYED + f"n AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_key ORDER BY {_PREC} DESC, confidence DESC, seq, section, scope, t) AS n FROM k) SELECT {', '.join(_KEY_COLS)} FROM n WHERE n = 1")
register("rel_07_dedupe_any_key", lambda v: d.dedupe_by_key(_keyed(v)).select(*_KEY_COLS), _KEYED + f"n AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_key, relation_type ORDER BY seq, section, confidence, scope, t) AS n FROM k) SELECT {', '.join(_KEY_COLS)} FROM n WHERE n = 1")
register("rel_11_corpus_summary", lambda v: d.corpus_summary(v("relations")), """
WITH t(relation_type) AS (VALUES ('overrules'), ('supersedes'), ('cancels'), ('amends'), ('clarifies'), ('references'), ('overruled_by'))
SELECT t.relation_type, count(r.source_id) AS n, count(DISTINCT r.source_id) AS n_sources, count(*) FILTER (r.scope = 'partial') AS n_partial FROM t LEFT JOIN relations r ON r.relation_type = t.relation_type GROUP BY 1""")


def _alternatives(v):
    registry = v("books").filter("ref_type = 'go'").select("number", F.col("year").cast("int").alias("year"))
    refs = v("mentions").filter("go_number IS NOT NULL").select(F.col("rel_id").alias("ref_id"), F.concat(F.lit("No. "), "go_number").alias("number"), F.col("year").cast("int").alias("year"))
    return d.go_alternatives(refs, registry).withColumn("alternatives", F.array_join("alternatives", ","))


register("res_02_alternatives", _alternatives, """
WITH y AS (SELECT number, year, row_number() OVER (PARTITION BY number ORDER BY CAST(year AS INT) DESC) AS i, count(*) OVER (PARTITION BY number) AS n FROM (SELECT DISTINCT number, year FROM books WHERE ref_type = 'go') x)
SELECT rel_id AS ref_id, string_agg('GO.MS.No.' || number || '_' || y.year, ',' ORDER BY y.year) AS alternatives FROM mentions m JOIN y ON y.number = m.go_number AND n > 1 AND i > 1
WHERE NOT EXISTS (SELECT 1 FROM y z WHERE z.number = m.go_number AND z.year = m.year) GROUP BY 1""")


def _governed(v):
    return v("relations").withColumn("relation_type", F.when(F.col("relation_type") == "references", "governed_by").otherwise(F.col("relation_type")))


register("grf_05_overridden_by", lambda v: d.overridden_by(_governed(v), v("docs")).withColumn("overridden_by", F.array_join("overridden_by", ",")), """
SELECT source_id AS document_id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS overridden_by, CASE any_value(s.doc_type) WHEN 'go' THEN 0.7 ELSE 0.5 END::DOUBLE AS authority
FROM relations r JOIN docs j ON j.document_id = r.target_id AND j.doc_type = 'judgment' LEFT JOIN docs s ON s.document_id = r.source_id WHERE relation_type = 'references' GROUP BY 1""")
_EFFECTIVE = """
WITH t AS (SELECT DISTINCT thread_id, go_id FROM threads),
h AS (SELECT DISTINCT a.thread_id, x.target_id AS go_id, CASE WHEN scope = 'partial' THEN section END AS s FROM relations x JOIN go_master m ON m.go_id = x.source_id AND m.go_type NOT IN ('administrative', 'procedural', 'financial')
      JOIN t a ON a.go_id = x.source_id JOIN t b ON b.go_id = x.target_id AND a.thread_id = b.thread_id WHERE relation_type IN ('supersedes', 'amends', 'cancels', 'replaces')),
e AS (SELECT t.thread_id, t.go_id, clause_id FROM t JOIN go_clauses k ON k.go_id = t.go_id WHERE (effective_to_date IS NULL OR effective_to_date >= DATE '1997-01-01')
      AND NOT EXISTS (SELECT 1 FROM h WHERE h.thread_id = t.thread_id AND h.go_id = t.go_id AND (h.s IS NULL OR 'Rule ' || h.s = k.section_path)))
"""
register("grf_07_effective_clauses", lambda v: d.effective_clauses(v("threads"), v("go_master"), v("relations"), v("go_clauses"), "1997-01-01"), _EFFECTIVE + "SELECT thread_id, go_id, clause_id FROM e")
register("grf_07_thread_records", lambda v: d.thread_records(v("threads"), v("go_master"), v("relations"), v("go_clauses"), "1997-01-01"), _EFFECTIVE + """,
c AS (SELECT thread_id, go_id, count(*) AS n_effective FROM e GROUP BY 1, 2), o AS (SELECT thread_id, count(*) AS n FROM t GROUP BY 1), x AS (SELECT thread_id, count(*) AS n FROM c GROUP BY 1)
SELECT c.thread_id, c.go_id, n_effective, CASE WHEN x.n < o.n THEN 'PARTIALLY_ACTIVE' ELSE 'ACTIVE' END AS thread_status FROM c JOIN o USING (thread_id) JOIN x USING (thread_id)""")
register("ret_06_rrf_rows", lambda v: d.fused_rows(v("hits"), "lexical", 20), """
WITH f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS fused, arg_min(source, source <> 'lexical') AS source, arg_min(document_id, source <> 'lexical') AS document_id, arg_min(score, source <> 'lexical') AS score FROM hits GROUP BY 1, 2)
SELECT query_id, chunk_id, fused, rank, source, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM f) x WHERE rank <= 20""")


def _questions(v):
    words = F.element_at(F.array(*map(F.lit, ("What held before 1996?", "Rules after 1994", "since 1995 fees", "until 1993", "orders during 1994", "1995", "no year"))), (F.col("query_id") % 7 + 1).cast("int"))
    asked = v("hits").select("query_id").distinct().withColumn("text", words)
    return r.temporal_filter(v("hits"), v("docs"), r.temporal_context(asked, "text").select("query_id", F.col("year").alias("q_year"), "operator"))


register("ret_11_temporal_questions", _questions, """
WITH j AS (SELECT h.*, year(doc_date) AS year, query_id % 7 AS o FROM hits h LEFT JOIN docs USING (document_id))
SELECT query_id, chunk_id, source, year FROM j WHERE year IS NULL OR CASE o WHEN 0 THEN year < 1996 WHEN 1 THEN year > 1994 WHEN 2 THEN year > 1995 WHEN 3 THEN year < 1993 WHEN 4 THEN abs(year - 1994) <= 2 WHEN 5 THEN year = 1995 ELSE true END""")


def _hits(v):
    """Hits on real chunks: those that hold the query's first long word."""
    from .search import _lexical

    return _lexical(v)


_LEX = r"""
WITH q AS (SELECT query_id, domains, since_date, jurisdiction AS j, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '\S+'), lambda x: length(x) > 3)[1:5])) AS term FROM asks),
h AS (SELECT DISTINCT query_id, chunk_id, c.document_id, doc_date FROM q JOIN chunks c ON contains(lower(c.text), term) JOIN papers p ON p.document_id = c.document_id
      WHERE status = 'active' AND list_contains(domains, primary_domain) AND (since_date IS NULL OR doc_date >= since_date) AND (j IS NULL OR jurisdiction = j)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_date DESC NULLS LAST, chunk_id) AS rnk FROM h) x WHERE rnk <= 40)
"""
register("ret_12_timeline_excerpts", lambda v: d.timeline_excerpts(_hits(v), v("chunks"), v("papers")), _LEX + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY year(l.doc_date), l.chunk_id) AS place, year(l.doc_date) AS year, l.chunk_id, title, court AS authority, substr(c.text, 1, 150) AS excerpt FROM l JOIN chunks c USING (chunk_id) JOIN papers p ON p.document_id = l.document_id""")
register("ret_13_compared_chunks", lambda v: d.compared_chunks(_hits(v), v("papers")), _LEX + """
SELECT query_id, l.document_id, chunk_id, row_number() OVER (PARTITION BY query_id, l.document_id ORDER BY chunk_id) AS place, n AS documents_compared, title, CAST(p.doc_date AS VARCHAR) AS doc_date
FROM l JOIN (SELECT query_id, count(DISTINCT document_id) AS n FROM l GROUP BY 1) g USING (query_id) JOIN papers p ON p.document_id = l.document_id""")
register("ret_14_validation_summary", lambda v: d.validation_summary(v("hits"), v("relations"), v("docs")), """
WITH b AS (SELECT target_id, min(source_id) AS s FROM relations WHERE relation_type = 'overrules' GROUP BY 1), j AS (SELECT query_id, document_id, title, doc_type, court, s FROM (SELECT DISTINCT query_id, document_id FROM hits) h LEFT JOIN docs USING (document_id) LEFT JOIN b ON target_id = document_id)
SELECT query_id, count(*) AS documents_checked, count(*) FILTER (doc_type = 'judgment') AS n_judgments, coalesce(string_agg(DISTINCT court, ',' ORDER BY court) FILTER (doc_type = 'judgment'), '') AS courts, count(s) AS n_overruled,
coalesce(string_agg(DISTINCT coalesce(title, document_id) || ' is overruled by ' || s, '; ' ORDER BY coalesce(title, document_id) || ' is overruled by ' || s), '') AS warnings FROM j GROUP BY 1""")


def _hierarchy(v):
    cited = a.citations(v("hits"), v("docs")).join(v("docs").select("document_id", F.col("binding_strength").alias("strength")), "document_id")
    return d.source_hierarchy(cited)


register("ret_16_source_hierarchy", _hierarchy, """
WITH b AS (SELECT query_id, document_id, max(score) AS score FROM hits GROUP BY 1, 2),
j AS (SELECT b.*, binding_strength, CASE WHEN doc_type = 'judgment' THEN CASE court WHEN 'Supreme Court' THEN 10 WHEN 'hc' THEN 7 ELSE 1 END WHEN doc_type = 'regulation' THEN 8 WHEN doc_type = 'go' THEN 5 ELSE 4 END AS w FROM b JOIN docs USING (document_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, score DESC, document_id) AS rank FROM j)
SELECT query_id, coalesce(string_agg(document_id, ',' ORDER BY rank) FILTER (binding_strength = 'binding'), '') AS binding, coalesce(string_agg(document_id, ',' ORDER BY rank) FILTER (binding_strength = 'persuasive'), '') AS persuasive,
coalesce(string_agg(document_id, ',' ORDER BY rank) FILTER (coalesce(binding_strength, '') NOT IN ('binding', 'persuasive')), '') AS other FROM k WHERE rank <= 5 GROUP BY 1""")


def _titles(v):
    rows = v("papers").select("document_id", F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "None").otherwise(F.col("title")).alias("title"), F.when(F.col("k") % 5 == 0, "subject").alias("subject"), F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).alias("go_number"))
    return rows.select("document_id", d.citation_title(rows.columns).alias("citation_title"))


register("ret_16_citation_titles", _titles, "SELECT document_id, CASE WHEN k % 3 = 2 THEN title WHEN k % 5 = 0 THEN 'subject' WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE document_id END AS citation_title FROM papers")
register("ret_18_context_excerpts", lambda v: d.context_excerpts(_hits(v), v("chunks"), v("papers")), _LEX + """
SELECT query_id, l.rnk AS rank, chunk_id, '[' || l.rnk || '] ' || title || ' (' || CAST(p.doc_date AS VARCHAR) || '): ' || substr(c.text, 1, 500) AS passage FROM l JOIN chunks c USING (chunk_id) JOIN papers p ON p.document_id = l.document_id WHERE l.rnk <= 10""")


def _more(v):
    answers = v("asks").select("query_id", F.when(F.col("query_id") % 2 == 0, "It is Unconstitutional and ARBITRARY.").otherwise("Fine.").alias("answer"))
    return d.more_signals(_hits(v), v("papers"), answers)


_MORE = _LEX + """, m AS (SELECT query_id, 'jurisdiction_mismatch' AS signal, 1 AS n FROM l JOIN papers p ON p.document_id = l.document_id GROUP BY 1 HAVING bool_or(p.jurisdiction = 'AP') AND bool_or(p.jurisdiction = 'central')
UNION ALL SELECT query_id, 'constitutional_violation', 2 FROM asks WHERE query_id % 2 = 0)
"""
register("rsk_01_more_signals", _more, _MORE + "SELECT query_id, signal, n FROM m")
register("rsk_02_risk_levels", lambda v: d.risk_levels(_more(v)), _MORE + """
SELECT query_id, least(sum(n * CASE signal WHEN 'jurisdiction_mismatch' THEN 9 ELSE 15 END) * 5, 100)::DOUBLE AS risk_score, CAST(coalesce(sum(n) FILTER (signal = 'constitutional_violation'), 0) AS BIGINT) AS n_critical,
CAST(coalesce(sum(n) FILTER (signal = 'jurisdiction_mismatch'), 0) AS BIGINT) AS n_high, 0 AS n_medium, 0 AS n_low FROM m GROUP BY 1""")
register("ops_01_last_requests", lambda v: d.last_requests(v("traces").withColumn("routed", F.col("request_id") % 4 == 0), 100), """
WITH l AS (SELECT * FROM traces ORDER BY ts DESC, request_id DESC LIMIT 100), t AS (SELECT count(*) AS total_requests, round(avg(CAST(request_id % 4 = 0 AS INT)), 9) AS router_usage_rate, round(avg(CAST(fallback_used AS INT)), 9) AS fallback_rate,
round(avg(CAST(failed AS INT)), 9) AS error_rate, round(avg(latency_ms), 4) AS mean_latency_ms FROM l) SELECT coalesce(pipeline_used, 'unknown') AS pipeline, count(*) AS n, any_value(t.total_requests) AS total_requests, any_value(router_usage_rate) AS router_usage_rate,
any_value(fallback_rate) AS fallback_rate, any_value(error_rate) AS error_rate, any_value(mean_latency_ms) AS mean_latency_ms FROM l, t GROUP BY 1""")
register("ops_02_load_report", lambda v: d.load_report(r.latency_stats(v("traces")), v("traces")), """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY pipeline_used ORDER BY latency_ms, request_id) AS i, count(*) OVER (PARTITION BY pipeline_used) AS n FROM traces ),
g AS (SELECT pipeline_used, count(*) AS n, round(avg(latency_ms), 4) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, max(latency_ms) FILTER (i = floor(n * 0.95) + 1) AS p95_ms, round(1 - avg(CAST(failed AS INT)), 9) AS success_rate FROM o GROUP BY 1)
SELECT *, avg_ms < 3500 AND p95_ms < 5000 AS passed FROM g""")
register("emb_02_run_metrics", lambda v: d.run_metrics(v("chunks"), 32), r"""
SELECT count(*) AS n_chunks, CAST(ceil(count(*) / 32) AS BIGINT) AS n_batches, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) / 1000 * 0.00001 AS cost, count(*) FILTER (trim(regexp_replace(text, '\s', '', 'g')) = '') AS n_blank FROM chunks""")


def _cache(v):
    key = F.sha2(F.concat(F.lit("embed:m1:"), F.coalesce("text", F.lit(""))), 256).alias("cache_key")
    return v("chunks").filter("chunk_id LIKE '%5_0'").select(key).distinct()


register("emb_04_cache_misses", lambda v: d.cache_lookup(v("chunks"), _cache(v), "embed", "m1")[0].select("cache_key"), "SELECT DISTINCT sha256('embed:m1:' || text) AS cache_key FROM chunks WHERE text NOT IN (SELECT text FROM chunks WHERE chunk_id LIKE '%5_0')")
register("emb_04_cache_stats", lambda v: d.cache_lookup(v("chunks"), _cache(v), "embed", "m1")[1], """
WITH g AS (SELECT text, count(*) AS n, bool_or(chunk_id LIKE '%5_0') AS c FROM chunks GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS requests, count(*) FILTER (NOT c) AS misses FROM g) SELECT *, requests - misses AS hits, round((requests - misses) / requests, 9) AS hit_rate FROM s""")
register("emb_04_purge_cache", lambda v: d.purge_cache(v("papers").select("document_id", F.when(F.col("k") % 9 != 0, F.col("doc_date")).alias("created")), "2015-06-01", 1000).select("document_id"),
         "SELECT document_id FROM papers WHERE k % 9 = 0 OR DATE '2015-06-01' - doc_date <= 1000")


def _purged(v):
    frames = d.delete_from_tables({"go_master": v("go_master").select("go_id"), "go_clauses": v("go_clauses").select("go_id", "clause_id"), "view": v("go_master").select("go_id")}, {"go_master": "go_id", "go_clauses": "clause_id"}, ["go_1%", "%99_1"])
    return frames["go_master"].select(F.lit("go_master").alias("table_name"), F.col("go_id").alias("id")).unionByName(frames["go_clauses"].select(F.lit("go_clauses").alias("table_name"), F.col("clause_id").alias("id"))).unionByName(
        frames["view"].select(F.lit("view").alias("table_name"), F.col("go_id").alias("id")))


register("snk_03_delete_from_tables", _purged, """
SELECT 'go_master' AS table_name, go_id AS id FROM go_master WHERE go_id NOT LIKE 'go_1%' AND go_id NOT LIKE '%99_1' UNION ALL SELECT 'go_clauses', clause_id FROM go_clauses WHERE clause_id NOT LIKE 'go_1%' AND clause_id NOT LIKE '%99_1' UNION ALL SELECT 'view', go_id FROM go_master""")


def _parameters(v):
    kind = F.element_at(F.array(*map(F.lit, ("factual", "comparative", "risk_analysis", "judicial_constraint", "temporal", "jurisdictional", "other"))), (F.col("k") % 7 + 1).cast("int"))
    return v("papers").select("k", *[(F.array_join(c, ",") if n == "source_priorities" else c).alias(n) for n, c in d.query_parameters(kind).items()])


register("cls_06_retrieval_params", _parameters, """
SELECT k, [15, 30, 25, 20, 20, 20, 20][k % 7 + 1] AS top_k, CASE WHEN k % 7 BETWEEN 1 AND 3 THEN 'deep' ELSE 'standard' END AS depth, ['judicial,legal,go,scheme', 'go,legal,judicial', 'judicial,legal,go', 'judicial,legal', '', '', ''][k % 7 + 1] AS source_priorities,
k % 7 = 4 AS temporal_from_query, k % 7 = 5 AS jurisdiction_from_query FROM papers""")
register("qlt_01_pages", lambda v: v("papers").select("document_id", *[c.alias(n) for n, c in d.extraction_gate(F.col("text"), (F.col("k") % 9 + 1).cast("int")).items()]), r"""
SELECT document_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS n_words, CAST(length(text) AS INT) AS n_chars, CAST(k % 9 + 1 AS INT) AS n_pages, len(regexp_extract_all(text, '\S+')) > 50 AS ok, regexp_replace(text, '^\s+|\s+$', '', 'g') = '' OR len(regexp_extract_all(text, '\S+')) < 10 * (k % 9 + 1) AS needs_ocr,
regexp_matches(substr(text, 1, 2000), '\(cid:[0-9]+\)') AS garbled FROM papers""")


def _named(v):
    departments, schemes = d.departments_and_schemes(F.col("text"))
    return v("filings").select("document_id", F.array_join(departments, "|").alias("departments"), F.array_join(schemes, "|").alias("schemes"))


register("ent_01_departments_schemes", _named)
register("mig_01_with_authority", lambda v: d.documents_with_authority(w.go_to_documents(v("go_master"), v("threads"), v("docs").filter("doc_type = 'report'")).select("document_id", "title"), v("go_master").filter("k % 3 = 0").select("go_id", F.col("department").alias("authority_name"))), """
SELECT go_id AS document_id, 'GO ' || go_number AS title, CASE WHEN k % 3 = 0 THEN department ELSE 'State Government' END AS authority FROM go_master WHERE NOT EXISTS (SELECT 1 FROM docs WHERE document_id = go_id AND docs.doc_type = 'report')""")


def _totals(v):
    links = t.act_links(v("intake"))
    return d.report_totals(v("intake").select(F.col("doc_id").alias("go_id"), F.coalesce("go_archetype", F.lit("unknown")).alias("go_type")), t.effects(v("intake")), links, "d1%")


register("qa_01_totals", _totals, """
WITH i AS (SELECT * FROM intake WHERE doc_id LIKE 'd1%') SELECT 'orders' AS section, 'all' AS name, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM i UNION ALL SELECT 'archetype', coalesce(go_archetype, 'unknown'), count(*), count(DISTINCT doc_id) FROM i GROUP BY 2
UNION ALL SELECT 'effect', split_part(x, '|', 2), count(*), count(DISTINCT doc_id) FROM (SELECT doc_id, unnest(dates) AS x FROM i) e GROUP BY 2 UNION ALL SELECT 'act', split_part(x, '|', 1), count(*), count(DISTINCT doc_id) FROM (SELECT doc_id, unnest(list_filter(acts, lambda x: x <> '')) AS x FROM i) l GROUP BY 2""")
register("cln_10_all_steps", lambda v: v("filings").withColumn("cleaned", u.clean_text(F.col("text"))).select("document_id", cleaning.words(F.col("text")).alias("words_before"), cleaning.words(F.col("cleaned")).alias("words_after"), F.length("text").alias("chars_before"), F.length("cleaned").alias("chars_after")))
