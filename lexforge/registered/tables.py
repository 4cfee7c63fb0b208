"""Registered queries of table building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structure as st
from ..operators import relations as r
from ..operators import tables as t
from ..plans.registering import Register

register = Register()

_SOME = "list_filter({}, lambda x: x <> '')"
_ISO = "coalesce(strftime(coalesce(try_strptime({0}, '%d-%m-%Y'), try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%d.%m.%Y'), try_strptime({0}, '%d/%m/%Y')), '%Y-%m-%d'), CASE WHEN regexp_full_match({0}, '[0-9]{{2}}-[0-9]{{4}}') THEN substr({0}, 4, 4) || '-' || substr({0}, 1, 2) || '-01' END, '1970-01-01')"
_MASTER = f"""
ma AS (SELECT doc_id AS go_id, coalesce(go_number, 'UNKNOWN') AS go_number, {_ISO.format('go_date')} AS go_date, coalesce({_SOME.format('departments')}[1], 'UNKNOWN') AS department, coalesce(go_archetype, 'unknown') AS go_type, file_path AS raw_pdf_uri FROM intake )
"""


def _both(frames):
    good, bad = frames
    return good.select(*good.columns, F.lit(None).cast("string").alias("error_type")).unionByName(bad, allowMissingColumns=True)


register("tbl_01_go_master", lambda v: _both(t.go_master(v("intake"))), f"""
WITH {_MASTER} SELECT go_id, CASE WHEN ok THEN go_number END AS go_number, CASE WHEN ok THEN go_date END AS go_date, CASE WHEN ok THEN department END AS department, CASE WHEN ok THEN go_type END AS go_type, CASE WHEN ok THEN raw_pdf_uri END AS raw_pdf_uri,
CASE WHEN NOT ok THEN 'invalid identity' END AS error_type FROM (SELECT *, go_number <> 'UNKNOWN' AND go_date <> '1970-01-01' AS ok FROM ma) x""")


def _structured(v):
    own = v("filings").filter("vertical = 'go'").select(F.col("document_id").alias("go_id"), "k", *[x.alias(n) for n, x in st.go_sections(F.col("text")).items()])
    kind = "array<struct<para_no:string,text:string,legal_effect:string>>"
    paras = F.transform(st.go_paragraphs(F.col("orders")), lambda p: F.struct(p["para_no"].alias("para_no"), p["content"].alias("text"), F.lit(None).cast("string").alias("legal_effect")))
    empty = F.array().cast(kind)
    return own.select("go_id", F.when(F.col("k") % 3 == 0, "preamble text").alias("preamble"), F.when(F.col("k") % 3 == 0, paras).otherwise(empty).alias("orders"), F.when(F.col("k") % 3 == 1, paras).alias("paragraphs"), paras.alias("sections"))


register("tbl_02_go_clauses", lambda v: t.go_clauses(_structured(v)).groupBy("go_id", "clause_effect_type").agg(F.count("*").alias("n"), F.count_distinct("clause_id").alias("n_ids")), """
WITH g AS (SELECT document_id AS go_id, k FROM filings WHERE vertical = 'go') SELECT go_id, 'introduce' AS clause_effect_type, 5 AS n, 5 AS n_ids FROM g UNION ALL SELECT go_id, 'preamble', 1, 1 FROM g WHERE k % 3 = 0""")
register("tbl_03_functional_threads", lambda v: t.functional_threads(v("intake")), f"""
WITH d AS (SELECT doc_id AS go_id, CASE WHEN len({_SOME.format('policy_domains')}) > 0 THEN {_SOME.format('policy_domains')} ELSE ['general'] END AS l FROM intake ), u AS (SELECT go_id, unnest(l) AS thread_name, generate_subscripts(l, 1) AS i FROM d)
SELECT replace(replace(replace(replace(lower(thread_name), ' ', '_'), '(', ''), ')', ''), '/', '_') AS thread_id, go_id, thread_name, CASE WHEN i = 1 THEN 'primary' ELSE 'secondary' END AS role, 0.9::DOUBLE AS confidence, 'llm' AS source FROM u""")
register("tbl_04_act_links", lambda v: t.act_links(v("intake")), f"""
SELECT go_id, split_part(act, '|', 1) AS act_name, nullif(split_part(act, '|', 2), '') AS act_year, 'references' AS relation_type, 0.8::DOUBLE AS confidence FROM (SELECT doc_id AS go_id, unnest({_SOME.format('acts')}) AS act FROM intake ) x""")
register("tbl_05_beneficiaries", lambda v: t.beneficiaries(v("intake")), f"""
SELECT doc_id AS go_id, 'beneficiary_types' AS beneficiary_type, unnest({_SOME.format('beneficiary_types')}) AS beneficiary_name FROM intake UNION ALL SELECT doc_id, 'specific_orgs', unnest({_SOME.format('beneficiary_orgs')}) FROM intake
UNION ALL SELECT doc_id, 'general', unnest(beneficiaries) FROM intake WHERE len({_SOME.format('beneficiary_types')}) + len({_SOME.format('beneficiary_orgs')}) = 0""")
register("tbl_06_applicability", lambda v: t.applicability(v("intake")), f"SELECT doc_id AS go_id, 'district' AS region_type, unnest({_SOME.format('districts')}) AS region_name FROM intake UNION ALL SELECT doc_id, 'mandal', unnest({_SOME.format('mandals')}) FROM intake ")
register("tbl_07_authorities", lambda v: t.authorities(v("intake")), f"SELECT doc_id AS go_id, 'department' AS authority_role, unnest({_SOME.format('departments')}) AS authority_name FROM intake UNION ALL SELECT doc_id, 'signatory', unnest({_SOME.format('authorities')}) FROM intake ")
register("tbl_08_financials", lambda v: t.financials(v("intake")), f"SELECT doc_id AS go_id, CAST(generate_subscripts({_SOME.format('amounts')}, 1) - 1 AS INT) AS place, NULL::DOUBLE AS amount, {_SOME.format('budget_heads')}[1] AS budget_head FROM intake ")
register("tbl_08_effects", lambda v: t.effects(v("intake")), "SELECT go_id, 'date' AS effect_type, split_part(d, '|', 1) AS effect_value, split_part(d, '|', 2) AS effect_role FROM (SELECT doc_id AS go_id, unnest(dates) AS d FROM intake ) x")
register("tbl_09_documents", lambda v: t.documents(v("intake")), f"""
WITH {_MASTER} SELECT go_id AS document_id, ma.go_number AS title, CASE vertical WHEN 'judicial' THEN 'judgment' WHEN 'legal' THEN 'regulation' WHEN 'scheme' THEN 'policy' WHEN 'data' THEN 'report' ELSE 'go' END AS doc_type, coalesce({_SOME.format('policy_domains')}[1], 'general') AS domain,
coalesce({_SOME.format('departments')}[1], {_SOME.format('authorities')}[1], 'State Government') AS authority, 'AP' AS jurisdiction, ma.go_date AS date, 'active' AS status, raw_pdf_uri FROM ma JOIN intake i ON i.doc_id = go_id WHERE ma.go_number <> 'UNKNOWN' AND ma.go_date <> '1970-01-01'""")
register("tbl_10_chunks_from_clauses", lambda v: t.chunks_from_clauses(v("go_clauses").withColumns({"clause_effect_type": F.when(F.col("section_path") == "Rule 1", "preamble").otherwise("amend"), "clause_text": F.col("section_path")})), """
SELECT clause_id AS chunk_id, go_id AS document_id, CASE WHEN section_path = 'Rule 1' THEN 'paragraph' ELSE 'clause' END AS chunk_type, section_path AS text, NULL::INT AS page_start, NULL::INT AS page_end FROM go_clauses""")
register("tbl_11_domain_mapping", lambda v: t.domain_mapping(t.functional_threads(v("intake"))).withColumn("secondary_domains", F.array_join("secondary_domains", ",")), f"""
SELECT doc_id AS document_id, coalesce({_SOME.format('policy_domains')}[1], 'general') AS primary_domain, array_to_string({_SOME.format('policy_domains')}[2:], ',') AS secondary_domains, 0.9::DOUBLE AS confidence, 'llm' AS source FROM intake""")


def _judgments(v):
    sections = F.transform(st.judgment_sections(F.col("text")), lambda s: F.struct(s["section_type"].alias("section_type"), F.lit(None).cast("string").alias("title")))
    odd, none = F.col("k") % 2 == 1, F.lit(None)
    return v("filings").filter("vertical = 'judicial'").select(
        "document_id", F.when(odd, "High Court").alias("court"), F.when(F.col("k") % 3 == 0, "Tribunal").alias("meta_court"), none.cast("string").alias("meta_authority"), F.when(odd, 2).alias("bench_strength"), F.lit(1).alias("meta_bench_strength"),
        none.cast("string").alias("case_number"), F.col("k").cast("string").alias("meta_case_number"), none.cast("string").alias("binding_strength"), F.when(odd, "binding").alias("meta_binding_strength"), sections.alias("sections"),
        F.lit("allowed").alias("petition_result"), none.cast("string").alias("order_type"))


register("tbl_12_judgments_metadata", lambda v: t.judgments_metadata(_judgments(v)), """
SELECT document_id, CASE WHEN k % 2 = 1 THEN 'High Court' WHEN k % 3 = 0 THEN 'Tribunal' ELSE 'Unknown Court' END AS court, CASE WHEN k % 2 = 1 THEN 2 ELSE 1 END AS bench_strength, CAST(k AS VARCHAR) AS case_number,
regexp_matches(text, '(?i)(?:RATIO|RATIO DECIDENDI|REASONING|ANALYSIS|DISCUSSION|CONSIDERATION)[:\\s]') AS ratio_present, CASE WHEN k % 2 = 1 THEN 'binding' ELSE 'informative' END AS binding_strength, 'allowed' AS petition_result, NULL::VARCHAR AS order_type FROM filings WHERE vertical = 'judicial'""")
register("tbl_13_judgment_relations", lambda v: t.judgment_relations(v("relations")), """
SELECT source_id AS from_doc_id, target_id AS to_doc_id, CASE relation_type WHEN 'supersedes' THEN 'overrules' WHEN 'cancels' THEN 'overrules' WHEN 'amends' THEN 'followed' WHEN 'clarifies' THEN 'distinguished' ELSE relation_type END AS relation_type, confidence FROM relations""")
register("tbl_14_canonical_ids", lambda v: t.canonical_ids(v("canonical").withColumn("content", F.col("k").cast("string"))).select("k", "document_id", "needs_review"), r"""
WITH d AS (SELECT *, CASE k % 5 WHEN 0 THEN '2019-06-05' WHEN 1 THEN '2018-03-04' WHEN 2 THEN '2017-01-01' WHEN 3 THEN '2016-10-01' END AS iso FROM canonical ),
m AS (SELECT k, doc_type, iso, CASE doc_type WHEN 'go' THEN 'go_AP_' || regexp_replace(number, '[^A-Za-z0-9]', '', 'g') || '_' || iso
WHEN 'judgment' THEN 'judgment_' || CASE k % 4 WHEN 0 THEN 'SC' WHEN 1 THEN 'HC' WHEN 2 THEN 'LOKAD' ELSE 'UGC' END || '_' || (CASE WHEN case_type IS NOT NULL THEN 'WP' END) || '_' || trim(regexp_replace(regexp_replace(upper(number), '[^A-Za-z0-9]', '_', 'g'), '^NO', ''), '_') || '_' || (CASE WHEN case_year >= 1900 THEN case_year END) || '_' || iso
ELSE 'regulation_' || substr(regexp_replace(upper(authority), '[^A-Za-z0-9]', '', 'g'), 1, 20) || '_' || coalesce(CASE WHEN shortcode IS NOT NULL THEN 'FEE_POLICY' END, regexp_replace(upper(number), '[^A-Za-z0-9]', '_', 'g')) || '_' || iso END AS made FROM d)
SELECT k, coalesce(made, doc_type || '_unknown_' || coalesce(iso, 'unknown') || '_' || substr(sha256(CAST(k AS VARCHAR)), 1, 8)) AS document_id, made IS NULL AS needs_review FROM m""")
register("tbl_14_document_of_chunk", lambda v: v("papers").select("k", t.document_of_chunk(F.concat(F.when(F.col("k") % 3 == 0, "go_AP_").otherwise("x_"), F.col("k").cast("string"), F.lit("_2019-01-01_clause_"), F.lpad((F.col("k") % 100).cast("string"), 3, "0"))).alias("document_id")),
         "SELECT k, CASE WHEN k % 3 = 0 THEN 'go_AP_' || k || '_2019-01-01' END AS document_id FROM papers")


def _meta(v):
    chunks = v("go_clauses").select(F.col("clause_id").alias("chunk_id"), F.col("go_id").alias("document_id"), F.col("section_path").alias("text"))
    docs = v("docs").select("document_id", F.col("doc_type").alias("vertical"), F.when(F.col("doc_type") == "go", "education").alias("domain"))
    status = r.chain_flags(v("go_master"), v("relations")).select(F.col("go_id").alias("document_id"), "is_superseded", "is_most_recent")
    rows = t.chunk_metadata(chunks, docs, v("relations"), status)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("relation_types", "related_docs")})


register("tbl_15_chunk_metadata", _meta, """
WITH g AS (SELECT source_id, array_to_string(list_sort(list_distinct(list(relation_type))), ',') AS relation_types, array_to_string(list_sort(list_distinct(list(target_id)))[1:5], ',') AS related_docs FROM relations GROUP BY 1),
f AS (SELECT DISTINCT target_id FROM relations WHERE relation_type IN ('supersedes', 'amends'))
SELECT clause_id AS chunk_id, c.go_id AS document_id, d.doc_type AS vertical, 2 AS word_count, length(section_path) AS char_count, CASE WHEN g.source_id IS NULL THEN 'false' ELSE 'true' END AS has_relations, coalesce(relation_types, '') AS relation_types, coalesce(related_docs, '') AS related_docs,
CASE WHEN f.target_id IS NULL THEN 'false' ELSE 'true' END AS is_superseded, CASE WHEN f.target_id IS NULL THEN 'true' ELSE 'false' END AS is_most_recent, CASE WHEN d.doc_type = 'go' THEN 'education' ELSE 'general' END AS primary_domain
FROM go_clauses c LEFT JOIN docs d ON d.document_id = c.go_id LEFT JOIN g ON g.source_id = c.go_id LEFT JOIN f ON f.target_id = c.go_id""")


def _doc_meta(v):
    relations = v("overrulings")
    return t.document_metadata(v("intake"), relations, v("chunks")).withColumn("relation_types", F.array_join("relation_types", ","))


register("tbl_16_document_metadata", _doc_meta, f"""
WITH r AS (SELECT source_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(relation_type))), ',') AS t FROM overrulings GROUP BY 1), c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT doc_id, file_path, vertical, coalesce(c.n, 0) AS chunks_count, len({_SOME.format('departments')}) AS n_departments, len({_SOME.format('authorities')}) AS n_authorities, len({_SOME.format('acts')}) AS n_acts, len({_SOME.format('districts')}) AS n_districts, len(dates) AS n_dates,
coalesce(r.n, 0) AS relations_count, coalesce(r.t, '') AS relation_types, coalesce({_SOME.format('policy_domains')}[1], 'general') AS primary_domain FROM intake LEFT JOIN r ON source_id = doc_id LEFT JOIN c ON c.document_id = doc_id""")


def _sidecars(v):
    entity = lambda kind, value: F.array(F.struct(F.lit(kind).alias("type"), value.alias("value")), F.struct(F.lit("date").alias("type"), value.alias("value")))
    chunks = v("chunks").withColumn("metadata", F.create_map(F.lit("title"), F.lit("own")))
    own = v("chunks").filter("chunk_id LIKE '%1'").select("chunk_id", entity("act", F.col("chunk_id")).alias("entities"))
    docs = v("papers").filter("k % 2 = 0").select("document_id", entity("rule", F.col("document_id")).alias("entities"))
    rows = t.merge_sidecars(chunks, own, docs, v("papers").select("document_id", F.create_map(F.lit("title"), F.col("title"), F.lit("court"), F.col("court")).alias("extra")))
    return rows.select("chunk_id", "document_id", "entity_count", F.array_join("entity_types", ",").alias("entity_types"), F.col("metadata")["title"].alias("title"), F.col("metadata")["court"].alias("court"))


register("tbl_17_merge_sidecars", _sidecars, """
SELECT chunk_id, document_id, CASE WHEN chunk_id LIKE '%1' OR k % 2 = 0 THEN 2 ELSE 0 END AS entity_count, CASE WHEN chunk_id LIKE '%1' THEN 'act,date' WHEN k % 2 = 0 THEN 'date,rule' ELSE '' END AS entity_types, 'own' AS title, court FROM chunks JOIN papers USING (document_id)""")
register("tbl_18_enrich_results", lambda v: t.enrich_results(
    v("chunks").select("chunk_id", "document_id").withColumn("score", F.lit(1.0)), v("chunks").filter("chunk_id LIKE '%0'").select("chunk_id", "document_id", F.when(F.col("chunk_id").like("d1%"), "true").alias("is_table")),
    v("chunks").select("chunk_id", "document_id", F.md5("text").alias("table_text"))), """
SELECT chunk_id, document_id, 1.0::DOUBLE AS score, CASE WHEN chunk_id LIKE '%0' AND chunk_id LIKE 'd1%' THEN 'true' END AS is_table, CASE WHEN chunk_id LIKE '%0' AND chunk_id LIKE 'd1%' THEN md5(text) END AS table_text FROM chunks""")
