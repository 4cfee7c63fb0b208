"""Policy-document tables derived from the test tables, in SQL that Spark and DuckDB share.

Each view may use the test tables and the views before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.ranges import placed

TABLES = ("customer", "orders", "lineitem", "part", "events", "documents", "embeddings", "labels", "conversations")

VIEWS = {
    "go_master": """
SELECT 'go_' || CAST(o_orderkey AS STRING) AS go_id, CAST(o_orderkey % 4000 AS STRING) AS go_number,
       CAST(o_orderdate AS DATE) AS go_date, c_mktsegment AS department,
       CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'normative' WHEN o_orderpriority LIKE '3%' THEN 'administrative'
            WHEN o_orderpriority LIKE '4%' THEN 'financial' ELSE 'procedural' END AS go_type,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS effective_to_date, o_orderkey AS k
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "go_clauses": """
SELECT 'go_' || CAST(l_orderkey AS STRING) || '_' || CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS STRING) AS clause_id,
       'go_' || CAST(l_orderkey AS STRING) AS go_id, 'Rule ' || CAST(l_linenumber AS STRING) AS section_path,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS effective_to_date
FROM lineitem""",
    "relations": """
SELECT 'go_' || CAST(l_orderkey AS STRING) AS source_id, 'go_' || CAST(l_orderkey - 1 - l_partkey % 50 AS STRING) AS target_id,
       CASE WHEN l_linenumber = 1 THEN 'supersedes' WHEN l_linenumber = 2 THEN 'amends' WHEN l_linenumber = 3 THEN 'clarifies' WHEN l_linenumber = 5 THEN 'cancels'
            WHEN l_linenumber = 7 THEN 'overrules' ELSE 'references' END AS relation_type,
       CAST(0.5 + 5 * l_discount AS DOUBLE) AS confidence, CASE WHEN l_returnflag = 'R' THEN 'full' WHEN l_returnflag = 'A' THEN 'partial' ELSE 'unknown' END AS scope,
       CAST(l_linenumber AS STRING) AS section, l_partkey * 100000 + l_suppkey AS seq
FROM lineitem WHERE l_orderkey - 1 - l_partkey % 50 >= 0""",
    "threads": """
SELECT 't' || CAST(CASE WHEN o_custkey % 40 < 2 THEN 0 ELSE o_custkey % 40 END AS STRING) AS thread_id, 'go_' || CAST(o_orderkey AS STRING) AS go_id, 'primary' AS role, 0.9 AS confidence FROM orders
UNION ALL
SELECT 't' || CAST(100 + o_orderkey % 7 AS STRING), 'go_' || CAST(o_orderkey AS STRING), 'secondary', 0.6 FROM orders WHERE o_orderkey % 2 = 0""",
    "docs": """
SELECT 'go_' || CAST(o_orderkey AS STRING) AS document_id, 'Document ' || CAST(o_orderkey AS STRING) AS title,
       CASE o_orderkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'judgment' WHEN 2 THEN 'regulation' WHEN 3 THEN 'policy' ELSE 'report' END AS doc_type,
       CASE WHEN o_orderstatus = 'F' THEN 'superseded' ELSE 'active' END AS status, CAST(o_orderdate AS DATE) AS doc_date,
       CASE o_orderkey % 3 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'hc' ELSE 'Tribunal' END AS court,
       CASE o_orderkey % 4 WHEN 0 THEN 'binding' WHEN 1 THEN 'persuasive' WHEN 2 THEN 'non_binding' END AS binding_strength
FROM orders""",
    "hits": """
SELECT query_id, chunk_id, document_id, source, CAST(score AS DOUBLE) AS score, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS INT) AS rnk FROM (
    SELECT DISTINCT l_suppkey AS query_id, 'c' || CAST(l_partkey AS STRING) AS chunk_id, 'go_' || CAST(l_partkey AS STRING) AS document_id,
           CASE WHEN l_linenumber % 2 = 0 THEN 'lexical' ELSE 'vector' END AS source, max(l_extendedprice) OVER (PARTITION BY l_suppkey, l_partkey, l_linenumber % 2) AS score
    FROM lineitem) x) y""",
    "golden": """
SELECT l.doc_id % 50 AS query_id, 'd' || CAST(l.doc_id AS STRING) AS document_id, 'auth' || CAST(l.doc_id % 3 AS STRING) AS authority,
       CAST(2000 + l.doc_id % 20 AS STRING) || '-01-01' AS doc_date FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l""",
    "answered": """
SELECT l.doc_id % 50 AS query_id, 'd' || CAST(CASE WHEN l.doc_id % 7 = 0 THEN l.doc_id + 1000000 ELSE l.doc_id END AS STRING) AS document_id,
       'auth' || CAST(CASE WHEN l.doc_id % 5 = 0 THEN 9 ELSE l.doc_id % 3 END AS STRING) AS authority,
       CAST(2000 + (CASE WHEN l.doc_id % 5 = 1 THEN l.doc_id + 1 ELSE l.doc_id END) % 20 AS STRING) || '-06-01' AS doc_date
FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 11 <> 0) l""",
    "traces": """
SELECT event_id AS request_id, ts, event_type AS pipeline_used, CAST(value * 100 AS DOUBLE) AS latency_ms, event_id % 9 = 0 AS fallback_used, event_type = 'error' AS failed FROM events""",
    "dirty": """
SELECT doc_id, 'educa-' || chr(10) || ' tion <b>x</b> [Image: a] [chart: b] G.O.Ms.No.12 GO RT No 7 sec.12 §4 12/05/2024 1.2.2023 Govemment 0rder' || chr(10) || '- 3 -' || chr(10) || 'Page 4' || chr(10) || '3 of 9' || chr(10)
       || text || chr(10) || '-- Page 3 --' || chr(10) || ' ##tail' || chr(10) || 'last©®' AS text
FROM documents""",
    "letters": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'In supersession of G.O.Ms.No. 12 the transfers and postings, transfer by transfer, are cancelled. '
            WHEN 1 THEN 'This order amends Rule 5(a) and Section 12A, dated 12-05-2024. ' WHEN 2 THEN 'Promotions and pay scale arrears vide GO No 77! '
            WHEN 3 THEN 'Pension under Rules, 2023 and § 4 was set on 3rd March 2021. ' WHEN 4 THEN 'Sec 9B clarifies leave from January 5, 2020? ' ELSE 'Government Order No. 8 ' END
       || text || CASE WHEN doc_id % 4 = 1 THEN ' Recruitment and suspension are in 8B.' ELSE ' It cancels the rest.' END AS text
FROM documents""",
    "offices": """
SELECT go_id, CASE WHEN k % 11 = 0 THEN 'unknown' WHEN k % 11 <> 1 THEN go_type END AS go_type,
       CASE k % 9 WHEN 0 THEN 'School Education' WHEN 1 THEN 'Higher education' WHEN 2 THEN ' social justice' WHEN 3 THEN 'Law and Finance' WHEN 4 THEN 'finance'
            WHEN 5 THEN 'Health' WHEN 6 THEN 'Revenue' WHEN 7 THEN 'General Administration' ELSE department END AS department
FROM go_master""",
    "risks": """
SELECT query_id, CASE a WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' END AS expected,
       CASE b WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'odd' END AS actual
FROM (SELECT doc_id AS query_id, doc_id % 6 AS a, (doc_id + length(text)) % 5 AS b FROM documents) x""",
    "papers": """
SELECT doc_id AS k, 'd' || CAST(doc_id AS STRING) AS document_id, 'Paper ' || CAST(doc_id AS STRING) AS title,
       CASE doc_id % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'judgment' WHEN 2 THEN 'regulation' WHEN 3 THEN 'policy' ELSE 'report' END AS doc_type,
       CASE WHEN doc_id % 6 = 0 THEN 'superseded' ELSE 'active' END AS status,
       CAST(CAST(2000 + doc_id % 20 AS STRING) || '-' || lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0') || '-15' AS DATE) AS doc_date,
       CASE doc_id % 4 WHEN 0 THEN 'education' WHEN 1 THEN 'judicial' WHEN 2 THEN 'constitution' ELSE 'finance' END AS primary_domain,
       CASE WHEN doc_id % 3 = 0 THEN 'AP' ELSE 'central' END AS jurisdiction,
       CASE doc_id % 3 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'hc' ELSE 'Tribunal' END AS court,
       CASE doc_id % 4 WHEN 0 THEN 'binding' WHEN 1 THEN 'persuasive' WHEN 2 THEN 'non_binding' END AS binding_strength, text
FROM documents WHERE text IS NOT NULL""",
    "chunks": """
SELECT document_id || '_0' AS chunk_id, document_id, substr(text, 1, 600) AS text FROM papers
UNION ALL
SELECT document_id || '_1', document_id, substr(text, 601, 600) FROM papers WHERE length(text) > 600""",
    "asks": """
SELECT k AS query_id, substr(text, 1, 80) AS text, split(CASE k % 3 WHEN 0 THEN 'education,judicial' WHEN 1 THEN 'constitution' ELSE 'finance,education,labor' END, ',') AS domains,
       CASE WHEN k % 75 = 0 THEN DATE '2008-01-01' END AS since_date, CASE WHEN k % 50 = 0 THEN 'AP' END AS jurisdiction,
       'P' || CAST(k % 6 AS STRING) AS pipeline, split(CASE k % 3 WHEN 0 THEN 'go,judicial,go' WHEN 1 THEN 'unknown' ELSE 'data,legal' END, ',') AS verticals
FROM papers WHERE k % 25 = 0""",
    "vectors": """
SELECT 'd' || CAST(vec_id AS STRING) || '_0' AS chunk_id, 'd' || CAST(vec_id AS STRING) AS document_id, embedding AS vector FROM embeddings""",
    "overrulings": """
SELECT 'd' || CAST(doc_id AS STRING) AS source_id, 'd' || CAST(doc_id + 7 AS STRING) AS target_id, CASE WHEN doc_id % 9 = 0 THEN 'overrules' ELSE 'references' END AS relation_type
FROM documents""",
    "filings": """
SELECT doc_id AS k, 'AP_GO_' || CAST(doc_id AS STRING) AS document_id, CASE doc_id % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'judicial' WHEN 2 THEN 'legal' WHEN 3 THEN 'scheme' ELSE 'data' END AS vertical,
       CASE doc_id % 7 WHEN 0 THEN 'go_order_memo.pdf' WHEN 1 THEN 'High Court judgment.pdf' WHEN 2 THEN 'budget-report.pdf' ELSE 'file.txt' END AS file_name,
       CASE doc_id % 5 WHEN 0 THEN 'GOVERNMENT OF ANDHRA PRADESH' || chr(10) || 'G.O.Ms.No. ' || CAST(doc_id % 97 + 1 AS STRING) || ' Dated: 12-05-' || CAST(2000 + doc_id % 20 AS STRING) || '' || chr(10) || 'Department of School Education, Amaravati' || chr(10) || 'Read: G.O.Ms.No. 7 and G.O.Rt.No. 15' || chr(10) || 'ORDERS:' || chr(10) || '1. In supersession of G.O.Ms.No. ' || CAST(doc_id % 50 AS STRING) || ' this order supersedes the earlier orders issued subject to audit. (a) teachers may apply under 12; (b) schools must comply, (ii) none' || chr(10) || '2. This order partially amends 24 and amends Rule 5 vide G.O.Ms.No. 77. Provided that the fee is paid. Subject to review it holds' || chr(10) || '3) G.O.Ms.No. 31 is hereby cancelled and 44 are hereby rescinded. It comes into force with effect from 01-06-2019 and 8 B' || chr(10) || '4(a) ' || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 300) || '' || chr(10) || '(5) The department amends G.O.MS.No.' || CAST(doc_id % 50 AS STRING) || ' para 4 and clarifies G.O.MS.No.9. Copy to all as per 66' || chr(10) || 'ANNEXURE I' || chr(10) || 'a | b | c' || chr(10) || 'ANNEXURE-II' || chr(10) || 'plain words'
            WHEN 1 THEN 'IN THE HIGH COURT OF ANDHRA PRADESH' || chr(10) || 'Writ Petition No. ' || CAST(doc_id % 97 + 1 AS STRING) || ' of ' || CAST(2000 + doc_id % 20 AS STRING) || '' || chr(10) || 'Sharma versus State of Andhra Pradesh' || chr(10) || 'Decided on 03-04-' || CAST(2000 + doc_id % 20 AS STRING) || ' before Justice A. Rao and Justice B. Das' || chr(10) || 'HEADNOTE' || chr(10) || '1. ' || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 300) || '' || chr(10) || 'FACTS OF THE CASE' || chr(10) || 'The case began under 44. This court overrules the decision in Mehta v. Rao today.' || chr(10) || 'ISSUES' || chr(10) || 'Whether the rule stands.' || chr(10) || 'ARGUMENTS' || chr(10) || 'Counsel spoke. The judgment in Gupta v. Sen was overruled later.' || chr(10) || 'RATIO DECIDENDI' || chr(10) || 'The right holds.' || chr(10) || 'JUDGMENT' || chr(10) || 'The writ petition is allowed. No costs.'
            WHEN 2 THEN 'THE ANDHRA PRADESH EDUCATION ACT, ' || CAST(2000 + doc_id % 20 AS STRING) || '' || chr(10) || 'ACT No. ' || CAST(doc_id % 97 + 1 AS STRING) || ' of ' || CAST(2000 + doc_id % 20 AS STRING) || '' || chr(10) || 'PART I — PRELIMINARY' || chr(10) || 'CHAPTER I — GENERAL' || chr(10) || 'Section 1. Short title — This Act may be called the Education Act. (a) one (b) two' || chr(10) || 'Section 2. Definitions — In this Act unless the context requires otherwise, as per 19.' || chr(10) || 'CHAPTER II — SCHOOLS' || chr(10) || 'Section ' || CAST(doc_id % 50 AS STRING) || '. Schools — ' || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 300) || '' || chr(10) || 'Rule 4. Fees — The fee shall be paid; supersedes 9.' || chr(10) || 'SCHEDULE I' || chr(10) || 'list'
            WHEN 3 THEN 'AMMA VODI SCHEME' || chr(10) || 'Overview: ' || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 300) || '' || chr(10) || 'Objectives: to help' || chr(10) || 'Eligibility: the following' || chr(10) || '- income below limit' || chr(10) || '- enrolled in school' || chr(10) || 'Benefits: the following' || chr(10) || '* Rs. 15,000 a year' || chr(10) || 'How to apply: at the office' || chr(10) || 'Implementation: by departments, cancels ' || CAST(doc_id % 97 + 1 AS STRING) || ''
            ELSE 'ANNUAL REPORT ' || CAST(2000 + doc_id % 20 AS STRING) || '' || chr(10) || 'Budget Estimates for the financial year ' || CAST(2000 + doc_id % 20 AS STRING) || '-' || CAST(2000 + doc_id % 20 AS STRING) || '' || chr(10) || 'Department of Finance, Amaravati' || chr(10) || 'Table 1: Enrolment' || chr(10) || 'School | Boys | Girls' || chr(10) || 'A | 10 | 12' || chr(10) || 'B | 9 | 11' || chr(10) || '' || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 300) || '' || chr(10) || 'Figure 2: Growth' END AS text
FROM documents WHERE text IS NOT NULL""",
    "suits": """
SELECT doc_id AS k, 'S_' || CAST(doc_id AS STRING) AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'No parties here.' ELSE 'IN THE HIGH COURT' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'BETWEEN:' || chr(10) ELSE 'Between ' END || 'Party ' || CAST(doc_id % 97 AS STRING) || ' and Sons' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'of Guntur' ELSE '' END || chr(10)
       || CASE WHEN doc_id % 4 = 0 THEN '  and' ELSE 'AND' END || chr(10) || 'The State, No. ' || CAST(doc_id % 50 AS STRING) || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '(12) others' || chr(10) ELSE '' END || 'JUDGMENT' || chr(10) || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 200) END AS text
FROM documents WHERE text IS NOT NULL""",
    "surveys": """
SELECT doc_id AS k, 'R_' || CAST(doc_id AS STRING) AS document_id, 'ANNUAL SURVEY' || chr(10) || 'Chapter 1: Pupils' || chr(10) || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 300) || chr(10) || 'Figure 1: Growth of ' || CAST(doc_id % 97 AS STRING) || chr(10)
       || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'It grew.' || chr(10) END || 'Chart 2.1. Shares by place' || chr(10) || 'Half of it.' || chr(10) || 'Table 3: Enrolment' || chr(10) || 'A | 1 | 2' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Section 2.1 Results' || chr(10) || 'They rose.' || chr(10) ELSE '' END
       || CASE WHEN doc_id % 5 = 0 THEN 'CHAPTER 4' || chr(10) || 'Outlook' || chr(10) ELSE '' END || 'Graph 7' || chr(10) || 'Last of all ' || substr(replace(replace(text, chr(10), ' '), chr(13), ' '), 301, 900) AS text
FROM documents WHERE text IS NOT NULL""",
    "named_relations": """
SELECT 'go_' || CAST(doc_id AS STRING) AS source_id, CASE doc_id % 4 WHEN 0 THEN 'case of Mehta v. Rao' WHEN 1 THEN 'go_' || CAST(doc_id + 1 AS STRING) WHEN 2 THEN 'order ' || CAST(doc_id % 100 AS STRING) END AS target_id,
       CASE doc_id % 3 WHEN 0 THEN 'overrules' ELSE 'references' END AS relation_type FROM documents""",
    "topics": """
SELECT go_id, CASE WHEN k % 17 = 0 THEN NULL ELSE department END AS department, go_date, k AS seq,
       'policy' || CAST(k % 400 AS STRING) || ' of grants' || CAST(k % 250 AS STRING) || ' and school' || CAST(k % 40 AS STRING) AS subject FROM go_master""",
    "rings": """
SELECT DISTINCT k AS src, k - k % 20 + (k * 7 + 3) % 20 AS dst FROM go_master WHERE k % 3 <> 0
UNION
SELECT k, k - k % 20 + (k + 1) % 20 FROM go_master WHERE k % 11 = 0""",
    "books": """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'section' ELSE 'rule' END AS ref_type, CAST(p_partkey % 700 AS STRING) AS number, CAST(NULL AS STRING) AS year, 'part_' || CAST(p_partkey AS STRING) AS canonical_id,
       CASE p_partkey % 4 WHEN 0 THEN 'RTE Rules' WHEN 1 THEN 'Right to Education Act' WHEN 2 THEN 'School Code' ELSE 'RTE Education Act' END AS source_document, p_partkey AS seq FROM part
UNION ALL
SELECT 'go', go_number, year, canonical_id, 'order', CAST(row_number() OVER (ORDER BY go_number, year) + 1000000 AS BIGINT) FROM
(SELECT go_number, CAST(year(go_date) AS STRING) AS year, min(go_id) AS canonical_id FROM go_master WHERE k % 11 <> 0 GROUP BY 1, 2) x""",
    "mentions": """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rel_id,
       CASE l_linenumber WHEN 1 THEN 'Section ' || CAST(l_partkey % 800 AS STRING) || '(2)' WHEN 2 THEN 'Rule ' || CAST(l_partkey % 800 AS STRING) WHEN 3 THEN 'G.O.Ms.No. ' || CAST(l_orderkey % 4500 AS STRING) WHEN 4 THEN 'the order' ELSE 'G.O. ' END AS raw_text,
       CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber > 4 THEN CAST(l_orderkey % 4000 AS STRING) END AS go_number, CASE WHEN l_linenumber = 6 THEN CAST(year(l_shipdate) AS STRING) END AS year,
       CAST(0.5 + 5 * l_discount AS DOUBLE) AS confidence, CASE l_suppkey % 3 WHEN 0 THEN 'under the RTE norms' WHEN 1 THEN 'as the Right to Education Act says' END AS context FROM lineitem""",
    "intake": """
SELECT k, document_id AS doc_id, 'file:/' || document_id || '.pdf' AS file_path, CASE k % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'judicial' WHEN 2 THEN 'legal' WHEN 3 THEN 'scheme' ELSE 'data' END AS vertical,
       CASE WHEN k % 7 <> 0 THEN CAST(k % 100 AS STRING) END AS go_number, CASE k % 6 WHEN 0 THEN '5-6-2019' WHEN 1 THEN '2018-03-04' WHEN 2 THEN '01.02.2017' WHEN 3 THEN '9/10/2016' WHEN 4 THEN '02-2025' ELSE 'soon' END AS go_date,
       CASE WHEN k % 4 = 0 THEN 'normative' END AS go_archetype, split(CASE k % 3 WHEN 0 THEN 'Fee (State)/Aid,Transfer' WHEN 1 THEN 'Leave Rules' ELSE '' END, ',') AS policy_domains,
       split(CASE WHEN k % 2 = 0 THEN 'School Education,Finance' ELSE '' END, ',') AS departments, split(CASE WHEN k % 3 = 0 THEN 'Joint Secretary' ELSE '' END, ',') AS authorities,
       split(CASE WHEN k % 4 = 1 THEN 'Education Act|1982,Fee Act|' ELSE '' END, ',') AS acts, split(CASE WHEN k % 4 = 2 THEN 'teachers,students' ELSE '' END, ',') AS beneficiary_types, split(CASE WHEN k % 8 = 2 THEN 'Board' ELSE '' END, ',') AS beneficiary_orgs,
       split('all,some', ',') AS beneficiaries, split(CASE WHEN k % 5 = 0 THEN 'Guntur,Krishna' ELSE '' END, ',') AS districts, split(CASE WHEN k % 10 = 0 THEN 'M1' ELSE '' END, ',') AS mandals, split('', ',') AS villages,
       split(CASE WHEN k % 6 = 1 THEN '10 lakhs,2 crores' ELSE '' END, ',') AS amounts, split(CASE WHEN k % 12 = 1 THEN '2202' ELSE '' END, ',') AS budget_heads, split('2019-05-06|issue_date,2019-06-01|effective_from', ',') AS dates
FROM papers""",
    "canonical": """
SELECT k, CASE k % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'judgment' ELSE 'regulation' END AS doc_type, CASE WHEN k % 17 <> 0 THEN 'No. ' || CAST(k AS STRING) || '/A' END AS number,
       CASE k % 5 WHEN 0 THEN '5-6-2019' WHEN 1 THEN '2018-03-04' WHEN 2 THEN '2017' WHEN 3 THEN '2016-10' ELSE 'never' END AS dated, CASE k % 4 WHEN 0 THEN 'Supreme Court of India' WHEN 1 THEN 'High Court of AP' WHEN 2 THEN 'Lok Adalat Bench' ELSE 'U.G.C.' END AS authority,
       CASE WHEN k % 11 <> 0 THEN 'W.P.' END AS case_type, CAST(CASE WHEN k % 13 = 0 THEN 1800 ELSE 2010 END AS INT) AS case_year, CASE WHEN k % 2 = 0 THEN 'fee policy' END AS shortcode FROM papers""",
}


def with_sql(select: str) -> str:
    """The select behind common table expressions of the views it needs."""
    need, rest = [], [select]
    while rest:
        text = rest.pop()
        for name, body in VIEWS.items():
            if name not in need and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                need.append(name)
                rest.append(body)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in need)
    text = select.strip()
    if not ctes:
        return text
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {text[14:]}"
    return f"WITH {ctes}, {text[4:]}" if text.startswith("WITH ") else f"WITH {ctes} {text}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view (or test table) as a frame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS[name]
    tables = {t: view(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN) {t}\b", body)}
    if name == "mentions":
        # The same numbers as the view's window over all rows, without its single task.
        window = re.search(r"row_number\(\) OVER \(ORDER BY ([\w, ]+)\)", body)
        rows = tables["lineitem"]
        tables["lineitem"] = placed(rows.select(*[c for c in rows.columns if re.search(rf"\b{c}\b", body)]), window[1].split(", "))
        body = body.replace(window[0], "place")
    for t in tables:
        body = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", body)
    return spark.sql(body, **tables)
