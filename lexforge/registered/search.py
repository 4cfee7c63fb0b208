"""Registered retrieval and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as t
from ..operators import search as s
from ..operators.vector_index import open_search, vector_index
from ..plans.registering import Register
from ..sources.staging import new_folder

register = Register()

_HITS = r"""
WITH q AS (SELECT query_id, domains, since_date, jurisdiction AS j, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '\S+'), lambda x: length(x) > 3)[1:5])) AS term FROM asks),
h AS (SELECT DISTINCT query_id, chunk_id, c.document_id, doc_date FROM q JOIN chunks c ON contains(lower(c.text), term) JOIN papers p ON p.document_id = c.document_id
      WHERE status = 'active' AND list_contains(domains, primary_domain) AND (since_date IS NULL OR doc_date >= since_date) AND (j IS NULL OR jurisdiction = j)),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_date DESC NULLS LAST, chunk_id) AS rnk FROM h) x WHERE rnk <= 40)
"""


def _lexical(v):
    return s.lexical_search(v("asks"), v("chunks"), v("papers"), 20)


def _vectors(v):
    return v("vectors").filter("CAST(substr(document_id, 2) AS INT) % 25 = 0").select(F.expr("CAST(substr(document_id, 2) AS BIGINT)").alias("query_id"), "vector")


_VECTOR = """
qv AS (SELECT CAST(substr(document_id, 2) AS BIGINT) AS query_id, CAST(vector AS DOUBLE[]) AS q FROM vectors WHERE CAST(substr(document_id, 2) AS INT) % 25 = 0),
pv AS (SELECT c.query_id, v.chunk_id, v.document_id, round(list_cosine_similarity(q, CAST(vector AS DOUBLE[])), 9) AS score FROM (SELECT DISTINCT query_id, document_id FROM {}) c JOIN vectors v USING (document_id) JOIN qv USING (query_id)),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk FROM pv) x WHERE rnk <= {})
"""

register("ret_01_lexical_search", lambda v: _lexical(v).withColumn("score", F.round("score", 9)),
         _HITS + "SELECT query_id, chunk_id, document_id, 'lexical' AS source, round(1.0::DOUBLE / rnk, 9) AS score, rnk FROM lex")
register("ret_02_clause_search", lambda v: s.clause_search(v("asks"), v("chunks"), 20).withColumn("score", F.round("score", 9)), r"""
WITH q AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '\S+')[1:5], lambda x: length(x) > 3))) AS term FROM asks),
h AS (SELECT DISTINCT query_id, chunk_id, document_id FROM q JOIN chunks c ON contains(lower(c.text), term))
SELECT query_id, chunk_id, document_id, rnk, round(1.0::DOUBLE / rnk, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rnk FROM h) x WHERE rnk <= 20""")
register("ret_03_vertical_domains", lambda v: v("asks").select("query_id", F.array_join(s.vertical_domains(F.col("verticals")), ",").alias("domains")), """
WITH u AS (SELECT query_id, unnest(verticals) AS vertical, generate_subscripts(verticals, 1) AS i FROM asks),
m AS (SELECT query_id, CASE vertical WHEN 'go' THEN 'education' WHEN 'judicial' THEN 'judicial' WHEN 'legal' THEN 'constitution' WHEN 'scheme' THEN 'state_governance' WHEN 'data' THEN 'finance' END AS domain, min(i) AS i FROM u GROUP BY 1, 2)
SELECT query_id, coalesce(string_agg(domain, ',' ORDER BY i), 'education') AS domains FROM m GROUP BY 1""")
register("ret_05_vector_search", lambda v: s.vector_search(_vectors(v), v("vectors"), _lexical(v), 20).select("query_id", "chunk_id", "document_id", "score", "rnk"),
         _HITS + "," + _VECTOR.format("lex", 20) + "SELECT query_id, chunk_id, document_id, score, rnk FROM vec")

_HYBRID = _HITS + """,
lx AS (SELECT * FROM lex WHERE document_id NOT IN (SELECT target_id FROM overrulings WHERE relation_type = 'overrules')),""" + _VECTOR.format("lx", 40) + """,
fz AS (SELECT query_id, chunk_id, document_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS fused FROM (SELECT query_id, chunk_id, document_id, rnk FROM lx UNION ALL SELECT query_id, chunk_id, document_id, rnk FROM vec) x GROUP BY 1, 2, 3),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS r FROM fz) x WHERE r <= 40),
bo AS (SELECT query_id, chunk_id, document_id, doc_type, round(fused * CASE court WHEN 'Supreme Court' THEN 1.5 WHEN 'hc' THEN 1.2 ELSE 1.0 END::DOUBLE * CASE binding_strength WHEN 'binding' THEN 1.3 WHEN 'persuasive' THEN 1.1 ELSE 1.0 END::DOUBLE, 6) AS boosted FROM fk LEFT JOIN papers USING (document_id)),
bk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, chunk_id) AS rank FROM bo)
"""


def _hybrid(v, priorities=None):
    return s.hybrid_retrieve(v("asks"), v("chunks"), v("papers"), v("vectors"), _vectors(v), v("overrulings"), 20, priorities)


register("ret_09_hybrid_retrieve", _hybrid, _HYBRID + "SELECT query_id, chunk_id, boosted, rank FROM bk WHERE rank <= 20")
register("ret_09_hybrid_by_priority", lambda v: _hybrid(v, ["judgment", "go"]), _HYBRID + """
SELECT query_id, chunk_id, doc_type, rank FROM (SELECT query_id, chunk_id, doc_type, row_number() OVER (PARTITION BY query_id ORDER BY CASE doc_type WHEN 'judgment' THEN 1 WHEN 'go' THEN 2 ELSE 999 END, boosted DESC, chunk_id) AS rank
FROM bk WHERE rank <= 40) x WHERE rank <= 20""")
register("ret_15_route_pipelines", lambda v: s.route_pipelines(v("asks").select("query_id", "pipeline", "domains")).select(
    "query_id", "pipeline", F.array_join("verticals", ",").alias("verticals"), "pipeline_name", "requires_risk", "requires_timeline", "requires_comparison", "max_domains", "top_k", "max_latency_ms"), """
WITH c(pipeline, pipeline_name, requires_risk, requires_timeline, requires_comparison, max_domains, top_k, max_latency_ms) AS (VALUES ('P1', 'Factual/Clarification', false, false, false, 1, 15, 2000),
('P2', 'Comparative/Evolution', false, true, true, 1, 30, 3000), ('P3', 'Risk/Constitutionality', true, false, false, 2, 25, 3500), ('P4', 'Multi-Domain Impact', true, true, true, 3, 40, 4000), ('P5', 'Judicial Constraint', true, false, false, 2, 30, 4000)),
u AS (SELECT query_id, pipeline, unnest(domains) AS domain FROM asks),
w AS (SELECT query_id, pipeline, unnest(CASE domain WHEN 'education' THEN ['go', 'legal', 'scheme'] WHEN 'agriculture' THEN ['go', 'scheme'] WHEN 'constitution' THEN ['legal', 'judicial'] WHEN 'judicial' THEN ['judicial'] ELSE ['go', 'legal'] END) AS vertical FROM u),
g AS (SELECT query_id, pipeline, string_agg(DISTINCT vertical, ',' ORDER BY vertical) AS verticals FROM w GROUP BY 1, 2)
SELECT query_id, pipeline, verticals, pipeline_name, requires_risk, requires_timeline, requires_comparison, max_domains, top_k, max_latency_ms FROM g LEFT JOIN c USING (pipeline)""")


def _overall(v):
    rate = lambda col: t.match_rate(v("golden"), v("answered"), *col)
    authority = rate((F.col("e_authority"), F.col("a_authority")))
    dates = rate((F.substring("e_date", 1, 4), F.substring("a_date", 1, 4)))
    risks = t.risk_detection(v("risks").select("query_id", F.col("expected").alias("risk_level")), v("risks").select("query_id", F.col("actual").alias("risk_level")))
    claims = v("golden").select((F.col("query_id") % 9 + 1).alias("n_claims"), (F.col("query_id") % 4).alias("n_supported")).withColumn("n_supported", F.least("n_claims", "n_supported"))
    return t.overall_score(t.citation_accuracy(v("golden"), v("answered")), authority, dates, claims, risks)


register("evl_06_overall_score", _overall, """
WITH e AS (SELECT DISTINCT * FROM golden), a AS (SELECT DISTINCT * FROM answered),
m AS (SELECT count(*) FILTER (e.authority = a.authority) AS auth, count(*) FILTER (left(e.doc_date, 4) = left(a.doc_date, 4)) AS years, count(*) AS both_n FROM e JOIN a ON e.query_id = a.query_id AND e.document_id = a.document_id),
c AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1), o AS (SELECT query_id, count(*) AS n FROM a WHERE query_id NOT IN (SELECT query_id FROM e) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(n), 0) FROM c) + (SELECT coalesce(sum(n), 0) FROM o) AS total),
k AS (SELECT sum(query_id % 9 + 1) AS claims, sum(least(query_id % 9 + 1, query_id % 4)) AS good FROM golden),
r AS (SELECT count(*) FILTER (expected = actual) / count(*) AS acc FROM risks WHERE expected IS NOT NULL)
SELECT round(both_n / total, 9) AS citation_accuracy, round(auth / both_n, 9) AS authority_correctness, round(years / both_n, 9) AS temporal_correctness, round(1 - good / claims, 9) AS hallucination_rate, round(acc, 9) AS risk_detection,
round(0.3 * round(both_n / total, 9) + 0.25 * round(auth / both_n, 9) + 0.15 * round(years / both_n, 9) + 0.2 * (1 - round(1 - good / claims, 9)) + 0.1 * round(acc, 9), 6) AS overall_score FROM m, n, k, r""")


def _results(v):
    """Results by query, saved as JSON lines and read back."""
    runs = v("golden").select("query_id").distinct().withColumn("error", F.when(F.col("query_id") % 7 == 3, "timeout"))
    rows = t.evaluation_results(runs, v("golden"), v("answered"))
    path = new_folder(rows.sparkSession, "evaluation")
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


_RESULTS = """
WITH e AS (SELECT DISTINCT query_id, document_id FROM golden), a AS (SELECT DISTINCT query_id, document_id FROM answered), g AS (SELECT DISTINCT query_id FROM golden),
n AS (SELECT g.query_id, (SELECT count(*) FROM e WHERE e.query_id = g.query_id) AS n_e, (SELECT count(*) FROM a WHERE a.query_id = g.query_id) AS n_a, (SELECT count(*) FROM e JOIN a ON e.query_id = a.query_id AND e.document_id = a.document_id WHERE e.query_id = g.query_id) AS n_both FROM g),
r AS (SELECT query_id, query_id % 7 <> 3 AS success, CASE WHEN query_id % 7 = 3 THEN 'timeout' END AS error, CASE WHEN query_id % 7 <> 3 THEN n_both END AS correct, CASE WHEN query_id % 7 <> 3 THEN n_a - n_both END AS incorrect,
      CASE WHEN query_id % 7 <> 3 THEN n_e - n_both END AS missing, CASE WHEN query_id % 7 <> 3 THEN round(n_both / n_e, 9) END AS accuracy FROM n)
"""
register("evl_06_query_results", _results, _RESULTS + "SELECT * FROM r")
register("evl_06_counts", lambda v: t.evaluation_counts(_results(v)), _RESULTS + """
SELECT count(*) AS total_queries, count(*) FILTER (success) AS successful_queries, count(*) FILTER (NOT success) AS failed_queries, round(sum(correct) / sum(correct + missing), 9) AS recall FROM r""")


def _dated(v):
    """Vectors with the year and place of their document, where it is known."""
    return v("vectors").join(v("papers").select("document_id", F.year("doc_date").alias("year"), "jurisdiction"), "document_id", "left")


def _open(v, share):
    asked = _vectors(v).withColumns({"year": F.when(F.col("query_id") % 2 == 0, (2000 + F.col("query_id") % 20).cast("int")), "jurisdiction": F.when(F.col("query_id") % 3 == 0, "AP")})
    return open_search(asked, vector_index(_dated(v)), 20, share).select("query_id", "chunk_id", "document_id", "score", "rnk")


register("ret_05_open_search", lambda v: _open(v, 1.0), """
WITH qv AS (SELECT CAST(substr(document_id, 2) AS BIGINT) AS query_id, CAST(vector AS DOUBLE[]) AS q FROM vectors WHERE CAST(substr(document_id, 2) AS INT) % 25 = 0),
dv AS (SELECT chunk_id, v.document_id, CAST(vector AS DOUBLE[]) AS x, year(doc_date) AS y, jurisdiction FROM vectors v LEFT JOIN papers p ON p.document_id = v.document_id),
pv AS (SELECT query_id, chunk_id, document_id, round(list_cosine_similarity(q, x), 9) AS score FROM qv JOIN dv ON (query_id % 2 <> 0 OR y = 2000 + query_id % 20) AND (query_id % 3 <> 0 OR jurisdiction = 'AP'))
SELECT query_id, chunk_id, document_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk FROM pv) x WHERE rnk <= 20""")
register("ret_05_listed_search", lambda v: open_search(_vectors(v), vector_index(v("vectors")), 20).select("query_id", "chunk_id", "document_id", "score", "rnk"))
