"""Registered queries of layered and routed retrieval, with k by query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routed as r
from ..operators import search as s
from ..plans.registering import Register
from .search import _HITS, _VECTOR, _lexical, _vectors

register = Register()

#: Hits of runs (query_id, base_id, text, domains, since_date, j, top_k, prior), ranked.
_RANKED = r"""
q AS (SELECT query_id, domains, since_date, j, top_k, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '\S+'), lambda x: length(x) > 3)[1:5])) AS term FROM runs),
h AS (SELECT DISTINCT query_id, top_k, chunk_id, c.document_id, doc_date FROM q JOIN chunks c ON contains(lower(c.text), term) JOIN papers p ON p.document_id = c.document_id
      WHERE status = 'active' AND list_contains(domains, primary_domain) AND (since_date IS NULL OR doc_date >= since_date) AND (j IS NULL OR jurisdiction = j)),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_date DESC NULLS LAST, chunk_id) AS rnk FROM h) x
       WHERE rnk <= 2 * top_k AND document_id NOT IN (SELECT target_id FROM overrulings WHERE relation_type = 'overrules')),
pv AS (SELECT c.query_id, c.top_k, v.chunk_id, v.document_id, round(list_cosine_similarity(CAST(o.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 9) AS score
       FROM (SELECT DISTINCT query_id, top_k, document_id FROM lx) c JOIN runs USING (query_id) JOIN vectors v ON v.document_id = c.document_id JOIN vectors o ON o.document_id = 'd' || CAST(base_id AS VARCHAR)),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk FROM pv) x WHERE rnk <= 2 * top_k),
fz AS (SELECT query_id, top_k, chunk_id, document_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS fused FROM (SELECT query_id, top_k, chunk_id, document_id, rnk FROM lx UNION ALL SELECT query_id, top_k, chunk_id, document_id, rnk FROM vec) x GROUP BY 1, 2, 3, 4),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS r FROM fz) x WHERE r <= 2 * top_k),
bo AS (SELECT query_id, top_k, chunk_id, document_id, doc_type, round(fused * CASE court WHEN 'Supreme Court' THEN 1.5 WHEN 'hc' THEN 1.2 ELSE 1.0 END::DOUBLE * CASE binding_strength WHEN 'binding' THEN 1.3 WHEN 'persuasive' THEN 1.1 ELSE 1.0 END::DOUBLE, 6) AS score FROM fk LEFT JOIN papers USING (document_id)),
bk AS (SELECT * FROM (SELECT bo.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN prior THEN CASE doc_type WHEN 'judgment' THEN 1 WHEN 'regulation' THEN 2 ELSE 999 END ELSE 0 END, score DESC, chunk_id) AS rank FROM bo JOIN runs USING (query_id)) x WHERE rank <= top_k)
"""
_DOMAIN = "CASE x WHEN 'go' THEN 'education' WHEN 'judicial' THEN 'judicial' WHEN 'legal' THEN 'constitution' WHEN 'scheme' THEN 'state_governance' WHEN 'data' THEN 'finance' END"
_MAPPED = f"CASE WHEN len(list_filter(list_transform(verticals, lambda x: {_DOMAIN}), lambda d: d IS NOT NULL)) = 0 THEN ['education'] ELSE list_transform(verticals, lambda x: {_DOMAIN}) END AS domains"


def _layers(v):
    k = F.col("query_id")
    asks = v("asks").select("query_id", "text", "since_date", "jurisdiction", F.col("verticals").alias("primary_verticals"), (10 + k % 4 * 5).cast("int").alias("top_k"))
    words = lambda *w: F.array(*map(F.lit, w))
    return asks.withColumns({"binding_verticals": F.when(k % 2 == 0, words("judicial", "legal")), "impact_verticals": F.when(k % 3 == 0, words("data", "go")).otherwise(F.array().cast("array<string>"))})


def _layered(v):
    return r.layered_retrieve(_layers(v), v("chunks"), v("papers"), v("vectors"), _vectors(v), v("overrulings"))


register("ret_10_layered_search", _layered, f"""
WITH l AS (SELECT query_id AS base_id, text, since_date, jurisdiction AS j, CAST(10 + query_id % 4 * 5 AS INT) AS total, unnest([0, 1, 2]) AS layer, verticals AS own FROM asks),
w AS (SELECT *, CASE layer WHEN 0 THEN own WHEN 1 THEN CASE WHEN base_id % 2 = 0 THEN ['judicial', 'legal'] END ELSE CASE WHEN base_id % 3 = 0 THEN ['data', 'go'] END END AS verticals FROM l),
runs AS (SELECT base_id * 10 + layer AS query_id, base_id, total, layer, text, since_date, j, {_MAPPED}, CAST(floor(total * [0.5, 0.3, 0.2][layer + 1]) AS INT) AS top_k, layer = 1 AS prior FROM w WHERE verticals IS NOT NULL), {_RANKED},
d AS (SELECT *, row_number() OVER (PARTITION BY base_id, chunk_id ORDER BY layer) AS copy FROM (SELECT b.chunk_id, b.document_id, b.score, r.base_id, r.layer, r.total FROM bk b JOIN runs r ON r.query_id = b.query_id) x),
e AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY score DESC, layer, chunk_id) AS rank FROM d WHERE copy = 1)
SELECT base_id AS query_id, chunk_id, document_id, ['primary', 'binding', 'impact'][layer + 1] AS layer, score, rank FROM e WHERE rank <= total""")


def _routed(v):
    return r.pipeline_retrieve(v("asks").drop("verticals"), v("chunks"), v("papers"), v("vectors"), _vectors(v), v("overrulings"))


_PIPED = f"""
WITH u AS (SELECT query_id, unnest(domains) AS domain FROM asks),
g AS (SELECT query_id, list(DISTINCT vertical) AS verticals FROM (SELECT query_id, unnest(CASE domain WHEN 'education' THEN ['go', 'legal', 'scheme'] WHEN 'agriculture' THEN ['go', 'scheme'] WHEN 'constitution' THEN ['legal', 'judicial'] WHEN 'judicial' THEN ['judicial'] ELSE ['go', 'legal'] END) AS vertical FROM u) x GROUP BY 1),
k(pipeline, pipeline_name, risky, dated, compared, top_k) AS (VALUES ('P1', 'Factual/Clarification', false, false, false, 15), ('P2', 'Comparative/Evolution', false, true, true, 30), ('P3', 'Risk/Constitutionality', true, false, false, 25), ('P4', 'Multi-Domain Impact', true, true, true, 40), ('P5', 'Judicial Constraint', true, false, false, 30)),
runs AS (SELECT a.query_id, a.query_id AS base_id, text, since_date, jurisdiction AS j, {_MAPPED}, top_k, false AS prior FROM (SELECT * EXCLUDE (verticals) FROM asks) a JOIN g USING (query_id) JOIN k USING (pipeline)), {_RANKED}"""
register("ret_10_pipeline_search", _routed, _PIPED + "SELECT query_id, chunk_id, document_id, score, rank FROM bk")
register("ret_09_audit_rows", lambda v: r.audit_rows(_routed(v), v("papers")), _PIPED + "SELECT query_id, rank, document_id, coalesce(court, 'N/A') AS court, coalesce(binding_strength, 'N/A') AS binding_strength, round(score, 4) AS final_score FROM bk LEFT JOIN papers USING (document_id) WHERE rank <= 5")
register("ans_01_pipeline_package", lambda v: r.pipeline_package(v("asks"), _routed(v), v("overrulings"), v("papers")).select(
    "query_id", "pipeline_name", "n_hits", "confidence", "timeline", "comparison", "constraints", "risk_score", "risk_level"), _PIPED + """,
b AS (SELECT target_id, min(source_id) AS s FROM overrulings WHERE relation_type = 'overrules' GROUP BY 1),
j AS (SELECT query_id, chunk_id, document_id, title, year(doc_date) AS y, doc_date, p.doc_type, court, status, binding_strength, s FROM bk LEFT JOIN papers p USING (document_id) LEFT JOIN b ON target_id = document_id),
c AS (SELECT query_id, count(*) AS n, count(*) FILTER (binding_strength = 'binding') AS nb, count(s) AS o, count(*) FILTER (status = 'superseded') AS t, CAST(count(*) FILTER (doc_type = 'judgment' AND court = 'Supreme Court') > 1 AS INT) AS sc,
      CAST(count(*) FILTER (doc_type = 'go') > 0 AND count(*) FILTER (doc_type = 'regulation') > 0 AS INT) AS la FROM j GROUP BY 1),
z AS (SELECT *, least(5 * (o * 6.0 + t * 5.0 + sc * 10.0 + la * 8.0), 100.0)::DOUBLE AS risk FROM c),
t AS (SELECT query_id, string_agg(y || ' ' || title, '; ' ORDER BY doc_date, document_id) AS timeline, string_agg(title || ' ' || y || ' ' || m, '; ' ORDER BY document_id) AS comparison, string_agg(document_id || ' overruled by ' || s, '; ' ORDER BY document_id) FILTER (s IS NOT NULL) AS bad
      FROM (SELECT query_id, document_id, title, y, doc_date, s, count(*) AS m FROM j GROUP BY ALL) x GROUP BY 1)
SELECT a.query_id, pipeline_name, coalesce(n, 0) AS n_hits, round(least(coalesce(n, 0) / 5, 1.0) * 0.4 + least(coalesce(nb, 0) / 3, 1.0) * 0.6, 9) AS confidence, CASE WHEN dated THEN coalesce(timeline, '') END AS timeline, CASE WHEN compared THEN coalesce(comparison, '') END AS comparison,
CASE WHEN pipeline = 'P5' THEN coalesce(bad, '') END AS constraints, CASE WHEN risky THEN coalesce(risk, 0) END AS risk_score,
CASE WHEN risky THEN CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 40 THEN 'medium' WHEN risk >= 20 THEN 'low' ELSE 'none' END END AS risk_level
FROM asks a LEFT JOIN k USING (pipeline) LEFT JOIN z USING (query_id) LEFT JOIN t USING (query_id)""")


def _filtered(v):
    asked = v("asks").select("query_id", F.when(F.col("query_id") % 2 == 0, 2000 + F.col("query_id") % 20).cast("int").alias("year"), F.when(F.col("query_id") % 3 == 0, "AP").alias("jurisdiction"))
    return s.vector_search(_vectors(v), v("vectors"), r.filtered_candidates(asked, _lexical(v), v("papers")), 20).select("query_id", "chunk_id", "document_id", "score", "rnk")


register("ret_05_filtered_search", _filtered, _HITS + """,
fl AS (SELECT query_id, l.document_id FROM lex l JOIN papers p ON p.document_id = l.document_id WHERE (query_id % 2 <> 0 OR year(p.doc_date) = 2000 + query_id % 20) AND (query_id % 3 <> 0 OR jurisdiction = 'AP')),""" + _VECTOR.format("fl", 20) + "SELECT query_id, chunk_id, document_id, score, rnk FROM vec")
