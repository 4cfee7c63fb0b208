"""Registered queries of structure parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structure as st
from ..functions.report_tables import report_parts
from ..operators.acts import act_nodes, section_text
from ..plans.registering import Register

register = Register()


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_TOP = "substr(text, 1, 1000)"
register("str_01_go_identity", lambda v: v("filings").select(F.col("document_id").alias("source"), *[c.alias(n) for n, c in st.go_identity(F.col("text")).items()]), rf"""
WITH r AS (SELECT document_id AS source, text, nullif(regexp_extract({_TOP}, '(?i)G\.?O\.?(?:Ms|Rt)?\.?\s*No\.?\s*([0-9A-Z]+)', 1), '') AS raw, nullif(regexp_extract({_TOP}, '(?i)Dated?[:\.]?\s*([0-9]{{1,2}}[-/\.][0-9]{{1,2}}[-/\.][0-9]{{2,4}})', 1), '') AS d,
nullif(regexp_extract({_TOP}, '(?i)(?:Department|Dept\.?)\s+of\s+([A-Z][A-Za-z\s&]+?)(?:,|\.|\n)', 1), '') AS department FROM filings ),
s AS (SELECT *, coalesce(regexp_full_match(raw, '[0-9]+'), false) AS sure, string_split(d, '-')[-1] AS y0 FROM r), t AS (SELECT *, CASE WHEN length(y0) = 2 THEN '20' || y0 ELSE y0 END AS year FROM s)
SELECT source, CASE WHEN sure THEN raw END AS go_number, raw AS raw_go_number, d AS go_date, year, department, CASE WHEN sure THEN 'high' ELSE 'low' END AS confidence, CASE WHEN sure THEN 'authoritative' ELSE 'non_authoritative' END AS authority,
CASE WHEN sure AND year IS NOT NULL THEN 'AP_GO_' || raw || '_' || year ELSE 'AP_GO_UNKNOWN_' || coalesce(year, 'UNK') || '_' || substr(sha256(text), 1, 8) END AS document_id FROM t""")


def _sections(v):
    return v("filings").select("document_id", *[c.alias(n) for n, c in st.go_sections(F.col("text")).items()])


_CUT = rf"""
a AS (SELECT document_id, text, regexp_matches(text, '(?im)^\s*ORDERS?\s*:?\s*$') AS o, regexp_split_to_array(text, '(?im)^\s*ORDERS?\s*:?\s*$')[1] AS h, regexp_extract(text, '(?im)^\s*ORDERS?\s*:?\s*$') AS om,
  regexp_matches(text, '(?i)(?:NOW,?\s+THEREFORE|WHEREAS|In exercise of)') AS w, regexp_split_to_array(text, '(?i)(?:NOW,?\s+THEREFORE|WHEREAS|In exercise of)')[1] AS wh, regexp_extract(text, '(?i)(?:NOW,?\s+THEREFORE|WHEREAS|In exercise of)') AS wm FROM filings ),
b AS (SELECT *, {trim("CASE WHEN o THEN substr(text, length(h) + length(om) + 1) WHEN w THEN substr(text, length(wh) + length(wm) + 1) ELSE text END")} AS rest FROM a),
c AS (SELECT *, (o OR w) AND regexp_matches(rest, '(?im)^\s*ANNEXURE') AS x, regexp_split_to_array(rest, '(?im)^\s*ANNEXURE')[1] AS ro FROM b),
z AS (SELECT document_id, CASE WHEN o THEN {trim("h")} WHEN w THEN {trim("wh || wm")} ELSE '' END AS preamble, CASE WHEN x THEN {trim("ro")} WHEN o OR w THEN rest ELSE text END AS orders,
  CASE WHEN x THEN {trim("substr(rest, length(ro) + 1)")} ELSE '' END AS annexures FROM c)
"""
register("str_02_go_sections", lambda v: _sections(v).select("document_id", *[F.md5(c).alias(c) for c in ("preamble", "orders", "annexures")]),
         f"WITH {_CUT} SELECT document_id, md5(preamble) AS preamble, md5(orders) AS orders, md5(annexures) AS annexures FROM z")


def _paragraphs(v):
    return _sections(v).select("document_id", F.posexplode(st.go_paragraphs(F.col("orders"))).alias("place", "p")).select("document_id", "place", "p.*")


_P = r"(?m)^\s*((?:(?:[0-9]+|[a-zA-Z]+)[\.\)]|(?:[0-9]+|[a-zA-Z]+)\([0-9a-zA-Z]+\)\.?|\([0-9a-zA-Z]+\)))\s+"
_PARAS = _CUT + rf""",
pa AS (SELECT document_id, orders, regexp_extract_all(orders, '{_P}', 1) AS n, regexp_split_to_array(orders, '{_P}') AS g FROM z WHERE orders <> ''),
pb AS (SELECT document_id, unnest(range(0, len(n))) AS place, n, g, 'high' AS confidence FROM pa WHERE len(n) > 0),
pc AS (SELECT document_id, CAST(place AS INT) AS place, trim(n[place + 1], '.)') AS para_no, {trim("g[place + 2]")} AS content, confidence FROM pb UNION ALL SELECT document_id, 0, '1', orders, 'low' FROM pa WHERE len(n) = 0)
"""
register("str_03_go_paragraphs", lambda v: _paragraphs(v).withColumn("content", F.md5("content")), f"WITH {_PARAS} SELECT document_id, place, para_no, md5(content) AS content, confidence FROM pc")
register("str_04_order_semantics", lambda v: _paragraphs(v).select("document_id", "place", *[(F.array_join(c, ",") if n == "target_numbers" else c).alias(n) for n, c in st.order_semantics(F.col("content")).items()]), rf"""
WITH {_PARAS}, l AS (SELECT *, lower(content) AS low FROM pc), m AS (SELECT *, contains(low, 'supersedes') OR contains(low, 'supersession') AS s, contains(low, 'partially') OR contains(low, 'to the extent') OR contains(low, 'subject') AS p FROM l)
SELECT document_id, place, CASE WHEN s AND p THEN 'supersedes_partially' WHEN s THEN 'supersedes_entirely' WHEN contains(low, 'amend') THEN 'amends' WHEN contains(low, 'clarif') THEN 'clarifies' END AS legal_effect,
CASE WHEN s AND p THEN CASE WHEN contains(low, 'orders issued') THEN 'specific_para' ELSE 'subject_only' END WHEN s THEN 'entire_go' WHEN contains(low, 'amend') THEN 'specific_para' END AS override_scope,
contains(low, 'hereby rescinded') OR contains(low, 'stands repealed') OR (contains(low, 'supersedes') AND contains(low, 'entirety')) AS invalidates_prior,
array_to_string(regexp_extract_all(content, '(?i)G\.?O\.?(?:Ms|Rt)?\.?\s*No\.?\s*([0-9A-Z]+)', 1), ',') AS target_numbers,
coalesce(nullif(regexp_extract(content, '(?i)comes?\s+into\s+force\s+(?:with\s+effect\s+)?from\s+([0-9\-\./]+)', 1), ''), nullif(regexp_extract(content, '(?i)effective\s+from\s+([0-9\-\./]+)', 1), '')) AS effective_from FROM m""")


register("str_03_preamble_references", lambda v: _sections(v).select("document_id", F.posexplode(st.preamble_references(F.col("preamble"))).alias("place", "r")).select("document_id", "place", "r.*"), rf"""
WITH {_CUT}, n AS (SELECT document_id, regexp_extract_all(preamble, '(?i)G\.?O\.?(?:Ms|Rt)?\.?\s*No\.?\s*([0-9]+)') AS a, regexp_extract_all(preamble, '(?i)G\.?O\.?(?:Ms|Rt)?\.?\s*No\.?\s*([0-9]+)', 1) AS b FROM z)
SELECT document_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS place, unnest(a) AS ref_text, unnest(b) AS number, 'explicit' AS confidence FROM n""")


def _clauses(v):
    rows = _paragraphs(v).select("document_id", "place", F.posexplode(st.go_clauses(F.col("content"), F.col("para_no"))).alias("at", "c"))
    return rows.select("document_id", "place", "at", "c.*")


_BODY = "trim({}, ' ;,.')"
_OP = "CASE WHEN contains(lower({0}), 'shall') THEN 'shall' WHEN contains(lower({0}), 'must') THEN 'must' WHEN contains(lower({0}), 'may') THEN 'may' END"
_CLAUSES = _PARAS + rf""",
ca AS (SELECT *, regexp_extract_all(content, '(?:\s|^)\(([IVXivx0-9a-z]+)\)', 1) AS m, regexp_split_to_array(content, '(?:\s|^)\(([IVXivx0-9a-z]+)\)') AS cg, regexp_extract_all(content, '(?i)\.\s+(Provided that|Subject to)', 1) AS pm, regexp_split_to_array(content, '(?i)\.\s+(Provided that|Subject to)') AS pg FROM pc),
cb AS (SELECT document_id, place, para_no, m, cg, unnest(range(0, len(m))) AS i FROM ca WHERE len(m) > 0),
cp AS (SELECT document_id, place, para_no, content, pm, pg, unnest(range(0, len(pm))) AS i FROM ca WHERE len(m) = 0 AND len(pm) > 0),
cc AS (SELECT document_id, place, 0 AS o, para_no || '(pre)' AS clause_id, {trim("cg[1]")} AS clause_text, NULL AS legal_operator, false AS has_condition FROM ca WHERE len(m) > 0 AND {trim("cg[1]")} <> ''
UNION ALL SELECT document_id, place, i + 1, para_no || '(' || m[i + 1] || ')', {_BODY.format("cg[i + 2]")}, {_OP.format("cg[i + 2]")}, contains(lower(cg[i + 2]), 'subject to') OR contains(lower(cg[i + 2]), 'provided') FROM cb
UNION ALL SELECT document_id, place, 0, para_no || '(main)', {trim("pg[1]")}, {_OP.format("content")}, false FROM ca WHERE len(m) = 0 AND len(pm) > 0
UNION ALL SELECT document_id, place, i + 1, para_no || '(proviso_' || (i + 1) || ')', {trim("pm[i + 1] || ' ' || pg[i + 2]")}, NULL, true FROM cp
UNION ALL SELECT document_id, place, 0, para_no, content, {_OP.format("content")}, contains(lower(content), 'subject to') FROM ca WHERE len(m) = 0 AND len(pm) = 0)
"""
register("str_05_go_clauses", lambda v: _clauses(v).drop("at").withColumn("clause_text", F.md5("clause_text")), f"WITH {_CLAUSES} SELECT document_id, place, clause_id, md5(clause_text) AS clause_text, legal_operator, has_condition FROM cc")


def _annexures(v):
    return _sections(v).select("document_id", F.posexplode(st.annexures(F.col("annexures"))).alias("place", "a")).select("document_id", "place", "a.*")


_ANNEX = _CUT + rf""",
xa AS (SELECT document_id, annexures, regexp_extract_all(annexures, '(?i)(ANNEXURE\s*[-:\s]?[IVX0-9]+)', 1) AS h, regexp_split_to_array(annexures, '(?i)(ANNEXURE\s*[-:\s]?[IVX0-9]+)') AS g FROM z WHERE annexures <> ''),
xb AS (SELECT document_id, h, g, unnest(range(0, len(h))) AS i FROM xa),
xc AS (SELECT document_id, CAST(i AS INT) AS place, upper(replace({trim("h[i + 1]")}, ' ', '-')) AS annexure_id, {trim("g[i + 2]")} AS content, CASE WHEN regexp_matches({trim("g[i + 2]")}, '\|.*\||\s{{4,}}') THEN 'table' ELSE 'text' END AS kind FROM xb
UNION ALL SELECT document_id, 0, 'ANNEXURE-GEN', annexures, 'text' FROM xa WHERE len(h) = 0)
"""
register("str_06_annexures", lambda v: _annexures(v).withColumn("content", F.md5("content")), f"WITH {_ANNEX} SELECT document_id, place, annexure_id, md5(content) AS content, kind FROM xc")

_TAIL = r"(?:[:\.\s]+(.+?))?$"
_NUM = r"([0-9]+[A-Z]?(?:\([0-9a-zA-Z]+\))?)"
_NODES = {
    "section": rf"(?im)^\s*Section\s+{_NUM}{_TAIL}", "article": rf"(?im)^\s*Article\s+{_NUM}{_TAIL}", "rule": rf"(?im)^\s*Rule\s+{_NUM}{_TAIL}", "regulation": rf"(?im)^\s*Regulation\s+([0-9]+|[IVX]+){_TAIL}",
    "norm": rf"(?im)^\s*Norm\s*(?:[sS])?\s+([0-9]+|[IVX]+){_TAIL}", "schedule": rf"(?im)^\s*(?:THE\s+)?SCHEDULE\s+([IXV0-9A-Z]+){_TAIL}", "appendix": rf"(?im)^\s*APPENDIX\s+([IXV0-9A-Z]+){_TAIL}",
    "chapter": rf"(?im)^\s*CHAPTER\s+([IVXLCDM]+|[0-9]+){_TAIL}", "part": rf"(?im)^\s*PART\s+([IVXLCDM]+|[0-9]+){_TAIL}",
}
_LEGAL = "WITH lp AS (" + " UNION ALL ".join(
    f"SELECT document_id, text, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', 1) AS v, regexp_extract_all(text, '{p}', 2) AS t, regexp_split_to_array(text, '{p}') AS g FROM filings WHERE vertical = 'legal'" for k, p in _NODES.items()
) + rf"""),
lu AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM lp WHERE len(m) > 0),
ls AS (SELECT document_id, text, kind, m[i] AS matched, v[i] AS number, {trim("t[i]")} AS raw, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS start FROM lu),
lc AS (SELECT *, {trim("regexp_split_to_array(substr(text, start + length(matched) + 1), '(?im)^\\s*(Section|Sec\\.?|Article|Rule|Regulation|Norm\\s*s?|CHAPTER|PART|(?:THE\\s+)?SCHEDULE|APPENDIX)\\s+')[1]")} AS after,
  CASE WHEN contains(raw, '—') THEN {trim("split_part(raw, '—', 1)")} ELSE nullif(raw, '') END AS title, CASE WHEN contains(raw, '—') THEN {trim("substr(raw, instr(raw, '—') + 1)")} ELSE '' END AS inline FROM ls),
ld AS (SELECT *, CASE WHEN inline <> '' THEN {trim("inline || chr(10) || after")} ELSE after END AS content FROM lc),
lz AS (SELECT n.document_id, n.start, n.kind AS section_type, n.number, n.title, n.content, len(regexp_extract_all(n.content, '(?im)^\s*\(([0-9a-zA-Z]|[ivx]+)\)\s+')) AS n_clauses,
  round(greatest(1.0::DOUBLE - CASE WHEN length(n.content) < 30 THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(n.number, '[0-9][A-Z]') THEN 0.4 ELSE 0 END, 0.3), 6) AS confidence,
  (SELECT arg_max(p.number, p.start) FROM ls p WHERE p.document_id = n.document_id AND p.kind = 'part' AND p.start < n.start) AS part, (SELECT arg_max(p.number, p.start) FROM ls p WHERE p.document_id = n.document_id AND p.kind = 'chapter' AND p.start < n.start) AS chapter
  FROM ld n WHERE kind NOT IN ('part', 'chapter'))
"""


def _legal(v):
    return v("filings").filter("vertical = 'legal'").select("document_id", F.explode(st.legal_nodes(F.col("text"))).alias("n")).select("document_id", "n.*")


register("str_07_legal_nodes", lambda v: _legal(v).withColumn("content", F.md5("content")).withColumn("n_clauses", F.col("n_clauses").cast("long")),
         _LEGAL + "SELECT document_id, start, section_type, number, title, md5(content) AS content, n_clauses, confidence, part, chapter FROM lz")
_NODE_CLAUSES = r"array_to_string(regexp_extract_all(lz.content, '(?im)^\s*\(([0-9a-zA-Z]|[ivx]+)\)\s+', 1), '|')"
register("str_07_act_nodes", lambda v: act_nodes(v("filings").filter("vertical = 'legal'")).withColumns({"content": F.md5("content"), "clauses": F.array_join("clauses", "|")}),
         _LEGAL + f"SELECT document_id, start, section_type, number, title, md5(content) AS content, {_NODE_CLAUSES} AS clauses, n_clauses, confidence, part, chapter FROM lz")
register("str_07_section_text", lambda v: section_text(act_nodes(v("filings")), v("filings").filter("vertical = 'legal'").select("document_id", F.when(F.col("k") % 2 == 0, "2").otherwise("1A").alias("number"))),
         _LEGAL + "SELECT f.document_id, f.number, lz2.content FROM (SELECT document_id, CASE WHEN k % 2 = 0 THEN '2' ELSE '1A' END AS number FROM filings WHERE vertical = 'legal') f LEFT JOIN (SELECT document_id, number, arg_min(content, start) AS content FROM lz GROUP BY 1, 2) lz2 ON lz2.document_id = f.document_id AND lz2.number = f.number")
_AW = " OR ".join(f"contains(lower(substr(text, 1, 3000)), '{w}')" for w in ("be it enacted", "constitution of india", "notified", "regulation", "rules", "norms", "appendix", "ordinance"))
_AP = r"(?i)(?:THE\s+)?(.+?)\s+\b(Act|Rules|Regulations|Regulation|Rule|Norms|Norm|Appendix|Ordinance)\b(?:,?\s+([0-9]{4}))?"
register("str_08_act_name", lambda v: v("filings").select("document_id", st.act_name(F.concat(F.col("text"), F.lit("\nthe rules"))).alias("act_name")), rf"""
WITH f AS (SELECT document_id, text || chr(10) || 'the rules' AS text FROM filings ), l AS (SELECT document_id, unnest(string_split(substr(text, 1, 2500), chr(10))) AS x, unnest(range(len(string_split(substr(text, 1, 2500), chr(10))))) AS i FROM f WHERE {_AW}),
s AS (SELECT document_id, i, {trim("x")} AS x FROM l), n AS (SELECT document_id, i, x, {trim(f"regexp_extract_all(x, '{_AP}', 1)[-1]")} AS t, regexp_extract_all(x, '{_AP}', 2)[-1] AS s, regexp_extract_all(x, '{_AP}', 3)[-1] AS y FROM s WHERE length(x) >= 5),
r AS (SELECT document_id, i, CASE WHEN t IS NOT NULL THEN CASE WHEN length(t) <= 150 THEN t || ' ' || s || CASE WHEN coalesce(y, '') <> '' THEN ', ' || y ELSE '' END END WHEN contains(lower(x), 'norms') AND length(x) < 100 THEN x END AS name FROM n)
SELECT f.document_id, arg_min(name, i) AS act_name FROM f LEFT JOIN (SELECT * FROM r WHERE name IS NOT NULL) r ON r.document_id = f.document_id GROUP BY 1""")

_JM = {
    "headnote": r"(?i)(?:HEADNOTE|CATCHWORDS|SYLLABUS)[:\s]", "facts": r"(?i)(?:FACTS?|BACKGROUND|FACTUAL BACKGROUND|BRIEF FACTS)[:\s]", "issues": r"(?i)(?:ISSUES?|QUESTIONS? OF LAW|POINTS? FOR DETERMINATION)[:\s]",
    "arguments_petitioner": r"(?i)(?:SUBMISSIONS?\s+BY\s+THE\s+PETITIONER|ARGUMENTS?\s+OF\s+THE\s+APPELLANT|CONTENTIONS?\s+OF\s+THE\s+PETITIONER)[:\s]",
    "arguments_respondent": r"(?i)(?:SUBMISSIONS?\s+BY\s+THE\s+RESPONDENT|ARGUMENTS?\s+OF\s+THE\s+STATE|CONTENTIONS?\s+OF\s+THE\s+RESPONDENT)[:\s]",
    "ratio": r"(?i)(?:RATIO|RATIO DECIDENDI|REASONING|ANALYSIS|DISCUSSION|CONSIDERATION)[:\s]", "judgment": r"(?i)(?:JUDGMENT|DECISION|ORDER|HELD|CONCLUSION|COMMON JUDGMENT)[:\s]",
}
_SM = {
    "objective": r"(?im)^(?:OBJECTIVE|OBJECTIVES|PURPOSE|AIM)[:\s]", "eligibility": r"(?im)^(?:ELIGIBILITY|ELIGIBLE|WHO CAN APPLY|ELIGIBILITY CRITERIA)[:\s]", "benefits": r"(?im)^(?:BENEFITS?|ASSISTANCE|FINANCIAL AID|PROVISIONS)[:\s]",
    "application": r"(?im)^(?:HOW TO APPLY|APPLICATION|APPLICATION PROCESS|PROCEDURE)[:\s]", "implementation": r"(?im)^(?:IMPLEMENTATION|EXECUTION|MONITORING|ADMINISTRATION)[:\s]",
}


def _marked(marks: dict, vertical: str, before: str) -> str:
    each = " UNION ALL ".join(f"SELECT document_id, text, {i} AS o, '{k}' AS section_type, length(regexp_split_to_array(text, '{p}')[1]) AS start FROM filings WHERE vertical = '{vertical}' AND regexp_matches(text, '{p}')" for i, (k, p) in enumerate(marks.items()))
    return rf"""
WITH k AS ({each}), e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY start, o), length(text)) AS stop, row_number() OVER (PARTITION BY document_id ORDER BY start, o) AS n FROM k),
q AS (SELECT document_id, CAST(start AS INT) AS start, section_type, {trim("substr(text, start + 1, stop - start)")} AS content FROM e UNION ALL SELECT document_id, 0, '{before}', {trim("substr(text, 1, start)")} FROM e WHERE n = 1
UNION ALL SELECT document_id, 0, 'content', text FROM filings WHERE vertical = '{vertical}' AND document_id NOT IN (SELECT document_id FROM k)),
qq AS (SELECT * FROM q WHERE content <> '')
"""


def _cut(v, vertical, sections):
    return v("filings").filter(f"vertical = '{vertical}'").select("document_id", F.explode(sections(F.col("text"))).alias("s")).select("document_id", "s.start", "s.section_type", F.md5("s.content").alias("content"))


register("str_09_judicial_sections", lambda v: _cut(v, "judicial", st.judgment_sections), _marked(_JM, "judicial", "preamble") + "SELECT document_id, start, section_type, md5(content) AS content FROM qq")
register("str_11_scheme_sections", lambda v: _cut(v, "scheme", st.scheme_sections), _marked(_SM, "scheme", "overview") + "SELECT document_id, start, section_type, md5(content) AS content FROM qq")


def _bulleted(v):
    sections = st.scheme_sections(F.col("text"))
    rows = v("filings").filter("vertical = 'scheme'")
    return rows.select("document_id", st.scheme_name(F.col("text")).alias("scheme_name"), F.array_join(st.bullets(sections, "eligibility"), "|").alias("eligibility"), F.array_join(st.bullets(sections, "benefits"), "|").alias("benefits"))


_BUL = r"(?m)^(?:[•*-]|[0-9]+\.|\([a-z]\))\s+(.+?)$"
register("str_11_scheme_lists", _bulleted, _marked(_SM, "scheme", "overview") + rf"""
SELECT f.document_id, {trim(r"nullif(regexp_extract(substr(text, 1, 500), '(?i)(Jagananna\s+[A-Za-z\s]+|Amma\s+[A-Za-z\s]+(?:Scheme|Program)|\w+\s+(?:Scheme|Yojana|Program))', 1), '')")} AS scheme_name,
array_to_string(list_transform(regexp_extract_all(coalesce((SELECT min(content) FROM qq WHERE qq.document_id = f.document_id AND section_type = 'eligibility'), ''), '{_BUL}', 1), lambda x: {trim("x")}), '|') AS eligibility,
array_to_string(list_transform(regexp_extract_all(coalesce((SELECT min(content) FROM qq WHERE qq.document_id = f.document_id AND section_type = 'benefits'), ''), '{_BUL}', 1), lambda x: {trim("x")}), '|') AS benefits FROM filings f WHERE vertical = 'scheme'""")

_J3, _J2 = "substr(text, 1, 3000)", "right(text, 2000)"
register("str_10_judicial_identity", lambda v: v("filings").filter("vertical = 'judicial'").select("document_id", *[c.alias(n) for n, c in st.judgment_identity(F.col("text")).items()]), rf"""
WITH i AS (SELECT document_id, text, nullif(regexp_extract({_J3}, '(?i)(?:Supreme\s+Court\s+of\s+India|High\s+Court\s+of\s+[A-Za-z\s]+|District\s+Court\s+at\s+[A-Za-z\s]+|IN\s+THE\s+HIGH\s+COURT\s+OF\s+[A-Za-z\s]+)'), '') AS court,
nullif(regexp_extract({_J3}, '(?i)(?:BEFORE|CORAM|PRESENT|Bench)[:\s]+([^\n]*)'), '') AS bench, nullif(regexp_extract({_J3}, '(?i)(?:Case|Petition|Appeal|Crl\.A\.|W\.P\.|RT)\s*(?:No\.?|No(?:s)?\.?)\s*([0-9]+(?:/[0-9]+)?(?:\(?\w+\)?)*)', 1), '') AS case_number,
nullif(regexp_extract({_J3}, '(?i)(?:Dated?|Date\s+of\s+Decision)[:\s]+([0-9]{{1,2}}[-/\.][0-9]{{1,2}}[-/\.][0-9]{{2,4}})', 1), '') AS decided, nullif(regexp_extract({_J3}, '(?i)\([0-9]{{4}}\)\s*[0-9]+\s*[A-Z]{{2,}}\s*[0-9]+'), '') AS citation,
contains(lower(substr(text, 1, 1000)), 'guidelines') OR contains(lower(substr(text, 1, 1000)), 'manual') AS g FROM filings WHERE vertical = 'judicial'),
l AS (SELECT *, CASE WHEN contains(lower(court), 'supreme court') THEN 'supreme_court' WHEN contains(lower(court), 'high court') THEN 'high_court' WHEN contains(lower(court), 'tribunal') THEN 'tribunal' WHEN contains(lower(court), 'district') THEN 'district_court' END AS court_level,
(length(bench) - length(replace(lower(bench), 'justice', ''))) // 7 AS j FROM i)
SELECT document_id, court, bench, case_number, decided, citation, CASE WHEN g THEN 'guidelines' ELSE 'judgment' END AS doc_type, court_level, CASE WHEN court IS NULL OR g THEN 'informative' WHEN court_level IN ('supreme_court', 'high_court') THEN 'binding' WHEN court_level IS NOT NULL THEN 'persuasive' ELSE 'informative' END AS binding_scope,
CASE WHEN court_level = 'supreme_court' THEN 'Nationwide' WHEN court_level = 'high_court' AND NOT contains(lower(court), 'andhra pradesh') AND NOT contains(lower(court), 'ap') THEN 'India' ELSE 'AP' END AS jurisdiction, CAST(CASE WHEN j > 0 THEN j END AS INT) AS bench_strength,
CASE WHEN regexp_matches({_J2}, '(?i)(?:petition|appeal|writ)\s+(?:is\s+)?(?:partly|partially)\s+(?:allowed|granted)') THEN 'partly_allowed' WHEN regexp_matches({_J2}, '(?i)(?:petition|appeal|writ)\s+(?:is\s+)?(?:allowed|granted|accepted)') THEN 'allowed' WHEN regexp_matches({_J2}, '(?i)(?:petition|appeal|writ)\s+(?:is\s+)?(?:dismissed|rejected)') THEN 'dismissed' END AS petition_result,
CASE WHEN regexp_matches({_J2}, '(?i)(?:order|decision|judgment)\s+(?:is\s+)?(?:quashed|set\s+aside)') THEN 'quashed' WHEN regexp_matches({_J2}, '(?i)(?:order|decision|judgment)\s+(?:is\s+)?(?:upheld|confirmed|sustained)') THEN 'upheld'
WHEN regexp_matches({_J2}, '(?i)(?:matter|case)\s+(?:is\s+)?(?:remanded|sent\s+back)') THEN 'remanded' WHEN regexp_matches({_J2}, '(?i)(?:direct|direction|order)\s+(?:the|that)') THEN 'directions' END AS order_type FROM l""")
_R2 = "substr(text, 1, 2000)"
register("cls_08_report_identity", lambda v: v("filings").filter("vertical = 'data'").select("document_id", *[c.alias(n) for n, c in st.report_identity(F.col("text"), 2015).items()]), rf"""
WITH i AS (SELECT document_id, text, CASE WHEN regexp_matches({_R2}, '(?i)UDISE\+|Unified\s+District\s+Information\s+System') THEN 'UDISE+' WHEN regexp_matches({_R2}, '(?i)National\s+Achievement\s+Survey|NAS\s*20[0-9]{{2}}') THEN 'NAS' WHEN regexp_matches({_R2}, '(?i)Budget\s+Analysis|Budget\s+Estimates|Demand\s+for\s+Grants') THEN 'Budget' WHEN regexp_matches({_R2}, '(?i)Annexure|Appendix') THEN 'Annexure' ELSE 'Other Data Report' END AS k,
nullif(regexp_extract({_R2}, '(?i)Volume\s*[-:\s]*([IVX0-9]+)', 1), '') AS vol, nullif(regexp_extract({_R2}, '20[0-9]{{2}}[-\s/][0-9]{{2,4}}'), '') AS period FROM filings WHERE vertical = 'data'),
y AS (SELECT *, CASE WHEN k = 'Budget' AND vol IS NOT NULL THEN 'Budget Volume ' || vol ELSE k END AS report_type, CASE WHEN contains(period, '-') THEN split_part(period, '-', 1) ELSE period END AS year FROM i)
SELECT document_id, report_type, period, year, {trim(rf"nullif(regexp_extract({_R2}, '(?i)(?:Department|Dept\.?)\s+of\s+([A-Z][A-Za-z\s&]+?)(?:,|\.|\n|$)', 1), '')")} AS department,
CASE WHEN contains(lower(report_type), 'budget') OR contains(lower(report_type), 'financial') THEN 'financial' WHEN contains(upper(report_type), 'UDISE') OR contains(upper(report_type), 'NAS') OR contains(upper(report_type), 'STATISTICS') THEN 'statistical' WHEN contains(lower({_R2}), 'guideline') OR contains(lower({_R2}), 'recommendation') THEN 'recommendatory' ELSE 'informational' END AS intent,
coalesce(nullif(regexp_extract({_R2}, '(?i)(?:FY|Financial Year)\s*([0-9]{{4}}-[0-9]{{2,4}})', 1), ''), CASE WHEN contains(period, '-') THEN period END) AS financial_year,
CASE WHEN regexp_matches({_R2}, '([0-9]{{4}})\s*(?:to|-)\s*([0-9]{{4}})') THEN regexp_extract({_R2}, '([0-9]{{4}})\s*(?:to|-)\s*([0-9]{{4}})', 1) || '-' || regexp_extract({_R2}, '([0-9]{{4}})\s*(?:to|-)\s*([0-9]{{4}})', 2) END AS applicable_period,
coalesce(2015 - TRY_CAST(year AS INT) > 2, false) AS is_historical, regexp_matches(substr(text, 1, 3000), '(?i)(?:Rs\.?|Rupees|INR)\s*(?:in\s+)?(?:Lakhs|Crores|Millions)?') AS contains_financials,
CASE WHEN regexp_matches({_R2}, '\(cid:[0-9]+\)') THEN 'low' WHEN length(regexp_replace({_R2}, '[^0-9]', '', 'g')) / greatest(1, length({_R2})) > 0.15 THEN 'high' ELSE 'medium' END AS numeric_confidence FROM y""")


def _cells(v):
    rows = F.transform(F.split("text", "\n"), lambda r: F.split(r, r"\|"))
    return v("filings").filter("vertical = 'data'").select("document_id", *[(F.array_join(c, "/") if n == "headers" else F.md5(c) if n == "table_text" else c.cast("long")).alias(n) for n, c in st.table_cells(rows).items()])


register("str_14_table_cells", _cells, rf"""
WITH r AS (SELECT document_id, list_filter(list_transform(string_split(text, chr(10)), lambda r: list_transform(string_split(r, '|'), lambda c: {trim("c")})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS k FROM filings WHERE vertical = 'data')
SELECT document_id, array_to_string(k[1], '/') AS headers, md5(array_to_string(list_transform(k, lambda r: array_to_string(r, ' | ')), chr(10))) AS table_text, len(k) AS n_rows, len(k[1]) AS n_columns FROM r""")


_BETWEEN = r"(?is)Between[:\s\n]+(.*?)\n\s*AND\s*\n?(.*?)\n\s*(?:JUDGMENT|ORDER|PRESENT|[:A-Z]+|$)"
register("str_10_judicial_parties", lambda v: v("suits").select("document_id", *[c.alias(n) for n, c in st.judgment_parties(F.col("text")).items()]), f"""
SELECT document_id, {trim(f"nullif(regexp_extract({_J3}, '{_BETWEEN}', 1), '')")} AS petitioner, {trim(f"nullif(regexp_extract({_J3}, '{_BETWEEN}', 2), '')")} AS respondent FROM suits""")

_SECTION, _CHART = r"(?m)^(?:Chapter|Section|CHAPTER|SECTION)\s+([0-9]+(?:\.[0-9]+)?)[:\.]?\s*(.+?)$", r"(?:Figure|Chart|Graph)\s+([0-9]+(?:\.[0-9]+)?)[:\.]?\s*(.+?)(?:\n|$)"
_MARK = rf"(?i){_CHART}|(?:Table|Annexure)\s+[0-9]+(?:\.[0-9]+)?[:\.]?\s*.+?(?:\n|$)|(?:Demand\s+Reference|Demand\s*Number)\s*[:\.]?\s*[A-Za-z0-9]+.*"
_TITLED = "'{} ' || regexp_extract(mk, '{}', 1) || ': ' || " + trim("regexp_extract(mk, '{}', 2)")
register("str_12_report_parts", lambda v: v("surveys").select("document_id", F.explode(report_parts(F.col("text"))).alias("p")).select("document_id", "p.section_type", "p.title", "p.start", "p.end", F.md5("p.content").alias("content")), rf"""
WITH r AS (SELECT document_id, text, 'analysis' AS kind, regexp_extract_all(text, '{_SECTION}') AS m, regexp_split_to_array(text, '{_SECTION}') AS g FROM surveys
UNION ALL SELECT document_id, text, 'chart', regexp_extract_all(text, '{_MARK}'), regexp_split_to_array(text, '{_MARK}') FROM surveys),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r),
w AS (SELECT document_id, text, kind, m[i] AS mk, g[i + 1] AS body, i = len(m) AS final, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INT) AS off FROM u),
x AS (SELECT *, CASE WHEN kind = 'chart' AND (final OR body = '') THEN least(off + 500, length(text)) ELSE off + length(body) END AS stop FROM w WHERE kind = 'analysis' OR regexp_matches(mk, '^(?i)(?:Figure|Chart|Graph)'))
SELECT document_id, kind AS section_type, CASE kind WHEN 'chart' THEN {_TITLED.format("Figure", "(?i)" + _CHART, "(?i)" + _CHART)} ELSE {_TITLED.format("Section", _SECTION, _SECTION)} END AS title,
CAST(off - length(mk) AS INT) AS start, CAST(stop AS INT) AS "end", md5({trim("substr(text, CASE kind WHEN 'chart' THEN off - length(mk) ELSE off END + 1, stop - CASE kind WHEN 'chart' THEN off - length(mk) ELSE off END)")}) AS content FROM x""")
