"""Registered queries of classification, chunking, excerpts and entity cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as c
from ..functions import entities as e
from ..functions import mentions as m
from ..functions import structure as st
from ..functions import unicode as u
from ..operators import chunking as ch
from ..plans.registering import Register
from .structure import _ANNEX, _CLAUSES, _PARAS, trim

register = Register()

_KEYS = {
    "go": "government order|g.o.|preamble|order|whereas|now therefore|annexure", "legal": "act|rule|section|chapter|clause|amendment|regulation|statute",
    "judicial": "petitioner|respondent|judgment|court|honourable|held that|appeal|writ|case", "data": "table|figure|statistics|data|report|survey|analysis|enrollment|percentage",
    "scheme": "scheme|eligibility|beneficiary|benefit|implementation|guidelines|application|assistance",
}
_SCORES = ", ".join("CAST(" + " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)} + CASE WHEN contains(lower(file_name), '{w}') THEN 5 ELSE 0 END" for w in ws.split("|")) + f" AS INT) AS s_{k}" for k, ws in _KEYS.items())


def _verticals(v):
    kind, sure = c.vertical(F.col("text"), F.col("file_name"))
    return v("filings").select("document_id", kind.alias("vertical"), F.round(sure, 9).alias("confidence"))


register("cls_01_vertical_keywords", _verticals, f"""
WITH s AS (SELECT document_id, {_SCORES} FROM (SELECT *, lower(text) AS low FROM filings ) x), b AS (SELECT *, greatest(s_go, s_legal, s_judicial, s_data, s_scheme) AS best, s_go + s_legal + s_judicial + s_data + s_scheme AS total FROM s)
SELECT document_id, CASE WHEN best < 3 THEN 'data' WHEN s_go = best THEN 'go' WHEN s_legal = best THEN 'legal' WHEN s_judicial = best THEN 'judicial' WHEN s_data = best THEN 'data' ELSE 'scheme' END AS vertical,
round(CASE WHEN best < 3 THEN 0.3 ELSE least(0.8, best / greatest(total, 1)) END, 9) AS confidence FROM b""")


def _types(v):
    kind, sure, category = c.document_type(F.col("text"), F.col("vertical"), F.col("file_name"))
    return v("filings").select("document_id", kind.alias("doc_type"), sure.cast("double").alias("confidence"), category.alias("category"))


_M = lambda p: f"regexp_matches(t, '(?i){p}')"
_NOTE, _COURT = _M(r"NOTIFICATION|(?:is|are)\s+hereby\s+notified"), _M(r"ORDER|the\s+(?:Court|Bench)\s+(?:orders?|directs?)")
_AMEND, _ACT = _M(r"Amendment|amends?\s+(?:the\s+)?(?:Act|Rules?)|in\s+(?:partial\s+)?amendment"), _M(r"(?:The\s+)?([A-Z][A-Za-z\s,\(\)]+)\s+Act(?:,?\s+[0-9]{4})?|An\s+Act\s+to|BE\s+IT\s+ENACTED")
_RULE = _M(r"(?:The\s+)?([A-Z][A-Za-z\s,\(\)]+)\s+Rules(?:,?\s+[0-9]{4})?|In\s+exercise\s+of\s+the\s+powers|pursuant\s+to\s+Section")
_JUDG = _M(r"JUDGMENT|CORAM[:\s]|(?:Hon''ble|Honourable)\s+(?:Justice|Judge)|(?:Petitioner|Appellant)\s+(?:Vs?\.?|versus)\s+(?:Respondent|Defendant)")
_CIRC, _GUIDE = _M(r"CIRCULAR|for\s+information\s+and\s+(?:compliance|guidance)"), _M(r"GUIDELINES?|Standard\s+Operating\s+Procedures?|Instructions?\s+for")
_BUD, _REP = _M(r"Budget\s+(?:Estimates?|Allocations?)|Financial\s+(?:Statement|Estimates?)"), _M(r"(?:Annual|Quarterly|Monthly)\s+Report|REPORT\s+(?:ON|OF)|Executive\s+Summary")
_SCH = _M(r"Scheme\s+(?:for|of)|(?:Eligibility|Benefits?)\s+under\s+the\s+scheme|Implementation\s+of\s+(?:the\s+)?scheme")
register("cls_02_doc_type", _types, f"""
WITH f AS (SELECT document_id, vertical, lower(file_name) AS n, substr(text, 1, 2000) AS t FROM filings ),
r AS (SELECT document_id, CASE vertical
WHEN 'go' THEN CASE WHEN {_CIRC} THEN ['go_circular', '0.85', 'government_order'] WHEN {_NOTE} THEN ['go_notification', '0.8', 'government_order'] ELSE ['go_order', '0.75', 'government_order'] END
WHEN 'legal' THEN CASE WHEN {_AMEND} THEN ['amendment', '0.9', 'legislation'] WHEN {_ACT} THEN ['act', '0.9', 'legislation'] WHEN {_RULE} THEN ['rule', '0.85', 'legislation'] WHEN {_NOTE} THEN ['notification', '0.8', 'notification']
  WHEN contains(lower(substr(t, 1, 500)), 'regulation') THEN ['regulation', '0.75', 'legislation'] ELSE ['unknown', '0.5', 'unknown'] END
WHEN 'judicial' THEN CASE WHEN {_JUDG} THEN ['judgment', '0.9', 'judicial'] WHEN {_COURT} THEN CASE WHEN contains(lower(substr(t, 1, 500)), 'interim') THEN ['interim_order', '0.85', 'judicial'] ELSE ['order', '0.85', 'judicial'] END ELSE ['order', '0.7', 'judicial'] END
WHEN 'data' THEN CASE WHEN contains(n, 'budget') THEN ['budget', '0.9', 'data_report'] WHEN contains(n, 'report') OR contains(n, 'annual') OR contains(n, 'quarterly') THEN ['report', '0.85', 'data_report'] WHEN contains(n, 'stats') OR contains(n, 'data') THEN ['statistics', '0.85', 'data_report']
  WHEN {_BUD} THEN ['budget', '0.85', 'data_report'] WHEN {_REP} THEN ['report', '0.8', 'data_report'] WHEN len(regexp_extract_all(t, 'Table|[|]|\\t')) > 10 THEN ['statistics', '0.75', 'data_report'] ELSE ['report', '0.7', 'data_report'] END
ELSE CASE WHEN {_GUIDE} THEN ['guidelines', '0.85', 'scheme'] WHEN {_SCH} THEN ['scheme_document', '0.8', 'scheme'] ELSE ['scheme_document', '0.75', 'scheme'] END END AS x FROM f)
SELECT document_id, x[1] AS doc_type, CAST(x[2] AS DOUBLE) AS confidence, x[3] AS category FROM r""")


def _roles(v):
    own = v("filings").select("document_id", *[x.alias(n) for n, x in st.go_sections(F.col("text")).items()])
    role, weight = c.go_role(F.col("preamble"), F.transform(st.go_paragraphs(F.col("orders")), lambda p: p["content"]))
    return own.select("document_id", role.alias("role"), weight.alias("weight"))


register("cls_04_go_role", _roles, f"""
WITH {_PARAS}, o AS (SELECT document_id, string_agg(lower(content), ' ' ORDER BY place) AS t FROM pc GROUP BY 1), f AS (SELECT z.document_id, lower(preamble) AS p, lower(preamble) || ' ' || coalesce(t, '') AS f FROM z LEFT JOIN o ON o.document_id = z.document_id),
r AS (SELECT document_id, CASE WHEN contains(f, 'hereby repeal') OR contains(f, 'stands repealed') OR contains(f, 'entirety superseded') THEN 'repeal'
WHEN (contains(f, 'amendment') OR contains(f, 'amends')) AND (contains(f, 'hereby makes the following amendment') OR contains(f, 'substituted')) THEN 'amendment'
WHEN contains(f, 'sanction is hereby accorded') AND (contains(f, 'rupees') OR contains(f, 'rs.') OR contains(f, 'only')) THEN 'financial_sanction' WHEN contains(f, 'budget') AND contains(f, 'head of account') THEN 'financial_sanction'
WHEN contains(f, 'clarification') OR contains(f, 'clarifies') OR contains(f, 'common understanding') THEN 'clarification' WHEN (contains(p, 'implementation of') OR contains(p, 'rules made under')) AND (contains(p, 'act') OR contains(p, 'ordinance')) THEN 'primary_implementation'
WHEN contains(f, 'guidelines') OR contains(f, 'instructions') THEN 'procedural_guidelines' WHEN contains(f, 'act') THEN 'primary_implementation' ELSE 'procedural_guidelines' END AS role FROM f)
SELECT document_id, role, CASE role WHEN 'primary_implementation' THEN 1.0 WHEN 'amendment' THEN 0.95 WHEN 'clarification' THEN 0.7 WHEN 'procedural_guidelines' THEN 0.6 WHEN 'financial_sanction' THEN 0.4 ELSE 0.2 END::DOUBLE AS weight FROM r""")
register("cls_05_go_logic", lambda v: v("filings").select("document_id", *[F.array_join(x, ",").alias(n) for n, x in c.go_logic(F.col("text")).items()]),
         "SELECT document_id, " + ", ".join(
             f"coalesce(nullif(concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{k}' END" for k, p in labels.items())}), ''), '{c.LOGIC_DEFAULTS.get(kind, '')}') AS {kind}" for kind, labels in c.LOGIC.items()) + " FROM filings")


def _query_domains(v):
    kind = F.element_at(F.array(*map(F.lit, ("factual", "risk_analysis", "jurisdictional", "comparative"))), (F.col("k") % 4 + 1).cast("int"))
    text = F.concat(F.substring("text", 1, 60), F.element_at(F.array(*map(F.lit, (" quota and salary", " school fees", " state power", " nothing"))), (F.col("k") % 7 % 4 + 1).cast("int")))
    found = c.query_domains(text, kind)
    named = F.array_join(F.transform(found["domains"], lambda d: F.concat(d["domain"], F.lit(":"), d["confidence"].cast("string"))), ",")
    return v("papers").select("k", named.alias("domains"), *[F.array_join(found[n], ",").alias(n) for n in ("verticals", "primary_verticals", "binding_verticals", "impact_verticals")], found["depth"].alias("depth"))


register("cls_07_query_domains", _query_domains)
register("chk_02_pack_paragraphs", lambda v: v("papers").select("document_id", F.posexplode(ch.pack_paragraphs(ch.paragraphs(F.col("text")), 500, 1000, 80)).alias("place", "chunk")).withColumn("chunk", F.md5("chunk")))


def _go_chunks(v):
    return ch.chunk_go(v("filings").filter("vertical = 'go'"))


register("chk_04_chunk_go", lambda v: _go_chunks(v).withColumn("content", F.md5("content")), f"""
WITH {_CLAUSES}, {_ANNEX[len(_ANNEX.split('xa AS', 1)[0]):]},
idn AS (SELECT document_id, nullif(regexp_extract(substr(text, 1, 1000), '(?i)G\\.?O\\.?(?:Ms|Rt)?\\.?\\s*No\\.?\\s*([0-9A-Z]+)', 1), '') AS raw, string_split(nullif(regexp_extract(substr(text, 1, 1000), '(?i)Dated?[:\\.]?\\s*([0-9]{{1,2}}[-/\\.][0-9]{{1,2}}[-/\\.][0-9]{{2,4}})', 1), ''), '-')[-1] AS y FROM filings WHERE vertical = 'go'),
nm AS (SELECT document_id, 'AP_GO_' || coalesce(CASE WHEN regexp_full_match(raw, '[0-9]+') THEN raw END, 'UNK') || '_' || coalesce(y, 'UNK') || '_P' AS named FROM idn),
eff AS (SELECT document_id, place, CASE WHEN contains(lower(content), 'supersedes') OR contains(lower(content), 'supersession') THEN CASE WHEN contains(lower(content), 'partially') OR contains(lower(content), 'to the extent') OR contains(lower(content), 'subject') THEN 'supersedes_partially' ELSE 'supersedes_entirely' END
  WHEN contains(lower(content), 'amend') THEN 'amends' WHEN contains(lower(content), 'clarif') THEN 'clarifies' END AS effect FROM pc),
al AS (SELECT nm.document_id, 0 AS p, 0 AS a, 0 AS b, 'preamble' AS section_type, 'low' AS priority, NULL AS canonical_id, NULL AS legal_effect, preamble AS content FROM nm JOIN z USING (document_id) WHERE preamble <> ''
UNION ALL SELECT nm.document_id, 1, cc.place, o, 'order_clause', 'high', named || clause_id, effect, clause_text FROM nm JOIN cc USING (document_id) JOIN eff ON eff.document_id = cc.document_id AND eff.place = cc.place
UNION ALL SELECT nm.document_id, 2, place, 0, 'annexure', 'supporting', NULL, NULL, content FROM nm JOIN xc USING (document_id)),
ix AS (SELECT *, CASE WHEN p = 2 THEN 1000 + a ELSE row_number() OVER (PARTITION BY document_id ORDER BY p, a, b) - 1 END AS chunk_index FROM al)
SELECT document_id, document_id || '_chunk_' || chunk_index AS chunk_id, CAST(chunk_index AS INT) AS chunk_index, section_type, priority, canonical_id, legal_effect, md5(content) AS content FROM ix""")
for _name, _kind, _job in (("chk_05_chunk_legal", "legal", ch.chunk_legal), ("chk_06_chunk_judicial", "judicial", ch.chunk_judicial), ("chk_07_chunk_data", "data", ch.chunk_data), ("chk_08_chunk_scheme", "scheme", ch.chunk_scheme)):
    register(_name, lambda v, k=_kind, j=_job: j(v("filings").filter(F.col("vertical") == k)))
register("chk_09_chunk_stats", lambda v: ch.chunk_stats(v("chunks").join(v("papers").select("document_id", F.col("doc_type").alias("vertical")), "document_id").withColumnRenamed("text", "content")), r"""
SELECT p.doc_type AS vertical, document_id, count(*) AS n_chunks, CAST(sum(len(regexp_extract_all(c.text, '\S+'))) AS BIGINT) AS n_words, round(avg(length(c.text)), 6) AS avg_chars, min(length(c.text)) AS min_chars, max(length(c.text)) AS max_chars,
CAST(sum(len(string_split(c.text, chr(10)))) AS BIGINT) AS n_lines, grouping_id(p.doc_type, document_id) AS level FROM chunks c JOIN papers p USING (document_id) GROUP BY ROLLUP (p.doc_type, document_id)""")
_FORM = r"trim(lower(nfc_normalize(regexp_replace(regexp_replace({}, '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g'))))"
register("cln_11_locate_snippet", lambda v: v("papers").select("document_id", u.locate_excerpt(F.col("text"), F.concat(F.lit(" \n"), F.replace(F.substring("text", 40, 50), F.lit(" "), F.lit("\t ")))).alias("at")),
         f"SELECT document_id, CAST(instr({_FORM.format('text')}, {_FORM.format("' ' || chr(10) || replace(substr(text, 40, 50), ' ', chr(9) || ' ')")}) - 1 AS INT) AS at FROM papers")
register("cln_01_normalize_unicode", lambda v: v("dirty").select("doc_id", F.md5(u.normalize_unicode(F.col("text"))).alias("normalized_md5")))
register("ent_02_act_mentions", lambda v: v("filings").select("document_id", F.array_join(m.act_mentions(F.concat(F.lit("Under the Andhra Pradesh Education Act, 1982: and the School Fees Regulation Act. "), F.col("text"))), "|").alias("acts")))


def _offices(v):
    return F.split(F.concat(F.lit("School  Education|To\nAll|abc|Copy to all|Higher"), F.col("k").cast("string"), F.lit("|"), F.substring("text", 1, 250)), r"\|")


register("ent_03_sanitize_departments", lambda v: v("papers").select("document_id", F.array_join(m.sane_departments(_offices(v)), "|").alias("departments")), rf"""
WITH d AS (SELECT document_id, unnest(string_split('School  Education|To' || chr(10) || 'All|abc|Copy to all|Higher' || k || '|' || substr(text, 1, 250), '|')) AS d, generate_subscripts(string_split('School  Education|To' || chr(10) || 'All|abc|Copy to all|Higher' || k || '|' || substr(text, 1, 250), '|'), 1) AS i FROM papers),
t AS (SELECT document_id, i, {trim("d")} AS d FROM d), k AS (SELECT document_id, i, regexp_replace(d, '\s+', ' ', 'g') AS d FROM t WHERE length(d) BETWEEN 5 AND 200 AND len(string_split(d, chr(10))) <= 3 AND NOT regexp_matches(d, '(?i)SECRETARY TO GOVERNMENT|To\n|\n\n+|Copy to|Forwarded|/Sd/-|\(Sd\)|Date:|From:|Subject:'))
SELECT document_id, string_agg(d, '|' ORDER BY i) AS departments FROM k GROUP BY 1""")
register("ent_04_structure_dates", lambda v: v("papers").select("document_id", F.array_join(F.transform(m.structured_dates(F.array(F.lit("2019-05-06"), F.concat((F.col("k") % 28 + 1).cast("string"), F.lit("/5/2019")), F.lit("6.5.2019"), F.lit("May 2019"))), lambda d: d["value"]), ",").alias("dates")), """
SELECT document_id, CASE WHEN k % 28 + 1 = 6 THEN '2019-05-06' ELSE '2019-05-06,2019-05-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') END AS dates FROM papers""")


def _sources(v):
    rows = v("papers").select(F.col("k").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(t).alias("entity_type"), F.lit(i).alias("pos"), x.cast("string").alias("value")) for i, (t, x) in enumerate((("acts", F.col("k") % 3), ("acts", F.col("k") % 5), ("go_archetype", F.lit("financial")), ("years", F.lit("2019")), ("rules", F.lit(""))))])).alias("x"))
    rows = rows.select("doc_id", "x.*")
    return rows, rows.withColumn("value", F.when(F.col("entity_type") == "go_archetype", "normative").otherwise((F.col("doc_id") % 4).cast("string")))


register("ent_05_merge_entities", lambda v: m.merge_entities(*_sources(v)), """
WITH a AS (SELECT k, 0 AS s, 0 AS p, 'acts' AS t, CAST(k % 3 AS VARCHAR) AS x FROM papers UNION ALL SELECT k, 0, 1, 'acts', CAST(k % 5 AS VARCHAR) FROM papers UNION ALL SELECT k, 1, 0, 'acts', CAST(k % 4 AS VARCHAR) FROM papers UNION ALL SELECT k, 1, 1, 'acts', CAST(k % 4 AS VARCHAR) FROM papers
UNION ALL SELECT k, 1, 2, 'go_archetype', 'normative' FROM papers UNION ALL SELECT k, 1, 4, 'rules', CAST(k % 4 AS VARCHAR) FROM papers), f AS (SELECT k, t, x, min((s, p)) AS sp FROM a GROUP BY 1, 2, 3)
SELECT k AS doc_id, t AS entity_type, CAST(row_number() OVER (PARTITION BY k, t ORDER BY sp, x) - 1 AS INT) AS pos, x AS value FROM f""")


def _contract(v):
    rows = v("papers").select(
        F.col("k").alias("doc_id"), F.element_at(F.array(F.lit("normative"), F.lit("odd"), F.lit(None).cast("string")), (F.col("k") % 3 + 1).cast("int")).alias("go_archetype"),
        F.array(F.struct(F.when(F.col("k") % 4 == 0, "2019-5-6").otherwise("2019-05-06").alias("value"), F.when(F.col("k") % 5 == 0, "birthday").otherwise("issue_date").alias("role"))).alias("dates"),
        F.array(F.when(F.col("k") % 7 == 0, "Secretary to Government").otherwise("School Education")).alias("departments"), F.array(F.struct(F.when(F.col("k") % 11 == 0, "").otherwise("Act").alias("act_name"), F.lit("2019").alias("act_year"))).alias("acts"),
        F.when(F.col("k") % 13 == 0, "2019").alias("years"))
    good, bad = m.validate_contract(rows)
    return good.select("doc_id", F.lit("").alias("errors")).unionByName(bad)


register("ent_06_validate_contract", _contract, """
SELECT k AS doc_id, concat_ws('; ', CASE WHEN k % 13 = 0 THEN 'forbidden field years' END, CASE WHEN k % 3 = 1 THEN 'archetype' END, CASE WHEN k % 4 = 0 THEN 'date format' END, CASE WHEN k % 5 = 0 THEN 'date role' END, CASE WHEN k % 7 = 0 THEN 'department' END, CASE WHEN k % 11 = 0 THEN 'act' END) AS errors FROM papers""")


def _answers(v):
    body = F.concat(F.lit('{"go_archetype": "'), F.element_at(F.array(*map(F.lit, ("normative", "financial_sanction", "odd"))), (F.col("k") % 3 + 1).cast("int")), F.lit('", "legal_actions": [{"action": "amends", "target": "G.O. '), F.col("k"), F.lit('"}, {"action": "sings", "target": "x"}], "dates": [{"value": "2019-05-06", "role": "issue_date"}, {"value": "2020-01-01", "role": "issue_date"}], "specialized_terms": ["A: b"]}'))
    answer = F.when(F.col("k") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("k") % 5 == 1, F.lit("sorry")).otherwise(body)
    got = m.parse_model_output(v("papers").select(F.col("k").alias("doc_id"), answer.alias("answer")))
    return got.select("doc_id", "go_archetype", F.array_join(F.transform("legal_actions", lambda a: F.concat_ws(" ", a["action"], a["target"])), "|").alias("actions"), F.array_join(F.transform("dates", lambda d: d["value"]), "|").alias("dates"), F.array_join("specialized_terms", "|").alias("terms"), "parse_error")


register("ent_07_parse_model_output", _answers, """
SELECT k AS doc_id, CASE WHEN k % 5 = 1 THEN NULL WHEN k % 3 = 0 THEN 'normative' WHEN k % 3 = 1 THEN 'financial' END AS go_archetype, CASE WHEN k % 5 = 1 THEN '' ELSE 'amends G.O. ' || k END AS actions,
CASE WHEN k % 5 = 1 THEN '' ELSE '2019-05-06' END AS dates, CASE WHEN k % 5 = 1 THEN '' ELSE 'A: b' END AS terms, k % 5 = 1 AS parse_error FROM papers""")
register("ent_09_thesaurus", lambda v: m.thesaurus(v("papers").select(F.explode(F.array(F.concat(F.lit(" t"), (F.col("k") % 30).cast("string"), F.lit(" : sense: "), (F.col("k") % 7).cast("string")), F.lit("plain"))).alias("term"))).withColumn("definitions", F.array_join("definitions", "|")), """
SELECT 'T' || (k % 30) AS acronym, string_agg(DISTINCT 'sense: ' || (k % 7), '|' ORDER BY 'sense: ' || (k % 7)) AS definitions FROM papers GROUP BY 1""")


def _tagged(v):
    rows = v("letters").withColumn("numbers", e.found_entities(F.col("text"), "go_numbers")).withColumn("sections", e.found_entities(F.col("text"), "sections"))
    tag = lambda c_, t: F.transform(c_, lambda x: F.struct(F.lit(t).alias("type"), x.alias("value")))
    return rows.select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(tag("numbers", "go"), tag("sections", "section")).alias("entities"))


register("ent_10_chunks_with_entity", lambda v: m.chunks_with_entity(_tagged(v), "section").withColumn("matches", F.array_join("matches", "|")), r"""
WITH s AS (SELECT doc_id, list_sort(list_distinct(list_transform(""" + " || ".join(f"regexp_extract_all(coalesce(text, ''), '{p}', 1)" for p in e.ENTITIES["sections"][1]) + rf""", lambda x: CASE WHEN starts_with(x, '{e.ENTITIES["sections"][0].strip()}') THEN x ELSE '{e.ENTITIES["sections"][0]}' || x END))) AS l FROM letters)
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, array_to_string(l, '|') AS matches, CAST(len(l) AS INT) AS n FROM s WHERE len(l) > 0""")


def _chunk_entities(v):
    words = lambda n: F.slice(F.split(F.substring("text", 1, 400), " "), 3, n)
    own = v("papers").select("document_id", words(5).alias("go_numbers"), words(2).alias("sections"), F.transform(words(4), F.lower).alias("departments"), F.array(F.lit("nothing like it")).alias("schemes"))
    return m.chunk_entities(v("chunks"), own).select("chunk_id", *[F.array_join(k, "|").alias(k) for k in m.CHUNK_LIMITS])


register("ent_11_chunk_entities", _chunk_entities, """
WITH w AS (SELECT document_id, string_split(substr(text, 1, 400), ' ') AS l FROM papers)
SELECT chunk_id, array_to_string(list_filter(l[3:7], lambda x: contains(text, x))[1:3], '|') AS go_numbers, array_to_string(list_filter(l[3:4], lambda x: contains(text, x))[1:3], '|') AS sections,
array_to_string(list_filter(list_transform(l[3:6], lambda x: lower(x)), lambda x: contains(lower(text), lower(x)))[1:2], '|') AS departments, '' AS schemes FROM chunks JOIN w USING (document_id)""")
