"""Structure of orders, acts, judgments, schemes and reports: column expressions from text to rows.

Everything stays in built-in expressions on one row, so parsing needs no shuffle.  (?d) makes
line ends mean \\n only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import bound, spans, strip

#: Patterns of an order's parts.
GO_NUMBER = r"(?i)G\.?O\.?(?:Ms|Rt)?\.?\s*No\.?\s*([0-9A-Z]+)"
GO_DATE = r"(?i)Dated?[:\.]?\s*(\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4})"
GO_DEPARTMENT = r"(?i)(?:Department|Dept\.?)\s+of\s+([A-Z][A-Za-z\s&]+?)(?:,|\.|\n)"
ORDER_START = r"(?imd)^\s*ORDER[S]?\s*:?\s*$"
ANNEXURE_START = r"(?imd)^\s*ANNEXURE"
PREAMBLE_END = r"(?i)(?:NOW,?\s+THEREFORE|WHEREAS|In exercise of)"
PREAMBLE_REFERENCE = r"(?i)G\.?O\.?(?:Ms|Rt)?\.?\s*No\.?\s*(\d+)"
PARAGRAPH = r"(?md)^\s*((?:(?:\d+|[a-zA-Z]+)[\.\)]|(?:\d+|[a-zA-Z]+)\([0-9a-zA-Z]+\)\.?|\([0-9a-zA-Z]+\)))\s+"
CLAUSE = r"(?:\s|^)\(([IVXivx0-9a-z]+)\)"
PROVISO = r"(?i)\.\s+(Provided that|Subject to)"
ANNEXURE = r"(?i)(ANNEXURE\s*[-:\s]?[IVX0-9]+)"
EFFECTIVE = [r"(?i)comes?\s+into\s+force\s+(?:with\s+effect\s+)?from\s+([0-9\-\./]+)", r"(?i)effective\s+from\s+([0-9\-\./]+)"]
_TAIL = r"(?:[:\.\s]+(.+?))?$"
_NUMBER = r"(\d+[A-Z]?(?:\([0-9a-zA-Z]+\))?)"
#: Headings of an act.
LEGAL_NODES = {
    "section": rf"(?imd)^\s*Section\s+{_NUMBER}{_TAIL}", "article": rf"(?imd)^\s*Article\s+{_NUMBER}{_TAIL}", "rule": rf"(?imd)^\s*Rule\s+{_NUMBER}{_TAIL}",
    "regulation": rf"(?imd)^\s*Regulation\s+(\d+|[IVX]+){_TAIL}", "norm": rf"(?imd)^\s*Norm\s*(?:[sS])?\s+(\d+|[IVX]+){_TAIL}",
    "schedule": rf"(?imd)^\s*(?:THE\s+)?SCHEDULE\s+([IXV0-9A-Z]+){_TAIL}", "appendix": rf"(?imd)^\s*APPENDIX\s+([IXV0-9A-Z]+){_TAIL}",
}
CHAPTER, PART = rf"(?imd)^\s*CHAPTER\s+([IVXLCDM]+|\d+){_TAIL}", rf"(?imd)^\s*PART\s+([IVXLCDM]+|\d+){_TAIL}"
BOUNDARY = r"(?imd)^\s*(Section|Sec\.?|Article|Rule|Regulation|Norm\s*s?|CHAPTER|PART|(?:THE\s+)?SCHEDULE|APPENDIX)\s+"
SUBCLAUSE = r"(?imd)^\s*\(([0-9a-zA-Z]|[ivx]+)\)\s+"
ACT = r"(?i)(?:THE\s+)?(.+?)\s+\b(Act|Rules|Regulations|Regulation|Rule|Norms|Norm|Appendix|Ordinance)\b(?:,?\s+(\d{4}))?"
ACT_WORD = r"(?i)\s(?:Act|Rules?|Regulations?|Norms?|Appendix|Ordinance)\b"
ACT_LAST = rf"(?s)\A.*{ACT_WORD}(?:,?\s+\d{{4}})?"
ACT_WORDS = ["be it enacted", "constitution of india", "notified", "regulation", "rules", "norms", "appendix", "ordinance"]
#: First marks of a judgment's sections, in order of precedence at one place.
JUDGMENT_SECTIONS = {
    "headnote": r"(?i)(?:HEADNOTE|CATCHWORDS|SYLLABUS)[:\s]", "facts": r"(?i)(?:FACTS?|BACKGROUND|FACTUAL BACKGROUND|BRIEF FACTS)[:\s]",
    "issues": r"(?i)(?:ISSUES?|QUESTIONS? OF LAW|POINTS? FOR DETERMINATION)[:\s]",
    "arguments_petitioner": r"(?i)(?:SUBMISSIONS?\s+BY\s+THE\s+PETITIONER|ARGUMENTS?\s+OF\s+THE\s+APPELLANT|CONTENTIONS?\s+OF\s+THE\s+PETITIONER)[:\s]",
    "arguments_respondent": r"(?i)(?:SUBMISSIONS?\s+BY\s+THE\s+RESPONDENT|ARGUMENTS?\s+OF\s+THE\s+STATE|CONTENTIONS?\s+OF\s+THE\s+RESPONDENT)[:\s]",
    "ratio": r"(?i)(?:RATIO|RATIO DECIDENDI|REASONING|ANALYSIS|DISCUSSION|CONSIDERATION)[:\s]",
    "judgment": r"(?i)(?:JUDGMENT|DECISION|ORDER|HELD|CONCLUSION|COMMON JUDGMENT)[:\s]",
}
#: First marks of a scheme's sections.
SCHEME_SECTIONS = {
    "objective": r"(?imd)^(?:OBJECTIVE|OBJECTIVES|PURPOSE|AIM)[:\s]", "eligibility": r"(?imd)^(?:ELIGIBILITY|ELIGIBLE|WHO CAN APPLY|ELIGIBILITY CRITERIA)[:\s]",
    "benefits": r"(?imd)^(?:BENEFITS?|ASSISTANCE|FINANCIAL AID|PROVISIONS)[:\s]", "application": r"(?imd)^(?:HOW TO APPLY|APPLICATION|APPLICATION PROCESS|PROCEDURE)[:\s]",
    "implementation": r"(?imd)^(?:IMPLEMENTATION|EXECUTION|MONITORING|ADMINISTRATION)[:\s]",
}
SCHEME_NAME = r"(?i)(Jagananna\s+[A-Za-z\s]+|Amma\s+[A-Za-z\s]+(?:Scheme|Program)|\w+\s+(?:Scheme|Yojana|Program))"
BULLET = r"(?md)^(?:[\•\-\*]|\d+\.|\([a-z]\))\s+(.+?)$"
#: Patterns of a judgment's identity and outcome, first match first.
CASE_NUMBER = r"(?i)(?:Case|Petition|Appeal|Crl\.A\.|W\.P\.|RT)\s*(?:No\.?|No(?:s)?\.?)\s*(\d+(?:/\d+)?(?:\(?\w+\)?)*)"
COURT = r"(?i)(?:Supreme\s+Court\s+of\s+India|High\s+Court\s+of\s+[A-Za-z\s]+|District\s+Court\s+at\s+[A-Za-z\s]+|IN\s+THE\s+HIGH\s+COURT\s+OF\s+[A-Za-z\s]+)"
DECIDED = r"(?i)(?:Dated?|Date\s+of\s+Decision)[:\s]+(\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4})"
BENCH = r"(?i)(?:BEFORE|CORAM|PRESENT|Bench)[:\s]+([^\n]*)"
PARTIES = r"(?is)Between[:\s\n]+(.*?)\n\s*AND\s*\n?(.*?)(?=\n\s*(?:JUDGMENT|ORDER|PRESENT|[:A-Z]+|$))"
CITATION = r"(?i)\(\d{4}\)\s*\d+\s*[A-Z]{2,}\s*\d+"
PETITION = {
    "partly_allowed": r"(?i)(?:petition|appeal|writ)\s+(?:is\s+)?(?:partly|partially)\s+(?:allowed|granted)",
    "allowed": r"(?i)(?:petition|appeal|writ)\s+(?:is\s+)?(?:allowed|granted|accepted)", "dismissed": r"(?i)(?:petition|appeal|writ)\s+(?:is\s+)?(?:dismissed|rejected)",
}
ORDER_KIND = {
    "quashed": r"(?i)(?:order|decision|judgment)\s+(?:is\s+)?(?:quashed|set\s+aside)", "upheld": r"(?i)(?:order|decision|judgment)\s+(?:is\s+)?(?:upheld|confirmed|sustained)",
    "remanded": r"(?i)(?:matter|case)\s+(?:is\s+)?(?:remanded|sent\s+back)", "directions": r"(?i)(?:direct|direction|order)\s+(?:the|that)",
}
#: Kinds of reports, first match first.
REPORTS = {
    "UDISE+": r"(?i)UDISE\+|Unified\s+District\s+Information\s+System", "NAS": r"(?i)National\s+Achievement\s+Survey|NAS\s*20\d{2}",
    "Budget": r"(?i)Budget\s+Analysis|Budget\s+Estimates|Demand\s+for\s+Grants", "Annexure": r"(?i)Annexure|Appendix",
}


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(_text(text), pattern, group), F.lit(""))


def first_of(text: Column, patterns: dict[str, str]) -> Column:
    """Name of the first pattern of the table that the text holds."""
    return F.coalesce(*[F.when(F.regexp_like(_text(text), F.lit(p)), k) for k, p in patterns.items()])


def has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(_text(text), 256), 1, 8)


def go_identity(text: Column) -> dict[str, Column]:
    """Number, date, year, department, confidence, authority and id from the first 1,000 characters."""
    top = F.substring(_text(text), 1, 1000)
    raw, date = found(top, GO_NUMBER), found(top, GO_DATE)
    sure = F.coalesce(raw.rlike("^[0-9]+$"), F.lit(False))
    year = F.element_at(F.split(date, "-"), -1)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    number = F.when(sure, raw)
    return {
        "go_number": number, "raw_go_number": raw, "go_date": date, "year": year, "department": found(top, GO_DEPARTMENT),
        "confidence": F.when(sure, "high").otherwise("low"), "authority": F.when(sure, "authoritative").otherwise("non_authoritative"),
        "document_id": F.when(number.isNotNull() & year.isNotNull(), F.concat(F.lit("AP_GO_"), number, F.lit("_"), year))
        .otherwise(F.concat(F.lit("AP_GO_UNKNOWN_"), F.coalesce(year, F.lit("UNK")), F.lit("_"), short_hash(text))),
    }


def _cut(text: Column, pattern: str, **kept: Column) -> Column:
    """struct<text, found, parts> and what is kept: whether the pattern occurs, and the text before and behind its first match."""
    return F.struct(text.alias("text"), F.regexp_like(text, F.lit(pattern)).alias("found"), F.split(text, pattern, 2).alias("parts"), *[c.alias(n) for n, c in kept.items()])


def cut_order(text: Column) -> Column:
    """struct<preamble, orders, annexures>: split at ORDER, else behind the preamble's last words, else all orders."""
    before, behind = lambda c: c["parts"][0], lambda c: F.get(c["parts"], F.lit(1))
    split = lambda some, preamble, rest, text: F.struct(some.alias("some"), preamble.alias("preamble"), rest.alias("rest"), text.alias("text"))

    def opened(c: Column) -> Column:
        head = strip(F.concat(before(c), F.regexp_extract(c["text"], PREAMBLE_END, 0)))
        return split(c["found"], F.when(c["found"], head).otherwise(""), strip(F.when(c["found"], behind(c)).otherwise(c["text"])), c["text"])

    def ordered(c: Column) -> Column:
        return F.when(c["found"], split(c["found"], strip(before(c)), strip(behind(c)), c["text"])).otherwise(bound(_cut(c["text"], PREAMBLE_END), opened))

    def ended(c: Column) -> Column:
        whole, rest = c["whole"], c["text"]
        some = whole["some"] & c["found"]
        return F.struct(
            whole["preamble"].alias("preamble"), F.when(some, strip(before(c))).when(whole["some"], rest).otherwise(whole["text"]).alias("orders"),
            F.when(some, strip(F.substr(rest, F.length(before(c)) + 1))).otherwise("").alias("annexures"),
        )

    whole = bound(_cut(_text(text), ORDER_START), ordered)
    return bound(whole, lambda s: bound(_cut(s["rest"], ANNEXURE_START, whole=s), ended))


def go_sections(text: Column) -> dict[str, Column]:
    """Preamble, orders and annexures of cut_order."""
    cut = cut_order(text)
    return {k: cut[k] for k in ("preamble", "orders", "annexures")}


def go_paragraphs(orders: Column) -> Column:
    """array<struct<para_no, content, confidence>> of the numbered paragraphs; one of low confidence if none is."""
    orders = _text(orders)
    found = F.struct(orders.alias("text"), F.regexp_extract_all(orders, F.lit(PARAGRAPH), F.lit(1)).alias("numbers"), F.split(orders, PARAGRAPH, -1).alias("parts"))

    def listed(f: Column) -> Column:
        rows = F.zip_with(f["numbers"], F.slice(f["parts"], 2, F.greatest(F.size(f["parts"]) - 1, F.lit(0))), lambda n, c: F.struct(
            F.regexp_replace(n, r"^[.)]+|[.)]+$", "").alias("para_no"), strip(c).alias("content"), F.lit("high").alias("confidence")))
        whole = F.array(F.struct(F.lit("1").alias("para_no"), f["text"].alias("content"), F.lit("low").alias("confidence")))
        return F.when(F.size(f["numbers"]) > 0, rows).otherwise(whole)

    return F.when(orders == "", F.array().cast("array<struct<para_no:string,content:string,confidence:string>>")).otherwise(bound(found, listed))


def preamble_references(preamble: Column) -> Column:
    """array<struct<ref_text, number, confidence>> of the orders that a preamble names, in order, repeats included."""
    names, numbers = (F.regexp_extract_all(_text(preamble), F.lit(PREAMBLE_REFERENCE), F.lit(g)) for g in (0, 1))
    return F.zip_with(names, numbers, lambda n, d: F.struct(n.alias("ref_text"), d.alias("number"), F.lit("explicit").alias("confidence")))


def order_semantics(content: Column) -> dict[str, Column]:
    """Effect, scope, whether it invalidates, numbers it points at and when it takes effect."""
    low = F.lower(_text(content))
    replaces, partly = has(low, "supersedes", "supersession"), has(low, "partially", "to the extent", "subject")
    return {
        "legal_effect": F.when(replaces & partly, "supersedes_partially").when(replaces, "supersedes_entirely").when(low.contains("amend"), "amends").when(low.contains("clarif"), "clarifies"),
        "override_scope": F.when(replaces & partly, F.when(low.contains("orders issued"), "specific_para").otherwise("subject_only")).when(replaces, "entire_go").when(low.contains("amend"), "specific_para"),
        "invalidates_prior": has(low, "hereby rescinded", "stands repealed") | (low.contains("supersedes") & low.contains("entirety")),
        "target_numbers": F.regexp_extract_all(_text(content), F.lit(GO_NUMBER), F.lit(1)),
        "effective_from": F.coalesce(*[found(content, p) for p in EFFECTIVE]),
    }


def _operator(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("shall"), "shall").when(low.contains("must"), "must").when(low.contains("may"), "may")


def go_clauses(content: Column, para_no: Column) -> Column:
    """array<struct<clause_id, clause_text, legal_operator, has_condition>> of a paragraph."""
    content = _text(content)
    def clause(id_, text, operator, condition):
        return F.struct(id_.alias("clause_id"), text.alias("clause_text"), operator.alias("legal_operator"), condition.alias("has_condition"))

    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<clause_id:string,clause_text:string,legal_operator:string,has_condition:boolean>>")
    marks, parts = F.regexp_extract_all(content, F.lit(CLAUSE), F.lit(1)), F.split(content, CLAUSE, -1)
    behind = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda t: F.regexp_replace(t, r"^[ ;,.]+|[ ;,.]+\z", "")
    listed = F.zip_with(marks, behind, lambda m, t: clause(F.concat(para_no, F.lit("("), m, F.lit(")")), body(t), _operator(body(t)), has(F.lower(body(t)), "subject to", "provided")))
    head = strip(F.element_at(parts, 1))
    before = F.when(head != "", F.array(clause(F.concat(para_no, F.lit("(pre)")), head, none, F.lit(False)))).otherwise(empty)
    provisos, pieces = F.regexp_extract_all(content, F.lit(PROVISO), F.lit(1)), F.split(content, PROVISO, -1)
    main = F.array(clause(F.concat(para_no, F.lit("(main)")), strip(F.element_at(pieces, 1)), _operator(content), F.lit(False)))
    numbered = F.zip_with(provisos, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda m, t: strip(F.concat(m, F.lit(" "), t)))
    rest = F.transform(numbered, lambda t, i: clause(F.concat(para_no, F.lit("(proviso_"), (i + 1).cast("string"), F.lit(")")), t, none, F.lit(True)))
    one = F.array(clause(para_no, content, _operator(content), F.lower(content).contains("subject to")))
    return F.when(F.size(marks) > 0, F.concat(before, listed)).when(F.size(provisos) > 0, F.concat(main, rest)).otherwise(one)


def annexures(text: Column) -> Column:
    """array<struct<annexure_id, content, kind>>; one ANNEXURE-GEN where no heading is found."""
    text = _text(text)
    heads, parts = F.regexp_extract_all(text, F.lit(ANNEXURE), F.lit(1)), F.split(text, ANNEXURE, -1)
    rows = F.zip_with(heads, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda h, c: F.struct(
        F.upper(F.replace(strip(h), F.lit(" "), F.lit("-"))).alias("annexure_id"), strip(c).alias("content"),
        F.when(strip(c).rlike(r"(?d)\|.*\||\s{4,}"), "table").otherwise("text").alias("kind")))
    whole = F.array(F.struct(F.lit("ANNEXURE-GEN").alias("annexure_id"), text.alias("content"), F.lit("text").alias("kind")))
    return F.when(text == "", F.array().cast("array<struct<annexure_id:string,content:string,kind:string>>")).when(F.size(heads) > 0, rows).otherwise(whole)


def legal_nodes(text: Column) -> Column:
    """Headed nodes of an act by place, each bound to the last part and chapter before it.

    array<struct<start, section_type, number, title, content, n_clauses, confidence, part,
    chapter>>; content runs to the next boundary of any kind.
    """
    text = _text(text)
    parts, chapters = spans(text, PART), spans(text, CHAPTER)
    nodes = []
    for kind, pattern in LEGAL_NODES.items():
        nodes.append(_nodes(text, spans(text, pattern), kind, pattern, parts, chapters))
    return F.array_sort(F.concat(*nodes))


def _nodes(text: Column, hits: Column, kind: str, pattern: str, parts: Column, chapters: Column) -> Column:
    def last_before(markers: Column, start: Column) -> Column:
        return F.try_element_at(F.filter(markers, lambda m: m["start"] < start), F.lit(-1))["value"]

    def node(h: Column) -> Column:
        raw = strip(F.regexp_extract(h["matched"], pattern, 2))
        dash = F.locate("—", raw)
        title = F.when(dash > 0, strip(F.substr(raw, F.lit(1), dash - 1))).otherwise(F.nullif(raw, F.lit("")))
        inline = F.when(dash > 0, strip(F.substr(raw, dash + 1))).otherwise("")
        after = strip(F.element_at(F.split(F.substr(text, h["start"] + F.length(h["matched"]) + 1), BOUNDARY, 2), 1))
        content = F.when(inline != "", strip(F.concat(inline, F.lit("\n"), after))).otherwise(after)
        doubt = F.when(F.length(content) < 30, 0.3).otherwise(0.0) + F.when(h["value"].rlike("[0-9][A-Z]"), 0.4).otherwise(0.0) + F.when(has(content, "�", "\x00"), 0.2).otherwise(0.0)
        return F.struct(
            h["start"].alias("start"), F.lit(kind).alias("section_type"), h["value"].alias("number"), title.alias("title"), content.alias("content"),
            F.size(F.regexp_extract_all(content, F.lit(SUBCLAUSE), F.lit(1))).alias("n_clauses"), F.round(F.greatest(1.0 - doubt, F.lit(0.3)), 6).alias("confidence"),
            last_before(parts, h["start"]).alias("part"), last_before(chapters, h["start"]).alias("chapter"),
        )

    return F.transform(hits, node)


def act_name(text: Column) -> Column:
    """Name of an act or rules: the last name of the first line of the top that holds one.

    Only lines with one of the words are searched, up to the last of these, since behind it
    every place would be tried to the line's end; a line's names are found once, and the last
    is then taken apart.
    """
    text = _text(text)
    top = F.lower(F.substring(text, 1, 3000))

    def named(line: Column) -> Column:
        upto = F.regexp_extract(line, ACT_LAST, 0)
        return F.struct(line.alias("line"), F.try_element_at(F.regexp_extract_all(upto, F.lit(ACT), F.lit(0)), F.lit(-1)).alias("found"))

    def parts(x: Column) -> Column:
        group = lambda g: F.regexp_extract(x["found"], ACT, g)
        return F.struct(x["line"].alias("line"), strip(group(1)).alias("title"), group(2).alias("word"), group(3).alias("year"))

    def name(x: Column) -> Column:
        full = F.concat(x["title"], F.lit(" "), x["word"], F.when(x["year"] != "", F.concat(F.lit(", "), x["year"])).otherwise(""))
        return F.when(F.length(x["line"]) < 5, None).when(x["title"].isNotNull(), F.when(F.length(x["title"]) <= 150, full)).when(F.lower(x["line"]).contains("norms") & (F.length(x["line"]) < 100), x["line"])

    lines = F.filter(F.split(F.substring(text, 1, 2500), "\n"), lambda x: x.rlike(ACT_WORD) | F.lower(x).contains("norms"))
    names = F.transform(F.transform(F.transform(F.transform(lines, strip), named), parts), name)
    first = F.try_element_at(F.filter(names, lambda x: x.isNotNull()), F.lit(1))
    return F.when(has(top, *ACT_WORDS), F.coalesce(first, F.when(top.contains("constitution of india"), "Constitution of India")))


def marked_sections(text: Column, marks: dict[str, str], before: str) -> Column:
    """array<struct<start, section_type, content>>: from each mark's first match to the next mark.

    What precedes the first is a section called `before`; without marks all is one, `content`.
    """
    text = _text(text)
    places = F.array_sort(F.array_compact(F.array(*[
        F.when(F.regexp_like(text, F.lit(p)), F.struct(F.length(F.element_at(F.split(text, p, 2), 1)).alias("start"), F.lit(i).alias("i"), F.lit(k).alias("section_type")))
        for i, (k, p) in enumerate(marks.items())
    ])))

    def sections(m: Column) -> Column:
        found, text = m["places"], m["text"]

        def cut(m: Column, i: Column) -> Column:
            end = F.coalesce(F.get(found, i + 1)["start"], F.length(text))
            return F.struct(m["start"].alias("start"), m["section_type"].alias("section_type"), strip(F.substr(text, m["start"] + 1, end - m["start"])).alias("content"))

        head = F.struct(F.lit(0).alias("start"), F.lit(before).alias("section_type"), strip(F.substr(text, F.lit(1), F.get(found, F.lit(0))["start"])).alias("content"))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.lit("content").alias("section_type"), text.alias("content")))
        cuts = F.filter(F.concat(F.array(head), F.transform(found, cut)), lambda s: s["content"] != "")
        return F.when(F.size(found) == 0, whole).otherwise(cuts)

    empty = F.array().cast("array<struct<start:int,section_type:string,content:string>>")
    return F.when(text == "", empty).otherwise(bound(F.struct(text.alias("text"), places.alias("places")), sections))


def judgment_sections(text: Column) -> Column:
    return marked_sections(text, JUDGMENT_SECTIONS, "preamble")


def scheme_sections(text: Column) -> Column:
    return marked_sections(text, SCHEME_SECTIONS, "overview")


def scheme_name(text: Column) -> Column:
    return strip(found(F.substring(_text(text), 1, 500), SCHEME_NAME))


def bullets(sections: Column, kind: str) -> Column:
    """Bullet lines of the first section of a kind."""
    own = F.try_element_at(F.filter(sections, lambda s: s["section_type"] == kind), F.lit(1))["content"]
    return F.transform(F.regexp_extract_all(_text(own), F.lit(BULLET), F.lit(1)), strip)


def judgment_parties(text: Column) -> dict[str, Column]:
    """Petitioner and respondent as the first 3,000 characters name them behind "Between"; null if they don't."""
    top = F.substring(_text(text), 1, 3000)
    return {"petitioner": strip(found(top, PARTIES, 1)), "respondent": strip(found(top, PARTIES, 2))}


def judgment_identity(text: Column) -> dict[str, Column]:
    """Court, case, date, bench, citation, level, binding scope, jurisdiction, strength and outcome."""
    text = _text(text)
    top, end = F.substring(text, 1, 3000), F.when(F.length(text) > 2000, F.substring(text, -2000, 2000)).otherwise(text)
    court, bench = found(top, COURT, 0), found(top, BENCH, 0)
    low, guide = F.lower(court), has(F.lower(F.substring(text, 1, 1000)), "guidelines", "manual")
    level = F.when(low.contains("supreme court"), "supreme_court").when(low.contains("high court"), "high_court").when(low.contains("tribunal"), "tribunal").when(low.contains("district"), "district_court")
    binding = F.when(level.isin("supreme_court", "high_court"), "binding").when(level.isNotNull(), "persuasive").otherwise("informative")
    judges = (F.length(bench) - F.length(F.replace(F.lower(bench), F.lit("justice"), F.lit("")))) / 7
    return {
        "court": court, "bench": bench, "case_number": found(top, CASE_NUMBER), "decided": found(top, DECIDED), "citation": found(top, CITATION, 0),
        "doc_type": F.when(guide, "guidelines").otherwise("judgment"), "court_level": level,
        "binding_scope": F.when(court.isNull() | guide, "informative").otherwise(binding),
        "jurisdiction": F.when(level == "supreme_court", "Nationwide").when((level == "high_court") & ~has(low, "andhra pradesh", "ap"), "India").otherwise("AP"),
        "bench_strength": F.when(judges > 0, judges.cast("int")), "petition_result": first_of(end, PETITION), "order_type": first_of(end, ORDER_KIND),
    }


def report_identity(text: Column, as_of_year: int) -> dict[str, Column]:
    """Kind, period, department, intent, years, currency and how far numbers can be trusted."""
    text = _text(text)
    top = F.substring(text, 1, 2000)
    kind, volume = F.coalesce(first_of(top, REPORTS), F.lit("Other Data Report")), found(top, r"(?i)Volume\s*[-:\s]*([IVX0-9]+)")
    kind = F.when((kind == "Budget") & volume.isNotNull(), F.concat(F.lit("Budget Volume "), volume)).otherwise(kind)
    period = found(top, r"20\d{2}[-\s/]\d{2,4}", 0)
    year = F.when(period.contains("-"), F.element_at(F.split(period, "-"), 1)).otherwise(period)
    low = F.lower(top)
    between = r"(\d{4})\s*(?:to|-)\s*(\d{4})"
    digits = F.length(F.regexp_replace(top, r"[^0-9]", "")) / F.greatest(F.lit(1), F.length(top))
    return {
        "report_type": kind, "period": period, "year": year, "department": strip(found(top, r"(?i)(?:Department|Dept\.?)\s+of\s+([A-Z][A-Za-z\s&]+?)(?:,|\.|\n|\z)")),
        "intent": F.when(has(F.lower(kind), "budget", "financial"), "financial").when(has(F.upper(kind), "UDISE", "NAS", "STATISTICS"), "statistical")
        .when(has(low, "guideline", "recommendation"), "recommendatory").otherwise("informational"),
        "financial_year": F.coalesce(found(top, r"(?i)(?:FY|Financial Year)\s*(\d{4}-\d{2,4})"), F.when(period.contains("-"), period)),
        "applicable_period": F.when(F.regexp_like(top, F.lit(between)), F.concat(F.regexp_extract(top, between, 1), F.lit("-"), F.regexp_extract(top, between, 2))),
        "is_historical": F.coalesce((F.lit(as_of_year) - year.try_cast("int")) > 2, F.lit(False)),
        "contains_financials": F.substring(text, 1, 3000).rlike(r"(?i)(?:Rs\.?|Rupees|INR)\s*(?:in\s+)?(?:Lakhs|Crores|Millions)?"),
        "numeric_confidence": F.when(top.rlike(r"\(cid:\d+\)"), "low").when(digits > 0.15, "high").otherwise("medium"),
    }


def table_cells(rows: Column) -> dict[str, Column]:
    """Trimmed cells of array<array<string>> rows, empty rows out, with headers, text and counts."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    kept = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    return {
        "headers": F.try_element_at(kept, F.lit(1)), "table_text": F.array_join(F.transform(kept, lambda r: F.array_join(r, " | ")), "\n"),
        "n_rows": F.size(kept), "n_columns": F.coalesce(F.size(F.try_element_at(kept, F.lit(1))), F.lit(0)),
    }
