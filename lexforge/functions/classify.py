"""Classification of documents and queries by keywords and patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .segments import as_re2
from .spans import bound

#: Keywords of each vertical, first vertical first.
VERTICALS = {
    "go": ["government order", "g.o.", "preamble", "order", "whereas", "now therefore", "annexure"],
    "legal": ["act", "rule", "section", "chapter", "clause", "amendment", "regulation", "statute"],
    "judicial": ["petitioner", "respondent", "judgment", "court", "honourable", "held that", "appeal", "writ", "case"],
    "data": ["table", "figure", "statistics", "data", "report", "survey", "analysis", "enrollment", "percentage"],
    "scheme": ["scheme", "eligibility", "beneficiary", "benefit", "implementation", "guidelines", "application", "assistance"],
}
#: Patterns of document types.
_AMENDMENT = r"(?i)Amendment|amends?\s+(?:the\s+)?(?:Act|Rules?)|in\s+(?:partial\s+)?amendment"
_ACT = r"(?i)(?:The\s+)?([A-Z][A-Za-z\s,\(\)]+)\s+Act(?:,?\s+\d{4})?|An\s+Act\s+to|BE\s+IT\s+ENACTED"
_RULE = r"(?i)(?:The\s+)?([A-Z][A-Za-z\s,\(\)]+)\s+Rules(?:,?\s+\d{4})?|In\s+exercise\s+of\s+the\s+powers|pursuant\s+to\s+Section"
_NOTIFICATION = r"(?i)NOTIFICATION|(?:is|are)\s+hereby\s+notified"
_CIRCULAR = r"(?i)CIRCULAR|for\s+information\s+and\s+(?:compliance|guidance)"
_JUDGMENT = r"(?i)JUDGMENT|CORAM[:\s]|(?:Hon'ble|Honourable)\s+(?:Justice|Judge)|(?:Petitioner|Appellant)\s+(?:Vs?\.?|versus)\s+(?:Respondent|Defendant)"
_COURT_ORDER = r"(?i)ORDER|the\s+(?:Court|Bench)\s+(?:orders?|directs?)"
_REPORT = r"(?i)(?:Annual|Quarterly|Monthly)\s+Report|REPORT\s+(?:ON|OF)|Executive\s+Summary"
_BUDGET = r"(?i)Budget\s+(?:Estimates?|Allocations?)|Financial\s+(?:Statement|Estimates?)"
_SCHEME = r"(?i)Scheme\s+(?:for|of)|(?:Eligibility|Benefits?)\s+under\s+the\s+scheme|Implementation\s+of\s+(?:the\s+)?scheme"
_GUIDELINES = r"(?i)GUIDELINES?|Standard\s+Operating\s+Procedures?|Instructions?\s+for"
#: Category of a document type.
CATEGORIES = {
    "go_order": "government_order", "go_notification": "government_order", "go_circular": "government_order", "act": "legislation", "rule": "legislation", "regulation": "legislation",
    "amendment": "legislation", "notification": "notification", "judgment": "judicial", "order": "judicial", "interim_order": "judicial", "report": "data_report", "statistics": "data_report",
    "budget": "data_report", "scheme_document": "scheme", "guidelines": "scheme",
}
#: Ranking weight of an order's role.
ROLE_WEIGHTS = {"primary_implementation": 1.0, "amendment": 0.95, "clarification": 0.7, "procedural_guidelines": 0.6, "financial_sanction": 0.4, "repeal": 0.2}
#: Labels of an order's logic, a pattern each, by kind; and the label where none of a kind fits.
LOGIC = {
    "go_effect": {
        "supersession": r"\bsupersede[sd]?\b|\bin\s+supersession\s+of\b|\breplaces?\b.*\bG\.?O\.?\b|\bin\s+place\s+of\b.*\bG\.?O\.?\b|\bstand[s]?\s+superseded\b",
        "amendment": r"\bamend[sment]*\b|\bin\s+(?:partial\s+)?modification\s+of\b|\bmodif(?:y|ies|ied)\b|\brevise[sd]?\b|\bsubstitute[sd]?\b",
        "cancellation": r"\bcancel[slation]*\b|\brescind[sed]?\b|\bwithdr[aw|awn]\b|\bnull\s+and\s+void\b",
        "clarification": r"\bclarif(?:y|ies|ied|ication)\b|\bfor\s+clarification\b|\bto\s+clarify\b|\bexplanation\b",
    },
    "applicability_scope": {
        "statewide": r"\ball\s+districts?\b|\bstate\s*wide\b|\bthroughout\s+(?:the\s+)?state\b|\ball\s+government\s+(?:schools?|institutions?)\b|\bentire\s+state\b|\bacross\s+the\s+state\b|\bin\s+the\s+state\b",
        "regional": r"\b(?:municipal|mandal|district|zone|division)\b|\bspecific\s+districts?\b|\bin\s+the\s+district\s+of\b|\bselected\s+(?:districts?|areas?)\b",
        "institutional": r"\bspecific\s+(?:school|college|institution)s?\b|\bnamed\s+institution\b|\bfollowing\s+(?:schools?|institutions?)\b",
    },
    "legal_effect": {
        "enforceable": r"\b(?:shall|must|mandatory|compulsory|required)\b|\bwith\s+immediate\s+effect\b|\bstrictly\s+(?:follow|adhere|comply)\b|\bordered\s+to\b|\bdirected\s+to\b|\bhereby\s+(?:ordered|directed)\b",
        "advisory": r"\b(?:may|should|recommend|suggest|advise)\b|\bguidance\b|\bfor\s+consideration\b|\bvoluntary\b",
    },
    "authority_level": {
        "cabinet": r"\bcabinet\b|\bcouncil\s+of\s+ministers\b|\bchief\s+minister\b", "secretary": r"\b(?:principal\s+)?secretary\b|\bsecretary\s+to\s+government\b", "director": r"\bdirector(?:ate)?\b|\bcommissioner\b",
    },
    "beneficiary_scope": {
        "teachers": r"\bteachers?\b|\bteaching\s+staff\b|\bfaculty\b|\beducators?\b|\blecturers?\b|\bprofessors?\b", "students": r"\bstudents?\b|\bpupils?\b|\blearners?\b|\bchildren\b|\bbeneficiaries\b",
        "officers": r"\bofficers?\b|\badministrative\s+staff\b|\bnon-teaching\s+staff\b|\bemployees?\b|\bofficials?\b", "institutions": r"\b(?:schools?|colleges?|institutions?)\b|\beducational\s+institutions?\b|\buniversities\b",
    },
    "financial_impact": {
        "budget": r"\b(?:budget|fund|allocation|expenditure|grant)\b|\b(?:Rs\.?|rupees|crores?|lakhs?|thousands?)\b|\bfinancial\s+(?:assistance|support|aid|provision)\b|\bsanction(?:ed)?\s+(?:amount|fund)\b|\b(?:payment|salary|stipend|scholarship)\b|\bINR\s*\d+\b",
    },
}
LOGIC_DEFAULTS = {"go_effect": "issuance", "applicability_scope": "statewide", "legal_effect": "enforceable", "financial_impact": "policy"}
_LAYERS = ("primary", "binding", "impact")
#: Keywords, layer (0 primary, 1 binding, 2 impact) and verticals of a query's domains.
QUERY_DOMAINS = {
    "constitutional": (["reservation", "quota", "equality", "discrimination", "fundamental right", "article 14", "article 15", "article 19", "article 21", "constitutional", "unconstitutional", "violates article",
                        "constitutional validity", "constitutional challenge", "fundamental rights", "equal protection"], 1, ["judicial", "legal"]),
    "labor": (["appointment", "recruitment", "hiring", "employment", "contract", "salary", "wages", "pay scale", "allowance", "pension", "gratuity", "retirement", "promotion", "transfer", "disciplinary", "suspension",
               "termination", "dismissal", "service rules", "labor law", "employment law"], 2, ["go", "legal"]),
    "finance": (["fee", "fees", "tuition", "charges", "payment", "budget", "allocation", "funding", "grant", "subsidy", "financial", "cost", "expenditure", "revenue", "tax", "levy", "financial commitment", "budget head"],
                2, ["go", "legal", "data"]),
    "social_justice": (["minority", "minorities", "backward class", "sc", "st", "obc", "reservation", "quota", "affirmative action", "social justice", "equity", "inclusion", "access", "disadvantaged"], 2, ["go", "legal", "judicial"]),
    "administrative": (["administrative", "delegation", "administrative action", "quasi-judicial", "administrative tribunal", "administrative law", "natural justice", "procedural fairness", "administrative decision"],
                       1, ["judicial", "legal"]),
    "federalism": (["state", "central", "union", "federal", "concurrent list", "state list", "union list", "jurisdiction", "jurisdictional", "state vs central", "federal structure", "concurrent power", "state power"],
                   1, ["judicial", "legal", "go"]),
    "consumer": (["consumer", "unfair practice", "consumer protection", "consumer rights", "refund", "compensation", "deficiency in service", "consumer forum"], 2, ["judicial", "legal"]),
    "education": (["education", "university", "college", "school", "curriculum", "syllabus", "examination", "degree", "diploma", "admission", "enrollment", "ugc", "aicte", "naac", "nep", "autonomy", "affiliation"],
                  0, ["go", "legal", "judicial", "scheme"]),
}
#: Domains that a query's type hints at, and the verticals where no domain is found.
HINTS = {"risk_analysis": ["constitutional", "administrative"], "judicial_constraint": ["constitutional", "administrative"], "jurisdictional": ["federalism", "constitutional"], "comparative": ["constitutional", "administrative"]}
ALL_VERTICALS = ["go", "judicial", "legal", "scheme"]


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def vertical(text: Column, file_name: Column) -> tuple[Column, Column]:
    """(vertical, confidence): counts of keywords, five more for each in the file name; the first
    of equal ones.  Under three is data at 0.3; confidence is the share of all counts, 0.8 at most."""
    def score(words: Column, low: Column, name: Column) -> Column:
        count = lambda n, w: n + F.floor((F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("int") + F.when(name.contains(w), 5).otherwise(0)
        return F.aggregate(words, F.lit(0), count)

    def judged(scores: Column) -> Column:
        best, total = F.array_max(scores), F.aggregate(scores, F.lit(0), lambda a, x: a + x)
        first = F.element_at(F.array(*map(F.lit, VERTICALS)), F.array_position(scores, best).cast("int"))
        return F.struct(F.when(best < 3, "data").otherwise(first).alias("name"), F.when(best < 3, 0.3).otherwise(F.least(F.lit(0.8), best / F.greatest(total, F.lit(1)))).alias("sure"))

    # Keywords are data here, not code, so the generated code stays small.  Lists of one bind
    # the lower-cased text and the scores, which are then made once, not once a keyword.
    keywords = F.array(*[F.array(*map(F.lit, words)) for words in VERTICALS.values()])
    scores = F.transform(F.array(F.struct(_low(text).alias("low"), _low(file_name).alias("name"))), lambda t: F.transform(keywords, lambda words: score(words, t["low"], t["name"])))
    found = F.element_at(F.transform(scores, judged), 1)
    return found["name"], found["sure"]


def document_type(text: Column, kind: Column, file_name: Column) -> tuple[Column, Column, Column]:
    """(type, confidence, category) by the vertical's rules over the first 2,000 characters, first fit first."""
    top = F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    low500, name = F.lower(F.substring(top, 1, 500)), _low(file_name)
    has = lambda p: F.regexp_like(top, F.lit(p))
    marks = F.length(top) - F.length(F.translate(top, "|\t", "")) + (F.length(top) - F.length(F.replace(top, F.lit("Table"), F.lit("")))) / 5
    rules = [
        ("go", has(_CIRCULAR), "go_circular", 0.85), ("go", has(_NOTIFICATION), "go_notification", 0.8), ("go", F.lit(True), "go_order", 0.75),
        ("legal", has(_AMENDMENT), "amendment", 0.9), ("legal", has(_ACT), "act", 0.9), ("legal", has(_RULE), "rule", 0.85), ("legal", has(_NOTIFICATION), "notification", 0.8),
        ("legal", low500.contains("regulation"), "regulation", 0.75), ("legal", F.lit(True), "unknown", 0.5),
        ("judicial", has(_JUDGMENT), "judgment", 0.9), ("judicial", has(_COURT_ORDER) & low500.contains("interim"), "interim_order", 0.85), ("judicial", has(_COURT_ORDER), "order", 0.85), ("judicial", F.lit(True), "order", 0.7),
        ("data", name.contains("budget"), "budget", 0.9), ("data", _any(name, ("report", "annual", "quarterly")), "report", 0.85), ("data", _any(name, ("stats", "statistics", "data")), "statistics", 0.85),
        ("data", has(_BUDGET), "budget", 0.85), ("data", has(_REPORT), "report", 0.8), ("data", marks > 10, "statistics", 0.75), ("data", F.lit(True), "report", 0.7),
        ("scheme", has(_GUIDELINES), "guidelines", 0.85), ("scheme", has(_SCHEME), "scheme_document", 0.8), ("scheme", F.lit(True), "scheme_document", 0.75),
    ]
    empty = top == ""
    name_, sure = F.when(empty, "unknown"), F.when(empty, 0.0)
    for of, fits, type_, confidence in rules:
        name_, sure = name_.when((kind == of) & fits, type_), sure.when((kind == of) & fits, confidence)
    name_, sure = name_.otherwise("unknown"), sure.otherwise(0.5)
    table = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return name_, sure, F.coalesce(F.try_element_at(table, name_), F.lit("unknown"))


def go_role(preamble: Column, orders: Column) -> tuple[Column, Column]:
    """(role, weight) of an order from its preamble and an array of its paragraphs' texts, first rule first."""
    pre = _low(preamble)
    full = F.concat(pre, F.lit(" "), F.array_join(F.transform(orders, F.lower), " "))
    role = (
        F.when(_any(full, ("hereby repeal", "stands repealed", "entirety superseded")), "repeal")
        .when(_any(full, ("amendment", "amends")) & _any(full, ("hereby makes the following amendment", "substituted")), "amendment")
        .when(full.contains("sanction is hereby accorded") & _any(full, ("rupees", "rs.", "only")), "financial_sanction")
        .when(full.contains("budget") & full.contains("head of account"), "financial_sanction")
        .when(_any(full, ("clarification", "clarifies", "common understanding")), "clarification")
        .when(_any(pre, ("implementation of", "rules made under")) & _any(pre, ("act", "ordinance")), "primary_implementation")
        .when(_any(full, ("guidelines", "instructions")), "procedural_guidelines").when(full.contains("act"), "primary_implementation").otherwise("procedural_guidelines")
    )
    table = F.create_map(*[F.lit(x) for pair in ROLE_WEIGHTS.items() for x in pair])
    return role, F.coalesce(F.try_element_at(table, role), F.lit(0.5))


def _or_else(labels: Column, other: Column) -> Column:
    """labels, or other if there are none; bound, so that their patterns are searched once."""
    return bound(labels, lambda own: F.when(F.size(own) > 0, own).otherwise(other))


def go_logic(text: Column) -> dict[str, Column]:
    """Labels of each kind that fit an order's text, or the kind's default; empty lists for blank texts.

    All alternatives of a pattern begin at a word's bound, which is tested once for all of them.
    """
    text = F.coalesce(text, F.lit(""))
    blank = ~F.regexp_like(text, F.lit(r"\S"))
    none = F.array().cast("array<string>")
    out = {}
    for kind, labels in LOGIC.items():
        bound = {k: r"\b(?:" + p.removeprefix(r"\b").replace(r"|\b", "|") + ")" for k, p in labels.items()}
        fit = F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(f"(?id){as_re2(p)}")), k) for k, p in bound.items()]))
        other = F.array(F.lit(LOGIC_DEFAULTS[kind])) if kind in LOGIC_DEFAULTS else none
        out[kind] = F.when(blank, none).otherwise(_or_else(fit, other))
    return out


def query_domains(text: Column, query_type: Column) -> dict[str, Column]:
    """Domains of a query with their layers and confidence, verticals of each layer and depth.

    A domain found by n keywords counts 0.5 + 0.15 n up to 1; one that only the query's type
    hints at counts 0.6.
    """
    low = _low(text)
    found = []
    for i, (name, (words, layer, _)) in enumerate(QUERY_DOMAINS.items()):
        n = F.regexp_count(low, F.lit(r"\b(?:" + "|".join(words) + r")\b"))
        hinted = reduce(lambda a, b: a | b, [query_type == k for k, v in HINTS.items() if name in v], F.lit(False))
        hinted = F.coalesce(hinted, F.lit(False))
        confidence = F.when(n > 0, F.least(F.lit(1.0), F.lit(0.5) + n * 0.15)).when(hinted, 0.6)
        found.append(F.when(confidence.isNotNull(), F.struct(F.lit(layer).alias("layer"), (n == 0).alias("hint"), F.lit(i).alias("i"), F.lit(name).alias("domain"), F.round(confidence, 6).alias("confidence"))))
    domains = F.array_sort(F.array_compact(F.array(*found)))
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in QUERY_DOMAINS.items() for x in (k, v[2])])
    of = lambda own: F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda d: F.element_at(table, d["domain"])))))
    every = F.array(*map(F.lit, ALL_VERTICALS))
    out = {"domains": domains, "verticals": F.when(F.size(domains) > 0, of(domains)).otherwise(every)}
    for i, name in enumerate(_LAYERS):
        own = of(F.filter(domains, _in_layer(i)))
        out[f"{name}_verticals"] = F.when(F.size(domains) == 0, every).otherwise(own) if i == 0 else own
    out["depth"] = F.when(F.size(domains) > 2, "deep").otherwise("standard")
    return out


def _in_layer(i: int):
    return lambda d: d["layer"] == i
