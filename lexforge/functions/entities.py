"""Expressions that find references, policy domains and departments in a text.

A null text counts as empty.  White space is ASCII, words are runs of letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .segments import SPACE, trimmed

_S = SPACE
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"

#: Of each entity type, what stands before the found value and the patterns.
ENTITIES = {
    "go_numbers": ("GO.MS.No.", (
        rf"(?i)G\.?O\.?{_S}*(?:MS|RT)\.?{_S}*No\.?{_S}*([0-9]+)",
        rf"(?i)GO{_S}+No\.?{_S}*([0-9]+)",
        rf"(?i)Government Order{_S}+No\.?{_S}*([0-9]+)",
    )),
    "sections": ("Section ", (
        rf"(?i)Section{_S}+([0-9]+[A-Z]?(?:\([a-z0-9]+\))?)",
        rf"(?i)Sec\.?{_S}+([0-9]+[A-Z]?)",
        rf"§{_S}*([0-9]+[A-Z]?)",
    )),
    "rules": ("Rule ", (
        rf"(?i)Rule{_S}+([0-9]+[A-Z]?(?:\([a-z0-9]+\))?)",
        rf"(?i)(Rules?,?{_S}+[0-9]{{4}})",
    )),
    "dates": ("", (
        r"\b([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})\b",
        rf"(?i)\b([0-9]{{1,2}}(?:st|nd|rd|th)?{_S}+{_MONTH}\.?{_S}+[0-9]{{2,4}})\b",
        rf"(?i)\b({_MONTH}\.?{_S}+[0-9]{{1,2}},?{_S}+[0-9]{{2,4}})\b",
    )),
}

#: Keywords of each policy domain; a word may go on after a keyword.
DOMAINS = {
    "transfer": ("transfer", "postings", "deputation", "relieved", "joining", "counseling", "mutual transfer", "request transfer", "spousal category"),
    "promotion": ("promotion", "upgradation", "panel", "seniority list", "eligible for promotion", "adhoc promotion", "regularization of services"),
    "salary": ("salary", "pay scale", "allowance", "da", "hra", "increment", "arrears", "revised pay scales", "rps", "fixation of pay"),
    "leave": ("leave", "casual leave", "earned leave", "maternity leave", "medical leave", "child care leave", "ccl", "surrender leave"),
    "discipline": ("disciplinary", "suspension", "enquiry", "charge sheet", "penalty", "show cause notice", "reinstatement", "cca rules"),
    "appointment": ("appointment", "recruitment", "dsc", "selection", "interim relief", "compassionate appointment", "contract basis", "outsourcing"),
    "retirement": ("retirement", "pension", "gratuity", "superannuation", "commutation", "pensionary benefits", "provisional pension"),
}

#: Departments in order of precedence, each with alternatives of words that must all occur.
DEPARTMENTS = {
    "SCHOOL_EDUCATION": (("EDUCATION",),),
    "SOCIAL_WELFARE": (("WELFARE",), ("SOCIAL",)),
    "LAW": (("LAW",),),
    "FINANCE": (("FINANCE",),),
    "HEALTH": (("HEALTH",),),
    "REVENUE": (("REVENUE",),),
    "GENERAL_ADMINISTRATION": (("GENERAL", "ADMIN"),),
}

#: Words of sentences that may state a relation, lower case.
RELATION_WORDS = ("supersedes", "cancels", "amends", "clarifies", "references", "in supersession of", "in amendment", "vide", "g.o.ms", "g.o.rt")
SENTENCE_GAP = rf"[.!?]{SPACE}+"
OCR_NOISE = r"(?:^|[^\p{L}\p{N}_])[0-9][A-Z](?:[^\p{L}\p{N}_]|$)"


def domain_pattern(domain: str) -> str:
    """A keyword at the start of a word, with the rest of that word."""
    return r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(DOMAINS[domain]) + r")[\p{L}\p{N}_]*"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def found_entities(text: Column, kind: str) -> Column:
    """Sorted distinct values of an entity type."""
    before, patterns = ENTITIES[kind]
    found = F.concat(*[F.regexp_extract_all(_text(text), F.lit(p), F.lit(1)) for p in patterns])
    named = F.transform(found, lambda x: F.when(x.startswith(before.strip()), x).otherwise(F.concat(F.lit(before), x))) if before else found
    return F.array_sort(F.array_distinct(named))


def _starts(domain: str) -> str:
    """domain_pattern's matches; most characters and words are told by their ASCII letters, which is quicker."""
    firsts = "".join(sorted({k[0] for k in DOMAINS[domain]}))
    return rf"(?i)(?:^|(?![a-z0-9_])[^\p{{L}}\p{{N}}_])(?=[{firsts}])(?:" + "|".join(DOMAINS[domain]) + r")[\p{L}\p{N}_]*"


def policy_domains(text: Column) -> tuple[Column, Column]:
    """All domains with a keyword in the text, and that of most matches (the first of equals; general if none).

    The counts are an array's only element, so that the text is searched once a domain.
    """
    counts = F.array(F.struct(*[F.regexp_count(_text(text), F.lit(_starts(d))).alias(d) for d in DOMAINS]))

    def judged(n: Column) -> Column:
        listed = F.array_compact(F.array(*[F.when(n[d] > 0, F.lit(d)) for d in DOMAINS]))
        most = F.greatest(*[n[d] for d in DOMAINS])
        primary = F.when(most == 0, "general")
        for d in DOMAINS:
            primary = primary.when(n[d] == most, d)
        return F.struct(listed.alias("listed"), primary.alias("primary"))

    found = F.transform(counts, judged)[0]
    return found["listed"], found["primary"]


def department(raw: Column) -> Column:
    """The allowed department that a free text names, else UNKNOWN."""
    upper = F.upper(_text(raw))
    out = F.lit("UNKNOWN")
    for name, ways in reversed(DEPARTMENTS.items()):
        hit = F.lit(False)
        for words in ways:
            every = F.lit(True)
            for word in words:
                every = every & upper.contains(word)
            hit = hit | every
        out = F.when(hit, name).otherwise(out)
    return out


def order_type(raw: Column) -> Column:
    """The type of an order; administrative where it is null or unknown."""
    return F.when(raw.isNull() | (F.lower(raw) == "unknown"), "administrative").otherwise(raw)


def ocr_confidence(text: Column, confidence: Column) -> Column:
    """Confidence lowered for signs of bad recognition, or for a mere citation by "vide"."""
    return F.when(_text(text).rlike(OCR_NOISE), confidence * 0.6).when(F.lower(_text(text)).contains("vide"), confidence * 0.8).otherwise(confidence)


def candidate_sentences(text: Column, most: int | None = 20) -> Column:
    """The sentences that may state a relation, in order; the first `most` (None: all)."""

    def fits(x: Column) -> Column:
        hit = F.lit(False)
        for word in RELATION_WORDS:
            hit = hit | F.lower(x).contains(word)
        return hit

    found = F.transform(F.filter(F.split(_text(text), SENTENCE_GAP), fits), trimmed)
    return F.slice(found, 1, most) if most else found
