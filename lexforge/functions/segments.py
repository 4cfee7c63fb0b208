"""Expressions that cut text: garbage lines, paragraphs, sentences and the type of a query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the reference's patterns, as both Java and RE2 write it.
SPACE = r"[ \t\n\r\f\x0B]"
#: Symbols that mark recognition garbage, and words that keep a line of symbols.
SYMBOLS = r"[^~•@_{}\[\]<>|\\^°±§¶]"
KEEP_WORDS = ("no.", "dt.", "dated", "memo", "govt", "rc.", "procs.")
SENTENCE_END = rf"(?<=[.!?]){SPACE}+(?=[A-Z])"
LIST_ITEM = rf"\n(?={SPACE}*(?:[0-9]+\.|[•*-]){SPACE}+)"

#: Patterns of each query type, in order of precedence.
QUERY_TYPES = {
    "factual": (
        r"\b(what|which|who|where|when)\b[^\n]*\b(said|stated|mentioned|specified|defined|requires?|mandates?|allows?|prohibits?)\b",
        r"\b(what|which)\b[^\n]*\b(does|did|is|are|was|were)\b",
        r"\b(according to|as per|per|under)\b",
    ),
    "comparative": (
        r"\b(compare|comparison|difference|differences|versus|vs\.?|versus)\b",
        r"\b(how did|how has|how have|evolution|evolved|changed|changes)\b",
        r"\b(pre|post|before|after|earlier|later)\b[^\n]*\b(and|versus)\b",
        r"\b(over time|across|between)\b",
    ),
    "risk_analysis": (
        r"\b(can|could|may|might|would|should)\b[^\n]*\b(legal|constitutional|valid|permissible|allowed|prohibited)\b",
        r"\b(risk|risks|conflict|conflicts|contradict|contradiction|violate|violation)\b",
        r"\b(compliance|compliant|non-compliance|non-compliant)\b",
        r"\b(constitutional|constitutionally|unconstitutional)\b",
    ),
    "judicial_constraint": (
        r"\b(supreme court|high court|sc|hc|judgment|judgement|case|precedent|binding)\b",
        r"\b(court|judicial|judiciary|ruled|ruling|order|decided|decision)\b",
        r"\b(overruled|overrules|precedent|stare decisis)\b",
    ),
    "temporal": (
        r"\b(in|during|on|by|before|after|since|until)[ \t\n\r\f\x0B]+[0-9]{4}\b",
        r"\b(year|years|decade|decades|period|timeframe)\b",
        r"\b(historical|historically|past|previous|earlier|later|recent)\b",
    ),
    "jurisdictional": (
        r"\b(state|states|union|central|federal|provincial)\b",
        r"\b(andhra pradesh|ap|telangana|karnataka|tamil nadu|kerala|maharashtra)\b",
        r"\b(jurisdiction|jurisdictional|applicable|applies|applies to)\b",
        r"\b(territorial|geographic|region|regional)\b",
    ),
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def _keep_line(line: Column) -> Column:
    count = lambda other: F.length(F.regexp_replace(line, other, ""))
    total = F.length(trimmed(line))
    ascii_, letters = count(r"[^\x20-\x7E]"), count(r"[^\p{L}]")
    named = F.lit(False)
    for word in KEEP_WORDS:
        named = named | F.lower(line).contains(word)
    return (
        F.when(total == 0, True).when(ascii_ >= total * 0.7, True).when(count(SYMBOLS) > total * 0.15, False)
        .when((ascii_ < total * 0.4) & (letters < 5), False).when((total < 10) & (ascii_ < total * 0.5), False)
        .when(letters < total * 0.3, named).otherwise(True)
    )


def drop_garbage_lines(text: Column) -> Column:
    """Lines that look like text; the first rule that fits a line decides.  Null stays null."""
    return F.array_join(F.filter(F.split(text, "\n", -1), _keep_line), "\n")


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, list items apart, trimmed, without empty ones."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return _pieces(F.flatten(F.transform(F.split(text, rf"\n{SPACE}*\n", -1), lambda x: F.split(x, LIST_ITEM, -1))))


def sentences(text: Column) -> Column:
    """Sentences, cut where white space follows . ! or ? and a capital A-Z comes next."""
    return _pieces(F.split(text, SENTENCE_END, -1))


def numbered(df: DataFrame, parts: Column, key: str) -> DataFrame:
    """A row a part: key, place (from 0) and part; rows without parts give none."""
    return df.select(key, F.posexplode(parts).alias("place", "part"))


def ascii_bounds(pattern: str) -> str:
    """The pattern with \\b between A-Z, a-z, 0-9, _ and others; Java's own counts more letters, depending on its version."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def as_re2(pattern: str) -> str:
    """The pattern as RE2 reads it under (?i): \\b as in ascii_bounds, \\s without the vertical tab, s and k with the
    two letters beyond A-Z that fold to them."""
    wide = {"s": "\u017f", "k": "\u212a"}

    def part(found: re.Match) -> str:
        token = found[0]
        if token == r"\b":
            return ascii_bounds(token)
        if token == r"\s":
            return r"[\t\n\f\r ]"
        if token[0] == "[":
            return token[:-1] + "".join(w for c, w in wide.items() if c in token.lower()) + "]"
        return token if token[0] == "\\" else f"[{token}{wide[token.lower()]}]"

    return re.sub(r"\\.|\[[^\]]*\]|[sSkK]", part, pattern)


def query_type(text: Column) -> tuple[Column, Column, Column]:
    """(primary type, its confidence, other types over 0.3 joined by commas) of a query; null as "".

    A type's score is the share of its patterns found, half as much again (at most 1) if
    several are; the first of the highest wins; under 0.2 the query is factual with 0.5.
    """
    low, scores = F.lower(F.coalesce(text, F.lit(""))), {}
    for name, patterns in QUERY_TYPES.items():
        hits = sum((low.rlike(ascii_bounds(p)).cast("int") for p in patterns), F.lit(0))
        scores[name] = F.when(hits > 1, F.least(F.lit(1.0), hits * 1.5 / len(patterns))).otherwise(hits / len(patterns))
    best = F.greatest(*scores.values())
    top = F.lit(None).cast("string")
    for name in reversed(scores):
        top = F.when(scores[name] == best, name).otherwise(top)
    others = F.array_join(F.filter(F.array(*[F.when(s > 0.3, n) for n, s in scores.items()]), lambda x: x.isNotNull() & (x != top)), ",")
    return F.when(best < 0.2, "factual").otherwise(top), F.round(F.when(best < 0.2, 0.5).otherwise(best), 9), others
