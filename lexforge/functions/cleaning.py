"""Cleaning expressions: string column in, string column out, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]+"
_S = r"[ \t\n\r\f\x0B]*"


def _chain(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


#: Fixed values: (pattern, replacement) of each step, in the common subset of Java's and RE2's syntax.
HYPHENS = [(rf"({_W})-{_S}\n{_S}({_W})", "$1$2")]
PAGE_MARKERS = [
    (rf"\n{_S}[-–—]{_S}[0-9]+{_S}[-–—]{_S}\n", "\n"),
    (rf"(?i)\nPage[ \t\n\r\f\x0B]+[0-9]+{_S}\n", "\n"),
    (rf"(?i)\n[0-9]+[ \t\n\r\f\x0B]+of[ \t\n\r\f\x0B]+[0-9]+{_S}\n", "\n"),
    (rf"(?i)\n{_S}[-–—]+{_S}Page[ \t\n\r\f\x0B]+[0-9]+{_S}[-–—]+{_S}\n", "\n"),
]
ARTIFACTS = [
    (r"(?i)\[Image:[^\n]*?\]", ""), (r"(?i)\[Chart:[^\n]*?\]", ""), (r"<[^\n]*?>", ""),
    (rf"\n{_S}&&+[^\n]*\n", "\n"), (rf"\n{_S}##+[^\n]*\n", "\n"), (rf"\n{_S}\*\*\*+[^\n]*\n", "\n"), (r"[©®™]+", ""),
]
SPACES = [(r" +", " "), (rf"\n{_S}\n{_S}\n+", "\n\n"), (r"\n +", "\n"), (r" +\n", "\n"), (rf"\A{_S}", ""), (rf"{_S}\z", "")]
OCR_WORDS = [
    (r"(?i)\bGovemment\b", "Government"), (r"(?i)\bEducalion\b", "Education"), (r"(?i)\bAndhra\s+Pradcsh\b", "Andhra Pradesh"),
    (r"(?i)\b0rder\b", "Order"), (r"(?i)\bSec[il]on\b", "Section"),
]
REFERENCES = [
    (r"(?i)G\.O\.Ms\.?No\.?([0-9]+)", "G.O.Ms.No. $1"), (r"(?i)G\.O\.Rt\.?No\.?([0-9]+)", "G.O.Rt.No. $1"),
    (r"(?i)GO\s+MS\.?\s*No\.?\s*([0-9]+)", "G.O.Ms.No. $1"), (r"(?i)GO\s+RT\.?\s*No\.?\s*([0-9]+)", "G.O.Rt.No. $1"),
    (r"(?i)Sec\.?\s*([0-9]+)", "Section $1"), (r"§\s*([0-9]+)", "Section $1"),
    (r"([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})", "$1-$2-$3"),
]
STEPS = {
    "cln_03_fix_hyphenation": HYPHENS, "cln_04_remove_page_markers": PAGE_MARKERS, "cln_05_remove_artifacts": ARTIFACTS,
    "cln_06_normalize_whitespace": SPACES, "cln_07_fix_ocr_words": OCR_WORDS, "cln_09_standardize_refs": REFERENCES,
}


#: The same texts as HYPHENS with less to try at each word: only the letter before the hyphen is needed.
_JOINS = [(rf"([\p{{L}}\p{{N}}_])-{_S}\n{_S}({_W})", "$1$2")]


def step(name: str, text: Column) -> Column:
    """One cleaning step; null stays null."""
    return _chain(text, _JOINS if STEPS[name] is HYPHENS else STEPS[name])


def clean(text: Column) -> Column:
    """The steps 03 to 07 in order; "" for null."""
    for rules in (_JOINS, PAGE_MARKERS, ARTIFACTS, SPACES, OCR_WORDS):
        text = _chain(text, rules)
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")
