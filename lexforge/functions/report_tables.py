"""Tables of reports, the lines under a caption that look like a table, their charts and numbered sections, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Captions, lines of tables, other headings and garbled text.
CAPTIONS = [re.compile(p, re.I) for p in (
    r"(?:Table|TABLE)\s+(\d+(?:\.\d+)?)[:\.]?\s*(.+?)(?=\n|$)", r"(?:Table|TABLE)\s+(\d+(?:\.\d+)?)\s*[:-]\s*(.+?)(?=\n|$)",
    r"(?:Annexure|ANNEXURE)\s+(\d+(?:\.\d+)?)[:\.]?\s*(.+?)(?=\n|$)", r"(?:Demand\s+Reference|Demand\s*Number)\s*[:\.]?\s*([A-Za-z0-9]+)(.*)")]
LINES = [re.compile(r"(\s{3,}\S+){3,}"), re.compile(r"\|[^\n]*\|[^\n]*\|"), re.compile(r"\t[^\n]*\t[^\n]*\t"), re.compile(r"^\s*\d+[\.\)]\s+[^\n]*\d+[^\n]*$", re.M)]
CHART = re.compile(r"(?:Figure|Chart|Graph)\s+(\d+(?:\.\d+)?)[:\.]?\s*(.+?)(?:\n|$)", re.I)
SECTION = re.compile(r"^(?:Chapter|Section|CHAPTER|SECTION)\s+(\d+(?:\.\d+)?)[:\.]?\s*(.+?)$", re.M)
NUMBER, GARBLED = re.compile(r"\d+(?:,\d+)*(?:\.\d+)?"), re.compile(r"\(cid:\d+\)")
REACH, MOST_LINES, NEAR, ALONE, CHART_REACH = 2000, 50, 200, 1000, 500


def looks_like_row(line: str) -> bool:
    if not line.strip():
        return False
    digits = sum(c.isdigit() for c in line)
    return any(p.search(line) for p in LINES) or (digits > 5 and digits / len(line) > 0.1) or len(NUMBER.findall(line)) >= 3


def cells(line: str) -> list[str]:
    """Cells by the first separator that leaves two; none otherwise."""
    line = line.strip()
    for separator in ("|", "\t", "  "):
        found = [c.strip() for c in line.split(separator) if c.strip()] if separator in line else []
        if len(found) >= 2:
            return found
    return []


def tables(text: str) -> list[tuple[str, str, int, str, list[str], int, bool]]:
    """(number, title, place, content, header, rows, garbled) of each caption's table."""
    out = []
    for at, number, title in sorted({(m.start(), m[1], (m[2] or "").strip()) for p in CAPTIONS for m in p.finditer(text)}):
        head = next((m for p in CAPTIONS if (m := p.search(text[at : at + NEAR]))), None)
        if head is None:
            continue
        start = stop = at + head.end()
        held, rows, done = 0, [], 0
        for line in text[start : start + REACH].split("\n"):
            done += len(line) + 1
            if looks_like_row(line):
                held += 1
                stop = start + done - 1
                if found := cells(line):
                    rows.append(found)
            elif held and (held > MOST_LINES or any(p.search(line) for p in (*CAPTIONS, CHART, SECTION))):
                break
            elif held:
                held += 1
                stop = start + done - 1
        content = text[at : stop if held else min(start + ALONE, len(text))]
        out.append((number, title, at, content, rows[0] if rows else [], len(rows), bool(GARBLED.search(content))))
    return out


_ROW = "array<struct<number:string,title:string,start:int,content:string,columns:array<string>,n_rows:int,is_garbled:boolean>>"


def report_tables(text: Column) -> Column:
    """Tables of a report by place; null text gives none."""

    @pandas_udf(_ROW)
    def run(texts: pd.Series) -> pd.Series:
        names = ("number", "title", "start", "content", "columns", "n_rows", "is_garbled")
        return pd.Series([[dict(zip(names, t, strict=True)) for t in tables(x or "")] for x in texts], dtype=object)

    return run(text)


def _titled(kind: str, m: re.Match) -> str:
    return f"{kind} {m[1]}: {m[2].strip()}" if m[2].strip() else f"{kind} {m[1]}"


def charts(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, title, start, end, content) of each figure: up to the next caption or figure, else 500 characters.

    A caption directly behind a figure's heading doesn't end it.  Each pattern's next place is
    kept until it is passed, so the time is in proportion to the text.
    """
    out, ahead = [], {}
    for m in CHART.finditer(text):
        after = []
        for p in (*CAPTIONS, CHART):
            if p not in ahead or (ahead[p] is not None and ahead[p] < m.end()):
                behind = p.search(text, m.end())
                ahead[p] = behind.start() if behind else None
            if ahead[p] is not None:
                after.append(ahead[p])
        end = min(after, default=m.end())
        end = end if end > m.end() else min(m.end() + CHART_REACH, len(text))
        out.append(("chart", _titled("Figure", m), m.start(), end, text[m.start() : end].strip()))
    return out


def sections(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, title, start, end, content) of each numbered chapter or section: up to the next."""
    found = list(SECTION.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [("analysis", _titled("Section", m), m.start(), end, text[m.end() : end].strip()) for m, end in zip(found, ends, strict=False)]


_PART = "array<struct<section_type:string,title:string,start:int,end:int,content:string>>"


def report_parts(text: Column) -> Column:
    """Charts and numbered sections of a report by place; null text gives none."""

    @pandas_udf(_PART)
    def run(texts: pd.Series) -> pd.Series:
        names = ("section_type", "title", "start", "end", "content")
        return pd.Series([[dict(zip(names, t, strict=True)) for t in sorted(charts(x or "") + sections(x or ""), key=lambda t: (t[2], t[0]))] for x in texts], dtype=object)

    return run(text)
