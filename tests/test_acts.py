"""Sweep over acts against a plain scan, chunks of acts without headings, and many sections."""

import random
import re
import time

from lexforge.functions import structure as st
from lexforge.operators.acts import act_leads, act_nodes, section_text
from lexforge.operators.chunking import chunk_legal
from pyspark.sql import functions as F

BOUNDARY = re.compile(r"^\s*(Section|Sec\.?|Article|Rule|Regulation|Norm\s*s?|CHAPTER|PART|(?:THE\s+)?SCHEDULE|APPENDIX)(?=\s)", re.I | re.M)


def plain(text):
    """Every node by searching from the end of its heading."""
    flags = re.I | re.M
    find = lambda p: list(re.finditer(p.replace("(?imd)", ""), text, flags))
    marks = {k: [(m.start(), m[1]) for m in find(p)] for k, p in (("part", st.PART), ("chapter", st.CHAPTER))}
    out = []
    for kind, pattern in st.LEGAL_NODES.items():
        for m in find(pattern):
            raw = (m[2] or "").strip()
            title, _, inline = raw.partition("—")
            after = text[m.end() :]
            stop = BOUNDARY.search(after)
            after = after[: stop.start() if stop else None].strip()
            content = f"{inline.strip()}\n{after}".strip() if inline.strip() else after
            clauses = re.findall(r"^\s*\(([0-9a-zA-Z]|[ivx]+)\)\s+", content, flags)
            last = {k: next((v for s, v in reversed(x) if s < m.start()), None) for k, x in marks.items()}
            out.append((m.start(), kind, m[1], title.strip() or None, content, clauses, last["part"], last["chapter"]))
    return sorted(out, key=lambda x: x[0])


def made(rng):
    lines = []
    for _ in range(rng.randrange(1, 40)):
        lines.append(rng.choice([
            "", "", "  ", "plain words of the law", "(a) first", " (b) second thing", "(iv) roman", "Section 5", "Section 6A. Title here", "section 7(2): Name — inline text", "Rule 3", "  Rule 4. Title",
            "PART II", "CHAPTER IV — Schools", "CHAPTER", "PART of it", "THE SCHEDULE II", "Schedule X", "APPENDIX 3: forms", "Norms 4. Staff", "Norm s 5", "Regulation IV", "Article 21", "Sec. 9 is not a node",
            "Sectional view", "It refers to Section 5 here", "Section", "Article 3.\t", "é — ü",
        ]))
    return "\n".join(lines)


def test_sweep_against_a_plain_scan(spark):
    rng = random.Random(2)
    rows = [(f"d{i}", made(rng)) for i in range(400)] + [("n", None), ("e", ""), ("x", "no heading")]
    df = spark.createDataFrame(rows, "document_id string, text string")
    got = {}
    for r in act_nodes(df).collect():
        got.setdefault(r.document_id, []).append((r.start, r.section_type, r.number, r.title, r.content, list(r.clauses), r.part, r.chapter))
    for name, text in rows:
        assert sorted(got.get(name, []), key=lambda x: x[0]) == plain(text or "")
    nodes = act_nodes(df)
    asked = spark.createDataFrame([("d1", "5"), ("d2", "6A"), ("x", "1"), (None, "5")], "document_id string, number string")
    want = {(n, q): next((c for _, _, number, _, c, *_ in plain(dict(rows)[n]) if number == q), None) for n, q in (("d1", "5"), ("d2", "6A"), ("x", "1"))}
    assert {(r.document_id, r.number): r.content for r in section_text(nodes, asked).collect()} == {**want, (None, "5"): None}


def test_twenty_thousand_sections(spark):
    text = "THE ACT\n" + "\n".join((f"PART {i}\n" if i % 50 == 0 else "") + (f"CHAPTER {i}\n" if i % 7 == 0 else "") + f"Section {i}. Title {i}\n(a) some words of the section\n(b) more" for i in range(1, 20_001))
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    start = time.monotonic()
    rows = act_nodes(df).collect()
    assert time.monotonic() - start < 30 and len(rows) == 20_000
    assert {(r.number, r.part, r.chapter, tuple(r.clauses)) for r in rows if r.number in ("60", "20000")} == {("60", "50", "56", ("a", "b")), ("20000", "20000", "19999", ("a", "b"))}


def test_chunks_lose_no_act(spark):
    """Acts without headings are packed by paragraphs, and what stands before a heading is kept."""
    long = "\n\n".join(f"Paragraph {i} of an act that has no headings at all, told in plain words." for i in range(60))
    rows = [("a", long), ("b", "A short act of fifty characters and some, without one heading."), ("c", "Be it enacted by the legislature as follows:\nSection 1. Name — This is the name of the act.")]
    got = chunk_legal(spark.createDataFrame(rows, "document_id string, text string")).orderBy("document_id", "chunk_index").collect()
    kinds = {d: [r.section_type for r in got if r.document_id == d] for d in "abc"}
    assert kinds["b"] == [None] and kinds["c"] == ["lead", "section"] and len(kinds["a"]) > 1
    held = " ".join(r.content for r in got if r.document_id == "a")
    assert all(f"Paragraph {i} of" in held for i in range(60))
    assert act_leads(spark.createDataFrame(rows, "document_id string, text string")).filter(F.col("document_id") == "c").first().content.startswith("Be it enacted")
