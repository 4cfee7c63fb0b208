"""Charts, sections, parties and preamble references on literal texts, and topics against all pairs."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from lexforge.functions import report_tables as rt
from lexforge.functions import structure as st
from lexforge.operators import lineage


def plain_charts(text):
    """Each figure by searching what is left of the text anew."""
    out = []
    for m in rt.CHART.finditer(text):
        rest = text[m.end() :]
        behind = [f.start() for p in (*rt.CAPTIONS, rt.CHART) if (f := p.search(rest))]
        end = m.end() + min(behind) if behind and min(behind) else min(m.end() + 500, len(text))
        out.append((m.start(), end, text[m.start() : end].strip()))
    return out


def test_charts_and_sections_of_random_texts():
    rng = random.Random(2)
    parts = ["Figure 1: Growth\n", "chart 2.5 Shares", "Graph 3.\n", "Table 1: Pupils\n", "Annexure 2\n", "Demand Number: 12\n", "words " * 120, "Section 2.1 Results\n", "CHAPTER 3: End", "\n", "x | y | z\n", "Figure none "]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert [t[2:] for t in rt.charts(text)] == plain_charts(text)
        rows = rt.sections(text)
        assert all(a[3] == b[2] for a, b in zip(rows, rows[1:], strict=False)) and (not rows or rows[-1][3] == len(text))
    assert rt.charts("Figure 2: Growth") == [("chart", "Figure 2: Growth", 0, 16, "Figure 2: Growth")]
    assert rt.sections("Chapter 1: A\nbody\nSection 2.1 B") == [("analysis", "Section 1: A", 0, 18, "body"), ("analysis", "Section 2.1: B", 18, 31, "")]


def test_many_charts_without_a_caption_take_linear_time():
    assert len(rt.charts("Figure 1: a\nword word\n" * 50_000)) == 50_000


def test_parts_parties_and_references_of_odd_texts(spark):
    texts = [None, "", "Between: A Ltd\nAND\nThe State\nJUDGMENT\nx", "BETWEEN\nA\n& Co\n and \nB\n(2) C\nORDER", "Between\nA\nand Co\nAND\nB\nORDER", "Between A and B", "x" * 4000 + "Between: A\nAND\nB\nORDER"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = rows.select("i", *[c.alias(n) for n, c in st.judgment_parties(F.col("text")).items()], rt.report_parts(F.col("text")).alias("parts")).orderBy("i").collect()
    assert [(r.petitioner, r.respondent) for r in got] == [(None, None), (None, None), ("A Ltd", "The State"), ("A\n& Co", "B\n(2) C"), ("A", "Co"), (None, None), (None, None)]
    assert all(r.parts == [] for r in got)
    names = spark.createDataFrame([(0, "Read: G.O.Ms.No. 7, GO No 9B and G.O.Rt.No.7"), (1, None)], "i int, text string").select("i", st.preamble_references(F.col("text")).alias("r")).orderBy("i").collect()
    assert [(x.ref_text, x.number) for x in names[0].r] == [("G.O.Ms.No. 7", "7"), ("GO No 9", "9"), ("G.O.Rt.No.7", "7")] and names[1].r == []


def newer(orders):
    out = {}
    tokens = [({w for w in (o[3] or "").lower().split() if len(w) > 4}, o) for o in orders if o[2] is not None]
    for words, a in tokens:
        hits = [(b[4], b[0]) for more, b in tokens if b[1] == a[1] and b[2] > a[2] and len(words & more) > 1]
        if hits:
            out[a[0]] = min(hits)[1]
    return out


def test_newer_same_topic_of_random_orders(spark):
    """Null and empty departments, a hot pair of words on one day, repeated words, subjects without long words."""
    rng, orders = random.Random(4), []
    for i in range(400):
        day = rng.choice([None, date(2001, 1, 1), date(2001, 1, 1), date(2001, 1, 1) + timedelta(days=rng.randrange(90))])
        subject = rng.choice([None, "", "of the fee", "School grants"]) if i % 5 == 0 else " ".join(rng.choices(["school", "grants", "Grants", "policy", "transfer", "of", "pension", f"only{i}x"], k=rng.randrange(1, 6)))
        orders.append((f"o{i}", rng.choice(["a", "b", "", None]), day, subject, rng.randrange(10_000)))
    frame = spark.createDataFrame(orders, "go_id string, department string, go_date date, subject string, seq int")
    want = newer(orders)
    assert {r.go_id: r.superseded_by for r in lineage.newer_same_topic(frame).collect()} == want
    gone = spark.createDataFrame([(g,) for g in list(want)[::2]], "go_id string")
    assert {r.go_id for r in lineage.newer_same_topic(frame, gone).collect()} == set(list(want)[1::2])


def test_subjects_of_a_thousand_words(spark):
    long = " ".join(f"word{i:05}" for i in range(1000))
    orders = [("a", "d", date(2001, 1, 1), long, 1), ("b", "d", date(2002, 1, 1), "word00001 word00999 other", 2), ("c", "d", date(2003, 1, 1), long.upper(), 3)]
    frame = spark.createDataFrame(orders, "go_id string, department string, go_date date, subject string, seq int")
    assert {r.go_id: r.superseded_by for r in lineage.newer_same_topic(frame).collect()} == {"a": "b", "b": "c"}
