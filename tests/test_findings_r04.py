"""Cases of the findings of round 4."""

import random
import time

import duckdb
from pyspark.sql import functions as F

from lexforge import registry
from lexforge.functions import classify, mentions, spans, structure
from lexforge.operators import extraction

KINDS = list(classify.LOGIC)


def test_go_logic_reads_patterns_as_its_sql(spark):
    """Letters beyond A-Z, marks and odd white space beside the words, and the two letters that fold to s and k."""
    words = "supersedes stands superseded replaces G.O. in place of amends partial modification cancelled withdraw clarify all districts statewide district schools shall must may advise cabinet chief minister secretary director teachers staff students officers fund lakhs Rs. INR 500".split()
    odd = ["ü", "ß", "́", "ſ", "K", "ı", "İ", "_", "9", "\U0001d49c", "中", "٣", "‍", "-", "."]
    rng = random.Random(4)

    def word():
        w = rng.choice(words)
        w = w.replace("s", "ſ", 1) if rng.random() < 0.15 else w.replace("k", "K") if rng.random() < 0.1 else w
        return rng.choice([*odd, "", "", ""]) + w + rng.choice([*odd, "", "", ""])

    texts = ["FÜRS", "directoré", "wholeádistrict", "must́", "fundſ", "strictly\x0bfollow", "in place of\x85G.O."]
    texts += ["".join(word() + rng.choice([" ", " ", "", "\n", "\x0b", "\xa0", "\x85", " "]) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    made = rows.select("document_id", *[F.array_join(x, ",").alias(n) for n, x in classify.go_logic(F.col("text")).items()])
    filings = duckdb.connect()
    filings.execute("CREATE TABLE filings (document_id BIGINT, text VARCHAR)")
    filings.executemany("INSERT INTO filings VALUES (?, ?)", list(enumerate(texts)))
    sql = registry.ORACLE_SQL["cls_05_go_logic"]
    want = filings.execute(sql[sql.rindex("SELECT document_id"):]).fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert [c for c, _ in made.dtypes][1:] == KINDS


def test_ingest_searches_a_text_once_a_pattern(spark):
    """The marks, headings and relations of a text are searched where they are found, not where they are used."""
    texts = ["GOVERNMENT\nORDERS:\n1. One. \n2) Two\nANNEXURE I\na | b", "In exercise of powers\n(a) x", "WHEREAS so it is", "HEADNOTE x FACTS: y\nHELD z amends 12 and amends 13", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def made(column, *patterns):
        out = rows.select("id", column.alias("x"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        return [r.x for r in out.orderBy("id").collect()], [plan.count(p) for p in patterns]

    got, times = made(structure.judgment_sections(F.col("text")), "HEADNOTE", "RATIO DECIDENDI")
    assert times == [2, 2] and [s.section_type for s in got[3]] == ["headnote", "facts", "judgment"] and got[4] == []
    got, times = made(structure.cut_order(F.col("text")), "ORDER[S]", "THEREFORE", r"\s*ANNEXURE")
    assert times == [2, 3, 2]
    assert [tuple(x) for x in got] == [("GOVERNMENT", "1. One. \n2) Two", "ANNEXURE I\na | b"), ("In exercise of", "powers\n(a) x", ""), ("WHEREAS", "so it is", ""), ("", texts[3], ""), ("", "", ""), ("", "", "")]
    got, times = made(structure.go_paragraphs(F.col("text")), r"[\.\)]|(?:")
    assert times == [2] and [p.para_no for p in got[0]] == ["1", "2"] and got[4] == []
    got, times = made(spans.spans(F.col("text"), r"amends (\d+)"), r"amends (\d+)")
    assert times == [4] and [(h.start, h.value) for h in got[3]] == [(texts[3].index("amends"), "12"), (texts[3].rindex("amends"), "13")]
    # A column of the alias' name is the one before the select.
    assert rows.withColumnRenamed("text", "orders").select(structure.go_paragraphs(F.col("orders")).alias("orders"), structure.go_paragraphs(F.col("orders")).alias("again")).filter("orders <> again").count() == 0


def test_acts_are_sought_in_texts_that_name_one(spark):
    """The patterns end on the word Act and try each letter before it, each time to the end of the letters."""
    rows = spark.createDataFrame([("so many words " * 3000 + "exact facts",), ("under the School Fees Act, 1983: so",)], "text string")
    start = time.time()
    assert [r.acts for r in rows.select(mentions.act_mentions(F.col("text")).alias("acts")).collect()] == [[], ["School Fees Act", "under the School Fees Act"]]
    assert time.time() - start < 30


def test_tokens_are_whole_numbers(spark):
    """A number counts where it is a token of its own, a raw text anywhere."""
    docs = spark.createDataFrame([("a", "amends 12 and 345"), ("b", "amends 12.5 only")], "document_id string, text string")
    rows = [("a", "12", "no", 0.9), ("a", "34", "no", 0.9), ("a", "34", "and 34", 0.9), ("b", "12", "no", 0.9), ("b", "12", "no", 0.99), ("b", None, "no", 0.9), ("b", "12.5", None, 0.9)]
    relations = spark.createDataFrame(rows, "document_id string, go_number string, raw_text string, confidence double").withColumn("context", F.lit("x"))
    kept = extraction.validate_relations(relations, docs).select("document_id", "go_number", "raw_text").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [r[:3] for r in rows if r not in (rows[1], rows[3])]))


def test_act_names_start_where_they_did(spark):
    """The patterns with and without the bound on their starts find the same names."""
    bits = ["Act", "act", "The", "the", " ", ", ", ",", "  ", "\n", "    ", "1983", ":", ".", "No.", "5", "of", "under", "School", "Fee", "é", "exact", "Acts", "-", " Act, 1983", " Act: ", " Act No. 5 of 2001", "_"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(5000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern in mentions.ACTS:
        names = [F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (pattern, pattern.replace(mentions._START, ""))]
        assert rows.filter(names[0] != names[1]).count() == 0 < rows.filter(F.size(names[0]) > 0).count()
