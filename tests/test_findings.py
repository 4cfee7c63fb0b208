"""Cases of the findings of round 3."""

import random
import re

from pyspark.sql import functions as F

from lexforge.functions import classify, entities, segments, structure, unicode
from lexforge.operators import anchors, postings, ranges, resolution
from lexforge.plans import fixtures


def test_anchor_across_pages(spark):
    """A run that goes over several short pages, a shorter one, and two paragraphs with the same beginning."""
    sheets = [["one", "(Two),"], ["three"], [], ["four", "five.", "six"], ["one", "two", "three", "four", "five"]]
    word = lambda t, i: (t, float(i), float(i), i + 1.0, i + 2.0)
    pages = spark.createDataFrame([("d", p, [word(t, i + p) for i, t in enumerate(ws)]) for p, ws in enumerate(sheets)],
                                  "document_id string, page int, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    asked = spark.createDataFrame([("d", 0, "One two a three four five six"), ("d", 1, "one TWO three four five and on"), ("d", 2, "five six"), ("d", 3, "six five"), ("d", 4, None)], "document_id string, para_id int, content string")
    got = {r.para_id: tuple(r)[2:] for r in anchors.visual_anchors(asked, pages).collect()}
    assert got == {0: (0, 0.0, 0.0, 5.0, 6.0), 1: (0, 0.0, 0.0, 5.0, 6.0), 2: (3, 4.0, 4.0, 6.0, 7.0)}


def test_query_type_bounds(spark):
    """A letter beyond A-Z next to a word is a boundary, as in the query's SQL."""
    rows = spark.createDataFrame([("Underüau",), ("Unders",)], "text string")
    got = [r.c for r in rows.select(segments.query_type(F.col("text"))[1].alias("c")).collect()]
    assert got == [0.333333333, 0.5]


def test_parts_meet_documents_not_candidates(spark):
    """Alternatives of equal points, a twin of the best and a number without candidates; the choice alone reads one row a number."""
    books = [("section", "1", f"c{i}", d, i) for i, d in enumerate(["Code", "RTE Act", None, "Code", "RTE Act"])] + [("section", "1", "c1", "Other", 1), ("rule", "1", "r", "Code", 9)]
    registry = spark.createDataFrame(books, "ref_type string, number string, canonical_id string, source_document string, seq long")
    refs = spark.createDataFrame([(1, "Section 1", "the rte act"), (2, "Section 1(a)", None), (3, "Section 2", "x")], "ref_id long, raw_text string, context string")
    got = {r.ref_id: (r.canonical_id, r.method, r.alternatives) for r in resolution.resolve_parts(refs, registry, "section").collect()}
    assert got == {1: ("c1", "exact_with_disambiguation", ["c0", "c1", "c2", "c3", "c4"]), 2: ("c0", "exact_with_disambiguation", ["c1", "c1", "c2", "c3", "c4"]), 3: (None, "failed", [])}
    met = refs.join(resolution._books(registry, "section"), F.lit("1") == F.col("base"))
    assert met.count() == 3


def test_places_in_no_single_task(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("a"), (F.col("id") % 3).alias("b"))
    got = ranges.placed(rows, ["b", "a"])
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(a, b, i + 1) for i, (b, a) in enumerate(sorted((r.b, r.a) for r in rows.collect()))]
    plan = fixtures.view(spark, "/root/testdata/sf0.001", "mentions")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_vertical_lowers_its_text_once(spark):
    """Not once a keyword: inside the keywords' function the text is a variable."""
    rows = spark.createDataFrame([("The ACT and rule of the section", "Act.pdf"), (None, None)], "text string, file_name string")
    rows = rows.select(*classify.vertical(F.col("text"), F.col("file_name")))
    assert "replace(lower(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in rows.collect()] == [("legal", 0.8), ("data", 0.3)]


def test_term_lists_are_cut_without_merged_parts(spark):
    """Terms that the first chunks settle, terms that need all, null groups; parts keep their number, whatever their bytes."""
    rng = random.Random(5)
    rows = [(f"c{i:04}", f"d{i:04}", rng.choice(["a", "b", "a\nAP"]), rng.randrange(9), ["every", rng.choice(["often", "softened", "seldom"]), f"rare{i % 300}"]) for i in range(4000)]
    held = spark.createDataFrame(rows, "chunk_id string, document_id string, grp string, age int, words array<string>")
    words = held.withColumn("word", F.explode("words")).drop("words")
    needs = spark.createDataFrame([(t, g) for t in ("ever", "ofte", "rare7", "none") for g in ("a", "b", "a\nAP", "other")], "term string, grp string")
    lists = postings.first_chunks(words, held, postings.word_grams(words.select("word").distinct()), needs, ["age", "chunk_id"], 10)
    want = {(t, g, c) for t, g in {tuple(r) for r in needs.collect()} for _, c in sorted((a, c) for c, _, x, a, ws in rows if x == g and any(t in w for w in ws))[:10]}
    got = [(r.term, r.grp, r.chunk_id) for r in lists.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "REPARTITION_BY_NUM" in lists._jdf.queryExecution().executedPlan().toString()


def test_domains_are_counted_once_a_text(spark):
    """Random texts of keywords, parts of these and letters beyond A-Z, against the pattern of the SQL; one search a domain."""
    rng, bits = random.Random(7), [k for ks in entities.DOMAINS.values() for k in ks] + ["DA", "édasch", "da", "İ", "\U0001d49c", "_", "9", "panel\U0001d49c", "Kleave", "pay  scale"]
    texts = [None, ""] + ["".join(rng.choice([" ", "", "-", "\n"]) + rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    listed, primary = entities.policy_domains(F.col("text"))
    made = rows.select("text", listed.alias("listed"), primary.alias("primary"), *[F.regexp_count(F.coalesce("text", F.lit("")), F.lit(entities.domain_pattern(d))).alias(d) for d in entities.DOMAINS])
    for r in made.collect():
        most = max(r[d] for d in entities.DOMAINS)
        assert r.listed == [d for d in entities.DOMAINS if r[d]], r.text
        assert r.primary == (next(d for d in entities.DOMAINS if r[d] == most) if most else "general"), r.text
    judged = rows.select(listed.alias("listed"), primary.alias("primary"))._jdf.queryExecution().optimizedPlan().toString()
    assert judged.count("regexp_count") <= 2 * len(entities.DOMAINS)


def test_act_name_of_a_line_of_many_words(spark):
    """Against a plain reading of each line; and a line of thousands of spaces and no word is not searched at all."""
    rng, bits = random.Random(9), ["The", "Education", "Act", "Acts", "RULES,", "rules", "2010", "20101", ",  1999", "norms", "Norm", "\r", " ", " Ordinance", "x" * 160, "of"]
    texts = [None, "", "the rules"] + ["\n".join(" ".join(rng.choices(bits, k=rng.randrange(0, 8))) for _ in range(3)) + "\nthe rules" for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = dict(map(tuple, rows.select("k", structure.act_name(F.col("text"))).collect()))

    def plain(text):
        for line in (text or "")[:2500].split("\n"):
            line, found = line.strip(), None
            for found in re.finditer(structure.ACT.replace(".", r"[^\n\r\x85  ]", 1), line, re.A):
                pass
            title = found and found[1].strip()
            name = f"{title} {found[2]}" + (f", {found[3]}" if found[3] else "") if found else line if "norms" in line.lower() and len(line) < 100 else None
            if name is not None and len(line) >= 5 and not (found and len(title) > 150):
                return name

    assert [got[i] for i, t in enumerate(texts)] == [plain(t) if any(w in (t or "").lower() for w in structure.ACT_WORDS) else None for t in texts]
    plan = rows.select(structure.act_name(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2


def test_normal_form_holds_short_batches(spark):
    """Whole texts are long rows, so a Python worker gets a few hundred at a time, whatever a table's size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        made = spark.range(2000).select(unicode.normal_form(F.concat(F.lit("ﬁ é "), "id"), "NFKC").alias("t"))
        assert int(spark.conf.get(key)) <= 256
        assert {r.t for r in made.collect()} == {f"fi é {i}" for i in range(2000)}
    finally:
        spark.conf.set(key, before)
