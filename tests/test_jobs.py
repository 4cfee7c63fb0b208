"""Jobs that SQL can't express, on small literal frames and by their properties."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge import registry
from lexforge.functions import classify, embedding, mentions, packing, report_tables, spans
from lexforge.functions import unicode as u
from lexforge.operators import chunking, extraction, lineage, packages, relations, resolution, search
from lexforge.operators import warehouse as w
from lexforge.sources import files, sinks

DATA = "/root/testdata/sf0.001"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "pattern"), [("a1bb22c333", r"[a-z]+(\d+)"), ("vide 12, vide  13", r"vide\s+(\d+)"), ("none", r"(\d)"), ("12", r"(\d)"), (None, r"(\d)"), ("é7x ü8", r"(\d)")])
def test_spans_are_those_of_finditer(spark, text, pattern):
    import re

    got = [tuple(h) for h in one(spark, text, lambda c: spans.spans(c, pattern))]
    assert got == [(m.start(), m[0], m[1]) for m in re.finditer(pattern, text or "")]


def test_packing():
    paragraphs = ["a" * 400, "b" * 300, "c" * 500, "d" * 90, "e" * 10]
    chunks = packing._packed(paragraphs, 500, 1000, 80)
    assert chunks[0] == "a" * 400 + "\n\n" + "b" * 300 and all(p in "\n\n".join(chunks) for p in paragraphs)
    assert packing._packed(["x" * 10], 500, 1000, 80) == [] and packing._packed([], 1, 2, 0) == []
    assert packing._packed(["a" * 600, "b" * 600, "c" * 10], 500, 1000, 80)[-1].endswith("c" * 10)
    assert packing._pointed(["a" * 6, "b" * 6, "c" * 2], 10, "|", False) == ["aaaaaa", "bbbbbb|cc"]
    assert packing._pointed(["a" * 6, "b" * 6], 10, "|", True) == ["aaaaaa", "aaaaaa|bbbbbb"]


def test_chunkers_keep_the_text(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [
        ("legal", f"Section 1. Short title — {long}\n(a) {long}\n(b) {long}\nSection 2. Next — small text here that stays whole."),
        ("judicial", f"HEADNOTE: 1. first point\nRATIO: {long}. {long}. {long}\n\nsecond paragraph\nJUDGMENT: allowed"),
        ("scheme", f"Benefits: these\n- {long}\n- short one\nHow to apply: anywhere"),
        ("data", f"Intro {long}\nTable 1: rows\na | b | c | d\n\n\nAfter {long}"),
    ]
    for kind, text in rows:
        df = spark.createDataFrame([("d", text), ("short", "x"), ("null", None)], "document_id string, text string")
        got = {"legal": chunking.chunk_legal, "judicial": chunking.chunk_judicial, "scheme": chunking.chunk_scheme, "data": chunking.chunk_data}[kind](df).orderBy("chunk_index").collect()
        assert [x.chunk_index for x in got] == list(range(len(got))) and {x.document_id for x in got} == {"d"}
        held = " ".join(x.content for x in got)
        assert all(f"word{i}" in held for i in range(400)) and len(got) >= 2
    assert [x.table_name for x in got if x.chunk_type == "table"] == ["Table 1"]


def test_normalize_unicode(spark):
    assert one(spark, "“ﬁne”​ – it’s… ok", u.normalize_unicode) == '"fine" - it\'s... ok'
    assert one(spark, None, u.clean_text) == "" and one(spark, "  a  b ", u.clean_text) == "a b"
    assert one(spark, "x Educa-\n tion  ACT", lambda c: u.locate_excerpt(c, F.lit("education act"))) == 2


def test_act_mentions(spark):
    text = "Under the Andhra Pradesh Education Act, 1982: and the School Fees Regulation Act. officers for act."
    acts = one(spark, text, mentions.act_mentions)
    assert acts and all(a.lower().endswith("act") for a in acts)
    assert one(spark, ["Right to Education Act, 2009", "Fee Act", "Fee Act"], mentions.normalized_acts, "array<string>") == [("Right to Education Act", "2009"), ("Fee Act", None)]


def test_query_domains(spark):
    row = spark.createDataFrame([("Is the quota for school fees fair?", "risk_analysis"), ("nothing", None)], "t string, k string")
    found = classify.query_domains(F.col("t"), F.col("k"))
    got = row.select(F.transform(found["domains"], lambda d: F.struct(d["domain"], d["confidence"])).alias("d"), "t", found["depth"].alias("depth"), found["verticals"].alias("v")).collect()
    assert [tuple(x) for x in got[0].d] == [("education", 0.65), ("constitutional", 0.65), ("administrative", 0.6), ("finance", 0.65), ("social_justice", 0.65)]
    assert got[0].depth == "deep" and (got[1].d, got[1].depth, got[1].v) == ([], "standard", ["go", "judicial", "legal", "scheme"])


def test_fuzzy_numbers_against_all_pairs(spark):
    known = [str(n) for n in range(1000, 1400, 7)] + ["77", "123456"]
    asked = [str(n) for n in range(1001, 1300, 11)] + ["1234567", "78", "12a3456"]
    registry_ = spark.createDataFrame([("section", k, None, f"id{k}", "b", i) for i, k in enumerate(known)], "ref_type string, number string, year string, canonical_id string, source_document string, seq int")
    got = {x.number: (x.match, round(x.ratio, 6)) for x in resolution.resolve_fuzzy(spark.createDataFrame([(x,) for x in asked], "number string"), registry_, "section").collect()}
    want = {}
    for a in asked:
        best = max(((SequenceMatcher(None, a, k).ratio(), -i, k) for i, k in enumerate(known)))
        if best[0] > 0.8:
            want[a] = (best[2], round(best[0], 6))
    assert got == want and want


def test_self_references_by_name_stay(spark):
    rows = [("go_1", "case of A v B"), ("go_1", "go_1"), ("go_12", "order 1"), ("go_1", None), (None, "go_2")]
    got = relations.drop_self_refs(spark.createDataFrame(rows, "source_id string, target_id string")).collect()
    assert sorted(map(str, [tuple(x) for x in got])) == sorted(map(str, [rows[0], rows[3], rows[4]]))


def test_null_part_is_not_a_good_vector(spark):
    df = spark.createDataFrame([([None, 1.0],), ([0.0, 0.0],), ([1.0, 0.0],)], "v array<double>")
    assert [x.reason for x in w.validate_vectors(df, "v", 2).collect()] == ["not_finite", "all_zero", None]


def test_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("x", "a"), ("e", "y"), (None, "a")]
    got = {x.node: x.cycle_group for x in lineage.detect_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "d": "e", "e": "e", "f": "f"}
    assert lineage.detect_cycles(spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0


def test_report_tables():
    text = "Table 1: Enrolment by year\nSchool | Boys | Girls | All\nA | 10 | 12 | 22\n\nB | 9 | 11 | 20\nFigure 2: Growth\nTable 2. Empty\nwords only"
    first, second = report_tables.tables(text)
    assert (first[0], first[1], first[4], first[5]) == ("1", "Enrolment by year", ["School", "Boys", "Girls", "All"], 3) and first[3].endswith("20")
    assert (second[0], second[4], second[5]) == ("2", [], 0)


def test_embedding_is_independent_of_order(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "", None, "c", "a b", " "])], "k int, text string").withColumn("embedding", F.lit("clash"))
    rows = {x.k: (x.embedding, x.embedding_error) for x in embedding.embed_texts(df.repartition(3), batch=1).collect()}
    assert rows[0] == rows[4] and rows[1] == rows[2] == rows[5] == (None, "Empty text") and np.isclose(np.linalg.norm(rows[3][0]), 1)


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "My File-1.txt").write_text("one\ntwo")
    (tmp_path / "in" / "sub" / "b.txt").write_text("b+c")
    (tmp_path / "in" / "c.pdf").write_text("no")
    got = {x.doc_id: x.text for x in files.corpus_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"my_file_1": "one\ntwo", "b": "b+c"}
    (tmp_path / "golden.json").write_text('[{"query_id": "1", "query_type": "factual"}, {"query_id": "2", "query_type": "temporal"}]')
    assert [x.query_id for x in files.golden_set(spark, str(tmp_path / "golden.json"), query_type="temporal").collect()] == ["2"]
    import uuid

    ids = spark.createDataFrame([("d", "c"), ("dé", "c2")], "d string, c string").select("d", "c", sinks.point_id(F.col("d"), F.col("c")).alias("p")).collect()
    assert all(x.p == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{x.d}|{x.c}")) for x in ids)


def test_relations_of_a_text(spark):
    text = "In supersession of G.O.Ms.No. 12 and vide 7. Rule 5 is hereby amended. It overrules the decision in Mehta v. Rao."
    df = spark.createDataFrame([("a", "judicial", text), ("b", "go", text), ("c", "go", None)], "document_id string, vertical string, text string")
    got = {(x.document_id, x.relation_type, x.go_number) for x in extraction.extract_relations(df).collect()}
    assert got == {(d, t, n) for d in "ab" for t, n in (("supersedes", "12"), ("references", "7"), ("amends", "5"))} | {("a", "overrules", None)}


def test_queries_without_terms_find_nothing(spark):
    chunks = spark.createDataFrame([("c1", "d1", "School Fees rise"), ("c2", "d2", None)], "chunk_id string, document_id string, text string")
    docs = spark.createDataFrame([("d1", "active", "education", "AP"), ("d2", "active", "education", "AP")], "document_id string, status string, primary_domain string, jurisdiction string").withColumn("doc_date", F.current_date())
    queries = spark.createDataFrame([(1, "what FEES are due", ["education"]), (2, "a b c", ["education"]), (3, None, ["education"]), (4, "fees", None)], "query_id int, text string, domains array<string>")
    assert [(x.query_id, x.chunk_id) for x in search.lexical_search(queries, chunks, docs, 5).collect()] == [(1, "c1")]


def test_empty_answer_package(spark):
    queries = spark.createDataFrame([(1, "What is the rule?")], "query_id long, text string")
    hits = spark.createDataFrame([], "query_id long, chunk_id string, document_id string, source string, score double, rnk int")
    docs = registry.view(spark, DATA, "papers")
    row = packages.answer_package(queries, hits, registry.view(spark, DATA, "overrulings"), docs).first()
    assert (row.n_hits, row.citations, row.confidence, row.risk_level, row.timeline) == (0, "", 0.0, "none", None)


def test_ingest_corpus_reports_every_document(spark):
    texts = registry.view(spark, DATA, "filings").select("document_id", "file_name", "text").limit(25).unionByName(spark.createDataFrame([("tiny", "a.txt", "few words"), ("none", "b.txt", None)], "document_id string, file_name string, text string"))
    out = packages.ingest_corpus(texts, registry.view(spark, DATA, "books"))
    results = {x.document_id: x for x in out["results"].collect()}
    assert len(results) == 27 and results["tiny"].failed_stage == results["none"].failed_stage == "extraction"
    assert all(x.n_chunks > 0 for x in results.values() if x.status == "success")
    assert {"supersedes", "amends"} <= {x.relation_type for x in out["relations"].collect()}


def test_whole_texts_are_embedded(spark):
    """A word behind the first 20,000 characters counts, unless a longest length is given."""
    from lexforge.functions.embedding import embed_texts

    df = spark.createDataFrame([("a", "same " * 5000), ("b", "same " * 5000 + "other " * 900)], "chunk_id string, text string")
    whole, cut = ({r.chunk_id: r.embedding for r in embed_texts(df, longest=n).collect()} for n in (None, 20_000))
    assert whole["a"] != whole["b"] and cut["a"] == cut["b"]
