"""The policy-document operators on small literal frames, and all queries' SQL on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lexforge import registry
from lexforge.functions import cleaning, entities, segments
from lexforge.operators import lineage
from lexforge.operators import relations as r
from lexforge.operators import retrieval as t
from lexforge.operators import warehouse as w
from lexforge.streaming.ingest import ingest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("cln_09_standardize_refs", "G.O.Ms.No.123", "G.O.Ms.No. 123"),
        ("cln_09_standardize_refs", "GO MS No 123", "G.O.Ms.No. 123"),
        ("cln_09_standardize_refs", "Sec.12 §12 12/05/2024", "Section 12 Section 12 12-05-2024"),
        ("cln_03_fix_hyphenation", "educa-\ntion", "education"),
        ("cln_04_remove_page_markers", "a\n- 3 -\nb", "a\nb"),
        ("cln_05_remove_artifacts", "a<b>c</b>[Image: x]©", "ac"),
        ("cln_06_normalize_whitespace", "  a   b \n\n\n\n c ", "a b\n\nc"),
        ("cln_07_fix_ocr_words", "Govemment 0rder", "Government Order"),
    ],
)
def test_cleaning(spark, name, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(cleaning.step(name, F.col("text"))).first()[0] == want


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("go_numbers", "G.O.Ms.No. 7, GO No 12 and Government Order No. 7", ["GO.MS.No.12", "GO.MS.No.7"]),
        ("sections", "Section 12A(b) Sec. 3 § 4", ["Section 12A(b)", "Section 3", "Section 4"]),
        ("rules", "Rule 5(a), rules, 2023", ["Rule 5(a)", "Rule rules, 2023"]),
        ("dates", "12-05-2024, 3rd March 2021 and January 5, 2020", ["12-05-2024", "3rd March 2021", "January 5, 2020"]),
        ("dates", None, []),
    ],
)
def test_entities(spark, kind, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(entities.found_entities(F.col("text"), kind)).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Transfers; transfer, LEAVE", (["transfer", "leave"], "transfer")), ("leave salary", (["salary", "leave"], "salary")), ("éda", ([], "general")), ("", ([], "general")), (None, ([], "general"))],
)
def test_domains(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert tuple(df.select(*entities.policy_domains(F.col("text"))).first()) == want


def test_departments_and_confidence(spark):
    df = spark.createDataFrame([("dept of school education", "x 8B y"), ("General Admin", "Vide 12"), (None, None)], "d string, t string")
    rows = df.select(entities.department(F.col("d")), F.round(entities.ocr_confidence(F.col("t"), F.lit(1.0)), 6)).collect()
    assert [tuple(x) for x in rows] == [("SCHOOL_EDUCATION", 0.6), ("GENERAL_ADMINISTRATION", 0.8), ("UNKNOWN", 1.0)]


def test_candidate_sentences_keep_order(spark):
    df = spark.createDataFrame([("A. It amends b! no.  this cancels c",), (None,)], "t string")
    rows = df.select(entities.candidate_sentences(F.col("t")), F.size(entities.candidate_sentences(F.col("t"), None))).collect()
    assert [tuple(x) for x in rows] == [(["It amends b", "this cancels c"], 2), ([], 0)]


def test_risk_detection(spark):
    want = spark.createDataFrame([(1, "none"), (2, "none"), (3, "high"), (4, "low"), (5, None)], "query_id int, risk_level string")
    got = spark.createDataFrame([(1, "none"), (2, "low"), (3, "none"), (5, "low")], "query_id int, risk_level string")
    assert tuple(t.risk_detection(want, got).first()) == (4, 1, 3, 1, 1, 0.25)
    assert tuple(t.risk_detection(want.limit(0), got).first()) == (0, 0, 0, 0, 0, 0.0)


def test_precedence_keeps_the_strongest(spark):
    rows = [("a", "b", "references", 0.9, "full", "1", 1), ("a", "b", "supersedes", 0.5, "full", "1", 2), ("a", "c", "amends", 0.5, "full", "1", 3)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, relation_type string, confidence double, scope string, section string, seq long")
    assert {(x.target_id, x.relation_type) for x in r.precedence(df).collect()} == {("b", "supersedes"), ("c", "amends")}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1e-5, 0.0])], "id int, v array<double>")
    got = {x.id: x.reason for x in w.validate_vectors(df, "v", 2).collect()}
    assert got == {1: "all_zero", 2: None, 3: "dimension", 4: "dimension", 5: "not_finite", 6: "norm_small"}


def rounded(x):
    if isinstance(x, float | Decimal):
        return round(float(x), 7)
    return [rounded(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_values_match_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = tables.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(str(rounded([row[names.index(c)] for c in columns])) for row in found.fetchall())
    assert sorted(str(rounded(list(row))) for row in df.select(*columns).collect()) == want


def test_lineage_follows_chains_and_leaves_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x")]
    rels = spark.createDataFrame([(s, t, "amends", i) for i, (s, t) in enumerate(edges)], "source_id string, target_id string, relation_type string, seq long")
    orders = spark.createDataFrame([(k,) for k in "abcdxyzw"], "go_id string")
    got = {x.go_id: (x.root, x.depth) for x in lineage.trace_lineage(orders, rels).collect()}
    assert got == {"a": ("d", 3), "b": ("d", 2), "c": ("d", 1), "d": ("d", 0), "x": (None, None), "y": (None, None), "z": ("z", 0), "w": (None, None)}
    assert lineage.trace_lineage(orders.limit(0), rels.limit(0)).count() == 0


def test_segments(spark):
    df = spark.createDataFrame([("One. Two? no\n\n1. a\n2. b\n \nEnd",), ("",), (None,)], "text string")
    got = df.select(segments.paragraphs(F.col("text")), segments.sentences(F.col("text"))).collect()
    assert [tuple(x) for x in got] == [(["One. Two? no", "1. a", "2. b", "End"], ["One.", "Two? no\n\n1. a\n2. b\n \nEnd"]), ([], []), (None, None)]
    df = spark.createDataFrame([("ok line\nab§§§§§\nఅఆ5\n\n12ééé 3 ééé 4 ééé",)], "text string")
    assert df.select(segments.drop_garbage_lines(F.col("text"))).first()[0] == "ok line\n\n12ééé 3 ééé 4 ééé"


def test_ingest_takes_new_files_only(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id int, text string"
    for i in range(2):
        spark.createDataFrame([(i, "x"), (i + 10, None)], schema).write.mode("append").parquet(source)
        got = ingest(spark, source, spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "log"))
        assert sorted(x.id for x in got.collect()) == list(range(i + 1))
