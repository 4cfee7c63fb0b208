"""Layered and routed retrieval: k by query, first layers, empty and unknown pipelines."""

from datetime import date

from lexforge.operators import routed
from pyspark.sql import functions as F


def frames(spark):
    docs = [(f"d{i:02}", f"T{i}", ["go", "judgment", "regulation"][i % 3], date(2000 + i, 1, 1), "Supreme Court" if i % 3 == 1 else None, "binding", "active", ["education", "judicial"][i % 2], "AP") for i in range(60)]
    made = spark.createDataFrame(docs, "document_id string, title string, doc_type string, doc_date date, court string, binding_strength string, status string, primary_domain string, jurisdiction string")
    chunks = spark.createDataFrame([(f"c{i:02}", f"d{i:02}", "school fees") for i in range(60)], "chunk_id string, document_id string, text string")
    vectors = spark.createDataFrame([(f"c{i:02}", f"d{i:02}", [1.0, float(i)]) for i in range(60)], "chunk_id string, document_id string, vector array<double>")
    asked = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(1, 8)], "query_id long, vector array<double>")
    relations = spark.createDataFrame([("d01", "d59", "overrules")], "source_id string, target_id string, relation_type string")
    return chunks, made, vectors, asked, relations


def test_each_pipeline_has_its_own_k_and_parts(spark):
    chunks, docs, vectors, asked, relations = frames(spark)
    queries = spark.createDataFrame([(1, "fees", "P1"), (2, "school", "P4"), (3, "school", "P9"), (4, "nothing here", "P5"), (5, None, "P3"), (6, "fees", None)], "query_id long, text string, pipeline string")
    queries = queries.withColumn("domains", F.array(F.lit("education"), F.lit("judicial")))
    hits = routed.pipeline_retrieve(queries, chunks, docs, vectors, asked, relations)
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 15, 2: 40}
    assert hits.filter("document_id = 'd59'").count() == 0
    got = {r.query_id: r for r in routed.pipeline_package(queries, hits, relations, docs).collect()}
    assert len(got) == 6 and got[1].n_hits == 15 and got[1].risk_level is None and got[1].timeline is None
    assert len(got[2].timeline.split("; ")) == 40 and len(got[2].comparison.split("; ")) == 40 and got[2].risk_score > 0 and got[2].constraints is None
    assert (got[3].pipeline_name, got[3].n_hits, got[3].confidence) == (None, 0, 0.0)
    assert (got[4].n_hits, got[4].confidence, got[4].constraints, got[4].risk_level) == (0, 0.0, "", "none")
    assert len(routed.audit_rows(hits, docs).collect()) == 10


def test_a_chunk_stays_in_its_first_layer_and_priorities_lead(spark):
    chunks, docs, vectors, asked, relations = frames(spark)
    queries = spark.createDataFrame([(1, "fees", 20, ["go"], ["judicial", "go"], None), (2, "fees", 9, None, [], ["go"])], "query_id long, text string, top_k int, primary_verticals array<string>, binding_verticals array<string>, impact_verticals array<string>")
    rows = routed.layered_retrieve(queries, chunks, docs, vectors, asked, relations).collect()
    one = [r for r in rows if r.query_id == 1]
    assert len({r.chunk_id for r in one}) == len(one) and sum(r.layer == "primary" for r in one) == 10 and all(r.layer != "impact" for r in one)
    kinds = {r.document_id: r.doc_type for r in docs.collect()}
    assert {kinds[r.document_id] for r in one if r.layer == "binding"} <= {"judgment", "regulation"}
    assert [r.layer for r in rows if r.query_id == 2] == ["impact"]
    assert routed.layered_retrieve(queries.filter("false"), chunks, docs, vectors, asked, relations).count() == 0


def test_year_and_place_of_candidates(spark):
    _, docs, _, _, _ = frames(spark)
    queries = spark.createDataFrame([(1, 2003, "AP"), (2, None, None), (3, 2003, "IN")], "query_id long, year int, jurisdiction string")
    pairs = queries.select("query_id").crossJoin(docs.select("document_id").limit(6))
    got = routed.filtered_candidates(queries, pairs.union(pairs), docs).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 1, 2: 6}
