"""Lexical search by word postings against brute force, with hot terms, odd texts and a kept index."""

import random
from datetime import date

import pytest
from lexforge.operators import postings, search

QUERIES = "query_id long, text string, domains array<string>, since_date date, jurisdiction string"
DOCS = "document_id string, status string, doc_date date, primary_domain string, jurisdiction string"


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["school", "schooling", "preschool", "fee", "grant", "grants", "Rule", "élève", "x" * 300, "a grant", "ab"]
    chunks = [(f"c{i:04}", f"d{i // 2}", rng.choice([None, ""]) if i % 40 == 0 else " ".join(["government" if i % 3 else "", *rng.choices(parts, k=5)])) for i in range(n)]
    docs = [(f"d{i}", rng.choice(["active", "active", "old"]), rng.choice([None, date(2000 + i % 7, 1, 1)]), rng.choice(["a", "b", None]), rng.choice(["AP", "IN", None])) for i in range(n // 2)]
    texts = ["the GOVERNMENT grants school", "school", "a bc", None, "xxxxxxxxxx and rule", "élève government", "tion over nment"]
    queries = [(i, rng.choice(texts), rng.choice([["a"], ["a", "b", "a"], [], None]), rng.choice([None, date(2003, 1, 1)]), rng.choice([None, "AP"])) for i in range(40)]
    return queries, chunks, docs


def by_hand(queries, chunks, docs, top):
    known, out = {d[0]: d for d in docs}, set()
    for q, text, domains, since, place in queries:
        terms = [w for w in (text or "").lower().split() if len(w) > 3][:5]
        found = []
        for c, d, t in chunks:
            _, status, day, domain, where = known[d]
            if status == "active" and domain is not None and domain in (domains or []) and any(w in (t or "").lower() for w in terms):
                if (since is None or (day is not None and day >= since)) and (place is None or where == place):
                    found.append((-(day.toordinal() if day else 0), c))
        out |= {(q, c, n) for n, (_, c) in enumerate(sorted(found)[: 2 * top], 1)}
    return out


@pytest.mark.parametrize("top", [1, 5, 500])
def test_postings_find_what_reading_all_texts_finds(spark, top):
    queries, chunks, docs = corpus(300, top)
    frames = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, "chunk_id string, document_id string, text string"), spark.createDataFrame(docs, DOCS)
    got = search.lexical_search(*frames, top).collect()
    assert {(r.query_id, r.chunk_id, r.rnk) for r in got} == by_hand(queries, chunks, docs, top)
    assert len(got) == len({(r.query_id, r.chunk_id) for r in got})


def test_a_kept_index_serves_both_searches_without_the_texts(spark, tmp_path):
    queries, chunks, _ = corpus(120, 3)
    made = spark.createDataFrame(chunks, "chunk_id string, document_id string, text string")
    postings.lexical_index(made, str(tmp_path / "index"))
    index = postings.read_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame(queries, QUERIES)
    got = {(r.query_id, r.chunk_id) for r in search.clause_search(asked, made.filter("false"), 4, index).collect()}
    want = set()
    for q, text, *_ in queries:
        terms = [w for w in (text or "").lower().split()[:5] if len(w) > 3]
        want |= {(q, c) for c in sorted(c for c, _, t in chunks if any(w in (t or "").lower() for w in terms))[:4]}
    assert got == want
    assert index.postings.groupBy("word").agg({"salt": "max"}).filter("word = 'government'").first()[1] > 8


def test_no_chunks_and_no_queries(spark):
    queries, chunks, docs = corpus(20, 1)
    q, c, d = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, "chunk_id string, document_id string, text string"), spark.createDataFrame(docs, DOCS)
    assert search.lexical_search(q, c.filter("false"), d, 5).count() == 0
    assert search.lexical_search(q.filter("false"), c, d, 5).count() == 0
