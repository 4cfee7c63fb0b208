"""The training-data operators against brute force on small frames with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import byte_bpe, html_extract, media, mixing, sharding
from lexforge.llm.hilbert_search import hilbert_search
from lexforge.llm.ngram_jaccard import ngram_jaccard_join
from lexforge.llm.queries import tokenizer
from lexforge.llm.substring_dedup import substring_dedup
from lexforge.llm.toxicity import toxicity
from lexforge.llm.url_filter import url_filter

DOCS = "doc_id long, text string, source string, n_removed string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = [[rng.choice(words) for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([1, 5, 19, 20, 21, 60, 200]))]
        if i % 3 == 0:
            text += rng.choice(shared)
        if i % 10 == 7 and rows[-1][1]:
            text = rows[-1][1].split()
            if i % 20 == 7 and len(text) > 100:
                text[50] = "other"
        rows.append((i, " ".join(text), f"s{i % 3}" if i % 7 else None, "clash"))
    return [*rows, (n, None, "s0", "x"), (n + 1, "", "s1", "x"), (n + 2, " \t\n", None, "x"), (None, "w1 w2 w3 " * 30, "s0", "x"), (n + 3, "loop " * 100, "s0", "x")]


def test_substring_dedup(spark):
    rows = corpus()
    got = {x.doc_id: x for x in substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    seen, total = set(), 0
    for doc, text, *_ in rows:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - 19):
            run = tuple(words[i : i + 20])
            if doc is not None:
                if run in seen:
                    gone |= set(range(i, i + 20))
                seen.add(run)
        assert (got[doc].n_words, got[doc].n_removed) == (len(words), len(gone))
        if text is None:
            assert got[doc].text is None
        else:
            assert got[doc].text == " ".join(x for i, x in enumerate(words) if i not in gone)
        total += len(gone)
    assert total > 100 and substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_ngram_jaccard(spark):
    rows = corpus(2, 120)
    base = [w for _, t, *_ in rows if t for w in t.split()][:400]
    rows += [(1000 + i, " ".join([*base[:i], "x", *base[i + 1 :]]), "s", "x") for i in range(0, 60, 2)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard_join(spark.createDataFrame(rows, DOCS), block=8, wide=16).collect()}
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").lower().split()
        sets[doc] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {d: d for d in sets if d is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for d in ids:
        assert got[d] == (len(sets[d]), find(d))
    assert len({find(d) for d in ids}) < len(ids) - 10


def test_mixing(spark):
    df = spark.createDataFrame(corpus(3, 200), DOCS).filter("doc_id IS NOT NULL")
    plan = mixing.mix_plan(df)
    rows = plan.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(df).collect()))
    for source in {x.source for x in rows}:
        own = [x for x in rows if x.source == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 1 and sum(x.size for x in own) == own[0].source_size
    assert all(x.taken <= 3 * x.size and x.taken == sum(d.words for d in x.draws) for x in rows)
    assert sum(len(x.draws) for x in rows) == mixing.mix(df).count()
    assert mixing.targets([10, 100], [1, 1], 3) == [30.0, 80.0]
    assert mixing.splitting_tree(np.array([100, 7, 0]), 16, 1).sum(axis=0).tolist() == [100, 7, 0]
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.example.com/en/7x?q", "https://x.com/en/", "http://b.net/de/1", "http://example.net/de/8", "http://casino.org/", "http://a/free-win", "http://a/freewin", "no", None, "http://ads-track.org/es/"]
    got = [(x.rule, x.verdict) for x in url_filter(spark.createDataFrame([(u,) for u in urls], "url string")).collect()]
    assert got == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/es/", "block")]


def test_sharding():
    table = sharding.lookup_table()
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    assert sum(a != b for a, b in zip(table, less, strict=True)) / len(table) < 0.1


def test_search_finds_all_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (rng.normal(size=8) if i % 3 else np.ones(8))]) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert_search(df, F.col("vec_id") % 20 == 0, least_window=64).collect()
    found = total = 0
    for q in range(0, 300, 20):
        order = sorted((-float(np.einsum("d,d->", np.array(rows[q][1]), np.array(v))), i) for i, v in rows[:300] if i != q)[:20]
        found += len({i for _, i in order} & {x.vec_id for x in got if x.query_id == q})
        total += 20
    assert found / total >= 0.9


def test_bpe_matches_the_library(spark):
    import tiktoken

    ranks, pattern = tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "don't  stop\n\n", "<|endoftext|>", "é漢字²½  x", *("".join(rng.choices(" \n\t'sabdé漢1.,! \x1c", k=40)) for _ in range(200))]
    texts += ["".join(rng.choices([chr(i) for i in range(0x250)], k=30)) for _ in range(2000)] + ["ab" * 500, "a" * 300 + " " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for x in byte_bpe.bpe_decode(byte_bpe.bpe_encode(df, ranks, pattern), ranks).collect():
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == encoding.encode_ordinary(x.text or "") and bytes(x.decoded).decode() == (x.text or "")


def test_native_fold_matches(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"abcabc": 259}
    df = spark.createDataFrame([(w,) for w in ("", "a", "abc", "abcabc", "bcab", "xbcx")], "word string")
    many = byte_bpe._Merges(ranks).fold([x.word.encode() for x in df.collect() if x.word])
    assert all(np.frombuffer(ids, "<u4").tolist() == byte_bpe.fold(word, ranks) for word, ids in many.items())
    for x in byte_bpe.fold_words(df, ranks).collect():
        assert x.ids == (byte_bpe.fold(x.word.encode(), ranks) if x.word else [])


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 192, "é" * 5000]
    df = media.read_media(media.pack_media(spark.createDataFrame([(t,) for t in texts], "text string")))
    for x in df.collect():
        raw = media.pad((x.text or "").encode())
        assert bytes(x.payload) == raw and x.duration == len(raw) / media.RATE and x.packets == len(raw) // media.PACKET
        assert all(bytes(x.media)[k.offset : k.offset + k.size] == raw[i * 8 * 192 :][:192] for i, k in enumerate(x.keyframes))
    assert media.read_media(spark.createDataFrame([(b"junk",)], "media binary")).first().media_error


def test_html_extraction():
    pages = html_extract.labelled_pages(60, seed=99)
    w, a = html_extract.train()
    pairs = [(y, z) for f, labels in pages for y, z in zip(labels, html_extract.viterbi(f, w, a), strict=True)]
    assert np.mean([y == z for y, z in pairs]) > 0.97
    page = '<nav><a href="/">x</a></nav><article><h1>T &amp; U</h1><p><b>One  two.<br><p>Three</article><footer>&copy; f</footer>'
    assert html_extract.main_text(page, w, a) == "T & U\n\nOne two.\n\nThree" and html_extract.main_text("", w, a) == ""


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=60) + ["zonk"] * (i % 6 == 0))) for i in range(600)] + [(900, None), (901, ""), (None, "zonk")]
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)] + [(None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 600]
    assert np.mean([x.predicted == (x.doc_id % 6 == 0) for x in held]) > 0.97 and len(got) == len(rows)
    assert {x.score for x in toxicity(spark.createDataFrame(rows[:3], "doc_id long, text string"), labels.limit(0)).collect()} == {0.0}


def test_repeated_hash_is_stable():
    assert hashlib.sha256(media.pack(b"a")).hexdigest() == hashlib.sha256(media.pack(b"a")).hexdigest() and re.match("raw", media.describe(media.pack(b"a"))["codec"])


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages(spark, stage):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert got.count() > 0 and (stage == 4 or got.columns == docs.columns)
