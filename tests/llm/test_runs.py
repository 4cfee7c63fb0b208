"""Periodic runs against brute force, in one tile and in many."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from lexforge.llm.periodic_runs import periodic_runs, tile_fragments, z_function
from lexforge.llm.queries import op13_periodic_runs

SCHEMA = "doc_id long, text string"


def brute(words):
    """(start, period, length) of every run, by each period in turn."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        m = 0
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                m += 1
            else:
                if m and m + q >= max(24, 3 * q):
                    out.setdefault((i - m, m + q), q)
                m = 0
    return sorted((s, q, length) for (s, length), q in out.items())


def collapsed(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, v, words = rng.choice([0, 5, 23, 24, 60, 300, 1500]), rng.choice([1, 2, 3, 50]), []
        while len(words) < n:
            unit = [f"w{rng.randrange(v)}" for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40, 100]))]
            words += (unit * rng.randrange(1, 12))[: rng.randrange(1, 400)] + (["x"] if rng.random() < 0.5 else [])
        yield words[:n]


def test_z_function():
    for words in made(3, 20):
        z = z_function(words)
        assert z == [next((k for k in range(len(words) - i) if words[k] != words[i + k]), len(words) - i) for i in range(len(words))]


@pytest.mark.parametrize("tile", [256, 1 << 16])
def test_against_brute_force(spark, tile):
    texts = [" \t".join(words) for words in made(5, 120)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        words = text.split()
        want = brute(words)
        assert [tuple(r) for r in got[i].runs] == want and got[i].n_words == len(words)
        assert got[i].collapsed == collapsed(words, want)


def test_awkward_rows(spark):
    """Null and empty texts, null and repeated ids, an added column of an own name, no rows."""
    wave = "a b c " * 20
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, wave, "x"), (3, wave, "x"), (3, wave, "x"), (4, "one", "x")], SCHEMA + ", runs string")
    got = periodic_runs(df).collect()
    assert len(got) == 6 and sum(len(r.runs) == 1 for r in got) == 3
    assert {tuple(r.runs[0]) for r in got if r.runs} == {(0, 3, 60)} and {r.collapsed for r in got if r.runs} == {"a b c"}
    assert all(r.collapsed == "" and r.n_words == 0 for r in got if r.doc_id in (1, 2))
    assert periodic_runs(df.limit(0)).count() == 0


def test_long_texts_take_time_in_proportion():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 2, 300_000), np.array([bin(i).count("1") & 1 for i in range(1 << 17)]), np.tile(rng.integers(0, 9, 5000), 40), np.zeros(60_000)):
        start = time.monotonic()
        tile_fragments(ids.astype(np.int32), 0)
        assert time.monotonic() - start < 30


def test_query_repeats_the_tails_it_is_told_to(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 300)))) for i in range(150)] + [(None, "a " * 30), (150, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[None].n_runs == 1
    for doc, text in rows[:-2]:
        words, h = text.split(), zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs, r = brute(words), got[doc]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, q, length in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        if runs:
            s, q, length = min(runs, key=lambda x: (-x[2] / x[1], x[0], x[1]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, length, q, 1000 * length // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
