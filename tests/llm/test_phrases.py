"""Phrase counts and collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from lexforge.llm.phrase_mining import collocations, mine_phrases
from lexforge.llm.queries import op11_phrase_mining

SCHEMA = "doc_id long, text string, lang string"


def counts(rows, longest=5):
    f = {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            c[()] += len(w)
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def brute(rows, least, top=2000):
    out = []
    for lang, f in counts(rows).items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in good.items():
            if inside[p] >= a:
                continue
            score, _, l, r = min((1000 * a * f[()] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, f[()], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def prose(rng, n):
    made = []
    for _ in range(n):
        made.append(rng.choice(["alpha beta gamma delta epsilon zeta", "Alpha beta", "été\tÉté", "one. two", "x x x x x x", "ß,ß;Q"]) if rng.random() < 0.2 else f"w{min(rng.randrange(60), rng.randrange(60))}")
        made.append(rng.choice([" ", " ", "  ", "\t", "\n", ", "]))
    return "".join(made)


def corpus(seed=3, docs=80):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["en", "en", "en", "de", None])) for i in range(docs)]
    return rows + [(90, None, "en"), (91, "", "fr"), (None, "alpha beta gamma", "en"), (1, " .,\n", "en")]


@pytest.mark.parametrize(("shards", "bits"), [(3, 1 << 16), (1, 1 << 16), (4, 64)])
def test_counts_and_collocations(spark, shards, bits):
    rows = corpus()
    mined = mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(5), least=6, shards=shards, bits=bits).collect()
    want = {(lang, len(p), " ".join(p), n) for lang, f in counts(rows).items() for p, n in f.items() if n >= 6 and p or not p and n}
    assert {tuple(r) for r in mined} == want and len(mined) == len(want)
    got = collocations(spark.createDataFrame(mined), top=25).collect()
    best = [r for r in brute(rows, 6, 25)]
    assert sorted(tuple(r) for r in got) == best and {r[0] for r in best} >= {"en", "und"}


def test_phrases_that_reach_the_threshold_late(spark):
    """Words of one shard's rows only, so that longer phrases start in later cycles."""
    rows = [(i, "a b c d e f" if i % 7 == 6 else "q r s", "en") for i in range(140)]
    mined = mine_phrases(spark.createDataFrame(rows, SCHEMA).coalesce(1), least=20, shards=3, bits=1 << 12).collect()
    assert {(r.phrase, r.f) for r in mined if r.k == 5} == {("a b c d e", 20), ("b c d e f", 20)} and {r.f for r in mined if r.k == 3} == {20, 120}


def test_query_and_awkward_tables(spark, tmp_path):
    rows = [(i, "New York, new york is big. " * 3, "en") for i in range(60)] + [(99, "x" * 3_000_000 + " tail words", "en"), (98, None, None)]
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", phrase string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in op11_phrase_mining(spark, str(tmp_path)).collect()) == brute(rows, 100)
    assert collocations(mine_phrases(spark.createDataFrame([], SCHEMA))).count() == 0
