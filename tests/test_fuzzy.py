"""Candidates of fuzzy numbers against all pairs, and their number on digit strings."""

import random
from difflib import SequenceMatcher

import pytest

from lexforge.operators.resolution import candidates, resolve_fuzzy


@pytest.mark.parametrize(("kind", "percent"), [("section", 80), ("go", 85)])
def test_all_pairs_over_the_threshold_are_found(spark, kind, percent):
    rng = random.Random(percent)

    def text():
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 13, 14, 18, 25])
        return "".join(rng.choice("012A(") for _ in range(n))

    def edited(t):
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "7"]) + t[i + rng.randrange(2) :]
        return t or "1"

    asked = sorted({text() for _ in range(150)})
    known = sorted({text() for _ in range(60)} | {edited(t) for t in asked})
    a = spark.createDataFrame([(t,) for t in asked], "number string")
    met = {tuple(r) for r in candidates(a, spark.createDataFrame([(t,) for t in known], "match string"), percent).collect()}
    over = {(x, y): r for x in asked for y in known if (r := SequenceMatcher(None, x, y).ratio()) > percent / 100}
    assert set(over) <= met
    registry = spark.createDataFrame([(kind, t, None, f"c{t}", "d", i) for i, t in enumerate(known)], "ref_type string, number string, year string, canonical_id string, source_document string, seq long")
    got = {r.number: (r.match, r.ratio) for r in resolve_fuzzy(a, registry, kind).collect()}
    want = {x: max(((r, -known.index(y)), y) for (z, y), r in over.items() if z == x) for x, _ in over}
    assert got == {x: (y, round(r, 9)) for x, ((r, _), y) in want.items()}


def test_candidates_grow_with_the_numbers(spark):
    """Each number of digits meets few others, however many there are."""
    met = []
    for n in (500, 2000):
        rng = random.Random(n)
        sides = [spark.createDataFrame([(str(x),) for x in rng.sample(range(10 * n), n)], f"{c} string") for c in ("number", "match")]
        met.append(candidates(*sides, 80).count())
    assert met[1] < 8 * met[0] and met[1] < 15 * 2000
