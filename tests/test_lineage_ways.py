"""Ways back and on of orders against brute force, and their rounds through many chains."""

import random

import pytest
from test_lineage import made

from lexforge.operators import lineage

COLUMNS = "source_id string, target_id string, relation_type string, seq int"


def test_a_way_through_many_chains_takes_few_rounds(spark, monkeypatch):
    """Each of 60 orders follows two, and stands in the chain of the one that is not on the way; counted in writes."""
    relations = [(f"p{i + 1:03d}", target, "supersedes", i) for i in range(60) for target in (f"p{i:03d}", f"a{i:03d}")]
    chains = lineage.written(lineage.lineage_chains(spark.createDataFrame(relations, COLUMNS)), "chains")
    assert chains.filter("chain LIKE 'p%'").count() == 1 and chains.select("chain").distinct().count() == 61
    writes, real = [], lineage.written
    monkeypatch.setattr(lineage, "written", lambda df, name: writes.append(name) or real(df, name))
    asked = spark.createDataFrame([("p000",), ("a010",), ("alone",)], "go_id string")
    got = sorted(tuple(r) for r in lineage.ordered_lineage(asked, chains).collect())
    ways = {"p000": [f"p{i:03d}" for i in range(61)], "a010": ["a010"] + [f"p{i:03d}" for i in range(11, 61)], "alone": ["alone"]}
    assert got == sorted((start, place, x) for start, way in ways.items() for place, x in enumerate(way))
    assert len(writes) < 12


@pytest.mark.parametrize("small", [0, 100_000])
def test_ways_and_roots_of_random_graphs(spark, monkeypatch, small):
    monkeypatch.setattr(lineage, "SMALL", small)
    rng, relations = random.Random(11), []
    for g in range(40):
        for i, (a, b) in enumerate(made(rng)):
            target = None if rng.random() < 0.03 else f"{b}g{g:02d}"
            relations.append((f"{a}g{g:02d}", target, rng.choice(["supersedes", "amends", "cites"]), i // 2))
    relations += [(None, "n1g00", "amends", 0), ("x", "x", "amends", 1)]
    names = sorted({x for r in relations for x in r[:2] if x} | {"alone"})
    edges = [r for r in relations if r[2] != "cites"]
    first, after = {}, {}
    for s, t, _, seq in sorted(edges, key=lambda r: (r[3], r[1] or "")):
        first.setdefault(s, t)
    for s, t, _, seq in sorted((e for e in edges if e[0] and e[1]), key=lambda r: (r[3], r[0])):
        after.setdefault(t, s)

    def way(at, on):
        out = []
        while at is not None and at not in out:
            out.append(at)
            at = on.get(at)
        return out

    df, orders = spark.createDataFrame(relations, COLUMNS), spark.createDataFrame([(x,) for x in names], "go_id string")
    want = {x: (way(x, first)[-1], len(way(x, first)) - 1) if way(x, first)[-1] not in first else (None, None) for x in names}
    assert {r.go_id: (r.root, r.depth) for r in lineage.trace_lineage(orders, df).collect()} == want
    got = sorted(tuple(r) for r in lineage.ordered_ways(orders, lineage.following(df)).collect())
    assert got == sorted((x, place, y) for x in names for place, y in enumerate(way(x, after)))


def test_ways_of_a_long_ring_with_a_tail(spark):
    ring, tail = [f"r{i:03d}" for i in range(300)], [f"t{i:02d}" for i in range(70)]
    walk = tail + ring + ring[:1]
    pointers = spark.createDataFrame(list(zip(walk, walk[1:], strict=False)), "node string, at string")
    asked = spark.createDataFrame([("t00",), ("r123",)], "go_id string")
    got = sorted(tuple(r) for r in lineage.ordered_ways(asked, pointers).collect())
    assert got == sorted([("t00", i, x) for i, x in enumerate(tail + ring)] + [("r123", i, x) for i, x in enumerate(ring[123:] + ring[:123])])
