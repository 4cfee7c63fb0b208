"""Chains and cycle groups against brute force, and their rounds on long chains and rings."""

import random

import pytest

from lexforge.operators import lineage


def groups(edges):
    """Greatest node of the group of each node that can reach itself."""
    nodes = {n for e in edges for n in e if None not in e}
    reach = {n: {d for s, d in edges if s == n and d is not None} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {n: max(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


def made(rng):
    """A few tangled parts: chains, rings with tails, trees, dense knots, loops."""
    n = rng.randrange(2, 26)
    name = rng.sample(range(100, 200), n)
    edges = [(rng.choice(name), rng.choice(name)) for _ in range(rng.randrange(1, 2 * n))] if rng.random() < 0.6 else []
    for _ in range(rng.randrange(3)):
        walk = rng.sample(name, rng.randrange(1, n + 1))
        edges += list(zip(walk, walk[1:], strict=False)) + ([(walk[-1], walk[0])] if rng.random() < 0.6 else [])
    return [(f"n{a}", f"n{b}") for a, b in edges] or [("n1", "n2")]


def test_cycle_groups_of_random_graphs(spark):
    rng, edges, want = random.Random(5), [], {}
    for g in range(60):
        part = [(f"{a}g{g:02d}", f"{b}g{g:02d}") for a, b in made(rng)]
        edges += part
        want |= groups(part)
    edges += [("x", None), (None, "y")]
    got = lineage.detect_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r.node: r.cycle_group for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("ring", [False, True])
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, ring):
    """A shuffled chain and a shuffled ring of 10,000 nodes, counted in writes to the shared folder."""
    names = [f"{x:05d}" for x in random.Random(1).sample(range(10_000), 10_000)]
    edges = list(zip(names, names[1:], strict=False)) + ([(names[-1], names[0])] if ring else [])
    writes, real = [], lineage.written
    monkeypatch.setattr(lineage, "written", lambda df, name: writes.append(name) or real(df, name))
    got = lineage.detect_cycles(spark.createDataFrame(edges, "src string, dst string")).groupBy("cycle_group").count().collect()
    assert [tuple(r) for r in got] == ([("09999", 10_000)] if ring else [])
    assert sum(w == "jumps" for w in writes) < 40 and len(writes) < 80


def chain_of(start, relations):
    after = {}
    for s, t, kind, seq in sorted(relations, key=lambda r: (r[3], r[0])):
        if kind in ("supersedes", "amends"):
            after.setdefault(t, s)
    out = []
    while start is not None and start not in out:
        out.append(start)
        start = after.get(start)
    return out


def test_ordered_chains(spark):
    rng, relations = random.Random(8), []
    for g in range(40):
        for i, (a, b) in enumerate(made(rng)):
            relations.append((f"{a}g{g:02d}", f"{b}g{g:02d}", rng.choice(["supersedes", "amends", "cites"]), i))
    df = spark.createDataFrame(relations, "source_id string, target_id string, relation_type string, seq int")
    chains = lineage.lineage_chains(df).collect()
    orders = {x for r in relations for x in r[:2] if r[2] != "cites"}
    assert sorted(r.go_id for r in chains) == sorted(orders)
    by_chain = {}
    for r in chains:
        by_chain.setdefault(r.chain, []).append((r.place, r.go_id))
    for head, rows in by_chain.items():
        rows.sort()
        assert [p for p, _ in rows] == list(range(len(rows))) and rows[0][1] == head
        assert [x for _, x in rows] == chain_of(head, relations)[: len(rows)]
    asked = spark.createDataFrame([(x,) for x in sorted(orders)] + [("alone",)], "go_id string")
    got = {}
    for r in lineage.ordered_lineage(asked, lineage.lineage_chains(df)).collect():
        got.setdefault(r.start, []).append((r.place, r.go_id))
    assert set(got) == orders | {"alone"}
    for start, rows in got.items():
        assert [x for _, x in sorted(rows)] == chain_of(start, relations) and [p for p, _ in sorted(rows)] == list(range(len(rows)))
    assert lineage.lineage_chains(df.limit(0)).count() == 0
