"""Components and the n-gram join on chains, hubs and shuffled paths."""

import random

import numpy as np

from lexforge.llm.common import connected_components, skew_join
from lexforge.llm.ngram_jaccard import cell_keys, count_matrix, count_vector, label_links, ngram_jaccard_join, rtree_hits

EDGES = "src long, dst long"


def labels(spark, edges):
    return {x.id: x.label for x in connected_components(spark.createDataFrame(edges, EDGES)).collect()}


def test_shuffled_path_hub_and_loops(spark):
    ids = list(range(10, 5010))
    random.Random(3).shuffle(ids)
    path = [(a, b) for a, b in zip(ids, ids[1:], strict=False)]
    hub = [(9000, 9001 + i) for i in range(300)] + [(9500, 9001), (8000, 9500)]
    got = labels(spark, [*path, *hub, (1, 1), (hub[0][1], hub[0][0]), *path[:5]])
    assert {got[x] for x in ids} == {10} and len(got) == 5000 + 303
    assert {got[x] for x in got if x >= 8000} == {8000} and 1 not in got


def test_path_in_order_and_no_edges(spark):
    assert set(labels(spark, [(i, i + 1) for i in range(700)]).values()) == {0}
    assert labels(spark, []) == {}


def test_chain_of_near_copies(spark):
    """Each document is one word off the one before; the ends share nothing."""
    words, rows = [f"w{j}" for j in range(200)], []
    for i in range(900):
        words = list(words)
        words[i * 7 % 200] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 900 and {x.component_id for x in got} == {0}


def test_links_between_labels_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 330, replace=False) if k % 3 else base[:330], rng.integers(0, 1 << 62, rng.integers(1, 40), dtype=np.uint64)])) for k in range(150)]
    sizes = np.array([len(x) for x in sets])
    own = np.arange(150)
    points, rest = count_matrix([count_vector(x, 80).tobytes() for x in sets], sizes)
    for percent in (80, 72, 90):
        links = label_links(sets, own, rtree_hits(sizes, points, rest, percent, own), percent)
        root = list(range(150))

        def find(x, root=root):
            return x if root[x] == x else find(root[x])

        for a in range(150):
            for b in range(a):
                c = len(np.intersect1d(sets[a], sets[b]))
                if 100 * c >= percent * (sizes[a] + sizes[b] - c):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        mine = list(range(150))
        for a, b in links:
            x, y = find(a, mine), find(b, mine)
            assert x != y
            mine[max(x, y)] = min(x, y)
        assert [find(x) for x in range(150)] == [find(x, mine) for x in range(150)] and len(links) < 150


def test_clipped_counts_keep_the_bound():
    many = np.arange(0, 1 << 20, 16, dtype=np.uint64)
    near = many[:-3000]
    raw = [count_vector(x, 90).tobytes() for x in (many, near)]
    points, rest = count_matrix(raw, np.array([len(many), len(near)]))
    overlap = int(np.minimum(points[0], points[1]).astype(int).sum() + min(rest))
    assert overlap >= len(near)


def test_join_on_a_heavy_key(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 1000 + i) for i in range(50)], "k long, v long")
    right = spark.createDataFrame([(i, i * 2) for i in range(0, 300, 2)] + [(1, 7)], "k long, w long")
    for how in ("inner", "left"):
        got = sorted(map(str, skew_join(left, right, "k", "v", how, heavy=20, salts=4).collect()))
        assert got == sorted(map(str, left.join(right, "k", how).collect()))


def test_linked_sets_share_a_cell():
    """Whatever a set leaves out, two linked sets of any size meet."""
    rng = np.random.default_rng(9)
    pairs = 0
    for percent in (80, 90):
        for size in [*range(5, 60), *range(60, 900, 37)]:
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                drop = rng.integers(0, size // 4 + 1)
                b = np.unique(np.concatenate([rng.choice(a, len(a) - drop, replace=False), rng.integers(0, 1 << 63, rng.integers(0, size // 5 + 1), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
                    pairs += 1
                    assert np.intersect1d(cell_keys(a, percent), cell_keys(b, percent)).size
    assert pairs > 200
