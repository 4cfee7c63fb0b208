"""Exact Jaccard join on word n-grams with count-vector R-trees.

A document is the set of its distinct word shingles.  Shingles are hashed into groups, about
twice as many as two linked sets may differ in, and a set's group counts are its point.  Two
sets of sizes a and b with similarity s share at least s / (1 + s) * (a + b) shingles, and at
most the sum over groups of the smaller count, so a pair whose sum of coordinate minima is too
small is out without a look at the shingles.

The forest of R-trees is routed exactly.  Linked sets differ in at most d shingles, where d
follows from the larger size, so of d + 1 hash ranges of shingles one at least holds the same
shingles in both; some more ranges than that let sets leave out their empty ones.  A cell is a size band, a range and what a set has in it; only cells that
hold two different sets get an R-tree, and cells with the same members need one between them.
In a cell the points are packed into leaves with their upper corners, and search goes down
only where the corners' minima allow enough overlap.  Surviving pairs are verified on the
shingles of the whole texts.

Equal sets are one node from the start.  The first pass links each node of a cell with the
least node that its bound allows, which settles most groups.  The second pass searches only
cells with more than one label, and only between labels: it first finds the nodes that the
bound leaves with a possible partner, then reads the texts of these alone, verifies leaf
against leaf inside the cell and joins labels as links are found.  So no pass puts out more
rows than its cells have members, and no link between different components is lost.  Cells
over `block` nodes are dealt out as blocks in the first pass, and over `wide` nodes (fewer for
long texts, by bytes) as pairs of blocks in the second.

A document stands in d + 1 cells a band, so the largest cell holds at most about 1 / (d + 1)
of the rows dealt by cell; these rows are two integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, mix, ngram_hashes, short_batches, skew_join, staged, word_hashes

LEAF = 32
_RATIO = 0.85
_BLOCK_BYTES = 64 << 20


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of the whole text if it has fewer words."""
    hashes = word_hashes(raw, lower=True)
    if not len(hashes):
        return hashes
    return np.unique(ngram_hashes(hashes, min(words, len(hashes))))


def node_of(shingles: np.ndarray) -> int | None:
    """A hash of the set; none for an empty one."""
    if not len(shingles):
        return None
    return int(mix(mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _differ(size: int, percent: int) -> int:
    """In how many shingles a set of this size and one no larger may differ and be linked."""
    return 2 * size * (100 - percent) // (100 + percent)


def bands(percent: int, size: int) -> list[tuple[int, int, int]]:
    """(band, ranges, spare) in which a set of this size may meet a linked one.

    Band k holds pairs whose larger set has low_k <= size < low_(k+1); a smaller set counts
    from percent / 100 of low_k.  There are spare ranges beyond the d + 1 that the argument
    needs, about as many as a set leaves empty: see cell_keys.
    """
    found, low, band = [], 2, 0
    while percent * low <= 100 * size:
        high = max(low + 1, int(low / _RATIO) + 1)
        if size < high and (differ := _differ(high - 1, percent)):
            empty = (differ + 1) * math.exp(-low / (differ + 1))
            spare = math.ceil(empty + 2 * math.sqrt(empty))
            found.append((band, differ + 1 + spare, spare))
        low, band = high, band + 1
    return found


def cell_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """One key for each band and hash range: what the set holds there.

    Linked sets agree in spare + 1 ranges at least.  A set with no more than `spare` empty
    ranges leaves these out: one of those that it shares with a linked set is not empty, and
    the other set has that one too.
    """
    keys = [np.empty(0, np.uint64)]
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles), dtype=np.uint64, out=total[1:])
    high = shingles >> np.uint64(32)
    for band, ranges, spare in bands(percent, len(shingles)):
        at = np.searchsorted((high * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        held = total[at[1:]] - total[at[:-1]]
        own = mix(held + mix((np.arange(ranges, dtype=np.uint64) << np.uint64(16)) + np.uint64(band + 1)))
        empty = at[1:] == at[:-1]
        keys.append(own[~empty] if empty.sum() <= spare else own)
    return np.concatenate(keys)


def count_vector(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Counts of the hash groups, up to 255 each; a power of two of them, by the set's size."""
    groups = 16
    while groups < 2 * _differ(len(shingles), percent):
        groups *= 2
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8)


def count_matrix(raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors folded to the shortest one's groups, and what each set has beyond the counts kept."""
    groups = min(map(len, raw))
    points = np.empty((len(raw), groups), np.uint8)
    for i, x in enumerate(raw):
        points[i] = np.minimum(np.frombuffer(x, np.uint8).reshape(-1, groups).sum(axis=0), 255)
    return points, np.maximum(sizes - points.sum(axis=1, dtype=np.int64), 0)


def _need(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b, as a float bound."""
    return percent * (a + b) / (100 + percent) - 1e-9


def rtree_hits(sizes: np.ndarray, points: np.ndarray, rest: np.ndarray, percent: int, labels: np.ndarray | None = None):
    """(places of a leaf, places of a leaf, matrix of pairs that the bound allows), leaf pair by
    leaf pair; with labels only pairs of different ones."""
    order = np.lexsort((points[:, 0], sizes) if labels is None else (sizes, labels))
    leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    corner = np.stack([points[x].max(axis=0) for x in leaves])
    spare = np.array([rest[x].max() for x in leaves])
    least, most = (np.array([f(sizes[x]) for x in leaves]) for f in (min, max))
    if labels is not None:
        first, last = (np.array([f(labels[x]) for x in leaves]) for f in (min, max))
    for i, mine in enumerate(leaves):
        reach = np.minimum(corner[i], corner[i:]).sum(axis=1, dtype=np.int64) + np.minimum(spare[i], spare[i:]) >= _need(least[i], least[i:], percent)
        reach &= (100 * most[i] >= percent * least[i:]) & (100 * most[i:] >= percent * least[i])
        if labels is not None:
            reach &= ~((first[i] == last[i]) & (first[i:] == first[i]) & (last[i:] == first[i]))
        for j in np.flatnonzero(reach) + i:
            other = leaves[j]
            overlap = np.minimum(points[mine][:, None, :], points[other][None, :, :]).sum(axis=2, dtype=np.int64)
            overlap += np.minimum(rest[mine][:, None], rest[other][None, :])
            fits = overlap >= _need(sizes[mine][:, None], sizes[other][None, :], percent)
            if labels is not None:
                fits &= labels[mine][:, None] != labels[other][None, :]
            if i == j:
                fits = np.triu(fits, 1)
            if fits.any():
                yield mine, other, fits


def least_partners(ids: np.ndarray, hits) -> list[tuple[int, int]]:
    """For each place the place of the least id that it may link with, where that is less than its own."""
    best = ids.copy()
    at = np.arange(len(ids))
    for mine, other, fits in hits:
        for here, there, allowed in ((mine, other, fits), (other, mine, fits.T)):
            found = np.where(allowed, ids[there][None, :], np.iinfo(np.int64).max)
            k = found.argmin(axis=1)
            value = found[np.arange(len(here)), k]
            lower = value < best[here]
            best[here[lower]] = value[lower]
            at[here[lower]] = there[k[lower]]
    return [(i, int(b)) for i, b in enumerate(at) if b != i]


def _overlaps(one: list[np.ndarray], two: list[np.ndarray], fits: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, at least where fits."""
    rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    out = np.zeros(fits.shape, np.int64)
    vocabulary = np.unique(np.concatenate([one[i] for i in rows]))
    if fits.sum() <= 8 or len(vocabulary) > 1 << 17:
        for i, j in zip(*np.nonzero(fits), strict=True):
            out[i, j] = len(np.intersect1d(one[i], two[j], assume_unique=True))
        return out
    left, right = (np.zeros((len(x), len(vocabulary)), np.float32) for x in (rows, columns))
    for k, i in enumerate(rows):
        left[k, np.searchsorted(vocabulary, one[i])] = 1
    for k, j in enumerate(columns):
        place = np.minimum(np.searchsorted(vocabulary, two[j]), len(vocabulary) - 1)
        right[k, place[vocabulary[place] == two[j]]] = 1
    out[np.ix_(rows, columns)] = (left @ right.T).astype(np.int64)
    return out


def label_links(sets: list[np.ndarray], labels: np.ndarray, hits, percent: int) -> list[tuple[int, int]]:
    """Links between labels that join them, fewer than there are labels."""
    names, at = np.unique(labels, return_inverse=True)
    root = np.arange(len(names))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(x) for x in sets])
    for mine, other, fits in hits:
        ours, theirs = (np.array([find(x) for x in at[y]]) for y in (mine, other))
        fits = fits & (ours[:, None] != theirs[None, :])
        if not fits.any():
            continue
        common = _overlaps([sets[x] for x in mine], [sets[x] for x in other], fits)
        good = fits & linked(common, sizes[mine][:, None], sizes[other][None, :], percent)
        for x, y in zip(*np.nonzero(good), strict=True):
            a, b = sorted((find(at[mine[x]]), find(at[other[y]])))
            if a != b:
                root[b] = a
                out.append((int(labels[mine[x]]), int(labels[other[y]])))
    return out


def _groups(batches, key_columns: int):
    """Arrays of the rows of each key from batches sorted by key."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        keys = np.stack([columns[i] for i in range(key_columns)])
        cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(keys[:, a].tolist())
            if key != last and held:
                yield last, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append([c[a:b] for c in columns])
            last = key
    if held:
        yield last, [np.concatenate(x) for x in zip(*held, strict=True)]


def different_cells(routed: DataFrame) -> DataFrame:
    """(cell, hub, m): of the cells of distinct (cell, node) with two nodes at least, one for
    each set of members, with its least node and number.  Sets are told apart by their number
    and two checksums that can't overflow."""
    mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    return (
        routed.groupBy("cell").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("m"), *mark)
        .filter("hub <> last")
        .groupBy("hub", "last", "m", "mark0", "mark1").agg(F.min("cell").alias("cell"))
        .select("cell", "hub", "m")
    )


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, block: int = 2048, wide: int = 16384
) -> DataFrame:
    """Components of documents linked by 100 * |A & B| >= percent * |A | B|.

    Returns (id_col, n_shingles, component_id): the size of the document's set and the
    smallest id reachable by links, itself included.

    Null or empty text, or no words: an empty set, linked with nothing.  Null id: the row
    takes part in no link but that with equal sets, and its component is theirs (null if
    none has an id).  Rows that repeat an id are judged each by its own text.  Very long
    texts are whole sets; they lower the number of nodes in a block.  Other columns are not
    read.  Empty input: empty.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("raw"))

    def features(batches):
        for batch in batches:
            n, nodes, points = [], [], []
            for raw in batch.column(1):
                shingles = shingle_set(raw.as_py() or b"", words)
                n.append(len(shingles))
                nodes.append(node_of(shingles))
                points.append(count_vector(shingles, percent).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary())], names=["doc", "n", "node", "point"]
            )

    def cells_of(batches):
        """The cells of each node, once in a task."""
        seen: set[int] = set()
        for batch in batches:
            nodes, keys = [], []
            for raw in batch.column(1):
                shingles = shingle_set(raw.as_py() or b"", words)
                own = node_of(shingles)
                if own is not None and own not in seen:
                    seen.add(own)
                    nodes.append(own)
                    keys.append(cell_keys(shingles, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "cells"])

    known = staged(docs.mapInArrow(features, "doc long, n long, node long, point binary"), "shingles")
    # A node once in a cell, however many rows hold it; one exchange for all that follows by cell
    # (its null filter is the one that the join below adds, so that both its sides share it).
    routed = docs.filter("doc IS NOT NULL").mapInArrow(cells_of, "node long, cells array<long>")
    routed = routed.select("node", F.explode("cells").alias("cell")).filter("cell IS NOT NULL").repartition("cell").distinct()

    # Cells with two nodes at least; one of those with the same members.
    members = staged(routed.join(different_cells(routed), "cell").select("cell", "hub", "m", "node"), "cells")
    by_node = staged(
        known.filter("doc IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.count("*").alias("copies")), "nodes"
    )
    met = members.select("node").distinct()
    # A block holds `block` nodes in the first pass and `wide` in the second, whose cost in
    # pairs is the same however they are dealt; fewer where their shingles would take over
    # 64 MB (a cell's sets are all within a third of its hub's size).
    room = F.lit(_BLOCK_BYTES) / (F.col("hub_n") * 12)
    blocks_of = lambda most: F.ceil(F.col("m") / F.greatest(F.lit(1), F.least(F.lit(most), room))).cast("long")
    hub_sizes = by_node.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    points = known.filter("doc IS NOT NULL").join(met, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    points = staged(points, "points")
    sized = skew_join(members, hub_sizes, "hub", "node")
    placed = staged(sized.select("cell", "hub", "node", blocks_of(block).alias("blocks"), blocks_of(wide).alias("wide")), "placed")
    own = placed.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def by_cell(frame: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
        """run on the rows of each (cell, b1, b2)."""
        keyed = frame.select("cell", "b1", "b2", *columns)
        return keyed.repartition("cell", "b1", "b2").sortWithinPartitions("cell", "b1", "b2").mapInArrow(run, schema)

    def nearest(batches):
        """Each node and the least that it may link with."""
        for _, (_, _, _, ids, n, raw) in _groups(batches, 3):
            ids, first = np.unique(ids, return_index=True)
            points, rest = count_matrix(raw[first].tolist(), n[first])
            pairs = least_partners(ids, rtree_hits(n[first], points, rest, percent))
            if pairs:
                at = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 1]]), pa.array(ids[at[:, 0]])], names=["src", "dst"])

    def partnered(batches):
        """The nodes that may link with one of another label."""
        for (cell, b1, b2), (_, _, _, ids, n, raw, labels) in _groups(batches, 3):
            ids, first = np.unique(ids, return_index=True)
            points, rest = count_matrix(raw[first].tolist(), n[first])
            some = np.zeros(len(ids), bool)
            for mine, other, fits in rtree_hits(n[first], points, rest, percent, labels[first]):
                some[mine[fits.any(axis=1)]] = some[other[fits.any(axis=0)]] = True
            size = int(some.sum())
            if size:
                keys = [pa.array(np.full(size, x, np.int64)) for x in (cell, b1, b2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ids[some]), pa.array(labels[first][some])], names=["cell", "b1", "b2", "node", "label"])

    def joined(batches):
        """Links that join labels, verified on whole texts."""
        for _, (_, _, _, ids, raw, labels) in _groups(batches, 3):
            held: dict[int, tuple[np.ndarray, int]] = {}
            for i, text, label in zip(ids.tolist(), raw, labels.tolist(), strict=True):
                if i not in held and node_of(shingles := shingle_set(text or b"", words)) == i:
                    held[i] = shingles, label
            if len(held) < 2:
                continue
            sets = [x for x, _ in held.values()]
            sizes, own_labels = np.array([len(x) for x in sets]), np.array([x for _, x in held.values()])
            points, rest = count_matrix([count_vector(x, percent).tobytes() for x in sets], sizes)
            found = label_links(sets, own_labels, rtree_hits(sizes, points, rest, percent, own_labels), percent)
            if found:
                at = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["src", "dst"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, judged on their whole texts."""

        def run(batches):
            for batch in batches:
                src, dst, one, two = (batch.column(i) for i in range(4))
                keep = np.zeros(batch.num_rows, bool)
                last, left = None, None
                for i in range(batch.num_rows):
                    if src[i].as_py() != last:
                        last, left = src[i].as_py(), shingle_set(one[i].as_py() or b"", words)
                    right = shingle_set(two[i].as_py() or b"", words)
                    if node_of(left) == src[i].as_py() and node_of(right) == dst[i].as_py():
                        keep[i] = linked(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right), percent)
                yield pa.RecordBatch.from_arrays([src, dst], names=["src", "dst"]).filter(pa.array(keep))

        left = texts.select(F.col("node").alias("src"), F.col("raw").alias("one"))
        right = texts.select(F.col("node").alias("dst"), F.col("raw").alias("two"))
        both = skew_join(pairs, left, "src", "dst").join(right, "dst").select("src", "dst", "one", "two")
        return both.mapInArrow(run, "src long, dst long")

    # First pass: inside blocks, with the cell's least node in each block.
    hubs = placed.filter("node = hub AND blocks > 1").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = own.unionByName(hubs).withColumns({"b1": F.col("b"), "b2": F.col("b")})
    pairs = staged(by_cell(blocks.join(points, "node"), ["node", "n", "point"], nearest, "src long, dst long").distinct(), "pairs")
    # Texts of nodes that meet another: one row's, whose set is the node's.
    texts = staged(docs.join(met.join(by_node.select("node", "doc"), "node"), "doc").select("node", "raw"), "texts")
    labels = connected_components(verified(pairs))

    # Second pass: between labels, in cells that still have several.
    labelled = placed.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").select(
        "cell", "node", F.coalesce("label", "node").alias("label"), "wide", F.pmod(F.xxhash64("node"), F.col("wide")).alias("b")
    )
    labelled = staged(labelled, "labelled")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1))
    mixed = (
        labelled.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("wide").alias("wide"))
        .filter("low <> high").select("cell", every.alias("b"))
    )
    dealt = (
        labelled.join(mixed, ["cell", "b"]).withColumn("other", every)
        .withColumns({"b1": F.least("b", "other"), "b2": F.greatest("b", "other")}).join(points, "node")
    )
    open_nodes = staged(
        by_cell(dealt, ["node", "n", "point", "label"], partnered, "cell long, b1 long, b2 long, node long, label long"), "open"
    )
    later = connected_components(by_cell(open_nodes.join(texts, "node"), ["node", "raw", "label"], joined, "src long, dst long"))

    named = by_node.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(later.select(F.col("id").alias("label"), F.col("label").alias("last")), "label", "left")
    named = staged(named.select("node", "doc", F.coalesce("last", "label").alias("label")), "named")
    ids = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    component = staged(skew_join(named, ids, "label", "node").select("node", "component_id"), "components")
    return skew_join(known.select("doc", "n", "node"), component, "node", "doc", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    )
