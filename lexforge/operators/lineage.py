"""Chains and cycles of the relation graph, by pointer doubling, contraction and trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import written
from .ranges import told


#: Doubled pointers up to so many rows go to every task; of more, rows are sorted and merged.
SMALL = 100_000


def doubled(pointers: DataFrame) -> tuple[list[tuple[DataFrame, int]], DataFrame | None]:
    """The pointers (node, at), one a node and stored, of 1, 2, 4 ... hops with their counts, and
    the last of those whose nodes run into rings, whose at are the rings' nodes (None: no rings).

    A table holds only nodes that have as many hops before them, so tables shrink as ways end,
    and one that shrinks no more holds nodes without an end only.  Rounds grow with the
    logarithm of the longest way and are written to the shared folder.
    """
    tables, size, before, rings = [], pointers.count(), None, None
    while size:
        tables.append((pointers, size))
        if size == before:
            was, rings = rings, pointers.agg(F.count_distinct("at")).first()[0]
            if rings == was:
                return tables, pointers
        pointers = _twice(pointers)
        before, size = size, pointers.count()
    return tables, None


def _twice(pointers: DataFrame) -> DataFrame:
    on = pointers.select(F.col("node").alias("at"), F.col("at").alias("_at"))
    return written(pointers.join(on, "at").select("node", F.col("_at").alias("at")), "doubled")


def _hopped(rows: DataFrame, node: str, table: DataFrame, size: int) -> DataFrame:
    """rows with _at, where a doubled pointer leads from their node, or null."""
    on = table.select(F.col("node").alias(node), F.col("at").alias("_at"))
    return rows.join(on.hint("broadcast" if size <= SMALL else "merge"), node, "left")


def trace_lineage(orders: DataFrame, relations: DataFrame) -> DataFrame:
    """go_id, root and depth: where following each order's first supersedes or amends edge ends.

    The first edge is that of least (seq, target_id).  Orders go the doubled pointers, each at
    most once, from the longest to the shortest.  Those that are then still on a way that runs
    into a cycle, or at a first edge without a target, have a null root and depth.
    """
    edges = relations.filter(F.col("relation_type").isin("supersedes", "amends") & F.col("source_id").isNotNull())
    first = written(edges.groupBy(F.col("source_id").alias("node")).agg(F.min(F.struct("seq", "target_id"))["target_id"].alias("at")), "first")
    tables, looped = doubled(first.filter("at IS NOT NULL"))
    rows = orders.select("go_id", F.col("go_id").alias("root"), F.lit(0).cast("long").alias("depth"))
    for n, (table, size) in reversed(list(enumerate(tables))):
        rows = _hopped(rows, "root", table, size).select("go_id", F.coalesce("_at", "root").alias("root"), F.when(F.col("_at").isNull(), F.col("depth")).otherwise(F.col("depth") + (1 << n)).alias("depth"))
    lost = first.filter("at IS NULL").select("node")
    if looped is None and not lost.limit(1).count():
        return rows
    lost = lost if looped is None else lost.union(looped.select("node"))
    rows = rows.join(lost.select(F.col("node").alias("root"), F.lit(True).alias("_lost")), "root", "left")
    ended = lambda c: F.when(F.col("_lost").isNull(), F.col(c)).alias(c)
    return rows.select("go_id", ended("root"), ended("depth"))


def newer_same_topic(orders: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """For each order the first (by seq) later order of its department that shares two words of its subject.

    orders: go_id, department (null is a department), go_date, subject, seq.  Words count if
    longer than four characters.  Orders in `superseded` (go_id) ask for none, but may be the
    later one.

    Words of one order only are left out, then each pair of an order's words is a key.  A key's
    orders of one day are one row, so what its window holds grows with days and not with
    orders; along these, from the latest, the least seq so far is the answer.  Orders are never
    paired up, and a key of very many orders gets its answers in parts.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("subject", F.lit(""))), r"\s+"), lambda w: F.length(w) > 4))
    # A null department is one of its own.
    own = F.when(F.col("department").isNull(), "").otherwise(F.concat(F.lit("="), "department"))
    rows = orders.filter("go_date IS NOT NULL").select("go_id", own.alias("office"), "seq", (-F.unix_date("go_date")).alias("age"), F.explode(words).alias("word"))
    shared = rows.groupBy("office", "word").count().filter("count > 1").drop("count")
    kept = told(rows, shared, ["office", "word"], "go_id").groupBy("go_id", "office", "seq", "age").agg(F.array_sort(F.collect_set("word")).alias("words"))
    # In two steps, so that no row holds all pairs of a long subject.  Words are kept as 64-bit
    # hashes with their department, so a key of two is one of 128 bits.
    firsts = kept.select("go_id", "seq", "age", F.transform("words", lambda w: F.xxhash64("office", w)).alias("words")).select("go_id", "seq", "age", "words", F.posexplode("words").alias("at", "a"))
    pairs = firsts.select("go_id", "seq", "age", "a", F.explode(F.slice("words", F.col("at") + 2, F.size("words"))).alias("b"))
    keyed, key = written(pairs, "pairs"), ["a", "b"]
    days = keyed.groupBy(*key, "age").agg(F.min(F.struct("seq", "go_id")).alias("first"))
    later = W.partitionBy(*key).orderBy("age").rowsBetween(W.unboundedPreceding, -1)
    answers = days.select(*key, "age", F.min("first").over(later).alias("hit")).filter("hit IS NOT NULL")
    first = told(keyed, answers, [*key, "age"], "go_id").groupBy("go_id").agg(F.min("hit").alias("hit"))
    out = first.select("go_id", F.col("hit.go_id").alias("superseded_by"))
    return out if superseded is None else out.join(superseded.select("go_id"), "go_id", "left_anti")


def jumps(pointers: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Where following (node, to), one pointer a node, ends: (node, end, hops, least, at), and the
    pointers of 1, 2, 4 ... hops that the rounds doubled.

    A node that runs into a ring has a null end, and at is a node of the ring; least is the
    least node of what it runs through, which for a node of the ring is the ring's.  Rounds
    grow with the logarithm of the longest way and are written to the shared folder.
    """
    ends = pointers.select(F.col("to").alias("node")).distinct().join(pointers, "node", "left_anti")
    now = pointers.select("node", F.col("to").alias("at"), F.lit(1).cast("long").alias("hops"), F.least("node", "to").alias("least"), F.lit(False).alias("done"))
    now = written(now.unionByName(ends.select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("hops"), F.col("node").alias("least"), F.lit(True).alias("done"))), "jumps")
    tables, before = [], None
    while True:
        tables.append(now.select("node", "at"))
        on = now.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        step = now.join(on, "at").select(
            "node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("least", "_least").alias("least"), (F.col("done") | F.col("_done")).alias("done"),
            ((F.col("done") | F.col("_done")) & ~F.col("done")).alias("_ended"), (F.col("_least") < F.col("least")).alias("_sank"),
        )
        step = written(step, "jumps")
        # The nodes that open ways have come to grow fewer until they are those of the rings.
        moved, rings = step.agg(F.max((F.col("_ended") | (F.col("_sank") & ~F.col("done"))).cast("int")), F.count_distinct(F.when(~F.col("done"), F.col("at")))).first()
        now = step.drop("_ended", "_sank")
        if not moved and rings in (0, before):
            break
        before = rings
    return now.select("node", F.when(F.col("done"), F.col("at")).alias("end"), "hops", "least", "at"), tables


def _edges(relations: DataFrame) -> DataFrame:
    return relations.filter(F.col("relation_type").isin("supersedes", "amends") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())


def following(relations: DataFrame) -> DataFrame:
    """(node, at): what follows each order, the source of its first incoming edge, that of least
    (seq, source_id)."""
    return _edges(relations).groupBy(F.col("target_id").alias("node")).agg(F.min(F.struct("seq", "source_id"))["source_id"].alias("at"))


def lineage_chains(relations: DataFrame) -> DataFrame:
    """Every order of a supersedes or amends edge once, in a chain from older to newer:
    (go_id, chain, place, next_chain, next_place).

    What follows an order is the source of its first incoming edge, that of least (seq,
    source_id).  An order that follows several stands in the chain of the least of them; the
    others' chains end there and go on at (next_chain, next_place), so all chains together are
    as long as there are orders.  A cycle is opened before its least order.  chain is the
    chain's first order, places count from 0.
    """
    edges = _edges(relations)
    after = written(following(relations).select("node", F.col("at").alias("next")), "after")
    # Back along the chains: each order points to the least one that it follows.
    back = written(after.filter("node <> next").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("to")), "back")
    found, _ = jumps(back)
    found = written(found, "found")
    # In a cycle every order points on; the least one's pointer is left out.
    looped = found.filter("end IS NULL").select("node", "least")
    heads = looped.filter("node = least").select("node")
    ranked = found.filter("end IS NOT NULL").select("node", F.col("end").alias("chain"), F.col("hops").alias("place"))
    if heads.limit(1).count():
        again, _ = jumps(back.join(looped, "node", "left_semi").join(heads, "node", "left_anti"))
        ranked = ranked.unionByName(again.select("node", F.col("end").alias("chain"), F.col("hops").alias("place")))
    orders = edges.select(F.col("source_id").alias("node")).union(edges.select("target_id")).distinct()
    ranked = written(orders.join(ranked, "node", "left").select("node", F.coalesce("chain", "node").alias("chain"), F.coalesce("place", F.lit(0)).alias("place")), "ranked")
    to = ranked.select(F.col("node").alias("next"), F.col("chain").alias("next_chain"), F.col("place").alias("next_place"))
    linked = ranked.join(after, "node", "left").join(to, "next", "left")
    # Inside a chain the next order is the next place; only a chain's last order links on.
    inside = (F.col("next_chain") == F.col("chain")) & (F.col("next_place") == F.col("place") + 1)
    link = lambda c: F.when(~F.coalesce(inside, F.lit(True)), F.col(c))
    return linked.select(F.col("node").alias("go_id"), "chain", "place", link("next_chain").alias("next_chain"), link("next_place").alias("next_place"))


def ordered_lineage(asked: DataFrame, chains: DataFrame) -> DataFrame:
    """(start, place, go_id): the whole ordered chain from each asked order (go_id) on, oldest first.

    It is followed over the chains' links until it ends or would meet an order again.  Orders
    without edges are alone.
    """
    to = chains.select(F.col("chain").alias("_c"), F.col("place").alias("_p"), F.col("go_id").alias("at"))
    links = chains.select(F.col("go_id").alias("node"), F.coalesce("next_chain", "chain").alias("_c"), F.coalesce("next_place", F.col("place") + 1).alias("_p"))
    return ordered_ways(asked, links.join(to, ["_c", "_p"]).select("node", "at"))


def ordered_ways(asked: DataFrame, pointers: DataFrame) -> DataFrame:
    """(start, place, go_id): the way of the pointers (node, at), one a node, from each asked order
    (go_id) on, until it ends or would meet an order again.

    From the longest of the doubled pointers to the shortest, each place found so far gives the
    one that lies so many hops on, so every place is made once, by as many joins as the longest
    way has binary digits.
    """
    tables, looped = doubled(written(pointers, "after"))
    rows = asked.select(F.col("go_id").alias("start")).distinct().select("start", F.lit(0).cast("long").alias("place"), F.col("start").alias("go_id"), F.lit(None).cast("long").alias("length"))
    if looped is not None:
        lengths = written(_lengths(tables[0][0], looped), "lengths")
        rows = rows.drop("length").join(lengths.withColumnRenamed("node", "start"), "start", "left")
        longest = lengths.agg(F.max("length")).first()[0]
        while 1 << len(tables) < longest:
            tables.append((_twice(tables[-1][0]), tables[-1][1]))
    for n, (table, size) in reversed(list(enumerate(tables))):
        on = F.col("place") + (1 << n)
        here, there = F.struct("place", "go_id"), F.struct(on.alias("place"), F.col("_at").alias("go_id"))
        more = F.col("_at").isNotNull() & (F.col("length").isNull() | (on < F.col("length")))
        rows = _hopped(rows, "go_id", table, size).select("start", "length", F.explode(F.when(more, F.array(here, there)).otherwise(F.array(here))).alias("_row")).select("start", "_row.place", "_row.go_id", "length")
    return rows.select("start", "place", "go_id")


def _lengths(pointers: DataFrame, looped: DataFrame) -> DataFrame:
    """(node, length): how many nodes are met from each node that runs into a ring, itself included."""
    ring = written(looped.select(F.col("at").alias("node")).distinct(), "ring")
    ways = pointers.join(looped.select("node"), "node", "left_semi").select("node", F.col("at").alias("to"))
    around = jumps(ways.join(ring, "node", "left_semi"))[0].select("node", "least")
    sizes = around.groupBy("least").agg(F.count("*").alias("length"))
    around = written(around.join(sizes, "least").select("node", "length"), "ring")
    tails = jumps(ways.join(ring, "node", "left_anti"))[0].filter("hops > 0").select("node", "end", "hops")
    entered = tails.join(around.withColumnRenamed("node", "end"), "end").select("node", (F.col("hops") + F.col("length")).alias("length"))
    return around.unionByName(entered)


def detect_cycles(edges: DataFrame) -> DataFrame:
    """Nodes of (src, dst) that can reach themselves, with the greatest node of their cycle group.

    Nodes with one way out are contracted into where their ways end, found by doubling, then
    those with one way in, and nodes without a way in or out are left out, until nothing
    shrinks; chains, rings and trees so take rounds by the logarithm of their length.  What is
    left is coloured: every node takes the greatest node that reaches it, and those that reach
    their colour's own node are a group, which leaves.  Then the contracted nodes that lie
    between a group's nodes are added to it.  Rounds are written to the shared folder.
    """
    live = written(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "cycles")
    layers, groups = [], []
    # A node with an edge to itself is a group of its own, if of no greater one.
    own = live.filter("src = dst").select(F.col("src").alias("node"))
    live = written(live.filter("src <> dst"), "cycles")
    size = live.count()
    while size:
        before = size
        for way, other in (("src", "dst"), ("dst", "src")):
            live, layer, ring, loop = _contracted(live, way, other)
            layers.append((loop, layer))
            groups.append(ring)
            live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            live = written(live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "cycles")
        size = live.count()
        if size == before:
            group = _coloured(live)
            groups.append(group.withColumn("_n", F.count("*").over(W.partitionBy("rep"))).filter("_n > 1").drop("_n"))
            gone = group.select(F.col("node").alias("src"))
            live = written(live.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti"), "cycles")
            size = live.count()
    found = edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("rep"))
    for group in groups:
        found = found.unionByName(group)
    alone = lambda nodes: nodes.join(found, "node", "left_anti").select("node", F.col("node").alias("rep"))
    found = written(found, "found")
    for loop, layer in reversed(layers):
        # A node that its contracted neighbours gave an edge to itself is a group, if it is in no greater one.
        found = written(found.unionByName(alone(loop)), "found")
        found = _expanded(found, *layer)
    found = found.unionByName(alone(own))
    return found.withColumn("cycle_group", F.max("node").over(W.partitionBy("rep"))).select("node", "cycle_group")


def _contracted(live: DataFrame, way: str, other: str):
    """Edges after contraction of the nodes with one edge from `way` to `other`, and what undoes it."""
    degree = live.groupBy(F.col(way).alias("node")).agg(F.count("*").alias("n"), F.min(other).alias("to"))
    single = written(degree.filter("n = 1").select("node", "to"), "single")
    found, tables = jumps(single)
    found = written(found, "ends")
    # Ways that never end run into a ring, which has no other way on; its nodes point back to themselves.
    lost = found.filter("end IS NULL")
    ring = lost.join(lost.select(F.col("at").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least").alias("rep"))
    ends = found.filter("end IS NOT NULL").select("node", "end")
    tree = written(single.join(ends, "node").select("node", "to", "end"), "tree")
    rest = live.join(single.select(F.col("node").alias(way)), way, "left_anti")
    rest = rest.join(lost.select(F.col("node").alias(other)), other, "left_anti")
    moved = written(rest.join(ends.select(F.col("node").alias(other), "end"), other, "left").select(F.col(way), F.coalesce("end", other).alias(other), F.col(other).alias("entry")), "moved")
    loop = moved.filter("src = dst").select(F.col("src").alias("node")).distinct()
    left = written(moved.filter("src <> dst").select("src", "dst").distinct(), "cycles")
    entries = moved.filter(F.col("entry") != F.col(other)).select(F.col(way).alias("from"), F.col(other).alias("end"), "entry")
    return left, (tree, entries, tables), ring, loop


def _expanded(found: DataFrame, tree: DataFrame, entries: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """found with the contracted nodes that lie on a way from an entry to its end inside a group."""
    one, two = (found.select(F.col("node").alias(c), F.col("rep").alias(f"_{c}")) for c in ("from", "end"))
    marked = entries.join(one, "from").join(two, "end").filter("_from = _end").select(F.col("entry").alias("node"), F.col("_end").alias("rep")).distinct()
    marked = written(marked, "marked")
    if not marked.limit(1).count():
        return found
    inside = tree.select("node")
    for table in tables:
        marked = written(marked.unionByName(marked.join(table, "node").select(F.col("at").alias("node"), "rep").join(inside, "node", "left_semi")).distinct(), "marked")
    return written(found.unionByName(marked.join(found, "node", "left_anti")), "found")


def _coloured(live: DataFrame) -> DataFrame:
    """(node, rep) of a cycle group of each colour of a graph where every node has ways in and out."""
    colour = written(live.select(F.col("dst").alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
    moved = 1
    while moved:
        heard = live.join(colour, live["src"] == colour["node"]).groupBy("dst").agg(F.max("colour").alias("heard"))
        step = colour.join(heard, colour["node"] == heard["dst"], "left").select("node", F.greatest("colour", "heard").alias("new"), "colour")
        colour = written(step, "colours")
        moved = colour.filter("new <> colour").limit(1).count()
        colour = colour.select("node", F.col("new").alias("colour"))
    ends = [colour.select(F.col("node").alias(e), F.col("colour").alias(f"c_{e}")) for e in ("src", "dst")]
    inside = written(live.join(ends[0], "src").join(ends[1], "dst").filter("c_src = c_dst").select("src", "dst", F.col("c_src").alias("colour")), "inside")
    group = written(colour.filter("node = colour"), "groups")
    grown = 1
    while grown:
        more = inside.join(group.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct().join(group, "node", "left_anti")
        more = written(more, "groups")
        grown = more.limit(1).count()
        group = group.unionByName(more)
    group = written(group, "groups")
    return group.select("node", F.col("colour").alias("rep"))
