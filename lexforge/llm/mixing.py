"""Mixing sources to target weights with exact block quotas.

The documents of each source are dealt by a hash into blocks.  A source's target gives whole
passes over it and a rest: a quota of block units, the last of which is cut to the words that
are left.  A splitting tree deals these quotas to the output shards: each node halves its
shards and draws the left half's units from those it holds by the multivariate hypergeometric
law.  Each shard claims as many units of each source's permuted blocks as its leaf holds,
disjoint from all other shards' claims, and orders its documents by a hash.  What is taken of
a document is the sum of its shards' draws; a unit that no shard claims is not taken.

Only per-source totals, one row a source, come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, staged

#: Rows of the block table (about 400 bytes each) up to which it is broadcast.
_TABLE_ROWS = 40_000
#: Documents of a block where their number is left open, and the bounds of that number.
_BLOCK_DOCS, _LEAST_BLOCKS, _MOST_BLOCKS = 1000, 1024, 1 << 20


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none over most * its size, the excess reshared."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit >= most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i] if full else weights[i] * unit)
            left -= out[i] if full else 0
        open_ -= full or open_
    return out


def splitting_tree(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard, as an array (shards, sources)."""
    out = np.zeros((shards, len(blocks)), np.int64)

    def split(low: int, high: int, held: np.ndarray) -> None:
        if high - low == 1:
            out[low] = held
            return
        mid = (low + high) // 2
        share = int(held.sum()) * (mid - low) // (high - low)
        # Marginal hypergeometric draws in source order make one multivariate draw.
        rng = np.random.default_rng([seed, low, high])
        left, pool, want = np.zeros_like(held), int(held.sum()), share
        for i, n in enumerate(held.tolist()):
            left[i] = rng.hypergeometric(n, pool - n, want) if n and want else 0
            pool, want = pool - n, want - int(left[i])
        split(low, mid, left)
        split(mid, high, held - left)

    split(0, shards, np.asarray(blocks, np.int64))
    return out


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None,
    weights: tuple[float, ...] = (1, 2, 3), most: float = 3, shards: int = 16, blocks: int | None = None, seed: int = 7, max_sources: int = 100_000,
) -> DataFrame:
    """What the mix takes of every document.

    Adds size (words, or size_col), source_size, target (of the source), taken (words, with
    repeats) and draws: an array of (copy, words, shard), one entry for each time that the
    document is read, words being a prefix of it.  Sources are in code point order, null
    last, and take the weights in turn.  blocks: number of each source's blocks, by default
    a power of two that grows with the documents, so that a block stays small.

    Null or empty texts have size 0 and are never drawn; null sources are one source; rows
    that repeat an id are documents of their own, ordered by their text; ids order nothing
    but ties.  Very long texts are cut as others are.  Columns of the
    added names and names starting with _mx are replaced.  No documents: an empty frame.
    More than max_sources sources raise an error, since their totals are kept on the driver.
    """
    return _planned(docs, id_col, text_col, source_col, size_col, weights, most, shards, blocks, seed, max_sources)[0]


def _planned(docs, id_col, text_col, source_col, size_col=None, weights=(1, 2, 3), most=3, shards=16, blocks=None, seed=7, max_sources=100_000) -> tuple[DataFrame, int]:
    """mix_plan's rows and the words of all documents."""
    spark = docs.sparkSession
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")) if size_col else word_count(text_col)
    docs = docs.withColumn("_mx_size", size).drop("size", "source_size", "target", "taken", "draws").withColumnRenamed("_mx_size", "size")
    if blocks is None:
        blocks = _LEAST_BLOCKS
        while blocks < min(docs.count() / _BLOCK_DOCS, _MOST_BLOCKS):
            blocks *= 2
    docs = docs.withColumn("_mx_source", F.col(source_col).cast("string"))
    docs = docs.withColumn("_mx_block", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(blocks)).cast("int"))
    by_block = staged(docs.groupBy("_mx_source", "_mx_block").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "blocks")

    rows = by_block.groupBy("_mx_source").agg(F.sum("words").alias("words")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r["words"] for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most) if sum(sizes) else [0.0] * len(rows)
    quota = [min(round(g), int(most * n)) for g, n in zip(goal, sizes, strict=True)]
    passes = [q // n if n else 0 for q, n in zip(quota, sizes, strict=True)]
    rest = [q - p * n for q, p, n in zip(quota, passes, sizes, strict=True)]
    sources = spark.createDataFrame(
        [(r[0], n, g, p, f) for r, n, g, p, f in zip(rows, sizes, goal, passes, rest, strict=True)],
        "_mx_source string, source_size long, target double, passes long, rest long",
    )

    def order(copy):
        return F.xxhash64(F.lit(seed), copy, F.col("_mx_source"), F.col("_mx_block"))

    by_source = W.partitionBy("_mx_source")
    table = by_block.join(F.broadcast(sources) if len(rows) <= _TABLE_ROWS else sources, by_block["_mx_source"].eqNullSafe(sources["_mx_source"])).drop(sources["_mx_source"])
    for copy in range(int(most) + 1):
        table = table.withColumn(f"_k{copy}", F.row_number().over(by_source.orderBy(order(F.lit(copy)), "_mx_block")) - 1)
    last = by_source.orderBy(order(F.col("passes").cast("int")), "_mx_block")
    table = table.withColumns({
        "before": F.sum("words").over(last.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"),
        "places": F.array(*[f"_k{c}" for c in range(int(most) + 1)]),
        "held": F.count("*").over(by_source),
    }).drop(*[f"_k{c}" for c in range(int(most) + 1)])
    table = staged(table.withColumn("drawn", F.greatest(F.lit(0).cast("long"), F.least("words", F.col("rest") - F.col("before")))), "drawn")

    # A source's quota: whole passes and the blocks up to the last one drawn from.
    at = F.element_at("places", (F.col("passes") + 1).cast("int")) + 1
    quota_units = F.max(F.col("passes") * F.col("held") + F.when(F.col("drawn") > 0, at).otherwise(0))
    units = {r[0]: r[1] for r in table.groupBy("_mx_source").agg(quota_units).collect()}
    tree = splitting_tree(np.array([units.get(r[0], 0) for r in rows]), shards, seed).cumsum(axis=0) if rows else np.zeros((shards, 0), np.int64)
    bounds = spark.createDataFrame([(r[0], tree[:, i].tolist()) for i, r in enumerate(rows)], "_mx_source string, bounds array<long>")
    table = table.join(F.broadcast(bounds) if len(rows) * shards <= 1 << 20 else bounds, table["_mx_source"].eqNullSafe(bounds["_mx_source"])).drop(bounds["_mx_source"])
    table = table.select("_mx_source", "_mx_block", "source_size", "target", "passes", "words", "drawn", "places", "held", "bounds")

    small = len(rows) * blocks <= _TABLE_ROWS
    here = docs.join(
        F.broadcast(table) if small else table,
        docs["_mx_source"].eqNullSafe(table["_mx_source"]) & (docs["_mx_block"] == table["_mx_block"]),
    ).drop(table["_mx_source"]).drop(table["_mx_block"])
    border = (F.col("drawn") > 0) & (F.col("drawn") < F.col("words"))
    inside = W.partitionBy("_mx_source", "_mx_block").orderBy(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.col(id_col), "size", *([F.md5(F.col(text_col).cast("binary"))] if text_col in docs.columns else []))
    before = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    part = here.filter(border).withColumn("_mx_rest", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("drawn") - before)))
    whole = here.filter(~border).withColumn("_mx_rest", F.when(F.col("drawn") > 0, F.col("size")).otherwise(F.lit(0).cast("long")))

    def draw(copy, words):
        unit = F.element_at("places", (copy + 1).cast("int")) + copy * F.col("held")
        claimed = unit < F.element_at("bounds", -1)
        shard = F.size(F.filter("bounds", lambda b: b <= unit))
        return F.struct(copy.cast("int").alias("copy"), F.when(claimed, words).otherwise(0).cast("long").alias("words"), shard.alias("shard"))

    copies = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<long>"))
    draws = F.concat(
        F.transform(copies, lambda c: draw(c, F.col("size"))),
        F.array(draw(F.col("passes"), F.col("_mx_rest"))),
    )
    out = whole.unionByName(part).withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    out = out.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]))
    return out.drop("_mx_source", "_mx_block", "_mx_rest", "passes", "words", "drawn", "places", "held", "bounds"), sum(sizes)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, shards: int = 16, part_words: int = 2_000_000, **options,
) -> DataFrame:
    """The mixed corpus: a row of docs for each draw, with copy and shard, text cut to the
    words drawn, each shard in an order of its own by a hash.  See mix_plan.

    A shard is dealt into parts of about part_words words by the same hash, so no task's
    share grows with the corpus; a task's rows are sorted by shard, part and place."""
    columns = [c for c in docs.columns if c not in ("copy", "shard")]
    plan, words = _planned(docs.select(*columns), id_col, text_col, source_col, seed=seed, shards=shards, **options)
    parts = max(1, -(-words // (shards * part_words)))
    drawn = plan.withColumn("_mx_draw", F.explode("draws"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("_mx_draw.words"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("_mx_draw.words") < F.col("size"), cut).otherwise(F.col(text_col))
    place = F.xxhash64(F.lit(seed + 2), F.col(id_col), F.col("_mx_draw.copy"))
    return (
        drawn.withColumn(text_col, text)
        .select(*columns, F.col("_mx_draw.copy").alias("copy"), F.col("_mx_draw.shard").alias("shard"), place.alias("_mx_place"), F.pmod(place, F.lit(parts)).alias("_mx_part"))
        .repartition("shard", "_mx_part").sortWithinPartitions("shard", "_mx_part", "_mx_place", id_col).drop("_mx_place", "_mx_part")
    )
