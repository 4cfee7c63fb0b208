"""Shared helpers of the training-data operators.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  All word and n-gram hashes are
64-bit polynomial hashes with a final mix; two different sequences collide with a chance of
about n*n / 2**65 over n distinct sequences.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word, as a Java or RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where the session
    has none, as in tests, a folder in its warehouse, which a cluster must have on shared storage.

    What is staged there stays, as checkpoint files do, until the folder is cleared after the job."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return path.rstrip("/")


def short_batches(spark: SparkSession) -> None:
    """At most 512 rows in the session's Arrow batches: whole texts are long rows, and a
    Python worker holds a batch or two of them.  The setting stays, since Spark reads it when
    the frame is run, after the operator has returned it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 512:
        spark.conf.set(key, "512")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, in a folder for each value of column `by` if given, and read it back.

    Cuts the lineage: a lost executor costs a reread of these files, not a rerun of all that
    came before, and several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexforge-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A copy of schema with the fields of ddl behind it."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = np.uint64(pow(key, -1, 1 << 64))
        up, down = (np.full(size, b, dtype=np.uint64) for b in (base, inverse))
        up[0] = down[0] = 1
        _powers[key] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[key]


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_spans(raw: bytes, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a text; of its runs of letters and digits if asked."""
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = (_NO_LETTER if letters else _IS_SPACE)[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes, lower: bool = False, letters: bool = False, prefix: int | None = None) -> np.ndarray:
    """A 64-bit hash for each word of a text (of its first `prefix` bytes), with A-Z lower-cased if asked."""
    starts, ends = word_spans(raw, letters)
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = LOWER[data]
    return _range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, _BASE)


def joined_words(texts: list[str | None], letters: bool = False, lower: bool = False, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of its text for each word of all texts in turn; long ones go piece by piece,
    cut between words, so that what is held besides the words stays small."""
    raws = [(t or "").encode() for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raws])
    raw = b"\n".join(raws)
    hashes, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    space = _NO_LETTER if letters else _IS_SPACE
    at = 0
    while at < len(raw):
        end = min(len(raw), at + piece)
        while end < len(raw) and not space[raw[end]]:
            end += 1
        part = raw[at:end]
        hashes.append(word_hashes(part, lower, letters))
        docs.append(np.searchsorted(starts, word_spans(part, letters)[0] + at, side="right") - 1)
        at = end
    return np.concatenate(hashes), np.concatenate(docs)


def word_hashes_between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash, with A-Z lower-cased, of each span of bytes."""
    return _range_hashes(LOWER[data].astype(np.uint64) + np.uint64(1), starts, ends, _BASE)


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    starts = np.arange(n)
    return _range_hashes(words, starts, starts + k, _WORD_BASE)


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", heavy: int = 1 << 16, salts: int = 32) -> DataFrame:
    """left joined with right, which is distinct in key, with heavy keys of left dealt over salts.

    A key is heavy with more than `heavy` rows in left, so there are at most rows / heavy of
    them; they are counted with map-side aggregation.  Up to 100,000 heavy keys (a megabyte or
    two) are broadcast to mark rows by a hash of `spread`; beyond that, and without any, the
    join is a plain one, left to adaptive execution.  Null keys are dealt over salts too.
    """
    hot = left.groupBy(key).count().filter(F.col("count") > heavy).select(key)
    hot = staged(hot.withColumn("hot", F.lit(True)), "hot")
    found = hot.limit(100_001).count()
    if not 0 < found <= 100_000:
        return left.join(right, key, how)
    salt = F.when(F.col("hot") | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread_right = right.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return dealt.join(spread_right, [key, "salt"], how).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from each id of the undirected edges (src, dst).

    Each round every id takes the least id among itself and its neighbours as its parent
    (aggregated before the shuffle, so a hub costs one row per task), parents are followed to
    their roots by doubling, and edges are drawn again between roots.  Every component loses
    at least one root a round, about half of them in any order of ids, and a path of n ids in
    sequence takes log2(n) doublings, so there is no cap on rounds.  Rounds are written to the
    shared folder; only counts, observed while writing, come to the driver.  Ids without an
    edge to another are absent.  Empty edges give an empty frame.
    """
    live, count = _counted(_drawn(edges.select("src", "dst")), "edges", F.count(F.lit(1)))
    labels = None
    while count:
        both = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parent = staged(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.min("src")).alias("label")), "parents")
        moved = 1
        while moved:
            up = parent.select(F.col("id").alias("label"), F.col("label").alias("up"))
            parent, moved = _counted(
                parent.join(up, "label").select("id", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")),
                "parents",
                F.max(F.col("moved").cast("int")),
            )
            parent = parent.select("id", "label")
        root = parent.withColumnRenamed("label", "root")
        drawn = live.join(root.withColumnRenamed("id", "src"), "src").select("dst", F.col("root").alias("one"))
        drawn = drawn.join(root.withColumnRenamed("id", "dst"), "dst").select(F.col("one").alias("src"), F.col("root").alias("dst"))
        live, count = _counted(_drawn(drawn), "edges", F.count(F.lit(1)))
        if labels is None:
            labels = parent
        else:
            later = parent.select(F.col("id").alias("label"), F.col("label").alias("up"))
            labels = staged(labels.join(later, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
    return live.select(F.col("src").alias("id"), F.col("dst").alias("label")) if labels is None else labels


def _drawn(edges: DataFrame) -> DataFrame:
    """Distinct edges from the smaller to the larger id, without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _counted(df: DataFrame, name: str, measure) -> tuple[DataFrame, int]:
    """The staged frame and a measure observed while it was written."""
    seen = Observation()
    frame = staged(df.observe(seen, measure.alias("n")), name)
    return frame, seen.get.get("n") or 0
