"""Collocations by dynamic itemset counting.

Texts are dealt into shards, which are scanned in a cycle; each step scans one.  Words are
counted from the first step on.  A phrase of k + 1 words becomes active once its first k and
its last k words have both reached the threshold, and is then counted in the next steps until
it has seen every shard once, so phrases of several lengths are counted in one scan.  The
mining ends when no phrase is active.

Which phrases have reached the threshold is kept in a bitmap of fixed size, one for each of
the last steps, which travels with the job.  A phrase is active by one bitmap and done by the
one of a cycle earlier; bitmaps only grow, so each phrase is counted in as many consecutive
steps as there are shards, and every count is exact.  Two phrases of one bit only become
active earlier than they need.

Phrases are counted under 64-bit hashes of language, length and words, added up within a task
before the shuffle; their texts are looked up in a last scan, for those over the threshold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, mix, short_batches, staged, word_hashes_between

#: Bytes by kind: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_STEP = np.uint64(0xD1342543DE82EF93)
#: The lowest bits of a phrase's hash are its length.
_LENGTH_BITS = 3


def _chunks(texts: list[str | None], langs: list[str], size: int = 1 << 20):
    """(bytes, place of each text in them, its language's hash): texts joined by line feeds to
    about size bytes; longer ones are cut between pieces."""
    held, starts, of, n = [], [], [], 0
    for text, lang in zip(texts, langs, strict=True):
        raw = (text or "").encode()
        at = 0
        while at < len(raw):
            end = min(len(raw), at + size)
            while end < len(raw) and _KIND[raw[end]] != 2:
                end += 1
            held.append(raw[at:end])
            starts.append(n)
            of.append(lang)
            n += end - at + 1
            at = end
            if n >= size:
                yield b"\n".join(held), np.array(starts), of
                held, starts, of, n = [], [], [], 0
    if held:
        yield b"\n".join(held), np.array(starts), of


def _lang_hash(lang: str) -> int:
    raw = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64)
    h = np.full(1, len(raw) + 1, np.uint64)
    for b in raw:
        h = mix(h * _STEP + b)
    return int(h[0])


class _Words:
    """Words of one chunk: hashes with their language, spans, and whether the next word is of the same piece."""

    def __init__(self, raw: bytes, starts: np.ndarray, langs: list[str]):
        data = np.frombuffer(raw, np.uint8)
        kind = np.ones(len(raw) + 2, np.uint8)
        kind[1:-1] = _KIND[data]
        word = kind == 0
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.first, self.last = edge[0::2], edge[1::2]
        pieces = np.cumsum(kind[1:-1] == 2, dtype=np.int32)
        self.joined = np.zeros(len(self.first), bool)
        if len(self.first) > 1:
            piece = pieces[self.first]
            self.joined[:-1] = piece[1:] == piece[:-1]
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        self.langs = list(number)
        self.lang = np.array([number[x] for x in langs], np.int64)[self.doc]
        salt = np.array([_lang_hash(x) for x in self.langs], np.uint64)
        self.word = mix(word_hashes_between(data, self.first, self.last) ^ salt[self.lang])

    def texts(self, raw: bytes, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from words `at` on, lower-cased and joined by one space."""
        if not hasattr(self, "flat"):
            # The words of the chunk and one blank behind each.
            data = np.append(LOWER[np.frombuffer(raw, np.uint8)], np.uint8(0x20))
            keep = np.zeros(len(data), bool)
            keep[self.last] = True
            data[keep] = 0x20
            keep[: len(raw)] |= _KIND[data[: len(raw)]] == 0
            self.flat, size = data[keep].tobytes(), self.last - self.first
            self.end = np.cumsum(size + 1) - 1
            self.start = self.end - size
        return pa.array([self.flat[i:j] for i, j in zip(self.start[at].tolist(), self.end[at + k - 1].tolist(), strict=True)], pa.binary()).cast(pa.string())


def _marked(h: np.ndarray, k: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(_LENGTH_BITS)) << np.uint64(_LENGTH_BITS)) | np.uint64(k)


def _bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(_LENGTH_BITS)) & np.uint64(len(bitmap) * 64 - 1)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _phrases(words: _Words, longest: int, now: np.ndarray | None, before: np.ndarray | None, singles: bool):
    """(k, places, hashes) of the words, if asked, and of the phrases that are active: those whose
    first and last words but one are all in bitmap `now` and not all in `before`."""
    h = words.word
    at = np.arange(len(h))
    if singles:
        yield 1, at, _marked(h, 1)
    if now is None:
        return
    old = np.ones(len(h), bool) if before is not None else np.zeros(len(h), bool)
    # at: places where a phrase of k words with all its parts in `now` starts; old: in `before` as well.
    for k in range(1, longest):
        marked = _marked(h, k)
        have = _bits(now, marked)
        at, h, old, marked = at[have], h[have], old[have], marked[have]
        if before is not None:
            old = old & _bits(before, marked)
        pair = np.flatnonzero((at[1:] == at[:-1] + 1) & words.joined[at[1:] + k - 2]) if len(at) > 1 else np.empty(0, np.int64)
        nxt = np.minimum(at[pair] + k, len(words.word) - 1)
        h, old, at = mix(h[pair] * _STEP + words.word[nxt]), old[pair] & old[pair + 1], at[pair]
        if not len(at):
            return
        fresh = ~old
        if fresh.any():
            yield k + 1, at[fresh], _marked(h[fresh], k + 1)


def mine_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, shards: int = 3, bits: int = 1 << 26,
) -> DataFrame:
    """Every phrase of up to `longest` words that occurs `least` times or more in its language:
    (lang, k, phrase, f), with the count of all its occurrences within pieces, overlaps
    included, and for each language one row of k = 0, whose f is the number of all its words.

    A-Z are lower-cased; pieces end at . , ; : ! ? and at line ends, words at blanks and tabs.
    A null language is "und"; null and empty texts hold nothing; rows that repeat count each.
    Very long texts are read piece by piece.  Other columns are not read.  No rows: empty.

    The bitmap grows with the words of the first shard, up to bits / 8 bytes; more phrases than
    it has bits make the counting wider, not wrong.
    """
    if longest > 7 or longest < 1 or least < 1 or shards < 1 or bits & (bits - 1) or bits < 64:
        raise ValueError("longest is at most 7, least and shards at least 1, bits a power of two of at least 64")
    spark = docs.sparkSession
    short_batches(spark)
    dealt = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    shard_of = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    dealt = _dealt(dealt.filter("text <> ''").withColumn("shard", shard_of), shards)

    def counted(step: int, history: list[np.ndarray]):
        sent = [_packed(history[-1]) if history else None, _packed(history[-1 - shards]) if len(history) > shards else None]

        def count(batches):
            """(hash, count) of the step's phrases, added up over a task as far as memory allows."""
            held, size = [], 0
            now, before = (_unpacked(x) for x in sent)

            def flush():
                h, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

            for batch in batches:
                for raw, starts, langs in _chunks(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                    words = _Words(raw, starts, langs)
                    for _, _, h in _phrases(words, longest, now, before, step < shards):
                        held.append(np.unique(h, return_counts=True))
                        size += len(held[-1][0])
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
            if size:
                yield flush()

        return dealt[step % shards].mapInArrow(count, "h long, n long")

    state, history, step = None, [], 0
    while step < shards or not np.array_equal(history[-1], history[-1 - shards] if len(history) > shards else np.zeros_like(history[-1])):
        new = counted(step, history)
        rows = new.withColumn("seen", F.lit(step))
        rows = rows if state is None else state.unionByName(rows)
        rows = rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
        # A phrase first seen a cycle ago has seen every shard: under the threshold, it is out.
        state = staged(rows.filter((F.col("n") >= least) | (F.col("seen") > step + 1 - shards)), "phrases")
        if not step:
            # Twice the most phrases that can reach the threshold.
            words = (state.agg(F.sum("n")).first()[0] or 0) * shards
            bits = min(bits, 1 << max(6, (2 * longest * words // least).bit_length()))
        history.append(_bitmap(state, least, longest, bits))
        step += 1

    frequent = state.filter(F.col("n") >= least).select("h", "n")
    everything = _packed(_bitmap(frequent, least, longest + 1, bits))

    def named(batches):
        """(h, lang, k, phrase, words): each frequent phrase once a task, and each language's words (k = 0)."""
        seen, total, over = np.empty(0, np.uint64), {}, _unpacked(everything)
        for batch in batches:
            for raw, starts, langs in _chunks(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                words = _Words(raw, starts, langs)
                names = pa.array(words.langs, pa.string())
                for i, n in enumerate(np.bincount(words.lang, minlength=len(words.langs)).tolist()):
                    total[words.langs[i]] = total.get(words.langs[i], 0) + n
                for k, at, h in _phrases(words, longest, over, None, True):
                    held = _bits(over, h)
                    h, first = np.unique(h[held], return_index=True)
                    at, new = at[held][first], ~_among(h, seen)
                    h, at = h[new], at[new]
                    if len(h):
                        yield _named_batch(h.view(np.int64), names.take(pa.array(words.lang[at])), k, words.texts(raw, at, k), 0)
                        seen = np.sort(np.concatenate([seen, h]))
        yield _named_batch(np.zeros(len(total), np.int64), pa.array(list(total), pa.string()), 0, pa.array([""] * len(total), pa.string()), list(total.values()))

    texts = dealt[0]
    for part in dealt[1:]:
        texts = texts.unionByName(part)
    names = staged(texts.mapInArrow(named, "h long, lang string, k int, phrase string, words long"), "names")
    phrases = names.filter("k > 0").groupBy("h").agg(*[F.min(c).alias(c) for c in ("lang", "k", "phrase")])
    found = phrases.join(frequent, "h").select("lang", "k", "phrase", F.col("n").alias("f"))
    sizes = names.filter("k = 0").groupBy("lang").agg(F.sum("words").alias("f")).select("lang", F.lit(0).alias("k"), F.lit("").alias("phrase"), "f")
    return found.unionByName(sizes)


def _among(h: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array seen."""
    if not len(seen):
        return np.zeros(len(h), bool)
    return seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] == h


def _named_batch(h, langs: pa.Array, k: int, phrases: pa.Array, words) -> pa.RecordBatch:
    n = len(h)
    words = pa.array(np.full(n, words) if isinstance(words, int) else words, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(h), langs, pa.array(np.full(n, k, np.int32)), phrases, words], names=["h", "lang", "k", "phrase", "words"])


def _dealt(rows: DataFrame, shards: int) -> list[DataFrame]:
    """The rows of each shard, written once."""
    whole = staged(rows, "shards", by="shard")
    return [whole.filter(F.col("shard") == i).select("lang", "text") for i in range(shards)]


def _packed(bitmap: np.ndarray) -> bytes:
    return zlib.compress(bitmap.tobytes(), 1)


def _unpacked(raw: bytes | None) -> np.ndarray | None:
    return None if raw is None else np.frombuffer(zlib.decompress(raw), np.uint64)


def _bitmap(state: DataFrame, least: int, below: int, bits: int) -> np.ndarray:
    """A bit for each phrase of under `below` words that has reached the threshold: bits / 8 bytes."""
    h = F.col("h")
    place = F.shiftrightunsigned(h, _LENGTH_BITS).bitwiseAND(bits - 1)
    over = state.filter((F.col("n") >= least) & (h.bitwiseAND((1 << _LENGTH_BITS) - 1) < below))
    cells = over.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((shiftrightunsigned(h, {_LENGTH_BITS}) & 63) as int))")).alias("bits"))
    got = cells.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def collocations(phrases: DataFrame, top: int = 2000) -> DataFrame:
    """The best phrases of each language from mine_phrases' rows: (lang, rank, phrase, a, l, r, n, score).

    Cutting a phrase that occurs a times after its first k words gives l and r, the counts of
    both parts, and floor(1000 * a * n / (l * r)); its lowest cut counts, ties to the smallest
    k.  Phrases that stand inside a longer one that occurs as often are dropped.  Order: score
    and a descending, then the phrase's bytes.  Arithmetic is exact.
    """
    counts = phrases.filter("k > 0").select("lang", "phrase", "f")
    sizes = phrases.filter("k = 0").select("lang", F.col("f").alias("n"))
    words = phrases.filter("k > 1").withColumn("w", F.split("phrase", " ", -1))
    parts = words.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = parts.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("right")
    )
    one = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    two = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = parts.join(one, ["lang", "left"]).join(two, ["lang", "right"]).join(F.broadcast(sizes.limit(_LANGS)) if sizes.limit(_LANGS + 1).count() <= _LANGS else sizes, "lang")
    score = F.expr("cast(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as bigint)")
    best = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    inner = words.filter("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))).drop("longer")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Languages up to which their sizes are broadcast, a few bytes each.
_LANGS = 10_000
