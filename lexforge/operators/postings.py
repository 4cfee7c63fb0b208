"""A word index of chunks for sets of queries: posting rows by word, and grams of the distinct words."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import new_folder, written

#: Characters of a gram, and so the least length of a term; parts that a word's postings are dealt into.
GRAM, SALTS = 4, 16
#: The first chunks by order that are read for all terms: one in HEAD, placed by one chunk in SAMPLE.
HEAD, SAMPLE = 16, 64


class LexicalIndex(NamedTuple):
    """postings: (word, salt, chunk_id, document_id), each word of a chunk once; grams: (gram, word)."""

    postings: DataFrame
    grams: DataFrame


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    """The index that lexical_index wrote to a folder."""
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/grams"))


def chunk_words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, words): the distinct lower-cased words of each chunk that can hold a term."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\S+)"), F.lit(1)), lambda w: F.length(w) >= GRAM))
    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), words.alias("words"))


def word_grams(words: DataFrame) -> DataFrame:
    """(gram, word) of distinct words (word)."""
    return words.select(F.explode(_grams(F.col("word"))).alias("gram"), "word")


def lexical_index(chunks: DataFrame, path: str | None = None) -> LexicalIndex:
    """Index of the lower-cased words of chunks (chunk_id, document_id, text), written to `path`.

    Words are what stands between white space; those under four characters can hold no term
    and are left out.  A word's postings are dealt by chunk, so that no task holds all of a
    frequent one, and both tables are sorted, so that a look-up skips most row groups.  Null
    and empty texts have no rows.  Without a path a new folder of the shared one is used.
    """
    path = path or new_folder(chunks.sparkSession, "lexical-index")
    rows = chunk_words(chunks).withColumn("word", F.explode("words"))
    rows = rows.select("word", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int").alias("salt"), "chunk_id", "document_id")
    rows.repartition("word", "salt").sortWithinPartitions("word", "salt").write.parquet(f"{path}/postings")
    postings = chunks.sparkSession.read.parquet(f"{path}/postings")
    word_grams(postings.select("word").distinct()).repartition("gram", F.pmod(F.xxhash64("word"), F.lit(SALTS))).sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return read_index(chunks.sparkSession, path)


def term_words(grams: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, word): the indexed words that contain a term.

    terms: (term), of four characters or more and without white space, so a text contains one
    if a word of it does.  Each term is looked up by its rarest gram among the distinct words,
    and the words found are verified; no text is read.
    """
    asked = terms.select("term").distinct()
    parts = asked.select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    sizes = grams.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(sizes, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    return grams.join(rarest, "gram").filter(F.col("word").contains(F.col("term"))).select("term", "word")


def dealt(rows: DataFrame, size: int, *key: str) -> DataFrame:
    """Rows dealt by key into as many parts as `size` asks for, or as there are cores if those are more.

    The number is given, so that parts are not put together again by their compressed bytes:
    rows of postings shrink to a fiftieth, and tasks of some MB read would take gigabytes.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, size), *key)


def first_chunks(postings: DataFrame, chunks: DataFrame, grams: DataFrame, needs: DataFrame, order: list[str], places: int) -> DataFrame:
    """(term, grp, ...): of each needed (term, grp) the first `places` chunks by order that contain the term.

    postings: (word, grp, ...), a row for each word of a chunk, with the columns of order, of
    which one is chunk_id; chunks: (grp, ...), a row a chunk; grams: those of the words.

    The first sixteenth of each group by order is read for all terms.  A term that has all its
    places there needs no other chunk, since what is left comes later; the rest is read for
    the others only, of which there are few postings.  Where that sixteenth ends is placed by
    a sample, which sets what is read first and not what is found.
    """
    n = chunks.count() // 5000
    found = written(term_words(grams, needs), "found")
    drawn = chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(SAMPLE)) == 0).select("grp", *order)
    drawn = drawn.withColumns({"_at": F.row_number().over(W.partitionBy("grp").orderBy(*order)), "_all": F.count("*").over(W.partitionBy("grp"))})
    ends = written(drawn.filter(F.col("_at") == F.ceil(F.col("_all") / HEAD)).select("grp", F.struct(*order).alias("_end")), "ends")
    postings = postings.join(F.broadcast(ends), "grp", "left").withColumn("_head", F.coalesce(F.struct(*order) <= F.col("_end"), F.lit(False))).drop("_end")
    rank = F.dense_rank().over(W.partitionBy("term", "grp").orderBy(*order))

    def first(rows: DataFrame) -> DataFrame:
        return dealt(rows, n, "term", "grp").withColumn("_n", rank).filter(F.col("_n") <= places)

    # Several words of a term bring a chunk once each; its rank is the same.
    head = postings.filter("_head").drop("_head")
    met = dealt(head, n // 4, "word").join(dealt(found, n // 4, "word").hint("merge"), "word").drop("word").join(F.broadcast(needs) if n < 200 else needs, ["term", "grp"], "left_semi")
    lists = written(first(met).distinct(), "first")
    short = written(needs.join(lists.filter(F.col("_n") == places).select("term", "grp").distinct(), ["term", "grp"], "left_anti"), "short")
    wanted = written(found.join(short, "term"), "wanted")
    # Words of many chunks that no such term is in are left out before the exchange.
    common = head.groupBy("word").count().filter(F.col("count") >= places).select("word").join(wanted.select("word").distinct(), "word", "left_anti")
    rest = postings.filter("NOT _head").drop("_head").join(small(common, "common"), "word", "left_anti")
    late = dealt(rest, n, "word", "grp").join(dealt(wanted, n, "word", "grp").hint("merge"), ["word", "grp"]).drop("word")
    full = lists.drop("_n")
    early = full.join(short, ["term", "grp"], "left_semi")
    return full.join(short, ["term", "grp"], "left_anti").unionByName(first(early.unionByName(late)).drop("_n").distinct())


#: Bytes of the rows that may be broadcast.
BROADCAST = 16 << 20


def small(df: DataFrame, name: str) -> DataFrame:
    """df stored, and broadcast where it is joined if its rows together are under BROADCAST bytes."""
    kept = written(df, name)
    size = kept.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in kept.columns), F.lit(24)))).first()[0]
    return F.broadcast(kept) if (size or 0) <= BROADCAST else kept
