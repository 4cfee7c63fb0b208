"""Corpus pipeline: the documents table through five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
read back as the next stage's docs.  All but the last return the columns of documents.
Rows with a null doc_id pass every stage; rows that repeat a doc_id count as one document
from the second stage on, which keeps the one whose other columns are least.  Null and empty
texts are clean, copies of nothing and hold no words, so the mix takes none of them.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.byte_bpe import bpe_decode, bpe_encode
from lexforge.llm.common import staged
from lexforge.llm.mixing import mix
from lexforge.llm.ngram_jaccard import ngram_jaccard_join
from lexforge.llm.queries import tokenizer
from lexforge.llm.substring_dedup import substring_dedup
from lexforge.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; fitted on the whole documents table."""
    training = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, training).filter("predicted = 0").select(docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies: sets of five-word
    shingles with a Jaccard similarity of 0.8 or more."""
    groups = ngram_jaccard_join(docs.select("doc_id", "text"), words=5, percent=80)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row"))
    kept = one.select("doc_id", *[F.col(f"_row.{c}") for c in rest])
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words that start earlier; n_chars follows the text."""
    return substring_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix reads a document, cut to the words it takes."""
    return mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian 32-bit) of each row, and the digest of
    what its ids decode to, which is that of the text."""
    ranks, pattern = tokenizer()
    ids = bpe_encode(docs.select("doc_id", "source", "text"), ranks, pattern).drop("text")
    tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return bpe_decode(ids, ranks).select("doc_id", "source", tokens, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_group),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Toxicity and mixing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
