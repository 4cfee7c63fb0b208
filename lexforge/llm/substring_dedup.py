"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: hashes of `seed` words, of which the least in each window of
`length - seed + 1` is kept, so that equal runs of `length` words hold an equal anchor at an
equal place.  Documents meet on these anchors; only an anchor that occurs more than once is a
seed.  From a seed a match is extended to both sides over every run of `length` words whose
anchor it is; an extension is a repeat if the same words also start earlier.  Neighbouring
repeats join into the maximal ones, and their words go.

All grouping is by count and minimum, which Spark combines before the shuffle, so neither a
passage that a third of the documents share nor a large group of copies gathers in one task,
and pairs of documents are never formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ngram_hashes, short_batches, word_hashes, word_spans

_AUX = ("_sd_text", "_sd_firsts", "_sd_single", "_sd_first_runs")


def _anchors(words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seed-long runs and, for each run of `length` words, its anchor's place."""
    grams = ngram_hashes(words, seed)
    chosen = sliding_window_view(grams, length - seed + 1).argmin(axis=1)
    return grams, chosen + np.arange(len(chosen))


def _longs(column, row: int) -> np.ndarray | None:
    value = column[row]
    return value.values.to_numpy(zero_copy_only=False).view(np.uint64) if value.is_valid else None


def _rows(batch: pa.RecordBatch, id_col: str, text_col: str):
    """(row, id, text as bytes, is it the first of its exact copies)."""
    names = batch.schema.names
    ids = batch.column(names.index(id_col)).to_pylist()
    texts = batch.column(names.index(text_col)).cast(pa.binary())
    own = batch.column(names.index("_sd_text")).to_pylist()
    firsts = batch.column(names.index("_sd_firsts")).to_pylist() if "_sd_firsts" in names else [None] * len(ids)
    for i, (doc, digest, first) in enumerate(zip(ids, own, firsts, strict=True)):
        raw = texts[i].as_py() or b""
        yield i, doc, raw, doc is None or bool(first) and digest in first


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, seed: int = 8) -> DataFrame:
    """Cut from every text the words covered by a run of `length` words that starts earlier.

    Earlier means a smaller id or the same document at an earlier word; runs are judged on
    the input.  Returns the columns of docs, the text holding the kept words joined by one
    space, and n_words, n_removed and repeats (maximal removed word ranges [start, end)).

    Null text: no words, text stays null.  Null id: the row has no place in the order; it is
    returned with all its words and removes nothing.  Rows that repeat an id count as texts
    of one document, none earlier than another.  Texts under `length` words stay whole, very
    long ones are cut as a whole.
    Input columns called n_words, n_removed or repeats are replaced.  Empty input: empty.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "repeats", *_AUX)
    kept_columns = docs.columns
    source = docs.withColumn("_sd_text", F.unhex(F.md5(F.col(text_col).cast("binary"))))
    source = source.withColumn(id_col, F.col(id_col).cast("long"))
    # Rows without an id take part in no join, where one task would get them all.
    blank = source.filter(F.col(id_col).isNull())
    source = source.filter(F.col(id_col).isNotNull())

    firsts = (
        source.filter(F.col("_sd_text").isNotNull())
        .groupBy("_sd_text").agg(F.min(id_col).alias(id_col))
        .groupBy(id_col).agg(F.collect_set("_sd_text").alias("_sd_firsts"))
    )
    known = source.join(firsts, id_col, "left")

    def seeds(batches):
        for batch in batches:
            out, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for _, doc, raw, first in _rows(batch, id_col, text_col):
                words = word_hashes(raw) if first and doc is not None else ()
                if len(words) >= length:
                    grams, at = _anchors(words, length, seed)
                    found = grams[np.unique(at)]
                    out.append(found)
                    owner.append(np.full(len(found), doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner))], names=["seed", id_col])

    single = (
        known.mapInArrow(seeds, f"seed long, `{id_col}` long")
        .groupBy("seed").agg(F.count("*").alias("n"), F.min(id_col).alias(id_col))
        .filter("n = 1")
        .groupBy(id_col).agg(F.collect_list("seed").alias("_sd_single"))
    )
    seeded = known.join(single, id_col, "left")

    def runs_of(words, single_seeds):
        """Hashes of the runs of `length` words and which of them hold a shared seed."""
        grams, at = _anchors(words, length, seed)
        shared = np.ones(len(at), bool) if single_seeds is None else ~np.isin(grams, single_seeds)[at]
        return ngram_hashes(words, length), shared

    def extensions(batches):
        for batch in batches:
            single_column = batch.column(batch.schema.names.index("_sd_single"))
            out, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, doc, raw, first in _rows(batch, id_col, text_col):
                words = word_hashes(raw) if first and doc is not None else ()
                if len(words) >= length:
                    runs, shared = runs_of(words, _longs(single_column, i))
                    found = np.unique(runs[shared])
                    out.append(found)
                    owner.append(np.full(len(found), doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner))], names=["run", id_col])

    first_runs = (
        seeded.mapInArrow(extensions, f"run long, `{id_col}` long")
        .groupBy("run").agg(F.min(id_col).alias(id_col))
        .groupBy(id_col).agg(F.collect_list("run").alias("_sd_first_runs"))
    )
    judged = seeded.join(first_runs, id_col, "left")
    lists = [F.lit(None).cast("array<binary>").alias("_sd_firsts"), *[F.lit(None).cast("array<long>").alias(c) for c in ("_sd_single", "_sd_first_runs")]]

    def cut(raw, doc, first, single_seeds, firsts_here):
        """Kept text, words, removed words, maximal repeats."""
        starts, ends = word_spans(raw)
        n = len(starts)
        gone = np.zeros(n + 1, dtype=np.int32)
        if doc is not None and n >= length:
            if not first:
                gone[0], gone[n] = 1, -1
            else:
                runs, shared = runs_of(word_hashes(raw), single_seeds)
                values, at = np.unique(runs, return_index=True)
                begins = np.zeros(len(runs), bool)
                begins[at] = True
                if firsts_here is not None:
                    begins &= np.isin(runs, firsts_here)
                else:
                    begins[:] = False
                repeat = np.flatnonzero(shared & ~begins)
                np.add.at(gone, repeat, 1)
                np.add.at(gone, repeat + length, -1)
        covered = np.cumsum(gone[:n]) > 0
        kept = b" ".join([raw[a:b] for a, b in zip(starts[~covered].tolist(), ends[~covered].tolist(), strict=True)])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        return kept, n, int(covered.sum()), edge.reshape(-1, 2)

    kept_schema = T.StructType([f for f in source.schema.fields if f.name in kept_columns])
    schema = T.StructType(
        [*kept_schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
        + [T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    )
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cuts(batches):
        for batch in batches:
            names = batch.schema.names
            single_column, first_column = (batch.column(names.index(c)) for c in ("_sd_single", "_sd_first_runs"))
            text_valid = batch.column(names.index(text_col)).is_valid().to_pylist()
            texts, n_words, n_removed, spans = [], [], [], []
            for i, doc, raw, first in _rows(batch, id_col, text_col):
                kept, n, removed, found = cut(raw, doc, first, _longs(single_column, i), _longs(first_column, i))
                texts.append(kept if text_valid[i] else None)
                n_words.append(n)
                n_removed.append(removed)
                spans.append([{"start": a, "end": b} for a, b in found.tolist()])
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else batch.column(names.index(c)) for c in kept_columns]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_columns, "n_words", "n_removed", "repeats"])

    # Joined and other rows are cut apart: a union before the cut would part one exchange of texts in two.
    return judged.mapInArrow(cuts, schema).unionByName(blank.select("*", *lists).mapInArrow(cuts, schema))
