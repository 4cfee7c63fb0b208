"""Embedding of texts in batches by a function of the user's."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what is put before a text.
PREFIX = "Represent this document for retrieval: "


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in embedder: signed counts of hashed words."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            row[h % size] += 1 if h & 0x10000 else -1
    return out


def embed_texts(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_words, text_col: str = "text", batch: int = 32, longest: int | None = None) -> DataFrame:
    """Adds embedding (unit length) and embedding_error to chunks, text by text.

    The function gets lists of prefixed texts and returns a row for each.  Blank and null texts
    get no embedding and an error, as does a zero row; a text's embedding doesn't depend on its
    neighbours or their order.  Whole texts are embedded; `longest` cuts them
    for services that take no more than so many characters, 20,000 say.
    """
    chunks = chunks.drop("embedding", "embedding_error")
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedding_error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [(x or "")[:longest] for x in frame[text_col]]
            at = [i for i, x in enumerate(texts) if x.strip()]
            found: list = [None] * len(texts)
            error: list = ["Empty text"] * len(texts)
            for i in range(0, len(at), batch):
                some = at[i : i + batch]
                rows = np.asarray(embedder([PREFIX + texts[k] for k in some]), float)
                for k, row, norm in zip(some, rows, np.linalg.norm(rows, axis=1), strict=True):
                    found[k], error[k] = (row / norm, None) if norm > 0 else (None, "Zero vector")
            yield frame.assign(embedding=pd.Series(found, index=frame.index, dtype=object), embedding_error=error)

    return chunks.mapInPandas(run, schema)


def norms(embedded: DataFrame) -> DataFrame:
    """How many texts were embedded, how many not, and the greatest distance of a norm from 1."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return embedded.agg(F.count("embedding").alias("embedded"), F.count("embedding_error").alias("failed"), F.coalesce(F.max(F.abs(norm - 1)), F.lit(0.0)).alias("worst"))
