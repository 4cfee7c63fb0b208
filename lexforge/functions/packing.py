"""Greedy packing of text pieces into chunks: the one sequential step of chunking, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _packed(pieces: list[str], least: int, most: int, overlap: int) -> list[str]:
    chunks: list[str] = []
    group: list[str] = []
    size = 0
    for piece in pieces:
        if group and size + len(piece) > most and len("\n\n".join(group)) >= least:
            chunks.append("\n\n".join(group))
            kept: list[str] = []
            room = overlap * 1.5
            for last in reversed(group if overlap else []):
                if len(last) > room:
                    break
                kept.insert(0, last)
                room -= len(last)
            group = kept or (group[-1:] if overlap else [])
            size = sum(map(len, group))
        group.append(piece)
        size += len(piece)
    text = "\n\n".join(group)
    if group and len(text) >= least:
        chunks.append(text)
    elif group and chunks:
        chunks[-1] += "\n\n" + text
    return chunks


def _pointed(pieces: list[str], most: int, joiner: str, carry: bool) -> list[str]:
    chunks: list[str] = []
    group: list[str] = []
    size = 0
    for piece in pieces:
        if group and size + len(piece) > most:
            chunks.append(joiner.join(group))
            # A carried piece counts as long as the one behind it.
            group, size = (group[-1:], len(piece)) if carry else ([], 0)
        group.append(piece)
        size += len(piece)
    return [*chunks, joiner.join(group)] if group else chunks


def pack_paragraphs(paragraphs: Column, least: int, most: int, overlap: int) -> Column:
    """Chunks of whole paragraphs up to `most` characters, each starting with the last ones of the
    chunk before (up to 1.5 * overlap characters, one at least).

    A group under `least` goes on growing; a short tail joins the last chunk, and alone gives
    none.  Null and empty lists give no chunks.
    """

    @pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([_packed(list(x), least, most, overlap) if x is not None else [] for x in lists], dtype=object)

    return run(paragraphs)


def pack_points(points: Column, most: int, joiner: str, carry: bool = False) -> Column:
    """Chunks of whole points up to `most` characters; with carry each starts with the point before."""

    @pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([_pointed(list(x), most, joiner, carry) if x is not None else [] for x in lists], dtype=object)

    return run(points)
