"""Unicode normal forms and cleaning, and the places of excerpts in texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .cleaning import clean
from .segments import drop_garbage_lines
from .spans import strip

#: Characters and mojibake that are replaced, in this order.
REPLACED = [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("−", "-"), ("…", "..."), ("Â", ""), ("â€™", "'"), ("â€TM", "'"), ("â€œ", '"'), ("â€", '"')]
#: Zero-width and formatting characters that are dropped.
DROPPED = r"[\u200b-\u200f\u2028-\u202f\u205f-\u206f\ufeff\ufffe]"


def _form(name: str):
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize(name, x))

    return run


#: Rows of an Arrow batch, of which a Python worker holds some copies: whole texts are long rows.
BATCH = 256


def normal_form(text: Column, name: str) -> Column:
    """The text in a Unicode normal form; only rows with other than ASCII characters go to Python.

    The session's Arrow batches are held at BATCH rows from here on, since Spark reads the setting when the frame is run.
    """
    session, key = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(session.conf.get(key)) <= BATCH:
        session.conf.set(key, str(BATCH))
    return F.coalesce(_form(name)(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize_unicode(text: Column) -> Column:
    """NFKC, straight quotes and dashes, no mojibake or formatting characters, no garbage lines."""
    out = normal_form(text, "NFKC")
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.replace(F.regexp_replace(out, DROPPED, ""), F.lit("\u00a0"), F.lit(" "))
    return F.replace(drop_garbage_lines(out), F.lit("\u2007"), F.lit(" "))


def clean_text(text: Column) -> Column:
    """All cleaning steps in order, without white space at both ends; null gives the empty text."""
    return strip(clean(normalize_unicode(F.coalesce(text, F.lit("")))))


def excerpt_form(text: Column) -> Column:
    """Without line-break hyphens, with single spaces, composed, lower-cased and trimmed."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"-\s*\n\s*", "")
    return F.trim(F.lower(normal_form(F.regexp_replace(joined, r"\s+", " "), "NFC")))


def locate_excerpt(text: Column, excerpt: Column) -> Column:
    """Place of an excerpt in a text, both normalised, from 0; -1 if it isn't there."""
    return F.instr(excerpt_form(text), excerpt_form(excerpt)) - 1
