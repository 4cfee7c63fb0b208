"""Places of regular-expression matches, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-cased, trimmed and white-space patterns that Java and RE2 read alike.
EDGES = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"\A(?U:\s+)|(?U:\s+)\z", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used: it is the only element of a list.

    What else use needs belongs into the value: a column's name inside it could mean an alias of the same select.
    """
    return F.transform(F.array(value), lambda x: use(x))[0]


def spans(text: Column, pattern: str, group: int = 1) -> Column:
    """array<struct<start, matched, value>> of a pattern's matches from left to right.

    start counts from 0; value is the match's group.  The gaps that split leaves and the
    matches' lengths add up to the starts, so no Python is needed.  The pattern must not match
    the empty text; null text gives an empty array.
    """
    text = F.coalesce(text, F.lit(""))
    hits = {"matched": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "gaps": F.split(text, pattern, -1)}
    if group:
        hits["value"] = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(h: Column) -> Column:
        pairs = F.zip_with(h["matched"], F.slice(h["gaps"], 1, F.size(h["matched"])), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            pairs, nothing,
            lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts")),
            lambda a: a["starts"],
        )
        return F.zip_with(F.zip_with(starts, h["matched"], lambda s, m: F.struct(s.alias("start"), m.alias("matched"))), h["value"] if group else h["matched"],
                          lambda a, v: F.struct(a["start"].alias("start"), a["matched"].alias("matched"), v.alias("value")))

    found = bound(F.struct(*[c.alias(n) for n, c in hits.items()]), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,matched:string,value:string>>"))


def around(text: Column, start: Column, length: Column, reach: int) -> Column:
    """The text from `reach` characters before a span to as many behind it."""
    first = F.greatest(F.lit(0), start - reach)
    return F.substr(text, first + 1, start + length + reach - first)
