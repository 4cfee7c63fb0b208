"""Places of paragraphs on a page, by their first words in the stream of word coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that are sought, and what is stripped from them.
RUN = 5


def _bare(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(".,()")))


def visual_anchors(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, para_id, page, x0, y0, x1, y1) where a paragraph's first words first stand in a row.

    paragraphs: document_id, para_id, content; pages: document_id, page, words, an array of
    text and box corners.  The first five words longer than one character are sought, fewer
    where there are fewer; a run may cross pages.  Pages are exchanged once, by document, and
    meet the list of what their document seeks; of several places the first counts.
    """
    kept = F.filter(F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(\S+)"), F.lit(1)), lambda w: F.btrim(w, F.lit(".,()"))), lambda w: F.length(w) > 1)
    asked = paragraphs.select("document_id", "para_id", F.slice(kept, 1, RUN).alias("run")).filter(F.size("run") > 0)
    asked = asked.select("document_id", "para_id", F.size("run").alias("n"), F.array_join(F.transform("run", F.lower), "\x01").alias("key"))
    lists = asked.groupBy("document_id").agg(F.array_sort(F.collect_set("n")).alias("sizes"), F.collect_set("key").alias("keys"))
    # Words and corners as arrays of their own, which compress well in the exchange.
    corners = ("x0", "y0", "x1", "y1")
    part = lambda c: F.transform("words", lambda w: w[c]).alias(c)
    flat = pages.filter(F.size("words") > 0).select("document_id", "page", F.transform("words", lambda w: _bare(w["text"])).alias("ws"), *[part(c) for c in corners])
    along = W.partitionBy("document_id").orderBy("page")
    ahead = lambda c: F.slice(F.flatten(F.array_compact(F.array(*[F.lead(F.slice(c, 1, RUN - 1), i).over(along) for i in range(1, RUN)]))), 1, RUN - 1)
    rows = flat.select("document_id", "page", F.size("ws").alias("own"), *[F.concat(c, ahead(c)).alias(c) for c in ("ws", *corners)])
    # Runs of each size that the document seeks, smallest first, one for each of the page's own words.
    rows = rows.join(lists, "document_id")
    runs = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.col("own")), lambda i: F.array_join(F.slice("ws", i, n), "\x01"))))
    met = rows.withColumn("runs", runs).select("document_id", "page", "own", *corners, "runs", F.explode(F.array_intersect("keys", "runs")).alias("key"))
    at = ((F.array_position("runs", F.col("key")) - 1) % F.col("own") + 1).cast("int")
    side = lambda f, c: F.round(f(F.slice(c, at, F.size(F.split("key", "\x01")))), 2).alias(c)
    found = met.select("document_id", "key", F.struct("page", side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")).alias("found"))
    first = found.groupBy("document_id", "key").agg(F.min_by("found", "found.page").alias("found"))
    return asked.join(first, ["document_id", "key"]).select("document_id", "para_id", "found.*")
