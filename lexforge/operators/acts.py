"""Headed nodes of acts and rules, by one sweep over each text's boundaries.

A text is cut once, before each heading of any kind.  The pieces become rows; windows over
them give each heading's place, the piece behind it and the last part and chapter before it,
so the work is in proportion to the text, however many headings it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import structure as st
from ..functions.spans import strip

# Words that start a heading, of nodes, containers and other boundaries.
HEADING = r"(?:Section|Sec\.?|Article|Rule|Regulation|Norm\s*s?|CHAPTER|PART|(?:THE\s+)?SCHEDULE|APPENDIX)"
_KINDS = {**st.LEGAL_NODES, "chapter": st.CHAPTER, "part": st.PART}


def _heading(piece: Column, pattern: Column, group: int) -> Column:
    """A group of a kind's own heading pattern at the start of a piece."""
    return F.coalesce(F.call_function("regexp_extract", piece, pattern, F.lit(group)), F.lit(""))


def has_nodes(text: Column) -> Column:
    """Whether a text has any headed node."""
    text = F.coalesce(text, F.lit(""))
    return reduce(Column.__or__, [F.regexp_like(text, F.lit(p)) for p in st.LEGAL_NODES.values()])


def _swept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece that isn't blank: its kind, start, heading, number, raw title, content
    behind the heading, and the last part and chapter before it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.split(text, rf"(?imd)^(?=\s*{HEADING}\s)", -1)
    # The number is given before the rows are multiplied.
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), pieces.alias("pieces")).select("doc", "id", F.posexplode("pieces").alias("at", "piece"))
    rows = rows.withColumn("blank", F.regexp_like("piece", F.lit(r"\A\s*\z")))
    order = W.partitionBy("doc").orderBy("at")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # Blank lines before a heading belong to it.
    rows = rows.withColumn("start", F.coalesce(F.max(F.when(~F.col("blank"), F.col("end"))).over(before), F.lit(0)).cast("int")).filter(~F.col("blank"))
    word = F.lower(F.regexp_extract("piece", rf"(?i)\A\s*({HEADING})\s", 1))
    kind = F.when(word.endswith("schedule"), "schedule").when(word.startswith("norm"), "norm").otherwise(word)
    patterns = F.create_map(*[F.lit(x) for k, p in _KINDS.items() for x in (k, p.replace("^", r"\A", 1))])
    rows = rows.withColumn("kind", kind).withColumn("pattern", F.try_element_at(patterns, F.col("kind"))).withColumn("next", F.lead("piece").over(order))
    # A heading that is alone in its piece takes its title from the next line, which is the next piece's.
    piece, pattern = F.col("piece"), F.col("pattern")
    own = _heading(piece, pattern, 0)
    alone = (own != "") & (strip(_heading(piece, pattern, 2)) == "") & (strip(F.substr("piece", F.length(own) + 1)) == "")
    rows = rows.withColumn("alone", alone & F.col("next").isNotNull())
    # Of headings of one kind that stand alone behind each other, every second is the title of the one before it.
    first = ~F.coalesce(F.lag("alone").over(order) & (F.lag("kind").over(order) == F.col("kind")), F.lit(False))
    rows = rows.withColumn("first", first.cast("int")).withColumn("group", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("doc", "group").orderBy("at")))
    rows = rows.withColumn("piece", F.when(F.col("alone"), F.concat("piece", "next")).otherwise(F.col("piece")))
    number = F.when(F.col("nth") % 2 == 1, F.nullif(_heading(piece, pattern, 1), F.lit("")))
    rows = rows.withColumns({"number": number, "raw": strip(_heading(piece, pattern, 2)), "after": strip(F.substr("piece", F.length(_heading(piece, pattern, 0)) + 1))})
    last = {k: F.last(F.when(F.col("kind") == k, F.col("number")), ignorenulls=True).over(before) for k in ("part", "chapter")}
    return rows.withColumns(last)


def act_nodes(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Sections, articles, rules, regulations, norms, schedules and appendices, a row each.

    id_col, start, section_type, number, title, content (to the next heading of any kind),
    clauses (their marks in order), n_clauses, confidence, and the number of the last part and
    of the last chapter before.  A title that holds a dash goes on as content behind it.  Null
    and empty texts and texts without headings have no nodes; a repeated id's rows are swept each.
    """
    rows = _swept(docs, id_col, text_col).filter(F.col("kind").isin(*st.LEGAL_NODES) & F.col("number").isNotNull())
    dash = F.locate("—", F.col("raw"))
    title = F.when(dash > 0, strip(F.substr("raw", F.lit(1), dash - 1))).otherwise(F.nullif(F.col("raw"), F.lit("")))
    inline = F.when(dash > 0, strip(F.substr("raw", dash + 1))).otherwise("")
    rows = rows.withColumn("title", title).withColumn("content", F.when(inline != "", strip(F.concat(inline, F.lit("\n"), "after"))).otherwise(F.col("after")))
    rows = rows.withColumn("clauses", F.regexp_extract_all("content", F.lit(st.SUBCLAUSE), F.lit(1)))
    doubt = F.when(F.length("content") < 30, 0.3).otherwise(0.0) + F.when(F.col("number").rlike("[0-9][A-Z]"), 0.4).otherwise(0.0)
    doubt = doubt + F.when(F.contains("content", F.lit("�")) | F.contains("content", F.lit("\x00")), 0.2).otherwise(0.0)
    return rows.select(
        F.col("id").alias(id_col), "start", F.col("kind").alias("section_type"), "number", "title", "content", "clauses", F.size("clauses").cast("long").alias("n_clauses"),
        F.round(F.greatest(1.0 - doubt, F.lit(0.3)), 6).alias("confidence"), "part", "chapter",
    )


def act_leads(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(id_col, content): what stands before the first heading of a text."""
    return _swept(docs, id_col, text_col).filter("at = 0 AND kind = ''").select(F.col("id").alias(id_col), strip(F.col("piece")).alias("content"))


def section_text(nodes: DataFrame, wanted: DataFrame, id_col: str = "document_id") -> DataFrame:
    """wanted (id_col, number) with the content of the document's first node of that number; null if it has none."""
    first = nodes.join(wanted.select(id_col, "number").distinct(), [id_col, "number"]).groupBy(id_col, "number").agg(F.min_by("content", "start").alias("content"))
    return wanted.join(first, [id_col, "number"], "left")
