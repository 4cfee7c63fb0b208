"""Chunks of documents by kind, from their sections, with a running index in each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import structure as st
from ..functions.packing import pack_paragraphs, pack_points
from ..functions.segments import paragraphs
from ..functions.spans import spans, strip
from ..sources.staging import written
from .acts import act_leads, act_nodes, has_nodes

#: Least and most characters and overlap of a kind's chunks.
SIZES = {"legal": (800, 1500, 150), "judicial": (700, 1300, 120), "data": (500, 1000, 80), "scheme": (600, 1200, 100)}
_CLAUSE, _POINT = st.SUBCLAUSE, r"(?md)^(?:\d+\.|\([ivxIVX]+\)|\([a-z]\))\s+"
_BULLET, _TABLE = r"(?md)^(?:[\•\-\*]|\d+\.|\([a-z]\))\s+", r"(?i)(?:Table|Chart|Figure)\s+\d+"
LEAST_TEXT = 50


def points(text: Column, pattern: str) -> Column:
    """Pieces of a text from each match of a pattern to the next."""
    # Not bound: with it in their argument the packing functions are not taken out of Spark's plan and can't run.
    hits = spans(text, pattern, 0)
    cut = F.transform(hits, lambda h, i: strip(F.substr(text, h["start"] + 1, F.coalesce(F.get(hits, i + 1)["start"], F.length(text)) - h["start"])))
    return F.filter(cut, lambda p: p != "")


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of (document_id, place, pieces) as chunks with a running index."""
    flat = rows.select("document_id", "place", *columns, F.posexplode("pieces").alias("at", "content"))
    order = W.partitionBy("document_id").orderBy("place", "at")
    index = F.row_number().over(order) - 1
    return flat.withColumn("chunk_index", index).select(
        "document_id", F.concat("document_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", *columns, "content"
    )


def _long_enough(docs: DataFrame) -> DataFrame:
    return docs.filter(F.length(strip(F.col("text"))) >= LEAST_TEXT)


def chunk_go(docs: DataFrame) -> DataFrame:
    """Chunks of orders (document_id, text): the preamble, every clause, then the annexures.

    Adds section_type, priority, canonical_id (of the clause) and legal_effect; the index runs
    on from one part to the next, and annexures count from 1000.  Documents without orders
    have none; see rejected.
    """
    named = st.go_identity(F.col("text"))
    own = docs.select("document_id", st.cut_order(F.col("text")).alias("cut"), *[named[n].alias(f"id_{n}") for n in ("go_number", "year")])
    own = own.select("document_id", "cut.*", "id_go_number", "id_year").filter("orders <> ''")
    orders = F.transform(st.go_paragraphs(F.col("orders")), lambda p: F.struct(p["para_no"].alias("para_no"), p["content"].alias("content")))
    # Written once, since three parts read it and the patterns are dear.
    base = written(own.select("document_id", "preamble", orders.alias("orders"), "annexures", "id_go_number", "id_year"), "orders")
    named = F.concat(F.lit("AP_GO_"), F.coalesce("id_go_number", F.lit("UNK")), F.lit("_"), F.coalesce("id_year", F.lit("UNK")), F.lit("_P"))
    none = F.lit(None).cast("string")
    part = lambda rows, place, at, kind, priority, canonical, effect, content: rows.select(
        "document_id", F.lit(place).alias("place"), at.alias("at"), F.lit(kind).alias("section_type"), F.lit(priority).alias("priority"), canonical.alias("canonical_id"), effect.alias("legal_effect"), content.alias("content"))
    preamble = part(base.filter("preamble <> ''"), 0, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), "preamble", "low", none, none, F.col("preamble"))
    listed = base.select("document_id", named.alias("named"), F.posexplode("orders").alias("a", "o"))
    listed = listed.select("document_id", "named", "a", st.order_semantics(F.col("o.content"))["legal_effect"].alias("effect"), F.posexplode(st.go_clauses(F.col("o.content"), F.col("o.para_no"))).alias("b", "c"))
    clauses = part(listed, 1, F.struct("a", "b"), "order_clause", "high", F.concat("named", F.col("c.clause_id")), F.col("effect"), F.col("c.clause_text"))
    annexed = base.select("document_id", F.posexplode(st.annexures(F.col("annexures"))).alias("a", "x"))
    annexes = part(annexed, 2, F.struct("a", F.lit(0).alias("b")), "annexure", "supporting", none, none, F.col("x.content"))
    order = W.partitionBy("document_id").orderBy("place", "at")
    rows = preamble.unionByName(clauses).unionByName(annexes).withColumn("chunk_index", F.row_number().over(order) - 1)
    index = F.when(F.col("section_type") == "annexure", F.lit(1000) + F.col("at.a")).otherwise(F.col("chunk_index")).cast("int")
    return rows.withColumn("chunk_index", index).select(
        "document_id", F.concat("document_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "section_type", "priority", "canonical_id", "legal_effect", "content"
    )


def rejected_orders(docs: DataFrame) -> DataFrame:
    """Orders without any structure, for quarantine."""
    return docs.filter(F.coalesce("text", F.lit("")) == "").select("document_id", F.lit("GO structure missing").alias("error"))


def chunk_legal(docs: DataFrame) -> DataFrame:
    """Chunks of acts: a node whole up to 1,500 characters, else by its clauses, else by
    paragraphs.  What stands before the first heading is a node of its own, of type lead; an
    act without headings is whole up to that length, else packed by paragraphs, without a type."""
    least, most, overlap = SIZES["legal"]
    docs = _long_enough(docs).withColumn("_headed", has_nodes(F.col("text")))
    headed = docs.filter("_headed")
    nodes = act_nodes(headed).select("document_id", F.col("start").alias("place"), "section_type", F.col("number").alias("section_number"), "chapter", F.col("content").alias("text"))
    none = F.lit(None).cast("string")
    leads = act_leads(headed).select("document_id", F.lit(-1).alias("place"), F.lit("lead").alias("section_type"), none.alias("section_number"), none.alias("chapter"), F.col("content").alias("text"))
    columns = ["section_type", "section_number", "chapter"]
    split = _split(nodes.unionByName(leads), most, points(F.col("text"), _CLAUSE), F.lit(True), "\n\n", True, least, overlap).select("document_id", "place", *columns, "pieces")
    plain = docs.filter("NOT _headed").select("document_id", F.lit(0).alias("place"), *[none.alias(c) for c in columns], strip(F.col("text")).alias("text"))
    plain = plain.withColumn("_packed", pack_paragraphs(F.when(F.length("text") > most, paragraphs(F.col("text"))), least, most, overlap))
    packed = plain.select("document_id", "place", *columns, F.when(F.length("text") > most, F.col("_packed")).otherwise(F.array("text")).alias("pieces"))
    return _numbered(split.unionByName(packed), columns)


def _split(rows: DataFrame, most: int, listed: Column, may_list: Column, joiner: str, carry: bool, least: int, overlap: int) -> DataFrame:
    """Adds pieces: the text whole where it is short, else its points packed, else its paragraphs."""
    long = F.length("text") > most
    rows = rows.withColumn("_points", F.when(long & may_list, listed).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_paragraphs", F.when(long & (F.size("_points") == 0), paragraphs(F.col("text"))))
    packed, grouped = pack_points(F.col("_points"), most, joiner, carry), pack_paragraphs(F.col("_paragraphs"), least, most, overlap)
    return rows.withColumns({"_packed": packed, "_grouped": grouped}).withColumn(
        "pieces", F.when(~long, F.array("text")).when(F.size("_points") > 0, F.col("_packed")).otherwise(F.col("_grouped"))
    )


def chunk_judicial(docs: DataFrame) -> DataFrame:
    """Chunks of judgments: a section whole up to 1,300 characters; of a longer ratio every
    paragraph alone, an oversized one by sentences with low confidence; numbered points of
    arguments and headnotes packed; else paragraphs."""
    least, most, overlap = SIZES["judicial"]
    rows = _long_enough(docs).select("document_id", F.posexplode(st.judgment_sections(F.col("text"))).alias("place", "s"))
    rows = rows.select("document_id", "place", "s.section_type", F.col("s.content").alias("text"))
    ratio = F.col("section_type") == "ratio"
    sentences = lambda p: F.transform(F.split(p, r"\. "), lambda s: F.concat(strip(s), F.lit(".")))
    reasoned = rows.filter(ratio & (F.length("text") > most)).select("document_id", "place", "section_type", F.posexplode(paragraphs(F.col("text"))).alias("sub", "text"))
    reasoned = reasoned.withColumn("long", F.length("text") > most).withColumn("_packed", pack_points(F.when(F.col("long"), sentences(F.col("text"))), most, " "))
    reasoned = reasoned.withColumn("pieces", F.when(F.col("long"), F.col("_packed")).otherwise(F.array("text"))).withColumn("ratio_confidence", F.when(F.col("long"), "low").otherwise("high"))
    others = rows.filter(~ratio | (F.length("text") <= most))
    pointed = F.col("section_type").isin("arguments_petitioner", "arguments_respondent", "headnote")
    others = _split(others, most, points(F.col("text"), _POINT), pointed, "\n\n", False, least, overlap).withColumn("ratio_confidence", F.when(ratio, "high"))
    columns = ["document_id", "section_type", "ratio_confidence", "pieces"]
    both = reasoned.select(F.struct("place", "sub").alias("place"), *columns).unionByName(others.select(F.struct("place", F.lit(0).alias("sub")).alias("place"), *columns))
    return _numbered(both, ["section_type", "ratio_confidence"])


def chunk_scheme(docs: DataFrame) -> DataFrame:
    """Chunks of schemes: a section whole up to 1,200 characters, bullets packed for eligibility and benefits, else paragraphs."""
    least, most, overlap = SIZES["scheme"]
    rows = _long_enough(docs).select("document_id", F.posexplode(st.scheme_sections(F.col("text"))).alias("place", "s"))
    rows = rows.select("document_id", "place", "s.section_type", F.col("s.content").alias("text"))
    return _numbered(_split(rows, most, points(F.col("text"), _BULLET), F.col("section_type").isin("eligibility", "benefits"), "\n", False, least, overlap), ["section_type"])


def chunk_data(docs: DataFrame) -> DataFrame:
    """Chunks of reports: each table whole to the next table or a gap of two blank lines, the text
    between packed by paragraphs."""
    least, most, overlap = SIZES["data"]
    text = F.col("text")
    rows = _long_enough(docs).withColumn("_tables", spans(text, _TABLE, 0))
    def ends(t: Column, i: Column) -> Column:
        following = F.coalesce(F.get(F.col("_tables"), i + 1)["start"], F.length(text))
        gap = F.locate("\n\n\n", F.substr(text, t["start"] + 1)) - 1
        return F.struct(t["start"].alias("start"), F.when((gap >= 0) & (t["start"] + gap <= following), t["start"] + gap).otherwise(following).alias("stop"), t["matched"].alias("name"))

    rows = rows.withColumn("_tables", F.transform("_tables", ends))
    part = lambda kind, name, start, stop: F.struct(F.lit(kind).alias("kind"), name.alias("table_name"), strip(F.substr(text, start + 1, stop - start)).alias("text"))
    none = F.lit(None).cast("string")
    both = F.flatten(F.transform("_tables", lambda t, i: F.array(
        part("text", none, F.when(i > 0, F.get(F.col("_tables"), i - 1)["stop"]).otherwise(0), t["start"]), part("table", t["name"], t["start"], t["stop"]))))
    last = F.coalesce(F.try_element_at("_tables", F.lit(-1))["stop"], F.lit(0))
    sections = F.filter(F.concat(both, F.array(part("text", none, last, F.length(text)))), lambda s: s["text"] != "")
    cut = rows.select("document_id", F.posexplode(sections).alias("place", "s")).select("document_id", "place", F.col("s.kind").alias("chunk_type"), "s.table_name", "s.text")
    cut = cut.withColumn("_paragraphs", F.when(F.col("chunk_type") == "text", paragraphs(F.col("text")))).withColumn("_grouped", pack_paragraphs(F.col("_paragraphs"), least, most, overlap))
    return _numbered(cut.withColumn("pieces", F.when(F.col("chunk_type") == "table", F.array("text")).otherwise(F.col("_grouped"))), ["chunk_type", "table_name"])


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, words, characters and lines by vertical and document, with totals (null keys)."""
    text = F.coalesce("content", F.lit(""))
    words, lines = F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))).cast("long"), F.size(F.split(text, "\n")).cast("long")
    return chunks.rollup("vertical", "document_id").agg(
        F.count("*").alias("n_chunks"), F.sum(words).alias("n_words"), F.round(F.avg(F.length(text)), 6).alias("avg_chars"), F.min(F.length(text)).cast("long").alias("min_chars"),
        F.max(F.length(text)).cast("long").alias("max_chars"), F.sum(lines).alias("n_lines"), F.grouping_id().cast("long").alias("level"),
    )
