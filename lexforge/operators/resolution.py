"""Resolution of references against a registry of canonical ids.

A registry has ref_type (section, rule, go), number, year (orders only), canonical_id,
source_document and seq, its order.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..sources.staging import written

#: Confidence of a resolved section or rule, alone and of several, and of fuzzy matches times their ratio.
SINGLE, OF_SEVERAL, FUZZY = 0.95, 0.85, {"section": (0.8, 0.7), "go": (0.85, 0.65)}
_PART = "struct<canonical_id:string,title:string>"
_YEAR = "struct<canonical_id:string,subject:string>"


def flatten_registry(registries: DataFrame) -> DataFrame:
    """Rows of nested registries, one JSON text a row in column `registry`.

    acts -> sections and rules -> rules give a row a number; go_index gives one a year, whether
    an order has one year in place or a map of years.  Broken JSON gives no rows.
    """
    text = F.col("registry")
    parts = []
    for kind, outer, inner in (("section", "acts", "sections"), ("rule", "rules", "rules")):
        book = F.from_json(text, f"struct<{outer}:map<string,struct<full_name:string,{inner}:map<string,{_PART}>>>>")
        rows = registries.select(F.explode(book[outer]).alias("book", "v")).select("book", "v.full_name", F.explode(f"v.{inner}").alias("number", "p"))
        parts.append(rows.select(F.lit(kind).alias("ref_type"), "number", F.lit(None).cast("string").alias("year"), "p.canonical_id", F.col("full_name").alias("source_document")))
    orders = registries.select(F.explode(F.from_json(text, "struct<go_index:map<string,string>>")["go_index"]).alias("number", "info"))
    one = orders.withColumn("o", F.from_json("info", "struct<year:string,canonical_id:string,subject:string>"))
    single = one.filter("o.year IS NOT NULL").select("number", "o.year", "o.canonical_id", "o.subject")
    many = one.filter("o.year IS NULL").select("number", F.explode(F.from_json("info", f"map<string,{_YEAR}>")).alias("year", "y")).filter("y IS NOT NULL").select("number", "year", "y.canonical_id", "y.subject")
    both = single.unionByName(many)
    built = F.concat(F.lit("GO.MS.No."), F.col("number"), F.lit("_"), F.col("year"))
    parts.append(both.select(F.lit("go").alias("ref_type"), "number", "year", F.coalesce("canonical_id", built).alias("canonical_id"), F.col("subject").alias("source_document")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def base_number(text: Column, kind: str) -> Column:
    """The number behind Section or Rule without its brackets; null if there is none."""
    word = {"section": r"(?i)Section\s+(\d+)", "rule": r"(?i)Rule\s+(\d+)"}[kind]
    return F.nullif(F.regexp_extract(text, word, 1), F.lit(""))


def _books(registry: DataFrame, kind: str) -> DataFrame:
    """(base, _n, _docs) of a kind's numbers: the candidates' count and, for each document, its first."""
    of = registry.filter((F.col("ref_type") == kind) & F.col("canonical_id").isNotNull()).select(F.col("number").alias("base"), "canonical_id", "source_document", "seq")
    docs = of.groupBy("base", F.lower("source_document").alias("doc")).agg(F.count("*").alias("n"), F.min(F.struct("seq", "canonical_id")).alias("first"))
    return docs.groupBy("base").agg(F.sum("n").alias("_n"), F.collect_list(F.struct("doc", "first")).alias("_docs"))


def choose_parts(references: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """(ref_id, raw_text, base, seq, canonical_id, method, confidence): resolve_parts without alternatives.

    A candidate's points depend on its document alone, so each reference is held against the
    first candidate of each document that has its number, not against every candidate.
    """
    asked = references.withColumn("base", base_number(F.col("raw_text"), kind)).withColumn("_low", F.lower(F.coalesce("context", F.lit(""))))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    low = F.col("_low")
    score = lambda doc: points((low != "") & low.contains(doc), 10) + points(low.contains("rte") & doc.contains("rte"), 5) + points(low.contains("education act") & doc.contains("education act"), 5)
    best = F.array_min(F.transform("_docs", lambda d: F.struct((-score(d["doc"])).alias("s"), d["first"].alias("first"))))["first"]
    rows = asked.join(_books(registry, kind), "base", "left").withColumn("_best", best)
    return rows.select(
        "ref_id", "raw_text", "base", "_best.seq", "_best.canonical_id",
        F.when(F.col("_n") == 1, "exact").when(F.col("_n") > 1, "exact_with_disambiguation").otherwise("failed").alias("method"),
        F.when(F.col("_n") == 1, SINGLE).when(F.col("_n") > 1, OF_SEVERAL).otherwise(0.0).alias("confidence"),
    )


def resolve_parts(references: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """(ref_id, raw_text, context) of sections or rules to canonical ids.

    One candidate counts 0.95.  Of several the best by context counts 0.85: 10 where it names
    the candidate's document, 5 each where both speak of RTE or an education act; ties go to
    the registry's order, and the others are alternatives in that order.  These are listed
    once for each candidate that can be the best, not for each reference.
    """
    chosen = choose_parts(references, registry, kind)
    of = registry.filter((F.col("ref_type") == kind) & F.col("canonical_id").isNotNull())
    every = of.groupBy(F.col("number").alias("base")).agg(F.array_sort(F.collect_list(F.struct("seq", "canonical_id"))).alias("all"))
    firsts = _books(registry, kind).select("base", F.explode(F.array_distinct(F.transform("_docs", lambda d: d["first"]))).alias("first"))
    at = F.array_position("all", F.col("first")).cast("int")
    others = F.concat(F.slice("all", F.lit(1), at - 1), F.slice("all", at + 1, F.size("all")))
    lists = firsts.join(every, "base").select("base", "first.seq", "first.canonical_id", F.transform(others, lambda x: x["canonical_id"]).alias("alternatives"))
    out = chosen.join(lists, ["base", "seq", "canonical_id"], "left")
    return out.select("ref_id", "raw_text", "canonical_id", "method", "confidence", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"))


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts that matching blocks cover, 2 * matched / all."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


#: Longest numbers whose deletion neighbourhoods are listed: at most some 400 keys a number.
SHORT = 12


def _neighbourhood(number: Column, percent: int, mine: str) -> Column:
    """Keys that a number of up to SHORT characters shares with every one it can match.

    A match of lengths m and n has a common subsequence of over percent / 200 * (m + n)
    characters, so for each length of the other the number's subsequences of just the least
    such length are keys, with both lengths, the asked number's first.
    """
    length = F.length(number)
    without_one = lambda texts: F.array_distinct(F.flatten(F.transform(texts, lambda v: F.transform(
        F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1))))))
    shorter, lists = F.array(number), []
    for _ in range(SHORT // 3):
        lists.append(shorter)
        shorter = F.when(length > 3 * len(lists) - 2, without_one(shorter)).otherwise(F.array().cast("array<string>"))
    lists.append(shorter)
    common = lambda n: F.floor((n + length) * percent / 200) + 1
    others = F.filter(F.sequence(F.lit(1), F.lit(SHORT)), lambda n: (common(n) <= n) & (common(n) <= length))
    lengths = (lambda n: (length, n)) if mine == "number" else (lambda n: (n, length))
    keys = F.flatten(F.transform(others, lambda n: F.transform(
        F.element_at(F.array(*lists), (length - common(n) + 1).cast("int")), lambda v: F.concat_ws(":", v, *[x.cast("string") for x in lengths(n)]))))
    return F.when((length > 0) & (length <= SHORT), keys).otherwise(F.array().cast("array<string>"))


def resolve_fuzzy(numbers: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """The most similar registered number of each distinct `number`, above the kind's threshold.

    Numbers of up to SHORT characters meet by common subsequences as long as the threshold
    asks, listed for both sides, so candidates are few and none is lost.  Two longer texts over
    these thresholds share a pair of neighbouring characters, for what is left over can't cut
    the matched part into single ones, no further apart than the texts may differ.  Both are
    equi-joins.  Ties go to the registry's order.  Numbers without a match are absent.
    """
    least, weight = FUZZY[kind]
    percent = round(100 * least)
    known = registry.filter(F.col("ref_type") == kind).groupBy(F.col("number").alias("match")).agg(
        F.min("seq").alias("seq"), (F.max_by("canonical_id", F.col("year").cast("int")) if kind == "go" else F.min_by("canonical_id", "seq")).alias("canonical_id")
    )
    asked = numbers.select("number").distinct()
    met = candidates(asked, known.select("match"), percent)
    rated = met.withColumn("ratio", sequence_ratio("number", "match")).filter(F.col("ratio") > least).join(known, "match")
    order = W.partitionBy("number").orderBy(F.desc("ratio"), "seq")
    return rated.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(
        "number", "match", "canonical_id", F.round("ratio", 9).alias("ratio"), F.round(F.col("ratio") * weight, 9).alias("confidence")
    )


def candidates(asked: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Distinct (number, match) that may have a ratio over percent / 100."""
    near = asked.withColumn("key", F.explode(_neighbourhood(F.col("number"), percent, "number")))
    near = near.join(known.withColumn("key", F.explode(_neighbourhood(F.col("match"), percent, "match"))), "key")
    # A place and a pair of characters, for each pair with a longer text.
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring(c, i, F.lit(2)).alias("pair")))
    reach = lambda c: F.length(c) > F.lit(SHORT * percent / (200 - percent))
    one = asked.filter(reach("number")).select("number", F.inline(pairs(F.col("number")))).withColumnRenamed("at", "i")
    two = known.filter(reach("match")).select("match", F.inline(pairs(F.col("match")))).withColumnRenamed("at", "j")
    total = F.length("number") + F.length("match")
    fits = (200 * F.least(F.length("number"), F.length("match")) > percent * total) & (F.greatest(F.length("number"), F.length("match")) > SHORT)
    far = one.join(two, "pair").filter(fits & (100 * F.abs(F.col("i") - F.col("j")) < (100 - percent) * total))
    return near.select("number", "match").unionByName(far.select("number", "match")).distinct()


def resolve_relations(relations: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolves (rel_id, raw_text, go_number, year, confidence, context) by what the raw text names.

    Section and rule first, else the order's number, else a number behind "No." in a text
    that names an order.  Adds canonical_id, status, method and resolution_confidence; a
    relation's confidence is multiplied by a resolution's under 0.7, and by 0.3 unresolved.
    """
    from .relations import resolve_go

    low = F.lower("raw_text")
    named = F.when(F.col("raw_text").rlike(r"(?i)G\.?O\.?(?:MS|RT)?"), F.nullif(F.regexp_extract("raw_text", r"(?i)No\.?\s*(\d+)", 1), F.lit("")))
    number = F.coalesce(F.nullif("go_number", F.lit("")), named)
    kind = F.when(low.contains("section"), "section").when(low.contains("rule"), "rule").when(number.isNotNull(), "go").otherwise("unknown")
    rows = relations.withColumns({"_kind": kind, "_number": number})
    refs = rows.select(F.col("rel_id").alias("ref_id"), "raw_text", "context", "_kind", "_number", "year")
    orders = registry.filter("ref_type = 'go'").select("number", F.col("year").cast("int").alias("year"), "canonical_id")
    asked = refs.filter("_kind = 'go'").select("ref_id", F.col("_number").alias("number"), F.col("year").cast("int").alias("year"))
    columns = ["ref_id", "canonical_id", "method", "confidence"]
    exact = written(resolve_go(asked, orders).select(*columns, "number"), "exact")
    fuzzy = {}
    fuzzy["go"] = resolve_fuzzy(exact.filter("canonical_id IS NULL").select("number"), registry, "go")
    found = exact.join(fuzzy["go"].select("number", F.col("canonical_id").alias("_f"), F.col("confidence").alias("_c")), "number", "left").select(
        "ref_id", F.coalesce("canonical_id", "_f").alias("canonical_id"), F.when(F.col("canonical_id").isNull() & F.col("_f").isNotNull(), "fuzzy").otherwise(F.col("method")).alias("method"),
        F.when(F.col("canonical_id").isNull() & F.col("_f").isNotNull(), F.col("_c")).otherwise(F.col("confidence")).alias("confidence"))
    sections = written(choose_parts(refs.filter("_kind = 'section'"), registry, "section").select(*columns, F.col("base").alias("number")), "sections")
    fuzzy["section"] = resolve_fuzzy(sections.filter("canonical_id IS NULL AND number IS NOT NULL").select("number"), registry, "section")
    sections = sections.join(fuzzy["section"].select("number", F.col("canonical_id").alias("_f"), F.col("confidence").alias("_c")), "number", "left").select(
        "ref_id", F.coalesce("canonical_id", "_f").alias("canonical_id"), F.when(F.col("canonical_id").isNull() & F.col("_f").isNotNull(), "fuzzy").otherwise(F.col("method")).alias("method"),
        F.when(F.col("canonical_id").isNull() & F.col("_f").isNotNull(), F.col("_c")).otherwise(F.col("confidence")).alias("confidence"))
    rules = choose_parts(refs.filter("_kind = 'rule'"), registry, "rule").select(columns)
    every = found.unionByName(sections).unionByName(rules).select(F.col("ref_id").alias("rel_id"), "canonical_id", "method", F.col("confidence").alias("resolution_confidence"))
    out = relations.join(every, "rel_id", "left").withColumns({"method": F.coalesce("method", F.lit("failed")), "resolution_confidence": F.coalesce("resolution_confidence", F.lit(0.0))})
    factor = F.when(F.col("canonical_id").isNull(), 0.3).when(F.col("resolution_confidence") < 0.7, F.col("resolution_confidence")).otherwise(1.0)
    return out.withColumn("confidence", F.col("confidence") * factor).withColumn("status", F.when(F.col("canonical_id").isNotNull(), "resolved").otherwise("unresolved"))
