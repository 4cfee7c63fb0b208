"""Registered queries of sources, sinks, embeddings, anchors and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import embedding, report_tables
from ..functions import unicode as u
from ..operators import anchors, packages
from ..plans.registering import Register
from ..sources import commits, files, sinks
from ..sources.staging import new_folder
from .search import _hybrid

register = Register()


def _folder(v, name: str) -> str:
    return new_folder(v("documents").sparkSession, name)


def _files(v):
    """Whole-text files that Spark writes from the documents, read back by the reader."""
    path = _folder(v, "corpus")
    v("papers").select("doc_type", F.regexp_replace("text", r"[\r\n]+", " ").alias("text")).write.partitionBy("doc_type").text(path)
    rows = files.corpus_files(v("documents").sparkSession, path, ("txt",))
    return rows.agg(F.sum(F.size(F.split(F.regexp_replace("text", r"\n+\z", ""), "\n"))).cast("long").alias("n_texts"), F.count_if(F.col("bytes") > 0).alias("n_files"), F.count_if(F.col("doc_id").contains("-")).alias("n_bad_ids")).select("n_texts", "n_bad_ids")


register("src_01_corpus_files", _files, "SELECT CAST(count(*) AS BIGINT) AS n_texts, CAST(0 AS BIGINT) AS n_bad_ids FROM papers")
_PATH = "CASE k % 4 WHEN 0 THEN 'data/GO files/2019/go_ms_' || k || '_2019.pdf' WHEN 1 THEN 'a/b/c/High Court/d/wp ' || k || '.TXT' WHEN 2 THEN 'budget docs/Budget-2021-' || k || '.xlsx' ELSE 'note' || k END"


def _signals(v):
    path = F.expr(_PATH)
    return v("papers").select("k", files.document_id(path).alias("doc_id"), *[c.alias(n) for n, c in files.path_signals(path, F.col("k") * 700).items()])


register("src_02_path_signals", _signals, f"""
WITH p AS (SELECT k, {_PATH} AS path FROM papers), q AS (SELECT *, string_split(path, '/')[-1] AS name, list_transform(string_split(path, '/')[:-2], lambda f: lower(f)) AS all_f FROM p),
r AS (SELECT *, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem, CASE WHEN len(all_f) > 4 THEN all_f[-4:] ELSE all_f END AS f FROM q)
SELECT k, regexp_replace(stem, '[ \\-]', '_', 'g') AS doc_id, lower(regexp_extract(name, '\\.[^.]*$')) AS file_extension, CAST(round(k * 700 / 1024.0) AS BIGINT) AS file_size_kb, CASE WHEN lower(name) LIKE '%.pdf' THEN 'pdf' ELSE 'document' END AS source_type, CAST(len(f) AS INT) AS folder_depth,
coalesce(f[1], '') AS top_folder, coalesce(f[-1], '') AS immediate_parent, len(list_filter(f, lambda x: regexp_matches(x, '(?i)G\\.?O\\.?'))) > 0 AS contains_go, len(list_filter(f, lambda x: regexp_matches(x, 'supreme|high|district|tribunal'))) > 0 AS contains_court,
len(list_filter(f, lambda x: contains(x, 'budget'))) > 0 AS contains_budget, CASE WHEN len(list_filter(f, lambda x: regexp_matches(x, 'supreme|high|district|tribunal'))) > 0 THEN 'judicial' WHEN len(list_filter(f, lambda x: regexp_matches(x, '(?i)G\\.?O\\.?'))) > 0 THEN 'executive' ELSE 'informational' END AS authority_hint,
CAST(nullif(regexp_extract(stem, '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b', 1), '') AS INT) AS year_hint, CASE WHEN regexp_matches(stem, '(?i)G\\.?O\\.?') THEN 'go' WHEN regexp_matches(stem, 'supreme|high|district|tribunal') THEN 'judicial' WHEN contains(stem, 'budget') THEN 'financial' ELSE 'general' END AS doc_family FROM r""")


def _chunk_lines(v):
    path = _folder(v, "chunk-lines")
    row = F.to_json(F.struct("chunk_id", F.when(F.col("chunk_id").like("%7_0"), None).otherwise(F.col("document_id")).alias("doc_id"), F.when(F.col("chunk_id").like("%3_0"), "  ").otherwise(F.col("text")).alias("text")))
    v("chunks").select(F.when(F.col("chunk_id").like("%9_0"), "{broken").otherwise(row).alias("value")).write.text(path)
    good, bad = files.read_chunks(v("documents").sparkSession, path)
    return good.select("chunk_id", F.lit("kept").alias("state")).unionByName(bad.select(F.get_json_object("raw_payload", "$.chunk_id").alias("chunk_id"), F.lit("quarantined").alias("state")))


register("src_03_read_chunks_jsonl", _chunk_lines, """
SELECT CASE WHEN chunk_id LIKE '%9_0' THEN NULL ELSE chunk_id END AS chunk_id, CASE WHEN chunk_id LIKE '%9_0' OR chunk_id LIKE '%7_0' THEN 'quarantined' ELSE 'kept' END AS state FROM chunks WHERE chunk_id LIKE '%9_0' OR chunk_id LIKE '%7_0' OR (chunk_id NOT LIKE '%3_0' AND trim(regexp_replace(text, '\\s', '', 'g')) <> '')""")


def _golden(v):
    path = _folder(v, "golden")
    row = F.struct(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.array(F.struct(F.col("query_id").cast("string").alias("doc_id"), F.lit("t").alias("title"))).alias("expected_citations"),
                   F.when(F.col("query_id") % 50 == 0, "factual").otherwise("comparative").alias("query_type"), F.lit("education").alias("domain"))
    # A JSON array is one file: each of these holds one query.
    v("asks").select(F.concat(F.lit("["), F.to_json(row), F.lit("]")).alias("value")).repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.golden_set(v("documents").sparkSession, path, query_type="factual", domain="education").select("query_id", "query", F.col("expected_citations")[0]["doc_id"].alias("doc_id"))


register("src_04_golden_set", _golden, "SELECT CAST(query_id AS VARCHAR) AS query_id, text AS query, CAST(query_id AS VARCHAR) AS doc_id FROM asks WHERE query_id % 50 = 0")


def _partitioned(v):
    path = _folder(v, "partitioned")
    sinks.write_partitioned(v("papers").select("document_id", F.col("doc_type").alias("vertical"), "title"), path)
    return v("documents").sparkSession.read.parquet(path).groupBy("vertical").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


register("snk_01_write_partitioned", _partitioned, "SELECT doc_type AS vertical, count(*) AS n, min(title) AS first_title FROM papers GROUP BY 1")
_SCHEMA = T.StructType([T.StructField("go_id", T.StringType(), False), T.StructField("amount", T.LongType(), False), T.StructField("note", T.StringType())])


def _loaded(v):
    rows = v("papers").select(F.when(F.col("k") % 5 != 0, F.col("document_id")).alias("go_id"), F.when(F.col("k") % 7 == 0, "many").otherwise(F.col("k").cast("string")).alias("amount"), F.lit(1).alias("other"))
    good, bad = sinks.load_table(rows, _SCHEMA)
    return good.select("go_id", "amount", F.lit(None).cast("string").alias("missing")).unionByName(bad.select(F.lit(None).cast("string").alias("go_id"), F.lit(None).cast("long").alias("amount"), F.col("error_type").alias("missing")))


register("snk_02_load_table", _loaded, """
SELECT CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN document_id END AS go_id, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN k END AS amount, CASE WHEN k % 5 = 0 AND k % 7 = 0 THEN 'go_id,amount' WHEN k % 5 = 0 THEN 'go_id' WHEN k % 7 = 0 THEN 'amount' END AS missing FROM papers""")


def _tables(v):
    """Papers appended to two tables, one run twice; a dropped table is empty again."""
    spark, root = v("documents").sparkSession, _folder(v, "tables")
    rows = v("papers").select(F.when(F.col("k") % 5 != 0, F.col("document_id")).alias("go_id"), F.when(F.col("k") % 7 == 0, "many").otherwise(F.col("k").cast("string")).alias("amount"), F.col("title").alias("note"), F.lit(1).alias("other"))
    commits.create_tables(spark, root, "make", {"orders": _SCHEMA, "gone": _SCHEMA})
    for run in ("first", "first", "second"):
        commits.append_committed(spark, root, run, {"orders": rows, "gone": rows.filter("amount <> 'many'")})
    commits.create_tables(spark, root, "again", {"orders": _SCHEMA})
    commits.create_tables(spark, root, "drop", {"gone": _SCHEMA}, drop=True)
    good, bad = commits.read_committed(spark, root, "orders"), commits.read_committed(spark, root, "quarantine")
    left = commits.read_committed(spark, root, "gone").select("go_id", "amount", F.lit("left").alias("state"))
    return good.select("go_id", "amount", "note").unionByName(left.withColumnRenamed("state", "note")).unionByName(
        bad.filter("table = 'orders'").select(F.get_json_object("raw_payload", "$.go_id").alias("go_id"), F.lit(None).cast("long").alias("amount"), F.col("error_type").alias("note")))


register("snk_02_committed_tables", _tables, """
SELECT CASE WHEN k % 5 <> 0 THEN document_id END AS go_id, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN k END AS amount,
CASE WHEN k % 5 = 0 AND k % 7 = 0 THEN 'go_id,amount' WHEN k % 5 = 0 THEN 'go_id' WHEN k % 7 = 0 THEN 'amount' ELSE title END AS note FROM papers, (VALUES (1), (2)) x(run)""")


def _payload(v):
    rows = v("chunks").join(v("papers").select("document_id", "k"), "document_id").select("document_id", "chunk_id", F.repeat("text", 20).alias("text"), F.when(F.col("k") % 2 == 0, "GO ").alias("vertical"), (F.col("k") % 3 == 0).alias("is_table"))
    got = sinks.vector_payload(rows)
    field = lambda n: F.get_json_object("payload", f"$.{n}").alias(n)
    return got.select("point_id", "collection", field("chunk_id"), field("vertical"), field("is_table"), field("has_relations"), F.md5(F.get_json_object("payload", "$.text")).alias("text_md5"), field("char_count"))


_NS = r"'\x6b\xa7\xb8\x10\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB"
register("snk_04_vector_payload", _payload, f"""
WITH c AS (SELECT c.*, k, repeat(c.text, 20) AS t FROM chunks c JOIN papers USING (document_id)), h AS (SELECT *, sha1({_NS} || encode(document_id || '|' || chunk_id)) AS s FROM c)
SELECT substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(s, 17, 1)) - 1) % 4, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS point_id,
CASE WHEN k % 2 = 0 THEN 'government_orders' END AS collection, chunk_id, CASE WHEN k % 2 = 0 THEN 'GO ' ELSE 'unknown' END AS vertical, CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END AS is_table, 'false' AS has_relations,
md5(CASE WHEN length(t) > 8000 THEN substr(t, 1, 8000) || '...' ELSE t END) AS text_md5, CAST(length(t) AS VARCHAR) AS char_count FROM h""")
register("emb_03_embed_text", lambda v: embedding.norms(embedding.embed_texts(v("chunks"))).select("embedded", "failed", (F.col("worst") < 1e-9).alias("unit_length")))


def _anchored(v):
    box = lambda p: {"x0": p % 10, "y0": p % 20, "x1": p % 10 + 0.5, "y1": p % 20 + 1}
    sheets = v("papers").select("document_id", F.split("text", " ").alias("ws")).select("document_id", "ws", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 400).cast("int"))).alias("page"))
    placed = F.transform(F.slice("ws", F.col("page") * 400 + 1, 400), lambda w, i: F.struct(w.alias("text"), *[c.cast("double").alias(n) for n, c in box(F.col("page") * 400 + i).items()]))
    sheets = sheets.select("document_id", "page", placed.alias("words"))
    some = v("papers").select("document_id", F.lit(0).alias("para_id"), F.array_join(F.slice(F.split("text", " "), 4, 9), " ").alias("content")).filter(F.size(F.split("content", " ")) > 6)
    return anchors.visual_anchors(some, sheets)


_BARE = "lower(trim({}, '.,()'))"
register("str_13_visual_anchor", _anchored, f"""
WITH w AS (SELECT document_id, unnest(string_split(text, ' ')) AS t, unnest(range(len(string_split(text, ' ')))) AS pos FROM papers), b AS (SELECT document_id, pos, {_BARE.format('t')} AS w FROM w),
c AS (SELECT document_id, array_to_string(string_split(text, ' ')[4:12], ' ') AS content FROM papers WHERE len(string_split(text, ' ')[4:12]) > 6),
q AS (SELECT document_id, list_filter(list_transform(regexp_extract_all(content, '\\S+'), lambda x: trim(x, '.,()')), lambda x: length(x) > 1)[1:5] AS run FROM c),
s AS (SELECT document_id, pos, list(w) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ws FROM b),
m AS (SELECT q.document_id, min(pos) AS pos, len(any_value(run)) AS n FROM q JOIN s ON s.document_id = q.document_id AND len(run) > 0 AND ws[1:len(run)] = list_transform(run, lambda x: lower(x)) GROUP BY 1)
SELECT document_id, 0 AS para_id, CAST(pos // 400 AS INT) AS page, CAST(list_min(list_transform(range(pos, pos + n), lambda x: x % 10)) AS DOUBLE) AS x0, CAST(list_min(list_transform(range(pos, pos + n), lambda x: x % 20)) AS DOUBLE) AS y0,
list_max(list_transform(range(pos, pos + n), lambda x: x % 10)) + 0.5::DOUBLE AS x1, CAST(list_max(list_transform(range(pos, pos + n), lambda x: x % 20)) + 1 AS DOUBLE) AS y1 FROM m""")
register("str_12_report_tables", lambda v: v("filings").filter("vertical = 'data'").select("document_id", F.explode(report_tables.report_tables(F.col("text"))).alias("t")).select("document_id", "t.number", "t.title", "t.n_rows", F.array_join("t.columns", "|").alias("columns"), "t.is_garbled"))


def _packages(v):
    hits = _hybrid(v).withColumnRenamed("boosted", "score").withColumns({"source": F.lit("hybrid"), "rnk": F.col("rank"), "document_id": F.regexp_replace("chunk_id", "_[0-9]+$", "")})
    extra = v("papers").filter("k % 25 = 10").select((F.col("k") + 1_000_000).alias("query_id"), F.lit("compare changes since 2005").alias("text"))
    return packages.answer_package(v("asks").select("query_id", "text").unionByName(extra), hits, v("overrulings"), v("papers"))


register("ans_01_answer_package", _packages)


def _ingested(v):
    return packages.ingest_corpus(v("filings").select("document_id", "file_name", "text"), v("books"))["results"]


register("tbl_19_ingest_corpus", _ingested)


def _committed(v):
    """The ingested documents as their tables give them back, a run committed twice."""
    spark, root = v("documents").sparkSession, _folder(v, "ingested")
    for _ in range(2):
        packages.ingest_to_tables(v("filings").select("document_id", "file_name", "text"), v("books"), root, "night")
    counts = [commits.read_committed(spark, root, t).select("document_id", F.lit(t).alias("table")) for t in ("documents", "chunks", "entities", "results")]
    counts.append(commits.read_committed(spark, root, "relations").select(F.col("source_id").alias("document_id"), F.lit("relations").alias("table")))
    rows = counts[0]
    for part in counts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("document_id", "table").agg(F.count("*").alias("n"))


register("tbl_19_committed_tables", _committed)
register("cln_08_clean_text", lambda v: v("filings").select("document_id", F.md5(u.clean_text(F.col("text"))).alias("cleaned_md5")))
