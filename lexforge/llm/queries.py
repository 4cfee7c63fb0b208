"""One registered query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding, url_filter
from .byte_bpe import bpe_decode, bpe_encode, load_ranks
from .hilbert_search import hilbert_search
from .html_extract import html_extract
from .license_scan import license_scan
from .media import pack_media, read_media
from .mixing import mix_plan, word_count
from .ngram_jaccard import ngram_jaccard_join
from .periodic_runs import periodic_runs
from .phrase_mining import collocations, mine_phrases
from .common import WORD, staged
from .substring_dedup import substring_dedup
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Every word with its place; `runs` has each document's runs of 20 words.
OP1_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS MATERIALIZED (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS r
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)
), repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY r ORDER BY doc_id, i) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM repeats) GROUP BY doc_id
), marked AS (
  SELECT w.doc_id, w, coalesce(g, []::BIGINT[]) AS g FROM words w LEFT JOIN gone USING (doc_id)
), kept AS (
  SELECT doc_id, list(x ORDER BY p) AS k
  FROM (SELECT m.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM marked m) e
  ANTI JOIN (SELECT doc_id, unnest(g) AS p FROM gone) USING (doc_id, p) GROUP BY doc_id
)
SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM marked m LEFT JOIN kept USING (doc_id)
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


#: Linked sets differ little in size and share one of the least tenth of their shingles.
OP8_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM words)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), prefix AS MATERIALIZED (
  SELECT doc_id, h, n FROM (SELECT doc_id, h, n, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS k FROM shingles JOIN sizes USING (doc_id)) WHERE k <= n - CAST(ceil(n * 0.9) AS BIGINT) + 1
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn FROM prefix a JOIN prefix b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), links AS MATERIALIZED (
  SELECT a, b FROM pairs p JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND x.h = y.h
  GROUP BY a, b, an, bn HAVING 190 * count(*) >= 90 * (an + bn)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS r FROM edges UNION SELECT e.b, r.r FROM reach r JOIN edges e ON e.a = r.doc_id AND r.r < e.b
), least_id AS (
  SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(c, w.doc_id), w.doc_id) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""

def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = staged(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return mix_plan(sizes, size_col="size").select("doc_id", "size", "source_size", "target", "taken", F.to_json("draws").alias("draws"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


def _op3_sql() -> str:
    def hit(term: str) -> str:
        return f"CAST(regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])') AS INT)".replace("\\\\", "\\")

    fit = [(h, p, v) for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0]) - len(r[1]))]
    test = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"
    rule = " ".join(f"WHEN {test.format(h, p)} THEN '{h}{p}'" for h, p, _ in fit)
    verdict = " ".join(f"WHEN {test.format(h, p)} THEN '{v}'" for h, p, v in fit)
    strict, soft = (" + ".join(map(hit, x)) for x in (url_filter.STRICT, url_filter.SOFT))
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), hits AS (
  SELECT *, {strict} AS n_strict, {soft} AS n_soft FROM (SELECT *, lower(host || path) AS u FROM parts)
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM hits
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"))


def _op5_sql() -> str:
    owner = ",".join(map(str, sharding.lookup_table()))
    names = ",".join(f"'{s}'" for s in sharding.SHARDS)
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SIZE} AS INTEGER) AS slot FROM documents
)
SELECT doc_id, slot, [{names}][[{owner}][slot + 1] + 1] AS shard FROM placed
"""


def tokenizer() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the installed public vocabulary."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    ids = bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return bpe_decode(ids.select("doc_id", "ids"), ranks).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    media = read_media(pack_media(docs))
    return media.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.to_json(F.struct("codec", "duration", "packets", "keyframes")).alias("feature"),
    )


def op4_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(staged(mine_phrases(_table(spark, sf_dir, "documents")), "mined"))


#: Every phrase at every word, counted at once.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k))
), counts AS MATERIALIZED (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100
), cuts AS (
  SELECT lang, g, f, unnest(range(1, len(g))) AS cut FROM counts
), scored AS (
  SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, n, cut, CAST(1000 * CAST(c.f AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN counts y ON y.lang = c.lang AND y.g = c.g[cut + 1:] JOIN sizes s ON s.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, g[i:i + m - 1] AS g, max(f) AS longer FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM counts)) GROUP BY ALL
)
SELECT p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY score DESC, a DESC, encode(array_to_string(p.g, ' '))) AS rank, array_to_string(p.g, ' ') AS phrase, a, l, r, n, score
FROM lowest p LEFT JOIN inside i ON i.lang = p.lang AND i.g = p.g WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each document whose crc32(doc_id) ends in 0 repeats a block of its
    own words from some word on to its end.  Null ids are left as they are."""
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    g = F.expr("h div 10")
    docs = docs.withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("g", g)
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("flatten(array_repeat(slice(w, cast(a + 1 as int), p), cast(1 + (n - a) div p as int)))")
    text = F.array_join(F.slice(F.concat(F.expr("slice(w, 1, cast(a as int))"), tail), F.lit(1), F.col("n").cast("int")), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words at each distance; consecutive ones are stretches of a period.
OP13_SQL = r"""
WITH digits AS (
  SELECT DISTINCT doc_id, list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT) + 1, 1)) AS BIGINT)) AS d FROM documents
), hashed AS MATERIALIZED (
  SELECT doc_id, xor(4294967295, list_reduce(d, lambda c, b: list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295)) AS h FROM digits
), split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, h FROM documents JOIN hashed USING (doc_id)
), planned AS MATERIALIZED (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), words AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM planned
), place AS MATERIALIZED (
  SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM words
), equal AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM place a JOIN place b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n
), stretch AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal) GROUP BY doc_id, q, g
), runs AS MATERIALIZED (
  SELECT doc_id, s, len, min(q) AS q FROM stretch WHERE len >= greatest(24, 3 * q) GROUP BY doc_id, s, len
), best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min([s, len, q], [CAST(-floor(10000000000 * len / q) AS BIGINT), s, q]) AS b,
         string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k FROM place ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS "start", b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM words w LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_hilbert_search": op4_hilbert_search,
    "op5_sharding": op5_sharding,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_extract": op7_html_extract,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_media": op9_media,
    "op10_toxicity": op10_toxicity,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_license_scan": op12_license_scan,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op3_url_filter": _op3_sql(), "op5_sharding": _op5_sql(), "op8_ngram_jaccard": OP8_SQL, "op11_phrase_mining": OP11_SQL, "op13_periodic_runs": OP13_SQL}
