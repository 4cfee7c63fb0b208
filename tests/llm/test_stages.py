"""Stages of the pipeline against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lexforge.llm import ngram_jaccard
from lexforge.llm.toxicity import toxicity


def test_near_copies_of_the_stage(spark):
    rng = random.Random(11)
    rows, planted = [], 0
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(100)]
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            other = list(words)
            for at in rng.sample(range(5, 95, 6), k):
                other[at] = f"new{i}x{k}x{at}"
            rows.append((10 * i + k, " ".join(other)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (None, rows[0][1])]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in rows if d is not None and (w := (t or "").lower().split())}
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b:
                same = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                planted += 0.8 <= same < 0.9
                if same >= 0.8:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    got = corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept = sorted(d for d in root if find(d) == d)
    assert planted >= 60 and len(got) == len(kept) + 1
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == kept


def test_copies_count_once_in_a_cell(spark, monkeypatch):
    """Many equal copies neither add to a cell nor to its checksum."""
    text = [f"w{j}" for j in range(60)]
    near = [*text[:59], "other"]
    rows = [(i, " ".join(text)) for i in range(50)] + [(100 + i, " ".join(near)) for i in range(50)] + [(None, " ".join(text))]
    seen = []
    real = ngram_jaccard.different_cells

    def spy(routed):
        seen.append(routed.groupBy("cell").count().agg(F.max("count")).first()[0])
        return real(routed)

    monkeypatch.setattr(ngram_jaccard, "different_cells", spy)
    got = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert seen == [2] and {x.component_id for x in got} == {0} and len(got) == len(rows)


def test_checksums_of_large_cells(spark):
    """More nodes than 63 bits hold 42-bit hashes of, and cells that differ in one inner node."""
    n = 4_500_000
    large = spark.range(n).select(F.lit(1).cast("long").alias("cell"), F.col("id").alias("node"))
    small = spark.createDataFrame([(c, x) for c, own in ((2, (1, 5, 9)), (3, (1, 5, 9)), (4, (1, 6, 9)), (5, (7,))) for x in own], "cell long, node long")
    got = sorted((x.cell, x.hub) for x in ngram_jaccard.different_cells(large.unionByName(small)).collect())
    assert got == [(1, 0), (2, 1), (4, 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus(n=120):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 90])))
        if i % 9 == 0:
            text += " " + passage
        if i % 6 == 5:
            text += " vile hateful slur"
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
    copies = [(200 + i, rows[i][1], "en", "b", rows[i][4]) for i in (1, 2, 3)]
    odd = [(300, None, "en", "a", None), (301, "", None, "a", 0), (None, "no id here", "en", "c", 10), (3, "another text of id three", "en", "a", 24)]
    return rows + copies + odd


def key(rows):
    return sorted(map(str, rows))


def test_toxicity_stage(spark, tmp_path):
    rows = [r for r in small_corpus(200) if r[0] not in range(200, 204)] + [(400 + i, *r[1:]) for i, r in enumerate(small_corpus(900))]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    toxic = [r for r in rows if r[1] and "vile" in r[1]]
    spark.createDataFrame([(r[0], int(r in toxic)) for r in rows if r[0] is not None and r[1]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {str(tuple(x)) for x in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert all(str(r) in kept for r in rows if r not in toxic)
    assert sum(str(r) in kept for r in toxic) <= 0.05 * len(toxic)


def test_substring_stage(spark):
    rows = [r for r in small_corpus() if r[:2] != (3, "another text of id three")]
    seen, want = set(), []
    for doc, text, lang, source, n in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - 19 if doc is not None else 0):
            run = tuple(words[i : i + 20])
            if run in seen:
                gone |= set(range(i, i + 20))
            seen.add(run)
        kept = None if text is None else " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, kept, lang, source, None if kept is None else len(kept)))
    got = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert key(tuple(x) for x in got) == key(want) and any(w[4] != r[4] for w, r in zip(want, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True))


def test_mixing_stage(spark):
    from test_hostile import mixed_by_hand

    rows = [r for r in small_corpus() if r[0] is not None]
    want = []
    for (doc, text, lang, source, _), taken in zip(rows, mixed_by_hand([(r[0], r[1], r[3]) for r in rows], 7, 1024), strict=True):
        words = (text or "").split()
        while taken > 0:
            part = text if taken >= len(words) else " ".join(words[:taken])
            want.append((doc, part, lang, source, len(part)))
            taken -= len(words)
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert key(tuple(x) for x in got) == key(want)


def test_encoding_stage(spark):
    import hashlib

    import public_tokenizers
    import tiktoken

    from lexforge.llm.byte_bpe import load_ranks

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = small_corpus()
    got = corpus_pipeline.encode(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = []
    for doc, text, _, source, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, source, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256((text or "").encode()).hexdigest()))
    assert key((x.doc_id, x.source, x.n_tokens, bytes(x.ids), x.decoded_sha256) for x in got) == key(want)


def test_empty_stages_and_reruns(spark, tmp_path):
    docs = spark.createDataFrame(small_corpus(), SCHEMA)
    empty = docs.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 5)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    first, again = (corpus_pipeline.run(spark, str(tmp_path)).collect() for _ in range(2))
    assert key(first) == key(again) and first


def test_toxicity_keeps_its_texts_off_the_driver(spark, monkeypatch):
    """What comes to the driver is the model, not the words of the rows that it is fitted on."""
    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(500)) + (" vile" if i % 3 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kind, came = type(frame), []

    def noted(f):
        def call(self, *args, **more):
            out = f(self, *args, **more)
            came.append(out.nbytes if hasattr(out, "nbytes") else sum(len(x) if isinstance(x, (bytes, bytearray)) else 8 for row in out for x in row))
            return out

        return call

    for name in ("collect", "toArrow"):
        monkeypatch.setattr(kind, name, noted(getattr(kind, name)))
    scored = toxicity(frame, labels)
    monkeypatch.undo()
    assert 0 < sum(came) < sum(len(t) for _, t in docs) // 10
    assert {x.doc_id for x in scored.filter("predicted = 1").collect()} == {i for i, _ in docs if i % 3 == 0}
