"""Hostile, very long and awkward inputs, and second implementations to hold the operators against."""

import random
import struct
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexforge.llm import byte_bpe, html_extract, media, mixing, queries, sharding
from lexforge.llm.toxicity import toxicity
from lexforge.llm.url_filter import url_filter


def seconds(run):
    start = time.monotonic()
    run()
    return time.monotonic() - start


@pytest.mark.parametrize("piece", ["<a ", '<a "x', "<div>x", "<p>x", "<select>x", "<", "<!x", "<b>x", "<a ' > \""])
def test_a_megabyte_of_broken_markup(piece):
    w, a = html_extract.train()
    assert seconds(lambda: html_extract.main_text(piece * (1_000_000 // len(piece)), w, a)) < 20


def test_raw_tags_do_not_close_themselves():
    page = "<article><h1>Title here</h1><script src=/js/app/>var x = 1; </script><p>One sentence stands here.</p><script src='/a.js'/>more()</script><p>Another sentence ends it.</p></article>"
    assert [t for t, _ in html_extract.blocks(page)] == ["Title here", "One sentence stands here.", "Another sentence ends it."]


class Leaves(HTMLParser):
    """Leaf blocks of well-formed pages by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip = [], [], 0

    def close_block(self):
        flat = " ".join("".join(self.text).split())
        if flat:
            self.out.append(flat)
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_extract._RAW:
            self.skip += 1
        elif tag == "br":
            self.text.append(" ")
        elif tag not in html_extract._INLINE:
            self.close_block()

    def handle_endtag(self, tag):
        if tag in html_extract._RAW:
            self.skip -= 1
        elif tag not in html_extract._INLINE:
            self.close_block()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def test_blocks_against_the_standard_parser(spark):
    for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        other = Leaves()
        other.feed(x["html"] or "")
        other.close_block()
        assert [t for t, _ in html_extract.blocks(x["html"] or "")] == other.out


def test_html_rows(spark):
    long = "<article>" + "<p>A sentence of some words, which stands here.</p>" * 20000 + "</article>"
    rows = [(1, None, "u"), (2, "", "u"), (3, long, None), (3, long, None), (None, "<p", "u")]
    got = html_extract.html_extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(len(x.text) for x in got if x.page_id == 3) == [len("A sentence of some words, which stands here.") * 20000 + 2 * 19999] * 2
    assert [x.text for x in got if x.page_id in (1, 2)] == ["", ""] and len(got) == 5
    assert html_extract.html_extract(spark.createDataFrame([], "html string")).count() == 0


def test_long_pieces_fold_fast_and_right():
    ranks, _ = queries.tokenizer()
    rng = random.Random(3)

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                return [ranks[x] for x in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(60):
        piece = bytes(rng.choice(b"aabbccth e\xc3\xa9") for _ in range(rng.randint(1, 400)))
        assert byte_bpe.fold(piece, ranks) == ([ranks[piece]] if piece in ranks else slow(piece))
    assert seconds(lambda: byte_bpe.fold(b"a" * 1_000_000, ranks)) < 60


def test_bpe_rows(spark):
    ranks, pattern = queries.tokenizer()
    rows = [(1, None, "x"), (2, "", "x"), (3, "z" * 200_000 + " end", "x"), (3, "same", "x"), (None, "same", "x")]
    ids = byte_bpe.bpe_encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), ranks, pattern)
    got = byte_bpe.bpe_decode(ids, ranks).collect()
    assert sorted(bytes(x.decoded) for x in got) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.bpe_encode(spark.createDataFrame([], "text string"), ranks, pattern).count() == 0


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie(tracks):
    """A container with one track for each (sizes, keyframes or None, codec), samples in order."""
    total = sum(sum(s) for s, *_ in tracks)
    def made(start):
        out, at = b"", start
        for sizes, keys, codec in tracks:
            full = lambda kind, body: box(kind, b"\0\0\0\0" + body)
            stbl = full(b"stsd", struct.pack(">I", 1) + box(codec, bytes(28))) + full(b"stts", struct.pack(">III", 1, len(sizes), 10))
            stbl += full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)) + full(b"stsz", struct.pack(">II", 0, len(sizes)) + struct.pack(f">{len(sizes)}I", *sizes))
            stbl += full(b"stco", struct.pack(">II", 1, at))
            if keys is not None:
                stbl += full(b"stss", struct.pack(">I", len(keys)) + struct.pack(f">{len(keys)}I", *keys))
            at += sum(sizes)
            out += box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 10 * len(sizes), 0, 0)) + box(b"minf", box(b"stbl", stbl))))
        return box(b"moov", out)
    start = len(made(0)) + 8
    return made(start) + box(b"mdat", bytes(i % 251 for i in range(total)))


def test_tracks_are_kept_apart():
    raw = movie([([5] * 27, None, b"aaaa"), ([7] * 40, [1, 9, 17, 25], b"bbbb")])
    first, second = media.describe(raw), media.describe(raw, 1)
    assert (first["codec"], second["codec"]) == ("aaaa", "bbbb") and first["seconds"] == 2.7
    assert first["keys"].tolist() == list(range(27)) and second["keys"].tolist() == [0, 8, 16, 24]
    assert (first["offsets"] + first["sizes"]).tolist()[-1] == second["offsets"][0]
    data = raw[second["offsets"][0] :]
    assert b"".join(raw[a : a + n] for a, n in zip(second["offsets"], second["sizes"], strict=True)) == data


@pytest.mark.parametrize("kind", [b"stts", b"stsc", b"stsz", b"stco", b"stss"])
def test_hostile_counts_are_errors(spark, kind):
    raw = bytearray(media.pack(b"word " * 400))
    at = raw.index(kind) + 8 + (4 if kind == b"stsz" else 0)
    raw[at : at + 4] = struct.pack(">I", 4_000_000_000)
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    rows = [(1, bytes(raw)), (2, media.pack(b"ok")), (3, None), (4, b""), (5, deep), (6, b"\xff" * 50), (2, media.pack(b"ok"))]
    got = media.read_media(spark.createDataFrame(rows, "id long, media binary").withColumn("codec", F.lit("clash"))).collect()
    assert {x.id for x in got if x.media_error is None} == {2} and len(got) == 7
    assert all(bytes(x.payload) == media.pad(b"ok") for x in got if x.id == 2)


def test_media_empty_and_long(spark):
    assert media.pack_media(spark.createDataFrame([], "text string")).count() == 0
    text = "long text " * 300_000
    got = media.read_media(media.pack_media(spark.createDataFrame([(text, "clash")], "text string, media string"))).first()
    assert bytes(got.payload) == media.pad(text.encode()) and got.packets == len(media.pad(text.encode())) // 192


def mixed_by_hand(rows, seed, blocks, most=3, weights=(1, 2, 3)):
    """The mix in plain Python: words taken of each row."""

    def spark_hash(*values):
        h = 42
        for v, kind in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v), seed=h)
        return h - (1 << 64) if h >= 1 << 63 else h

    sources = {}
    for i, (doc, text, source) in enumerate(rows):
        size = len((text or "").split())
        block = spark_hash((seed, "i"), (doc, "l")) % blocks
        sources.setdefault(source, {}).setdefault(block, []).append((spark_hash((seed + 1, "i"), (doc, "l")), doc, size, i))
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(d[2] for b in sources[s].values() for d in b) for s in order]
    goal = mixing.targets(sizes, [weights[i % 3] for i in range(len(order))], most)
    taken = [0] * len(rows)
    for s, n, g in zip(order, sizes, goal, strict=True):
        quota = min(round(g), most * n)
        passes, left = (quota // n, quota % n) if n else (0, 0)
        for block in sorted(sources[s], key=lambda b: (spark_hash((seed, "i"), (passes, "i"), (s, "s"), (b, "i")), b)):
            for _, _, size, i in sorted(sources[s][block]):
                part = min(size, left)
                left -= part
                taken[i] = passes * size + part
    return taken


def test_mixing_against_plain_python(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 3, 40])), rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "e"), (1002, "big " * 5000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.taken for x in mixing.mix_plan(df, blocks=64).collect()}
    assert [got[d] for d, *_ in rows] == mixed_by_hand(rows, 7, 64)
    other = {x.doc_id: x.taken for x in mixing.mix_plan(df, blocks=64, seed=8).collect()}
    assert other != got and sum(other.values()) == sum(got.values())
    out = mixing.mix(df, blocks=64).withColumn("part", F.spark_partition_id())
    assert out.groupBy("shard").agg(F.countDistinct("part").alias("n")).filter("n <> 1").count() == 0
    monkeypatch.setattr(mixing, "splitting_tree", lambda held, shards, seed: np.zeros((shards, len(held)), np.int64))
    assert not any(x.taken for x in mixing.mix_plan(df, blocks=64).collect())


def test_sharding_rows(spark):
    rows = [(1,), (1,), (None,), (-5,), (1 << 40,)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long").withColumn("shard", F.lit("clash"))).collect()
    assert len(got) == 5 and {x.shard for x in got} <= set(sharding.SHARDS) and len({(x.doc_id, x.shard) for x in got}) == 4
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long")).count() == 0


def test_url_rows(spark):
    rows = [("http://a.fr/concours-gratuit",), ("http://a.fr/concours",), ("http://x.es/apuestas",), ("http://gratisbillig.de/",), ("HTTP://A.DE/Gewinnspiel/GRATIS",), (None,), ("",), ("http://" + "a" * 100_000 + "/casino",)]
    got = url_filter(spark.createDataFrame(rows, "url string").withColumn("host", F.lit("clash"))).collect()
    assert [x.verdict for x in got] == ["block", "allow", "block", "allow", "block", "allow", "allow", "block"]
    assert url_filter(spark.createDataFrame([], "url string")).count() == 0


def test_toxicity_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *(["vile", "hateful"] if i % 4 == 0 else [])]), "clash") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    odd = [(900, None, "x"), (901, "", "x"), (None, "vile hateful words", "x"), (902, "w1 " * 100_000 + "vile hateful", "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    got = toxicity(docs, labels).collect()
    assert len(got) == 405
    held = [x for x in got if x.held_out and x.doc_id < 400]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert np.mean([x.predicted == int(x.doc_id % 4 == 0) for x in held]) > 0.95
    assert {x.predicted for x in got if x.doc_id in (900, 901)} == {0} and len({x.score for x in got if x.doc_id == 5}) == 1
    assert sorted(map(str, got)) == sorted(map(str, toxicity(docs, labels).collect()))
    assert toxicity(docs.limit(0), labels).count() == 0 and {x.score for x in toxicity(docs, labels.limit(0)).collect()} == {0.0}
