"""Licence scans against a plain scan of words, planted notices and awkward rows."""

import random
import re

import pytest

from lexforge.llm.license_scan import BASE, TEMPLATES, license_scan, license_words
from lexforge.llm.queries import op12_license_scan

SCHEMA = "doc_id long, text string"
NOTICES = {
    "Released under the MIT License.": {"mit"},
    "Licensed under the Apache License, Version 2.0.": {"apache", "apache-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
    "This work is licensed under the GNU General Public License, version 2.": {"gpl", "gpl-2.0"},
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
    "CC BY and the\nMIT\tlicense": {"cc-by", "mit"},
}


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "license", "under", "cc", "by", "mit", "Größe", "a1", "is", "software", "été"]) if rng.random() < 0.3 else f"w{rng.randrange(500)}" for _ in range(n))


def test_base_and_planted_notices(spark, tmp_path):
    rng, rows, want = random.Random(4), [], {}
    for i in range(300):
        text, labels = prose(rng, rng.randrange(0, 200)), set()
        if i % 6 == 0:
            notice, labels = rng.choice(list(NOTICES.items()))
            text = f"{text}\n{notice} {prose(rng, 40)}"
        rows.append((i, text))
        want[i] = labels
    rows += [(300, None), (301, ""), (None, "MIT License"), (5, "cc by")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_license_scan(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *map(str, r[1:6])) for r in got) == sorted((i is None, i or 0, *map(str, plain(t))) for i, t in rows)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))
        if r.doc_id is not None and r.doc_id < 300 and r.doc_id != 5:
            assert set(filter(None, r.labels.split(","))) >= want[r.doc_id]
            if not want[r.doc_id]:
                assert r.labels == r.base_labels


@pytest.mark.parametrize("edits", [0, 3])
def test_templates_are_found_with_edits(spark, edits):
    """Every template in a text of its own, with some words changed away from its key phrases."""
    rng, rows = random.Random(7), []
    for i, (_, text, keys) in enumerate(TEMPLATES):
        words = [w for w in license_words(text) if w]
        held = {w for k in keys for w in k.split()}
        if len(words) > 30:
            for j in rng.sample([j for j, w in enumerate(words) if w not in held], edits):
                words[j] = "changed"
        rows.append((i, " ".join([*(f"x{rng.randrange(99)}" for _ in range(50)), *words, *(f"y{rng.randrange(99)}" for _ in range(50))])))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (label, text, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",") and any(m.label == label and 46 <= m.start <= 54 for m in got[i].matches)
    versions = {got[i].labels for i, t in enumerate(TEMPLATES) if t[0] == "gpl-2.0"}
    assert not any("gpl-3.0" in v for v in versions)


def test_awkward_rows(spark):
    """Very long texts of licence words, many copies of one notice, clashing columns, no rows."""
    df = spark.createDataFrame([(1, "license " * 200_000, "x"), (2, "Released under the MIT License. " * 3000, "x"), (3, "é" * 3_000_000, "x")], SCHEMA + ", labels string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert got[1].labels == "" and got[2].n_base == 3000 and got[2].last_word == 14998 and len(got[2].matches) == 3000 and got[3].n_words == 1
    assert license_scan(df.limit(0)).count() == 0
