from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from loomline.llm import fingerprints, licenses, quality, sharding
from loomline.llm.queries import QUERIES
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    (3, None), (1, ""), (2, " \t\n"), (9, "one two three"), (8, "a b c a b c a b c"), (7, "x\nx\n \nx y"), (10, "All rights  RESERVED. cc-by, CC BY cc by"),
    (12, "GNU General Public License\nAll rights reserved"), (11, "all rights reserved all rights reserved"), (20, "é" * 50 + " 😀 word. Next! " * 400),
    (21, "a b c d " * 6000), (22, None), (23, "same text here"), (24, "same text here"), (None, "no id"), (30, "Released under the MIT License."),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in ODD], SCHEMA + ", kept string, shard int, labels int, _end int")


def by_id(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_quality_equals_brute_force(spark, rows, odd):
    for found, want in ((by_id(QUERIES["op3_quality_rules"](spark, SF_DIR)), rows), (by_id(quality.quality_rules(odd)), ODD)):
        assert len(found) == len(want)
        for d, t in want:
            assert {k: found[d][k] for k in brute.quality(t)} == brute.quality(t), d


def test_quality_keeps_good_and_rejects_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    found = by_id(QUERIES["op3_quality_rules"](spark, SF_DIR))
    for d, good in labels.items():
        row = found[d]
        assert row["base_failed"] or row["kept"] == bool(good), d


def test_quality_of_nothing(spark):
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def check_licenses(found, want):
    """Labels and scores against every window of every text; returns the labels that the templates gave."""
    counts = Counter(w for _, t in want for w in brute.LICENSE_WORD.findall(brute.ascii_lower(t or "")))
    rarest = {k: min(set(v.split()), key=lambda w: (counts[w], w)) for k, v in licenses.TEMPLATES.items()}
    given = Counter()
    assert len(found) == len(want)
    for d, t in want:
        base = brute.license_base(t)
        assert {k: found[d][k] for k in base} == base, d
        words, hits = brute.LICENSE_WORD.findall(brute.ascii_lower(t or "")), {}
        for label, template in licenses.TEMPLATES.items():
            own, n = set(template.split()), len(template.split())
            shares = [len(own & set(words[i:i + n])) / len(own) for i in range(len(words)) if rarest[label] in words[i:i + n]]
            if max(shares, default=0) >= licenses.THRESHOLD - 1e-12:
                hits[label] = max(shares)
        given.update(hits)
        assert set(filter(None, found[d]["labels"].split(","))) == set(hits) | set(filter(None, base["base_labels"].split(","))), t
        assert found[d]["score"] == max([1.0 if base["n_base"] else 0.0, *hits.values()]), t
        if "blocks" in found[d]:
            for b in found[d]["blocks"]:
                n = len(licenses.TEMPLATES[b.label].split())
                assert b.text == " ".join(words[b["at"]:b["at"] + n]) and b.share >= licenses.THRESHOLD - 1e-12
    return given


def test_licenses_equal_brute_force(spark, rows, odd):
    check_licenses(by_id(QUERIES["op8_license_scans"](spark, SF_DIR)), rows)
    check_licenses(by_id(licenses.license_scan(odd)), ODD)
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_notices_wrapped_over_lines(spark):
    rng = random.Random(4)
    mit = "Permission is hereby granted, free of charge, to any person obtaining\n// a copy of this software and associated documentation files, to deal\n// in the Software without restriction"
    far = "MIT began here. The license office was old. " + "other words " * 450 + "released under the sea."
    texts = ["Head.\n\n// " + mit + ".\nTail.", "Released under\nthe\nMIT License", "released\n" + "other words " * 3 + "\nunder the\nlicense", "Released under the MIT License.\nx", far, "released under the old license"]
    for _ in range(60):
        words = " ".join(rng.sample(sorted(licenses.TEMPLATES.values()), 2)).split()
        words = [w for w in words if rng.random() > 0.1]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n * ", " the "]) for w in words))
    found = by_id(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)))
    given = check_licenses(found, list(enumerate(texts)))
    assert [found[k]["labels"] for k in range(6)] == ["mit-text", "mit-notice", "", "mit-notice", "", ""]
    assert sum(given.values()) > 40 and len(given) > 5


def test_license_blocks_without_the_rarest_word_are_listed(spark):
    texts = ["mit mit", "released under the old license", "Released under the MIT license", "under the old sea", "released license " * 3]
    found = by_id(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates={"mit": "released under the mit license"}))
    blocks = {(d, b["at"], b.share, b.rarest) for d in found for b in found[d]["blocks"]}
    assert {(1, 0, 0.8, False), (2, 0, 1.0, True)} <= blocks and {d for d, *_ in blocks} == {1, 2}
    assert [found[d]["labels"] for d in range(5)] == ["", "", "mit", "", ""]
    check_licenses(found := by_id(licenses.license_scan(docs := spark.createDataFrame(list(enumerate(texts)), SCHEMA))), list(enumerate(texts)))
    assert [found[d]["labels"] for d in found] == [r.labels for r in sorted(licenses.license_scan(docs, common=False).collect(), key=lambda r: r.doc_id)]


def test_the_query_lists_blocks_without_the_rarest_word(spark, tmp_path, monkeypatch):
    scanned, plain = [], licenses.license_scan
    monkeypatch.setattr(licenses, "license_scan", lambda *a, **k: scanned.append(plain(*a, **k)) or scanned[-1])
    texts = ["released under the old license"] * 3 + ["Released under the MIT license"]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = by_id(QUERIES["op8_license_scans"](spark, str(tmp_path)))
    blocks = {(r.doc_id, b["at"], b.label, b.share, b.rarest) for r in scanned[0].collect() for b in r.blocks}
    assert blocks == {(d, 0, "mit-notice", 0.8, False) for d in range(3)} | {(3, 0, "mit-notice", 1.0, True), (3, 1, "mit-notice", 0.8, True)}
    assert [found[d]["labels"] for d in range(4)] == ["", "", "", "mit-notice"]
    check_licenses(found, list(enumerate(texts)))


def test_clashing_names_and_filters_on_results(spark):
    names = ["doc_id", "text", "measures", "_measures", "scan", "_m", "_text", "_base", "_blocks", "_n_words", "Kept `x`"]
    docs = spark.createDataFrame([(1, "Released under the MIT License. " * 20, *range(9))], names)
    for judged, test in ((quality.quality_rules(docs), "NOT kept"), (licenses.license_scan(docs), "labels = 'mit-notice'")):
        row = judged.filter(test).first()
        assert row is not None and [row[c] for c in names[2:]] == list(range(9))


def test_a_filter_on_the_verdict_does_not_repeat_the_measures(spark, odd):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = odd.select("doc_id", "text")
    judged = quality.quality_rules(docs)
    assert plan(judged.filter("kept")).count("xxhash64") == plan(judged).count("xxhash64") == 1
    scanned = licenses.license_scan(docs)
    assert plan(scanned.filter("labels <> '' AND score > 0.5")).count("array_contains") == plan(scanned).count("array_contains") > 0


def test_stop_words_are_asked_of_latin_texts_only(spark):
    texts = [" ".join(f"{w}{k}" for k in range(80)) for w in ("слово", "λέξη", "كلمة", "word")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert kept == {0: True, 1: True, 2: True, 3: False}


def check_shards(found, want, shards):
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, len((t or "").encode()) + (1)) for d, t in want)
    slots, places = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        places[bytes(r.digest)].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in places.values())
    first, size = {}, Counter()
    for d, t in want:
        first[t] = min(first.get(t, (1, 1 << 62)), (0, 0) if d is None else (1, d))
        size[t] += len((t or "").encode()) + 1
    sizes = [size[t] for t in sorted(first, key=lambda t: first[t])]
    totals = Counter()
    for r in found:
        totals[r.shard] += r.size
    assert max(totals.values()) == brute.least_capacity(sizes, shards)
    assert set(totals) <= set(range(shards))


def test_shards_are_minimax(spark, rows, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check_shards(sharding.shard_documents(docs).collect(), rows, 8)
    for shards in (1, 2, 8):
        check_shards(sharding.shard_documents(odd, shards).collect(), ODD, shards)
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuts_stay_exact_with_few_bins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 16)
    rng = random.Random(5)
    for shards in (3, 8):
        sizes = [rng.choice([1, 2, 3, 50, 1000]) * rng.randint(1, 40) for _ in range(700)]
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append((at,))
        cuts = sharding.minimax_cuts(spark.createDataFrame(ends, "_end long"), shards)
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == brute.least_capacity(sizes, shards)
        assert set(cuts) <= {e for e, in ends}


def test_fingerprints(spark, rows, odd):
    found = by_id(QUERIES["op7_fingerprints"](spark, SF_DIR))
    want = brute.edited(rows)
    assert {d: (r["n_chars"], r["edited_sha256"]) for d, r in found.items()} == want
    texts = dict(rows)
    prints = {}
    for d, r in found.items():
        assert prints.setdefault(texts[d], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(prints.values())) == len(prints)
    mean = lambda k: sum(r[k] for r in found.values()) / len(found)
    assert mean("near_edited") > 0.35 and mean("near_next") < 0.15
    odd_found = fingerprints.digests(fingerprints.near_neighbours(odd)).collect()
    assert len(odd_found) == len(ODD)
    known = [(d, t) for d, t in ODD if d is not None]
    after_null = brute.edited([(-1, "no id"), *known])
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in odd_found if r.doc_id is not None} == {d: v for d, v in after_null.items() if d != -1}
    assert fingerprints.near_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprints.digests(fingerprints.near_neighbours(spark.createDataFrame([(1, "abcd")], SCHEMA))).first()
    assert one.near_next == 1.0


def test_fingerprints_add_and_ignore_order(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a b\nc d", "e f.", "e f.\na b\nc d")], "x string, y string, z string")
    x, y, z = (fingerprints.vector(F.col(c)) for c in "xyz")
    row = df.select((fingerprints.combine(x, y) == z).alias("sum"), (fingerprints.combine(z, y, -1) == x).alias("rest")).first()
    assert row["sum"] and row["rest"]
