"""Benchmark decontamination against every window of every item at every place of every document."""

from __future__ import annotations

import hashlib
import random

import pytest

from loomline.llm import decontamination
from tests.llm import brute

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return brute.LICENSE_WORD.findall(brute.ascii_lower(text or ""))


def want_of(text, items, window=10):
    own, hit, held = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            for p in range(len(own) - size + 1):
                if own[p:p + size] == w[k:k + size]:
                    hit.update(range(p, p + size))
                    held |= {str(item)} if item is not None else set()
    return len(own), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)


def compare(spark, docs, items, **how):
    found = decontamination.digests(decontamination.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS), **how)).collect()
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found), key=repr)
    assert got == sorted(((d is None, d, *want_of(t, items, how.get("window", 10))) for d, t in docs), key=repr)
    return got


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    vocabulary = ["a", "b", "c", "über", "d4", "E"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 3, 6, 9, 10, 11, 25]))) for k in range(9)]
    items += [(9, None), (10, ""), (11, "?!"), (2, "another text of an item that has an id already and more words"), (None, text(12)), (12, items[5][1]), (12, items[5][1])]
    docs = [(k, text(rng.choice([0, 1, 2, 5, 30, 80]))) for k in range(25)]
    for k in range(25, 45):
        parts = [text(rng.randint(0, 15)), rng.choice(items)[1] or "", text(rng.randint(0, 9)), rng.choice(items)[1] or ""]
        docs.append((k, " ".join(parts)))
    docs += [(50, None), (51, ""), (None, items[8][1]), (None, items[8][1]), (52, items[8][1]), (52, items[8][1]), (52, "other text"), (53, (text(40) + " ") * 40)]
    return docs, items


def test_equals_brute_force(spark, made):
    found = compare(spark, *made)
    assert any(r[-1] for r in found) and not all(r[-1] for r in found)


def test_windows_of_other_lengths(spark, made):
    compare(spark, *made, window=4)
    compare(spark, *made, window=2)


def test_blocks_give_the_same(spark, made, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    compare(spark, *made)


def test_lower_containment_finds_changed_windows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "x " + item + " y"), (2, item.replace("ten", "zehn")), (3, item.replace("five", "fuenf")), (4, "ten nine eight seven six five four three two one")]
    both = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, item)], ITEMS)
    kept = lambda c: {r.doc_id for r in decontamination.contaminated(*both, containment=c).collect() if r.contaminated}
    assert kept(1.0) == {1} and kept(0.8) == {1, 2} and kept(0.6) == {1, 2, 3}
    spans = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in decontamination.contaminated(*both, containment=0.6).collect()}
    assert spans == {1: [(1, 10)], 2: [(0, 10)], 3: [(0, 10)], 4: []}


def test_nothing_and_clashing_names(spark):
    docs, items = spark.createDataFrame([(1, "a b c", "x", 2, 3, 4)], SCHEMA + ", own string, h int, n_words int, part int"), spark.createDataFrame([(1, "a b", 5)], ITEMS + ", own int")
    row = decontamination.contaminated(docs, items).first()
    assert (row.doc_id, row.n_words, row.n_hit, row["items"], row.contaminated) == (1, 3, 2, ["1"], True)
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    empty = decontamination.digests(decontamination.contaminated(docs, items.limit(0))).first()
    assert (empty.n_hit, empty.n_items, empty.items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
