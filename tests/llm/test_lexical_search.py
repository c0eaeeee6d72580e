"""Ranked search against the score of every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from loomline.llm import lexical_search
from tests.llm import brute

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [brute.ascii_lower(t) for t in TERM.findall(text or "")]


def want_of(docs, items, best):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    held = Counter(t for _, c in own for t in c)
    out = []
    for i, text in set(items):
        scored = []
        for d, c in own:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, times in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(i, text, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:best], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(25)] + ["Über", "don", "A1", "語"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "'", "\n", "_"]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 10, 60]))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, "w1 " * 5000), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (300, docs[7][1]), (301, docs[7][1]), (301, docs[7][1])]
    items = [(k, text(rng.choice([1, 5, 12, 30]))) for k in range(12)]
    items += [(20, None), (21, "?"), (22, "nowhere"), (23, items[0][1]), (0, "w1 w2"), (0, "w1 w2"), (None, "w3 w3 w4")]
    return docs, items


def rows(spark, docs, items, **how):
    found = lexical_search.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS), **how).collect()
    return sorted(((r.item_id, r.item_text, r["rank"], r.doc_id, r.score) for r in found), key=repr)


def test_equals_brute_force(spark, made):
    for best in (20, 3):
        assert rows(spark, *made, best=best) == want_of(*made, best)


def test_blocks_and_small_accumulators_give_the_same(spark, made, monkeypatch):
    want = rows(spark, *made)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 12)
    monkeypatch.setattr(lexical_search, "ACCUMULATOR_BYTES", 2000)
    assert rows(spark, *made) == want


def test_graph_adds_up_to_each_item(made):
    for items in ([Counter(t.encode() for t in terms(x)) for _, x in made[1]], [Counter({b"a": 1, b"b": 1, b"c": 2})] * 3 + [Counter({b"a": 1, b"b": 1, b"c": 1, b"d": 1})], []):
        plan = lexical_search.share(items)
        sums = [Counter({t: 1}) for t in plan.terms]
        for a, b in plan.pairs:
            sums.append(sums[a] + sums[b])
        for own, want in zip(plan.items, items):
            found = Counter()
            for k, times in own:
                for t, n in sums[k].items():
                    found[t] += n * times
            assert found == want
        used = Counter(k for own in plan.items for k, _ in own) + Counter(k for pair in plan.pairs for k in pair)
        assert all(used[k] for k in range(len(plan.terms), len(sums)))
        adds = sum(len(own) - 1 for own in plan.items if own) + len(plan.pairs)
        assert adds <= sum(len(own) - 1 for own in items if own)


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(1, 256))) + " ÀÉ Zz9_語-x"
    assert [t.decode() for t in lexical_search.terms_of(text.encode())] == terms(text)


def test_nothing(spark, made):
    docs, items = spark.createDataFrame(made[0], SCHEMA), spark.createDataFrame(made[1], ITEMS)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 1, 2, 3)], SCHEMA + ", id int, n int, score int")
    assert [tuple(r) for r in lexical_search.search(clash, spark.createDataFrame([(5, "a")], ITEMS)).select("item_id", "rank", "doc_id").collect()] == [(5, 1, 1)]
