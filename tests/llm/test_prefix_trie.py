"""The conversation trie against a trie of plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loomline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [r[3:] for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, w in built.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    sums = defaultdict(lambda: [0, 0])
    for path, held in members.items():
        saved = (len(held) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            sums[path[:d]][0] += not children[path]
            sums[path[:d]][1] += saved
    return sorted((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(children[path]), *sums[path],
                   hashlib.sha256(",".join(str(c) for c in sorted(held) if len(built[c]) == len(path)).encode()).hexdigest())
                  for path, held in members.items())


def compare(spark, rows, **how):
    found = sorted(tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), **how).collect())
    assert found == brute_nodes(rows)
    return found


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    rows = []
    for c in [*range(100, 130), *range(200, 220), 505, 7, -3, -101, 10**12 + 5]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "", None, "über 😀"])))
    rows += [(300, None, "user", "first"), (300, 4, "user", "x"), (300, 4, "user", "x"), (300, 4, None, "a"), (None, 1, "user", "lost"), (301, 1, "a", "bc"), (302, 1, "ab", "c")]
    long = [("user", f"t{k}") for k in range(26)]
    for c in (400, 401, 402):
        rows += [(c, k, r, t) for k, (r, t) in enumerate(long[: 26 if c < 402 else 19])] + ([(402, 50, "user", "other")] if c == 402 else [])
    rows += [(c, 0, "user", "the very same") for c in range(1000, 1400)]
    return rows


def test_equals_brute_force(spark, made):
    found = compare(spark, made)
    assert any(r[6] for r in found) and max(r[1] for r in found) > 20


def test_other_widths_and_chunks_give_the_same(spark, made, monkeypatch):
    compare(spark, made, width=3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    compare(spark, made, width=16)


def test_nothing_turnless_and_clashing_names(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # 101 takes its head from a conversation that is absent, and its own only turn is within that head: nothing is left
    assert zlib.crc32(b"101") % 6 > 0
    assert [r[:5] for r in compare(spark, [(101, 0, "user", "x")])] == [(101, 0, None, 1, 0)]
    named = spark.createDataFrame([(100, 0, "user", "x", 1, 2, 3)], SCHEMA + ", c int, p int, top int")
    assert sorted(tuple(r)[:5] for r in prefix_trie.conversation_trie(named).collect())[0] == (100, 0, None, 1, 1)


def test_chains_of_single_conversations_take_no_rounds(spark, monkeypatch):
    rounds = []
    rollup = prefix_trie._rollup
    monkeypatch.setattr(prefix_trie, "_rollup", lambda *a: rounds.append(1) or rollup(*a))
    found = compare(spark, [(c, k, "user", f"{c} {k}") for c in (100, 200) for k in range(500)])
    assert len(rounds) == 2 and len(found) == 1001
