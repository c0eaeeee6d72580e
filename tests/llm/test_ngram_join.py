from __future__ import annotations

import random

import numpy as np

from loomline.llm import ngram_join
from loomline.llm.queries import QUERIES
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(seed: int) -> list[tuple[int, str | None]]:
    """Families of copies with edits around the threshold, a passage that many share, exact copies and odd texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 400)
    passage = " ".join(word() for _ in range(40))
    rows: list[tuple[int, str | None]] = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 18)):
                own[rng.randrange(len(own))] = word()
            text = " ".join(own) + (" " + passage if rng.random() < 0.3 else "")
            rows.append((rng.randint(0, 10**6) * 100 + len(rows), text))
    rows += [(1, None), (2, ""), (3, " \t "), (4, "Two words"), (5, "two\nWORDS"), (6, "Ä b"), (7, "ä b"), (8, "a b c d e " * 3000), (9, "a b c d e")]
    rng.shuffle(rows)
    return rows


def test_small_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = brute.components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert components(QUERIES["op2_ngram_join"](spark, SF_DIR)) == want


def test_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1)  # so that the full comparison has work to do
    rows = near_copies(7)
    docs = spark.createDataFrame([(d, t, 1, "x", 0.5) for d, t in rows], SCHEMA + ", n int, key string, component_id double").repartition(3)
    assert components(ngram_join.ngram_jaccard_components(docs)) == brute.components(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y"), (9, None)], SCHEMA)
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_jaccard_components(docs).collect())
    assert rows == [("5", 2, "5"), ("5", 2, "5"), ("9", 0, "9"), ("None", 1, "None"), ("None", 2, "5")]
    assert ngram_join.ngram_jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_finds_what_comparison_finds():
    rng = random.Random(3)
    base = list(range(40))
    sets = []
    for i in range(80):
        own = sorted({x if rng.random() > 0.12 else rng.randint(40, 400) for x in base[rng.randint(0, 9):]})
        sets.append((i, len(own) + rng.randint(0, 2), own))
    tree = ngram_join.PrefixTree(sets)
    for i, n, own in sets:
        want = {j for j, m, other in sets for both in [len(set(own) & set(other))] if 100 * both >= 75 * (n + m - both)}
        assert set(tree.partners(own, n)) == want, i


def test_packed_numbers_return():
    values = np.array([0, 1, (1 << 48) - 1, 12345678901], np.uint64)
    assert (ngram_join._unpack(ngram_join._pack(values)) == values).all()
