"""Ordered and sequential plans against plain Python on small random data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomline.plans.ordered import group_rows, lag, lead, ordered_window, row_number, running, with_position
from loomline.streaming import stateful, steps

def calcs():
    return {"rn": row_number(), "n": group_rows(), "prev": lag(F.col("v")), "next": lead(F.col("v")),
            "total": running("sum", F.col("v")), "low": running("min", F.col("v")), "high": running("max", F.col("v")),
            "seen": running("count", F.col("v"))}


def expected(rows):
    groups = {}
    for k, at, v in rows:
        groups.setdefault(k, []).append((at, v))
    out = []
    for k, items in groups.items():
        items.sort()
        for i, (at, v) in enumerate(items):
            known = [x for _, x in items[: i + 1] if x is not None]
            out.append((k, at, v, i + 1, len(items), items[i - 1][1] if i else None,
                        items[i + 1][1] if i + 1 < len(items) else None, sum(known) if known else None,
                        min(known, default=None), max(known, default=None), len(known)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,hot_rows", [(1, 5), (2, 20), (3, 10**9)])
def test_ordered_window_hot_and_cold(spark, seed, hot_rows):
    rng = random.Random(seed)
    # one key holds about half of the rows, and NULL is a key
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    got = ordered_window(df, ["at"], calcs(), keys=["k"], hot_rows=hot_rows, partitions=5)
    assert got.columns == ["k", "at", "v", *calcs()]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected(rows)


def test_global_order_and_descending(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    up = with_position(df, ["x"], partitions=7).filter("pos <> x").count()
    down = with_position(df, [F.desc("x")], start=5, step=2, partitions=7).filter("pos <> 5 + 2 * (999 - x)").count()
    assert (up, down) == (0, 0)
    assert with_position(df.limit(0), ["x"]).count() == 0


def replay(rows, made, width):
    step, init = made
    states, out = {}, []
    for row in sorted(rows):
        key, _, *values = row
        start = list(init) if isinstance(init, list) else init
        states[key], result = step(states.get(key, start), tuple(values))
        out.append((*row, *result))
    return sorted(out, key=repr)


SECOND = 1_000_000


@pytest.mark.parametrize("kind,made,make", [
    ("state_transitions", steps.state_transitions([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], "a"), lambda r, t: (r.choice("abc"),)),
])
@pytest.mark.parametrize("chunk_rows", [9, 10_000])
def test_chunked_steps_equal_one_pass(spark, kind, made, make, chunk_rows):
    rng = random.Random(len(kind))
    clock, rows = 0, []
    for i in range(120):
        clock += rng.randint(1, 5) * SECOND
        rows.append((rng.choice(["hot", "hot", "hot", "x", "y"]), i, *make(rng, clock)))
    names = [f"in{i}" for i in range(len(rows[0]) - 2)]
    df = spark.createDataFrame(rows, ["k", "i", *names])
    got = stateful.run_steps(df, kind, ["k"], ["i"], names, made, chunk_rows=chunk_rows, hot_rows=30)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == replay(rows, made, len(names))
