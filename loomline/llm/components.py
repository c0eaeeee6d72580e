"""Components of a graph of links, by hooking and contraction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomline.session import discard, materialize, materialize_some

ROWS_A_FILE = 200_000


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) with the components merged that ``links`` (src, dst) connect; smallest id names them.

    Works on components, not on ids: each picks its smallest neighbour if that is smaller, the picks are followed to their
    end by pointer jumping, and only links between different components stay. At least every second component that has
    a link goes in a round, so there are at most log2 rounds. Tables between rounds are as many files as their rows need.
    """
    src = labels.select(F.col("id").alias("src"), F.col("component").alias("u"))
    dst = labels.select(F.col("id").alias("dst"), F.col("component").alias("v"))
    edges, n = _packed(links.join(src, "src").join(dst, "dst").select("u", "v").filter("u <> v").distinct())
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        heads, _ = _packed(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), 2 * n)
        moving = True
        while moving:
            up = heads.select(F.col("u").alias("to"), F.col("to").alias("_next"))
            jumped = heads.join(up, "to").select("u", F.col("_next").alias("to"), (F.col("to") != F.col("_next")).alias("moved"))
            before = heads
            heads, moving = materialize_some(jumped.coalesce(_files(2 * n)), "heads", F.col("moved"))
            discard(before)
        heads = heads.select("u", "to")
        before = labels
        labels = materialize(labels.join(heads, F.col("component") == F.col("u"), "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        a, b = heads.select("u", F.col("to").alias("_u")), heads.select(F.col("u").alias("v"), F.col("to").alias("_v"))
        rest = edges.join(a, "u").join(b, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).filter("u <> v").distinct()
        old = edges
        edges, n = _packed(rest, n)
        discard(before, old, heads)
    discard(edges)
    return labels


def _files(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_A_FILE))


def _packed(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """The written table, in few files if it has ``most`` rows at most, and its number of rows."""
    seen = Observation()
    table = materialize((df if most is None else df.coalesce(_files(most))).observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    return table, seen.get["n"]
