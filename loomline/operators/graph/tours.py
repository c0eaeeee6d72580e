"""Euler tours: trees as linked lists, ranked by pointer doubling.

A tour passes every node of a tree when it enters it and when it leaves it. Each stop only knows the stop after it; a
round of pointer doubling adds to each stop's sums those of the stop it points to and lets it point twice as far, so a
list of n stops is ranked in log2(n) rounds, whatever the shape of the tree: a chain takes as many rounds as a star.
Places in the tour make every subtree an interval of the preorder, and folds over subtrees become folds over
intervals (``interval_folds``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomline.plans.ordered import lead, ordered_window
from loomline.session import discard, materialize, materialize_some

ROWS_A_FILE = 200_000
_FOLDS = {"min": F.min, "max": F.max}


def list_sums(stops: DataFrame, names: Sequence[str]) -> DataFrame:
    """``stops`` (id, next, values…) with each value summed from the stop to the end of its list, and ``last``, its end.

    Stops on a circle have no end; their ``last`` is NULL.
    """
    seen = Observation()
    before = materialize(stops.select("id", "next", F.col("id").alias("last"), *names).observe(seen, F.count(F.lit(1)).alias("n")), "tour")
    n = seen.get["n"]
    files, rounds, going = max(1, math.ceil(n / ROWS_A_FILE)), n.bit_length(), n > 0
    while going and rounds > 0:
        once = _doubled(before, names)
        # two doublings in one job: tables of few rows spend more on jobs than on joins
        after, going = materialize_some(_doubled(once, names).coalesce(files), "tour", F.col("next").isNotNull())
        discard(before)
        before, rounds = after, rounds - 2
    return before.select("id", F.when(F.col("next").isNull(), F.col("last")).alias("last"), *names)


def _doubled(stops: DataFrame, names: Sequence[str]) -> DataFrame:
    far = stops.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("last").alias("_last"), *[F.col(k).alias(f"_{k}") for k in names])
    return stops.join(far, F.col("next") == F.col("_id"), "left").select(
        "id", F.col("_next").alias("next"), F.coalesce("_last", "last").alias("last"), *[(F.col(k) + F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in names])


def tree_tour(links: DataFrame, root) -> DataFrame:
    """(node, parent, level, pre, size, leaves) of the tree below ``root``; ``links`` are (parent, child, rank).

    ``pre`` is the place in depth-first order (children by rank), so the subtree of a node is ``pre`` to
    ``pre + size - 1``; ``leaves`` counts its nodes without children. Nodes that the root does not reach are left out.
    """
    links = materialize(links.select("parent", "child", "rank"), "links")
    after = ordered_window(links, ["rank", "child"], {"after": lead(F.col("child"))}, keys=["parent"]).select("child", "parent", "after")
    firsts = links.groupBy(F.col("parent").alias("node")).agg(F.min_by("child", F.struct("rank", "child")).alias("first"))
    top = links.sparkSession.range(1).select(F.lit(root).cast(links.schema["child"].dataType).alias("node"))
    above = after.filter(F.col("child") != F.lit(root)).withColumnRenamed("child", "node")
    told = above.unionByName(top, allowMissingColumns=True).join(firsts, "node", "left")
    told = materialize(told.select("node", "parent", "after", "first"), "told")
    stop = lambda mark, name: F.concat(F.lit(mark), F.col(name).cast("string"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    stops = told.select(F.explode(F.array(
        F.struct(stop(">", "node").alias("id"), F.coalesce(stop(">", "first"), stop("<", "node")).alias("next"), one.alias("opened"), one.alias("open"), F.col("first").isNull().cast("bigint").alias("bare")),
        F.struct(stop("<", "node").alias("id"), F.coalesce(stop(">", "after"), stop("<", "parent")).alias("next"), none.alias("opened"), (-one).alias("open"), none.alias("bare")))).alias("s")).select("s.*")
    summed = list_sums(stops, ["opened", "open", "bare"])
    kept = summed.filter(F.col("last") == F.lit(f"<{root}"))
    side = lambda mark, k: kept.filter(F.col("id").startswith(mark)).select(
        F.expr("substring(id, 2)").alias("stop"), *[F.col(c).alias(f"{c}{k}") for c in ("opened", "open", "bare")])
    total = kept.agg(F.max("opened")).first()[0] or 0
    found = told.select("node", "parent", F.col("node").cast("string").alias("stop")).join(side(">", 0), "stop").join(side("<", 1), "stop")
    found = found.select("node", "parent", (-F.col("open0")).alias("level"), (F.lit(total) - F.col("opened0")).alias("pre"),
                         (F.col("opened0") - F.col("opened1")).alias("size"), (F.col("bare0") - F.col("bare1")).alias("leaves"))
    out = materialize(found, "tree")
    discard(links, told)
    return out


def forest_tour(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, parent, tree, pre, size) of a forest without directions: ``edges`` (src, dst), one of ``roots`` (node) in each tree.

    Every edge is passed once each way; what is passed first leads down, so the tour itself finds the parents. Places
    count from the end of the tour of a ``tree``: ``pre`` is where the node is left, and its subtree is left (and nothing
    else is) from ``pre`` to ``pre + size - 1``.
    """
    numbered = materialize(edges.select("src", "dst", F.monotonically_increasing_id().alias("k")), "edges")
    # leaving src by edge k is arc 4k, leaving dst is arc 4k + 1; 4k + 2 and 4k + 3 are the leave of a root by its first edge
    ends = numbered.select(F.col("src").alias("node"), F.col("dst").alias("to"), (4 * F.col("k")).alias("out"), (4 * F.col("k") + 1).alias("into")).unionByName(
        numbered.select(F.col("dst").alias("node"), F.col("src").alias("to"), (4 * F.col("k") + 1).alias("out"), (4 * F.col("k")).alias("into")))
    around = ordered_window(ends, ["out"], {"after": lead(F.col("out"))}, keys=["node"])
    first = ends.groupBy("node").agg(F.min("out").alias("first"))
    tops = roots.select("node", F.lit(True).alias("top"))
    around = materialize(around.join(first, "node").join(tops, "node", "left"), "around")
    leave = F.col("first") + 2
    arrive = F.struct(F.col("into").alias("id"), F.coalesce("after", F.when(F.col("top"), leave).otherwise(F.col("first"))).alias("next"), F.lit(1).cast("bigint").alias("left"))
    finish = F.when(F.col("top") & (F.col("out") == F.col("first")), F.struct(leave.alias("id"), F.lit(None).cast("bigint").alias("next"), F.lit(1).cast("bigint").alias("left")))
    summed = list_sums(around.select(F.explode(F.array_compact(F.array(arrive, finish))).alias("s")).select("s.*"), ["left"])
    arcs = around.select(F.col("out").alias("id"), "node", "to").join(summed, "id")
    both = arcs.groupBy(F.floor(F.col("id") / 4).alias("k"), F.col("last").alias("tree")).agg(
        F.max_by(F.struct("node", "to"), "left").alias("down"), F.max("left").alias("a"), F.min("left").alias("z"))
    child = both.select(F.col("down.to").alias("node"), F.col("down.node").alias("parent"), "tree", F.col("z").alias("pre"), (F.col("a") - F.col("z") + 1).alias("size"))
    # a root is left at the last place, and entered before the first arc
    longest = summed.groupBy(F.col("last").alias("tree")).agg(F.max("left").alias("a"))
    begin = around.filter(F.col("top") & (F.col("out") == F.col("first"))).select("node", leave.alias("tree")).join(longest, "tree")
    top = begin.select("node", F.lit(None).cast(child.schema["parent"].dataType).alias("parent"), "tree", F.lit(1).cast("bigint").alias("pre"), F.col("a").alias("size"))
    out = materialize(child.unionByName(top), "forest")
    discard(numbered, around)
    return out


def interval_folds(tree: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(node, column…): each column's ``min`` or ``max`` over the subtree of each node of ``tree`` (node, tree, pre, size, …).

    A table of folds over the stretches [i * 2^k, (i + 1) * 2^k) of the preorder, one row for each that has a node;
    an interval is made up of at most two of them for each k. Two exchanges, no rounds.
    """
    most = tree.agg(F.max(F.col("pre") + F.col("size"))).first()[0] or 0
    powers = F.array(*[F.lit(k) for k in range(max(1, int(most).bit_length()))])
    spread = tree.select("tree", "pre", *columns, F.explode(powers).alias("k"))
    table = spread.groupBy("tree", "k", F.expr("shiftright(pre, k)").alias("i")).agg(*[_FOLDS[kind](c).alias(c) for c, kind in columns.items()])
    end = F.col("pre") + F.col("size")

    def stretches(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k).cast("bigint")
        low, high = F.floor((F.col("pre") + width - 1) / width).cast("bigint"), F.floor(end / width).cast("bigint")
        piece = lambda i: F.struct(k.alias("k"), i.alias("i"))
        return F.array(F.when((low < high) & (low % 2 == 1), piece(low)), F.when((low < high) & (high % 2 == 1), piece(high - 1)))

    asked = tree.select("node", "tree", F.explode(F.array_compact(F.flatten(F.transform(powers, stretches)))).alias("s")).select("node", "tree", "s.k", "s.i")
    return asked.join(table, ["tree", "k", "i"]).groupBy("node").agg(*[_FOLDS[kind](c).alias(c) for c, kind in columns.items()])
