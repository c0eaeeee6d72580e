"""Trees as ``links(parent, child, rank)``; ``rank`` orders the children of a node.

Everything but the paths comes from an Euler tour (``tours.py``): each node is an interval of the depth-first order, so
no node carries its ancestors and no job runs for a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph.tours import interval_folds, tree_tour
from loomline.plans.ordered import ordered_window, running
from loomline.session import discard, materialize, materialize_some


def tree_levels(links: DataFrame, root) -> DataFrame:
    """(node, parent, level, pre, size, leaves) of the tree below ``root``; ``pre`` is the place in depth-first order."""
    return tree_tour(links, root)


def tree_paths(tree: DataFrame, separator: str = "/") -> DataFrame:
    """(node, path): the ids from the root to the node as text, by pointer doubling: as many rounds as the level has bits.

    Paths are as long as levels are deep; ask for them only where they are wanted.
    """
    paths = tree.select("node", F.col("parent").alias("up"), F.col("node").cast("string").alias("path"))
    before, more = materialize_some(paths, "paths", F.col("up").isNotNull())
    while more:
        above = before.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("path").alias("_p"))
        longer = before.join(above, F.col("up") == F.col("_n"), "left").select(
            "node", F.col("_u").alias("up"), F.concat_ws(separator, "_p", "path").alias("path"))
        after, more = materialize_some(longer, "paths", F.col("up").isNotNull())
        discard(before)
        before = after
    return before.select("node", "path")


def subtree_counts(tree: DataFrame) -> DataFrame:
    """(node, nodes, leaves, depth): subtree size, its leaves, height above the deepest leaf."""
    deepest = interval_folds(tree.select("node", F.lit(0).alias("tree"), "pre", "size", F.col("level").alias("_most")), {"_most": "max"})
    return tree.join(deepest, "node").select("node", F.col("size").alias("nodes"), "leaves", (F.col("_most") - F.col("level")).alias("depth"))


def find_all(tree: DataFrame, condition: Column) -> DataFrame:
    return tree.filter(condition)


def find_first(tree: DataFrame, condition: Column) -> DataFrame:
    """The first matching node in depth-first order."""
    return tree.filter(condition).orderBy("pre").limit(1)


def topmost_matches(tree: DataFrame, condition: Column) -> DataFrame:
    """Matching nodes without a matching ancestor: those that no earlier match's interval reaches."""
    hits = materialize(tree.filter(condition), "hits")
    ends = ordered_window(hits, ["pre"], {"_end": running("max", F.col("pre") + F.col("size"))})
    # an interval that begins earlier and is still open holds the node; the largest end before it decides
    before = ends.select("*", (F.col("_end") > F.col("pre") + F.col("size")).alias("_inside"))
    return _without_covered(before)


def _without_covered(hits: DataFrame) -> DataFrame:
    """Nested intervals never cross, so a node is inside an earlier one just if the largest end so far is not its own,
    or if it ends together with one that begins before it."""
    same_end = hits.groupBy((F.col("pre") + F.col("size")).alias("_e")).agg(F.min("pre").alias("_first"))
    joined = hits.join(same_end, F.col("pre") + F.col("size") == F.col("_e"))
    return joined.filter((~F.col("_inside")) & (F.col("pre") == F.col("_first"))).drop("_end", "_inside", "_e", "_first")
