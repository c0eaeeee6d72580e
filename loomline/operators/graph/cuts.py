"""Bridges, articulation points and minimum spanning forests.

Bridges and articulation points come from one exact pass over any spanning forest (Tarjan and Vishkin's): an Euler tour
gives preorder places and subtree intervals, folds over intervals give the lowest and highest place that the non-tree
edges of each subtree reach. Tree edges whose subtrees are linked from outside belong to one block; blocks are
connected components of that relation. All of it takes log-many rounds, however deep the forest is; no node or edge is
removed and re-tested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph.tours import forest_tour, interval_folds
from loomline.session import discard, materialize, materialize_some


def block_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, parent, bridge, block): one row per node of a spanning forest.

    ``block`` names the biconnected block of the tree edge above the node, and
    ``bridge`` tells whether that edge is a bridge; both are NULL at roots.
    """
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = materialize(pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies")), "pairs")
    chosen, labels = spanning_forest(pairs.withColumn("w", F.lit(0)))
    forest = forest_tour(chosen, labels.groupBy("component").agg(F.min("id").alias("node")).select("node"))

    side = forest.select("node", "parent", "pre", "size")
    a = side.select(F.col("node").alias("src"), F.col("parent").alias("_pa"), F.col("pre").alias("_a"), F.col("size").alias("_sa"))
    b = side.select(F.col("node").alias("dst"), F.col("parent").alias("_pb"), F.col("pre").alias("_b"), F.col("size").alias("_sb"))
    known = pairs.join(a, "src").join(b, "dst")
    is_tree = F.col("_pa").eqNullSafe(F.col("dst")) | F.col("_pb").eqNullSafe(F.col("src"))
    known = materialize(known.withColumn("tree", is_tree), "known")
    cross = known.filter("not tree")
    ends = cross.select(F.col("src").alias("node"), F.col("_b").alias("seen")).unionByName(
        cross.select(F.col("dst").alias("node"), F.col("_a").alias("seen")))
    ends = ends.groupBy("node").agg(F.min("seen").alias("_lo"), F.max("seen").alias("_hi"))
    own = forest.join(ends, "node", "left").select("node", "tree", "pre", "size", F.least("pre", "_lo").alias("low"), F.greatest("pre", "_hi").alias("high"))
    folded = interval_folds(materialize(own, "own"), {"low": "min", "high": "max"})
    reach = materialize(forest.join(folded, "node"), "reach")

    twins = known.filter("tree and copies > 1").select(
        F.when(F.col("_pb").eqNullSafe(F.col("src")), F.col("dst")).otherwise(F.col("src")).alias("node"), F.lit(True).alias("_twin"))
    closed = (F.col("low") >= F.col("pre")) & (F.col("high") < F.col("pre") + F.col("size"))
    marked = reach.join(twins, "node", "left").withColumn("bridge", F.when(
        F.col("parent").isNotNull(), closed & F.col("_twin").isNull()))

    mother = reach.select(F.col("node").alias("_m"), F.col("pre").alias("_mp"), F.col("size").alias("_ms"), F.col("parent").alias("_mm"))
    upward = reach.join(mother, F.col("parent") == F.col("_m")).filter(
        F.col("_mm").isNotNull() & ((F.col("low") < F.col("_mp")) | (F.col("high") >= F.col("_mp") + F.col("_ms"))))
    apart = (F.col("_a") + F.col("_sa") <= F.col("_b")) | (F.col("_b") + F.col("_sb") <= F.col("_a"))
    links = upward.select(F.col("node").alias("src"), F.col("_m").alias("dst")).unionByName(
        cross.filter(apart).select("src", "dst"))
    blocks = spanning_forest(links.withColumn("w", F.lit(0)))[1].select(F.col("id").alias("node"), "component")
    block = F.when(F.col("parent").isNotNull(), F.coalesce("component", "node"))
    found = marked.join(blocks, "node", "left").select("node", "parent", "bridge", block.alias("block"))
    alone = nodes.select(F.col("id").alias("node")).join(forest, "node", "left_anti")
    bare = ("parent", "bridge", "block")
    return found.unionByName(alone.select("node", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in bare]))


def bridges(forest: DataFrame) -> DataFrame:
    """(src, dst), src < dst, of the edges whose removal disconnects; a twin edge is none."""
    return forest.filter("bridge").select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))


def articulation_points(forest: DataFrame) -> DataFrame:
    """(id) of the nodes that lie in two or more blocks."""
    up = forest.filter("parent is not null")
    touching = up.select(F.col("node").alias("id"), "block").unionByName(up.select(F.col("parent").alias("id"), "block"))
    spread = touching.groupBy("id").agg(F.min("block").alias("_lo"), F.max("block").alias("_hi"))
    return spread.filter("_lo <> _hi").select("id")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of the minimum spanning forest; ties by (w, src, dst)."""
    return spanning_forest(edges)[0]


def _jumped(heads: DataFrame) -> DataFrame:
    up = heads.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
    return heads.join(up, F.col("p") == F.col("_c")).select("c", F.col("_p").alias("p"), (F.col("p") != F.col("_p")).alias("moved"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (src, dst, w) of ``edges``, ties by (w, src, dst), and the component (id, component) of each
    node that has an edge to another; a component is named by one of its nodes.

    Each round every component picks its lightest outgoing edge (a map-side
    combined minimum) and the picks merge by pointer jumping: at most log2(V)
    rounds. Between rounds only the lightest edge of each component pair is kept.
    """
    flat = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    best = F.min(F.struct("w", "src", "dst")).alias("e")
    work, more = materialize_some(flat.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(best), "mst")
    if not more:
        return flat.limit(0), flat.limit(0).select(F.col("src").alias("id"), F.col("src").alias("component"))
    label = work.select(F.col("a").alias("id")).unionByName(work.select(F.col("b").alias("id"))).distinct()
    label = materialize(label.select("id", F.col("id").alias("component")), "label")
    chosen = []
    while more:
        out = work.select(F.col("a").alias("c"), F.col("b").alias("o"), "e").unionByName(
            work.select(F.col("b").alias("c"), F.col("a").alias("o"), "e"))
        picks = materialize(out.groupBy("c").agg(F.min(F.struct("e", "o")).alias("x")).select("c", "x.e", F.col("x.o").alias("p")), "picks")
        chosen.append(picks.select("e.src", "e.dst", "e.w").distinct())
        # two components that pick each other: the smaller one is the root
        back = picks.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
        root = F.col("_p").eqNullSafe(F.col("c")) & (F.col("c") < F.col("p"))
        heads = picks.join(back, F.col("p") == F.col("_c")).select("c", F.when(root, F.col("c")).otherwise(F.col("p")).alias("p"))
        jumping = True
        while jumping:
            before = heads
            heads, jumping = materialize_some(_jumped(_jumped(heads)), "heads", F.col("moved"))
            discard(before)
        ha = heads.select(F.col("c").alias("a"), F.col("p").alias("_a"))
        hb = heads.select(F.col("c").alias("b"), F.col("p").alias("_b"))
        before = work, label, heads
        label = materialize(label.join(heads, F.col("component") == F.col("c"), "left").select("id", F.coalesce("p", "component").alias("component")), "label")
        merged = work.join(ha, "a").join(hb, "b").filter("_a <> _b")
        work, more = materialize_some(merged.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e")), "mst")
        discard(*before)
    return reduce(DataFrame.unionByName, chosen).distinct(), label
