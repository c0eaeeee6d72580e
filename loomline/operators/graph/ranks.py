"""PageRank, closeness, betweenness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.graph.traverse import bfs_levels
from loomline.session import discard, materialize, materialize_some, shuffle_width

#: Ends in one list of a node's edges.
CHUNK = 4096


def pagerank(nodes: DataFrame, adjacency: DataFrame, damping: float = 0.85, iterations: int = 100,
             write_every: int = 5) -> DataFrame:
    """(id, rank). Rank of nodes without out-edges is lost; parallel edges count in
    the out-degree but pass rank once.

    A node's edges are lists of at most ``CHUNK`` ends, cached hash-partitioned and sorted by source node, the layout in
    which each round's sums arrive: a round joins a row for each list, sorts no edges and shuffles only its map-side
    combined sums. Lineage is cut every few rounds.
    """
    nodes = materialize(nodes.select("id"), "nodes")
    n = nodes.count()
    if n == 0 or iterations < 1:
        return nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    width = shuffle_width(nodes.sparkSession)
    # rows of one partition in the order of src: numbers within it cut the edges of a node into lists of bounded length
    pairs = adjacency.filter("src IS NOT NULL").repartition(width, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.sortWithinPartitions("src").select("src", F.struct("dst").alias("to"), "n", F.floor(F.monotonically_increasing_id() / CHUNK).alias("chunk"))
    lists = pairs.groupBy("src", "chunk").agg(F.collect_list("to").alias("ends"), F.sum("n").alias("n"))
    lists = lists.select("src", "ends", (F.lit(damping) / F.sum("n").over(Window.partitionBy("src"))).alias("share"))
    stored = materialize(lists, "shares")
    shares = stored.repartition(width, "src").sortWithinPartitions("src").persist()
    base = nodes.select("id", F.lit((1 - damping) / n).alias("part"))
    ranks, written = nodes.select("id", F.lit(1.0 / n).alias("rank")), None
    for turn in range(1, iterations + 1):
        passed = ranks.join(shares, ranks["id"] == shares["src"]).select(
            F.explode("ends").alias("to"), (F.col("rank") * F.col("share")).alias("part")).select(F.col("to.dst").alias("id"), "part")
        ranks = passed.unionByName(base).groupBy("id").agg(F.sum("part").alias("rank"))
        if turn % write_every == 0 or turn == iterations:
            last, ranks = written, materialize(ranks, "ranks")
            written = ranks
            if last is not None:
                discard(last)
    shares.unpersist()
    discard(stored, nodes)
    return ranks


def closeness_centrality(adjacency: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, closeness): reached nodes / sum of hop distances; 0 when nothing is reached."""
    reach = bfs_levels(adjacency, sources)
    return reach.groupBy(F.col("source").alias("id")).agg(
        F.coalesce(F.try_divide((F.count(F.lit(1)) - 1).cast("double"), F.sum("level").cast("double")), F.lit(0.0)).alias("closeness"))


def betweenness_centrality(nodes: DataFrame, adjacency: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness), divided by (n-1)(n-2).

    Shortest-path counts go forward level by level, dependencies come back level
    by level, for all sources at once (rows keyed by source).
    """
    nodes = materialize(nodes.select("id"), "nodes")
    n = nodes.count()
    hops = materialize(adjacency.select("src", "dst").filter("src <> dst").distinct(), "hops")
    starts = nodes if sources is None else sources
    frontier = materialize(starts.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("sigma")), "sigma")
    levels = [frontier]
    while True:
        seen = reduce(DataFrame.unionByName, [x.select("source", "node") for x in levels])
        step = frontier.withColumnRenamed("node", "src").join(hops, "src")
        found = step.groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        frontier, more = materialize_some(found.join(seen, ["source", "node"], "left_anti"), "sigma")
        if not more:
            break
        levels.append(frontier)
    deeper = levels[-1].withColumn("delta", F.lit(0.0))
    parts = [deeper]
    for upper in reversed(levels[:-1]):
        below = deeper.select("source", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("pull"))
        pulls = hops.join(below, "dst").groupBy("source", F.col("src").alias("node")).agg(F.sum("pull").alias("pull"))
        joined = upper.join(pulls, ["source", "node"], "left")
        deeper = materialize(joined.select("source", "node", "sigma", (F.col("sigma") * F.coalesce("pull", F.lit(0.0))).alias("delta")), "delta")
        parts.append(deeper)
    total = reduce(DataFrame.unionByName, parts).filter("source <> node").groupBy(F.col("node").alias("id")).agg(F.sum("delta").alias("_b"))
    scale = float((n - 1) * (n - 2))
    value = F.coalesce(F.col("_b") / scale, F.lit(0.0)) if n > 2 else F.lit(0.0)
    return nodes.join(total, "id", "left").select("id", value.alias("betweenness"))
