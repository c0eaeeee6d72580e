"""Edge and node tables: ``edges(src, dst, w)``, ``nodes(id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_directions(edges: DataFrame) -> DataFrame:
    """Adjacency of an undirected graph: every edge and its reverse; a loop once."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)
    return edges.select("src", "dst", *others).unionByName(back)


def build_graph(edges: DataFrame, isolated: DataFrame | None = None, directed: bool = False,
                removed_nodes: DataFrame | None = None, removed_edges: DataFrame | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """(nodes, adjacency). Edges create their end nodes; parallel edges stay.

    A removed node takes its edges along; a removed edge goes in both directions
    when the graph is undirected.
    """
    if removed_edges is not None:
        gone = removed_edges if directed else both_directions(removed_edges)
        edges = edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if isolated is not None:
        ends = ends.unionByName(isolated.select("id"))
    nodes = ends.distinct()
    if removed_nodes is not None:
        gone = removed_nodes.select("id")
        nodes = nodes.join(gone, "id", "left_anti")
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return nodes, edges if directed else both_directions(edges)


def degrees(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Adjacency entries per node (out-degree when directed), 0 for isolated nodes."""
    counted = adjacency.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_distribution(degree: DataFrame) -> DataFrame:
    return degree.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def neighbors(adjacency: DataFrame, node) -> DataFrame:
    return adjacency.filter(F.col("src") == F.lit(node)).select(F.col("dst").alias("id"), "w")


def edge_weight(adjacency: DataFrame, src, dst) -> DataFrame:
    """Weights of the edges between two nodes; no row when there is none."""
    return adjacency.filter((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))).select("w")


def graph_summary(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """Node and edge counts, density and mean degree; 0 below two nodes."""
    n = nodes.agg(F.count(F.lit(1)).alias("n")).scalar()
    e = F.count(F.lit(1))
    most = n * (n - 1) if directed else n * (n - 1) / 2
    return edges.agg(e.alias("edge_count")).select(
        n.alias("node_count"), "edge_count",
        F.when(n < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.col("edge_count").cast("double"), most.cast("double")), F.lit(0.0))).alias("density"),
        F.coalesce(F.try_divide(F.col("edge_count") * 2.0, n.cast("double")), F.lit(0.0)).alias("avg_degree"))


def edge_list(adjacency: DataFrame) -> DataFrame:
    """Distinct edges as (smaller id, larger id, weight)."""
    return adjacency.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").distinct()


def adjacency_matrix(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Dense matrix in long form (src, dst, w), 0 where there is no edge.

    The n * n cells are the result itself; they are built by row number, evenly
    over the tasks. Parallel edges show their largest weight.
    """
    from loomline.operators.joins import product_slice
    grid = product_slice([(nodes.select(F.col("id").alias("src")), ["src"]), (nodes.select(F.col("id").alias("dst")), ["dst"])])
    weights = adjacency.groupBy("src", "dst").agg(F.max("w").alias("w"))
    return grid.join(weights, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"))
