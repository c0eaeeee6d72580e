"""Registered queries: graphs and trees derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.catalog.registry import query
from loomline.operators.graph import cuts, dag, edges as ge, ranks, traverse, trees
from loomline.plans.ordered import lag, ordered_window, row_number
from loomline.session import materialize
from loomline.tables import load

# ---------------------------------------------------------------- derived graphs


def supplier_part(spark, d):
    """Every lineitem as an edge supplier - part."""
    return load(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"),
        F.col("l_extendedprice").alias("w"))


def nation_trade(spark, d, directed=False):
    """Trade of all pairs of different nations, customer side to supplier side."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    buyers = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(
        load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    sellers = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    trade = lines.join(buyers.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").join(sellers, "l_suppkey")
    a, b = F.col("c_nationkey").cast("bigint"), F.col("s_nationkey").cast("bigint")
    if not directed:
        a, b = F.least(a, b), F.greatest(a, b)
    pairs = trade.filter("c_nationkey <> s_nationkey").groupBy(a.alias("src"), b.alias("dst")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("w"))
    return materialize(pairs, "trade")


_TRADE = """trade AS (SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, l_extendedprice AS p FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey),
e AS MATERIALIZED (SELECT least(a, b) AS src, greatest(a, b) AS dst, round(sum(p), 2) AS w FROM trade GROUP BY 1, 2),
adj AS MATERIALIZED (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e),
node AS MATERIALIZED (SELECT DISTINCT src AS id FROM adj)"""

_HOPS = _TRADE + """,
walk(source, node, level) AS (SELECT id, id, 0 FROM node UNION SELECT source, dst, level + 1 FROM walk JOIN adj ON src = walk.node WHERE level < 16),
hop AS MATERIALIZED (SELECT source, node, min(level) AS level FROM walk GROUP BY 1, 2)"""


def place_graph(spark, d):
    """Customers and suppliers at their nations, and the trade between nations."""
    at = lambda table, mark, key, nation: load(spark, d, table).select(
        F.concat(F.lit("n"), nation).alias("src"), F.concat(F.lit(mark), key).alias("dst"))
    trade = nation_trade(spark, d).select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"))
    places = at("customer", "c", "c_custkey", "c_nationkey").unionByName(at("supplier", "s", "s_suppkey", "s_nationkey"))
    return materialize(trade.unionByName(places), "places")


_PLACES = _TRADE[:_TRADE.index("e AS MATERIALIZED")] + """e AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM (
  SELECT DISTINCT 'n' || least(a, b) AS src, 'n' || greatest(a, b) AS dst FROM trade UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)),
adj AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


def nation_graph(spark, d):
    nodes, adjacency = ge.build_graph(nation_trade(spark, d))
    return materialize(nodes, "nodes"), materialize(adjacency, "adjacency")


def customer_part(spark, d):
    """Distinct customer - part pairs of all lineitems."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


def order_chains(spark, d):
    """(items, deps): each order depends on the customer's previous order and the one before it."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    order = ["o_orderdate", "o_orderkey"]
    once = ordered_window(orders, order, {"prev1": lag(F.col("o_orderkey"))}, keys=["o_custkey"])
    twice = ordered_window(once, order, {"prev2": lag(F.col("prev1"))}, keys=["o_custkey"])
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    items = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"))
    deps = twice.select(F.col("o_orderkey").alias("item"), F.explode(F.array("prev1", "prev2")).alias("depends_on"))
    return items, deps.filter("depends_on is not null")


def supplier_rivals(spark, d):
    """Directed: a supplier to the strongest other supplier of each of the two parts it sells most of."""
    sold = load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    sold = materialize(sold, "sold")
    # a filter on the place right above its window trims each task to two rows a key before the shuffle
    place = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy(F.col("q").desc(), other))
    best = sold.select("*", place("l_suppkey", "l_partkey").alias("n")).filter("n <= 2")
    # the strongest other one is the first or the second seller of the part
    sellers = sold.select("*", place("l_partkey", "l_suppkey").alias("n")).filter("n <= 2")
    met = best.select("l_partkey", F.col("l_suppkey").alias("src")).join(sellers.select("l_partkey", F.col("l_suppkey").alias("dst"), "n"), "l_partkey")
    rivals = met.filter("src <> dst").groupBy("src", "l_partkey").agg(F.min_by("dst", "n").alias("dst"))
    return materialize(rivals.select("src", "dst").distinct(), "rivals")


_RIVALS = """sold AS MATERIALIZED (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
best AS (SELECT l_suppkey AS src, l_partkey FROM sold QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) <= 2),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, l_suppkey AS dst FROM best JOIN sold USING (l_partkey) WHERE l_suppkey <> src
  QUALIFY row_number() OVER (PARTITION BY src, l_partkey ORDER BY q DESC, l_suppkey) = 1)),
way(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM way JOIN e ON src = b),
own AS MATERIALIZED (SELECT x.a AS id, min(x.b) AS component FROM way x JOIN way y ON y.a = x.b AND y.b = x.a GROUP BY 1)"""


def place_tree(spark, d):
    """root -> regions -> nations -> customers, children ranked by key."""
    region = load(spark, d, "region").select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"), F.col("r_regionkey").cast("bigint").alias("k"))
    nation = load(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.col("n_nationkey").cast("bigint").alias("k"))
    customer = load(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), F.col("c_custkey").alias("k"))
    links = region.unionByName(nation).unionByName(customer)
    return ordered_window(links, ["k"], {"rank": row_number()}, keys=["parent"]).select("parent", "child", "rank")


_TREE = """l AS MATERIALIZED (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY k) AS rank FROM (
  SELECT 'root' AS parent, 'r' || r_regionkey AS child, r_regionkey::BIGINT AS k FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer)),
t(node, level, path, trail) AS (SELECT 'root', 0::BIGINT, ['root'], []::BIGINT[] UNION ALL
  SELECT child, level + 1, list_append(path, child), list_append(trail, rank) FROM t JOIN l ON l.parent = t.node)"""

# ---------------------------------------------------------------- construction


@query("build_graph", """
WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 10 <> 3 AND NOT (l_suppkey = 7 AND l_partkey % 2 = 0)),
a AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
n AS (SELECT src AS id FROM a UNION SELECT 'c' || c_custkey FROM customer UNION SELECT 'p' || l_partkey FROM lineitem WHERE NOT (l_suppkey = 7 AND l_partkey % 2 = 0))
SELECT n.id, count(a.src) AS entries, count(DISTINCT a.dst) AS neighbors FROM n LEFT JOIN a ON a.src = n.id GROUP BY 1""")
def _(spark, d):
    suppliers = load(spark, d, "supplier")
    gone = suppliers.filter("s_suppkey % 10 = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    cut = load(spark, d, "part").filter("p_partkey % 2 = 0").select(F.lit("s7").alias("src"), F.concat(F.lit("p"), "p_partkey").alias("dst"))
    lonely = load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    nodes, adjacency = ge.build_graph(supplier_part(spark, d), lonely, removed_nodes=gone, removed_edges=cut)
    stats = adjacency.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("dst").alias("neighbors"))
    return nodes.join(stats, "id", "left").na.fill(0)


@query("neighbors_degree", """
WITH a AS (SELECT 's' || l_suppkey AS id FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem), g AS (SELECT id, count(*) AS degree FROM a GROUP BY 1),
n AS (SELECT id FROM a UNION SELECT 'p' || p_partkey FROM part)
SELECT degree, count(*) AS nodes FROM (SELECT n.id, COALESCE(degree, 0) AS degree FROM n LEFT JOIN g ON n.id = g.id) GROUP BY 1""")
def _(spark, d):
    parts = load(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    nodes, adjacency = ge.build_graph(supplier_part(spark, d), parts)
    return ge.degree_distribution(ge.degrees(nodes, adjacency))


@query("graph_summary", """
WITH n AS (SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem) + (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n, (SELECT count(*) FROM lineitem) AS e)
SELECT n AS node_count, e AS edge_count, round(e / (n * (n - 1) / 2), 8) AS density, round(2 * e / n, 6) AS avg_degree FROM n""")
def _(spark, d):
    edges = supplier_part(spark, d)
    nodes, _ = ge.build_graph(edges)
    return ge.graph_summary(nodes, edges).withColumns({"density": F.round("density", 8), "avg_degree": F.round("avg_degree", 6)})


@query("graph_export", "WITH " + _TRADE + """, cell AS (SELECT a.id AS src, b.id AS dst FROM node a, node b)
SELECT 'edge' AS kind, src, dst, w FROM e UNION ALL
SELECT 'cell', cell.src, cell.dst, COALESCE(adj.w, 0) FROM cell LEFT JOIN adj ON adj.src = cell.src AND adj.dst = cell.dst""")
def _(spark, d):
    nodes, adjacency = nation_graph(spark, d)
    listed = ge.edge_list(adjacency).withColumn("kind", F.lit("edge"))
    return listed.unionByName(ge.adjacency_matrix(nodes, adjacency).withColumn("kind", F.lit("cell")))


# ---------------------------------------------------------------- traversal


@query("bfs_levels", "WITH RECURSIVE " + _TREE + " SELECT node, level, path[-2] AS parent FROM t")
def _(spark, d):
    links = place_tree(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    found = traverse.bfs_levels(links, spark.range(1).select(F.lit("root").alias("id")))
    return found.select("node", F.col("level").cast("bigint").alias("level"), "parent")


def _relaxed_sql(rounds: int) -> str:
    text = "WITH " + _TRADE + ", d0 AS MATERIALIZED (SELECT id AS source, id AS node, 0.0::DOUBLE AS dist FROM node)"
    for i in range(1, rounds + 1):
        text += f""",
d{i} AS MATERIALIZED (SELECT source, node, min(dist) AS dist FROM (SELECT * FROM d{i - 1} UNION ALL
  SELECT source, dst, dist + w FROM d{i - 1} JOIN adj ON src = node) GROUP BY 1, 2)"""
    return text + f"\nSELECT source, node, round(dist, 2) AS dist FROM d{rounds}"


@query("weighted_shortest_paths", _relaxed_sql(12))
def _(spark, d):
    nodes, adjacency = nation_graph(spark, d)
    found, _ = traverse.shortest_distances(adjacency, nodes)
    return found.select("source", "node", F.round("dist", 2).alias("dist"))


def trade_links(spark, d):
    """Suppliers and parts, both ways; the weight is the least price in cents over all lineitems of the pair."""
    edges = supplier_part(spark, d).select("src", "dst", F.round(F.col("w") * 100).cast("bigint").alias("w"))
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def _weighted_sql(rounds: int, sources: str) -> str:
    text = f"""o AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, min(round(l_extendedprice * 100)::BIGINT) AS w FROM lineitem GROUP BY 1, 2),
a AS MATERIALIZED (SELECT s AS src, p AS dst, w FROM o UNION ALL SELECT p, s, w FROM o),
d0 AS MATERIALIZED (SELECT DISTINCT src AS source, src AS node, {{'d': 0::BIGINT, 'h': 0, 'p': NULL::VARCHAR}} AS l FROM a WHERE src IN ({sources}))"""
    for i in range(1, rounds + 1):
        text += f""",
d{i} AS MATERIALIZED (SELECT source, node, arg_min(l, (l.d, l.h, COALESCE(l.p, ''))) AS l FROM (SELECT * FROM d{i - 1} UNION ALL
  SELECT source, dst, {{'d': l.d + w, 'h': l.h + 1, 'p': src}} FROM d{i - 1} JOIN a ON src = node) GROUP BY 1, 2)"""
    return text + f""",
best AS MATERIALIZED (SELECT source, node, l.d AS dist, l.h::BIGINT AS hops, l.p AS parent FROM d{rounds})"""


_SOURCES = [f"s{i}" for i in range(1, 11)]
_WEIGHTED = _weighted_sql(30, ", ".join(f"'{s}'" for s in _SOURCES))


def weighted_tree(spark, d):
    starts = spark.createDataFrame([(s,) for s in _SOURCES], "id string")
    links = trade_links(spark, d)
    suppliers = load(spark, d, "lineitem").select("l_suppkey").distinct().select(F.concat(F.lit("s"), "l_suppkey").alias("id"))
    there = suppliers.join(starts, "id", "left_semi").distinct()
    return traverse.weighted_levels(links, there)


@query("weighted_levels", "WITH " + _WEIGHTED + " SELECT * FROM best")
def _(spark, d):
    return weighted_tree(spark, d).withColumn("hops", F.col("hops").cast("bigint"))


@query("weighted_paths", "WITH RECURSIVE " + _WEIGHTED + """,
t(source, node, path) AS (SELECT source, node, node FROM best WHERE parent IS NULL UNION ALL
  SELECT best.source, best.node, t.path || '-' || best.node FROM t JOIN best ON best.source = t.source AND best.parent = t.node)
SELECT source, node, dist, path FROM t JOIN best USING (source, node) WHERE node LIKE 's%'""")
def _(spark, d):
    tree = materialize(weighted_tree(spark, d), "weighted")
    paths = traverse.walk_parents(tree, tree.filter(F.startswith("node", F.lit("s"))).select("source", "node"))
    return paths.join(tree, ["source", "node"]).select("source", "node", "dist", F.array_join("path", "-").alias("path"))


@query("find_path", "WITH RECURSIVE " + _HOPS + """
SELECT source, node, level AS hops FROM hop WHERE source = (SELECT min(id) FROM node) AND node = (SELECT max(id) FROM node)""")
def _(spark, d):
    nodes, adjacency = nation_graph(spark, d)
    ends = nodes.agg(F.min("id"), F.max("id")).first()
    path = traverse.find_path(adjacency, ends[0], ends[1])
    return path.select("source", "node", (F.size("path") - 1).cast("bigint").alias("hops"))


@query("all_simple_paths", "WITH RECURSIVE " + _TRADE + """,
p(node, path) AS (SELECT min(id), [min(id)] FROM node UNION ALL
  SELECT dst, list_append(path, dst) FROM p JOIN adj ON src = p.node WHERE NOT list_contains(path, dst) AND len(path) < 5 AND p.node <> (SELECT max(id) FROM node))
SELECT array_to_string(path, '-') AS path FROM p WHERE node = (SELECT max(id) FROM node)""")
def _(spark, d):
    nodes, adjacency = nation_graph(spark, d)
    ends = nodes.agg(F.min("id"), F.max("id")).first()
    paths = traverse.all_simple_paths(adjacency, ends[0], ends[1], 4)
    return paths.select(F.array_join("path", "-").alias("path"))


def _labels_sql(rounds: int) -> str:
    text = """WITH e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
adj AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS label FROM adj)"""
    for i in range(1, rounds + 1):
        text += f""",
r{i} AS MATERIALIZED (SELECT a.src AS id, least(any_value(o.label), min(x.label)) AS label FROM adj a JOIN r{i - 1} x ON x.id = a.dst JOIN r{i - 1} o ON o.id = a.src GROUP BY 1)"""
    return text + f"\nSELECT id, label AS component FROM r{rounds}"


@query("connected_components", _labels_sql(12))
def _(spark, d):
    edges = materialize(customer_part(spark, d), "edges")
    nodes, _ = ge.build_graph(edges)
    return traverse.connected_components(nodes, edges)


@query("topological_layers", """
SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS layer FROM orders""")
def _(spark, d):
    return dag.topological_layers(*order_chains(spark, d))


@query("ready_items", """
WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, lag(o_orderstatus) OVER w AS p1, lag(o_orderstatus, 2) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT id FROM o WHERE s = 'O' AND COALESCE(p1, 'F') = 'F' AND COALESCE(p2, 'F') = 'F'""")
def _(spark, d):
    return dag.ready_items(*order_chains(spark, d)).select("id")


@query("strong_components", "WITH RECURSIVE " + _RIVALS + " SELECT id, component FROM own")
def _(spark, d):
    return dag.strong_components(supplier_rivals(spark, d))


@query("witness_cycles", "WITH RECURSIVE " + _RIVALS + """,
f AS MATERIALIZED (SELECT src AS id, x.component, min(dst) AS next FROM e JOIN own x ON x.id = src JOIN own y ON y.id = dst AND y.component = x.component GROUP BY 1, 2),
orbit(start, node) AS (SELECT id, next FROM f UNION SELECT start, next FROM orbit JOIN f ON f.id = node),
least AS (SELECT component, min(node) AS m FROM orbit JOIN f ON f.id = start WHERE start IN (SELECT start FROM orbit WHERE node = start) GROUP BY 1),
steps(component, m, place, node) AS (SELECT component, m, 0::BIGINT, m FROM least UNION ALL
  SELECT steps.component, m, place + 1, next FROM steps JOIN f ON f.id = node WHERE next <> m)
SELECT component, place, node FROM steps""")
def _(spark, d):
    return dag.witness_cycles(supplier_rivals(spark, d))


@query("find_cycles", "WITH RECURSIVE " + _TRADE.replace("least(a, b) AS src, greatest(a, b) AS dst", "a AS src, b AS dst") + """,
p(start, node, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL
  SELECT start, e.dst, list_append(path, e.dst) FROM p JOIN e ON e.src = p.node WHERE p.node <> start AND len(path) <= 4 AND e.dst >= start AND (e.dst = start OR NOT list_contains(path, e.dst)))
SELECT array_to_string(path, '-') AS cycle FROM p WHERE node = start""")
def _(spark, d):
    trade = nation_trade(spark, d, directed=True)
    cycles = dag.find_cycles(trade.select(F.col("src").alias("item"), F.col("dst").alias("depends_on")), 4)
    return cycles.select(F.array_join("cycle", "-").alias("cycle"))


# ---------------------------------------------------------------- measures


@query("minimum_spanning_tree", "WITH RECURSIVE " + _TRADE + """,
r(es, ed, ew, node) AS (SELECT src, dst, w, src FROM e UNION SELECT es, ed, ew, adj.dst FROM r JOIN adj ON adj.src = r.node AND adj.w < r.ew)
SELECT src, dst, w FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE es = e.src AND ed = e.dst AND r.node = e.dst)""")
def _(spark, d):
    return cuts.minimum_spanning_forest(nation_trade(spark, d))


def _pagerank_sql(rounds: int) -> str:
    text = """WITH adj AS MATERIALIZED (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
node AS MATERIALIZED (SELECT src AS id, count(*) AS deg FROM adj GROUP BY 1), n AS (SELECT count(*) AS n FROM node), d AS MATERIALIZED (SELECT DISTINCT src, dst FROM adj),
r0 AS MATERIALIZED (SELECT id, deg, 1.0::DOUBLE / n AS rank FROM node, n)"""
    for i in range(1, rounds + 1):
        text += f""",
r{i} AS MATERIALIZED (SELECT x.id, x.deg, 0.15::DOUBLE / n.n + 0.85::DOUBLE * COALESCE(s.part, 0) AS rank FROM node x CROSS JOIN n LEFT JOIN
  (SELECT d.dst, sum(p.rank / p.deg) AS part FROM d JOIN r{i - 1} p ON p.id = d.src GROUP BY 1) s ON s.dst = x.id)"""
    return text + f"\nSELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank", _pagerank_sql(10))
def _(spark, d):
    nodes, adjacency = ge.build_graph(supplier_part(spark, d))
    return ranks.pagerank(nodes, adjacency, iterations=10).select("id", F.round("rank", 9).alias("rank"))


@query("closeness_centrality", "WITH RECURSIVE " + _HOPS + """
SELECT source AS id, round((count(*) - 1) / sum(level), 6) AS closeness FROM hop GROUP BY 1""")
def _(spark, d):
    nodes, adjacency = nation_graph(spark, d)
    return ranks.closeness_centrality(adjacency, nodes).withColumn("closeness", F.round("closeness", 6))


@query("betweenness_centrality", "WITH RECURSIVE " + _HOPS + """,
sp(source, node, level) AS (SELECT id, id, 0 FROM node UNION ALL
  SELECT sp.source, adj.dst, sp.level + 1 FROM sp JOIN adj ON adj.src = sp.node JOIN hop ON hop.source = sp.source AND hop.node = adj.dst AND hop.level = sp.level + 1),
sg AS MATERIALIZED (SELECT source, node, level, count(*) AS c FROM sp GROUP BY 1, 2, 3),
b AS (SELECT v.node AS id, sum(v.c * t.c / st.c) AS b FROM sg v JOIN sg t ON t.source = v.node JOIN sg st ON st.source = v.source AND st.node = t.node
  WHERE v.node <> v.source AND t.node <> v.node AND st.node <> st.source AND v.level + t.level = st.level GROUP BY 1)
SELECT node.id, round(COALESCE(b, 0) / (((SELECT count(*) FROM node) - 1) * ((SELECT count(*) FROM node) - 2)), 6) AS betweenness FROM node LEFT JOIN b ON b.id = node.id""")
def _(spark, d):
    nodes, adjacency = nation_graph(spark, d)
    return ranks.betweenness_centrality(nodes, adjacency).withColumn("betweenness", F.round("betweenness", 6))


@query("bridges", "WITH RECURSIVE " + _PLACES + """,
r(es, ed, node) AS (SELECT src, dst, src FROM e UNION SELECT es, ed, adj.dst FROM r JOIN adj ON adj.src = r.node AND NOT (least(adj.src, adj.dst) = es AND greatest(adj.src, adj.dst) = ed))
SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE es = e.src AND ed = e.dst AND r.node = e.dst)""")
def _(spark, d):
    edges = place_graph(spark, d)
    return cuts.bridges(cuts.block_forest(ge.build_graph(edges)[0], edges))


@query("articulation_points", "WITH RECURSIVE " + _PLACES + """,
r(x, a, node) AS (SELECT src, dst, dst FROM adj UNION SELECT x, a, adj.dst FROM r JOIN adj ON adj.src = r.node AND adj.dst <> r.x)
SELECT DISTINCT p.src AS id FROM adj p JOIN adj q ON p.src = q.src AND p.dst < q.dst
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.x = p.src AND r.a = p.dst AND r.node = q.dst)""")
def _(spark, d):
    edges = place_graph(spark, d)
    return cuts.articulation_points(cuts.block_forest(ge.build_graph(edges)[0], edges))


# ---------------------------------------------------------------- trees


@query("tree_levels_and_paths", "WITH RECURSIVE " + _TREE + """
SELECT node, level, array_to_string(path, '/') AS path, row_number() OVER (ORDER BY trail) - 1 AS preorder FROM t""")
def _(spark, d):
    tree = trees.tree_levels(place_tree(spark, d), "root")
    return tree.join(trees.tree_paths(tree), "node").select("node", "level", "path", F.col("pre").alias("preorder"))


@query("tree_counts_and_search", "WITH RECURSIVE " + _TREE + """,
a AS (SELECT unnest(path) AS node, generate_subscripts(path, 1) - 1 AS lvl, level, t.node AS leaf, NOT EXISTS (SELECT 1 FROM l WHERE l.parent = t.node) AS is_leaf FROM t),
c AS (SELECT node, count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, max(level - lvl) AS depth FROM a GROUP BY 1),
h AS (SELECT * FROM t WHERE node LIKE '%1')
SELECT c.node, nodes, leaves, CAST(depth AS BIGINT) AS depth, c.node LIKE '%1' AS found, c.node = (SELECT node FROM h ORDER BY trail LIMIT 1) AS is_first,
  EXISTS (SELECT 1 FROM h WHERE h.node = c.node AND NOT EXISTS (SELECT 1 FROM h o WHERE o.node <> h.node AND list_contains(h.path, o.node))) AS topmost FROM c""")
def _(spark, d):
    tree = trees.tree_levels(place_tree(spark, d), "root")
    hit = F.col("node").endswith("1")
    first = trees.find_first(tree, hit).select("node", F.lit(True).alias("is_first"))
    top = trees.topmost_matches(tree, hit).select("node", F.lit(True).alias("topmost"))
    found = trees.find_all(tree, hit).select("node", F.lit(True).alias("found"))
    joined = trees.subtree_counts(tree)
    for part in (found, first, top):
        joined = joined.join(part, "node", "left")
    return joined.na.fill(False, ["found", "is_first", "topmost"])
