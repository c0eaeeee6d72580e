"""Graph operators against brute force on small random graphs."""

from __future__ import annotations

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomline.operators import quality
from loomline.operators.graph import cuts, dag, edges as ge, ranks, traverse, trees
from loomline.session import materialize


def adjacency_of(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def reach(adj, start, without_node=None, without_edge=None):
    seen, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in adj.get(x, ()):
            if y != without_node and y not in seen and {x, y} != without_edge:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def random_graph(seed, n=22, m=24):
    rng = random.Random(seed)
    weights = list(range(1, 400))
    rng.shuffle(weights)
    pairs = set()
    while len(pairs) < m:
        a, b = rng.sample(range(n), 2)
        pairs.add((min(a, b), max(a, b)))
    return [(a, b, float(weights[i])) for i, (a, b) in enumerate(sorted(pairs))]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_bridges_articulation_and_forest(spark, seed):
    rows = random_graph(seed)
    adj = adjacency_of((a, b) for a, b, _ in rows)
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    nodes, _ = ge.build_graph(edges, spark.createDataFrame([(99,)], "id long"))
    labels = {r.id: r.component for r in traverse.connected_components(nodes, edges).collect()}
    assert labels == {**{x: min(reach(adj, x)) for x in adj}, 99: 99}

    forest = cuts.block_forest(nodes, edges)
    found = {(r.src, r.dst) for r in cuts.bridges(forest).collect()}
    assert found == {(a, b) for a, b, _ in rows if b not in reach(adj, a, without_edge={a, b})}
    points = {r.id for r in cuts.articulation_points(forest).collect()}
    assert points == {x for x in adj if any(
        q not in reach(adj, p, without_node=x) for p, q in itertools.combinations(adj[x], 2))}

    tree = {(r.src, r.dst) for r in cuts.minimum_spanning_forest(edges).collect()}
    light = set()
    for a, b, w in sorted(rows, key=lambda r: r[2]):
        if b not in reach(adjacency_of(light), a):
            light.add((a, b))
    assert tree == light


def test_twin_edges_are_no_bridges(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 1.0)], "src string, dst string, w double")
    nodes, _ = ge.build_graph(edges)
    assert [tuple(r) for r in cuts.bridges(cuts.block_forest(nodes, edges)).collect()] == [("b", "c")]


def test_path_graph_fixture(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, w double")
    nodes, adj = ge.build_graph(edges)
    assert [r.id for r in cuts.articulation_points(cuts.block_forest(nodes, edges)).collect()] == ["b"]
    assert traverse.is_connected(nodes, edges)
    assert {r.id: r.degree for r in ge.degrees(nodes, adj).collect()} == {"a": 1, "b": 2, "c": 1}


def test_weighted_fixture(spark):
    rows = [("a", "b", 4.0), ("a", "c", 2.0), ("b", "c", 1.0), ("b", "d", 5.0), ("c", "d", 8.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    start = spark.createDataFrame([("a",)], "id string")
    found, negative = traverse.shortest_distances(ge.both_directions(edges), start)
    assert {r.node: r.dist for r in found.collect()} == {"a": 0, "b": 3, "c": 2, "d": 8} and not negative
    ends = found.filter("node = 'd'").select("source", "node")
    assert traverse.walk_parents(found, ends).first().path == ["a", "c", "b", "d"]
    paths = {tuple(r.path) for r in traverse.all_simple_paths(ge.both_directions(edges), "a", "d", 3).collect()}
    assert paths == {("a", "b", "d"), ("a", "c", "d"), ("a", "b", "c", "d"), ("a", "c", "b", "d")}
    assert len(traverse.find_path(ge.both_directions(edges), "a", "d").first().path) == 3
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "c", -3.0), ("c", "b", 1.0)], "src string, dst string, w double")
    assert traverse.shortest_distances(loop, start)[1]


def test_layers_cycles_and_ready(spark):
    deps = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (5, 4), (4, 5), (6, 5), (7, 7)], "item long, depends_on long")
    items = spark.createDataFrame([(i, "completed" if i in (1, 2) else "pending") for i in range(1, 9)], "id long, status string")
    layers = {r.id: r.layer for r in dag.topological_layers(items, deps).collect()}
    assert layers == {1: 0, 2: 1, 3: 2, 8: 0, 4: None, 5: None, 6: None, 7: None}
    assert {r.id for r in dag.ready_items(items, deps).collect()} == {3, 8}
    assert {tuple(r.cycle) for r in dag.find_cycles(deps, 5).collect()} == {(4, 5, 4), (7, 7)}


def strong(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
    ahead = {x: set().union(*(set(reach(adj, y)) for y in adj[x])) for x in adj}
    return {x: min(y for y in ahead[x] if x in ahead.get(y, ())) for x in adj if x in ahead[x]}


def test_strong_components_and_their_cycles(spark):
    rng = random.Random(6)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(k, k + 1) for k in range(70, 90)} | {(90, 75), (95, 95), (95, 96), (97, 70)}
    edges = spark.createDataFrame([*pairs, *list(pairs)[:4], (1, None), (None, 2)], "src long, dst long")
    own = materialize(dag.strong_components(edges), "own")
    want = strong(pairs)
    assert {r.id: r.component for r in own.collect()} == want and own.count() == len(want) > 20
    step = {x: min(b for a, b in pairs if a == x and want.get(b) == want[x]) for x in want}
    cycles = {}
    for x in want:
        seen = [x]
        while step[seen[-1]] not in seen:
            seen.append(step[seen[-1]])
        circle = seen[seen.index(step[seen[-1]]):]
        at = circle.index(min(circle))
        cycles[want[x]] = min(cycles.get(want[x], [999]), circle[at:] + circle[:at])
    rows = dag.witness_cycles(edges, own).collect()
    assert {c: [r.node for r in sorted(rows, key=lambda r: r.place) if r.component == c] for c in cycles} == cycles
    assert len(rows) == sum(map(len, cycles.values()))


def test_no_cycles_in_a_chain_or_an_empty_table(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    for frame in (edges, edges.limit(0)):
        assert dag.strong_components(frame).count() == 0 and dag.witness_cycles(frame).count() == 0


def test_a_circle_of_5000_nodes(spark):
    n = 5_000
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    cycle = dag.witness_cycles(edges)
    assert cycle.agg(F.count("*"), F.count_if((F.col("node") == F.col("place")) & (F.col("component") == 0))).first() == (n, n)


def peeled(ids, deps):
    open_, layers, level = {x: {b for a, b in deps if a == x} for x in ids}, dict.fromkeys(ids), 0
    while ready := [x for x, need in open_.items() if not need]:
        layers |= dict.fromkeys(ready, level)
        open_ = {x: need - set(ready) for x, need in open_.items() if x not in ready}
        level += 1
    return layers


@pytest.mark.parametrize(("seed", "back"), [(1, 0), (2, 0), (3, 2), (4, 40)])
def test_layers_of_random_graphs(spark, seed, back):
    rng = random.Random(seed)
    deps = {(max(p), min(p)) for p in (rng.sample(range(60), 2) for _ in range(110))} | {(k, k - j) for k in range(103, 130) for j in (1, 2, 3)}
    deps |= {tuple(rng.sample(range(60), 2)) for _ in range(back)}
    frame = spark.createDataFrame([*deps, *list(deps)[:5], (200, None)], "item long, depends_on long")
    ids = {x for d in deps for x in d} | {200, 300}
    got = dag.topological_layers(spark.createDataFrame([(300,)], "id long"), frame).collect()
    assert {r.id: r.layer for r in got} == peeled(ids, deps) and len(got) == len(ids)


def test_layers_of_a_dense_circle_are_null(spark):
    deps = spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if a != b] + [(9, 1), (1, 8)], "item long, depends_on long")
    got = {r.id: r.layer for r in dag.topological_layers(deps.select(F.col("item").alias("id")), deps).collect()}
    assert got == {**dict.fromkeys((0, 1, 2, 3, 9)), 8: 0}


def test_layers_of_a_chain_of_50000(spark, monkeypatch):
    rounds, once = [], dag._folded_once
    monkeypatch.setattr(dag, "_folded_once", lambda s: rounds.append(1) or once(s))
    chain = spark.range(1, 50_000).select(F.col("id").alias("item"), F.explode(F.array(F.col("id") - 1, F.greatest(F.col("id") - 2, F.lit(0)))).alias("depends_on"))
    layers = dag.topological_layers(spark.range(1), chain)
    assert layers.agg(F.count("*"), F.count_if(F.col("layer") == F.col("id"))).first() == (50_000, 50_000)
    assert len(rounds) <= 20


def test_layers_of_an_empty_table(spark):
    none = spark.createDataFrame([], "item long, depends_on long")
    assert dag.topological_layers(spark.range(0), none).count() == 0


def test_pagerank_against_loops(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "c"), ("c", "d")]
    edges = spark.createDataFrame([(*r, 1.0) for r in rows], "src string, dst string, w double")
    nodes, adj = ge.build_graph(edges, directed=True)
    names, out = "abcd", {}
    for a, _ in rows:
        out[a] = out.get(a, 0) + 1
    rank = dict.fromkeys(names, 0.25)
    for _ in range(12):
        rank = {x: 0.15 / 4 + 0.85 * sum(rank[a] / out[a] for a, b in set(rows) if b == x) for x in names}
    got = {r.id: r["rank"] for r in ranks.pagerank(nodes, adj, iterations=12).collect()}
    assert all(abs(got[x] - rank[x]) < 1e-12 for x in names)


def test_centralities_against_brute_force(spark):
    rows = random_graph(5, 10, 13)
    adj = adjacency_of((a, b) for a, b, _ in rows)
    nodes, adjacency = ge.build_graph(spark.createDataFrame(rows, "src long, dst long, w double"))
    dist = {x: reach(adj, x) for x in adj}

    def count(s, t):
        return 1 if s == t else sum(count(s, p) for p in adj[t] if dist[s].get(p, 99) == dist[s][t] - 1)

    n = len(adj)
    want = {v: sum(count(s, v) * count(v, t) / count(s, t) for s in adj for t in dist[s] if len({s, t, v}) == 3
                   and v in dist[s] and dist[s][v] + dist[v].get(t, 99) == dist[s][t]) / ((n - 1) * (n - 2)) for v in adj}
    got = {r.id: r.betweenness for r in ranks.betweenness_centrality(nodes, adjacency).collect()}
    assert all(abs(got[v] - want[v]) < 1e-9 for v in adj)
    close = {r.id: r.closeness for r in ranks.closeness_centrality(adjacency, nodes).collect()}
    assert all(abs(close[v] - (len(dist[v]) - 1) / sum(dist[v].values())) < 1e-12 for v in adj)


def test_tree_search(spark):
    links = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("a", "c", 1), ("a", "d", 2), ("d", "e", 1)], "parent string, child string, rank int")
    tree = trees.tree_levels(links, "r")
    assert [r.node for r in tree.orderBy("pre").collect()] == list("racdeb")
    assert {r.node: r.path for r in trees.tree_paths(tree).collect()} == {"r": "r", "a": "r/a", "b": "r/b", "c": "r/a/c", "d": "r/a/d", "e": "r/a/d/e"}
    counts = {r.node: (r.nodes, r.leaves, r.depth) for r in trees.subtree_counts(tree).collect()}
    assert counts == {"r": (6, 3, 3), "a": (4, 2, 2), "b": (1, 1, 0), "c": (1, 1, 0), "d": (2, 1, 1), "e": (1, 1, 0)}
    hit = F.col("node").isin("d", "e", "b")
    assert {r.node for r in trees.topmost_matches(tree, hit).collect()} == {"d", "b"}
    assert trees.find_first(tree, hit).first().node == "d"


def test_random_trees_and_unreached_nodes(spark):
    rng = random.Random(8)
    links = [(rng.randrange(max(0, k - 6), k), k, rng.random()) for k in range(1, 70)] + [(900, 901, 1.0), (901, 902, 1.0), (950, 951, 1.0), (951, 950, 1.0)]
    tree = trees.tree_levels(spark.createDataFrame(links, "parent long, child long, rank double"), 0)
    kids = {}
    for p, c, r in sorted(links, key=lambda x: x[2]):
        kids.setdefault(p, []).append(c)
    want, order = {}, []

    def walk(v, level):
        order.append(v)
        at, parts = len(order) - 1, [walk(c, level + 1) for c in kids.get(v, [])]
        size, leaves, depth = 1 + sum(p[0] for p in parts), sum(p[1] for p in parts) or 1, max((p[2] + 1 for p in parts), default=0)
        want[v] = (level, at, size, leaves, depth)
        return size, leaves, depth

    walk(0, 0)
    counts = {r.node: r.depth for r in trees.subtree_counts(tree).collect()}
    assert {r.node: (r.level, r.pre, r["size"], r.leaves, counts[r.node]) for r in tree.collect()} == want
    up = {c: p for p, c, _ in links}
    hit = {v for v in want if v % 5 in (0, 3) and v}
    above = lambda v: v != 0 and (up[v] in hit or above(up[v]))
    found = trees.topmost_matches(tree, F.col("node").isin(sorted(hit)))
    assert {r.node for r in found.collect()} == {v for v in hit if not above(v)} and found.columns == tree.columns


def test_a_chain_of_100000_nodes_takes_log_many_rounds(spark, monkeypatch):
    from loomline.operators.graph import tours
    rounds, doubled = [], tours._doubled
    monkeypatch.setattr(tours, "_doubled", lambda *a: rounds.append(1) or doubled(*a))
    n = 100_000
    links = spark.range(1, n).select((F.col("id") - 1).alias("parent"), F.col("id").alias("child"), F.lit(1).alias("rank"))
    tree = trees.tree_levels(links, 0)
    assert len(rounds) <= 20
    row = tree.agg(F.count("*").alias("n"), F.count_if((F.col("level") == F.col("node")) & (F.col("pre") == F.col("node")) & (F.col("size") == n - F.col("node"))).alias("right")).first()
    assert (row.n, row.right) == (n, n)


def test_cuts_of_forests_with_twins_loops_and_lone_nodes(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(a, b, 1.0) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(36))] + [(80, 81, 1.0), (81, 80, 1.0), (90, 90, 1.0)]
        edges = spark.createDataFrame(rows, "src long, dst long, w double")
        forest = materialize(cuts.block_forest(ge.build_graph(edges)[0], edges), "forest")
        pairs = {(min(a, b), max(a, b)) for a, b, _ in rows if a != b}
        adj, twins = adjacency_of(pairs), {p for p in pairs if sum({a, b} == set(p) for a, b, _ in rows) > 1}
        assert {(r.src, r.dst) for r in cuts.bridges(forest).collect()} == {p for p in pairs - twins if p[1] not in reach(adj, p[0], without_edge=set(p))}
        assert {r.id for r in cuts.articulation_points(forest).collect()} == {x for x in adj if any(
            q not in reach(adj, p, without_node=x) for p, q in itertools.combinations(adj[x], 2))}
        assert {r.node for r in forest.collect()} == {x for a, b, _ in rows for x in (a, b)}


def test_a_path_of_100000_nodes_with_chords(spark, monkeypatch):
    from loomline.operators.graph import tours
    rounds, doubled = [], tours._doubled
    monkeypatch.setattr(tours, "_doubled", lambda *a: rounds.append(1) or doubled(*a))
    n = 100_000
    path = spark.range(1, n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    chords = spark.range(0, n - 10, 1000).select(F.col("id").alias("src"), (F.col("id") + 7).alias("dst"))
    edges = path.unionByName(chords)
    forest = materialize(cuts.block_forest(spark.range(n), edges), "forest")
    assert len(rounds) <= 20
    # a chord closes seven edges of the path; the points inside stay joined without each other
    assert cuts.bridges(forest).count() == n - 1 - 7 * (n // 1000)
    assert cuts.articulation_points(forest).count() == n - 2 - 6 * (n // 1000)


def test_edge_checks(spark):
    edges = spark.createDataFrame([("a", "b", -1.0), ("a", "a", 1.0), ("", "b", 1.0), ("a", "b", 2.0)], "src string, dst string, w double")
    assert {r.finding for r in quality.graph_findings(edges).collect()} == {"negative weight", "self-loop", "empty id"}
    assert quality.valid_edges(edges).count() == 1


def cheapest(edges, source):
    """Least (weight, hops) and smallest parent by relaxing until nothing changes."""
    best, changed = {source: (0, 0, "")}, True
    while changed:
        changed = False
        for a, b, w in edges:
            if a != b and w is not None and a in best:
                offer = (best[a][0] + w, best[a][1] + 1, a)
                if b not in best or offer < best[b]:
                    best[b], changed = offer, True
    return {(source, n, d, h, p or None) for n, (d, h, p) in best.items()}


@pytest.mark.parametrize("width", [None, 3])
def test_weighted_levels(spark, width):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice([0, 0, 1, 2, 5, 40, None])) for _ in range(150)]
    edges += edges[:10] + [("n0", "n0", 0), ("x", "y", 3)]
    table = spark.createDataFrame(edges, "src string, dst string, w long")
    starts = spark.createDataFrame([("n0",), ("n1",), ("n1",), ("alone",)], "id string")
    found = {tuple(r) for r in traverse.weighted_levels(table, starts, width).select("source", "node", "dist", "hops", "parent").collect()}
    assert found == cheapest(edges, "n0") | cheapest(edges, "n1") | {("alone", "alone", 0, 0, None)}


def test_weighted_levels_of_nothing_and_negative_weights(spark):
    starts = spark.createDataFrame([(1,)], "id long")
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert [tuple(r) for r in traverse.weighted_levels(none, starts).collect()] == [(1, 1, 0.0, 0, None)]
    with pytest.raises(ValueError):
        traverse.weighted_levels(spark.createDataFrame([(1, 2, -1.0)], none.schema), starts)


def test_only_edges_in_sight_are_grouped(spark, monkeypatch):
    tables, plain = [], traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, label="t", *a: tables.append((label, plain(df, label, *a))) or tables[-1][1])
    monkeypatch.setattr(traverse, "discard", lambda *_: None)
    far = [(f"x{k}", f"y{k}", 1) for k in range(50)]
    table = spark.createDataFrame([("a", "b", 3), ("a", "b", 2), ("b", "c", 1), *far], "src string, dst string, w long")
    found = traverse.weighted_levels(table, spark.createDataFrame([("a",)], "id string")).collect()
    assert {(r.node, r.dist) for r in found} == {("a", 0), ("b", 2), ("c", 3)}
    grouped = [t for label, t in tables if label == "hops"][1:]
    assert grouped and sum(t.count() for t in grouped) == 2


@pytest.mark.parametrize("kind, rewritten, rounds", [("long", 0, None), ("decimal(9,2)", 100, None), ("long", 100, 2)])
def test_only_edges_within_the_bounds_are_worked_on(spark, monkeypatch, kind, rewritten, rounds):
    tables, plain = [], traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, label="t", *a: tables.append((label, plain(df, label, *a))) or tables[-1][1])
    monkeypatch.setattr(traverse, "discard", lambda *_: None)
    monkeypatch.setattr(traverse, "REWRITTEN", rewritten)
    if rounds:
        monkeypatch.setattr(traverse._Packed, "rounds", rounds)
    rng = random.Random(11)
    # a few light edges reach nearly all nodes; a node behind heavy edges only, twins, loops, ties and no weight
    edges = [(f"n{a}", f"n{b}", 5 * rng.randrange(1, 4) if abs(a - b) in (1, 7) else 500 + rng.randrange(400)) for a in range(30) for b in range(30)]
    edges += [("n3", "far", 900), ("far", "further", 700), ("further", "n1", 10), ("n1", "n2", None), ("n4", "n5", 0), ("away", "off", 1)]
    table = spark.createDataFrame(edges, "src string, dst string, w int").selectExpr("src", "dst", f"cast(w as {kind}) as w")
    ids = [f"n{k}" for k in range(18)] + [None, None]
    starts = spark.createDataFrame([(x,) for x in ids], "id string")
    found = traverse.weighted_levels(table, starts, 20).select("source", "node", "dist", "hops", "parent")
    assert found.schema["dist"].dataType == table.schema["w"].dataType
    want = set().union(*[cheapest(edges, x) for x in ids[:18]]) | {(None, None, 0, 0, None)}
    assert found.count() == len(want) and {tuple(r) for r in found.collect()} == want
    worked = sum(t.count() for label, t in tables if label == "hops")
    assert rounds or worked < len(edges) / 2


def test_paths_pass_inner_nodes_only(spark, monkeypatch):
    tables, plain = [], traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, label="t", *a: tables.append((label, plain(df, label, *a))) or tables[-1][1])
    rows = [("a", "a", None), ("a", "b", "a"), ("a", "c", "b"), ("a", "lost", "gone"), *[("a", f"leaf{k}", "b") for k in range(40)]]
    tree = spark.createDataFrame(rows, "source string, node string, parent string")
    ends = spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "lost"), ("a", "none")], "source string, node string")
    assert {(r.node, *r.path) for r in traverse.walk_parents(tree, ends).collect()} == {("c", "a", "b", "c"), ("a", "a")}
    assert [t for label, t in tables if label == "tree"][-1].count() == 2


def test_components_merge_all_links_after_a_few(spark, monkeypatch):
    rng, rounds, plain = random.Random(3), [], traverse._merged
    monkeypatch.setattr(traverse, "_merged", lambda links: rounds.append(links.count()) or plain(links))
    # dense blocks: a few links of each node hold them together, so no other link is worked on
    edges = [(b * 100 + rng.randrange(60), b * 100 + rng.randrange(60)) for b in range(3) for _ in range(1500)]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(5, None), (7, 7)]
    table = spark.createDataFrame(edges, "src long, dst long")
    adj = adjacency_of((a, b) for a, b in edges if b is not None)
    found = {r.id: r.component for r in traverse.connected_components(spark.createDataFrame([(x,) for x in adj], "id long"), table).collect()}
    assert found == {x: min(reach(adj, x)) for x in adj}
    assert sum(rounds) <= 4 * len(adj)


def test_pagerank_of_a_hub_in_several_lists(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CHUNK", 4)
    rows = [("hub", f"n{k}") for k in range(30)] + [(f"n{k}", "hub") for k in range(30)] + [("hub", "n1"), ("n2", None)]
    rank = {r.id: r["rank"] for r in ranks.pagerank(spark.createDataFrame([(x,) for x in {a for a, _ in rows}], "id string"),
                                                    spark.createDataFrame(rows, "src string, dst string"), iterations=2).collect()}
    first = {"hub": 0.15 / 31 + 0.85 / 31 * 29.5, "n1": 0.15 / 31 + 0.85 / 31 / 31, "n2": 0.15 / 31 + 0.85 / 31 / 31}
    assert abs(rank["n1"] - (0.15 / 31 + 0.85 * first["hub"] / 31)) < 1e-12
    assert abs(rank["hub"] - (0.15 / 31 + 0.85 * (29 * first["n1"] + first["n2"] / 2))) < 1e-12
    assert abs(rank[None] - 0.85 * first["n2"] / 2) < 1e-12


def test_rivals_trim_before_the_shuffle(spark, tmp_path):
    from loomline.catalog import graphs
    rows = [(s, p, float(q)) for s, p, q in [(1, 1, 5), (2, 1, 7), (3, 1, 6), (1, 2, 1), (3, 2, 9), (1, 3, 9), (4, 3, 9), (4, 4, 1)]]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    made, plain = [], graphs.materialize
    try:
        graphs.materialize = lambda df, label="t": made.append((label, df)) or plain(df, label)
        found = {tuple(r) for r in graphs.supplier_rivals(spark, str(tmp_path)).collect()}
    finally:
        graphs.materialize = plain
    assert found == {(1, 4), (1, 2), (2, 3), (3, 1), (3, 2), (4, 1)}
    assert "WindowGroupLimit" in dict(made)["rivals"]._jdf.queryExecution().executedPlan().toString()
