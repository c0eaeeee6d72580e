"""Reachability, shortest paths, simple paths, connected components.

Loops run on the driver but hold no data: each round is one job that writes its
result to the shared scratch area, and stops on an emptiness test. Joins are on
(node, edge) with at most one row per node on the state side, so a node with very
many edges only makes the edge side skewed, which AQE splits.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomline.plans.ordered import with_position
from loomline.session import discard, materialize, materialize_some


def bfs_levels(edges: DataFrame, starts: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(source, node, level, parent) for every node reachable from each start.

    ``edges`` are directed (src, dst); ``starts`` has ``id``. The parent is the
    smallest one, so the tree is repeatable.
    """
    hops = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "hops")
    frontier = materialize(starts.select(
        F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("level"),
        F.col("id").alias("parent")).withColumn("parent", F.when(F.lit(False), F.col("parent"))), "bfs")
    # eight tables of equally many rounds are written as one, so a deep graph is read from few tables
    kept, depth = [(frontier, 1)], 0
    while max_levels is None or depth < max_levels:
        depth += 1
        seen = reduce(DataFrame.unionByName, [x.select("source", "node") for x, _ in kept])
        reached = frontier.select("source", F.col("node").alias("src")).join(hops, "src")
        found = reached.groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        found = found.join(seen, ["source", "node"], "left_anti")
        frontier, more = materialize_some(found.select("source", "node", F.lit(depth).alias("level"), "parent"), "bfs")
        if not more:
            break
        kept.append((frontier, 1))
        while len(kept) >= 8 and len({n for _, n in kept[-8:]}) == 1:
            parts = [x for x, _ in kept[-8:]]
            kept[-8:] = [(materialize(reduce(DataFrame.unionByName, parts), "bfs"), 8 * kept[-1][1])]
            discard(*[x for x in parts if x is not frontier])
    return reduce(DataFrame.unionByName, [x for x, _ in kept])


def walk_parents(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, node, path) from the root to each end along (source, node, parent)."""
    tree = materialize(tree.select("source", "node", "parent"), "tree")
    # a path passes its end and nodes that have children, in most trees a small part
    inner = tree.select("source", F.col("parent").alias("node")).distinct()
    keyed = materialize(tree.join(inner, ["source", "node"], "left_semi").select("source", F.col("node").alias("_at"), F.col("parent").alias("_up")), "tree")
    open_ = tree.join(ends, ["source", "node"], "left_semi").select(
        "source", "node", F.array("node").alias("path"), F.col("parent").alias("_next"))
    done = []
    while True:
        open_, more = materialize_some(open_, "walk", F.col("_next").isNotNull())
        done.append(open_.filter("_next is null").select("source", "node", "path"))
        rest = open_.filter("_next is not null")
        if not more:
            return reduce(DataFrame.unionByName, done)
        open_ = rest.join(keyed, (rest["source"] == keyed["source"]) & (rest["_next"] == keyed["_at"])).select(
            rest["source"], "node", F.concat(F.array("_at"), "path").alias("path"), F.col("_up").alias("_next"))


def find_path(edges: DataFrame, start, end) -> DataFrame:
    """One path with the fewest hops, as an array; no row when unreachable."""
    starts = edges.sparkSession.range(1).select(F.lit(start).alias("id"))
    tree = bfs_levels(edges, starts)
    return walk_parents(tree, tree.filter(F.col("node") == F.lit(end)).select("source", "node"))


def shortest_distances(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, bool]:
    """((source, node, dist, parent), negative cycle found?) by relaxation rounds.

    ``edges`` are directed (src, dst, w). Only nodes improved in the last round
    relax their edges. Without a negative cycle it ends within |V| - 1 rounds.
    """
    hops = edges.groupBy("src", "dst").agg(F.min("w").cast("double").alias("w"))
    hops = materialize(hops, "hops")
    n = hops.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(starts.select("id")).distinct().count()
    state = materialize(starts.select(
        F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist"),
        F.when(F.lit(False), F.col("id")).alias("parent"), F.lit(0).alias("round")), "sssp")
    for turn in range(1, n + 1):
        moved = state.filter(F.col("round") == turn - 1).select("source", F.col("node").alias("src"), "dist")
        offers = moved.join(hops, "src").groupBy("source", F.col("dst").alias("node")).agg(
            F.min(F.struct((F.col("dist") + F.col("w")).alias("d"), F.col("src").alias("p"))).alias("_o"))
        before = state
        both = state.join(offers, ["source", "node"], "full_outer")
        better = F.col("_o").isNotNull() & (F.col("dist").isNull() | (F.col("_o.d") < F.col("dist")))
        state, moved_on = materialize_some(both.select(
            "source", "node", F.when(better, F.col("_o.d")).otherwise(F.col("dist")).alias("dist"),
            F.when(better, F.col("_o.p")).otherwise(F.col("parent")).alias("parent"),
            F.when(better, F.lit(turn)).otherwise(F.col("round")).alias("round")), "sssp", F.col("round") == turn)
        discard(before)
        if not moved_on:
            return state.drop("round"), False
    return state.drop("round"), True


#: Sources whose costs stand side by side in a row, and one more than the hops that fit into a cost kept as one number.
SLOTS, HOPS = 16, 1 << 16
#: Labels that are written anew in each round; of more of them only those that became less.
REWRITTEN = 100_000


def weighted_levels(edges: DataFrame, starts: DataFrame, width=None) -> DataFrame:
    """(source, node, dist, hops, parent): least weight, then fewest hops, then the smallest parent.

    ``edges`` are directed (src, dst, w) of weights that are not negative (else ValueError; NULL weights are no edges),
    ``starts`` has ``id``; integers and decimals stay exact. ``edges`` are read a few times, not once for each round: write
    them first if they are dear to build. Costs are relaxed until nothing changes, first over the edges
    no heavier than ``width`` (by default about four for each node). What that finds bounds every distance from above and,
    up to ``width``, from below. Then only the edges count that can keep to these bounds, ties included, and that leave a
    labelled node; edges out of sight of the starts are never grouped. A row holds the costs of a node from up to ``SLOTS``
    sources, and a round is one job that writes what became less. Parents are read off the final costs.
    """
    hops = edges.filter("w is not null and src <> dst").select("src", "dst", "w")
    weight = hops.schema["w"].dataType
    whole = isinstance(weight, IntegralType)
    # weights by sixteenths of their binary logarithm; no other column is read for that
    scale = F.when(F.col("w") > 0, F.floor(16 * F.log2(F.col("w").cast("double"))))
    spread = sorted(edges.filter("w is not null").groupBy(scale.alias("scale")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most")).collect(),
                    key=lambda r: r.most)
    if spread and min(r.least for r in spread) < 0 and not hops.filter("w < 0").isEmpty():
        raise ValueError("negative weights need shortest_distances")
    ids = materialize(starts.select(F.col("id").alias("source")).distinct(), "starts")
    alone = ids.select("source", F.col("source").alias("node"), F.lit(0).cast(weight).alias("dist"), F.lit(0).alias("hops"),
                       F.when(F.lit(False), F.col("source")).alias("parent"))
    if not spread:
        return alone
    most = spread[-1].most
    width = min(_weight_of_few(edges, spread) if width is None else width, most)
    width = math.floor(width) if whole else width
    sources = materialize(with_position(ids.filter("source is not null"), ["source"], "_i").select(
        "source", F.expr(f"_i div {SLOTS}").alias("chunk"), F.expr(f"cast(_i % {SLOTS} as int)").alias("slot")), "sources")
    # whole weights and hops are kept as one number where no sum of weights can run over it
    found = _least_costs(hops, sources, width, most, _Packed(weight)) if whole and most < 2**31 else None
    costs, labels, parents = found or _least_costs(hops, sources, width, most, _Costs(weight))
    each = [F.struct(F.lit(k).alias("slot"), F.col(f"c{k}").alias("cost"), F.col(f"p{k}").alias("parent")) for k in range(len(labels.columns) - 2)]
    rows = labels.join(parents, ["chunk", "node"], "left").select("chunk", "node", F.explode(F.array(*each)).alias("_e"))
    rows = rows.filter("_e.cost is not null").select("chunk", "node", "_e.*").join(sources, ["chunk", "slot"])
    rows = rows.select("source", "node", F.expr(costs.dist("cost")).cast(weight).alias("dist"), F.expr(costs.hops("cost")).alias("hops"), "parent")
    return rows.unionByName(alone.filter("source is null"))


def _weight_of_few(edges: DataFrame, spread: list):
    """The weight up to which there are about four edges for each node: the largest of a scale in ``spread``."""
    nodes, found = edges.agg(F.approx_count_distinct("src").alias("n")).first().n, 0
    if sum(r.n for r in spread) > 8 * nodes:
        for r in spread:
            found += r.n
            if found >= 4 * nodes:
                return r.most
    return spread[-1].most


class _Costs:
    """Costs as structs of a distance and hops, in any type of weight; all methods give SQL, which is quick to build in wide rounds."""

    rounds = None

    def __init__(self, weight):
        self.weight, self.kind = weight, weight.simpleString()

    def step(self, w: str) -> str:
        return w

    def start(self) -> str:
        return f"named_struct('dist', cast(0 as {self.kind}), 'hops', 0)"

    def plus(self, cost: str, step: str) -> str:
        return f"CASE WHEN {cost} IS NOT NULL THEN named_struct('dist', cast({cost}.dist + {step} as {self.kind}), 'hops', {cost}.hops + 1) END"

    def dist(self, cost: str) -> str:
        return f"{cost}.dist"

    def hops(self, cost: str) -> str:
        return f"{cost}.hops"


class _Packed(_Costs):
    """Costs as one long, distance times ``HOPS`` and hops, for fewer than ``HOPS`` rounds and weights below 2^31."""

    rounds = HOPS - 1

    def step(self, w: str) -> str:
        return f"cast({w} as bigint) * {HOPS} + 1"

    def start(self) -> str:
        return "0L"

    def plus(self, cost: str, step: str) -> str:
        return f"{cost} + {step}"

    def dist(self, cost: str) -> str:
        return f"({cost} div {HOPS})"

    def hops(self, cost: str) -> str:
        return f"cast({cost} % {HOPS} as int)"


def _least_costs(hops: DataFrame, sources: DataFrame, width, most, costs: _Costs):
    """(``costs``, labels, parents): written tables (chunk, node, c0 ...) and (chunk, node, p0 ...); None if the rounds run out."""
    count = sources.agg(F.count(F.lit(1)).alias("n")).first().n
    slots = max(1, min(count, SLOTS))
    first = materialize(sources.select("chunk", F.col("source").alias("node"), *[
        F.expr(f"CASE WHEN slot = {k} THEN {costs.start()} END").alias(f"c{k}") for k in range(slots)]), "labels")
    labels = _Labels(first, count, costs)
    bar = F.lit(width).cast(costs.weight)
    few = materialize(hops if width >= most else hops.filter(F.col("w") <= bar), "hops")
    if not labels.settle(first, count, few):
        return None
    discard(few)
    passed, near = [], []
    while True:
        merged = labels.merged()
        fresh = merged.select("node").distinct()
        for before in passed:
            fresh = fresh.join(before, "node", "left_anti")
        fresh, some = materialize_some(fresh, "passed")
        if not some:
            break
        near.append(_near_hops(hops, labels.bounds(count), fresh if passed else None, bar, labels.sizes[0] > 200_000))
        passed.append(fresh)
        if width >= most:
            break  # relaxed over all edges, nothing is left to be found
        moved, n = labels.relax(merged if len(passed) == 1 else merged.join(fresh, "node", "left_semi"), near[-1])
        if not labels.settle(moved, n, reduce(DataFrame.unionByName, near)):
            return None
        if len(passed) > 8:
            passed, near = [_one_table(passed, "passed")], [_one_table(near, "hops")]
    parents = materialize(labels.parents(reduce(DataFrame.unionByName, near)) if near else labels.parents(hops.limit(0)), "parents")
    discard(*near, *passed)
    return costs, labels.merged(), parents


class _Labels:
    """The costs found so far: a base table and small tables of what became less, all of (chunk, node, c0 ...)."""

    def __init__(self, first: DataFrame, rows: int, costs: _Costs):
        self.tables, self.sizes, self.costs, self.turns = [first], [rows], costs, 0
        self.names = first.columns[2:]
        self.none = f"cast(null as {first.schema['c0'].dataType.simpleString()})"

    def relax(self, moved: DataFrame, around: DataFrame) -> tuple[DataFrame, int]:
        """One more hop from the moved rows: what became less, as a new table, and its number of rows."""
        self.turns += 1
        offers = moved.join(around.selectExpr("src", "dst as _to", f"{self.costs.step('w')} as _step"), F.col("node") == F.col("src")).selectExpr(
            "chunk", "_to as node", *[f"{self.none} as {c}" for c in self.names], *[f"{self.costs.plus(c, '_step')} as _{c}" for c in self.names])
        known = reduce(DataFrame.unionByName, self.tables).selectExpr("chunk", "node", *self.names, *[f"{self.none} as _{c}" for c in self.names])
        both = known.union(offers).groupBy("chunk", "node").agg(*[F.expr(f"min({c}) as {c}") for c in known.columns[2:]])
        less = [f"CASE WHEN {c} IS NULL OR _{c} < {c} THEN _{c} END" for c in self.names]
        some, seen = F.expr(" OR ".join(f"_{c} IS NOT NULL" for c in self.names)), Observation()
        if sum(self.sizes) <= REWRITTEN:
            written = both.selectExpr("chunk", "node", *[f"coalesce({x}, {c}) as {c}" for c, x in zip(self.names, less, strict=True)],
                                      *[f"{x} as _{c}" for c, x in zip(self.names, less, strict=True)])
            written = materialize(written.observe(seen, F.count_if(some).alias("n"), F.count(F.lit(1)).alias("all")), "labels")
            discard(*self.tables)
            self.tables, self.sizes = [_kept(written, "chunk", "node", *self.names)], [seen.get["all"]]
            return written.filter(some).selectExpr("chunk", "node", *[f"_{c} as {c}" for c in self.names]), seen.get["n"]
        better = both.selectExpr("chunk", "node", *[f"{x} as _{c}" for c, x in zip(self.names, less, strict=True)]).filter(some)
        better = materialize(better.toDF("chunk", "node", *self.names).observe(seen, F.count(F.lit(1)).alias("n")), "labels")
        self.tables.append(better)
        self.sizes.append(seen.get["n"])
        if len(self.tables) > 8 or sum(self.sizes[1:-1]) > self.sizes[0]:
            *old, last = self.tables
            self.tables = [materialize(self._least(old), "labels"), last]
            self.sizes = [sum(self.sizes[:-1]), self.sizes[-1]]
            discard(*old)
        return better, seen.get["n"]

    def settle(self, moved: DataFrame, n: int, around: DataFrame) -> bool:
        """Relaxes until nothing changes; False if the rounds run out."""
        while n:
            if self.turns == self.costs.rounds:
                return False
            moved, n = self.relax(moved, around)
        return True

    def merged(self) -> DataFrame:
        """All costs as one written table."""
        if len(self.tables) > 1:
            old, self.tables, self.sizes = self.tables, [materialize(self._least(self.tables), "labels")], [sum(self.sizes)]
            discard(*old)
        return self.tables[0]

    def _least(self, tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables).groupBy("chunk", "node").agg(*[F.min(c).alias(c) for c in self.names])

    def bounds(self, count: int) -> DataFrame:
        """(node, least, most) distance over all sources; most is NULL for a node that some source has not reached."""
        found = [F.col(c) for c in self.names]
        least, most = (F.least(*found), F.greatest(*found)) if len(found) > 1 else (found[0], found[0])
        reached = reduce(Column.__add__, [c.isNotNull().cast("int") for c in found])
        rows = self.merged().groupBy("node").agg(F.min(least).alias("least"), F.max(most).alias("most"), F.sum(reached).alias("n"))
        return materialize(rows.selectExpr("node", f"{self.costs.dist('least')} as least",
                                           f"CASE WHEN n = {count} THEN {self.costs.dist('most')} END as most"), "bounds")

    def parents(self, around: DataFrame) -> DataFrame:
        """(chunk, node, p0 ...): the smallest node whose cost and edge make up the cost of the node."""
        own = self.merged()
        ends = own.selectExpr("chunk as _chunk", "node as _to", *[f"{c} as _{c}" for c in self.names])
        pairs = own.join(around.selectExpr("src", "dst as _at", f"{self.costs.step('w')} as _step"), F.col("node") == F.col("src"))
        pairs = pairs.join(ends, (F.col("_at") == F.col("_to")) & (F.col("chunk") == F.col("_chunk")))
        fits = [f"{self.costs.plus(c, '_step')} = _{c}" for c in self.names]
        return pairs.filter(" OR ".join(f"({f})" for f in fits)).groupBy("chunk", F.col("_to").alias("node")).agg(
            *[F.expr(f"min(CASE WHEN {f} THEN src END) as p{k}") for k, f in enumerate(fits)])


def _near_hops(hops: DataFrame, bounds: DataFrame, fresh: DataFrame | None, bar: Column, many: bool) -> DataFrame:
    """The edges (src, dst, w) from labelled (or only ``fresh``) nodes that can be part of a best path, written.

    ``bounds`` is a table that goes. A distance above ``bar`` may still become less, though not below ``bar``.
    Of ``many`` labelled nodes the bound at the far end leaves fewer edges than the near end.
    """
    into = bounds.select(F.col("node").alias("dst"), "most")
    out = bounds if fresh is None else bounds.join(fresh, "node", "left_semi")
    out = out.select(F.col("node").alias("src"), F.least(F.col("least"), bar).cast(bounds.schema["least"].dataType).alias("least"))
    far = F.col("most").isNull()
    if many and fresh is None:
        rows = hops.join(into, "dst", "left").filter(far | (F.col("w") <= F.col("most"))).join(out, "src")
    else:
        rows = hops.join(out, "src").join(into, "dst", "left")
    rows = rows.filter(far | ((F.col("least") + F.col("w")).cast(bounds.schema["least"].dataType) <= F.col("most")))
    near = materialize(rows.groupBy("src", "dst").agg(F.min("w").alias("w")), "hops")
    discard(bounds)
    return near


def _one_table(tables: list[DataFrame], label: str) -> DataFrame:
    """The rows of all the tables as one written table; the tables go."""
    whole = materialize(reduce(DataFrame.unionByName, tables), label)
    discard(*tables)
    return whole


def all_simple_paths(edges: DataFrame, start, end, max_hops: int | None = None) -> DataFrame:
    """Every path (array) without a repeated node, of at most ``max_hops`` edges if that is given."""
    hops = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "hops")
    growing = edges.sparkSession.range(1).select(F.lit(start).alias("src"), F.array(F.lit(start)).alias("path"))
    done = []
    for _ in count() if max_hops is None else range(max_hops):
        longer = growing.join(hops, "src").filter(~F.array_contains("path", F.col("dst")))
        longer, more = materialize_some(longer.select(F.col("dst").alias("src"), F.array_append("path", F.col("dst")).alias("path")), "paths")
        done.append(longer.filter(F.col("src") == F.lit(end)).select("path"))
        growing = longer.filter(F.col("src") != F.lit(end))
        if not more:
            break
    return reduce(DataFrame.unionByName, done)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component = smallest node id; direction is ignored.

    The components of a few links of each node (its least and greatest neighbour above and below it) are found first. They
    hold together most of what all links do, so of all links, whose ends are then replaced by their components once, only
    those between different ones go on. Minima are map-side combined aggregates, never lists of neighbours.
    """
    links = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = materialize(links, "links")
    above = links.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("z")).select("u", F.explode(F.array("a", "z")).alias("v"))
    below = links.groupBy("v").agg(F.min("u").alias("a"), F.max("u").alias("z")).select(F.explode(F.array("a", "z")).alias("u"), "v")
    few, some = materialize_some(above.unionByName(below).distinct(), "few")
    heads = None
    if some:
        heads = _merged(few)
        rest, more = materialize_some(_between(links, heads), "links")
        if more:
            heads = _followed(heads, _merged(rest))
        else:
            discard(rest)
    else:
        discard(few)
    discard(links)
    if heads is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(heads, "id", "left").select("id", F.coalesce("head", "id").alias("component"))


def _merged(links: DataFrame) -> DataFrame:
    """(id, head) of every node that is not the smallest of its component under ``links`` (u > v), a written table that goes.

    Each round every node hooks on its least neighbour if that is smaller, hooks are followed to their end by pointer
    doubling, and links between different heads go on. Whatever has a link is merged within two rounds, so the rounds are
    logarithmic in the number of nodes.
    """
    heads, more = None, True
    while more:
        hooks, moving = materialize(links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("head")), "heads"), True
        while moving:
            up = hooks.select(F.col("id").alias("_id"), F.col("head").alias("_head"))
            jumped = hooks.join(up, F.col("head") == F.col("_id"), "left").select(
                "id", F.coalesce("_head", "head").alias("head"), F.col("_head").isNotNull().alias("moved"))
            before = hooks
            hooks, moving = materialize_some(jumped, "heads", F.col("moved"))
            discard(before)
            hooks = _kept(hooks, "id", "head")
        before = links
        links, more = materialize_some(_between(links, hooks), "links")
        discard(before)
        heads = hooks if heads is None else _followed(heads, hooks)
    discard(links)
    return heads


def _kept(table: DataFrame, *names: str) -> DataFrame:
    """Columns of a written table, which can still be discarded."""
    kept = table.select(*names)
    kept._scratch_path = table._scratch_path
    return kept


def _between(links: DataFrame, heads: DataFrame) -> DataFrame:
    """The different links (u > v) between different heads."""
    for end in ("u", "v"):
        own = heads.select(F.col("id").alias(end), F.col("head").alias(f"_{end}"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).select("u", "v")
    return links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _followed(heads: DataFrame, hooks: DataFrame) -> DataFrame:
    """``heads`` led on by the ``hooks`` of some of them, written; both tables go."""
    on = hooks.select(F.col("id").alias("_id"), F.col("head").alias("_head"))
    moved = heads.join(on, F.col("head") == F.col("_id"), "left").select("id", F.coalesce("_head", "head").alias("head"))
    whole = materialize(moved.unionByName(hooks), "heads")
    discard(heads, hooks)
    return whole


def is_connected(nodes: DataFrame, edges: DataFrame) -> bool:
    """True for one component, and for the empty graph."""
    found = connected_components(nodes, edges).select("component").distinct().limit(2).count()
    return found <= 1
