"""Dependency tables: ``items(id, ...)`` and ``deps(item, depends_on)``."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomline.operators.graph.tours import list_sums
from loomline.session import discard, materialize, materialize_some


#: Layers from here on belong to items on or behind a cycle.
_NEVER = 1 << 60
#: Ways over an item of more dependencies are not tried when edges are thinned out; that costs rounds, never results.
_FEW = 8


def topological_layers(items: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, layer): 0 without dependencies, else 1 + the deepest dependency's layer.

    Items on or behind a cycle get a NULL layer; a NULL dependency is none. The layer of an item with one dependency is
    ``max(base, layer of that one + w)``, and such steps put together are again one such step. So all items of at most one
    open dependency are folded into what they hang on by pointer doubling, the others' edges then lead there (the longest
    of equal ends stays, known layers go into ``base``), and this repeats with the items left: a chain of any length is
    one round, and what no round can fold any more is cyclic.
    """
    links = deps.select("item", "depends_on")
    nodes = items.select("id").unionByName(links.select(F.col("item").alias("id"))).unionByName(links.select(F.col("depends_on").alias("id")))
    nodes = nodes.filter("id IS NOT NULL").distinct().withColumn("base", F.lit(0).cast("long"))
    looped = links.filter("item = depends_on").select(F.col("item").alias("id")).distinct()
    nodes = materialize(nodes.join(looped.withColumn("_loop", F.lit(True)), "id", "left").select(
        "id", F.when(F.col("_loop"), F.lit(_NEVER)).otherwise(F.col("base")).alias("base")), "open")
    edges = materialize(links.filter("depends_on IS NOT NULL").distinct().join(
        looped.withColumnRenamed("id", "item"), "item", "left_anti").select("item", "depends_on", F.lit(1).cast("long").alias("w")), "deps")
    folded = []
    while True:
        edges = _without_shorter_ways(edges)
        ways = edges.groupBy(F.col("item").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("depends_on").alias("up"), F.max("w").alias("w"))
        state, many = materialize_some(nodes.join(ways, "id", "left").select("id", "base", "up", "w", F.coalesce("n", F.lit(0)).alias("n")), "open", F.col("n") > 1)
        thin = state.filter("n <= 1").select("id", "up", "w", "base")
        if many and thin.isEmpty():
            folded.append(state.select("id", F.col("up"), "w", F.lit(_NEVER).alias("base")).withColumn("up", F.when(F.lit(False), F.col("up"))))
            break
        done = _fold(thin)
        folded.append(done)
        if not many:
            break
        ends = done.select(F.col("id").alias("depends_on"), F.lit(True).alias("_hit"), F.col("up").alias("_up"), F.col("w").alias("_w"), F.col("base").alias("_base"))
        thick = state.filter("n > 1").select("id", "base")
        told = edges.join(thick.select(F.col("id").alias("item")), "item", "left_semi").join(ends, "depends_on", "left").select(
            "item", F.when(F.col("_hit"), F.col("_up")).otherwise(F.col("depends_on")).alias("depends_on"),
            F.when(F.col("_hit"), F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"),
            F.when(F.col("_hit"), F.col("w") + F.col("_base")).otherwise(F.lit(0)).alias("base"))
        told = materialize(told, "told")
        bases = told.groupBy(F.col("item").alias("id")).agg(F.max(F.when(F.col("item") == F.col("depends_on"), F.lit(_NEVER)).otherwise(F.col("base"))).alias("_base"))
        before = edges
        nodes = materialize(thick.join(bases, "id").select("id", F.greatest("base", "_base").alias("base")), "open")
        still = nodes.filter(F.col("base") < _NEVER).select(F.col("id").alias("item"))
        edges = told.filter("depends_on IS NOT NULL").groupBy("item", "depends_on").agg(F.max("w").alias("w")).join(still, "item", "left_semi")
        edges = materialize(edges, "deps")
        discard(before, told, state)
    known = folded[0] if len(folded) == 1 else _fold(materialize(reduce(DataFrame.unionByName, folded), "folded"))
    return known.select("id", F.when(F.col("base") < _NEVER, F.col("base")).alias("layer"))


def _without_shorter_ways(edges: DataFrame) -> DataFrame:
    """``edges`` without those beside a way of two edges that is as long and stays itself, so layers and cycles are the same."""
    few = edges.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= _FEW).select("item")
    second = edges.join(few, "item", "left_semi").select(F.col("item").alias("mid"), F.col("depends_on").alias("to"), F.col("w").alias("w2"))
    first = edges.select("item", F.col("depends_on").alias("mid"), F.col("w").alias("w1"))
    ways = first.join(second, "mid").filter("item <> to").select("item", "mid", F.col("to").alias("depends_on"), (F.col("w1") + F.col("w2")).alias("way"))
    beside, some = materialize_some(edges.join(ways, ["item", "depends_on"]).filter("way >= w").select("item", "mid", "depends_on"), "beside")
    if not some:
        return edges
    doubtful = beside.select("item", "depends_on").distinct()
    sure = beside.join(doubtful.withColumnRenamed("depends_on", "mid"), ["item", "mid"], "left_anti").join(
        doubtful.withColumnRenamed("item", "mid"), ["mid", "depends_on"], "left_anti").select("item", "depends_on").distinct()
    return materialize(edges.join(sure, ["item", "depends_on"], "left_anti"), "deps")


def _fold(steps: DataFrame) -> DataFrame:
    """``steps`` (id, up, w, base), each put together with those it leads to until ``up`` is none of them, or NULL.

    Steps on or behind a circle end with ``up`` NULL and a ``base`` of ``_NEVER``.
    """
    seen = Observation()
    steps = materialize(steps.withColumn("going", F.col("up").isNotNull()).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("going")).alias("going")), "fold")
    rounds, going = seen.get["n"].bit_length() + 2, seen.get["going"] > 0
    while going and rounds > 0:
        # two doublings in one job: tables of few rows spend more on jobs than on joins
        after, going = materialize_some(_folded_once(_folded_once(steps)), "fold", F.col("going"))
        discard(steps)
        steps, rounds = after, rounds - 2
    return steps.select("id", F.when(~F.col("going"), F.col("up")).alias("up"), "w", F.when(F.col("going"), F.lit(_NEVER)).otherwise(F.col("base")).alias("base"))


def _folded_once(steps: DataFrame) -> DataFrame:
    far = steps.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("w").alias("_w"), F.col("base").alias("_base"))
    hit = F.col("_id").isNotNull()
    moved = steps.filter("going").join(far, F.col("up") == F.col("_id"), "left").select(
        "id", F.when(hit, F.col("_up")).otherwise(F.col("up")).alias("up"),
        F.when(hit, F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"),
        F.when(hit, F.greatest(F.col("base"), F.col("w") + F.col("_base"))).otherwise(F.col("base")).alias("base"),
        (hit & F.col("_up").isNotNull()).alias("going"))
    return steps.filter("not going").unionByName(moved)


def ready_items(items: DataFrame, deps: DataFrame, pending: str = "pending", completed: str = "completed") -> DataFrame:
    """Pending items all of whose dependencies are completed; none at all is ready."""
    status = items.select(F.col("id").alias("depends_on"), F.col("status").alias("_s"))
    blocked = deps.join(status, "depends_on", "left").filter(~F.col("_s").eqNullSafe(completed))
    waiting = items.filter(F.col("status") == pending)
    return waiting.join(blocked.select(F.col("item").alias("id")), "id", "left_anti")


def cyclic_core(deps: DataFrame) -> DataFrame:
    """The edges left after removing, again and again, items without a way in or out."""
    core = materialize(deps.select("item", "depends_on").distinct(), "core")
    size = core.count()
    while True:
        inner = core.select(F.col("depends_on").alias("item")).distinct()
        outer = core.select(F.col("item").alias("depends_on")).distinct()
        trimmed = materialize(core.join(inner, "item", "left_semi").join(outer, "depends_on", "left_semi"), "core")
        left = trimmed.count()
        if left == size:
            return trimmed
        core, size = trimmed, left


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that lies on a cycle; component = smallest id that it reaches and that reaches it.

    ``edges`` are directed (src, dst); a loop is a cycle, rows with a NULL end are none. Ids are ordered by their hashes.
    Every node gets the first id that reaches it and, along edges within one such colour, the first that it reaches. Where
    both agree, the node is in that one's component. Found nodes go, edges between nodes that differ in either go too (no
    cycle passes them), and the rest begins again.
    """
    links, more = materialize_some(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    loops = links.filter("src = dst").select("src")
    found = []
    while more:
        ahead = _first_reaching(links)
        inside = materialize(_within(links, ahead, ["first"]), "inside")
        back = _first_reaching(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("first", "back")
        both = materialize(ahead.join(back, "id", "left").select("id", "first", F.coalesce("back", _ranked("id")).alias("back")), "both")
        found.append(both.filter("first = back").select("id", F.col("first.id").alias("_root")))
        rest, more = materialize_some(_within(inside, both.filter("first <> back"), ["first", "back"]), "links")
        discard(inside)
        links = rest
    if not found:
        return links.select(F.col("src").alias("id"), F.col("src").alias("component"))
    own = reduce(DataFrame.unionByName, found)
    names = own.groupBy("_root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("_n"))
    # a node alone in its component is on a cycle only by its own loop
    kept = names.join(loops, F.col("_root") == F.col("src"), "left").filter("_n > 1 OR src IS NOT NULL").select("_root", "component")
    return own.join(kept, "_root").select("id", "component")


def _ranked(name: str) -> Column:
    return F.struct(F.xxhash64(name).alias("rank"), F.col(name).alias("id"))


def _within(links: DataFrame, marked: DataFrame, names: list[str]) -> DataFrame:
    """The edges whose ends are both marked, and alike in the columns ``names``."""
    for end in ("src", "dst"):
        links = links.join(marked.select(F.col("id").alias(end), F.struct(*names).alias(f"_{end}")), end)
    return links.filter("_src = _dst").select("src", "dst")


def _first_reaching(edges: DataFrame) -> DataFrame:
    """(id, first): the first id, by rank, from which the node can be reached, itself included.

    What reaches the first one known so far reaches the node as well, so each round also looks up the value of the value:
    with ranks that do not follow the edges, the ways looked back on grow by a factor each round.
    """
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    state, more = materialize_some(ids.select("id", _ranked("id").alias("first")), "first")
    while more:
        offers = edges.join(state.select(F.col("id").alias("src"), F.col("first").alias("_o")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("_o").alias("_o"))
        near = state.join(offers, "id", "left").select("id", F.col("first").alias("was"), F.least("first", "_o").alias("first"))
        far = state.select(F.col("id").alias("_id"), F.col("first").alias("_far"))
        jumped = near.join(far, F.col("first.id") == F.col("_id")).select("id", "was", F.least("first", "_far").alias("first"))
        before = state
        state, more = materialize_some(jumped, "first", F.col("first") < F.col("was"))
        discard(before)
        state = state.select("id", "first")
    return state


def witness_cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, place, node): one cycle in each strong component, from its smallest node on, ``place`` from 0.

    Every node of a component steps to its smallest successor there; of the circles that these steps run into, the one
    with the smallest node is shown. Circles are found and ranked by pointer doubling, so their length does not matter, and
    a cycle is a row for each node, so none has to fit in one row.
    """
    own = materialize(strong_components(edges) if components is None else components, "components")
    inside = edges.select("src", "dst").join(own.select(F.col("id").alias("src"), "component"), "src").join(
        own.select(F.col("id").alias("dst"), F.col("component").alias("_c")), "dst").filter("component = _c")
    steps = materialize(inside.groupBy(F.col("src").alias("id"), "component").agg(F.min("dst").alias("next")), "steps")
    # after as many steps as there are nodes every place reached lies on a circle, and the least node seen from there is the circle's
    far = steps.select("id", F.col("next").alias("at"), F.least("id", "next").alias("least"))
    for _ in range(steps.count().bit_length()):
        on = far.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        after = materialize(far.join(on, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), F.least("least", "_least").alias("least")), "far")
        discard(far)
        far = after
    circles = steps.join(far.select(F.col("at").alias("id")).distinct(), "id", "left_semi").join(far.select("id", "least"), "id")
    first = circles.groupBy("component").agg(F.min("least").alias("_first"))
    circles = circles.join(first, "component").filter("least = _first")
    stops = materialize(circles.select("component", "id", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left")), "stops")
    ranked = list_sums(stops, ["left"]).select("id", "left").join(stops.select("id", "component"), "id")
    length = ranked.groupBy("component").agg(F.max("left").alias("_n"))
    return ranked.join(length, "component").select("component", (F.col("_n") - F.col("left")).alias("place"), F.col("id").alias("node"))


def find_cycles(deps: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Every simple dependency cycle, once, as a closed array; of at most ``max_hops`` edges if that is given.

    A cycle is grown from its smallest item only, which makes it unique.
    """
    links = cyclic_core(deps).select(F.col("item").alias("at"), F.col("depends_on").alias("to"))
    loops = [links.filter("at = to").select(F.array("at", "to").alias("cycle"))]
    paths = links.filter("at < to").select(F.col("at").alias("start"), F.col("to").alias("at"), F.array("at", "to").alias("path"))
    for hop in count(2) if max_hops is None else range(2, max_hops + 1):
        paths, more = materialize_some(paths, "cycles")
        step = paths.join(links, "at")
        loops.append(step.filter("to = start").select(F.array_append("path", F.col("to")).alias("cycle")))
        if hop == max_hops or not more:
            break
        grown = step.filter((F.col("to") > F.col("start")) & ~F.array_contains("path", F.col("to")))
        paths = grown.select("start", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path"))
    return reduce(DataFrame.unionByName, loops)
