"""Conversation prefix trie by ROLLUP over positional turn columns.

A turn's id is the MD5 of its role and text with its number of characters; turns are columns by position, ``WIDTH`` to a
block. ``GROUP BY top, ROLLUP(t0, ..., t7)`` aggregates all prefixes of a block together, and ``grouping_id`` says which.
Conversations longer than a block go on in the next block of columns, keyed by the node they have reached (``top``).
A node is named by its depth and its smallest member, which no other node of that depth has. A conversation that is alone
in its node is not rolled up any further: the rest of its path is a chain that follows from its turns by a projection.
So there are as many rounds as blocks in the longest prefix that two conversations share, and none for turns beyond.

Sums over subtrees come from a second ROLLUP over the nodes (not the members), from the last block to the first: what a
block adds up for its ``top`` is added to that node of the block before.

The hash over the members that end in a node takes them in order, so it can only be made in one go; ids are joined to
strings of at most ``CHUNK`` ids in parallel, and a task reads the strings of a node as a stream, in constant memory.

Defined cases: turns are ordered by number, null first, equal numbers by the MD5 of role and text; null role or text is
empty; rows without a conversation id belong to none; repeated rows are turns as often as they stand; an empty table
gives no rows, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.ordered import ordered_window, row_number
from loomline.session import discard, materialize, materialize_some

WIDTH = 8
#: Conversations c take up to ``HEADS - 1`` turns of conversation c - c % ``FAMILY``.
FAMILY, HEADS = 100, 6
CHUNK = 65_536
_ID_BYTES = 16
_NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, p, d, n): conversation, place from 0, MD5 of role and text, characters of the text."""
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), digest.alias("d"), F.length(text).alias("n"))
    placed = ordered_window(turns.filter("c IS NOT NULL"), [F.col("turn").asc_nulls_first(), F.col("d")], {"p": row_number()}, ["c"])
    return placed.select("c", (F.col("p") - 1).alias("p"), "d", "n")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of their family's first one, h = crc32(id) % heads, and go on with
    their own turns after the first h: the turns (c, p, d, n) and the conversations (c, len)."""
    c = F.col("c")
    lengths = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own")).select(
        "c", "own", (c - c % family).alias("b"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    lengths = materialize(lengths, "lengths")
    first = lengths.select(F.col("c").alias("b"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    plan = lengths.join(first, "b", "left").select("c", "b", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    plan = materialize(plan, "plan")
    lead = turns.filter(F.col("p") < heads - 1).withColumnRenamed("c", "b").join(plan.select("c", "b", "taken"), "b").filter("p < taken")
    rest = turns.join(plan.select("c", "h", "taken"), "c").filter("p >= h")
    both = lead.select("c", "p", "d", "n").unionByName(rest.select("c", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "d", "n"))
    # by place, so that a later block reads only the files that hold its places
    out = materialize(both.repartitionByRange("p", "c"), "turns"), materialize(plan.select("c", "len"), "convs")
    discard(lengths, plan)
    return out


def _columns(width: int) -> list[str]:
    return [f"t{k}" for k in range(width)]


def _rollup(rows: DataFrame, sums: str, width: int) -> DataFrame:
    """All prefixes of a block: ``top``, the columns, ``level`` (columns in the prefix) and the sums."""
    names = ", ".join(_columns(width))
    rolled = rows.sparkSession.sql(
        f"SELECT top, {names}, {width} - bit_count(grouping_id()) AS level, {sums} FROM {{rows}} GROUP BY top, ROLLUP({names})", rows=rows)
    # a conversation that ends within the block has nulls after its end; these are no turns
    real = F.col("level") == 0
    for k, name in enumerate(_columns(width), 1):
        real = real | ((F.col("level") == k) & F.col(name).isNotNull())
    return rolled.filter(real)


def _key(width: int) -> Column:
    """The ids of the prefix one after the other."""
    return F.concat(*[F.coalesce(F.col(name)["d"], F.lit(b"")) for name in _columns(width)])


def _block_rows(turns: DataFrame, waiting: DataFrame, base: int, width: int) -> DataFrame:
    """(c, len, top, t0, ...) for the conversations that are still shared."""
    here = turns.filter((F.col("p") >= base) & (F.col("p") < base + width))
    listed = here.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "d", "n"))).alias("own"))
    turn = lambda k: F.when(F.size("own") > k, F.struct(F.get("own", F.lit(k))["d"].alias("d"), F.get("own", F.lit(k))["n"].alias("n")))
    return waiting.join(listed, "c", "left").select("c", "len", "top", *[turn(k).alias(name) for k, name in enumerate(_columns(width))])


def trie(turns: DataFrame, conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of the conversations (c, len) with their turns (c, p, d, n): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    root = conversations.agg(F.min("c").alias("c")).first().c
    names = _columns(width)
    waiting, going = conversations.select("c", "len", F.lit(root).cast("long").alias("top")), root is not None
    blocks, ended, alone = [], [], []
    while going:
        base = width * len(blocks)
        rows = materialize(_block_rows(turns, waiting, base, width), "rows")
        rolled = _rollup(rows, "min(c) AS conv_id, count(1) AS n_convs, max(len) AS longest", width)
        nodes = rolled if not blocks else rolled.filter("level > 0")
        nodes = materialize(nodes.withColumn("key", _key(width)), "nodes")
        above = nodes.select("top", F.col("key").alias("up"), F.col("conv_id").alias("above"))
        up = F.substring("key", F.lit(1), (F.col("level") - 1) * _ID_BYTES)
        deep = nodes.filter("level > 1").withColumn("up", up).join(above, ["top", "up"]).select(*nodes.columns, F.col("above").alias("parent"))
        blocks.append(materialize(nodes.filter("level <= 1").withColumn("parent", F.col("top")).unionByName(deep), "block"))
        reached = rows.select("c", "len", "top", _key(width).alias("key")).join(nodes.select("top", "key", "conv_id", "n_convs"), ["top", "key"])
        reached = materialize(reached.select("c", "len", F.col("conv_id").alias("top"), "n_convs"), "reached")
        ended.append(reached.filter(F.col("len") <= base + width).select(F.col("len").alias("depth"), F.col("top").alias("conv_id"), "c"))
        further = reached.filter(F.col("len") > base + width)
        alone.append(further.filter("n_convs = 1").select("c", "len", F.lit(base + width).alias("start")))
        waiting, going = materialize_some(further.filter("n_convs > 1").select("c", "len", "top"), "waiting")
        discard(rows, nodes)
    kind = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    found = _summed(blocks, width) if blocks else turns.sparkSession.createDataFrame([], kind)
    if alone:
        chains = turns.filter(F.col("p") >= width).join(_union(alone), "c").filter("p >= start")
        found = found.unionByName(chains.select(
            F.col("c").alias("conv_id"), (F.col("p") + 1).alias("depth"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            (F.col("p") + 1 < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
        ended.append(_union(alone).select(F.col("len").alias("depth"), F.col("c").alias("conv_id"), "c"))
    ends = ends_hashes(_union(ended)) if ended else turns.sparkSession.createDataFrame([], "depth long, conv_id long, ends_sha256 string")
    return found.join(ends, ["depth", "conv_id"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _summed(blocks: list[DataFrame], width: int) -> DataFrame:
    """The nodes with their children, and the leaves and saved tokens of their subtrees."""
    names, below, out = _columns(width), None, []
    for b in range(len(blocks) - 1, -1, -1):
        base, level = b * width, F.col("level")
        chars = F.coalesce(*[F.when(level == k, F.col(name)["n"]) for k, name in enumerate(names, 1)], F.lit(0))
        leaf, chain = F.col("longest") == base + level, (level == width) & (F.col("n_convs") == 1) & (F.col("longest") > base + width)
        own = blocks[b].select("top", *names, "level", "conv_id", "n_convs", "parent", (leaf | chain).cast("long").alias("leaves"),
                               ((F.col("n_convs") - 1) * chars).alias("saved"), chain.cast("long").alias("further"))
        if below is not None:
            own = own.join(below, (level == width) & (F.col("conv_id") == F.col("b_top")), "left").select(
                "top", *names, "level", "conv_id", "n_convs", "parent", *[(F.col(k) + F.coalesce(f"b_{k}", F.lit(0))).alias(k) for k in ("leaves", "saved", "further")])
        counts = ", ".join(f"count_if(level = {k}) AS c{k}" for k in range(1, width + 1))
        # of a node and those below it, the node itself has the smallest member, the most members and the smallest parent
        rolled = _rollup(own.withColumnRenamed("level", "at").withColumn("level", F.col("at")), "min(conv_id) AS conv_id, max(n_convs) AS n_convs, min(parent) AS parent, "
                         f"sum(leaves) AS leaves, sum(saved) AS saved, sum(further) AS further, {counts}", width)
        children = F.coalesce(*[F.when(level == k, F.col(f"c{k + 1}")) for k in range(width)], F.col("further"))
        rolled = materialize(rolled.withColumn("children", children), "summed")
        nodes = rolled if b == 0 else rolled.filter("level > 0")
        out.append(nodes.select("conv_id", (level + base).cast("long").alias("depth"), F.when(level + base > 0, F.col("parent")).alias("parent_conv_id"), "n_convs",
                                F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
        below = rolled.filter("level = 0").select(F.col("top").alias("b_top"), F.col("leaves").alias("b_leaves"), F.col("saved").alias("b_saved"), F.col("children").alias("b_further"))
    return _union(out)


def ends_hashes(ended: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of the members c that end in each node, in ascending order."""
    chunk = F.floor(F.col("c") / CHUNK)
    pieces = ended.groupBy("depth", "conv_id", chunk.alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def rows() -> pa.RecordBatch:
            depths, ids, hashes = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(depths, pa.int64()), pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["depth", "conv_id", "ends_sha256"])

        for batch in batches:
            depths, nodes, _, ids = batch.columns
            for depth, node, text in zip(depths.to_pylist(), nodes.to_pylist(), ids):
                if (depth, node) == now:
                    state.update(b"," + text.as_buffer())
                    continue
                if state:
                    done.append((*now, state.hexdigest()))
                now, state = (depth, node), hashlib.sha256(text.as_buffer())
            if done:
                yield rows()
        if state:
            done.append((*now, state.hexdigest()))
            yield rows()

    return ordered.select(F.col("depth").cast("long"), "conv_id", "chunk", "ids").mapInArrow(hashed, "depth long, conv_id long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, width: int = WIDTH, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of the rebuilt conversations."""
    numbered = materialize(numbered_turns(conversations), "numbered")
    turns, each = rebuilt(numbered, family, heads)
    discard(numbered)
    return trie(turns, each, width)


def oracle() -> str:
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), "
           "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)")
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY p) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % {FAMILY} AS b, {crc} % {HEADS} AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(o.own[1:h], []), h.own[h + 1:]) AS w FROM h LEFT JOIN o ON o.conv_id = h.b),
m AS (SELECT conv_id, w, unnest(range(len(w) + 1)) AS depth FROM c),
n AS (SELECT w[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(w) = depth), '') AS ends FROM m GROUP BY ALL),
k AS (SELECT *, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children,
  CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].t) ELSE 0 END AS saved FROM n),
a AS (SELECT path, depth, unnest(range(depth + 1)) AS up, n_children, saved FROM k),
s AS (SELECT path[1:up] AS path, up AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s ON s.depth = k.depth AND s.path = k.path LEFT JOIN n AS u ON u.depth = k.depth - 1 AND u.path = k.path[1:k.depth - 1]"""
