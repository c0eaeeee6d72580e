"""Mixing sources to target weights by blocks of words.

The words of a source's documents, one document after the other, form blocks of ``BLOCK`` words, or
of a ``PARTS``-th of the source's words if that is less. A source's target is its weight's
part of ``share`` times all words, at most ``most`` times its size; what a source can't take goes to the others.
A target is met by whole passes over the source's blocks and a part of one more. Each output shard draws how many blocks
of which source it gets, from a multinomial over what the sources still have to give, so that the totals come out
exactly. The slots of a source are numbered over the shards; a keyed permutation (Feistel network with cycle
walking) maps them to blocks, another one in each pass; slots and documents meet by block number.

Only totals of sources and the drawn counts (sources times shards) come to the driver. Seeds are fixed and sources are
numbered by code point (null last), so reruns agree in whatever order the totals arrive.

Defined cases: a null text has no words and is taken 0 times; a null source is a source of its own, the last; equal
rows are taken each for itself; sources without words have target 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.columns import words
from loomline.llm.ranks import spread_rank
from loomline.session import materialize, shuffle_width

BLOCK, SHARDS, SEED = 128, 64, 20
#: Blocks that a source has at least, if it has as many words.
PARTS = 64
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
_PAIR = 1 << 17


def source_order(sizes: dict[str | None, int]) -> list[str | None]:
    """The sources by code point, null last."""
    return sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))


def block_width(size: int, block: int = BLOCK) -> int:
    """Words in a block of a source of ``size`` words."""
    return min(block, max(1, size // PARTS))


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source; weights repeat over the sources by code point, null last."""
    order = source_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    pool, wanted, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: pool * weight[s] / total for s in open_}
        full = [s for s in open_ if part[s] > most * sizes[s]]
        if not full:
            return wanted | part
        for s in full:
            wanted[s] = most * sizes[s]
            pool -= wanted[s]
        open_ = [s for s in open_ if s not in wanted]
    return wanted


def slot_counts(sizes: dict[str | None, int], wanted: dict[str | None, float], block: int = BLOCK, most: float = MOST) -> dict[str | None, int]:
    """Blocks to take of each source: whole passes, and the nearest number of a pass more."""
    out = {}
    for s, size in sizes.items():
        blocks = math.ceil(size / block_width(size, block))
        passes, rest = divmod(wanted[s], size) if size else (0, 0)
        out[s] = min(int(passes) * blocks + (round(rest / (size / blocks)) if size else 0), int(most) * blocks)
    return out


def shard_draws(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """[shard, source] multinomial draws that add up to ``slots``."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    drawn = np.zeros((shards, len(left)), np.int64)
    for t in range(shards):
        if t == shards - 1:
            drawn[t] = left
        else:
            want = int(left.sum()) // (shards - t)
            while want > 0:
                now = np.minimum(rng.multinomial(want, left / left.sum()), left)
                drawn[t] += now
                left = left - now
                want -= int(now.sum())
    return drawn


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 … size - 1 maps the indexes."""
    half = max(1, (max(2, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rng = np.random.default_rng(key)
    keys = rng.integers(1, 1 << 62, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ (mixed >> np.uint64(33) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (far := out >= size).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _slots(spark, rows: list[tuple], seed: int) -> DataFrame:
    """(shard, _source, _block) of every slot; ``rows``: (shard, source number, first slot, slots, blocks of the source)."""
    def run(batches):
        for batch in batches:
            for shard, source, first, n, blocks in zip(*[c.to_pylist() for c in batch.columns]):
                for at in range(first, first + n, _PAIR):
                    index = np.arange(at, min(at + _PAIR, first + n))
                    block = np.empty(len(index), np.int64)
                    for turn in range(int(index[0]) // blocks, int(index[-1]) // blocks + 1):
                        own = index // blocks == turn
                        block[own] = permuted(index[own] % blocks, blocks, seed * 1_000_003 + source * 101 + turn)
                    yield pa.record_batch([np.full(len(index), shard), np.full(len(index), source), block], names=["shard", "_number", "_block"])

    frame = spark.createDataFrame(rows, "shard long, source long, first long, n long, blocks long")
    return frame.repartition(shuffle_width(spark)).mapInArrow(run, "shard long, _number long, _block long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, shards: int = SHARDS,
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Every document with size, source_size, target, taken and ``pieces``: (first word, words, shards that take the piece).

    Columns named in ``keep`` come along.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        F.size(words(F.col(text_col).cast("string"))).cast("long").alias("size"),
                        *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)])
    sized = materialize(spread_rank(sized, ["source"], ["doc_id", "size"], [F.col("doc_id").asc_nulls_first(), "size"], "_row", running={"_start": "size"}), "sized")
    sizes = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    wanted = targets(sizes, weights, share, most)
    counts = slot_counts(sizes, wanted, block, most)
    order = source_order(sizes)
    drawn = shard_draws([counts[s] for s in order], shards, seed) if order else np.zeros((0, 0), np.int64)
    before = np.cumsum(drawn, axis=0) - drawn
    rows = [(t, k, int(before[t, k]), int(drawn[t, k]), math.ceil(sizes[s] / block_width(sizes[s], block)))
            for t in range(len(drawn)) for k, s in enumerate(order) if drawn[t, k]]
    table = spark.createDataFrame([(k, s, sizes[s], float(wanted[s]), block_width(sizes[s], block)) for k, s in enumerate(order)],
                                  "_number long, _source string, source_size long, target double, _width long")
    placed = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")))  # a row for each source

    last = F.expr("(_start + size - 1) div _width")
    pieces = placed.filter("size > 0").select("_number", "_row", "_start", "size", "_width", F.explode(F.sequence(F.expr("_start div _width"), last)).alias("_block"))
    low = F.greatest(F.col("_block") * F.col("_width"), F.col("_start"))
    high = F.least((F.col("_block") + 1) * F.col("_width"), F.col("_start") + F.col("size"))
    pieces = pieces.select("_number", "_row", "_block", (low - F.col("_start")).alias("first"), (high - low).alias("n"))
    # written, so that Spark plans the join by the slots' true size; by the size of the small table they come from it would broadcast them
    slots = materialize(_slots(spark, rows, seed), "slots")
    met = pieces.join(slots, ["_number", "_block"], "left").groupBy("_number", "_row", "_block", "first", "n").agg(F.collect_list("shard").alias("shards"))
    taken = met.groupBy("_number", "_row").agg(F.sum(F.col("n") * F.size("shards")).alias("taken"),
                                               F.array_sort(F.collect_list(F.struct("first", "n", "shards"))).alias("pieces"))
    joined = placed.join(taken, ["_number", "_row"], "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "pieces",
                         *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep) if c not in ("doc_id", "source")])


def mixed_texts(mixed: DataFrame, text_col: str = "text", most: int = int(MOST)) -> DataFrame:
    """The mix as rows: for each document and copy 1 to ``most``, the words of the pieces taken as often, in their order."""
    copies = mixed.withColumn("copy", F.explode(F.array(*[F.lit(c) for c in range(1, most + 1)])))
    taken = F.filter(F.col("pieces"), lambda p: F.size(p["shards"]) >= F.col("copy"))
    copies = copies.withColumn("_taken", F.coalesce(taken, F.array().cast(mixed.schema["pieces"].dataType))).filter(F.size("_taken") > 0)
    own = words(F.col(text_col))
    cut = F.transform(F.array(own), lambda w: F.array_join(F.flatten(F.transform(F.col("_taken"), lambda p: F.slice(
        w, (p["first"] + 1).cast("int"), p["n"].cast("int")))), " "))[0]
    whole = F.size("_taken") == F.size("pieces")
    return copies.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(cut)).drop("_taken")
