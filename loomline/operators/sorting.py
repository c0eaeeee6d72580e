"""Sorting, slicing, top-k and batching. ``order`` always ends in a unique column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.plans.ordered import with_position


def sort_rows(df: DataFrame, key: str, tiebreak: Sequence[str], reverse: bool = False) -> DataFrame:
    """Sorted rows, NULLs last; ties keep ``tiebreak`` order in both directions."""
    first = F.col(key).desc_nulls_last() if reverse else F.col(key).asc_nulls_last()
    return df.orderBy(first, *tiebreak)


FEW_ROWS = 100_000


def limit_offset(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """Slice of the ordered rows. A far or long slice is cut by position, not held by one task."""
    if offset + limit <= FEW_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed = with_position(df, order, "_pos")
    return placed.filter((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit)).drop("_pos")


def paginate(df: DataFrame, order: Sequence[str | Column], size: int) -> DataFrame:
    """Add 1-based ``page``, ``total_pages``, ``has_next`` and ``has_prev``."""
    placed = with_position(df, order, "_pos")
    total = placed.agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("total_pages"))
    paged = placed.withColumn("page", F.floor(F.col("_pos") / size).cast("bigint") + 1).drop("_pos")
    total = total.first()["total_pages"]
    return (paged.withColumn("total_pages", F.lit(total).cast("bigint"))
            .withColumn("has_next", F.col("page") < total).withColumn("has_prev", F.col("page") > 1))


def get_page(df: DataFrame, order: Sequence[str | Column], page: int, size: int) -> DataFrame:
    """One page; out of range gives no rows."""
    if page < 1:
        return df.limit(0)
    return limit_offset(df, order, size, (page - 1) * size)


def top_n(df: DataFrame, n: int, order: Sequence[Column | str], keys: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """First n rows of ``order``, overall or per key, with their rank.

    Per key the ``row_number() <= n`` filter is trimmed before the shuffle.
    """
    if not keys and n > FEW_ROWS:
        return with_position(df, order, rank, start=1).filter(F.col(rank) <= n)
    if not keys:
        few = df.orderBy(*order).limit(n)
        return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))


def merge_sorted_inputs(parts: Sequence[DataFrame], order: Sequence[str | Column]) -> DataFrame:
    """One sorted output with duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(*order)


def slice_step(df: DataFrame, order: Sequence[str | Column], start: int = 0, stop: int | None = None,
               step: int = 1, name: str = "pos") -> DataFrame:
    """Positions start, start+step, ... below stop."""
    placed = with_position(df, order, name)
    keep = (F.col(name) >= start) & ((F.col(name) - start) % step == 0)
    if stop is not None:
        keep = keep & (F.col(name) < stop)
    return placed.filter(keep)


def priority_batches(df: DataFrame, priority: Column, order: Sequence[str | Column], size: int) -> DataFrame:
    """Highest priority first, then ``order``; ``batch_id`` per ``size`` rows."""
    placed = with_position(df, [priority.desc(), *order], "pos")
    return placed.withColumn("batch_id", F.floor(F.col("pos") / size).cast("bigint"))


def assign_batches(df: DataFrame, order: Sequence[str | Column], size: int | None = None, chunks: int | None = None,
                   round_robin: int | None = None, floor_chunks: int | None = None,
                   max_leaf: int | None = None) -> DataFrame:
    """Batch numbers by closed forms on the row position.

    ``size``: fixed-size batches (``batch``). ``chunks``: n near-equal chunks, the
    first ones one longer (``chunk``). ``round_robin``: position modulo n
    (``slot``). ``floor_chunks``: chunks of n // parts rows, so maybe more than
    ``parts`` (``part``). ``max_leaf``: repeated halving until a piece has at most
    that many rows; ``leaf_start`` and ``leaf_rows`` of the piece.
    """
    placed = with_position(df, order, "pos")
    pos = F.col("pos")
    if size:
        placed = placed.withColumn("batch", F.floor(pos / size).cast("bigint"))
    if round_robin:
        placed = placed.withColumn("slot", pos % round_robin)
    if not (chunks or floor_chunks or max_leaf):
        return placed
    n = placed.count()
    if chunks:
        base, extra = divmod(n, chunks)
        wide = extra * (base + 1)
        narrow = F.floor((pos - wide) / max(base, 1)) + extra
        chunk = F.when(pos < wide, F.floor(pos / (base + 1))).otherwise(narrow)
        placed = placed.withColumn("chunk", chunk.cast("bigint"))
    if floor_chunks:
        placed = placed.withColumn("part", F.floor(pos / max(1, n // floor_chunks)).cast("bigint"))
    if max_leaf:
        lo, rows = F.lit(0).cast("bigint"), F.lit(n).cast("bigint")
        longest = n
        while longest > max_leaf:
            half = F.floor(rows / 2).cast("bigint")
            split, right = rows > max_leaf, pos >= lo + half
            placed = placed.withColumns({
                "_lo": F.when(split & right, lo + half).otherwise(lo),
                "_rows": F.when(~split, rows).when(right, rows - half).otherwise(half)})
            lo, rows, pos = F.col("_lo"), F.col("_rows"), F.col("pos")
            longest -= longest // 2
        placed = placed.withColumns({"leaf_start": lo, "leaf_rows": rows}).drop("_lo", "_rows")
    return placed


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, repeatable for a seed; ``draw`` is the draw number."""
    if k > FEW_ROWS:
        return shuffle_rows(df, key, seed).filter(F.col("draw") <= k)
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    few = df.withColumn("_mix", mixed).orderBy("_mix", key).limit(k)
    return few.withColumn("draw", F.row_number().over(Window.orderBy("_mix", key)).cast("bigint")).drop("_mix")


def shuffle_rows(df: DataFrame, key: str, seed: int, name: str = "draw") -> DataFrame:
    """A full permutation: every row with its position in the shuffled order."""
    mixed = df.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return with_position(mixed, ["_mix", key], name, start=1).drop("_mix")
