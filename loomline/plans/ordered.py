"""Ordered-row calculations that never put one key, or the whole table, in one task.

Keys of ordinary size go through a normal Spark window. Keys above ``hot_rows``
(and the keyless, global case) are range-partitioned on (keys, order), so a hot
key spreads over many tasks; each task works on its own segment and the segments
are stitched with a table of one row per (partition, key), whose size is bounded
by the number of partitions plus the number of hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import materialize

HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Calc:
    """One output column: what to compute over the ordered rows of a key."""

    kind: str
    expr: Column | None = None


def row_number() -> Calc:
    """1-based position within the key."""
    return Calc("row_number")


def group_rows() -> Calc:
    """Number of rows of the key, on every row."""
    return Calc("group_rows")


def lag(expr: Column) -> Calc:
    return Calc("lag", expr)


def lead(expr: Column) -> Calc:
    return Calc("lead", expr)


def running(kind: str, expr: Column) -> Calc:
    """Running ``sum``, ``min``, ``max`` or ``count`` including the current row."""
    if kind not in ("sum", "min", "max", "count"):
        raise ValueError(f"unsupported running aggregate {kind!r}")
    return Calc(kind, expr)


def _columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def _calculate(calc: Calc, keys: Sequence[str], order: list[Column]) -> Column:
    part = Window.partitionBy(*keys)
    ordered = part.orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if calc.kind == "row_number":
        return F.row_number().over(ordered).cast("bigint")
    if calc.kind == "group_rows":
        return F.count(F.lit(1)).over(part)
    if calc.kind in ("lag", "lead"):
        return getattr(F, calc.kind)(calc.expr).over(ordered)
    return getattr(F, calc.kind)(calc.expr).over(so_far)


def ordered_window(
    df: DataFrame,
    order: Sequence[str | Column],
    columns: dict[str, Calc],
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Add ordered-row columns per key; ``order`` must end in a unique column."""
    keys, order = list(keys), _columns(order)
    if not keys:
        return _segmented(df, keys, order, columns, partitions)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ow_rows")).filter(F.col("_ow_rows") > hot_rows).drop("_ow_rows")
    plain = lambda part: part.select(
        "*", *[_calculate(c, keys, order).alias(name) for name, c in columns.items()])
    if hot.isEmpty():
        return plain(df)
    hot = materialize(hot, "hot")
    matches = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    left, right = df.alias("l"), hot.alias("r")
    cold_rows = left.join(right, matches, "left_anti")
    hot_rows_ = left.join(right, matches, "left_semi")
    return plain(cold_rows).unionByName(_segmented(hot_rows_, keys, order, columns, partitions))


def _segmented(df, keys, order, columns, partitions):
    # without a number AQE may merge neighbouring ranges of small data; they stay in order
    width = [partitions] if partitions else []
    placed = df.repartitionByRange(*width, *[F.col(k).asc_nulls_first() for k in keys], *order)
    placed = placed.withColumn("_ow_pid", F.spark_partition_id())
    local_keys = ["_ow_pid", *keys]
    needed = {"_ow_rn": row_number(), "_ow_n": group_rows()}
    needed.update({f"_ow_c_{name}": c for name, c in columns.items() if c.kind not in ("row_number", "group_rows")})
    local = placed.select(
        "*",
        *[_calculate(c, local_keys, order).alias(name) for name, c in needed.items()],
        *[c.expr.alias(f"_ow_v_{name}") for name, c in columns.items() if c.kind in ("lag", "lead")],
    )
    local = materialize(local, "ordered")

    ends = local.filter((F.col("_ow_rn") == 1) | (F.col("_ow_rn") == F.col("_ow_n"))).groupBy(*local_keys)
    aggregates = [F.max("_ow_n").alias("_ow_n")]
    for name, c in columns.items():
        if c.kind == "lag":
            aggregates.append(F.max_by(f"_ow_v_{name}", "_ow_rn").alias(f"_ow_e_{name}"))
        elif c.kind == "lead":
            aggregates.append(F.min_by(f"_ow_v_{name}", "_ow_rn").alias(f"_ow_e_{name}"))
        elif c.kind in ("sum", "min", "max", "count"):
            aggregates.append(F.max_by(f"_ow_c_{name}", "_ow_rn").alias(f"_ow_e_{name}"))
    ends = ends.agg(*aggregates)

    by_pid = Window.partitionBy(*keys).orderBy("_ow_pid")
    before = by_pid.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.col("_ow_pid").alias("_ow_epid"), *[F.col(k).alias(f"_ow_k_{k}") for k in keys],
               F.coalesce(F.sum("_ow_n").over(before), F.lit(0)).alias("_ow_before"),
               F.sum("_ow_n").over(Window.partitionBy(*keys)).alias("_ow_total")]
    for name, c in columns.items():
        if c.kind in ("lag", "lead"):
            carried.append(getattr(F, c.kind)(f"_ow_e_{name}").over(by_pid).alias(f"_ow_p_{name}"))
        elif c.kind in ("sum", "count"):
            carried.append(F.sum(f"_ow_e_{name}").over(before).alias(f"_ow_p_{name}"))
        elif c.kind in ("min", "max"):
            carried.append(getattr(F, c.kind)(f"_ow_e_{name}").over(before).alias(f"_ow_p_{name}"))
    ends = ends.select(*carried)

    on = [F.col("_ow_pid") == F.col("_ow_epid")]
    on += [F.col(k).eqNullSafe(F.col(f"_ow_k_{k}")) for k in keys]
    result = []
    for name, c in columns.items():
        mine, prior = F.col(f"_ow_c_{name}"), F.col(f"_ow_p_{name}")
        if c.kind == "row_number":
            value = F.col("_ow_rn") + F.col("_ow_before")
        elif c.kind == "group_rows":
            value = F.col("_ow_total")
        elif c.kind == "lag":
            value = F.when(F.col("_ow_rn") == 1, prior).otherwise(mine)
        elif c.kind == "lead":
            value = F.when(F.col("_ow_rn") == F.col("_ow_n"), prior).otherwise(mine)
        elif c.kind in ("sum", "count"):
            value = F.when(prior.isNull(), mine).when(mine.isNull(), prior).otherwise(mine + prior)
        elif c.kind == "min":
            value = F.least(mine, prior)
        else:
            value = F.greatest(mine, prior)
        result.append(value.alias(name))
    return local.join(ends, on, "left").select(*df.columns, *result)


def with_position(df, order, name="pos", start=0, step=1, partitions=None) -> DataFrame:
    """Consecutive global index in row order: ``start``, ``start + step``, ...

    One range exchange; a row's place in its partition comes from the scan itself,
    and the table of rows per partition (one row each) shifts it.
    """
    order = _columns(order)
    width = [partitions] if partitions else []
    placed = df.repartitionByRange(*width, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_ow_id", F.monotonically_increasing_id()), "placed")
    part, local = F.shiftright("_ow_id", 33), F.col("_ow_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_ow_pid")).agg(F.count(F.lit(1)).alias("_ow_n"))
    before = Window.orderBy("_ow_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_ow_pid", F.coalesce(F.sum("_ow_n").over(before), F.lit(0)).alias("_ow_before"))
    joined = placed.join(F.broadcast(shifts), part == F.col("_ow_pid"))
    return joined.select(*df.columns, ((local + F.col("_ow_before")) * F.lit(step) + F.lit(start)).alias(name))
