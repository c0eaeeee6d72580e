"""Ordered-row functions per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.ordered import lag, lead, ordered_window, row_number, running


def pairwise(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), **kw) -> DataFrame:
    """Adjacent pairs: ``value`` with its successor as ``next_value`` (n-1 rows)."""
    paired = ordered_window(df, order, {"_next": lead(F.struct(F.col(value).alias("v")))}, keys=keys, **kw)
    return paired.filter("_next is not null").withColumn("next_value", F.col("_next.v")).drop("_next")


def lap_splits(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), **kw) -> DataFrame:
    """Difference to the previous row; the first row keeps its own value."""
    lagged = ordered_window(df, order, {"_prev": lag(F.col(value))}, keys=keys, **kw)
    return lagged.withColumn("split", F.coalesce(F.col(value) - F.col("_prev"), F.col(value))).drop("_prev")


def accumulate(df: DataFrame, value: Column, order: Sequence[str], keys: Sequence[str] = (), func: str = "sum",
               name: str = "running", **kw) -> DataFrame:
    """Running sum, min, max or count up to the current row."""
    return ordered_window(df, order, {name: running(func, value)}, keys=keys, **kw)


def accumulate_custom(df: DataFrame, func, value: str, order: Sequence[str], keys: Sequence[str],
                      result: str = "double", name: str = "running", **kw) -> DataFrame:
    """Running fold with any Python binary function, e.g. ``lambda a, b: a * b``."""
    from pyspark.sql import types as T

    from loomline.plans.sequential import sequential_scan

    def step(state, row):
        folded = row[0] if state is None else func(state, row[0])
        return folded, (folded,)

    return sequential_scan(df, keys, order, [value], step, None, T.StructType().add(name, result), **kw)


def consecutive_runs(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), **kw) -> DataFrame:
    """Runs of adjacent equal values: run number, value, first and last order value, rows."""
    marked = ordered_window(df, order, {"_prev": lag(F.struct(F.col(value).alias("v")))}, keys=keys, **kw)
    starts = F.when(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(value)), 1).otherwise(0)
    numbered = ordered_window(marked.withColumn("_start", starts), order, {"run": running("sum", F.col("_start"))},
                              keys=keys, **kw)
    first = order[0]
    return numbered.groupBy(*keys, "run", value).agg(
        F.min(first).alias("first_at"), F.max(first).alias("last_at"), F.count(F.lit(1)).alias("n"))


def last_n_history(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The n most recent rows, overall or per key; ``age`` 1 is the newest."""
    from loomline.operators.sorting import top_n
    return top_n(df, n, order, keys, rank="age")


def growth_rate(snapshots: DataFrame, ts: str, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean per-second growth of the measures from the first to the last snapshot.

    Fewer than two snapshots, or no time between them, gives 0.
    """
    picks = [F.min(ts).alias("_t0"), F.max(ts).alias("_t1")]
    for m in measures:
        picks += [F.min_by(m, ts).alias(f"_{m}0"), F.max_by(m, ts).alias(f"_{m}1")]
    ends = snapshots.groupBy(*keys).agg(*picks)
    seconds = (F.unix_micros("_t1") - F.unix_micros("_t0")) / 1e6
    total = sum(((F.col(f"_{m}1") - F.col(f"_{m}0")) for m in measures), F.lit(0))
    rate = F.coalesce(F.try_divide(total.cast("double") / len(measures), seconds), F.lit(0.0))
    return ends.select(*keys, rate.alias("growth_rate"))


def active_version(versions: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Per name the latest version flagged active, else the last one."""
    others = [c for c in versions.columns if c != name]
    best = versions.groupBy(name).agg(
        F.max_by(F.struct(*others), F.struct(F.col("is_active"), F.col(pos))).alias("_v"))
    return best.select(name, *[F.col(f"_v.{c}").alias(c) for c in others])


def rollback_version(versions: DataFrame, target: DataFrame | None = None, name: str = "name", pos: str = "pos") -> DataFrame:
    """Move the active flag to ``target`` (name, pos), or to the version before the active one."""
    now = active_version(versions, name, pos).select(name, F.col(pos).alias("_now"))
    if target is None:
        older = versions.join(now, name).filter(F.col(pos) < F.col("_now"))
        target = older.groupBy(name).agg(F.max(pos).alias("_to"))
    else:
        target = target.withColumnRenamed(pos, "_to")
    moved = versions.join(target, name, "left")
    flag = F.when(F.col("_to").isNull(), F.col("is_active")).otherwise(F.col(pos) == F.col("_to"))
    return moved.withColumn("is_active", flag).drop("_to")


def event_timeline(events: DataFrame, ts: str, ident: str, keys: Sequence[str], as_of: Column, **kw) -> DataFrame:
    """Each event as a span that ends at the next event of its key, or at ``as_of``."""
    spans = ordered_window(events, [ts, ident], {"_end": lead(F.col(ts)), "step": row_number()}, keys=keys, **kw)
    end = F.coalesce("_end", as_of)
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return spans.withColumn("seconds", seconds).withColumn("is_open", F.col("_end").isNull()).drop("_end")
