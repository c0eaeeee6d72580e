"""Aggregations. Everything here combines on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.ordered import ordered_window, row_number


def sum_field(column: str | Column) -> Column:
    """Sum where a missing value counts as 0 and no rows give 0."""
    return F.coalesce(F.sum(column), F.lit(0))


def avg_field(column: str | Column) -> Column:
    """Mean where a missing value counts as 0 and stays in the denominator."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.try_divide(F.sum(F.coalesce(value, F.lit(0))), F.count(F.lit(1))), F.lit(0.0))


def count_field(column: str | Column | None = None) -> Column:
    """Row count, or the count of rows where the column has a value."""
    return F.count(F.lit(1)) if column is None else F.count(column)


def count_key(mapping: str | Column, key: str) -> Column:
    """Rows whose map has the key; an explicit NULL value counts."""
    return F.count_if(F.coalesce(F.map_contains_key(mapping, key), F.lit(False)))


def group_by_aggregate(df: DataFrame, field: str, *aggregates: Column, unknown: str = "unknown") -> DataFrame:
    """Group by a field; rows without it form the group ``unknown``."""
    key = F.coalesce(F.col(field).cast("string"), F.lit(unknown)).alias(field)
    return df.groupBy(key).agg(*aggregates)


def group_collect(df: DataFrame, keys: Sequence[str], order: Sequence[str], record: Column, chunk_rows: int = 1000,
                  **kw) -> DataFrame:
    """Key -> its records in order, as arrays of at most ``chunk_rows`` records.

    Concatenating the chunks of a key in ``chunk`` order gives its whole list,
    and no task ever holds more than one chunk as one row.
    """
    numbered = ordered_window(df, order, {"_rn": row_number()}, keys=keys, **kw)
    numbered = numbered.withColumn("chunk", F.floor((F.col("_rn") - 1) / chunk_rows).cast("bigint"))
    packed = F.array_sort(F.collect_list(F.struct("_rn", record.alias("record"))))
    grouped = numbered.groupBy(*keys, "chunk").agg(packed.alias("_list"), F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, "chunk", "n", F.transform("_list", lambda s: s["record"]).alias("records"))


def min_max_any_all(value: str, ident: str, condition: Column) -> list[Column]:
    """Extremes with their rows (ties: lowest id), and boolean folds with empty defaults."""
    return [
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.min_by(ident, F.struct(F.col(value), F.col(ident))).alias("min_id"),
        F.max_by(ident, F.struct(F.col(value), -F.col(ident))).alias("max_id"),
        F.coalesce(F.bool_or(condition), F.lit(False)).alias("any_holds"),
        F.coalesce(F.bool_and(condition), F.lit(True)).alias("all_hold"),
    ]


def descriptive_stats(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Mean, medians, sample variance and first-seen mode per key.

    The table is first reduced to one row per (key, value): the exact medians
    come from the counts, so a hot key costs its distinct values, not its rows.
    """
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    moments = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.var_samp(value).alias("variance"),
        F.count(value).alias("n"))
    mode = distinct.groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("c"), F.col("_first"))).alias("mode"))
    from loomline.plans.ordered import running
    ranked = ordered_window(distinct, [value], {"_upto": running("sum", F.col("_n"))}, keys=keys)
    joined = ranked.join(moments.select(*keys, F.col("n").alias("_total")), list(keys))
    low_rank = F.floor((F.col("_total") + 1) / 2)
    high_rank = F.floor(F.col("_total") / 2) + 1
    start = F.col("_upto") - F.col("_n")
    holds = lambda rank: (start < rank) & (F.col("_upto") >= rank)
    medians = joined.groupBy(*keys).agg(
        F.max(F.when(holds(low_rank), F.col(value))).alias("median_low"),
        F.max(F.when(holds(high_rank), F.col(value))).alias("_high"))
    return (moments.join(medians, list(keys), "left").join(mode, list(keys), "left")
            .withColumn("median", (F.col("median_low") + F.col("_high")) / 2).drop("_high"))


def most_common(df: DataFrame, value: str, n: int, order: Sequence[str]) -> DataFrame:
    """Top n values by count; ties by first appearance."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*order)).alias("_first"))
    return counts.orderBy(F.desc("count"), "_first").limit(n).drop("_first")


def map_reduce(df: DataFrame, mapper: Callable[[DataFrame], DataFrame], keys: Sequence[str], *reducers: Column) -> DataFrame:
    """Map rows, then reduce per key with built-in (map-side combining) aggregates."""
    mapped = mapper(df)
    return mapped.groupBy(*keys).agg(*reducers) if keys else mapped.agg(*reducers)


def duration_summary(df: DataFrame, name: str, duration: str) -> DataFrame:
    """Calls, total, mean, min and max per name; 0 where there is no duration."""
    zero = F.lit(0.0)
    return df.groupBy(name).agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(duration), zero).alias("total"),
        F.coalesce(F.avg(duration), zero).alias("avg"), F.coalesce(F.min(duration), zero).alias("min"),
        F.coalesce(F.max(duration), zero).alias("max"))


_FOLDS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def metric_query(points: DataFrame, name: str | None = None, start=None, end=None, tags: dict | None = None) -> DataFrame:
    """Points of a metric in an inclusive time range with all given tags."""
    if name is not None:
        points = points.filter(F.col("name") == name)
    if start:
        points = points.filter(F.col("ts") >= F.lit(start))
    if end:
        points = points.filter(F.col("ts") <= F.lit(end))
    for key, value in (tags or {}).items():
        points = points.filter(F.element_at("tags", F.lit(key)).eqNullSafe(F.lit(value)))
    return points


def metric_aggregate(points: DataFrame, funcs: Sequence[str], value: str = "value", **query) -> DataFrame:
    """One row with the asked folds; no points, or an unknown fold, gives 0.0."""
    selected = metric_query(points, **query)
    folds = [F.coalesce(_FOLDS[f](value).cast("double"), F.lit(0.0)) if f in _FOLDS else F.lit(0.0) for f in funcs]
    return selected.agg(*[c.alias(f) for c, f in zip(folds, funcs)])


def counters_and_gauges(df: DataFrame, name: str, delta: Column, gauge: Column, order: Sequence[str]) -> DataFrame:
    """Counter = sum of deltas; gauge = latest value in ``order``."""
    return df.groupBy(name).agg(F.sum(delta).alias("counter"), F.max_by(gauge, F.struct(*order)).alias("gauge"))


def status_summary(df: DataFrame, status: str, statuses: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Total and one count column per status, 0 when a status does not occur."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)
