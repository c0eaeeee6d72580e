"""Unions, distinct rows, key-set algebra and counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: Mapping[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows of all parts by column name, with the name of their part."""
    tagged = [df.withColumn(source, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in ``order``; NULL is one key value.

    ``min_by`` combines on the map side, so a hot key ships one row per task.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates(list(keys))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def set_algebra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every distinct key with the sides it is on: left, right or both."""
    tagged = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sides = tagged.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    member = F.when(F.col("_l") + F.col("_r") == 2, "both").when(F.col("_l") == 1, "left").otherwise("right")
    return sides.select(key, member.alias("member"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def counter_arithmetic(add: Sequence[DataFrame], subtract: Sequence[DataFrame], key: str) -> DataFrame:
    """Multiset sums; counts may go negative and zero entries stay."""
    signed = [d.select(key, F.lit(1).alias("_s")) for d in add]
    signed += [d.select(key, F.lit(-1).alias("_s")) for d in subtract]
    return reduce(DataFrame.unionByName, signed).groupBy(key).agg(F.sum("_s").alias("count"))


def layered_lookup(layers: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Per key the value of the first layer that has the key."""
    tagged = [d.select(key, value, F.lit(i).alias("layer")) for i, d in enumerate(layers)]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy(key).agg(F.min_by(value, "layer").alias(value), F.min("layer").cast("bigint").alias("layer"))
