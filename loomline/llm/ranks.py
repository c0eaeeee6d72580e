"""Gapless numbers within keys of which one may hold any share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import materialize, shuffle_width


def spread_rank(df: DataFrame, keys: list[str], salt: list[str], order: list[str | Column], name: str,
                running: dict[str, str] | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, … within ``keys``.

    A key is dealt to as many buckets as there are shuffle partitions, by a hash of the ``salt``
    columns. Rows are numbered inside a bucket in ``order`` and shifted by the size of the
    buckets before it, so no task needs more than one bucket of a key. ``running`` adds
    further columns: output name -> column whose values of the rows before are summed.
    """
    spark = df.sparkSession
    running = running or {}
    placed = materialize(df.withColumn("_bucket", F.pmod(F.xxhash64(*salt), F.lit(shuffle_width(spark))).cast("int")), "rank")
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in running.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
                          *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in running])
    on = [F.col("_bucket") == F.col("_b"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_rn", F.row_number().over(inside)).withColumns(
        {f"_r_{o}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for o, c in running.items()})
    joined = numbered.join(shifts, reduce(lambda a, b: a & b, on))
    return joined.select(*df.columns, (F.col("_shift") + F.col("_rn") - 1).alias(name),
                         *[(F.col(f"_s_{o}") + F.col(f"_r_{o}")).alias(o) for o in running])
