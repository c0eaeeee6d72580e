"""Lookups, diffs and positional pairing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import comb, perm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.ordered import ordered_window, row_number, running, with_position


def lookup_join(df: DataFrame, table: DataFrame, on: str, order: Column) -> DataFrame:
    """Left lookup by key; of duplicate keys the last in ``order`` wins.

    No hint: Spark broadcasts the table when its measured size allows it.
    """
    others = [c for c in table.columns if c != on]
    last = table.groupBy(on).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return df.join(last, on, "left").select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in others])


def unprocessed_anti_join(files: DataFrame, ledger: DataFrame, operation: str) -> DataFrame:
    """Files with no ledger row of the operation for their present content hash.

    ``files`` has (path, content); ``ledger`` has (path, operation, source_hash).
    Only 32-byte digests are shuffled for the comparison of long contents.
    """
    done = ledger.filter(F.col("operation") == operation).select("path", "source_hash")
    return files.withColumn("source_hash", F.md5("content")).join(done, ["path", "source_hash"], "left_anti")


def record_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per key: added, removed, modified or unchanged, with a ``changed`` array."""
    fields = [c for c in old.columns if c != key]
    left = old.select(F.col(key).alias("_ok"), F.struct(*fields).alias("_old"))
    right = new.select(F.col(key).alias("_nk"), F.struct(*fields).alias("_new"))
    both = left.join(right, F.col("_ok") == F.col("_nk"), "full_outer")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields]))
    status = (F.when(F.col("_ok").isNull(), "added").when(F.col("_nk").isNull(), "removed")
              .when(F.size(changed) > 0, "modified").otherwise("unchanged"))
    return both.select(F.coalesce("_ok", "_nk").alias(key), status.alias("status"),
                       F.when(status == "modified", changed).alias("changed"), "_old", "_new")


def field_changes(diff: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per changed field of modified keys, with both values as text."""
    entries = F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f"_old.{f}").cast("string").alias("old_value"),
        F.col(f"_new.{f}").cast("string").alias("new_value"),
        (~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}"))).alias("differs")) for f in fields])
    rows = diff.filter("status = 'modified'").select(key, F.explode(entries).alias("e")).filter("e.differs")
    return rows.select(key, "e.field", "e.old_value", "e.new_value")


def zip_join(left: DataFrame, left_order, right: DataFrame, right_order, longest: bool = False) -> DataFrame:
    """Pair rows by position; ``longest`` keeps the unpaired tail with NULLs."""
    a, b = with_position(left, left_order, "pos"), with_position(right, right_order, "pos")
    return a.join(b, "pos", "full_outer" if longest else "inner")


def product_slice(parts: Sequence[tuple[DataFrame, Sequence[str]]], start: int = 0, stop: int | None = None) -> DataFrame:
    """Tuples ``start`` .. ``stop`` of the cartesian product, in product order.

    Tuple number p picks row ``p // stride % n`` of each input (mixed radix), so
    the product is built by equi-joins on evenly spread row numbers: every task
    gets the same share, and any slice costs only its own size.
    """
    placed, sizes = [], []
    for i, (df, order) in enumerate(parts):
        numbered = with_position(df, order, f"_i{i}")
        placed.append(numbered)
        sizes.append(numbered.count())
    total = reduce(lambda a, b: a * b, sizes, 1)
    stop = total if stop is None else min(stop, total)
    spark = placed[0].sparkSession
    rows = spark.range(start, max(start, stop)).withColumnRenamed("id", "tuple_no")
    stride = total
    for i, (numbered, n) in enumerate(zip(placed, sizes)):
        stride = stride // n if n else 1
        rows = rows.withColumn(f"_i{i}", F.expr(f"tuple_no div {max(stride, 1)}") % max(n, 1))
    for i, numbered in enumerate(placed):
        rows = rows.join(numbered, f"_i{i}").drop(f"_i{i}")
    return rows


def combination_count(n: Column, r: int, kind: str = "combinations") -> Column:
    """How many r-tuples n items give, in closed form and exact decimals (nothing is emitted)."""
    whole = lambda c: c.cast("decimal(38,0)")
    n = n.cast("decimal(19,0)")
    if kind == "product":
        return reduce(lambda a, _: whole(a * n), range(r), whole(F.lit(1))).cast("bigint")
    if kind == "with_replacement":
        n = n + (r - 1)
    value = whole(F.lit(1))
    for i in range(r):
        value = whole(value * F.greatest(n - i, F.lit(0)))
        if kind != "permutations":
            value = whole(value / (i + 1))
    return value.cast("bigint")


def pair_at(n: Column, rank: Column) -> tuple[Column, Column]:
    """0-based positions (a, b), a < b, of pair number ``rank`` in row order, for n up to 2^31.

    The root in double precision is off by less than 64 places; which of these holds is decided in exact decimals.
    """
    exact = lambda c: c.cast("decimal(19,0)")
    m = 2 * n.cast("double") - 1
    guess = F.floor((m - F.sqrt(F.greatest(m * m - 8 * rank.cast("double"), F.lit(0.0)))) / 2).cast("bigint")
    before = lambda a: (exact(a) * exact(2 * n - a - 1) / 2).cast("bigint")
    near = F.transform(F.sequence(F.lit(-64), F.lit(64)), lambda k: guess + k)
    a = F.array_max(F.filter(near, lambda a: (a >= 0) & (a <= n - 2) & (before(a) <= rank)))
    return a, (rank - before(a) + a + 1).cast("bigint")


def permutations_count(n: int, r: int | None = None) -> int:
    return perm(n, n if r is None else r)


def combinations_count(n: int, r: int) -> int:
    return comb(n, r)


def combinations_at(df: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, ranks: DataFrame) -> DataFrame:
    """The pairs of each key that ``ranks`` (keys, rank) asks for.

    Pairs are by position, so equal values at different positions are distinct.
    The pair is computed from its number and fetched by two equi-joins; the pairs
    of a key are never listed.
    """
    keys = list(keys)
    rows = ordered_window(df.select(*keys, *order, *([] if ident in [*keys, *order] else [ident])), order,
                          {"_rn": row_number()}, keys=keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = ranks.join(sizes, keys)
    a, b = pair_at(F.col("n"), F.col("rank"))
    asked = asked.filter((F.col("rank") >= 0) & (F.col("rank") < combination_count(F.col("n"), 2)))
    asked = asked.withColumns({"_a": a + 1, "_b": b + 1})
    item = rows.select(*keys, "_rn", F.col(ident))
    first = item.select(*keys, F.col("_rn").alias("_a"), F.col(ident).alias("first"))
    second = item.select(*keys, F.col("_rn").alias("_b"), F.col(ident).alias("second"))
    return asked.join(first, [*keys, "_a"]).join(second, [*keys, "_b"]).drop("_a", "_b")


def rank_position_join(probe: DataFrame, base: DataFrame, value: str, ident: str) -> DataFrame:
    """For each probe row: base values below it (``left``) and not above it (``right``).

    One running count over the union of both sides in value order; no pair is
    compared. The insertion point of an item is its ``left`` (or ``right``).
    """
    tagged = probe.select(F.col(value).alias("_v"), F.lit(1).alias("_side"), F.col(ident).cast("string").alias("_id"))
    others = base.select(F.col(value).alias("_v"), F.lit(0).alias("_side"), F.lit("").alias("_id"))
    # base values collapse to counts first, so equal values cannot pile up in one task
    others = others.groupBy("_v", "_side", "_id").agg(F.count(F.lit(1)).alias("_n"))
    both = tagged.withColumn("_n", F.lit(0).cast("bigint")).unionByName(others)
    placed = ordered_window(both, ["_v", "_side", "_id"], {"right": running("sum", F.col("_n"))})
    same = others.select(F.col("_v").alias("_bv"), F.col("_n").alias("_same"))
    hits = placed.filter("_side = 1").join(same, F.col("_v") == F.col("_bv"), "left")
    return hits.select(F.col("_id").alias(ident), F.col("_v").alias(value),
                       (F.col("right") - F.coalesce("_same", F.lit(0))).alias("left"), "right")
