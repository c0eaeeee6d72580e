"""Row filters: each takes a DataFrame and returns the rows that pass."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.plans.ordered import ordered_window, running, with_position


def filter_predicate(df: DataFrame, condition: Column, keep: bool = True) -> DataFrame:
    """Rows where ``condition`` holds; ``keep=False`` gives the other rows.

    A NULL condition counts as not holding, in both directions.
    """
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(condition if keep else ~holds)


def filter_key_equals(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal all given values; ``None`` matches NULL."""
    for name, value in values.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    return df


def find_first(df: DataFrame, order: Sequence[str | Column], **values) -> DataFrame:
    """The first row, in ``order``, of ``filter_key_equals``."""
    return filter_key_equals(df, **values).orderBy(*order).limit(1)


def filter_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive, optional bounds. Numeric text counts, other text is dropped."""
    kind = dict(df.dtypes)[column]
    value = F.col(column).try_cast("double") if kind == "string" else F.col(column)
    df = df.filter(value.isNotNull())
    if low is not None:
        df = df.filter(value >= low)
    if high is not None:
        df = df.filter(value <= high)
    return df


def filter_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text contains a match of ``pattern`` anywhere."""
    return df.filter(F.col(column).cast("string").rlike(pattern))


def variant_type(column: Column) -> Column:
    """Type name of a JSON value held as VARIANT."""
    return F.schema_of_variant(column)


def filter_value_type(df: DataFrame, value: Column, types: Sequence[str], allow_null: bool = False) -> DataFrame:
    """Rows whose VARIANT ``value`` has one of the given types."""
    test = variant_type(value).isin(*types)
    if allow_null:
        test = test | value.isNull() | (variant_type(value) == "VOID")
    return df.filter(test)


def filter_composite(df: DataFrame, conditions: Sequence[Column], mode: str = "and") -> DataFrame:
    """All (``and``) or at least one (``or``) of the conditions; duplicates stay."""
    if mode not in ("and", "or"):
        raise ValueError("mode is 'and' or 'or'")
    if not conditions:
        return df
    return df.filter(reduce(operator.and_ if mode == "and" else operator.or_, conditions))


def filter_null(df: DataFrame, column: str, keep: bool = False) -> DataFrame:
    """Drop NULL rows, or keep only them. Falsy values are not NULL."""
    return df.filter(F.col(column).isNull() if keep else F.col(column).isNotNull())


def take_while(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str] = (), **kw) -> DataFrame:
    """Rows of each key before the first one that fails ``condition``."""
    return _while(df, condition, order, keys, **kw).filter("_failed = 0").drop("_failed")


def drop_while(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str] = (), **kw) -> DataFrame:
    """Rows of each key from the first one that fails ``condition`` on."""
    return _while(df, condition, order, keys, **kw).filter("_failed > 0").drop("_failed")


def _while(df, condition, order, keys, **kw):
    failed = F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)
    return ordered_window(df, order, {"_failed": running("max", failed)}, keys=keys, **kw)


def compress_by_mask(df: DataFrame, order: Sequence[str], mask: DataFrame, mask_order: Sequence[str],
                     flag: str) -> DataFrame:
    """Row i stays when row i of ``mask`` is true; stops at the shorter side."""
    rows = with_position(df, order, "_pos")
    flags = with_position(mask, mask_order, "_pos").filter(F.col(flag)).select("_pos")
    return rows.join(flags, "_pos", "left_semi").drop("_pos")


def filter_by_tags(df: DataFrame, tags: dict[str, str], column: str = "tags") -> DataFrame:
    """Rows whose tag map has every given pair."""
    for key, value in tags.items():
        df = df.filter(F.element_at(F.col(column), F.lit(key)).eqNullSafe(F.lit(value)))
    return df


def filter_has_tag(df: DataFrame, tag: str, column: str = "tags") -> DataFrame:
    """Rows whose tag array contains ``tag``."""
    return df.filter(F.array_contains(F.col(column), tag))


def rule_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (rule, metric row) whose condition holds.

    ``metrics`` has ``metric`` and ``value``; ``rules`` has ``rule``, ``metric``,
    ``op`` (one of ``> >= < <= =``) and ``bound``. Works on streams as well.
    """
    v, b = F.col("value"), F.col("bound")
    holds = (F.when(F.col("op") == ">", v > b).when(F.col("op") == ">=", v >= b)
             .when(F.col("op") == "<", v < b).when(F.col("op") == "<=", v <= b)
             .when(F.col("op") == "=", v == b).otherwise(False))
    return metrics.join(rules, "metric").filter(holds)
