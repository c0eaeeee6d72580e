"""Data-quality rules as columns: a rule is NULL when it passes, else its message.

``strict`` rules reject NULL unless allowed; ``lenient`` rules let NULL pass and
leave it to ``required``. Both families keep their own messages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import materialize

# The accepted formats and boolean words, and the rules' error messages below, as specified.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL_PATTERN = r"^https?://"
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")


def _first(*checks: tuple[Column | None, str]) -> Column:
    """Message of the first failing check."""
    result = None
    for test, message in checks:
        if test is None:
            continue
        failing = F.coalesce(test, F.lit(True))
        result = F.when(failing, message) if result is None else result.when(failing, message)
    return result if result is not None else F.lit(None).cast("string")


def _anchored(pattern: str) -> str:
    return pattern if pattern.startswith("^") else f"^(?:{pattern})"


def string_rule(c: Column, min_length=None, max_length=None, pattern=None, allow_empty=False) -> Column:
    """Strict text rule; a bound of 0 means no bound."""
    empty = c.isNull() | (c == "")
    rest = _first(
        (F.length(c) < min_length if min_length else None, f"Minimum length is {min_length}"),
        (F.length(c) > max_length if max_length else None, f"Maximum length is {max_length}"),
        (~c.rlike(_anchored(pattern)) if pattern else None, "Value does not match required pattern"))
    when_empty = F.lit(None).cast("string") if allow_empty else F.lit("Value cannot be empty")
    return F.when(F.coalesce(empty, F.lit(True)), when_empty).otherwise(rest)


def number_rule(c: Column, min_value=None, max_value=None, integer_only=False) -> Column:
    """Strict numeric rule on text or numbers."""
    value = c.try_cast("double")
    return _first(
        (value.isNull(), "Value must be a number"),
        (value != F.floor(value) if integer_only else None, "Value must be an integer"),
        (value < min_value if min_value is not None else None, f"Minimum value is {min_value}"),
        (value > max_value if max_value is not None else None, f"Maximum value is {max_value}"))


def boolean_rule(c: Column) -> Column:
    return _first((~F.lower(c.cast("string")).isin(*BOOLEAN_WORDS), "Value must be a boolean"))


def list_rule(c: Column, min_items=None, max_items=None, item_rule: Callable[[Column], Column] | None = None) -> Column:
    """Strict array rule; reports the first failing item with its index."""
    size_error = _first(
        (c.isNull(), "Value must be a list"),
        (F.size(c) < min_items if min_items else None, f"Minimum {min_items} items required"),
        (F.size(c) > max_items if max_items else None, f"Maximum {max_items} items allowed"))
    if item_rule is None:
        return size_error
    messages = F.transform(c, lambda x, i: F.when(
        item_rule(x).isNotNull(), F.concat(F.lit("Item "), i.cast("string"), F.lit(": "), item_rule(x))))
    return F.coalesce(size_error, F.try_element_at(F.array_compact(messages), F.lit(1)))


def choice_rule(c: Column, choices: Sequence, case_sensitive: bool = True) -> Column:
    allowed = list(choices)
    value = c
    if not case_sensitive:
        allowed = [x.lower() if isinstance(x, str) else x for x in allowed]
        value = F.lower(c)
    return _first((~value.isin(*allowed), f"Value must be one of: {list(choices)}"))


def email_rule(c: Column) -> Column:
    return _first((c.isNull(), "Value must be a string"), (~c.rlike(EMAIL_PATTERN), "Invalid email format"))


def url_rule(c: Column) -> Column:
    return _first((c.isNull(), "Value must be a string"),
                  (~c.rlike(URL_PATTERN), "Invalid URL format (must start with http:// or https://)"))


def optional_rule(c: Column, rule: Column, allow_none: bool = True) -> Column:
    missing = F.lit(None).cast("string") if allow_none else F.lit("Value cannot be None")
    return F.when(c.isNull(), missing).otherwise(rule)


def required(c: Column, message: str = "This field is required") -> Column:
    return _first((c.isNull() | (c.cast("string") == ""), message))


def _lenient(c: Column, failing: Column, message: str) -> Column:
    return F.when(c.isNotNull() & F.coalesce(failing, F.lit(True)), message)


def _bounds(name: str, low, high, invalid: str) -> str:
    if low is not None and high is not None:
        return f"{name} must be between {low} and {high}"
    if low is not None:
        return f"{name} must be at least {low}"
    if high is not None:
        return f"{name} must be at most {high}"
    return invalid


def _outside(value: Column, low, high) -> Column:
    failing = value.isNull()
    if low is not None:
        failing = failing | (value < low)
    if high is not None:
        failing = failing | (value > high)
    return failing


def range_rule(c: Column, low=None, high=None) -> Column:
    return _lenient(c, _outside(c.try_cast("double"), low, high), _bounds("Value", low, high, "Invalid value"))


def length_rule(c: Column, low=None, high=None) -> Column:
    return _lenient(c, _outside(F.length(c), low, high), _bounds("Length", low, high, "Invalid length"))


def pattern_rule(c: Column, pattern: str, message: str = "Invalid format") -> Column:
    return _lenient(c, ~c.cast("string").rlike(_anchored(pattern)), message)


def all_rules(*rules: Column) -> Column:
    """First error of the rules."""
    return F.coalesce(*rules)


def and_rules(*rules: Column) -> Column:
    """Every error, joined by ``; ``; NULL when all pass."""
    errors = F.array_compact(F.array(*rules))
    return F.when(F.size(errors) > 0, F.array_join(errors, "; "))


def any_rule(*rules: Column) -> Column:
    """Passes when one rule passes."""
    failed = reduce(lambda a, b: a & b, [r.isNotNull() for r in rules])
    return F.when(failed, "None of the validators passed")


def custom_rule(func: Callable[[object], bool], c: Column, message: str = "Invalid value") -> Column:
    """Any Python predicate, in Arrow batches; a predicate that raises is a failure."""

    @F.pandas_udf("boolean")
    def holds(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                return bool(func(value))
            except Exception:  # noqa: BLE001
                return False
        return values.map(one).astype(bool)

    return F.when(~holds(c), message)


def schema_errors(required_fields: Sequence[str], rules: Mapping[str, Sequence[Column]]) -> Column:
    """Array of ``field: error`` over required fields first, then every failing rule."""
    errors = [F.when(F.col(f).isNull(), f"{f}: Required key '{f}' is missing") for f in required_fields]
    for field, checks in rules.items():
        errors += [F.concat(F.lit(f"{field}: "), check) for check in checks]
    return F.array_compact(F.array(*errors))


def schema_validate_split(df: DataFrame, required_fields: Sequence[str], rules: Mapping[str, Sequence[Column]]
                          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``errors``, failure counts per rule).

    The checked table is written once and the three results read it.
    """
    checked = materialize(df.withColumn("errors", schema_errors(required_fields, rules)), "checked")
    bad = checked.filter(F.size("errors") > 0)
    counts = bad.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    return checked.filter(F.size("errors") == 0).drop("errors"), bad, counts


def graph_findings(edges: DataFrame) -> DataFrame:
    """One row per fault of an edge table (src, dst, w): empty id, self-loop, negative weight."""
    src, dst, w = F.col("src"), F.col("dst"), F.col("w")
    empty = src.isNull() | (src == "") | dst.isNull() | (dst == "")
    faults = F.array_compact(F.array(
        F.when(w < 0, "negative weight"), F.when(src == dst, "self-loop"), F.when(empty, "empty id")))
    return edges.select("src", "dst", "w", F.explode(faults).alias("finding"))


def valid_edges(edges: DataFrame) -> DataFrame:
    src, dst, w = F.col("src"), F.col("dst"), F.col("w")
    return edges.filter((src != "") & (dst != "") & (src != dst) & (w.isNull() | (w >= 0)))
