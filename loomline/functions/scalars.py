"""Date, duration and number columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- dates


def month_days(c: Column) -> Column:
    return F.dayofmonth(F.last_day(c))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def add_days(c: Column, days: int | Column) -> Column:
    """Shift a timestamp or date by whole days, keeping the time of day."""
    days = F.lit(days) if isinstance(days, int) else days
    return c + F.make_dt_interval(days)


def month_calendar(df: DataFrame, month: str) -> DataFrame:
    """Week rows of each month (first day in ``month``): seven columns, 0 outside the month."""
    start = F.trunc(F.col(month), "MM")
    monday = F.date_sub(start, F.weekday(start))
    weeks = F.sequence(monday, F.last_day(start), F.expr("interval 7 days"))
    rows = df.withColumn("_week", F.explode(weeks))
    cells = []
    for i, name in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun")):
        cell = F.date_add("_week", i)
        cells.append(F.when(F.trunc(cell, "MM") == start, F.dayofmonth(cell)).otherwise(0).alias(name))
    return rows.select(*df.columns, *cells)


def to_zone(c: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of a UTC wall-clock time (both without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)


def zone_offset_seconds(c: Column, zone: str) -> Column:
    return F.timestamp_diff("SECOND", c, to_zone(c, zone))


def is_dst(c: Column, zone: str) -> Column:
    """Offset differs from the smaller of the year's January and July offsets."""
    january, july = (F.make_timestamp_ntz(F.year(c), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) for m in (1, 7))
    standard = F.least(zone_offset_seconds(january, zone), zone_offset_seconds(july, zone))
    return zone_offset_seconds(c, zone) > standard


def _fixed(value: Column, digits: int) -> Column:
    """Decimal text, rounded half to even on the binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def format_duration(seconds: Column) -> Column:
    """``12.3s``, ``4.5m`` or ``6.7h``."""
    s = seconds.cast("double")
    return (F.when(s < 60, F.concat(_fixed(s, 1), F.lit("s"))).when(s < 3600, F.concat(_fixed(s / 60, 1), F.lit("m")))
            .otherwise(F.concat(_fixed(s / 3600, 1), F.lit("h"))))


def parse_duration(c: Column) -> Column:
    """Seconds of texts like ``1h30m``; missing units count 0."""
    def unit(letter: str) -> Column:
        found = F.regexp_extract(c, rf"(\d+){letter}", 1)
        return F.when(found == "", 0.0).otherwise(found.try_cast("double"))
    return unit("h") * 3600 + unit("m") * 60 + unit("s")


# ---------------------------------------------------------------- numbers


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def rescale(c: Column, in_min, in_max, out_min, out_max) -> Column:
    """Linear map of one range to another."""
    lo = in_min if isinstance(in_min, Column) else F.lit(in_min)
    hi = in_max if isinstance(in_max, Column) else F.lit(in_max)
    return F.try_divide((c - lo) * (F.lit(out_max) - F.lit(out_min)), hi - lo) + F.lit(out_min)


def min_max_scaled(df: DataFrame, column: str, name: str) -> DataFrame:
    """Column rescaled to 0..1 by the bounds of the whole table (one scalar aggregate each)."""
    low, high = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return df.withColumn(name, rescale(F.col(column), low, high, 0.0, 1.0))


def quantize(c: Column, digits: int = 2) -> Column:
    """Exact decimal rounded half up."""
    return F.round(c.cast("decimal(38,12)"), digits)


def format_bytes(size: Column) -> Column:
    """1024-step units with one decimal."""
    value = size.cast("double")
    units = ("B", "KB", "MB", "GB", "TB")
    text = None
    for i, unit in enumerate(units):
        label = F.concat(_fixed(value / 1024.0**i, 1), F.lit(unit))
        test = value < 1024.0 ** (i + 1)
        text = F.when(test, label) if text is None else text.when(test, label)
    return text.otherwise(F.concat(_fixed(value / 1024.0**5, 1), F.lit("PB")))


def format_percent(c: Column, digits: int = 1) -> Column:
    return F.concat(_fixed(c * 100, digits), F.lit("%"))
