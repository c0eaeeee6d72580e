"""Loaders for the star-schema, event and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    """``yyyy-MM-dd`` text of a date or timestamp column."""
    return F.date_format(F.col(column), "yyyy-MM-dd")


def micros(column: str) -> Column:
    """Epoch microseconds of a timestamp, with or without time zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))
