"""Readers with declared schemas: nothing is inferred unless asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.sources.csv_splits import csv_records, parse_records


def read_text_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One row per line (``value``), or per file when ``whole``."""
    return spark.read.text(path, wholetext=whole)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str, whole_file: bool = False,
                      corrupt: str | None = None) -> DataFrame:
    """JSON Lines (blank lines are skipped), or one document per file.

    With ``corrupt`` bad records stay as rows holding their text in that column.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("multiLine", whole_file).option("mode", "PERMISSIVE")
    if corrupt:
        fields = T.StructType([*fields.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(fields).json(path)


def read_csv_records(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ",",
                     header: bool = True, schema: T.StructType | str | None = None, multi_line: bool = True,
                     by_file: bool = False) -> DataFrame:
    """Every value is text unless a schema is given; without header and names, columns are ``_c0``...

    Quoted values can hold line breaks and files are split all the same (see ``csv_splits``); lines end in ``\\n`` or
    ``\\r\\n``. Files of other line ends, and separators of several characters, take ``by_file``: one task a file.
    Without ``multi_line`` a line is a record; only for files known to have no line breaks in values.
    """
    reader = spark.read.option("sep", sep).option("header", header).option("escape", '"').option("multiLine", multi_line)
    if schema is None and columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if multi_line and not by_file and len(sep) == 1:
        return parse_records(csv_records(spark, path, sep), schema or reader.csv(path).schema, sep, header)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_xml_records(spark: SparkSession, path: str, row_tag: str, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per ``row_tag``: child tags as text columns, or the item's own text as ``value``."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    if fields is None:
        own = T.StructType([T.StructField("_VALUE", T.StringType())])
        return reader.schema(own).load(path).withColumnRenamed("_VALUE", "value")
    return reader.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).load(path)


def read_file_tree(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, with_hash: bool = True) -> DataFrame:
    """(path, kind, size, modified[, sha256]) per file; contents are read only for the hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    columns = [F.col("path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"),
               F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if with_hash:
        columns.append(F.sha2("content", 256).alias("sha256"))
    return files.select(*columns)


def read_file_contents(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content as text) per file, for the whole-text jobs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.decode("content", "utf-8").alias("content"))


def files_per_kind(tree: DataFrame) -> DataFrame:
    return tree.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
