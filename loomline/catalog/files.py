"""Registered queries: file sources and sinks, checked by reading back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.catalog.registry import query
from loomline.session import scratch_path
from loomline.sources import readers, writers
from loomline.tables import day, load


@query("read_text_lines", """
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT md5(line) AS line_md5, count(*) AS n FROM l GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "text")
    load(spark, d, "documents").select("text").write.text(path)
    lines = readers.read_text_lines(spark, path)
    return lines.groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("read_json_records", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(spark, d):
    path = scratch_path(spark, "json")
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    writers.write_json_records(rows, path)
    return readers.read_json_records(spark, path, rows.schema)


@query("read_csv_records", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment || ', "' || c_nationkey || '"' AS note FROM customer""")
def _(spark, d):
    path = scratch_path(spark, "csv")
    rows = load(spark, d, "customer").select(
        "c_custkey", "c_name", F.concat("c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"')).alias("note"))
    writers.write_csv_records(rows, path)
    return readers.read_csv_records(spark, path, rows.columns)


@query("read_xml_records", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def _(spark, d):
    path = scratch_path(spark, "xml")
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    writers.write_xml_records(rows, path, "suppliers", "supplier")
    return readers.read_xml_records(spark, path, "supplier", rows.columns)


@query("read_file_tree", """
SELECT lang, 'txt' AS kind, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "tree")
    load(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    tree = readers.read_file_tree(spark, path, "*.txt")
    hashed = tree.filter(F.length("sha256") == 64)
    return hashed.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), "kind").agg(F.sum("size").alias("size"))


@query("write_json_records", "SELECT p_partkey, p_name, p_retailprice, CASE WHEN p_size > 25 THEN p_size END AS p_size FROM part")
def _(spark, d):
    path = scratch_path(spark, "json")
    rows = load(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"))
    writers.write_json_records(rows.filter("p_partkey % 2 = 0"), path)
    writers.write_json_records(rows.filter("p_partkey % 2 = 1"), path, append=True)
    return readers.read_json_records(spark, path, rows.schema)


@query("write_csv_records", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(spark, d):
    path = scratch_path(spark, "csv")
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    writers.write_csv_records(rows, path, sep=";", header=False)
    return readers.read_csv_records(spark, path, sep=";", header=False, schema=rows.schema)


@query("write_xml_records", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def _(spark, d):
    path = scratch_path(spark, "xml")
    writers.write_xml_records(load(spark, d, "customer").select("c_custkey", "c_name"), path)
    return readers.read_xml_records(spark, path, "item", ["c_custkey", "c_name"])


@query("write_text_report", """
SELECT 'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', segment: ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'None' END AS value FROM customer""")
def _(spark, d):
    path = scratch_path(spark, "report")
    rows = load(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    writers.write_text_report(rows, path)
    return readers.read_text_lines(spark, path)


@query("fan_out_write", """
SELECT 'json' AS target, event_type, count(*) AS n, true AS ok FROM events GROUP BY 2
UNION ALL SELECT 'csv', event_type, count(*), true FROM events GROUP BY 2 UNION ALL SELECT 'broken', NULL, 0, false""")
def _(spark, d):
    json_path, csv_path = scratch_path(spark, "json"), scratch_path(spark, "csv")
    rows = load(spark, d, "events").select("event_id", "event_type")

    def broken(df):
        raise OSError("no such target")

    done = writers.fan_out_write(rows, {
        "json": lambda df: writers.write_json_records(df, json_path), "broken": broken,
        "csv": lambda df: writers.write_csv_records(df, csv_path)})
    count = lambda df, name: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("target"), "event_type", "n", F.lit(done[name]).alias("ok"))
    failed = spark.range(1).select(F.lit("broken").alias("target"), F.lit(None).cast("string").alias("event_type"),
                                   F.lit(0).cast("bigint").alias("n"), F.lit(done["broken"]).alias("ok"))
    return count(readers.read_json_records(spark, json_path, rows.schema), "json").unionByName(
        count(readers.read_csv_records(spark, csv_path, schema=rows.schema), "csv")).unionByName(failed)


@query("metrics_exposition", """
WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS events, count(DISTINCT user_id)::DOUBLE AS "active-users", max(value) AS peak FROM events GROUP BY 1),
u AS (UNPIVOT m ON events, "active-users", peak INTO NAME name VALUE value)
SELECT day, name, value, 'pipeline_' || replace(name, '-', '_') || ' ' || CAST(value AS VARCHAR) AS line,
 'daily,day=' || day || ' ' || name || '=' || CAST(value AS VARCHAR) AS influx, 'pipeline.' || name || ':' || CAST(value AS VARCHAR) || '|g' AS statsd FROM u""")
def _(spark, d):
    daily = load(spark, d, "events").groupBy(day("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("active-users"), F.max("value").alias("peak"),
        F.max("event_type").alias("note"))
    return writers.metric_rows(daily, ["day"]).withColumns({
        "line": writers.exposition_line(), "influx": writers.line_protocol(F.lit("daily"), {"day": F.col("day")}), "statsd": writers.statsd_line()})
