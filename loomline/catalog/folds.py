"""Registered queries: aggregates, reports, ordered rows, data quality and Python functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loomline.catalog.registry import query
from loomline.functions import udf
from loomline.operators import aggregates as agg
from loomline.operators import analytics, quality, sorting, windows
from loomline.tables import day, load, micros

# ---------------------------------------------------------------- aggregates


@query("group_by_aggregate", """
SELECT COALESCE(o_orderpriority, 'unknown') AS o_orderpriority, round(sum(o_totalprice), 2) AS total_price,
       round(avg(o_totalprice), 4) AS avg_price, count(*) AS n
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 400000 GROUP BY 1""")
def _(spark, d):
    orders = load(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 400000))
    grouped = agg.group_by_aggregate(
        orders, "o_orderpriority", F.round(F.sum("o_totalprice"), 2).alias("total_price"),
        F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"))
    return sorting.sort_rows(grouped, "o_orderpriority", ["n"])


@query("sum_field", """
SELECT l_returnflag, COALESCE(sum(l_quantity), 0) AS qty, round(COALESCE(sum(l_extendedprice), 0), 2) AS price FROM lineitem GROUP BY 1""")
def _(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(
        agg.sum_field("l_quantity").alias("qty"), F.round(agg.sum_field("l_extendedprice"), 2).alias("price"))


@query("avg_field", """
SELECT lang, round(sum(COALESCE(quality, 0)) * 1.0 / count(*), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(spark, d):
    rated = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left")
    return rated.groupBy("lang").agg(F.round(agg.avg_field("quality"), 6).alias("quality"))


@query("count_field", """
SELECT lang, count(*) AS n, count(quality) AS rated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(spark, d):
    rated = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id", "left")
    return rated.groupBy("lang").agg(agg.count_field().alias("n"), agg.count_field("quality").alias("rated"))


@query("group_collect", """
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM orders)
SELECT o_custkey, CAST(rn // 8 AS BIGINT) AS chunk, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS records
FROM p GROUP BY 1, 2""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lists = agg.group_collect(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderkey").cast("string"), 8)
    return lists.withColumn("records", F.array_join("records", ","))


@query("min_max_any_all", """
SELECT l_returnflag, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value,
  min_by(l_orderkey, (l_extendedprice, l_orderkey)) AS min_id, max_by(l_orderkey, (l_extendedprice, -l_orderkey)) AS max_id,
  bool_or(l_quantity > 49) AS any_holds, bool_and(l_quantity > 0) AS all_hold FROM lineitem GROUP BY 1""")
def _(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(
        *agg.min_max_any_all("l_extendedprice", "l_orderkey", F.col("l_quantity") > 49)[:5],
        F.coalesce(F.bool_and(F.col("l_quantity") > 0), F.lit(True)).alias("all_hold"))


@query("descriptive_stats", """
WITH c AS (SELECT l_returnflag, l_quantity AS v, count(*) AS n, min((l_orderkey, l_linenumber, l_partkey)) AS f FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_returnflag, first(v ORDER BY n DESC, f) AS mode FROM c GROUP BY 1)
SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS stdev,
  round(var_samp(l_quantity), 6) AS variance, median(l_quantity) AS median, quantile_disc(l_quantity, 0.5) AS median_low, any_value(m.mode) AS mode
FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def _(spark, d):
    stats = agg.descriptive_stats(load(spark, d, "lineitem"), ["l_returnflag"], "l_quantity",
                                  ["l_orderkey", "l_linenumber", "l_partkey"])
    return stats.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"),
                        F.round("variance", 6).alias("variance"), "median", "median_low", "mode")


@query("most_common", """
SELECT p_type, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, min(p_partkey) LIMIT 5""")
def _(spark, d):
    return agg.most_common(load(spark, d, "part"), "p_type", 5, ["p_partkey"])


@query("map_reduce", """
WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1""")
def _(spark, d):
    words = lambda df: df.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''")
    return agg.map_reduce(load(spark, d, "documents"), words, ["word"], F.count(F.lit(1)).alias("n"))


@query("duration_summary", """
SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max
FROM events GROUP BY 1""")
def _(spark, d):
    stats = agg.duration_summary(load(spark, d, "events"), "event_type", "value")
    return stats.withColumns({"total": F.round("total", 4), "avg": F.round("avg", 6)})


@query("metric_query_aggregate", """
SELECT round(avg(value), 6) AS avg, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max,
  CAST(count(value) AS DOUBLE) AS count, 0.0::DOUBLE AS p99 FROM events
WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00' AND user_id % 2 = 0""")
def _(spark, d):
    points = load(spark, d, "events").select(
        F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value",
        F.create_map(F.lit("even"), (F.col("user_id") % 2 == 0).cast("string")).alias("tags"))
    row = agg.metric_aggregate(points, ["avg", "sum", "min", "max", "count", "p99"], name="view", start="2024-01-05 00:00:00",
                               end="2024-01-20 12:00:00", tags={"even": "true"})
    return row.withColumns({"avg": F.round("avg", 6), "sum": F.round("sum", 4)})


@query("counters_and_gauges", """
SELECT event_type, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS counter, max_by(value, (ts, event_id)) AS gauge
FROM events GROUP BY 1""")
def _(spark, d):
    delta = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    return agg.counters_and_gauges(load(spark, d, "events"), "event_type", delta, F.col("value"), ["ts", "event_id"])


# ---------------------------------------------------------------- reports


def task_log(spark, d):
    """Events as a task log: duration = value, failed when the type is error."""
    start = micros("ts") / 1e6
    events = load(spark, d, "events")
    return events.select(
        F.col("event_id").alias("task_id"), (F.col("user_id") % 8).alias("worker_id"), start.alias("start_time"),
        F.when(F.col("event_type") == "signup", 0.0).otherwise(start + F.col("value")).alias("end_time"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running")
        .otherwise("completed").alias("status"), F.col("value").alias("duration"))


@query("execution_summary", """
WITH t AS (SELECT epoch_us(ts) / 1e6 AS s, CASE WHEN event_type <> 'signup' THEN epoch_us(ts) / 1e6 + value END AS e, value, event_type FROM events)
SELECT count(*) AS total, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS completed, count(*) FILTER (event_type = 'error') AS failed,
  round(count(*) FILTER (event_type NOT IN ('error', 'signup')) / count(*), 6) AS success_rate, round(avg(e - s), 4) AS avg_duration,
  round(count(*) FILTER (event_type NOT IN ('error', 'signup')) / (max(e) - min(s)), 8) AS throughput FROM t""")
def _(spark, d):
    return analytics.execution_summary(task_log(spark, d)).withColumns({
        "success_rate": F.round("success_rate", 6), "avg_duration": F.round("avg_duration", 4),
        "throughput": F.round("throughput", 8)})


@query("worker_load", """
SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R') AS completed, count(*) FILTER (l_returnflag = 'R') AS failed,
  round(avg(l_quantity), 6) AS avg_duration, round(count(*) FILTER (l_returnflag <> 'R') / count(*), 6) AS success_rate,
  round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 8) AS load FROM lineitem GROUP BY 1""")
def _(spark, d):
    per = analytics.worker_load(load(spark, d, "lineitem"), "l_suppkey", "l_quantity", F.col("l_returnflag") != "R")
    return per.withColumns({"avg_duration": F.round("avg_duration", 6), "success_rate": F.round("success_rate", 6),
                            "load": F.round("load", 8)})


@query("slow_task_bottlenecks", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.8::DOUBLE FROM orders)""")
def _(spark, d):
    return analytics.slow_task_bottlenecks(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


def ab_fixture(spark, d):
    """A test with four declared variants, one disabled, and the results of five buckets."""
    variants = spark.createDataFrame(
        [("t1", "control", 50, True, 0), ("t1", "short", 30, True, 1), ("t1", "long", 20, True, 2), ("t1", "off", 10, False, 3)],
        "test_id string, variant_id string, weight int, enabled boolean, decl_pos int")
    bucket = F.col("user_id") % 100
    name = (F.when(bucket < 50, "control").when(bucket < 80, "short").when(bucket < 95, "long").otherwise("stray"))
    results = load(spark, d, "events").select(
        F.lit("t1").alias("test_id"), name.alias("variant_id"), (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("response_time"), F.col("value").alias("quality_score"), F.lit(1).alias("tokens_used"))
    return results, variants


_AB_SQL = """
WITH v(variant_id, decl_pos) AS (VALUES ('control', 0), ('short', 1), ('long', 2), ('off', 3)),
r AS (SELECT CASE WHEN user_id % 100 < 50 THEN 'control' WHEN user_id % 100 < 80 THEN 'short' WHEN user_id % 100 < 95 THEN 'long' ELSE 'stray' END AS variant_id,
        event_type <> 'error' AS ok, value FROM events),
s AS (SELECT v.variant_id, decl_pos, count(r.ok) AS impressions, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
        COALESCE(count(*) FILTER (ok) / nullif(count(r.ok), 0), 0) AS success_rate, COALESCE(avg(value), 0) AS avg_response_time,
        COALESCE(avg(value) FILTER (ok), 0) AS avg_quality FROM v LEFT JOIN r USING (variant_id) GROUP BY 1, 2)"""


@query("ab_test_stats", _AB_SQL + """
SELECT variant_id, impressions, successes, failures, round(success_rate, 6) AS success_rate,
  round(avg_response_time, 6) AS avg_response_time, round(avg_quality, 6) AS avg_quality FROM s""")
def _(spark, d):
    stats = analytics.ab_test_stats(*ab_fixture(spark, d))
    return stats.select("variant_id", "impressions", "successes", "failures", *[
        F.round(c, 6).alias(c) for c in ("success_rate", "avg_response_time", "avg_quality")])


@query("ab_winner_leaderboard", _AB_SQL + """
SELECT variant_id, round(success_rate * 100, 1) AS success_pct, row_number() OVER (ORDER BY round(success_rate * 100, 1) DESC, decl_pos) AS rank,
  variant_id = (SELECT variant_id FROM s WHERE impressions > 0 ORDER BY success_rate DESC, decl_pos LIMIT 1) AS is_winner FROM s""")
def _(spark, d):
    stats = analytics.ab_test_stats(*ab_fixture(spark, d))
    board = analytics.ab_leaderboard(stats).join(analytics.ab_winner(stats), "test_id", "left")
    return board.select("variant_id", "success_pct", "rank", (F.col("variant_id") == F.col("winner")).alias("is_winner"))


@query("ab_assign_variant", """
SELECT CASE WHEN user_id % 3 = 0 THEN 't2' ELSE 't1' END AS test_id, user_id, CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 4 = 0 THEN 'a' ELSE 'b' END
 WHEN user_id % 100 < 50 THEN 'control' WHEN user_id % 100 < 80 THEN 'short' ELSE 'long' END AS variant_id, count(*) AS impressions FROM events GROUP BY 1, 2, 3""")
def _(spark, d):
    _, variants = ab_fixture(spark, d)
    second = spark.createDataFrame([("t2", "a", 1, True, 0), ("t2", "b", 3, True, 1)], variants.schema)
    test = F.when(F.col("user_id") % 3 == 0, "t2").otherwise("t1")
    units = load(spark, d, "events").select(test.alias("test_id"), "user_id")
    picked = analytics.ab_assign_variant(units, variants.unionByName(second), F.col("user_id"))
    return picked.groupBy("test_id", "user_id", "variant_id").agg(F.count(F.lit(1)).alias("impressions"))


# Price in USD per million tokens by provider.
PROVIDER_PRICES = [("groq", 0.59), ("cerebras", 0.60), ("hyperbolic", 0.40), ("gemini", 0.15), ("ollama", 0.0), ("huggingface", 0.0)]


@query("provider_usage_rollup", """
WITH p(i, provider, price) AS (VALUES (0, 'groq', 0.59), (1, 'cerebras', 0.60), (2, 'hyperbolic', 0.40), (3, 'gemini', 0.15), (4, 'ollama', 0.0), (5, 'other', 0.0)),
u AS (SELECT p.provider, p.price::DOUBLE AS price, length(text) // 4 AS tokens, turn % 4 = 3 AS error, turn = 5 AS limited, conv_id % 50 AS latency
      FROM conversations JOIN p ON p.i = conv_id % 6),
per AS (SELECT provider, count(*) AS calls, count(*) FILTER (error) AS errors, count(*) FILTER (limited) AS rate_limits, sum(tokens) AS tokens,
          sum(tokens) / 1e6 * any_value(price) AS cost, sum(latency) AS latency FROM u GROUP BY 1)
SELECT CASE WHEN grouping(provider) = 1 THEN '(all)' ELSE provider END AS provider, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors,
  CAST(sum(rate_limits) AS BIGINT) AS rate_limits, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, round(sum(latency) / sum(calls), 4) AS avg_latency
FROM per GROUP BY ROLLUP (provider)""")
def _(spark, d):
    providers = F.array(*[F.lit(p) for p in ("groq", "cerebras", "hyperbolic", "gemini", "ollama", "other")])
    usage = load(spark, d, "conversations").select(
        F.element_at(providers, (F.col("conv_id") % 6 + 1).cast("int")).alias("provider"),
        F.floor(F.length("text") / 4).cast("bigint").alias("tokens"), (F.col("turn") % 4 == 3).alias("error"),
        (F.col("turn") == 5).alias("rate_limited"), (F.col("conv_id") % 50).alias("latency_ms"))
    prices = spark.createDataFrame(PROVIDER_PRICES, "provider string, usd_per_million double")
    return analytics.provider_usage_rollup(usage, prices)


@query("weighted_ranking", """
WITH s AS (SELECT s_suppkey, round(s_acctbal * 0.4 + (s_nationkey * 100) * 0.3 + (s_suppkey % 97) * 0.3, 6) AS score FROM supplier)
SELECT s_suppkey, score, row_number() OVER (ORDER BY score DESC, s_suppkey) AS rank FROM s""")
def _(spark, d):
    measures = load(spark, d, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("cost"), (F.col("s_nationkey") * 100).alias("speed"),
        (F.col("s_suppkey") % 97).alias("quality"))
    ranked = analytics.weighted_ranking(measures, {"cost": 0.4, "speed": 0.3, "quality": 0.3}, ["s_suppkey"])
    return ranked.select("s_suppkey", "score", "rank")


@query("status_summary", """
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f,
  count(*) FILTER (o_orderstatus = 'P') AS n_p, CAST(0 AS BIGINT) AS n_x FROM orders GROUP BY 1""")
def _(spark, d):
    return agg.status_summary(load(spark, d, "orders"), "o_orderstatus", ["O", "F", "P", "X"], ["o_orderpriority"])


@query("health_rollup", """
WITH c AS (SELECT user_id, event_type, count(*) FILTER (value > 30) / count(*) AS rate, event_type IN ('error', 'purchase') AS critical FROM events GROUP BY 1, 2),
s AS (SELECT user_id, critical, CASE WHEN rate > 0.3 THEN 'UNHEALTHY' WHEN rate > 0.15 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM c)
SELECT user_id, count(*) AS checks, CASE WHEN bool_or(critical AND status = 'UNHEALTHY') THEN 'UNHEALTHY'
  WHEN bool_or(status = 'DEGRADED') THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall FROM s GROUP BY 1""")
def _(spark, d):
    rates = load(spark, d, "events").groupBy("user_id", "event_type").agg(
        (F.count_if(F.col("value") > 30) / F.count(F.lit(1))).alias("rate"))
    status = F.when(F.col("rate") > 0.3, "UNHEALTHY").when(F.col("rate") > 0.15, "DEGRADED").otherwise("HEALTHY")
    checks = rates.select("user_id", status.alias("status"), F.col("event_type").isin("error", "purchase").alias("critical"))
    return analytics.health_rollup(checks, "user_id")


def _check_props(row):
    import json
    k = json.loads(row["props"])["k"]
    if k % 5 == 0:
        raise ValueError(f"k={k} is not accepted")


@query("batch_result_report", """
WITH k AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (k % 5 <> 0) AS successful, count(*) FILTER (k % 5 = 0) AS failed FROM k GROUP BY 1""")
def _(spark, d):
    items = load(spark, d, "events").select("user_id", "event_id", "props")
    return analytics.batch_result_report(items, "user_id", "event_id", _check_props)[0]


@query("batch_result_errors", """
SELECT user_id, event_id, 'k=' || CAST(json_extract(props, '$.k') AS VARCHAR) || ' is not accepted' AS message
FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0""")
def _(spark, d):
    items = load(spark, d, "events").select("user_id", "event_id", "props")
    return analytics.batch_result_report(items, "user_id", "event_id", _check_props)[1]


@query("cache_usage_report", """
SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses, count(*) FILTER (event_type = 'purchase') AS writes,
  round(COALESCE(count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'error')), 0), 0), 6) AS hit_rate FROM events GROUP BY 1""")
def _(spark, d):
    kind = F.col("event_type")
    op = F.when(kind == "view", "hit").when(kind == "error", "miss").when(kind == "purchase", "write")
    report = analytics.cache_usage_report(load(spark, d, "events").withColumn("op", op), ["user_id"])
    return report.withColumn("hit_rate", F.round("hit_rate", 6))


@query("least_loaded_candidate", """
SELECT s_nationkey, min_by(s_suppkey, (s_acctbal, s_suppkey)) AS s_suppkey, min(s_acctbal) AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1""")
def _(spark, d):
    return analytics.least_loaded_candidate(load(spark, d, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey",
                                            F.col("s_suppkey") % 4 != 0)


# ---------------------------------------------------------------- ordered rows


@query("pairwise", """
WITH p AS (SELECT event_id, event_type, value, lead(event_type) OVER w AS next_value, lag(value) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, event_type, next_value, round(COALESCE(value - prev, value), 4) AS split FROM p WHERE next_value IS NOT NULL""")
def _(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    laps = windows.lap_splits(events, "value", ["ts", "event_id"], ["user_id"])
    pairs = windows.pairwise(laps, "event_type", ["ts", "event_id"], ["user_id"])
    return pairs.select("event_id", "event_type", "next_value", F.round("split", 4).alias("split"))


@query("accumulate", """
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS spend, max(o_totalprice) OVER w AS best, count(*) OVER w AS n
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    from loomline.plans.ordered import ordered_window, running
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    price = F.col("o_totalprice")
    ran = ordered_window(orders, ["o_orderdate", "o_orderkey"], {
        "spend": running("sum", price), "best": running("max", price), "n": running("count", price)}, keys=["o_custkey"])
    return ran.select("o_orderkey", F.round("spend", 2).alias("spend"), "best", "n")


def _fading_peak(state, value):
    """Non-built-in fold used by the custom accumulation query: a peak that halves per row."""
    return max(state * 0.5, value)


@query("accumulate_custom", """
WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
r AS (SELECT o_custkey, o_orderkey, rn, v AS running FROM o WHERE rn = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.rn, greatest(r.running * 0.5, o.v) FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.rn = r.rn + 1)
SELECT o_orderkey, running FROM r""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    folded = windows.accumulate_custom(orders, _fading_peak, "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return folded.select("o_orderkey", "running")


@query("consecutive_runs", """
WITH m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY 1, 2, 3""")
def _(spark, d):
    events = load(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    runs = windows.consecutive_runs(events.withColumn("at", F.struct("ts", "event_id")), "event_type", ["at"], ["user_id"])
    return runs.select("user_id", "run", "event_type", "n", F.col("first_at.event_id").alias("first_event"))


@query("last_n_history", """
SELECT 'type' AS scope, event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 100
UNION ALL (SELECT 'all', event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 1000)""")
def _(spark, d):
    events = load(spark, d, "events").select("event_id", "event_type", "ts")
    newest = [F.desc("ts"), F.desc("event_id")]
    per_type = windows.last_n_history(events, 100, newest, ["event_type"]).withColumn("scope", F.lit("type"))
    overall = windows.last_n_history(events, 1000, newest).withColumn("scope", F.lit("all"))
    return per_type.unionByName(overall).select("scope", "event_id", "event_type", "age")


@query("growth_rate", """
WITH s AS (SELECT o_orderpriority, o_orderdate AS t, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, round(COALESCE((max_by(n, t) - min_by(n, t) + max_by(c, t) - min_by(c, t)) / 2.0 / nullif(epoch_us(max(t)) / 1e6 - epoch_us(min(t)) / 1e6, 0), 0), 12) AS growth_rate
FROM s GROUP BY 1""")
def _(spark, d):
    daily = load(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("at")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    rates = windows.growth_rate(daily, "at", ["orders", "customers"], ["o_orderpriority"])
    return rates.select("o_orderpriority", F.round("growth_rate", 12).alias("growth_rate"))


def order_versions(spark, d):
    """Orders of a customer as versions; an urgent order is flagged active."""
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("version"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_active"))


@query("active_version", """
WITH v AS (SELECT o_custkey AS name, o_orderkey AS pos, o_totalprice AS version, o_orderpriority = '1-URGENT' AS is_active FROM orders),
a AS (SELECT name, max_by(pos, (is_active, pos)) AS now, max_by(version, (is_active, pos)) AS version FROM v GROUP BY 1),
t AS (SELECT v.name, max(v.pos) AS target FROM v JOIN a ON v.name = a.name AND v.pos < a.now GROUP BY 1)
SELECT a.name, a.now AS pos, a.version, COALESCE(t.target, CASE WHEN b.flagged THEN a.now END) AS after_rollback
FROM a LEFT JOIN t ON a.name = t.name JOIN (SELECT name, bool_or(is_active) AS flagged FROM v GROUP BY 1) b ON a.name = b.name""")
def _(spark, d):
    versions = order_versions(spark, d)
    rolled = windows.rollback_version(versions).filter("is_active").groupBy("name").agg(F.max("pos").alias("after_rollback"))
    return windows.active_version(versions).select("name", "pos", "version").join(rolled, "name", "left")


@query("event_timeline", """
WITH p AS (SELECT event_id, row_number() OVER w AS step, ts, lead(ts) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, step, nxt IS NULL AS is_open, round((epoch_us(COALESCE(nxt, TIMESTAMP '2024-02-01')) - epoch_us(ts)) / 1e6, 6) AS seconds FROM p""")
def _(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts")
    spans = windows.event_timeline(events, "ts", "event_id", ["user_id"], F.lit("2024-02-01").cast("timestamp_ntz"))
    return spans.select("event_id", "step", "is_open", F.round("seconds", 6).alias("seconds"))


# ---------------------------------------------------------------- data quality


@query("value_rules", """
SELECT c_custkey, CASE WHEN length(c_name) < 5 THEN 'Minimum length is 5' WHEN NOT regexp_matches(c_name, '^Customer#\\d+5') THEN 'Value does not match required pattern' END AS name_error,
 CASE WHEN c_acctbal <> floor(c_acctbal) THEN 'Value must be an integer' WHEN c_acctbal < 0 THEN 'Minimum value is 0' END AS balance_error,
 CASE WHEN lower(c_mktsegment) NOT IN ('building', 'machinery') THEN 'Value must be one of: [''Building'', ''machinery'']' END AS segment_error,
 CASE WHEN c_acctbal < -500 OR c_acctbal > 9000 THEN 'Value must be between -500 and 9000' END AS range_error,
 'Invalid email format' AS email_error, CASE WHEN length(c_mktsegment) > 9 THEN 'Length must be at most 9' END AS length_error FROM customer""")
def _(spark, d):
    name, balance, segment = F.col("c_name"), F.col("c_acctbal"), F.col("c_mktsegment")
    return load(spark, d, "customer").select(
        "c_custkey", quality.string_rule(name, 5, 40, r"Customer#\d+5").alias("name_error"),
        quality.number_rule(balance, 0, None, True).alias("balance_error"),
        quality.choice_rule(segment, ["Building", "machinery"], False).alias("segment_error"),
        quality.range_rule(balance, -500, 9000).alias("range_error"), quality.email_rule(name).alias("email_error"),
        quality.length_rule(segment, None, 9).alias("length_error"))


@query("composite_rules", """
WITH e AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Value must be at least 0' END AS a, CASE WHEN length(c_mktsegment) > 8 THEN 'Length must be at most 8' END AS b,
  CASE WHEN c_custkey % 3 = 0 THEN 'Invalid value' END AS c FROM customer)
SELECT c_custkey, COALESCE(a, b, c) AS first_error, nullif(concat_ws('; ', a, b, c), '') AS all_errors,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN 'None of the validators passed' END AS any_error FROM e""")
def _(spark, d):
    rules = [quality.range_rule(F.col("c_acctbal"), 0), quality.length_rule(F.col("c_mktsegment"), None, 8),
             quality.custom_rule(lambda v: 1 / (v % 3) > 0, F.col("c_custkey"))]
    return load(spark, d, "customer").select(
        "c_custkey", quality.all_rules(*rules).alias("first_error"), quality.and_rules(*rules).alias("all_errors"),
        quality.any_rule(*rules).alias("any_error"))


@query("schema_validate_split", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS k, o_totalprice AS p, o_orderstatus AS s FROM orders),
e AS (SELECT *, CASE WHEN k IS NULL THEN 'o_custkey: Required key ''o_custkey'' is missing' END AS e1, CASE WHEN p > 400000 THEN 'o_totalprice: Value must be at most 400000' END AS e2,
  CASE WHEN s = 'P' THEN 'o_orderstatus: Value must be one of: [''O'', ''F'']' END AS e3 FROM o),
x AS (SELECT unnest([e1, e2, e3]) AS error FROM e)
SELECT 'rule' AS kind, error, count(*) AS n FROM x WHERE error IS NOT NULL GROUP BY 2
UNION ALL SELECT 'rows', CASE WHEN COALESCE(e1, e2, e3) IS NULL THEN 'valid' ELSE 'quarantined' END, count(*) FROM e GROUP BY 2""")
def _(spark, d):
    orders = load(spark, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")))
    valid, bad, counts = quality.schema_validate_split(orders, ["o_custkey"], {
        "o_totalprice": [quality.range_rule(F.col("o_totalprice"), None, 400000)],
        "o_orderstatus": [quality.choice_rule(F.col("o_orderstatus"), ["O", "F"])]})
    rows = valid.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("kind"), F.lit("valid").alias("error"), "n")
    rows = rows.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("kind"), F.lit("quarantined").alias("error"), "n"))
    return counts.select(F.lit("rule").alias("kind"), "error", "n").unionByName(rows)


@query("graph_validate", """
WITH e AS (SELECT CASE WHEN l_suppkey % 20 = 0 THEN '' ELSE 's' || l_suppkey END AS src, CASE WHEN l_linenumber = 7 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS dst,
  CASE WHEN l_quantity = 1 THEN -l_extendedprice ELSE l_extendedprice END AS w FROM lineitem),
f AS (SELECT src, unnest([CASE WHEN w < 0 THEN 'negative weight' END, CASE WHEN src = dst THEN 'self-loop' END, CASE WHEN src = '' OR dst = '' THEN 'empty id' END]) AS finding FROM e)
SELECT src, finding, count(*) AS n FROM f WHERE finding IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    supp = F.concat(F.lit("s"), "l_suppkey")
    edges = load(spark, d, "lineitem").select(
        F.when(F.col("l_suppkey") % 20 == 0, "").otherwise(supp).alias("src"),
        F.when(F.col("l_linenumber") == 7, supp).otherwise(F.concat(F.lit("p"), "l_partkey")).alias("dst"),
        F.when(F.col("l_quantity") == 1, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("w"))
    return quality.graph_findings(edges).groupBy("src", "finding").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- Python functions


@query("scalar_and_predicate_udf", """
SELECT c_custkey, length(c_name) * 2 AS doubled FROM customer WHERE c_custkey % 7 <> 0 AND 100 // (c_custkey % 7) > 20""")
def _(spark, d):
    twice = udf.scalar_function(lambda s: len(s) * 2, "bigint")
    usable = udf.predicate(lambda k: 100 // (k % 7) > 20)
    return load(spark, d, "customer").filter(usable("c_custkey")).select("c_custkey", twice("c_name").alias("doubled"))


@query("table_udf", """
WITH w AS (SELECT doc_id, unnest(string_split(text, '. ')) AS sentence FROM documents)
SELECT doc_id, length(sentence) AS size, count(*) AS n FROM w GROUP BY 1, 2""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    sizes = udf.table_function(docs, lambda r: [(len(s),) for s in r["text"].split(". ")], "size bigint", ["doc_id"])
    return sizes.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"))


@query("aggregate_udf", """
SELECT l_returnflag, max(l_extendedprice) - min(l_extendedprice) AS spread, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    items = load(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return udf.aggregate_function(
        items, ["l_returnflag"], lambda g: (g["l_extendedprice"].min(), g["l_extendedprice"].max(), len(g)),
        lambda a, b: (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2]), "lo double, hi double, n bigint",
        lambda s: (s[1] - s[0], s[2]), "spread double, n bigint")


def _upper_sizes(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"pos": pdf["pos"], "doc_id": pdf["doc_id"], "n_lines": pdf["text"].str.count("\n") + 1})


@query("chunked_batch_udf", """
SELECT row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos, doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "n_chars", "text")
    return udf.chunked_batches(docs, ["n_chars", "doc_id"], _upper_sizes, "pos bigint, doc_id bigint, n_lines bigint")


__all__ = ["day", "ab_fixture", "order_versions", "task_log"]
