"""Execution, A/B, usage, cache and health reports over log tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import materialize


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 when the divisor is 0 or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def execution_summary(tasks: DataFrame) -> DataFrame:
    """Totals of a task log (status, start_time, end_time; end 0 = running)."""
    ended = F.col("end_time") > 0
    done = F.count_if(F.col("status") == "completed")
    spent = F.when(ended, F.col("end_time") - F.col("start_time"))
    elapsed = F.max(F.when(ended, F.col("end_time"))) - F.min("start_time")
    return tasks.agg(
        F.count(F.lit(1)).alias("total"), done.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        _ratio(done, F.count(F.lit(1))).alias("success_rate"),
        F.coalesce(F.avg(spent), F.lit(0.0)).alias("avg_duration"),
        _ratio(done, elapsed).alias("throughput"))


def worker_load(tasks: DataFrame, worker: str, duration: str, ok: Column) -> DataFrame:
    """Per worker counts, mean duration, success rate and share of all time."""
    per = tasks.groupBy(worker).agg(
        F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"),
        F.sum(duration).alias("busy"), F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("busy").alias("_all"))
    # one-row total, attached as a scalar subquery
    share = _ratio(F.col("busy"), total.scalar())
    return per.select(worker, "completed", "failed", _ratio(F.col("busy"), F.col("_n")).alias("avg_duration"),
                      _ratio(F.col("completed"), F.col("_n")).alias("success_rate"), share.alias("load"))


def slow_task_bottlenecks(tasks: DataFrame, duration: str, fraction: float = 0.8) -> DataFrame:
    """Ended tasks that took more than ``fraction`` of the longest one."""
    longest = tasks.agg(F.max(duration)).scalar()
    return tasks.filter(F.col(duration) > longest * fraction)


def ab_test_stats(results: DataFrame, variants: DataFrame) -> DataFrame:
    """Per variant impressions, successes, failures and zero-safe rates.

    Results of undeclared variants are ignored; quality counts on success only.
    Declared variants without a result appear with zeros.
    """
    ok = F.col("success")
    facts = results.groupBy("test_id", "variant_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        F.sum("response_time").alias("_time"), F.sum(F.when(ok, F.col("quality_score"))).alias("_quality"),
        F.sum("tokens_used").alias("tokens"))
    joined = variants.join(facts, ["test_id", "variant_id"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        "test_id", "variant_id", "decl_pos", n("impressions"), n("successes"), n("failures"), n("tokens"),
        _ratio(F.col("successes"), F.col("impressions")).alias("success_rate"),
        _ratio(F.col("_time"), F.col("impressions")).alias("avg_response_time"),
        _ratio(F.col("_quality"), F.col("successes")).alias("avg_quality"))


def ab_winner(stats: DataFrame) -> DataFrame:
    """Highest success rate among shown variants; the first declared wins ties."""
    shown = stats.filter(F.col("impressions") > 0)
    best = F.struct(F.col("success_rate"), -F.col("decl_pos"))
    return shown.groupBy("test_id").agg(F.max_by("variant_id", best).alias("winner"))


def ab_leaderboard(stats: DataFrame) -> DataFrame:
    """Variants of a test by rounded success percentage; ties in declared order."""
    board = stats.withColumn("success_pct", F.round(F.col("success_rate") * 100, 1))
    order = Window.partitionBy("test_id").orderBy(F.desc("success_pct"), "decl_pos")
    return board.withColumn("rank", F.row_number().over(order).cast("bigint"))


def ab_assign_variant(units: DataFrame, variants: DataFrame, bucket: Column) -> DataFrame:
    """Sticky weighted assignment of units (test_id, ...) to enabled variants.

    ``bucket`` is a non-negative integer per unit. The variants of a test become
    one sorted array of cumulative weights (a test has a handful of variants), so
    the weighted pick is an equi-join plus an array lookup.
    """
    usable = variants.filter("enabled and weight > 0").withColumn(
        "_upto", F.sum("weight").over(Window.partitionBy("test_id").orderBy("decl_pos")))
    tests = usable.groupBy("test_id").agg(
        F.array_sort(F.collect_list(F.struct("_upto", "variant_id"))).alias("_ladder"), F.sum("weight").alias("_total"))
    picked = units.withColumn("_bucket", bucket).join(tests, "test_id")
    spot = F.pmod(F.col("_bucket"), F.col("_total"))
    step = F.try_element_at(F.filter("_ladder", lambda s: s["_upto"] > spot), F.lit(1))
    return picked.select(*units.columns, step["variant_id"].alias("variant_id"))


def provider_usage_rollup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, errors, rate limits, tokens, cost and latency per provider, and in total.

    The total row has ``provider`` = ``(all)``. Unknown providers cost 0.
    """
    per = usage.groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("error").alias("errors"),
        F.count_if("rate_limited").alias("rate_limits"), F.sum("tokens").alias("tokens"),
        F.sum("latency_ms").alias("_latency"))
    priced = per.join(prices, "provider", "left").withColumn(
        "_cost", F.col("tokens") / 1e6 * F.coalesce("usd_per_million", F.lit(0.0)))
    rolled = priced.rollup("provider").agg(
        *[F.sum(c).alias(c) for c in ("calls", "errors", "rate_limits", "tokens", "_latency", "_cost")],
        F.grouping("provider").alias("_total"))
    name = F.when(F.col("_total") == 1, "(all)").otherwise(F.col("provider"))
    return rolled.select(name.alias("provider"), "calls", "errors", "rate_limits", "tokens",
                         F.round("_cost", 4).alias("cost"),
                         F.round(_ratio(F.col("_latency"), F.col("calls")), 4).alias("avg_latency"))


def weighted_ranking(df: DataFrame, weights: Mapping[str, float], tiebreak: Sequence[str], n: int | None = None) -> DataFrame:
    """Score = weighted sum of measures; ``rank`` by score, ties by ``tiebreak``."""
    from loomline.plans.ordered import with_position
    score = sum((F.col(m) * w for m, w in weights.items()), F.lit(0.0))
    scored = df.withColumn("score", F.round(score, 6))
    if n is not None:
        from loomline.operators.sorting import top_n
        return top_n(scored, n, [F.desc("score"), *tiebreak])
    return with_position(scored, [F.desc("score"), *tiebreak], "rank", start=1)


def health_rollup(checks: DataFrame, service: str) -> DataFrame:
    """Worst state per service: a critical unhealthy check, else any degraded one."""
    bad = F.bool_or((F.col("status") == "UNHEALTHY") & F.col("critical"))
    weak = F.bool_or(F.col("status") == "DEGRADED")
    overall = F.when(bad, "UNHEALTHY").when(weak, "DEGRADED").otherwise("HEALTHY")
    return checks.groupBy(service).agg(overall.alias("overall"), F.count(F.lit(1)).alias("checks"))


def batch_result_report(items: DataFrame, batch: str, ident: str, process) -> tuple[DataFrame, DataFrame]:
    """Counts per batch, and the failing items with their messages.

    ``process`` is a Python function of a row dict; a row that raises fails alone.
    The outcome is written once and read for both. Errors stay rows of their own
    table, so a bad batch is never one huge value.
    """
    schema = T.StructType([*items.select(batch, ident).schema.fields,
                           T.StructField("ok", T.BooleanType()), T.StructField("message", T.StringType())])

    def attempt(batches):
        for rows in batches:
            messages = []
            for row in rows.to_pylist():
                try:
                    process(row)
                    messages.append(None)
                except Exception as error:  # noqa: BLE001 - a failing item must not stop its batch
                    messages.append(str(error))
            yield pa.record_batch([rows.column(batch), rows.column(ident), pa.array([m is None for m in messages], pa.bool_()),
                                   pa.array(messages, pa.string())], names=schema.names)

    outcome = materialize(items.mapInArrow(attempt, schema), "outcome")
    report = outcome.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"))
    return report, outcome.filter(~F.col("ok")).select(batch, ident, "message")


def cache_usage_report(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hits, misses, writes and hit rate of an access log (``op`` column)."""
    hits, misses = F.count_if(F.col("op") == "hit"), F.count_if(F.col("op") == "miss")
    return log.groupBy(*keys).agg(
        hits.alias("hits"), misses.alias("misses"), F.count_if(F.col("op") == "write").alias("writes"),
        _ratio(hits, hits + misses).alias("hit_rate"))


def cache_entry_report(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("total_entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"),
        _ratio(F.sum("hit_count"), F.count(F.lit(1))).alias("avg_hits"))


def least_loaded_candidate(nodes: DataFrame, capability: str, load: str, ident: str, online: Column) -> DataFrame:
    """Per capability the online row with the lowest load (ties: lowest id)."""
    return nodes.filter(online).groupBy(capability).agg(
        F.min_by(ident, F.struct(load, ident)).alias(ident), F.min(load).alias(load))


def least_loaded_for(nodes: DataFrame, capability: str, load: str, ident: str, online: Column,
                     capabilities: str = "capabilities") -> DataFrame:
    """The single best row among online rows whose array has ``capability``."""
    able = nodes.filter(online & F.array_contains(capabilities, capability))
    return able.orderBy(load, ident).limit(1)
