"""Registered queries: streams, state machines, expiry, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.catalog.registry import query
from loomline.operators import filters, reshape
from loomline.session import read_written, scratch_path
from loomline.streaming import flow, stateful, watch
from loomline.tables import load, micros

_CALLS = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


def call_log(spark, d):
    """Events per user as a call log with the time in microseconds."""
    return load(spark, d, "events").select("user_id", "event_id", "event_type", "value", micros("ts").alias("t"))


ORDER = ["t", "event_id"]

# ---------------------------------------------------------------- streams


@query("stream_stages", """
WITH k AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k, CASE WHEN k % 13 = 0 THEN 'bad k' WHEN event_type = 'error' AND k > 90 THEN 'late error' END AS problem FROM k WHERE event_type <> 'view'""")
def _(spark, d):
    stages = [
        lambda df: filters.filter_predicate(df, F.col("event_type") != "view"),
        lambda df: reshape.split_failures(
            df, {"k": reshape.json_get(F.col("props"), "k", "bigint")},
            {"bad k": reshape.json_get(F.col("props"), "k", "bigint") % 13 == 0,
             "late error": (F.col("event_type") == "error") & (reshape.json_get(F.col("props"), "k", "bigint") > 90)}),
        lambda df: df.select("event_id", "k", F.col("_error").alias("problem"))]
    checked = reshape.chain_stages(flow.table_stream(spark, d, "events"), stages)
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")

    def split(batch, n):
        batch.persist()
        batch.filter("problem is null").write.mode("overwrite").parquet(f"{good}/batch_id={n}")
        batch.filter("problem is not null").write.mode("overwrite").parquet(f"{bad}/batch_id={n}")
        batch.unpersist()

    flow.run_batches(checked, split).awaitTermination()
    both = [read_written(spark, path, checked.schema).select("event_id", "k", "problem") for path in (good, bad)]
    return both[0].unionByName(both[1])


@query("event_routing", """
WITH s(subscriber, type, priority) AS (VALUES ('audit', '*', 10), ('sales', 'purchase', 5), ('sales', 'signup', 5), ('ops', 'error', 7))
SELECT subscriber, priority, event_type, count(*) AS n FROM events JOIN s ON type = '*' OR type = event_type GROUP BY 1, 2, 3""")
def _(spark, d):
    subscriptions = spark.createDataFrame(
        [("audit", "*", 10), ("sales", "purchase", 5), ("sales", "signup", 5), ("ops", "error", 7), ("broken", "*", 8)],
        "subscriber string, type string, priority int")
    routed = flow.route_events(flow.table_stream(spark, d, "events").select("event_id", "event_type"), subscriptions)
    out = scratch_path(spark, "inbox")

    def write(name):
        return lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/inbox={name}/batch_id={n}")

    def broken(rows, n):
        raise RuntimeError("this subscriber always fails")

    handlers = {"audit": write("audit"), "sales": write("sales"), "ops": write("ops"), "broken": broken}
    flow.run_batches(routed, flow.deliver(handlers)).awaitTermination()
    inbox = read_written(spark, out, routed.schema)
    return inbox.groupBy("subscriber", "priority", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_deduplicate", "SELECT event_id, event_type FROM events")
def _(spark, d):
    events = flow.table_stream(spark, d, "events").select("event_id", "event_type", "ts")
    again = flow.table_stream(spark, d, "events").select("event_id", "event_type", "ts").filter("event_id % 3 = 0")
    unique = flow.stream_deduplicate(events.unionByName(again), ["event_id"], delay="40 days")
    return flow.run_append(unique).select("event_id", "event_type")


@query("sliding_rate", """
WITH w AS (SELECT event_id, event_type, count(*) OVER x AS n, epoch_us(ts) - min(epoch_us(ts)) OVER x AS span FROM events
  WINDOW x AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
SELECT event_id, event_type, n, round(n / CASE WHEN span > 0 THEN span / 1e6 ELSE 1 END, 6) AS rate FROM w""")
def _(spark, d):
    events = load(spark, d, "events").select("event_id", "event_type", micros("ts").alias("us"))
    rates = flow.sliding_rate(events, ["event_type"], "us", "event_id", 3_600_000_000)
    return rates.select("event_id", "event_type", "n", F.round("rate", 6).alias("rate"))


@query("stream_counters", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, d):
    counters = flow.stream_counters(flow.table_stream(spark, d, "events"), "event_type")
    last = flow.run_updates(counters, ["start", "event_type"])
    return last.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


# ---------------------------------------------------------------- order-dependent operators


@query("quota_by_calendar_day", """
SELECT event_id, rn <= 2 AS admitted, greatest(2 - rn, 0) AS remaining FROM (
 SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events)""")
def _(spark, d):
    calls = load(spark, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    return stateful.unit_quota_by_day(calls, ["user_id"], "day", ["ts", "event_id"], 2).select("event_id", "admitted", "remaining")


ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("error", "view")]


@query("state_transition_audit", _CALLS + """,
a(f, n) AS (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'view'), ('view', 'error'), ('error', 'view')),
r(user_id, rn, event_id, before, after, accepted) AS (SELECT user_id, rn, event_id, 'signup', CASE WHEN event_type = 'view' THEN 'view' ELSE 'signup' END, event_type = 'view' FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, e.event_id, r.after, CASE WHEN a.f IS NULL THEN r.after ELSE e.event_type END, a.f IS NOT NULL
 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1 LEFT JOIN a ON a.f = r.after AND a.n = e.event_type)
SELECT event_id, accepted, before AS state_before, after AS state_after FROM r""")
def _(spark, d):
    audited = stateful.state_transition_audit(call_log(spark, d), ["user_id"], ORDER, "event_type", ALLOWED, "signup")
    return audited.select("event_id", "accepted", "state_before", "state_after")


# ---------------------------------------------------------------- entries, files, resume, delays


def cache_entries(spark, d):
    """Documents as cache entries with mixed TTLs, tags and hit counts."""
    k = F.col("doc_id") % 4
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return load(spark, d, "documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("key"), (F.col("n_chars") % 100).alias("hit_count"),
        F.array("lang", "source").alias("tags"), (start + F.make_dt_interval(mins=(F.col("doc_id") % 720).cast("int"))).alias("created_at"),
        F.when(k == 0, 0.0).when(k == 2, -1.0).when(k == 3, 7200.0).alias("ttl"))


_ENTRIES = """WITH e AS (SELECT 'doc/' || doc_id AS key, n_chars % 100 AS hit_count, lang, TIMESTAMP '2024-01-01' + to_minutes(doc_id % 720) AS created_at,
 CASE doc_id % 4 WHEN 2 THEN NULL WHEN 3 THEN 7200 ELSE 3600 END AS ttl FROM documents)"""


@query("expiring_entries", _ENTRIES + """,
i AS (SELECT key, hit_count, created_at FROM e WHERE NOT regexp_matches(key, '^doc/1') AND lang <> 'fr' AND created_at >= TIMESTAMP '2024-01-01 01:00:00')
SELECT 'live' AS kind, key FROM e WHERE ttl IS NULL OR created_at + to_seconds(ttl) >= TIMESTAMP '2024-01-01 06:00:00'
UNION ALL SELECT 'kept', key FROM i WHERE key NOT IN (SELECT key FROM i ORDER BY hit_count, created_at, key LIMIT 50)""")
def _(spark, d):
    entries = cache_entries(spark, d)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    live = flow.live_entries(entries, at("2024-01-01 06:00:00")).select(F.lit("live").alias("kind"), "key")
    kept = flow.invalidate(entries, "doc/1", "fr", at("2024-01-01 01:00:00"), 50).select(F.lit("kept").alias("kind"), "key")
    return live.unionByName(kept)


@query("file_change_feed", """
SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents WHERE doc_id % 10 IN (0, 1)
UNION ALL SELECT 'new/' || doc_id, 'created' FROM documents WHERE doc_id % 50 = 3""")
def _(spark, d):
    at = F.lit("2024-01-01").cast("timestamp")
    docs = load(spark, d, "documents").select("doc_id")
    before = docs.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), at.alias("modified"), "doc_id")
    newer = F.when(F.col("doc_id") % 10 == 1, at + F.expr("interval 1 hour")).when(F.col("doc_id") % 10 == 2, at - F.expr("interval 1 hour")).otherwise(at)
    after = before.filter("doc_id % 10 <> 0").withColumn("modified", newer)
    fresh = docs.filter("doc_id % 50 = 3").select(F.concat(F.lit("new/"), "doc_id").alias("path"), at.alias("modified"), "doc_id")
    return flow.file_changes(before, after.unionByName(fresh))


@query("file_change_stream", """
SELECT lang, 1 AS version, 'created' AS change, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents GROUP BY 1
UNION ALL SELECT lang, 2, 'created', CAST(sum(strlen(text) + 1) AS BIGINT) FROM documents WHERE source = (SELECT min(source) FROM documents) GROUP BY 1""")
def _(spark, d):
    docs = load(spark, d, "documents")
    folder, listings, out, ckpt = [scratch_path(spark, label) for label in ("watched", "listings", "changes", "ckpt")]
    least = docs.agg(F.min("source").alias("source"))
    for rows in (docs, docs.join(least, "source", "left_semi")):
        rows.select("lang", "text").write.mode("append").partitionBy("lang").text(folder)
        found = flow.run_append(watch.file_change_stream(spark, folder, listings, "*.txt"), out, ckpt)
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), "version", "change").agg(F.sum("size").alias("size"))


@query("incremental_resume", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS run, 'doc/' || doc_id AS path, length(text) AS size FROM documents
UNION ALL SELECT 3, 'doc/' || doc_id, length(text) + 1 FROM documents WHERE doc_id % 100 = 5""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"))
    ledger, out = scratch_path(spark, "ledger"), scratch_path(spark, "out")
    measure = lambda df: df.select("path", F.length("content").cast("bigint").alias("size"))
    edited = docs.withColumn("content", F.when(F.col("doc_id") % 100 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    for items in (docs.filter("doc_id % 2 = 0"), docs, docs, edited):
        flow.resume_run(items.select("path", "content"), "measure", ledger, out, measure)
    return spark.read.parquet(out).select("run", "path", "size")


@query("delayed_release", """
WITH a AS (SELECT event_id, epoch_us(ts) + CAST(round(value * 3600 * 1e6) AS BIGINT) AS due_us FROM events)
SELECT event_id, due_us, row_number() OVER (ORDER BY due_us, event_id) - 1 AS pos FROM a WHERE due_us <= epoch_us(TIMESTAMP '2024-01-15')""")
def _(spark, d):
    from loomline.plans.ordered import with_position
    items = load(spark, d, "events").select("event_id", "ts", F.round(F.col("value") * 3600, 6).alias("delay"))
    due = flow.delayed_release(items, "ts", "delay", F.lit("2024-01-15").cast("timestamp_ntz"))
    due = due.select("event_id", micros("available_at").alias("due_us"))
    return with_position(due, ["due_us", "event_id"], "pos")
