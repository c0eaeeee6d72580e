"""Stream forms equal batch forms over several micro-batches; restarts change nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomline.session import scratch_path
from loomline.sources import readers, writers
from loomline.streaming import flow, stateful, steps

SECOND = 1_000_000


@pytest.fixture(scope="module")
def log_dir(spark):
    """Three files of a call log, each later in time than the one before."""
    rng, folder, clock = random.Random(7), scratch_path(spark, "log"), 0
    for part in range(3):
        rows = []
        for i in range(60):
            clock += rng.randint(1, 4)
            rows.append((part * 60 + i, rng.choice(["u", "u", "v", "w"]), rng.choice(["view", "click", "error"]), clock * SECOND))
        df = spark.createDataFrame(rows, "event_id long, user string, event_type string, t long")
        df = df.withColumn("ts", F.timestamp_micros("t")).coalesce(1)
        df.write.mode("append").parquet(folder)
    return folder


def stream_of(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("kind,inputs,made", [
    ("state_transitions", ["event_type"], steps.state_transitions([("view", "click"), ("click", "error"), ("error", "view")], "view")),
])
def test_stateful_stream_equals_batch(spark, log_dir, kind, inputs, made):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    ok = F.col("event_type") != "error"
    live = stateful.stream_steps(stream_of(spark, log_dir).withColumn("ok", ok), kind, ["user"], ["t", "event_id"], inputs, made)
    batch = stateful.run_steps(spark.read.parquet(log_dir).withColumn("ok", ok), kind, ["user"], ["t", "event_id"], inputs, made)
    assert rows_of(flow.run_append(live).select(batch.columns)) == rows_of(batch)


def test_delayed_release_stream(spark, log_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    items = stream_of(spark, log_dir).select("event_id", "user", "ts", (F.col("t") + 30 * SECOND).alias("release_us"))
    out = flow.run_append(stateful.stream_delayed_release(items, ["user"], "ts", "release_us"))
    seen = spark.read.parquet(log_dir)
    last = seen.agg(F.max("t")).first()[0]
    due = {r.event_id for r in seen.filter(F.col("t") + 30 * SECOND <= last - SECOND).select("event_id").collect()}
    got = [r.event_id for r in out.collect()]
    assert len(got) == len(set(got)) and due <= set(got)


def test_late_rows_run_in_their_place(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    rng, folder, files = random.Random(3), scratch_path(spark, "late"), [[], [], [], []]
    for i in range(200):
        clock = i * 2 + 1  # Spark drops times up to the first watermark, zero
        row = (i, rng.choice(["u", "v"]), rng.choice(["view", "click", "error", None]), rng.choice([2**53 + 1, None]), clock * SECOND)
        files[min(2, clock // 150 + rng.randint(0, 1))].append(row)
    files[3] = [(999, "end", "view", 1, 10_000 * SECOND)]
    for rows in files:
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "event_id long, user string, event_type string, big long, t long")
        df.withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode("append").parquet(folder)
    made = steps.state_transitions([("view", "click"), ("click", "error"), ("error", "view")], "view")
    order = ["t", "event_id"]
    live = stateful.stream_steps(stream_of(spark, folder), "state_transitions", ["user"], order, ["event_type"], made, "ts", "400 seconds")
    batch = stateful.run_steps(spark.read.parquet(folder), "state_transitions", ["user"], order, ["event_type"], made).filter("user <> 'end'")
    got = rows_of(flow.run_append(live).filter("user <> 'end'").select(batch.columns))
    assert len(got) == 200 and got == rows_of(batch)


def test_many_delayed_items_of_one_key(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    folder, n = scratch_path(spark, "delayed"), 10_000
    items = spark.range(n).select(
        F.lit("k").alias("user"), (F.col("id") + 2**53 + 1).alias("big"), F.when(F.col("id") % 2 == 0, "x").alias("text"),
        F.timestamp_micros(F.col("id") * 10 + SECOND).alias("ts"), ((n - F.col("id")) * SECOND).alias("release_us"))
    items.coalesce(1).write.parquet(folder)
    late = spark.createDataFrame([("k", 1, "end")], "user string, big long, text string")
    late = late.withColumns({"ts": F.timestamp_micros(F.lit(10**12)), "release_us": F.lit(10**15)})
    late.coalesce(1).write.mode("append").parquet(folder)
    out = flow.run_append(stateful.stream_delayed_release(stream_of(spark, folder), ["user"], "ts", "release_us"))
    assert rows_of(out) == rows_of(items.drop("ts"))


def test_dedup_counters_and_rate_streams(spark, log_dir):
    twice = stream_of(spark, log_dir).unionByName(stream_of(spark, log_dir))
    assert flow.run_append(flow.stream_deduplicate(twice, ["event_id"])).count() == 180
    counters = flow.run_updates(flow.stream_counters(stream_of(spark, log_dir), "event_type", "1 minute"), ["start", "event_type"])
    want = spark.read.parquet(log_dir).groupBy(F.window("ts", "1 minute")["start"].alias("start"), "event_type").count()
    assert rows_of(counters) == rows_of(want)
    rates = flow.run_updates(flow.windowed_rate(stream_of(spark, log_dir), ["event_type"], "2 minutes", "1 minute").select(
        F.col("window.start").alias("start"), "event_type", "n", "rate"), ["start", "event_type"])
    assert rates.agg(F.sum("n")).first()[0] == 360


def test_folder_tables_stream_like_single_files(spark, log_dir):
    folder = scratch_path(spark, "tables")
    spark.read.parquet(log_dir).repartition(5).write.parquet(f"{folder}/events.parquet")
    stream = flow.table_stream(spark, folder, "events", files_per_trigger=2)
    assert flow.run_append(stream.select("event_id")).count() == 180
    unique = flow.stream_deduplicate(stream.unionByName(flow.table_stream(spark, folder, "events", files_per_trigger=2)), ["event_id"])
    assert flow.run_append(unique).count() == 180
    assert flow.run_append(stream.filter("event_id < 0").select("event_id")).count() == 0


def test_restart_continues_where_it_stopped(spark, log_dir):
    out, ckpt, folder = scratch_path(spark, "out"), scratch_path(spark, "ckpt"), scratch_path(spark, "grow")
    all_rows = spark.read.parquet(log_dir)
    all_rows.filter("event_id < 100").write.parquet(folder)
    flow.run_append(stream_of(spark, folder).select("event_id"), out, ckpt)
    all_rows.filter("event_id >= 100").write.mode("append").parquet(folder)
    result = flow.run_append(stream_of(spark, folder).select("event_id"), out, ckpt)
    assert rows_of(result) == [(i,) for i in sorted(range(180), key=lambda i: repr((i,)))]


def test_fan_out_batch_is_idempotent(spark):
    a, b = scratch_path(spark, "a"), scratch_path(spark, "b")
    write = writers.fan_out_batch({"a": a, "b": b})
    for _ in range(2):
        write(spark.range(5), 0)
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 5


def test_entries_and_changes(spark):
    entries = spark.createDataFrame([("a", 1, 0.0), ("b", 5, None), ("c", 3, -1.0), ("d", 2, 10.0)], "key string, hit_count int, ttl double")
    entries = entries.withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "tags": F.array(F.lit("x"))})
    at = F.lit("2024-01-01 00:30:00").cast("timestamp")
    assert {r.key for r in flow.live_entries(entries, at).collect()} == {"a", "b", "c"}
    assert {r.key for r in flow.live_entries(entries, at, default_ttl=60.0).collect()} == {"c"}
    assert {r.key for r in flow.invalidate(entries, least_used=2).collect()} == {"b", "c"}
    assert flow.invalidate(entries, least_used=4).count() == 0
    assert flow.invalidate(entries, tag="x").count() == 0


def test_metric_lines(spark):
    rows = spark.createDataFrame([("a b", 1.5, "x,y", None), ("c", 2.0, "z", "")], "name string, value double, t string, u string")
    lines = rows.select(writers.line_protocol(F.lit("m 1"), {"t": F.col("t"), "u": F.col("u")}, F.lit(7)).alias("i"), writers.statsd_line().alias("s")).collect()
    assert [r.i for r in lines] == ["m\\ 1,t=x\\,y a\\ b=1.5 7", "m\\ 1,t=z c=2.0 7"]
    assert [r.s for r in lines] == ["pipeline.a b:1.5|g", "pipeline.c:2.0|g"]


def test_csv_values_with_line_breaks(spark):
    path = scratch_path(spark, "io")
    rows = spark.createDataFrame([("1", 'a "q"; b\nc'), ("2", "x\r\n\ny"), ("3", "é")], "id string, note string")
    assert writers.write_csv_records(rows, path, sep=";")
    assert rows_of(readers.read_csv_records(spark, path, sep=";")) == rows_of(rows)
    plain = rows.filter("id = '3'")
    assert writers.write_csv_records(plain, path + "/plain")
    assert rows_of(readers.read_csv_records(spark, path + "/plain", multi_line=False)) == rows_of(plain)


def test_sources_round_trip(spark):
    path = scratch_path(spark, "io")
    rows = spark.createDataFrame([("1", 'a "q", b\nc'), ("2", "é")], "id string, note string")
    assert writers.write_csv_records(rows, path + "/csv") and not writers.write_csv_records(rows.limit(0), path + "/none")
    assert rows_of(readers.read_csv_records(spark, path + "/csv", rows.columns, multi_line=True)) == rows_of(rows)
    spark.createDataFrame([('{"a": 1}',), ("",), ("{bad",)], "value string").coalesce(1).write.text(path + "/json")
    got = readers.read_json_records(spark, path + "/json", "a int", corrupt="_bad")
    assert rows_of(got) == [(1, None), (None, "{bad")]
    spark.createDataFrame([("<r><i>x</i><i>y</i></r>",)], "value string").coalesce(1).write.text(path + "/xml")
    assert rows_of(readers.read_xml_records(spark, path + "/xml", "i")) == [("x",), ("y",)]
    whole = readers.read_text_lines(spark, path + "/json", whole=True)
    assert whole.count() == 1 and readers.read_file_tree(spark, path + "/json", "*.txt").first().kind == "txt"
    assert readers.files_per_kind(readers.read_file_tree(spark, path, "*.txt", with_hash=False)).first().files == 2
    assert readers.read_file_contents(spark, path + "/xml", "*.txt").first().content.startswith("<r>")


def test_file_changes_as_a_stream(spark, tmp_path):
    import os

    from loomline.streaming.watch import file_change_stream
    folder, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    listings, seen = (tmp_path / "listings").as_uri(), set()

    def changes():
        got = flow.run_append(file_change_stream(spark, folder.as_uri(), listings, "*.txt"), out, ckpt)
        rows = {(r.path, r.change, r.version) for r in got.collect()}
        assert got.count() == len(rows)
        fresh, _ = rows - seen, seen.update(rows)
        return fresh

    assert changes() == set()
    (folder / "deep").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "deep/c.txt", "skip.csv"):
        (folder / name).write_text(name)
    assert changes() == {("a.txt", "created", 1), ("b.txt", "created", 1), ("deep/c.txt", "created", 1)}
    assert changes() == set()
    os.utime(folder / "a.txt", ns=(1, 1))
    (folder / "b.txt").unlink()
    (folder / "d.txt").write_text("")
    assert changes() == {("a.txt", "modified", 2), ("b.txt", "deleted", 2), ("d.txt", "created", 2)}
    (folder / "b.txt").write_text("again")
    assert changes() == {("b.txt", "created", 3)}
