"""Literal fixtures for filters, reshaping, sorting, joins, sets and aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from loomline.operators import aggregates, analytics, filters, joins, quality, reshape, sets, sorting, windows


def values(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_filters(spark):
    status = spark.createDataFrame([("a", "active"), ("b", "inactive"), ("c", "active"), ("d", None)], "name string, status string")
    assert values(filters.filter_key_equals(status, status="active"), "name") == [("a",), ("c",)]
    assert values(filters.filter_key_equals(status, status=None), "name") == [("d",)]
    assert filters.find_first(status, ["name"], status="active").first().name == "a"
    numbers = spark.createDataFrame([(1,), (6,), (3,), (8,), (2,)], "v int")
    assert values(filters.filter_predicate(numbers, F.col("v") > 5), "v") == [(6,), (8,)]
    assert values(filters.filter_predicate(numbers, F.col("v") > 5, keep=False), "v") == [(1,), (2,), (3,)]
    texts = spark.createDataFrame([("3",), ("7.5",), ("x",), (None,), ("12",)], "v string")
    assert values(filters.filter_range(texts, "v", 3, 10), "v") == [("3",), ("7.5",)]
    either = [F.col("v") > 100, F.col("v") < 0]
    assert filters.filter_composite(numbers, either, "or").count() == 0
    typed = spark.createDataFrame([("1",), ('"x"',), ("true",), ("null",)], "j string").withColumn("v", F.try_parse_json("j"))
    assert values(filters.filter_value_type(typed, F.col("v"), ["BIGINT"]), "j") == [("1",)]
    assert values(filters.filter_value_type(typed, F.col("v"), ["BIGINT"], allow_null=True), "j") == [("1",), ("null",)]
    tags = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"])], "id int, tags array<string>")
    assert values(filters.filter_has_tag(tags, "x"), "id") == [(1,)]


def test_merges_and_defaults(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, v int")
    over = spark.createDataFrame([(2, None), (3, 30)], "k int, v int")
    assert values(reshape.overlay_merge(base, over, "k"), "k", "name", "v") == [(1, "a", 10), (2, "b", None), (3, None, 30)]
    maps = spark.createDataFrame([({"a": "1", "b": None}, {"b": "2", "c": None})], "x map<string,string>, y map<string,string>")
    assert maps.select(reshape.merge_maps(F.col("x"), F.col("y")).alias("m")).first().m == {"a": "1", "b": "2", "c": None}
    kept = maps.select(reshape.map_value_or_default(F.col("x"), "b", F.lit("d")).alias("b"), reshape.map_value_or_default(F.col("x"), "z", F.lit("d")).alias("z")).first()
    assert (kept.b, kept.z) == (None, "d")
    nested = spark.sql("select named_struct('a', named_struct('p', 1, 'q', 2), 'b', 3) x, named_struct('a', named_struct('q', 9), 'c', 4) y")
    merged = nested.select(reshape.merge_structs(F.col("x"), nested.schema["x"].dataType, F.col("y"), nested.schema["y"].dataType).alias("m")).first().m
    assert merged.asDict(True) == {"a": {"p": 1, "q": 9}, "b": 3, "c": 4}
    deep = reshape.nested_set(nested.select("x"), "x.a.new.leaf", F.lit(7))
    assert deep.first().x.asDict(True) == {"a": {"p": 1, "q": 2, "new": {"leaf": 7}}, "b": 3}
    made = reshape.nested_set(spark.range(1), "m.n", F.lit(1)).first().m.asDict(True)
    assert made == {"n": 1}


def test_explode_replace_flatten(spark):
    flat = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    doubled = reshape.explode_rows(flat, F.array("v", F.col("v") * 2), "o")
    assert values(doubled, "o") == [(1,), (2,), (2,), (3,), (4,), (6,)]
    arrays = spark.sql("select array(array(array(1, 2)), array(array(3))) a")
    assert reshape.flatten_deep(arrays, "a").first().a == [1, 2, 3]
    mixed = spark.sql("select 'a1' s, array('b2') l, map('k3', 'c4') m, named_struct('t', 'd5') r, 6 n")
    got = reshape.regex_replace_all_fields(mixed, r"\d", "#").first()
    assert (got.s, got.l, got.m, got.r.t, got.n) == ("a#", ["b#"], {"k3": "c#"}, "d#", 6)


def test_migration_goes_both_ways(spark):
    steps = [(1, reshape.add_if_absent("x", 1), lambda d: d.drop("x")), (2, reshape.add_if_absent("y", 2), lambda d: d.drop("y"))]
    old = spark.createDataFrame([(5, 0)], "id int, version int")
    up = reshape.migrate_records(old, steps, 2)
    assert values(up, "id", "version", "x", "y") == [(5, 2, 1, 2)]
    down = reshape.migrate_records(up, steps, 0)
    assert "id" in down.columns and down.filter("version = 0").count() == 1


def test_templates(spark):
    templates = spark.createDataFrame([("t", 1, 1, "{{a}}!", True), ("t", 2, 2, "{{a}}?", False)], "name string, version int, pos int, template string, is_active boolean")
    rows = spark.createDataFrame([("t",)], "name string")
    context = F.create_map(F.lit("a"), F.lit("x"))
    assert reshape.render_templates(rows, templates, context).first().rendered == "x!"
    assert reshape.render_templates(rows, templates, context, F.lit(2)).first().rendered == "x?"


def test_rows_without_template_or_value_stay(spark):
    templates = spark.createDataFrame([("t", 1, 1, "{{a}}!", True)], "name string, version int, pos int, template string, is_active boolean")
    rows = spark.createDataFrame([("t", None), ("gone", "x"), ("t", "y")], "name string, a string")
    context = F.create_map(F.lit("a"), F.col("a"))
    got = sorted(reshape.render_templates(rows, templates, context).select("name", "rendered").collect(), key=str)
    assert [tuple(r) for r in got] == [("gone", None), ("t", "None!"), ("t", "y!")]
    assert reshape.render_templates(rows, templates, context, F.lit(9)).count() == 3


def test_migration_keeps_unknown_versions(spark):
    steps = [(1, reshape.add_if_absent("x", 1), lambda d: d.drop("x"))]
    old = spark.createDataFrame([(5, 0), (6, 7), (7, None)], "id int, version int")
    assert sorted(values(reshape.migrate_records(old, steps, 1), "id", "version", "x")) == [(5, 1, 1), (6, 7, None), (7, None, None)]


def test_pairs_of_large_groups_are_exact(spark):
    from math import comb
    asked = []
    for n in (2, 3, 1000, 200_000_000, 2**31):
        total = comb(n, 2)
        asked += [(n, 0, 0, 1), (n, total - 1, n - 2, n - 1)]
        a = n // 3
        for b in {a + 1, n - 1} if a + 1 < n else ():
            asked.append((n, a * (2 * n - a - 1) // 2 + b - a - 1, a, b))
    df = spark.createDataFrame(asked, "n long, rank long, a long, b long")
    a, b = joins.pair_at(F.col("n"), F.col("rank"))
    assert all((r.x, r.y) == (r.a, r.b) for r in df.select("*", a.alias("x"), b.alias("y")).collect())
    counts = df.select("n", joins.combination_count(F.col("n"), 2).alias("c")).distinct().collect()
    assert all(r.c == comb(r.n, 2) for r in counts)


def test_batches_follow_the_recursive_halving(spark):
    def halve(items, most):
        if len(items) <= most:
            return [items] if items else []
        mid = len(items) // 2
        return halve(items[:mid], most) + halve(items[mid:], most)

    for n, most in ((1, 3), (10, 3), (37, 4), (64, 5)):
        got = sorting.assign_batches(spark.range(n), ["id"], max_leaf=most)
        leaves = {}
        for r in got.collect():
            leaves.setdefault((r.leaf_start, r.leaf_rows), []).append(r.id)
        assert sorted(sorted(v) for v in leaves.values()) == halve(list(range(n)), most)
    chunks = sorting.assign_batches(spark.range(10), ["id"], chunks=3, round_robin=4)
    assert [r["count"] for r in chunks.groupBy("chunk").count().orderBy("chunk").collect()] == [4, 3, 3]


def test_pages_and_samples(spark):
    paged = sorting.paginate(spark.range(25), ["id"], 10)
    assert values(paged.filter("page = 3"), "id", "total_pages", "has_next", "has_prev")[0] == (20, 3, False, True)
    assert sorting.get_page(spark.range(25), ["id"], 9, 10).count() == 0
    drawn = sorting.sample_rows(spark.range(100), "id", 7, 3)
    assert drawn.select("id").distinct().count() == 7
    assert values(drawn, "id", "draw") == values(sorting.sample_rows(spark.range(100).orderBy(F.desc("id")), "id", 7, 3), "id", "draw")


def test_far_slices_are_cut_by_position(spark, monkeypatch):
    df = spark.range(500).select(((F.col("id") * 7) % 500).alias("x"))
    near = [values(sorting.limit_offset(df, ["x"], 20, 100), "x"), values(sorting.top_n(df, 30, ["x"]), "x", "rank"),
            values(sorting.sample_rows(df, "x", 40, 1), "x", "draw")]
    monkeypatch.setattr(sorting, "FEW_ROWS", 10)
    far = [values(sorting.limit_offset(df, ["x"], 20, 100), "x"), values(sorting.top_n(df, 30, ["x"]), "x", "rank"),
           values(sorting.sample_rows(df, "x", 40, 1), "x", "draw")]
    assert near == far


def test_product_equals_itertools(spark):
    a, b = spark.range(4), spark.range(3).withColumnRenamed("id", "b")
    full = joins.product_slice([(a, ["id"]), (b, ["b"])])
    assert values(full, "id", "b") == sorted(itertools.product(range(4), range(3)), key=repr)
    part = joins.product_slice([(a, ["id"]), (b, ["b"])], 5, 8)
    assert values(part, "id", "b") == list(itertools.islice(itertools.product(range(4), range(3)), 5, 8))


def test_combinations_by_number(spark):
    for n in (2, 3, 9):
        items = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("x"))
        total = joins.combinations_count(n, 2)
        ranks = spark.range(-1, total + 2).select(F.lit(1).alias("g"), F.col("id").alias("rank"))
        got = joins.combinations_at(items, ["g"], ["x"], "x", ranks)
        assert [p[1:] for p in values(got, "rank", "first", "second")] == sorted(
            itertools.combinations(range(n), 2)) if n < 5 else got.count() == total
    counts = spark.range(6).select(joins.combination_count(F.col("id"), 3).alias("c"), joins.combination_count(F.col("id"), 3, "permutations").alias("p"))
    assert [tuple(r) for r in counts.collect()] == [(joins.combinations_count(n, 3), joins.permutations_count(n, 3)) for n in range(6)]


def test_rank_positions(spark):
    import bisect
    base = [5.0, 1.0, 3.0, 3.0, 3.0, 9.0]
    probe = [(1, 3.0), (2, 0.0), (3, 10.0), (4, 4.0), (5, 3.0)]
    got = joins.rank_position_join(spark.createDataFrame(probe, "id int, v double"), spark.createDataFrame([(x,) for x in base], "v double"), "v", "id")
    want = [(str(i), bisect.bisect_left(sorted(base), v), bisect.bisect_right(sorted(base), v)) for i, v in probe]
    assert values(got, "id", "left", "right") == sorted(want)


def test_diff_and_fields(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "b", None), (3, "c", 3), (4, "d", 4)], "k int, s string, n int")
    diff = joins.record_diff(old, new, "k")
    assert values(diff, "k", "status") == [(1, "removed"), (2, "modified"), (3, "unchanged"), (4, "added")]
    assert values(joins.field_changes(diff, "k", ["s", "n"]), "k", "field", "old_value", "new_value") == [(2, "n", "2", None)]


def test_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert values(sets.counter_arithmetic([a], [b], "k"), "k", "count") == [(1, 2), (2, 0), (3, -1)]
    assert values(sets.difference(a, b), "k") == [(1,)] and values(sets.intersection(a, b), "k") == [(2,)]
    first = sets.distinct_first(spark.createDataFrame([(None, 2), (None, 1), ("x", 3)], "k string, o int"), ["k"], ["o"])
    assert values(first, "k", "o") == sorted([(None, 1), ("x", 3)], key=repr)


def test_aggregates(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, None)], "type string, val int")
    grouped = aggregates.group_by_aggregate(t, "type", aggregates.sum_field("val").alias("s"), aggregates.avg_field("val").alias("a"), aggregates.count_field("val").alias("c"))
    assert values(grouped, "type", "s", "a", "c") == [("a", 4, 2.0, 2), ("b", 2, 2.0, 1), ("unknown", 0, 0.0, 0)]
    empty = t.limit(0).agg(aggregates.sum_field("val").alias("s"), aggregates.avg_field("val").alias("a"), *aggregates.min_max_any_all("val", "val", F.col("val") > 0)).first()
    assert (empty.s, empty.a, empty.any_holds, empty.all_hold) == (0, 0.0, False, True)
    maps = spark.createDataFrame([({"k": None},), ({"z": "1"},), (None,)], "m map<string,string>")
    assert maps.agg(aggregates.count_key("m", "k").alias("n")).first().n == 1
    stats = aggregates.descriptive_stats(spark.createDataFrame([("g", v, i) for i, v in enumerate([3, 1, 3, 1, 8])], "g string, v int, i int"), ["g"], "v", ["i"]).first()
    assert (stats.median, stats.median_low, stats["mode"], stats.n) == (3.0, 3, 3, 5)
    lists = aggregates.group_collect(spark.range(25).withColumn("g", F.lit(1)), ["g"], ["id"], F.col("id"), 10, hot_rows=5)
    assert [r.records for r in lists.orderBy("chunk").collect()] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_ab_and_usage(spark):
    variants = spark.createDataFrame([("t", "v1", 1, True, 0), ("t", "v2", 3, True, 1)], "test_id string, variant_id string, weight int, enabled boolean, decl_pos int")
    results = spark.createDataFrame([("t", "v1", True, 2.0, 0.5, 10), ("t", "v2", False, 4.0, 0.9, 20), ("t", "zz", True, 1.0, 1.0, 1)],
                                    "test_id string, variant_id string, success boolean, response_time double, quality_score double, tokens_used int")
    stats = analytics.ab_test_stats(results, variants)
    assert values(stats, "variant_id", "success_rate", "avg_quality") == [("v1", 1.0, 0.5), ("v2", 0.0, 0.0)]
    assert analytics.ab_winner(stats).first().winner == "v1"
    picked = analytics.ab_assign_variant(spark.range(8).withColumn("test_id", F.lit("t")), variants, F.col("id"))
    assert values(picked.groupBy("variant_id").count(), "variant_id", "count") == [("v1", 2), ("v2", 6)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 10), (2, 12), (3, 12), (4, 7)], "i int, v int")
    assert values(windows.pairwise(df, "v", ["i"]), "v", "next_value") == [(10, 12), (12, 12), (12, 7)]
    assert [r.split for r in windows.lap_splits(df, "v", ["i"]).orderBy("i").collect()] == [10, 2, 0, -5]
    runs = windows.consecutive_runs(df, "v", ["i"])
    assert values(runs, "run", "v", "n") == [(1, 10, 1), (2, 12, 2), (3, 7, 1)]
    product = windows.accumulate_custom(df.withColumns({"k": F.lit("k"), "x": F.col("v").cast("double")}), lambda a, b: a * b, "x", ["i"], ["k"], chunk_rows=2)
    assert [r.running for r in product.orderBy("i").collect()] == [10.0, 120.0, 1440.0, 10080.0]
    one = spark.sql("select timestamp'2024-01-01' t, 1 n, 1 e")
    assert windows.growth_rate(one, "t", ["n", "e"]).first().growth_rate == 0.0


def test_rules(spark):
    df = spark.createDataFrame([(None, "", "x@y.com"), (5.5, "abc", "nope"), (7.0, "abcdef", "a@b.cc")], "n double, s string, e string")
    got = df.select(quality.number_rule(F.col("n"), 6, None, True).alias("n"), quality.string_rule(F.col("s"), 4, 0).alias("s"), quality.email_rule(F.col("e")).alias("e"),
                    quality.range_rule(F.col("n"), 6).alias("r"), quality.required(F.col("s")).alias("q")).collect()
    assert [tuple(r) for r in got] == [
        ("Value must be a number", "Value cannot be empty", None, None, "This field is required"),
        ("Value must be an integer", "Minimum length is 4", "Invalid email format", "Value must be at least 6", None), (None, None, None, None, None)]
    lists = spark.createDataFrame([([1, 2],), ([1, -1],), ([],), (None,)], "l array<int>")
    rule = quality.list_rule(F.col("l"), 1, 3, lambda x: quality.number_rule(x, 0))
    assert [r[0] for r in lists.select(rule).collect()] == [None, "Item 1: Minimum value is 0", "Minimum 1 items required", "Value must be a list"]
    words = spark.createDataFrame([("Yes",), ("maybe",), (None,)], "w string")
    assert [r[0] is None for r in words.select(quality.boolean_rule(F.col("w"))).collect()] == [True, False, False]
    assert words.select(quality.optional_rule(F.col("w"), quality.boolean_rule(F.col("w")))).collect()[2][0] is None
