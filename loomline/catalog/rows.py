"""Registered queries: filters, reshaping, sorting, pairing and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.catalog.registry import query
from loomline.operators import filters, joins, reshape, sets, sorting
from loomline.session import materialize
from loomline.tables import day, load

# ---------------------------------------------------------------- filters


@query("filter_predicate", """
SELECT l_orderkey, l_quantity, count(*) AS n, round(sum(l_extendedprice), 2) AS price
FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2""")
def _(spark, d):
    rows = filters.filter_predicate(load(spark, d, "lineitem"), F.col("l_quantity") > 5)
    return rows.groupBy("l_orderkey", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("filter_key_equals", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def _(spark, d):
    rows = filters.filter_key_equals(load(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_range", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 10000 AND 20000""")
def _(spark, d):
    rows = filters.filter_range(load(spark, d, "lineitem"), "l_extendedprice", 10000, 20000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("filter_regex", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(red|small) (ring|w.dget)')""")
def _(spark, d):
    return filters.filter_regex(load(spark, d, "part"), "p_name", "(red|small) (ring|w.dget)").select("p_partkey", "p_name")


@query("filter_value_type", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')""")
def _(spark, d):
    events = load(spark, d, "events").withColumn("v", F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    rows = filters.filter_value_type(events, F.col("v"), ["BIGINT"])
    return rows.select("event_id", F.variant_get("v", "$", "bigint").alias("k"))


@query("filter_composite", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND o_orderpriority <> '5-LOW'""")
def _(spark, d):
    either = filters.filter_composite(load(spark, d, "orders"),
                                      [F.col("o_orderstatus") == "F", F.col("o_totalprice") > 400000], "or")
    both = filters.filter_composite(either, [F.col("o_orderpriority") != "5-LOW"], "and")
    return both.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("filter_null", """
SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    joined = docs.join(load(spark, d, "labels"), "doc_id", "left")
    return filters.filter_null(joined, "quality", keep=True).select("doc_id", "lang")


@query("take_while_drop_while", """
WITH m AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN 0 ELSE 1 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failed FROM events)
SELECT event_id, user_id, CASE WHEN failed = 0 THEN 'take' ELSE 'drop' END AS part FROM m""")
def _(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    calm = F.col("event_type") != "error"
    head = filters.take_while(events, calm, ["ts", "event_id"], ["user_id"]).withColumn("part", F.lit("take"))
    tail = filters.drop_while(events, calm, ["ts", "event_id"], ["user_id"]).withColumn("part", F.lit("drop"))
    return head.unionByName(tail).select("event_id", "user_id", "part")


@query("compress_by_mask", """
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders),
b AS (SELECT c_acctbal > 0 AS flag, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer)
SELECT a.o_orderkey FROM a JOIN b ON a.pos = b.pos WHERE b.flag""")
def _(spark, d):
    mask = load(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("flag"))
    return filters.compress_by_mask(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"],
                                    mask, ["c_custkey"], "flag")


@query("filter_by_tags", """
SELECT event_id, user_id FROM events
WHERE json_extract_string(props, '$.k') = '7' AND event_type = 'click'""")
def _(spark, d):
    events = load(spark, d, "events")
    tags = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    rows = events.withColumn("tags", tags)
    return filters.filter_by_tags(rows, {"k": "7", "type": "click"}).select("event_id", "user_id")


@query("rule_alerts", """
WITH r(rule, metric, op, bound) AS (VALUES ('big_purchase', 'purchase', '>', 30.0), ('any_error', 'error', '>=', 0.0),
  ('tiny_click', 'click', '<', 1.0), ('no_such', 'missing', '>', 0.0))
SELECT r.rule, e.event_id, e.value FROM events e JOIN r ON r.metric = e.event_type
WHERE (op = '>' AND value > bound) OR (op = '>=' AND value >= bound) OR (op = '<' AND value < bound)""")
def _(spark, d):
    rules = spark.createDataFrame(
        [("big_purchase", "purchase", ">", 30.0), ("any_error", "error", ">=", 0.0),
         ("tiny_click", "click", "<", 1.0), ("no_such", "missing", ">", 0.0)],
        "rule string, metric string, op string, bound double")
    metrics = load(spark, d, "events").select("event_id", F.col("event_type").alias("metric"), "value")
    return filters.rule_alerts(metrics, rules).select("rule", "event_id", "value")


# ---------------------------------------------------------------- reshaping


@query("map_rows", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
       round(l_extendedprice * l_tax, 4) AS tax FROM lineitem""")
def _(spark, d):
    price = F.col("l_extendedprice")
    return reshape.map_rows(load(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                            F.round(price * (1 - F.col("l_discount")), 4).alias("net"),
                            F.round(price * F.col("l_tax"), 4).alias("tax"))


@query("select_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    return reshape.select_columns(load(spark, d, "customer"), ["c_mktsegment", "c_name", "c_custkey", "absent"])


@query("exclude_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(spark, d):
    return reshape.exclude_columns(load(spark, d, "customer"), ["c_acctbal", "c_mktsegment", "absent"])


@query("rename_columns", "SELECT s_suppkey AS id, s_name AS label, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    return reshape.rename_columns(load(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "label", "absent": "x"})


@query("overlay_merge", """
WITH o AS (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS c_acctbal, count(*) AS orders
           FROM orders GROUP BY 1)
SELECT c.c_custkey, c.c_name, CASE WHEN o.c_custkey IS NULL THEN c.c_acctbal ELSE o.c_acctbal END AS c_acctbal, o.orders
FROM customer c LEFT JOIN o ON c.c_custkey = o.c_custkey""")
def _(spark, d):
    base = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    override = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"), F.count(F.lit(1)).alias("orders"))
    return reshape.overlay_merge(base, override, "c_custkey")


@query("fill_defaults", """
SELECT event_id, COALESCE(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, 'web' AS channel,
       COALESCE(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def _(spark, d):
    props = F.from_json("props", "map<string,string>")
    rows = load(spark, d, "events").select(
        "event_id", reshape.map_value_or_default(props, "k", F.lit("-1")).cast("bigint").alias("k"),
        reshape.map_value_or_default(props, "missing", F.lit("none")).alias("missing"))
    return reshape.fill_defaults(rows, {"channel": "web", "k": 0})


@query("nested_get_set", """
SELECT event_id, COALESCE(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, 0 AS gap,
       user_id * 2 AS owner_score, event_type AS owner_kind FROM events""")
def _(spark, d):
    events = load(spark, d, "events").withColumn("meta", F.struct(F.struct(F.col("event_type").alias("kind")).alias("owner")))
    events = reshape.nested_set(events, "meta.owner.score", F.col("user_id") * 2)
    events = reshape.nested_get(events, "meta.owner.score", name="owner_score")
    events = reshape.nested_get(events, "meta.owner.kind", "unknown", name="owner_kind")
    return events.select("event_id", reshape.json_get(F.col("props"), "k", "bigint", -1).alias("k"),
                         reshape.json_get(F.col("props"), "a.b", "int", 0).alias("gap"), "owner_score", "owner_kind")


@query("flatten_record", """
SELECT o.o_orderkey AS order_id, o.o_totalprice AS order_price, c.c_name AS customer_name, c.c_nationkey AS customer_place_nation
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def _(spark, d):
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    nested = joined.select(
        F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")).alias("order"),
        F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("place")).alias("customer"))
    return reshape.flatten_record(nested, sep="_")


@query("explode_rows", """
WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)
SELECT lang, length(word) AS word_length, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2""")
def _(spark, d):
    words = reshape.explode_rows(load(spark, d, "documents").select("lang", "text"), F.split("text", " "), "word")
    return words.filter("word <> ''").groupBy("lang", F.length("word").cast("bigint").alias("word_length")).agg(
        F.count(F.lit(1)).alias("n"))


@query("regex_replace_all_fields", """
SELECT conv_id, turn, regexp_replace(role, '([aeiou])', '<\\1>', 'g') AS role,
       md5(regexp_replace(text, '([aeiou])', '<\\1>', 'g')) AS text_md5 FROM conversations""")
def _(spark, d):
    rows = reshape.regex_replace_all_fields(load(spark, d, "conversations"), "([aeiou])", "<$1>")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("stage_chain", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, count(*) AS n
FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'N' GROUP BY 1""")
def _(spark, d):
    return reshape.chain_stages(load(spark, d, "lineitem"), [
        lambda df: filters.filter_predicate(df, F.col("l_quantity") > 10),
        lambda df: filters.filter_key_equals(df, l_returnflag="N"),
        lambda df: reshape.map_rows(df, "l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")),
        lambda df: df.groupBy("l_orderkey").agg(F.round(F.sum("net"), 4).alias("net"), F.count(F.lit(1)).alias("n"))])


@query("migrate_records", """
SELECT o_orderkey, 2 AS version, 'EUR' AS currency, CASE WHEN o_orderkey % 3 = 2 THEN 'EU' ELSE 'none' END AS region,
       o_totalprice FROM orders""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3).cast("int").alias("version"))
    orders = orders.withColumn("region", F.when(F.col("version") == 2, F.lit("EU")))
    steps = [
        (1, reshape.add_if_absent("currency", "EUR"), lambda df: df.drop("currency")),
        (2, lambda df: reshape.add_if_absent("currency", "EUR")(
            df.withColumn("region", F.coalesce("region", F.lit("none")))), lambda df: df.drop("region"))]
    moved = reshape.migrate_records(orders, steps, 2)
    return moved.withColumn("currency", F.coalesce("currency", F.lit("EUR"))).select(
        "o_orderkey", "version", "currency", "region", "o_totalprice")


@query("render_templates", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS version, CASE WHEN c_acctbal < 0 THEN 'Owed by ' || c_name ELSE 'Dear ' || c_name || ', segment ' || c_mktsegment
 || ' from nation ' || CAST(c_nationkey AS VARCHAR) || '. {{unknown}}' END AS rendered FROM customer""")
def _(spark, d):
    templates = spark.createDataFrame(
        [("hello", 1, 1, "Hi {{name}}", False), ("hello", 2, 2, "Dear {{name}}, segment {{seg}} from nation {{nat}}. {{unknown}}", True),
         ("hello", 3, 3, "Yo {{name}}", False), ("dunning", 1, 1, "Owed by {{name}}", False)],
        "name string, version int, pos int, template string, is_active boolean")
    rows = load(spark, d, "customer").withColumn("name", F.when(F.col("c_acctbal") < 0, "dunning").otherwise("hello"))
    context = F.create_map(F.lit("name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment"),
                           F.lit("nat"), F.col("c_nationkey").cast("string"))
    return reshape.render_templates(rows, templates, context).select("c_custkey", "version", "rendered")


# ---------------------------------------------------------------- sorting


@query("sort_rows", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS pos FROM orders""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sorting.slice_step(orders, [F.desc_nulls_last("o_totalprice"), "o_orderkey"]).transform(
        lambda df: sorting.sort_rows(df, "o_totalprice", ["o_orderkey"], reverse=True))


@query("limit_offset", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sorting.limit_offset(orders, ["o_totalprice", "o_orderkey"], 50, 100)


@query("paginate", """
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(pos // 40 + 1 AS BIGINT) AS page, CAST(ceil(n / 40.0) AS BIGINT) AS total_pages,
       pos // 40 + 1 < ceil(n / 40.0) AS has_next, pos // 40 > 0 AS has_prev FROM p""")
def _(spark, d):
    return sorting.paginate(load(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 40).drop("c_name")


@query("top_n_bottom_n", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS hi,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS lo FROM orders)
SELECT 'top' AS side, o_custkey, o_orderkey, o_totalprice, hi AS rank FROM r WHERE hi <= 2
UNION ALL SELECT 'bottom', o_custkey, o_orderkey, o_totalprice, lo FROM r WHERE lo <= 1""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = sorting.top_n(orders, 2, [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_custkey"])
    bottom = sorting.top_n(orders, 1, [F.asc("o_totalprice"), F.col("o_orderkey")], ["o_custkey"])
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


@query("merge_sorted_inputs", """
WITH u AS (SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer
           UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier)
SELECT *, row_number() OVER (ORDER BY balance, kind, id) - 1 AS pos FROM u""")
def _(spark, d):
    customers = load(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = load(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    order = ["balance", "kind", "id"]
    merged = sorting.merge_sorted_inputs([customers, suppliers], order)
    return sorting.slice_step(merged, order)


@query("slice_step", """
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, pos FROM p WHERE pos >= 5 AND (pos - 5) % 7 = 0""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return sorting.slice_step(orders, ["o_orderdate", "o_orderkey"], 5, None, 7).drop("o_orderdate")


@query("priority_batches", """
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY 6 - CAST(left(o_orderpriority, 1) AS INT) DESC, o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, pos, CAST(pos // 100 AS BIGINT) AS batch_id FROM p""")
def _(spark, d):
    orders = load(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"))
    batches = sorting.priority_batches(orders, F.col("priority"), ["o_orderdate", "o_orderkey"], 100)
    return batches.select("o_orderkey", "pos", "batch_id")


@query("assign_batches", """
WITH RECURSIVE p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
leaf(lo, len) AS (SELECT CAST(0 AS BIGINT), count(*) FROM customer
  UNION ALL SELECT CASE WHEN s.side = 0 THEN lo ELSE lo + len // 2 END, CASE WHEN s.side = 0 THEN len // 2 ELSE len - len // 2 END
  FROM leaf, (VALUES (0), (1)) AS s(side) WHERE len > 100)
SELECT c_custkey, pos, CAST(pos // 64 AS BIGINT) AS batch, ntile(7) OVER (ORDER BY pos) - 1 AS chunk, CAST(pos % 5 AS BIGINT) AS slot,
       CAST(pos // (n // 7) AS BIGINT) AS part, leaf.lo AS leaf_start, leaf.len AS leaf_rows
FROM p JOIN leaf ON leaf.len <= 100 AND pos >= leaf.lo AND pos < leaf.lo + leaf.len""")
def _(spark, d):
    return sorting.assign_batches(load(spark, d, "customer").select("c_custkey"), ["c_custkey"], size=64, chunks=7,
                                  round_robin=5, floor_chunks=7, max_leaf=100)


@query("sample_shuffle", """
WITH m AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS draw FROM customer)
SELECT 'shuffle' AS kind, c_custkey, draw FROM m UNION ALL SELECT 'sample', c_custkey, draw FROM m WHERE draw <= 100""")
def _(spark, d):
    customers = load(spark, d, "customer").select("c_custkey")
    full = sorting.shuffle_rows(customers, "c_custkey", 42).withColumn("kind", F.lit("shuffle"))
    few = sorting.sample_rows(customers, "c_custkey", 100, 42).withColumn("kind", F.lit("sample"))
    return full.unionByName(few)


@query("with_position", """
SELECT l_orderkey, pos FROM (SELECT l_orderkey, 10 + 2 * (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS pos FROM lineitem)""")
def _(spark, d):
    from loomline.plans.ordered import with_position
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = with_position(load(spark, d, "lineitem").select(*order), order, "pos", start=10, step=2)
    return rows.select("l_orderkey", "pos")


# ---------------------------------------------------------------- pairing


@query("lookup_join", """
WITH last AS (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS last_order, max_by(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1)
SELECT c_custkey, last_order, last_price FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def _(spark, d):
    table = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"),
                                            F.col("o_totalprice").alias("last_price"))
    return joins.lookup_join(load(spark, d, "customer").select("c_custkey"), table, "c_custkey", F.col("last_order"))


def _ledger(docs):
    """Fixture ledger: two thirds of the documents, a part of them with an old hash."""
    changed = F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 32)).otherwise(F.md5("text"))
    return docs.filter("doc_id % 3 <> 0").select(
        F.concat(F.lit("doc/"), "doc_id").alias("path"), F.lit("clean").alias("operation"), changed.alias("source_hash"))


@query("unprocessed_anti_join", """
SELECT 'doc/' || doc_id AS path, md5(text) AS source_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0""")
def _(spark, d):
    docs = load(spark, d, "documents")
    files = docs.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return joins.unprocessed_anti_join(files, _ledger(docs), "clean").select("path", "source_hash")


def customer_snapshot(customers):
    """The later snapshot of the customer table used by the diff queries."""
    kept = customers.filter("c_custkey % 10 <> 0").withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 10 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    fresh = customers.filter("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
    return kept.unionByName(fresh)


@query("record_diff", """
WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
           FROM customer WHERE c_custkey % 10 <> 0
           UNION ALL SELECT c_custkey + 1000000000, c_name, c_acctbal FROM customer WHERE c_custkey % 50 = 0)
SELECT COALESCE(o.c_custkey, n.c_custkey) AS c_custkey,
  CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed'
       WHEN o.c_acctbal <> n.c_acctbal THEN 'modified' ELSE 'unchanged' END AS status,
  CASE WHEN o.c_acctbal <> n.c_acctbal THEN 'c_acctbal' END AS changed,
  CASE WHEN o.c_acctbal <> n.c_acctbal THEN round(n.c_acctbal - o.c_acctbal, 2) END AS delta
FROM customer o FULL OUTER JOIN n ON o.c_custkey = n.c_custkey""")
def _(spark, d):
    old = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    diff = joins.record_diff(old, customer_snapshot(old), "c_custkey")
    delta = F.when(F.col("status") == "modified", F.round(F.col("_new.c_acctbal") - F.col("_old.c_acctbal"), 2))
    return diff.select("c_custkey", "status", F.array_join("changed", ",").alias("changed"), delta.alias("delta"))


@query("zip_join", """
WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS pos FROM part)
SELECT COALESCE(a.pos, b.pos) AS pos, COALESCE(c_custkey, -1) AS c_custkey, COALESCE(p_partkey, -1) AS p_partkey
FROM a FULL OUTER JOIN b ON a.pos = b.pos""")
def _(spark, d):
    left = load(spark, d, "customer").select("c_custkey")
    right = load(spark, d, "part").select("p_partkey", "p_retailprice")
    pairs = joins.zip_join(left, ["c_custkey"], right, ["p_retailprice", "p_partkey"], longest=True)
    return pairs.select("pos", F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey"),
                        F.coalesce("p_partkey", F.lit(-1)).alias("p_partkey"))


@query("cartesian_product", """
SELECT s_suppkey, n_name, r_name, row_number() OVER (ORDER BY s_suppkey, n_nationkey, r_regionkey) - 1 AS tuple_no
FROM supplier, nation, region""")
def _(spark, d):
    parts = [(load(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"]),
             (load(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]),
             (load(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])]
    return joins.product_slice(parts).select("tuple_no", "s_suppkey", "n_name", "r_name")


@query("combinations_permutations", """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT a.o_custkey, a.o_orderkey AS first, b.o_orderkey AS second,
        row_number() OVER (PARTITION BY a.o_custkey ORDER BY a.rn, b.rn) - 1 AS rank
      FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.rn < b.rn)
SELECT n.o_custkey, n, CAST(n * (n - 1) // 2 AS BIGINT) AS pairs, CAST(n * (n - 1) AS BIGINT) AS ordered_pairs,
       CAST(n * (n + 1) // 2 AS BIGINT) AS pairs_with_replacement, CAST(n * n AS BIGINT) AS tuples, p.first, p.second
FROM n JOIN p ON n.o_custkey = p.o_custkey AND p.rank = (n * (n - 1) // 2) // 2""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey")
    sizes = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    counts = sizes.select("o_custkey", joins.combination_count(n, 2).alias("pairs"),
                          joins.combination_count(n, 2, "permutations").alias("ordered_pairs"),
                          joins.combination_count(n, 2, "with_replacement").alias("pairs_with_replacement"),
                          joins.combination_count(n, 2, "product").alias("tuples"))
    middle = counts.select("o_custkey", F.floor(F.col("pairs") / 2).cast("bigint").alias("rank"))
    found = joins.combinations_at(orders, ["o_custkey"], ["o_orderkey"], "o_orderkey", middle)
    return found.drop("rank").join(counts, "o_custkey")


@query("rank_position_join", """
WITH b AS (SELECT c_acctbal AS v FROM customer), q AS (SELECT DISTINCT s_suppkey, s_acctbal FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_acctbal AS balance, (SELECT count(*) FROM b WHERE v < s_acctbal) AS "left",
       (SELECT count(*) FROM b WHERE v <= s_acctbal) AS "right" FROM q""")
def _(spark, d):
    probe = load(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    base = load(spark, d, "customer").select(F.col("c_acctbal").alias("balance"))
    return joins.rank_position_join(probe, base, "balance", "s_suppkey")


# ---------------------------------------------------------------- sets


@query("union_all", """
SELECT 'customer' AS source, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, NULL FROM supplier""")
def _(spark, d):
    return sets.union_all({
        "customer": load(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "supplier": load(spark, d, "supplier").select(F.col("s_name").alias("name"))})


@query("distinct_first", """
SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def _(spark, d):
    events = load(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return sets.distinct_first(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("set_algebra", """
WITH b AS (SELECT DISTINCT o_custkey AS id FROM orders), u AS (SELECT DISTINCT user_id AS id FROM events)
SELECT COALESCE(b.id, u.id) AS id, CASE WHEN u.id IS NULL THEN 'left' WHEN b.id IS NULL THEN 'right' ELSE 'both' END AS member
FROM b FULL OUTER JOIN u ON b.id = u.id""")
def _(spark, d):
    buyers = load(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    users = load(spark, d, "events").select(F.col("user_id").alias("id"))
    return sets.set_algebra(buyers, users, "id")


@query("counter_arithmetic", """
SELECT event_type, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE -1 END) AS BIGINT) AS count FROM events GROUP BY 1""")
def _(spark, d):
    events = load(spark, d, "events")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return sets.counter_arithmetic([events.filter(late)], [events.filter(~late)], "event_type")


@query("layered_lookup", """
WITH a AS (SELECT c_custkey AS id, c_name AS label, 0 AS layer FROM customer WHERE c_acctbal > 5000
 UNION ALL SELECT p_partkey, p_name, 1 FROM part UNION ALL SELECT o_orderkey, o_orderpriority, 2 FROM orders)
SELECT id, min_by(label, layer) AS label, CAST(min(layer) AS BIGINT) AS layer FROM a GROUP BY 1""")
def _(spark, d):
    rich = load(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return sets.layered_lookup([rich, parts, orders], "id", "label")


__all__ = ["customer_snapshot", "day", "materialize"]
