"""Registered queries: text, dates, numbers, ids and whole-text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.catalog.registry import query
from loomline.functions import documents as doc
from loomline.functions import scalars, text
from loomline.session import shuffle_width
from loomline.tables import load


@query("text_normalize_job", r"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, text FROM documents)
SELECT 'd' || doc_id AS id, md5(slug) AS slug_md5, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS short, NULL AS camel, NULL AS snake, NULL AS acronym, NULL AS upper_camel FROM s
UNION ALL
SELECT 'p' || p_partkey, NULL, NULL, string_split(p_name, ' ')[1] || upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2),
  replace(p_name, ' ', '_'), 'http_server_' || replace(p_name, ' ', '_'),
  upper(left(string_split(p_name, ' ')[1], 1)) || substr(string_split(p_name, ' ')[1], 2) || upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) FROM part""")
def _(spark, d):
    docs = load(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.md5(text.slugify(F.col("text"))).alias("slug_md5"),
        text.truncate(F.col("text"), 40).alias("short"))
    snake = F.replace("p_name", F.lit(" "), F.lit("_"))
    camel = text.snake_to_camel(snake)
    upper = text.upper_camel(snake)
    parts = load(spark, d, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), camel.alias("camel"), text.camel_to_snake(camel).alias("snake"),
        text.acronym_snake(F.concat(F.lit("HTTPServer"), upper)).alias("acronym"), upper.alias("upper_camel"))
    return docs.unionByName(parts, allowMissingColumns=True)


@query("sensitive_data_job", r"""
WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS t FROM documents),
k AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+$') THEN 'email' WHEN regexp_matches(t, '^https?://[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+') THEN 'url'
  WHEN regexp_matches(t, '^(25[0-5]|2[0-4]\d|1\d\d|0*\d?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|0*\d?\d)){3}$') THEN 'ip' END AS kind FROM t)
SELECT doc_id, kind, CASE WHEN length(t) <= 4 THEN repeat('*', length(t)) ELSE left(t, 2) || repeat('*', length(t) - 4) || right(t, 2) END AS masked, count(*) AS n
FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    found = text.sensitive_tokens(load(spark, d, "documents").select("doc_id", "text"), "text")
    return found.groupBy("doc_id", "kind", "masked").agg(F.count(F.lit(1)).alias("n"))


@query("regex_extract_job", r"""
WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '\d+') AS n FROM documents)
SELECT doc_id, len(n) AS numbers, COALESCE(CAST(list_sum(list_transform(n, lambda v: v::HUGEINT)) AS VARCHAR), '0') AS total,
 len(regexp_extract_all(text, '[aeiou]{3}')) AS vowel_runs, regexp_matches(text, '^(?:The|Der|La)') AS starts_with_article,
 len(string_split_regex(text, '[.!?]\s')) AS sentences, md5(regexp_replace(text, '(\d)\d*', '\1#', 'g')) AS masked_md5 FROM x""")
def _(spark, d):
    c = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", F.size(text.find_all(c, r"\d+")).cast("bigint").alias("numbers"), text.sum_of_digits(text.extract_numbers(c)).alias("total"),
        F.size(text.find_all(c, "[aeiou]{3}")).cast("bigint").alias("vowel_runs"),
        text.matches_at_start(c, "The|Der|La").alias("starts_with_article"),
        F.size(F.split(c, r"[.!?]\s")).cast("bigint").alias("sentences"),
        F.md5(F.regexp_replace(c, r"(\d)\d*", "$1#")).alias("masked_md5"))


@query("html_clean_job", r"""
WITH s AS (SELECT page_id, html, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)
SELECT page_id, md5(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')) AS text_md5,
 md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5,
 len(list_distinct(regexp_extract_all(html, '(\w+)="([^"]*)"', 1))) AS attributes, list_last(regexp_extract_all(html, '(\bclass)="([^"]*)"', 2)) AS last_class FROM s""")
def _(spark, d):
    stripped = text.strip_tags(F.col("html"))
    attributes = text.parse_attributes(F.col("html"))
    return load(spark, d, "pages").select(
        "page_id", F.md5(text.html_unescape(stripped)).alias("text_md5"), F.md5(text.html_escape(stripped)).alias("escaped_md5"),
        F.size(attributes).cast("bigint").alias("attributes"), F.element_at(attributes, F.lit("class")).alias("last_class"))


@query("url_rollup_job", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', ['scheme', 'netloc', 'path', 'query', 'fragment']) AS p FROM pages),
q AS (SELECT p.netloc AS domain, unnest(CASE WHEN p.query = '' THEN ['(none)'] ELSE list_transform(string_split(p.query, '&'), lambda x: string_split(x, '=')[1] || '=' || url_decode(string_split(x, '=')[2])) END) AS param,
  p.scheme AS scheme, p.fragment AS fragment FROM u)
SELECT domain, scheme, param, fragment, count(*) AS n FROM q GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    url = F.col("url")
    pages = load(spark, d, "pages").select(
        text.domain(url).alias("domain"), text.url_part(url, "scheme").alias("scheme"),
        text.url_part(url, "fragment").alias("fragment"), text.decode_params(text.url_part(url, "query")).alias("params"))
    entries = F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    param = F.explode(F.when(F.size("params") == 0, F.array(F.lit("(none)"))).otherwise(entries))
    return pages.select("domain", "scheme", "fragment", param.alias("param")).groupBy(
        "domain", "scheme", "param", "fragment").agg(F.count(F.lit(1)).alias("n"))


@query("json_profile_job", """
WITH j AS (SELECT CASE WHEN event_id % 9 = 0 THEN '{"k": ' WHEN event_id % 5 = 0 THEN '{"k": "' || event_type || '", "deep": {"v": ' || value || '}}' ELSE props END AS t, event_id FROM events)
SELECT NULL AS key, 'invalid' AS type, count(*) AS n FROM j WHERE event_id % 9 = 0
UNION ALL SELECT 'k', 'STRING', count(*) FROM j WHERE event_id % 9 <> 0 AND event_id % 5 = 0
UNION ALL SELECT 'deep', 'OBJECT', count(*) FROM j WHERE event_id % 9 <> 0 AND event_id % 5 = 0
UNION ALL SELECT 'k', 'BIGINT', count(*) FROM j WHERE event_id % 9 <> 0 AND event_id % 5 <> 0""")
def _(spark, d):
    other = F.concat(F.lit('{"k": "'), "event_type", F.lit('", "deep": {"v": '), F.col("value").cast("string"), F.lit("}}"))
    body = F.when(F.col("event_id") % 9 == 0, '{"k": ').when(F.col("event_id") % 5 == 0, other).otherwise(F.col("props"))
    profile = text.json_profile(load(spark, d, "events").select(body.alias("t")), "t")
    kind = F.when(F.col("type").startswith("OBJECT"), "OBJECT").otherwise(F.col("type"))
    return profile.groupBy("key", kind.alias("type")).agg(F.sum("n").alias("n"))


@query("json_parse_job", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS type_is_json,
 '{"a":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '","z":"1"}' AS merged FROM events""")
def _(spark, d):
    from loomline.operators.reshape import merge_maps
    props = F.from_json("props", "map<string,string>")
    update = F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.col("event_type"))
    parsed = text.parse_or_default(F.col("props"))
    return load(spark, d, "events").select(
        "event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"), text.is_json(F.col("event_type")).alias("type_is_json"),
        text.sorted_json(merge_maps(props, update)).alias("merged"))


@query("content_fingerprint_job", """
SELECT md5(text) AS fingerprint, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return text.duplicate_groups(load(spark, d, "documents"), "text", "doc_id")


@query("content_digests", """
SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, left(md5(text), 12) AS short_id, left(sha256('clean:doc/' || doc_id), 16) AS cache_key,
 replace(replace(to_base64(encode(lang || '?>~' || source)), '+', '-'), '/', '_') AS coded, lang || '?>~' || source AS decoded FROM documents""")
def _(spark, d):
    c, plain = F.col("text"), F.concat("lang", F.lit("?>~"), "source")
    return load(spark, d, "documents").select(
        "doc_id", F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"), text.hash_id(c).alias("short_id"),
        text.cache_key(F.lit("clean"), F.concat(F.lit("doc/"), "doc_id")).alias("cache_key"),
        text.base64_url(plain).alias("coded"), text.unbase64_url(text.base64_url(plain)).alias("decoded"))


@query("date_job", """
SELECT o_orderkey, day(last_day(o_orderdate)) AS month_days, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap,
 dayname(o_orderdate) AS weekday, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due, strftime(timezone('America/New_York', timezone('UTC', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS new_york,
 hour(timezone('America/New_York', timezone('UTC', o_orderdate))) = 20 AS dst,
 CASE WHEN o_totalprice < 60 THEN printf('%.1fs', o_totalprice) WHEN o_totalprice < 3600 THEN printf('%.1fm', o_totalprice / 60) ELSE printf('%.1fh', o_totalprice / 3600) END AS duration,
 CAST(o_custkey % 24 * 3600 + o_orderkey % 60 * 60 AS DOUBLE) AS parsed FROM orders""")
def _(spark, d):
    date = F.col("o_orderdate")
    spelled = F.concat((F.col("o_custkey") % 24).cast("string"), F.lit("h"), (F.col("o_orderkey") % 60).cast("string"), F.lit("m"))
    return load(spark, d, "orders").select(
        "o_orderkey", scalars.month_days(date).cast("bigint").alias("month_days"), scalars.is_leap_year(F.year(date)).alias("leap"),
        scalars.day_name(date).alias("weekday"), F.date_format(scalars.add_days(date, 45), "yyyy-MM-dd").alias("due"),
        F.date_format(scalars.to_zone(date, "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("new_york"),
        scalars.is_dst(date, "America/New_York").alias("dst"), scalars.format_duration(F.col("o_totalprice")).alias("duration"),
        scalars.parse_duration(spelled).alias("parsed"))


@query("calendar_job", """
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), w AS (SELECT m, unnest(generate_series(m - (isodow(m) - 1)::INT, last_day(m), INTERVAL 7 DAY))::DATE AS w FROM m)
SELECT strftime(m, '%Y-%m') AS month, strftime(w, '%Y-%m-%d') AS week, CASE WHEN month(w) = month(m) THEN day(w) ELSE 0 END AS mon, CASE WHEN month(w + 6) = month(m) THEN day(w + 6) ELSE 0 END AS sun FROM w""")
def _(spark, d):
    months = load(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("m")).distinct()
    weeks = scalars.month_calendar(months, "m")
    day = F.when(F.col("mon") > 0, F.date_add("m", F.col("mon") - 1)).otherwise(F.date_add("m", F.col("sun") - 7))
    return weeks.select(F.date_format("m", "yyyy-MM").alias("month"), F.date_format(day, "yyyy-MM-dd").alias("week"),
                        F.col("mon").cast("bigint").alias("mon"), F.col("sun").cast("bigint").alias("sun"))


@query("numeric_job", """
SELECT p_partkey, greatest(950.0, least(p_retailprice, 1200.0))::DOUBLE AS clamped, round(p_retailprice + (1000 - p_retailprice) * 0.25, 6) AS mixed,
 round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS scaled,
 round(ln(p_retailprice), 6) AS log, round(sqrt(p_retailprice), 6) AS root, round(sin(radians(p_size)), 6) AS sine, CAST(ceil(p_retailprice / 7) AS BIGINT) AS up, CAST(floor(p_retailprice / 7) AS BIGINT) AS down,
 CAST(CAST(round(CAST(p_retailprice AS DECIMAL(20,4)) * 3 / 8, 2) AS DECIMAL(20,2)) AS VARCHAR) AS cents, CASE WHEN p_retailprice * p_size * 100 < 1024 THEN printf('%.1fB', p_retailprice * p_size * 100)
  WHEN p_retailprice * p_size * 100 < 1048576 THEN printf('%.1fKB', p_retailprice * p_size * 100 / 1024) ELSE printf('%.1fMB', p_retailprice * p_size * 100 / 1048576) END AS bytes, printf('%.1f%%', p_size / 64 * 100) AS share FROM part""")
def _(spark, d):
    price, size = F.col("p_retailprice"), F.col("p_size")
    parts = scalars.min_max_scaled(load(spark, d, "part"), "p_retailprice", "scaled")
    exact = price.cast("decimal(20,4)") * 3 / F.lit(8).cast("decimal(2,0)")
    return parts.select(
        "p_partkey", scalars.clamp(price, 950.0, 1200.0).alias("clamped"), F.round(scalars.lerp(price, F.lit(1000.0), F.lit(0.25)), 6).alias("mixed"),
        F.round("scaled", 6).alias("scaled"), F.round(F.ln(price), 6).alias("log"), F.round(F.sqrt(price), 6).alias("root"),
        F.round(F.sin(F.radians(size)), 6).alias("sine"), F.ceil(price / 7).cast("bigint").alias("up"), F.floor(price / 7).cast("bigint").alias("down"),
        scalars.quantize(exact, 2).cast("decimal(20,2)").cast("string").alias("cents"), scalars.format_bytes(price * size * 100).alias("bytes"),
        scalars.format_percent(size / 64).alias("share"))


@query("version_sort_job", r"""
WITH v AS (SELECT p_partkey, 'v' || p_size || '.' || (p_partkey % 12) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey % 7) END AS version FROM part),
p AS (SELECT *, list_transform(regexp_extract_all(version, '\d+'), lambda x: x::BIGINT) AS key FROM v)
SELECT p_partkey, version, row_number() OVER (ORDER BY key, p_partkey) - 1 AS pos, CASE WHEN key < [20, 5, 3] THEN -1 WHEN key > [20, 5, 3] THEN 1 ELSE 0 END AS compared, key >= [20, 5, 3] AS compatible FROM p""")
def _(spark, d):
    from loomline.plans.ordered import with_position
    tail = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), (F.col("p_partkey") % 7).cast("string")))
    version = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"), tail)
    rows = load(spark, d, "part").select("p_partkey", version.alias("version"))
    rows = rows.withColumn("key", text.parse_version(F.col("version")))
    placed = with_position(rows, ["key", "p_partkey"], "pos")
    return placed.select("p_partkey", "version", "pos", text.compare_versions(F.col("version"), F.lit("20.5.3")).alias("compared"),
                         text.is_compatible(F.col("version"), F.lit("20.5.3")).alias("compatible"))


@query("id_assignment_job", """
WITH h AS (SELECT c_custkey, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)
SELECT c_custkey, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9'
  WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid, true AS valid, false AS name_valid FROM h""")
def _(spark, d):
    name = text.uuid_v5(F.col("c_name"))
    return load(spark, d, "customer").select("c_custkey", name.alias("uuid"), text.is_uuid(name).alias("valid"),
                                             text.is_uuid(F.col("c_name")).alias("name_valid"))


def source_files(spark, d):
    """One C++ header per part, its contents derived from the part row."""
    i, word = F.col("p_partkey").cast("string"), F.initcap(F.regexp_extract("p_name", r"^(\w+)", 1))
    kind = F.initcap(F.regexp_extract("p_name", r"(\w+)$", 1))
    body = F.concat(
        F.lit("#include <"), F.lower("p_type"), F.lit('.h>\n#include "'), F.lower(kind), F.lit('.hpp"\nclass '), word, i,
        F.lit(" : public "), kind, F.lit(" {\npublic:\n  virtual int load(int key) { if (key) { store->fetch(key); } return 0; }\n  Brand brand;\n  "),
        kind, F.lit(" part"), i, F.lit(";\n};\nstruct Rec"), i, F.lit(" { int size; "), F.when(F.col("p_size") % 2 == 0, "char* tag; ").otherwise(""),
        F.lit("double price; };\nclass Plain"), (F.col("p_partkey") % 50).cast("string"), F.lit(" { };\nvoid run"), i, F.lit("(int a) { SQLExecDirect(h, \"SELECT size FROM parts WHERE id = "),
        F.col("p_size").cast("string"), F.lit("\"); }\n"), F.when(F.col("p_size") % 5 == 0, '// prints sheet.rpt\n').otherwise(""))
    # the rows of a small file become texts that are long work, so they are dealt to as many tasks as a shuffle has
    parts = load(spark, d, "part").repartition(shuffle_width(spark), "p_partkey")
    return parts.select(F.concat(F.lit("src/p"), i, F.lit(".h")).alias("path"), body.alias("content"))


@query("source_code_facts_job", """
SELECT kind, CAST(n AS BIGINT) AS n, CAST(files AS BIGINT) AS files FROM (
 SELECT 'include' AS kind, 2 * count(*) AS n, count(*) AS files FROM part UNION ALL SELECT 'class', count(*), count(*) FROM part
 UNION ALL SELECT 'simple_class', count(*), count(*) FROM part UNION ALL SELECT 'struct', count(*), count(*) FROM part
 UNION ALL SELECT 'field', sum(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END), count(*) FROM part UNION ALL SELECT 'function', 2 * count(*), count(*) FROM part
 UNION ALL SELECT 'sql', count(*), count(*) FROM part UNION ALL SELECT 'report', count(*), count(*) FROM part WHERE p_size % 5 = 0
 UNION ALL SELECT 'method', count(*), count(*) FROM part UNION ALL SELECT 'dependency', 4 * count(*), count(*) FROM part)""")
def _(spark, d):
    return doc.fact_summary(doc.source_code_facts(source_files(spark, d)))


@query("source_class_table", """
SELECT upper(left(string_split(p_name, ' ')[1], 1)) || substr(string_split(p_name, ' ')[1], 2) || p_partkey AS name,
 upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) AS parent, 'src/p' || p_partkey || '.h' AS path FROM part
UNION ALL SELECT 'Plain' || (p_partkey % 50), NULL, min('src/p' || p_partkey || '.h') FROM part GROUP BY 1""")
def _(spark, d):
    return doc.class_table(doc.source_code_facts(source_files(spark, d)))


@query("text_structure_checks_job", r"""
WITH RECURSIVE b(doc_id, s) AS (SELECT doc_id, regexp_replace(text, '[^()\[\]{}]', '', 'g') FROM documents UNION ALL
  SELECT doc_id, replace(replace(replace(s, '()', ''), '[]', ''), '{}', '') FROM b WHERE s <> replace(replace(replace(s, '()', ''), '[]', ''), '{}', '')),
m AS (SELECT doc_id, min_by(s, length(s)) = '' AS balanced FROM b GROUP BY 1),
st AS (SELECT doc_id, list_filter(list_transform(string_split(text, ';'), lambda x: trim(x, E' \n\r\t')), lambda x: x <> '') AS st FROM documents)
SELECT doc_id, length(text) >= 10 AND balanced AS code_valid, length(text) < 10 OR contains(text, 'module') OR contains(text, 'import') AS code_quiet,
 length(text) >= 10 AND length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', '')) AS sql_valid,
 CASE WHEN length(text) < 10 THEN 0 ELSE CASE WHEN contains(upper(text), 'CREATE TABLE') THEN 0 ELSE 1 END + len(list_filter(st, lambda s: NOT regexp_matches(upper(s), '^(CREATE|ALTER|DROP|INSERT|UPDATE|DELETE|COMMENT|GRANT|REVOKE)'))) END AS sql_warnings,
 length(text) >= 10 AND length(text) - length(replace(text, '{', '')) = length(text) - length(replace(text, '}', '')) AS qml_valid FROM documents JOIN m USING (doc_id) JOIN st USING (doc_id)""")
def _(spark, d):
    c = F.col("text")
    checked = load(spark, d, "documents").select(
        "doc_id", doc.check_haskell(c).alias("h"), doc.check_sql(c).alias("s"), doc.check_qml(c).alias("q"))
    return checked.select("doc_id", F.col("h.valid").alias("code_valid"), (F.size("h.warnings") == 0).alias("code_quiet"),
                          F.col("s.valid").alias("sql_valid"), F.size("s.warnings").cast("bigint").alias("sql_warnings"),
                          F.col("q.valid").alias("qml_valid"))


@query("commit_log_parse_job", """
SELECT CASE WHEN o_custkey % 3 = 0 THEN 'a|b' ELSE 'fix' END || ' #' || o_orderkey AS subject, left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS hash,
 'dev' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey = 0 THEN '' ELSE left(md5(CAST(o_orderkey - 1 AS VARCHAR)), 8) END AS parents FROM orders""")
def _(spark, d):
    key = F.col("o_orderkey")
    line = F.concat_ws(
        "|", F.md5(key.cast("string")), F.concat(F.when(F.col("o_custkey") % 3 == 0, "a|b").otherwise("fix"), F.lit(" #"), key.cast("string")),
        F.concat(F.lit("dev"), "o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(key == 0, "").otherwise(F.substring(F.md5((key - 1).cast("string")), 1, 8)))
    return doc.parse_commit_lines(load(spark, d, "orders").select(line.alias("value"))).drop("value")


@query("status_lines_job", """
SELECT 'f' || o_orderkey AS file, o_orderkey % 4 IN (0, 1) AS modified, o_orderkey % 4 = 0 AS staged, o_orderkey % 4 = 2 AS untracked FROM orders""")
def _(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("M ", " M", "??", "A ")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    lines = load(spark, d, "orders").select(F.concat(code, F.lit(" f"), "o_orderkey").alias("value"))
    return doc.parse_status_lines(lines)


def webhook_events(events):
    """Events as webhook calls; the payload is built from the event row."""
    kind, n = F.col("event_type"), F.col("user_id")
    source = F.when(kind.isin("view", "click", "purchase"), "github").when(kind == "error", "gitlab").otherwise("slack")
    name = (F.when(kind == "view", "push").when(kind == "click", "pull_request").when(kind == "purchase", "release")
            .when(kind == "error", "merge_request").when(n % 2 == 0, "event_callback").otherwise("unknown"))
    fmt = F.format_string
    payload = (F.when(kind == "view", fmt('{"commits": [{"id": 1}, {"id": %d}], "repository": {"full_name": "team/r%d"}}', n, n))
               .when(kind == "click", fmt('{"action": "opened", "pull_request": {"number": %d}}', n))
               .when(kind == "purchase", fmt('{"action": "published", "release": {"tag_name": "v%d"}}', n))
               .when(kind == "error", fmt('{"object_attributes": {"action": "merge", "iid": %d}}', n))
               .otherwise(F.lit('{"event": {"type": "message"}}')))
    return events.select("event_id", source.alias("source"), name.alias("event_type"), payload.alias("payload"))


@query("webhook_normalize_job", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'gitlab' WHEN 'signup' THEN 'slack' ELSE 'github' END AS source,
 CASE event_type WHEN 'view' THEN 'push' WHEN 'click' THEN 'pull_request' WHEN 'purchase' THEN 'release' WHEN 'error' THEN 'merge_request' ELSE 'event_callback' END AS event_type,
 CASE event_type WHEN 'view' THEN 'push' WHEN 'click' THEN 'opened' WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'merge' ELSE 'event_callback' END AS action,
 CASE event_type WHEN 'view' THEN 'team/r' || user_id WHEN 'purchase' THEN 'v' || user_id WHEN 'signup' THEN 'message' END AS name,
 CASE WHEN event_type IN ('click', 'error') THEN user_id END AS number, CASE WHEN event_type = 'view' THEN 2::BIGINT END AS commits
FROM events WHERE NOT (event_type = 'signup' AND user_id % 2 = 1)""")
def _(spark, d):
    return doc.normalize_webhooks(webhook_events(load(spark, d, "events")))


@query("model_output_clean_job", """
WITH a AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 4 AS k, replace(text, chr(10), ' ') AS t FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'clean' WHEN 1 THEN 'clean' WHEN 2 THEN 'block' ELSE 'failed' END AS status, CASE WHEN k < 3 THEN md5(t) END AS jasper,
 CASE WHEN k < 3 THEN 'x' END AS pentaho, CASE WHEN k < 3 THEN '' END AS pdfslave FROM a""")
def _(spark, d):
    k = (F.col("conv_id") * 7 + F.col("turn")) % 4
    plain = F.replace("text", F.lit("\n"), F.lit(" "))
    body = F.concat(F.lit('{"jasper": "'), plain, F.lit('", "pentaho": "x"}'))
    answer = (F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, body)
              .when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).otherwise(F.col("text")))
    rows = load(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"))
    parsed = doc.parse_answers(rows, "answer", ("jasper", "pentaho", "pdfslave")).drop("answer")
    return parsed.withColumn("jasper", F.md5("jasper"))
