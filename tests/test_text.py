"""Text, date and number columns against the Python standard library."""

from __future__ import annotations

import html
import ipaddress
import random
import re
import urllib.parse
import uuid

from pyspark.sql import functions as F

from loomline.functions import documents as doc
from loomline.functions import scalars, text, udf


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


WORDS = ["Hello, Wörld!  It's -- fine_", "  a  b ", "HTTPServerName", "simpleTest", "snake_case_name", "", "x", "o'neil_mac donald", "éa ßb"]


def test_naming(spark):
    def slug(s):
        return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", s.lower())).strip("-")

    assert column(spark, WORDS, text.slugify) == [slug(s) for s in WORDS]
    assert column(spark, WORDS, lambda c: text.truncate(c, 8)) == [s if len(s) <= 8 else s[:5] + "..." for s in WORDS]
    assert column(spark, ["abcdef"], lambda c: text.truncate(c, 2)) == ["ab"]
    assert column(spark, WORDS, text.camel_to_snake) == [re.sub(r"(?<!^)(?=[A-Z])", "_", s).lower() for s in WORDS]
    assert column(spark, ["snake_case_name", "a_b2c", "one"], text.snake_to_camel) == ["snakeCaseName", "aB2C", "one"]
    assert column(spark, ["HTTPServerName", "getURLNow2Go"], text.acronym_snake) == ["http_server_name", "get_url_now2_go"]
    assert column(spark, ["my_class_name", "_x__yZ"], text.upper_camel) == ["MyClassName", "XYz"]


def test_masks_and_checks(spark):
    assert column(spark, ["", "abc", "abcd", "secret1"], text.mask) == ["", "***", "****", "se***t1"]
    mails = ["a.b@c.de", "é@x.fr", "a@b", "a b@c.de"]
    assert column(spark, mails, text.is_email) == [bool(re.match(r"^[\w\.-]+@[\w\.-]+\.\w+$", m)) for m in mails]
    hosts = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "1..2.3"]

    def is_ip(s):
        try:
            return bool(ipaddress.IPv4Address(s))
        except ValueError:
            return False
    assert column(spark, hosts, text.is_ip) == [is_ip(h) for h in hosts]
    assert column(spark, ["v12 x 007", "no"], lambda c: F.transform(text.extract_numbers(c), lambda x: x.cast("int"))) == [[12, 7], []]


def test_html(spark):
    rows = ['<a href="x" class="y" class="z">Tom &amp; J&eacute;r&#244;me &lt;3 &bogus; &copy</a>', "plain", "&amp;lt;"]
    assert column(spark, rows, text.html_unescape) == [html.unescape(r) for r in rows]
    assert column(spark, rows, text.html_escape) == [html.escape(r) for r in rows]
    assert column(spark, rows, text.parse_attributes) == [dict(re.findall(r'(\w+)="([^"]*)"', r)) for r in rows]


def test_urls(spark):
    urls = ["https://u:p@h.example.com:8080/a/b?x=1&y=a%20b&x=2&z=&w#frag", "/only/path", "HTTP://Host?q=a+b", "mailto:me@x.org", ""]
    for part in ("scheme", "netloc", "path", "query", "fragment"):
        assert column(spark, urls, lambda c: text.url_part(c, part)) == [getattr(urllib.parse.urlparse(u), part) for u in urls]
    queries = [urllib.parse.urlparse(u).query for u in urls] + ["a=1&b=%C3%A9&a=3&c==x", "100%=a%zz&x=%"]
    assert column(spark, queries, text.decode_params) == [dict(urllib.parse.parse_qsl(q)) for q in queries]
    raw = ["a b/c~d*é+&", "x"]
    assert column(spark, raw, text.url_quote) == [urllib.parse.quote(r) for r in raw]
    assert column(spark, ["a%20b+c", "5% of %41"], text.url_unquote) == [urllib.parse.unquote(x) for x in ("a%20b+c", "5% of %41")]
    built = column(spark, ["h"], lambda c: text.build_url(F.lit("https"), c, F.lit("/p"), F.create_map(F.lit("k"), F.lit("a b"))))
    assert built == ["https://h/p?k=a+b"]


def test_ids_and_versions(spark):
    names = ["a", "Customer#1", "é"]
    assert column(spark, names, text.uuid_v5) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    checks = [str(uuid.uuid4()), "x", uuid.uuid4().hex, "{" + str(uuid.uuid4()) + "}"]
    assert column(spark, checks, text.is_uuid) == [True, False, True, True]
    assert column(spark, ["1.10", "1.9.9", "v1.9"], lambda c: text.compare_versions(c, F.lit("1.9.9"))) == [1, 0, -1]


def test_durations_and_formats(spark):
    rng = random.Random(1)
    seconds = [0.25, 0.35, 59.95, 60.0, 90.0, 3599.0, 3600.0, 86400.5] + [rng.uniform(0, 9000) for _ in range(40)]

    def spell(s):
        return f"{s:.1f}s" if s < 60 else f"{s / 60:.1f}m" if s < 3600 else f"{s / 3600:.1f}h"
    assert column(spark, seconds, scalars.format_duration, "double") == [spell(s) for s in seconds]
    assert column(spark, ["1h30m", "45s", "2m5s", "x"], scalars.parse_duration) == [5400.0, 45.0, 125.0, 0.0]
    assert column(spark, [10, 1024, 5 * 1024**3, 1024**6], scalars.format_bytes, "bigint") == ["10.0B", "1.0KB", "5.0GB", "1024.0PB"]
    assert column(spark, [0.125, 1.0], scalars.format_percent, "double") == ["12.5%", "100.0%"]
    assert [str(x) for x in column(spark, ["2.345", "-2.345"], scalars.quantize)] == ["2.35", "-2.35"]


def test_brackets_and_checks(spark):
    def balanced(s):
        stack = []
        for ch in s:
            if ch in "([{":
                stack.append(ch)
            elif ch in ")]}":
                if not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[ch]:
                    return False
        return not stack

    rng = random.Random(3)
    texts = ["", "a(b[c]{d})", "(]", ")(", "(("] + ["".join(rng.choices("()[]{}x", k=rng.randint(1, 7))) for _ in range(60)]
    assert column(spark, texts, doc.brackets_balanced) == [balanced(t) for t in texts]
    got = column(spark, ["short", "module X where f :: Int -> (Int)", "value of x ::   = 3 import"], doc.check_haskell)
    assert [r.valid for r in got] == [False, True, False]
    assert got[2].errors == ["Empty type signature for x"]
    sql = column(spark, ["CREATE TABLE a (x int); SELECT 1; DROP TABLE a;"], doc.check_sql)[0]
    assert sql.valid and sql.warnings == ["Unknown statement type: SELECT 1"]
    qml = column(spark, ["import X\n  <Item a>{ }", "no root here {{"], doc.check_qml)
    assert [(r.valid, r.warnings) for r in qml] == [(True, []), (False, ["No import statements found", "No root QML element found"])]


def test_source_facts(spark):
    code = ('#include "a.h"\nclass Foo : public Base { void go() { if (x) { y->run(); } } int n; };\nclass Later { };\n'
            'struct S { char* name; int id; };\nint main(int a) { execute(db, "SELECT 1"); execute(db, "SELECT 1"); }\nclass W : public QWidget { };')
    files = spark.createDataFrame([("m.cpp", code), ("z.h", "class Later : public Foo { };")], "path string, content string")
    facts = doc.source_code_facts(files)
    names = {}
    for r in facts.collect():
        names.setdefault(r.kind, set()).add((r.name, r.parent))
    assert names["include"] == {("a.h", None)} and names["sql"] == {("SELECT 1", None)}
    assert names["class"] == {("Foo", "Base"), ("W", "QWidget"), ("Later", "Foo")} and names["widget"] == {("QWidget", None)}
    assert names["struct"] == {("S", None)} and names["field"] == {("name", "S"), ("id", "S")}
    assert names["function"] == {("go", None), ("main", None)} and ("y", "Foo") in names["dependency"]
    table = {r.name: (r.parent, r.path) for r in doc.class_table(facts).collect()}
    assert table["Later"] == ("Foo", "z.h") and table["Foo"] == ("Base", "m.cpp")


def test_commit_lines_and_answers(spark):
    lines = spark.createDataFrame([("0123456789|fix a|b|Ann|2024-01-01|p1 p2",), ("abc|s|Bob|2024",), ("x|y",), ("",)], "value string")
    got = {r.hash: (r.subject, r.author, r.date, r.parents) for r in doc.parse_commit_lines(lines).collect()}
    assert got == {"01234567": ("fix a|b", "Ann", "2024-01-01", "p1 p2"), "abc": ("s", "Bob", "2024", "")}
    answers = spark.createDataFrame([('```json\n{"a": "1"}\n```',), ('see {"a": {"b": 2}} ok',), ("none {",), ("{" * 3000 + "x",)], "t string")
    rows = doc.parse_answers(answers, "t", ("a",)).collect()
    assert [r.status for r in rows] == ["clean", "block", "failed", "failed"] and rows[0].a == "1"
    assert column(spark, ["```sql\nSELECT 1;\n```"], lambda c: doc.strip_fences(c, "sql")) == ["SELECT 1;\n"]


def test_long_bodies_statements_and_numbers(spark):
    code = "struct Big { " + " ".join(f"int f{i};" for i in range(400)) + " };"
    facts = doc.source_code_facts(spark.createDataFrame([("b.h", code)], "path string, content string"))
    assert facts.filter("kind = 'struct'").count() == 1 and facts.filter("kind = 'field'").count() == 400
    sql = column(spark, ["CREATE TABLE a (x int);" * 5 + " EXPLAIN everything there is to know about it"], doc.check_sql)[0]
    assert sql.warnings == ["Unknown statement type: EXPLAIN everything there is to know about it"]
    long = "9" * 60
    got = column(spark, [f"a {long} b 007 c 1", "none", "0 00"], lambda c: text.sum_of_digits(text.extract_numbers(c)))
    assert got == [str(int(long) + 8), "0", "0"]
    assert column(spark, [f"1.{long}"], lambda c: text.compare_versions(c, F.lit(f"1.{'9' * 59}"))) == [1]
    many = " ".join(f'k{i % 40000}="{i}"' for i in range(50_000))
    attributes = column(spark, [many], text.parse_attributes)[0]
    assert len(attributes) == 40_000 and attributes["k1"] == "40001" and attributes["k39999"] == "39999"
    assert column(spark, ["(" * 200_000 + ")" * 200_000], doc.brackets_balanced) == [True]


def test_large_integers_and_nulls_pass_python_unharmed(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([("a", big), ("a", None), ("b", 3)], "k string, v long")
    same = udf.scalar_function(lambda v: v, "bigint")
    assert sorted(r.x or 0 for r in df.select(same("v").alias("x")).collect()) == [0, 3, big]
    rows = udf.table_function(df, lambda r: [(r["v"],)], "w long", keep=["k", "v"]).collect()
    assert sorted((r.v or 0, r.w or 0) for r in rows) == [(0, 0), (3, 3), (big, big)]
    top = udf.aggregate_function(df, ["k"], lambda g: (g["v"].max(),), lambda a, b: (max(a[0] or 0, b[0] or 0),), "m bigint")
    assert {r.k: r.m for r in top.collect()} == {"a": big, "b": 3}
    from loomline.operators import analytics
    from loomline.streaming import stateful, steps

    def process(row):
        if row["v"] is None or row["v"] == 2**53 + 1:
            raise ValueError(str(row["v"]))

    report, errors = analytics.batch_result_report(df, "k", "v", process)
    assert sorted(r.message for r in errors.collect()) == ["9007199254740993", "None"]
    log = df.withColumn("i", F.monotonically_increasing_id())
    audited = stateful.state_transition_audit(log, ["k"], ["i"], "k", [("x", "a")], "x").collect()
    assert sorted(r.v or 0 for r in audited) == [0, 3, big]


def test_python_functions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("a", 4)], "k string, v int")
    inverse = udf.scalar_function(lambda v: 1 / v, "double")
    assert sorted(r.x for r in df.filter("v > 0").select(inverse("v").alias("x")).collect()) == [0.25, 1.0]
    assert df.select(inverse("v").alias("x")).filter("x is null").count() == 1
    assert df.filter(udf.predicate(lambda v: 1 / v > 0.5)("v")).count() == 1
    best = udf.aggregate_function(df, ["k"], lambda g: (int(g["v"].max()),), lambda a, b: (max(a[0], b[0]),), "m bigint")
    assert {r.k: r.m for r in best.collect()} == {"a": 4, "b": 0}


def test_source_files_are_dealt_to_many_tasks(spark, tmp_path):
    from loomline.catalog.text import source_files
    parts = spark.createDataFrame([(k, f"red box{k}", "TIN", k % 7) for k in range(40)], "p_partkey long, p_name string, p_type string, p_size int")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    files = source_files(spark, str(tmp_path))
    assert files.count() == 40 and files.select(F.spark_partition_id()).distinct().count() > 1
