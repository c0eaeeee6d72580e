"""Whole-text jobs: source-code facts, structure checks, commit logs, webhooks, answer cleaning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import find_all, let, strip

# ---------------------------------------------------------------- source-code facts

# The patterns that define each kind of fact, and the words that are no functions.
INCLUDE = r'#include\s+[<"]([^>"]+)[>"]'
DERIVED_CLASS = r"class\s+(\w+)\s*[:{]\s*public\s+(\w+)"
ANY_CLASS = r"class\s+(\w+)\s*[:{]"
STRUCT = r"struct\s+(\w+)\s*\{([^}]*)\}"
STRUCT_FIELD = r"(\w+(?:\*|\&)?)\s+(\w+)\s*;"
FUNCTION = r"(?:void|int|bool|float|double|string|auto)\s+(\w+)\s*\([^)]*\)"
METHOD = r"(virtual\s+)?(\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)"
NOT_FUNCTIONS = ("if", "for", "while", "switch", "return")
SQL_CALLS = (r'(?i)SQLExecDirect\([^,]+,\s*"([^"]+)"', r'(?i)execute\([^,]*\s*,\s*"([^"]+)"', r'(?i)cbExec\([^,]+,\s*"([^"]+)"')
DEPENDENCIES = (r"\b(\w+)\s+(\w+)\s*;", r"\b(\w+)\s*->\s*(\w+)\s*\(", r"\b(\w+)\s*\.(\w+)\s*\(")
REPORT = r"(?i)CrystalReport|\.rpt|CRPE"
WIDGETS = (("QWidget", r"class\s+(\w+)\s*:\s*public\s+QWidget"), ("QMainWindow", r"class\s+(\w+)\s*:\s*public\s+QMainWindow"))
RECORD_TYPES = ("char", "int", "float")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "parent", "body")])))
def class_bodies(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Derived classes of a file with the text up to their closing brace."""
    start, brace = re.compile(DERIVED_CLASS, re.ASCII), re.compile("[{}]")

    def bodies(text):
        found = []
        for m in start.finditer(text or ""):
            depth, end = 0, len(text)
            for b in brace.finditer(text, m.start()):
                depth += 1 if b.group() == "{" else -1
                if depth == 0:
                    end = b.end()
                    break
                if depth < 0:
                    end = b.start()
                    break
            found.append({"name": m.group(1), "parent": m.group(2), "body": text[m.start():end]})
        return found

    for batch in contents:
        yield batch.map(bodies)


def source_code_facts(files: DataFrame) -> DataFrame:
    """(path, kind, name, parent, detail) facts of ``files(path, content)``.

    Kinds: include, class (with a parent), simple_class, method, dependency, struct,
    field, function, sql, report, widget. Repeated dependencies and SQL texts of a
    file count once.
    """
    c = F.col("content")
    none = F.lit(None).cast("string")

    def rows(kind: str, items: Column, name=lambda x: x, parent=lambda x: none, detail=lambda x: none) -> Column:
        return F.transform(items, lambda x: F.struct(
            F.lit(kind).alias("kind"), name(x).alias("name"), parent(x).alias("parent"), detail(x).alias("detail")))

    structs = F.arrays_zip(find_all(c, STRUCT, 1).alias("name"), find_all(c, STRUCT, 2).alias("body"))
    record = lambda s: F.when(
        reduce(lambda a, b: a | b, [F.contains(F.lower(s["body"]), F.lit(t)) for t in RECORD_TYPES]), "record").otherwise("plain")
    sql = F.array_distinct(F.concat(*[find_all(c, p, 1) for p in SQL_CALLS]))
    functions = F.filter(F.array_distinct(find_all(c, FUNCTION, 1)), lambda x: ~x.isin(*NOT_FUNCTIONS))
    derived = find_all(c, DERIVED_CLASS, 1)
    simple = F.array_except(find_all(c, ANY_CLASS, 1), derived)
    widget = F.when(c.rlike(WIDGETS[0][1]), F.array(F.lit(WIDGETS[0][0]))).when(
        c.rlike(WIDGETS[1][1]), F.array(F.lit(WIDGETS[1][0]))).otherwise(F.array().cast("array<string>"))
    report = F.when(c.rlike(REPORT), F.array(F.lit("report"))).otherwise(F.array().cast("array<string>"))

    plain = F.concat(
        rows("include", find_all(c, INCLUDE, 1)), rows("simple_class", simple), rows("function", functions),
        rows("sql", sql), rows("report", report), rows("widget", widget),
        rows("struct", structs, lambda s: s["name"], detail=record),
        F.flatten(F.transform(structs, lambda s: F.transform(
            F.arrays_zip(find_all(s["body"], STRUCT_FIELD, 1).alias("t"), find_all(s["body"], STRUCT_FIELD, 2).alias("n")),
            lambda f: F.struct(F.lit("field").alias("kind"), f["n"].alias("name"), s["name"].alias("parent"), f["t"].alias("detail"))))))
    flat = files.select("path", F.explode(plain).alias("f")).select("path", "f.*")

    bodies = files.filter(c.rlike(DERIVED_CLASS)).select("path", F.explode(class_bodies("content")).alias("k")).select("path", "k.*")
    body = F.col("body")
    methods = F.arrays_zip(find_all(body, METHOD, 3).alias("n"), find_all(body, METHOD, 2).alias("r"))
    used = F.array_remove(F.array_distinct(F.concat(*[find_all(body, p, 1) for p in DEPENDENCIES])), "this")
    inner = F.concat(
        F.array(F.struct(F.lit("class").alias("kind"), F.col("name"), F.col("parent"), none.alias("detail"))),
        rows("method", methods, lambda m: m["n"], lambda m: F.col("name"), lambda m: m["r"]),
        rows("dependency", used, lambda x: x, lambda x: F.col("name")))
    return flat.unionByName(bodies.select("path", F.explode(inner).alias("f")).select("path", "f.*"))


def class_table(facts: DataFrame) -> DataFrame:
    """One row per class name: a derived definition beats a simple one, a later file an earlier one."""
    classes = facts.filter(F.col("kind").isin("class", "simple_class"))
    derived = F.col("kind") == "class"
    rank = F.struct(derived, F.when(derived, F.col("path")), F.col("parent"))
    return classes.groupBy("name").agg(
        F.max_by("parent", rank).alias("parent"),
        F.coalesce(F.max(F.when(derived, F.col("path"))), F.min("path")).alias("path"))


def fact_summary(facts: DataFrame) -> DataFrame:
    """(kind, n, files): facts and files per kind."""
    return facts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))


# ---------------------------------------------------------------- structure checks

# Minimum length, statement starts, root elements.
MIN_LENGTH = 10
STATEMENTS = ("CREATE", "ALTER", "DROP", "INSERT", "UPDATE", "DELETE", "COMMENT", "GRANT", "REVOKE")
ROOT_ELEMENTS = ("Item", "Rectangle", "Button", "Text", "Window", "ApplicationWindow")


_MARKS = re.compile(r"[()\[\]{}]")


@F.pandas_udf(T.BooleanType())
def brackets_balanced(texts: pd.Series) -> pd.Series:
    """Every closing bracket meets its own kind, and none stays open."""
    opened = {")": "(", "]": "[", "}": "{"}

    def balanced(text):
        if text is None:
            return None
        stack = []
        for mark in _MARKS.findall(text):
            if mark not in opened:
                stack.append(mark)
            elif not stack or stack.pop() != opened[mark]:
                return False
        return not stack

    return texts.map(balanced).astype("object")


# The messages of the reports below, as specified.


def _report(c: Column, short: str, errors: list[Column], warnings: list[Column]) -> Column:
    """(valid, errors, warnings); too short a text has one error only."""
    too_short = c.isNull() | (F.length(c) < MIN_LENGTH)
    no_text = F.array().cast("array<string>")
    found = F.when(too_short, F.array(F.lit(short))).otherwise(F.array_compact(F.concat(*errors)))
    noted = F.when(too_short, no_text).otherwise(F.array_compact(F.concat(*warnings)))
    return let(F.struct(found.alias("e"), noted.alias("w")), lambda r: F.struct(
        (F.size(r["e"]) == 0).alias("valid"), r["e"].alias("errors"), r["w"].alias("warnings")))


def _one(test: Column, message) -> Column:
    return F.array(F.when(test, message))


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def check_haskell(c: Column) -> Column:
    signature = r"(?U)(\w+)\s*::\s*([^\n=]+)"
    pairs = F.arrays_zip(find_all(c, signature, 1).alias("n"), find_all(c, signature, 2).alias("s"))
    empty = F.transform(F.filter(pairs, lambda p: strip(p["s"]) == ""),
                        lambda p: F.concat(F.lit("Empty type signature for "), p["n"]))
    empty = F.when(c.contains("::"), empty).otherwise(F.array().cast("array<string>"))
    return _report(c, "Empty or too short content",
                   [_one(~brackets_balanced(c), "Unbalanced brackets or parentheses"), empty],
                   [_one(~c.contains("module") & ~c.contains("import"), "No module or import declarations found")])


def check_sql(c: Column) -> Column:
    """Every statement is looked at for its kind; the counts cover the whole text."""
    statements = F.filter(F.transform(F.split(c, ";"), strip), lambda s: s != "")
    known = lambda s: reduce(lambda a, b: a | b, [F.startswith(F.upper(s), F.lit(k)) for k in STATEMENTS])
    odd = F.transform(F.filter(statements, lambda s: ~known(s)),
                      lambda s: F.concat(F.lit("Unknown statement type: "), s))
    return _report(c, "Empty or too short SQL",
                   [_one(count_of(c, "(") != count_of(c, ")"), "Unbalanced parentheses")],
                   [_one(~F.upper(c).contains("CREATE TABLE"), "No CREATE TABLE statements found"), odd])


def check_qml(c: Column) -> Column:
    root = c.rlike(rf"(?m)^\s*<(?:{'|'.join(ROOT_ELEMENTS)})\s")
    return _report(c, "Empty or too short QML", [_one(count_of(c, "{") != count_of(c, "}"), "Unbalanced curly braces")],
                   [_one(~c.contains("import"), "No import statements found"), _one(~root, "No root QML element found")])


# ---------------------------------------------------------------- commit logs


def parse_commit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``hash|subject|author|date|parents`` lines; bars inside the subject are kept."""
    parts = F.split(column, r"\|", -1)
    n = F.size("p")
    split = lines.select("*", parts.alias("p")).filter(n >= 4)
    tail = F.when(n == 4, n).otherwise(n - 1)  # parts up to and including the date
    at = lambda i: F.element_at("p", i.cast("int"))
    return split.select(
        *lines.columns, F.substring(at(F.lit(1)), 1, 8).alias("hash"),
        F.array_join(F.slice("p", F.lit(2), tail - 3), "|").alias("subject"),
        at(tail - 1).alias("author"), at(tail).alias("date"),
        F.when(n > 4, at(n)).otherwise("").alias("parents"))


def parse_status_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Short status lines: file with modified, staged and untracked flags."""
    status, line = F.substring(column, 1, 2), F.col(column)
    return lines.filter(line != "").select(
        F.substring(column, 4, 1 << 30).alias("file"), status.contains("M").alias("modified"),
        status.startswith("M").alias("staged"), status.contains("?").alias("untracked"))


# ---------------------------------------------------------------- webhooks


def normalize_webhooks(events: DataFrame) -> DataFrame:
    """Few common fields of (source, event_type, payload JSON text); other kinds give no row.

    Works on batch and stream tables alike.
    """
    v = F.col("_v")
    text = lambda p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))
    number = lambda p: F.coalesce(F.try_variant_get(v, p, "bigint"), F.lit(0).cast("bigint"))
    kind = F.concat_ws("/", "source", "event_type")
    commits = F.coalesce(F.size(F.try_variant_get(v, "$.commits", "array<variant>")), F.lit(0)).cast("bigint")
    push = kind.isin("github/push", "gitlab/push")
    known = push | kind.isin("github/pull_request", "github/issues", "github/release", "gitlab/merge_request",
                             "gitlab/tag_push", "slack/url_verification", "slack/event_callback")
    name = (F.when(kind == "github/push", text("$.repository.full_name")).when(kind == "gitlab/push", text("$.project.path_with_namespace"))
            .when(kind == "github/release", text("$.release.tag_name")).when(kind == "gitlab/tag_push", F.replace(text("$.ref"), F.lit("refs/tags/"), F.lit("")))
            .when(kind == "slack/url_verification", text("$.challenge")).when(kind == "slack/event_callback", text("$.event.type")))
    action = (F.when(kind.isin("github/pull_request", "github/issues", "github/release"), text("$.action"))
              .when(kind == "gitlab/merge_request", text("$.object_attributes.action"))
              .when(kind != "slack/url_verification", F.col("event_type")))
    ident = (F.when(kind == "github/pull_request", number("$.pull_request.number")).when(kind == "github/issues", number("$.issue.number"))
             .when(kind == "gitlab/merge_request", number("$.object_attributes.iid")))
    rows = events.filter(known).withColumn("_v", F.try_parse_json("payload"))
    return rows.select(*[c for c in events.columns if c != "payload"], action.alias("action"), name.alias("name"),
                       ident.alias("number"), F.when(push, commits).alias("commits"))


# ---------------------------------------------------------------- answer cleaning

# One level of nesting; possessive, so long texts need no backtracking.
JSON_BLOCK = r"(\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\})"


def strip_fences(c: Column, language: str) -> Column:
    """Drop code fences of a language anywhere in the text."""
    return F.regexp_replace(F.regexp_replace(c, f"```{language}\\n?", ""), "```\\n?", "")


def clean_answer(c: Column) -> Column:
    """JSON text without its fences and control characters."""
    t = strip(c)
    for pattern in (r"(?U)^```json\s*", r"(?U)^```\s*", r"(?U)\s*```$"):
        t = F.regexp_replace(t, pattern, "")
    return F.regexp_replace(t, r"[\x00-\x1f\x7f-\x9f]", "")


def parse_answers(answers: DataFrame, text: str, parts: tuple[str, ...]) -> DataFrame:
    """Parsed answers with one column per part and ``status``: clean, block or failed."""
    whole = F.try_parse_json(clean_answer(F.col(text)))
    block = F.try_parse_json(F.regexp_extract(text, JSON_BLOCK, 1))
    rows = answers.withColumn("_w", whole).withColumn("_b", F.when(F.col("_w").isNull(), block))
    status = F.when(F.col("_w").isNotNull(), "clean").when(F.col("_b").isNotNull(), "block").otherwise("failed")
    chosen = F.coalesce("_w", "_b")
    fields = [F.when(chosen.isNotNull(), F.coalesce(F.try_variant_get(chosen, f"$.{p}", "string"), F.lit(""))).alias(p) for p in parts]
    return rows.select(*answers.columns, status.alias("status"), *fields)
