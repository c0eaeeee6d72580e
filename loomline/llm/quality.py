"""Quality rules: a table of thresholds compiled into one projection.

All measures are built-in functions, so that the whole verdict is one scan without a shuffle. A document is rejected
when it is too short or mostly repeated (``base_failed``), or when a measure leaves its range in ``RULES``.

The measures come out of a generator of one row, since Spark does not push filters below one. Otherwise a filter on
``kept`` would be written out with all measures once for each rule that it stands for.

Defined cases: a null or empty text has no words, all counts are 0 and it fails; measures of nothing are null and break
no rule, as does the share of stop words where fewer than half of the words hold a letter from A to Z, since the
list has only words of Latin script; very long texts are read whole; equal rows get equal verdicts; every other column is
kept under any name, one of an output's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.columns import SPACE, bound, quoted, unused_name, words

#: Frequent function words of English, German, French and Spanish; the share is taken only of texts that are mostly Latin.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from or an not have "
    "der die und den von zu das sich mit des auf für nicht im ist dem ein eine als auch "
    "de la le et les un du une que pour est dans qui au par sur pas avec il "
    "el en y los las se del por con no su para al lo es como"
).split()
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: measure -> (least, most); None is no bound. Shares lie within 0 and 1.
RULES: dict[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (2.0, 12.0),
    "symbols_per_word": (None, 0.25),
    "stop_word_share": (0.05, None),
    "upper_word_share": (None, 0.5),
    "dup_line_share": (None, 0.5),
}


def _repeated(found: Column) -> Column:
    """Words in windows of three that occur twice or more: windows are hashed, sorted and compared with their neighbours."""
    windows = F.transform(F.sequence(F.lit(0), F.size(found) - 3),
                          lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            same = lambda row, j: F.get(rows, j)["h"] == row["h"]
            return F.filter(rows, lambda row, j: F.coalesce(same(row, j - 1), F.lit(False)) | F.coalesce(same(row, j + 1), F.lit(False)))

        covered = F.flatten(F.transform(bound(placed, twice), lambda row: F.array(row["i"], row["i"] + 1, row["i"] + 2)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.size(F.array_distinct(covered)))

    return F.when(F.size(found) < 4, 0).otherwise(bound(windows, count))


def _measures(text: Column) -> Column:
    def of(found: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}"))
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bound(lines, lambda own: F.struct(F.size(own).cast("long").alias("n"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("dup"))).alias("lines"),
            _repeated(found).cast("long").alias("n_repeat_words"),
            F.size(F.filter(found, lambda w: F.lower(w).isin(STOP_WORDS))).alias("stops"),
            F.size(F.filter(found, lambda w: w.rlike("[A-Za-z]"))).alias("latin"),
            F.size(F.filter(found, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))).alias("uppers"),
        )

    return bound(words(text), of)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: dict[str, tuple[float | None, float | None]] | None = None,
                  min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT) -> DataFrame:
    """The rows with their counts, the measures of ``RULES``, ``base_failed``, ``failed_rules`` and ``kept``."""
    rules = RULES if rules is None else rules
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES, "base_failed", "failed_rules", "kept"]
    own = [F.col(quoted(c)) for c in docs.columns if c not in names]
    held = unused_name(docs, "measures")
    m = F.col(held)
    measures = _measures(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    measured = docs.select(*own, F.explode(F.array(measures)).alias(held))
    counted = measured.select(
        *own, m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        _share(m["word_chars"], m["n_words"]).alias("mean_word_chars"), _share(m["n_symbols"], m["n_words"]).alias("symbols_per_word"),
        F.when(2 * m["latin"] >= m["n_words"], _share(m["stops"], m["n_words"])).alias("stop_word_share"), _share(m["uppers"], m["n_words"]).alias("upper_word_share"),
        _share(m["lines"]["dup"], m["lines"]["n"]).alias("dup_line_share"),
        ((m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeated_percent * m["n_words"])).alias("base_failed"))
    broken = []
    for name, (least, most) in rules.items():
        tests = ([F.col(name) < least] if least is not None else []) + ([F.col(name) > most] if most is not None else [])
        if tests:
            broken.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(name)))
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    judged = counted.withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def _sql_words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    sql = {"mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words",
           "stop_word_share": "CASE WHEN 2 * latin >= n_words THEN stops / n_words END",
           "upper_word_share": "uppers / n_words", "dup_line_share": "n_dup_lines / n_lines"}
    for name, (least, most) in RULES.items():
        tests += [f"coalesce({sql[name]} >= {least}, true)"] if least is not None else []
        tests += [f"coalesce({sql[name]} <= {most}, true)"] if most is not None else []
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_sql_words("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
  coalesce(v.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) AS latin,
  len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) AS uppers
  FROM d JOIN l USING (doc_id) LEFT JOIN v USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""
