"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Its set are its
shingles (three words, or all it has). The join runs in two scans of the documents:

* how often each shingle of the benchmark stands in all documents; this is the global order, rarest first. A window of
  which too many shingles stand nowhere cannot occur and goes;
* a window that reaches ``containment`` must hold one of its first n - ceil(containment * n) + 1 shingles (its necessary
  prefix), so only these are joined with the shingles of the documents. Where one stands, its offset in the window fixes
  where the window would begin: it must begin in the text (position bound) and end in it (length bound), and the words
  of that stretch, as long as the window, are then compared (exact, by words, not by hashes).

The benchmark is a stated query set: it is broadcast in blocks of at most ``BLOCK_BYTES``, by its measured size, and
each block meets all documents; usually there is one. Documents are never shuffled, only what was found in them.

Defined cases: a null or empty text has no words, no hits, and the hash of nothing; rows that repeat stay as many rows;
items without an id are found, but not counted or listed; rows of one item id are one item; an item without words has no
window; an empty table of documents gives no rows, an empty benchmark no hits. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.columns import bound
from loomline.session import discard, materialize

#: Characters between words, after A-Z have become small letters.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW, SHINGLE = 10, 3
BLOCK_BYTES = 32 << 20
#: Stands after the shingles of every document, so that documents without hits stay in the result.
_END = -1


def words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    small = F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())
    return F.array_remove(F.split(small, _GAP + "+"), "")


def _shingles(found: Column, size: int) -> Column:
    """A hash for each place at which ``size`` words begin."""
    last = F.size(found) - size
    own = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(size)]))
    return F.when(last >= 0, own).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each distinct window (``own``, its words) with the ``items`` (ids as text) that hold it."""
    worded = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = worded.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("own"))
    return cut.groupBy("own").agg(F.collect_set("item").alias("items"))


def _placed_shingles(windows: DataFrame, shingle: int) -> tuple[DataFrame, list[int]]:
    """(own, n, size, offset, h) for each shingle of each window, and the sizes that occur, largest first."""
    sizes = sorted((r.s for r in windows.select(F.least(F.size("own"), F.lit(shingle)).alias("s")).distinct().collect()), reverse=True)
    parts = [windows.filter(F.least(F.size("own"), F.lit(shingle)) == s).select(
        "own", (F.size("own") - s + 1).alias("n"), F.lit(s).alias("size"), F.posexplode(_shingles(F.col("own"), s)).alias("offset", "h")) for s in sizes]
    placed = parts[0] if parts else windows.select("own", F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("h"))
    for p in parts[1:]:
        placed = placed.unionByName(p)
    return placed, sizes


def _blocks(table: DataFrame, row_bytes: Column) -> list[DataFrame]:
    """The written table in parts that are small enough to be broadcast, as it is if it is one."""
    total = table.agg(F.sum(row_bytes).alias("n")).first().n or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    return [table] if n == 1 else [table.filter(F.pmod(F.xxhash64("h", F.lit(n)), F.lit(n)) == k) for k in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefixes(docs: DataFrame, windows: DataFrame, text_col: str = "text", shingle: int = SHINGLE, containment: float = 1.0) -> tuple[DataFrame, list[int]]:
    """(own, items, n, size, need, offset, h): each window's necessary prefix in the order of the corpus; and the shingle sizes."""
    placed, sizes = _placed_shingles(windows, shingle)
    placed = materialize(placed, "shingles")
    forms = materialize(placed.select("h").distinct(), "forms")
    text = docs.select(words(F.col(text_col)).alias("w"))
    hashed = text.select(F.explode(F.concat(*[_shingles(F.col("w"), s) for s in sizes])).alias("h")) if sizes else text.select(F.lit(0).cast("long").alias("h")).limit(0)
    counted = _union([hashed.join(F.broadcast(b), "h", "left_semi") for b in _blocks(forms, F.lit(16))]).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ordered = placed.join(counted, "h", "left").select("*", F.ceil(F.lit(containment) * F.col("n") - 1e-9).cast("int").alias("need"))
    own = Window.partitionBy("own")
    ranked = ordered.select("*", F.count("df").over(own).alias("known"), F.row_number().over(own.orderBy(F.coalesce("df", F.lit(0)), "h", "offset")).alias("place"))
    needed = ranked.filter("known >= need AND place <= n - need + 1 AND df IS NOT NULL")
    out = materialize(needed.join(windows, "own").select("own", "items", "n", "size", "need", "offset", "h"), "prefixes")
    discard(placed, forms)
    return out, sizes


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, containment: float = 1.0) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items (sorted ids), spans (start, length; by start), contaminated.

    ``containment`` is the share of a window's shingles that must stand at their places; 1 asks for the window word by word.
    """
    windows = materialize(item_windows(items, item_col, item_text_col, window), "windows")
    table, sizes = prefixes(docs, windows, text_col, shingle, containment)
    row_bytes = F.octet_length(F.array_join("own", " ")) + 24 * F.size("own") + F.octet_length(F.array_join("items", " ")) + 24 * F.size("items") + 64
    blocks = _blocks(table, row_bytes)
    # equal rows of one task are told apart from those of others, so that a hot row is not dealt to one task
    part = F.spark_partition_id() if len(blocks) == 1 else F.lit(0)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    read = read.select("id", part.alias("part"), F.md5("t").alias("key"), words(F.col("t")).alias("w"))
    kinds = {f.name: f.dataType for f in table.schema}
    end = table.sparkSession.range(1).select(*[(F.lit(_END).cast("long") if c == "h" else F.lit(None).cast(kinds[c])).alias(c) for c in table.columns])
    found = []
    for k, block in enumerate(blocks):
        own = [_shingles(F.col("w"), s) for s in sizes]
        listed = F.concat(*own, F.array(F.lit(_END).cast("long")))
        spread = read.select("id", "part", "key", "w", F.size("w").alias("n_words"), F.posexplode(listed).alias("at", "h"))
        side = block.unionByName(end) if k == 0 else block
        met = spread.join(F.broadcast(side), "h")
        # shingles of a size begin after those of the larger sizes
        before = F.coalesce(*[F.when(F.col("size") == s, _before(sizes, s)) for s in sizes], F.lit(0)) if sizes else F.lit(0)
        total = _before(sizes, 0)
        start = F.col("at") - before - F.col("offset")
        met = met.select("id", "part", "key", "n_words", "own", "items", "n", "size", "need", start.alias("start"), (F.col("at") == total).alias("end"),
                         F.when((start >= 0) & (start + F.size("own") <= F.col("n_words")), F.slice("w", start + 1, F.size("own"))).alias("here"))
        same = F.when(F.col("here") == F.col("own"), F.col("n")) if containment >= 1 else _agreeing()
        found.append(met.filter((F.col("own").isNull() & F.col("end")) | (F.col("here").isNotNull() & (same >= F.col("need")))))
    is_end = F.col("own").isNull()
    grouped = _union(found).groupBy("id", "part", "key").agg(
        F.max("n_words").alias("n_words"), F.count_if(is_end).alias("rows"),
        F.collect_set(F.when(~is_end, F.struct("start", F.size("own").alias("length")))).alias("spans"),
        F.collect_set("items").alias("lists"))
    each = grouped.select("id", "n_words", F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"),
                          F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("turn"))
    return each.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def _before(sizes: list[int], size: int) -> Column:
    """How many shingles of larger sizes a document has."""
    out = F.lit(0)
    for s in sizes:
        if s > size:
            out = out + F.greatest(F.col("n_words") - s + 1, F.lit(0))
    return out


def _agreeing() -> Column:
    """How many shingles of the window stand at their places in the stretch of the document."""
    places = F.sequence(F.lit(1), F.col("n"))
    return F.size(F.filter(places, lambda i: F.slice("here", i, F.col("size")) == F.slice("own", i, F.col("size"))))


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, span: Column) -> Column:
        return bound(span["start"] + span["length"], lambda end: F.struct(
            (acc["n"] + F.greatest(end - F.greatest(span["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end")))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def digests(found: DataFrame) -> DataFrame:
    """The rows with the list of items as a hash."""
    hashed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", hashed.alias("items_sha256"), "contaminated")


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    w = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (upper, upper.lower())
    return f"""
WITH i AS (SELECT item_id, {w} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, w[k + 1:k + {WINDOW}] AS own FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(own) AS n FROM v),
d AS (SELECT doc_id, {w} AS w FROM documents),
p AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d JOIN n ON len(w) >= n),
m AS (SELECT doc_id, k, n, item_id FROM (SELECT doc_id, k, n, w[k + 1:k + n] AS own FROM p) JOIN v USING (own)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)"""
