"""Ranked lexical search of many items at once, by common subexpressions.

The items are a stated query set, taken in blocks of at most ``BLOCK_TERMS`` different terms, and each block meets all
documents (usually there is one block):

1. A scan of the documents counts the block's terms in each text (``term_counts``, a written table of a row a document).
   The number of documents with terms, all terms, and the documents of each term come from that table.
2. The score of an item is a sum over its terms, so items that share terms share partial sums. ``share`` mines these: terms
   held by just the same items become one node, then the pair of nodes that most items hold together becomes a node,
   again and again, until no two items hold a pair in common. The nodes form a directed acyclic graph over the terms.
3. A scan of the written table fills one accumulator of all documents of a batch for each term, adds up each shared node
   once, and each item from its last nodes; the best documents of each item in a batch go on, and two ranked steps (by
   a hash of the id, then whole) leave the best of all.

All arithmetic is on 64-bit integers, but for the weight of a term.

Defined cases: a null text, or one without a term, is no document of the statistics and never found; an item is a
distinct (id, text), those without terms find nothing; repeated documents are ranked each for itself, equal scores by
ascending id, documents without id last; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import discard, materialize, shuffle_width

BEST = 20
#: Different terms of a block of items: bounds the tables that each task holds.
BLOCK_TERMS = 20_000
#: Bytes of accumulators at one time in a task.
ACCUMULATOR_BYTES = 64 << 20
_SMALL_OR_GAP = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: letters and digits of ASCII, A-Z made small, and all that lies beyond ASCII."""
    return (text or b"").translate(_SMALL_OR_GAP).split()


@dataclass(frozen=True)
class Plan:
    """Items as sums over a graph: node numbers below ``len(terms)`` are terms, each further one the sum of two before."""

    terms: list[bytes]
    pairs: list[tuple[int, int]]
    items: list[list[tuple[int, int]]]  #: for each item (node, times)


def share(items: Sequence[Counter]) -> Plan:
    """The graph of partial sums that several items need.

    A unit is a term with the number of times an item holds it, since only like multiples can be shared. Units of the very
    same items are added up first; then pairs of nodes, those that most items hold first.
    """
    terms = sorted({t for own in items for t in own})
    number = {t: k for k, t in enumerate(terms)}
    pairs: list[tuple[int, int]] = []

    def node(a: int, b: int) -> int:
        pairs.append((a, b))
        return len(terms) + len(pairs) - 1

    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, own in enumerate(items):
        for t in sorted(own):
            holders[(number[t], own[t])].append(k)
    alike: dict[tuple[int, tuple[int, ...]], list[int]] = defaultdict(list)
    for (t, times), held in holders.items():
        alike[(times, tuple(held))].append(t)
    held_by: list[set[tuple[int, int]]] = [set() for _ in items]
    for (times, held), own in alike.items():
        groups = [own] if len(held) > 1 else [[t] for t in own]
        for group in groups:
            top = group[0]
            for t in group[1:]:
                top = node(top, t)
            for k in held:
                held_by[k].add((top, times))

    together: dict[tuple, set[int]] = defaultdict(set)

    def meet(k: int, a: tuple[int, int], others: set[tuple[int, int]]) -> None:
        for b in others:
            if b != a and b[1] == a[1]:
                together[(min(a, b), max(a, b))].add(k)

    for k, own in enumerate(held_by):
        for a in own:
            meet(k, a, {b for b in own if b > a})
    queue = [(-len(ks), pair) for pair, ks in together.items() if len(ks) > 1]
    heapq.heapify(queue)
    while queue:
        n, pair = heapq.heappop(queue)
        ks = together.get(pair, set())
        if len(ks) < 2:
            continue
        if len(ks) != -n:
            heapq.heappush(queue, (-len(ks), pair))
            continue
        a, b = pair
        new = (node(a[0], b[0]), a[1])
        for k in sorted(ks):
            own = held_by[k]
            own -= {a, b}
            for c in own:
                for old in (a, b):
                    together.get((min(old, c), max(old, c)), set()).discard(k)
            meet(k, new, own)
            own.add(new)
        del together[pair]
        for c in {c for k in ks for c in held_by[k]} - {new}:
            fresh = (min(new, c), max(new, c))
            if len(together.get(fresh, ())) > 1:
                heapq.heappush(queue, (-len(together[fresh]), fresh))
    return Plan(terms, pairs, [sorted(own) for own in held_by])


def _blocks(items: list[tuple[int, Counter]]) -> Iterator[list[tuple[int, Counter]]]:
    """The items in runs of at most ``BLOCK_TERMS`` different terms; an item of more stands alone."""
    run, seen = [], set()
    for row in items:
        if run and len(seen | set(row[1])) > BLOCK_TERMS:
            yield run
            run, seen = [], set()
        run.append(row)
        seen |= set(row[1])
    if run:
        yield run


def term_counts(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, counts) for each document with a term: all its terms counted, and those of the list with their numbers."""
    number = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            ids, sizes, ends, found, times = [], [], [0], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms_of(text.as_py())
                if not own:
                    continue
                ids.append(i)
                sizes.append(len(own))
                for term, n in Counter(own).items():
                    k = known.get(term)
                    if k is not None:
                        found.append(k)
                        times.append(n)
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind)) for values, kind in ((found, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return read.mapInArrow(count, "id long, n long, terms array<int>, counts array<long>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class _Best:
    """The best documents of one item so far: by score, then by id, those without id last."""

    def __init__(self, most: int) -> None:
        self.most, self.score = most, np.zeros(0, np.int64)
        self.bare, self.ids = np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, bare: np.ndarray, ids: np.ndarray) -> None:
        least = self.score[-1] if len(self.score) == self.most else 1
        at = np.flatnonzero(score >= least)
        if len(at) > self.most:  # whatever is below the score at the last place cannot be among the best
            at = at[score[at] >= np.partition(score[at], -self.most)[-self.most]]
        if not len(at):
            return
        s, b, i = (np.concatenate([old, new[at]]) for old, new in ((self.score, score), (self.bare, bare), (self.ids, ids)))
        order = np.lexsort((i, b, -s))[: self.most]
        self.score, self.bare, self.ids = s[order], b[order], i[order]


def _sums(plan: Plan, weights: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, total: int) -> Iterator[np.ndarray]:
    """The scores of each item for a batch of documents, one accumulator for each node."""
    m = 75 + (25 * n * documents) // total
    row = np.repeat(np.arange(len(n)), np.diff(ends))
    value = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[row]))
    nodes = np.zeros((len(plan.terms) + len(plan.pairs), len(n)), np.int64)
    nodes[terms, row] = value
    for k, (a, b) in enumerate(plan.pairs, len(plan.terms)):
        np.add(nodes[a], nodes[b], out=nodes[k])
    for own in plan.items:
        score = np.zeros(len(n), np.int64)
        for k, times in own:
            score += nodes[k] if times == 1 else times * nodes[k]
        yield score


def _ranked(counted: DataFrame, plan: Plan, numbers: list[int], best: int) -> DataFrame:
    """(item, id, score) for the best documents of each item within each task."""
    spark = counted.sparkSession
    whole = counted.agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("t")).first()
    held = {r.t: r.n for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([weight(whole.d, held.get(k, 0)) for k in range(len(plan.terms))], np.int64)
    shared = spark.sparkContext.broadcast((plan, weights))
    documents, total = whole.d, whole.t

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        width = max(1, ACCUMULATOR_BYTES // (8 * max(1, len(plan.terms) + len(plan.pairs))))
        tops = [_Best(best) for _ in plan.items]
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                ids, n, lists, times = part.columns
                ends = lists.offsets.to_numpy().astype(np.int64)
                ends -= ends[0]
                sums = _sums(plan, weights, n.to_numpy(), ends, lists.flatten().to_numpy(), times.flatten().to_numpy(), documents, total)
                bare = ids.is_null().to_numpy(zero_copy_only=False)
                plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for top, score in zip(tops, sums):
                    top.add(score, bare, plain)
        for number, top in zip(numbers, tops):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(top.score), pa.int32()), pa.array(top.ids, pa.int64(), mask=top.bare), pa.array(top.score, pa.int64())], ["item", "id", "score"])

    return counted.mapInArrow(rank, "item int, id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", best: int = BEST) -> DataFrame:
    """(item id, item_text, rank, id, score): the ``best`` documents of each distinct item with a score above 0."""
    spark = docs.sparkSession
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).distinct()
    # the query set passes the driver: it is what the caller asks for, not the corpus
    asked = sorted(named.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.item_text is None, r.item_text or ""))
    counted_items = [(k, Counter(terms_of((r.item_text or "").encode()))) for k, r in enumerate(asked)]
    parts, tables = [], []
    for block in _blocks([row for row in counted_items if row[1]]):
        plan = share([own for _, own in block])
        counted = materialize(term_counts(docs, plan.terms, id_col, text_col), "term-counts")
        parts.append(_ranked(counted, plan, [k for k, _ in block], best))
        tables.append(counted)
    kinds = f"item int, {item_col} {named.schema['item_id'].dataType.simpleString()}, item_text string"
    names = spark.createDataFrame([(k, r.item_id, r.item_text) for k, r in enumerate(asked)], kinds)
    found = parts[0] if parts else spark.createDataFrame([], "item int, id long, score long")
    for p in parts[1:]:
        found = found.unionByName(p)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    bucket = F.pmod(F.xxhash64("id"), F.lit(shuffle_width(spark)))
    first = found.withColumn("bucket", bucket).withColumn("r", F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*order))).filter(F.col("r") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
    out = materialize(ranked.select("item", "rank", "id", "score"), "ranked")
    discard(*tables)
    return out.join(F.broadcast(names) if len(asked) <= 10_000 else names, "item").select(item_col, "item_text", "rank", F.col("id").alias(id_col), "score")


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    w = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (upper, upper.lower())
    return f"""
WITH d AS (SELECT doc_id, {w} AS w FROM documents),
s AS (SELECT count(*) AS dn, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * dn + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, s GROUP BY t, dn),
i AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({w}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
x AS (SELECT item_id, doc_id, sum(c * wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * dn) // l))))::BIGINT AS score
  FROM tf JOIN i USING (t) JOIN df USING (t), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= {BEST}"""
