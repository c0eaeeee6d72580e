"""Shards of near equal size from whole groups: minimax contiguous partition.

Groups of equal texts, in the order of their first id, are atoms; shards are runs of groups. The capacity is the
smallest for which cutting greedily needs no more than the given number of shards; binary search finds it.
The running sums of the groups stay distributed. The driver sees them only through at most
``BINS`` bins (least and greatest sum in each): a greedy walk over bins gives the capacity between two bounds, and
only the stretches where a cut can still lie are binned again, finer, until all cuts are exact.

Defined cases: a null text is a group of its own of size 1 a row and differs from the empty text; equal rows are one
group; a null id comes first; a group larger than a fair share makes its shard larger (it is never split); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.ranks import spread_rank
from loomline.session import materialize, shuffle_width

SHARDS, BINS = 8, 8192


def _running(groups: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """``name``: sum of ``size`` up to and with the row, in ``order``; a range exchange and one stitch by partition."""
    placed = groups.repartitionByRange(shuffle_width(groups.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_t"))  # one row a partition
    shifts = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum(size).over(inside))
    return local.join(shifts, F.col("_part") == F.col("_p")).select(*groups.columns, (F.col("_shift") + F.col("_local")).alias(name))


class _Bins:
    """Disjoint bins (least, greatest) of group ends, in order; both are ends of groups."""

    def __init__(self, bins: list[tuple[int, int]]):
        self.bins = sorted(bins)
        self.firsts = [b[0] for b in self.bins]

    def end(self, reach: int, sure: bool) -> int:
        """The greatest end up to ``reach``: at least (``sure``), or at most."""
        at = bisect_right(self.firsts, reach) - 1
        if at < 0:
            return 0
        least, most = self.bins[at]
        return most if most <= reach else least if sure else reach

    def walk(self, capacity: int, shards: int, total: int, sure: bool) -> list[int]:
        """Where greedy cutting ends the shards; the last end is below ``total`` if the capacity is too small."""
        ends = [0]
        for _ in range(shards):
            reach = ends[-1] + capacity
            ends.append(total if reach >= total else self.end(reach, sure))
        return ends[1:]

    def least_capacity(self, low: int, high: int, shards: int, total: int, sure: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.walk(middle, shards, total, sure)[-1] == total else (middle + 1, high)
        return low


def _bins(ends: DataFrame, spans: list[tuple[int, int]]) -> _Bins:
    """At most about ``BINS`` bins of the ends within the spans (both borders with)."""
    each = max(1, BINS // len(spans))
    key = F.lit(None).cast("long")
    for i, (low, high) in enumerate(spans):
        width = max(1, -(-(high - low + 1) // each))
        key = F.when(F.col("_end").between(low, high), F.expr(f"{i * (each + 1)}L + (_end - {low}L) div {width}L")).otherwise(key)
    rows = ends.select("_end", key.alias("_bin")).filter("_bin IS NOT NULL").groupBy("_bin").agg(F.min("_end").alias("a"), F.max("_end").alias("b"))
    return _Bins([(r.a, r.b) for r in rows.collect()])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def minimax_cuts(ends: DataFrame, shards: int) -> list[int]:
    """Ends of the shards over the running sums ``_end`` of the groups, for the smallest feasible capacity."""
    total = ends.agg(F.max("_end")).first()[0]
    if total is None:
        return []
    low, high, spans = -(-total // shards), total, [(1, total)]
    while True:
        known = _bins(ends, spans)
        low, high = (known.least_capacity(low, high, shards, total, sure) for sure in (False, True))
        least, most = known.walk(low, shards, total, True), known.walk(high, shards, total, False)
        if low == high and least == most:
            return least
        # the ends of the answer lie between the walk that is too careful and the one that is too bold
        spans = _merged([(max(1, a), b) for a, b in zip(least[:-1], most[:-1])])


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot): whole groups of equal texts in runs of near equal bytes."""
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1).cast("long")).alias("size"),
        F.crc32(raw).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("digest")), "sized")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("_size"))
    ends = _running(groups, [F.col("_first").asc_nulls_first(), F.col("digest").asc()], "_size", "_end")
    ends = materialize(ends.select("digest", "_end"), "ends")
    shard = sum((F.when(F.col("_end") > cut, 1).otherwise(0) for cut in minimax_cuts(ends, shards)[:-1]), F.lit(0))
    placed = rows.join(ends.select("digest", shard.cast("int").alias("shard")), "digest")
    placed = placed.select("doc_id", "size", "text_crc32", "digest", "shard")
    return spread_rank(placed, ["shard"], ["doc_id", "digest"], [F.col("doc_id").asc_nulls_first(), "digest"], "slot")
