"""Splittable CSV: values may hold line breaks, and every split of a file is still read by its own task.

A line only moves a reader between two states, outside and inside a quoted value. One pass tells for each split where
it ends from either state; a prefix over the splits of a file gives the state each one begins in; then all splits cut
their records at once, and the few records that cross a border are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.plans.ordered import ordered_window, running
from loomline.session import discard, materialize, materialize_some

_PIECES = "record string, path string, start long, begins boolean, first boolean"


def _ends_inside(sep: str) -> Callable[[str, bool], bool]:
    """Whether a line ends inside a quoted value, by the state it begins in; a quote opens at the start of a value only."""
    s = re.escape(sep)
    unclosed = re.compile(f'(?:(?:[^"{s}][^{s}]*+|"(?:[^"]|"")*+"[^{s}]*+|){s})*+"(?:[^"]|"")*+')
    rest_of_value = re.compile(f'(?:[^"]|"")*+"[^{s}]*+')

    def ends_inside(line: str, inside: bool) -> bool:
        if not inside:
            return unclosed.fullmatch(line) is not None
        closed = rest_of_value.match(line)
        if closed is None:
            return True
        return closed.end() < len(line) and unclosed.fullmatch(line, closed.end() + 1) is not None

    return ends_inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, start of the split) in file order within each split; a carriage return stays with its line."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(path, start, from_outside, from_inside): whether a split ends inside a value, for both states it may begin in."""
    ends_inside = _ends_inside(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, states = None, (False, True)
        for batch in batches:
            done = []
            for value, *here in zip(*[c.to_pylist() for c in batch.columns]):
                if here != split:
                    done += [(*split, *states)] if split else []
                    split, states = here, (False, True)
                if value is not None:
                    states = tuple(ends_inside(value, s) for s in states)
            if done:
                yield _batch(done, names, types)
        if split:
            yield _batch([(*split, *states)], names, types)

    names, types = ["path", "start", "from_outside", "from_inside"], [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    quoted = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")))
    return quoted.mapInArrow(run, "path string, start long, from_outside boolean, from_inside boolean")


def _begins_inside(splits: DataFrame) -> DataFrame:
    """(path, start) of the splits that begin inside a value: the last split of fixed outcome, then the swaps after it."""
    upto = Window.partitionBy("path").orderBy("start")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    counted = splits.withColumn("_swaps", F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(upto))
    last = F.last(F.when(fixed, F.struct("from_outside", "_swaps")), ignorenulls=True).over(before)
    known = counted.withColumn("_fixed", last).withColumn("_before", F.lag("_swaps", 1, 0).over(upto))
    odd = (F.col("_before") - F.coalesce("_fixed._swaps", F.lit(0))) % 2 == 1
    inside = F.coalesce("_fixed.from_outside", F.lit(False)) != odd
    return known.filter(inside).select("path", "start")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _cut_records(lines: DataFrame, sep: str) -> DataFrame:
    """Records of each split; ``path`` is set only for a piece of a record that goes on beyond the split.

    ``lines`` has (value, path, start, inside), the last telling how the split begins. ``begins`` marks the first piece
    of a record, ``first`` the first record of a file that is not blank.
    """
    ends_inside = _ends_inside(sep)
    names = ["record", "path", "start", "begins", "first"]
    types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, kept, begins, inside, heading = None, [], True, False, False
        for batch in batches:
            value, path, start, _ = batch.columns
            same = split == [path[0].as_py(), start[0].as_py()] and pc.count_distinct(path).as_py() == 1 \
                and pc.count_distinct(start).as_py() == 1 if len(batch) else True
            if same and not kept and not heading and not pc.any(pc.match_substring(value, '"')).as_py():
                blank, no = pa.nulls(len(batch)), pa.array([False] * len(batch))
                yield pa.RecordBatch.from_arrays([value.cast(types[0]), blank.cast(types[1]), blank.cast(types[2]), no, no], names=names)
                continue
            out = []
            for line, at, offset, entered in zip(*[c.to_pylist() for c in batch.columns]):
                if [at, offset] != split:
                    if kept:
                        out.append(("\n".join(kept), *split, begins, heading and begins))
                    split, kept, begins, inside, heading = [at, offset], [], not entered, entered, offset == 0
                kept.append(line)
                if inside or '"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    record = "\n".join(kept)
                    first = heading and begins and bool(record.rstrip("\r"))
                    out.append((record, None, None, False, first) if begins else (record, *split, False, False))
                    kept, begins, heading = [], True, heading and not first
            yield _batch(out, names, types)
        if kept:
            yield _batch([("\n".join(kept), *split, begins, heading and begins)], names, types)

    return lines.mapInArrow(run, _PIECES)


def _stitch(pieces: DataFrame) -> DataFrame:
    """Records that cross borders, from their pieces: a new one begins at each piece that ``begins``."""
    numbered = ordered_window(pieces, ["start", "begins"], {"_record": running("sum", F.col("begins").cast("long"))}, keys=["path"])
    parts = F.array_sort(F.collect_list(F.struct("start", "begins", "record")))
    whole = numbered.groupBy("path", "_record").agg(parts.alias("_parts"), F.bool_or("first").alias("first"))
    return whole.select(F.array_join(F.col("_parts.record"), "\n").alias("record"), "first")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(record, first): the text of every record of the files at ``path``, and whether it is the first of its file.

    Lines end in ``\\n`` or ``\\r\\n``; those within values stay as they are, blank lines outside are left out. A value is quoted if it begins with a
    quote; quotes within it are doubled; one that never closes ends with the file, less its last line end. The broadcast side holds one row for each split that begins inside a value.
    """
    lines = _lines(spark, path)
    splits = materialize(_split_states(lines, sep), "splits")
    inside, any_inside = materialize_some(_begins_inside(splits), "inside")
    discard(splits)
    if not any_inside:
        records = _cut_records(lines.withColumn("inside", F.lit(False)), sep).select("record", "first")
    else:
        marked = lines.join(F.broadcast(inside.withColumn("_inside", F.lit(True))), ["path", "start"], "left")
        cut = _cut_records(marked.select("value", "path", "start", F.coalesce("_inside", F.lit(False)).alias("inside")), sep)
        pieces = materialize(cut.filter("path is not null"), "pieces")
        records = cut.filter("path is null").select("record", "first").unionByName(_stitch(pieces))
    return records.filter(F.rtrim("record", F.lit("\r")) != "")


def parse_records(records: DataFrame, schema: T.StructType, sep: str, header: bool) -> DataFrame:
    """Columns of ``schema`` from record texts; with ``header`` the first record of each file is left out."""
    kept = records.filter(~F.col("first")) if header else records
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    # the carriage return of the line end is no part of the last value
    record = F.regexp_replace("record", "\r\\z", "")
    return kept.select(F.from_csv(record, fields, {"sep": sep, "escape": '"', "multiLine": "true"}).alias("_r")).select("_r.*")
