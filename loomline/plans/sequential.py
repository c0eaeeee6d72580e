"""Order-dependent per-key steps (state machines and the like) in parallel.

Each decision depends on the ones before it, so a key is cut into chunks of
``chunk_rows`` rows. All chunks start from a guess of their entry state; each
round hands every chunk the exit state of its predecessor and re-runs only the
chunks whose entry state changed. When nothing changes the entry states are
exact, and the outputs are emitted in one last pass. No task ever holds more
than one chunk of a key in sequence, whatever the size of the key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomline.plans.ordered import ordered_window, row_number
from loomline.session import discard, materialize

CHUNK_ROWS = 200_000
# step(state, row) -> (new state, output values); state is JSON-serialisable.
Step = Callable[[object, tuple], tuple[object, tuple]]


def _runner(step: Step, init, keys, inputs, passed, schema: T.StructType, emit):
    arrow = to_arrow_schema(schema)

    def made(rows):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, entered = None, None, None
        for batch in batches:
            values_of = lambda names: list(zip(*[batch.column(n).to_pylist() for n in names]))  # noqa: E731, B023
            outputs, exits = [], []
            for group, row, start in zip(values_of([*keys, "_chunk"]), values_of(inputs), batch.column("_entry").to_pylist()):
                if group != current:
                    if current is not None and not emit:
                        exits.append((*current, entered, json.dumps(state)))
                    current, entered = group, start
                    state = json.loads(entered) if entered is not None else json.loads(json.dumps(init))
                state, values = step(state, row)
                if emit:
                    outputs.append(values)
            if emit and outputs:
                added = [pa.array(c, f.type) for c, f in zip(zip(*outputs), list(arrow)[len(passed):])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *added], names=arrow.names)
            elif exits:
                yield made(exits)
        if current is not None and not emit:
            yield made([(*current, entered, json.dumps(state))])

    return run


def sequential_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    step: Step,
    init: object,
    outputs: T.StructType,
    chunk_rows: int = CHUNK_ROWS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Run ``step`` over the ordered rows of each key and append its outputs.

    Keys must not be NULL. The result is exact for any state machine; the number
    of rounds is how long a wrong entry state takes to be forgotten.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("give at least one key column")
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    numbered = ordered_window(df, order, {"_rn": row_number()}, keys=keys, **extra)
    numbered = numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk_rows).cast("bigint"))

    def arranged(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_rn")

    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    schema_out = T.StructType([*df.schema.fields, *outputs.fields])
    emit = _runner(step, init, keys, list(inputs), df.columns, schema_out, True)
    if largest <= chunk_rows:
        ready = numbered.withColumn("_entry", F.lit(None).cast("string"))
        return arranged(ready).mapInArrow(emit, schema_out)

    numbered = materialize(numbered, "numbered")
    state_schema = T.StructType([
        *[f for f in df.select(*keys).schema.fields],
        T.StructField("_chunk", T.LongType()), T.StructField("_entry", T.StringType()),
        T.StructField("_exit", T.StringType())])
    exits_of = _runner(step, init, keys, list(inputs), df.columns, state_schema, False)
    split_keys = numbered.filter("_chunk = 1").select(*keys).distinct()
    split = materialize(numbered.join(split_keys, keys, "left_semi").select(
        *keys, "_chunk", "_rn", *[c for c in inputs if c not in keys]), "split")
    states = materialize(arranged(split.withColumn("_entry", F.lit(None).cast("string")))
                         .mapInArrow(exits_of, state_schema), "states")
    previous = F.lag("_exit").over(Window.partitionBy(*keys).orderBy("_chunk"))
    while True:
        wanted = states.withColumn("_wanted", previous)
        stale = wanted.filter(~F.col("_wanted").eqNullSafe(F.col("_entry")))
        if stale.isEmpty():
            break
        redo = stale.select(*keys, "_chunk", F.col("_wanted").alias("_entry"))
        again = arranged(split.join(redo, [*keys, "_chunk"])).mapInArrow(exits_of, state_schema)
        keep = wanted.filter(F.col("_wanted").eqNullSafe(F.col("_entry"))).drop("_wanted")
        before, states = states, materialize(keep.unionByName(again), "states")
        discard(before)
    entries = states.select(*keys, "_chunk", "_entry")
    ready = numbered.join(entries, [*keys, "_chunk"], "left")
    return arranged(ready).mapInArrow(emit, schema_out)
