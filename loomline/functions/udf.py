"""Python callables over columns and tables, always in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from loomline.plans.ordered import with_position


def scalar_function(func: Callable[[object], object], result: str, on_error=None) -> Callable[..., Column]:
    """Column function from a Python callable; a value that raises gives ``on_error``."""

    kind = T.StructType.fromDDL(f"v {result}").fields[0].dataType

    @F.arrow_udf(result)
    def apply(values: pa.Array) -> pa.Array:
        def one(value):
            try:
                return func(value)
            except Exception:  # noqa: BLE001 - one bad value must not fail the task
                return on_error
        return pa.array([one(v) for v in values.to_pylist()], to_arrow_type(kind))

    return apply


def predicate(func: Callable[[object], bool]) -> Callable[..., Column]:
    """Boolean column function; a value that raises counts as False."""
    return scalar_function(lambda v: bool(func(v)), "boolean", False)


def table_function(df: DataFrame, func: Callable[[dict], Sequence[tuple]], schema: T.StructType | str,
                   keep: Sequence[str] = ()) -> DataFrame:
    """One row to many: ``func`` gives tuples of ``schema``; ``keep`` columns go along."""
    keep = list(keep)
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([*[df.schema[c] for c in keep], *added.fields])

    def run(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            rows = []
            for record in batch.to_pylist():
                head = tuple(record[c] for c in keep)
                rows.extend(head + tuple(t) for t in func(record))
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def aggregate_function(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.DataFrame], tuple],
                       merge: Callable[[tuple, tuple], tuple], state: T.StructType | str,
                       finish: Callable[[tuple], tuple] | None = None,
                       result: T.StructType | str | None = None) -> DataFrame:
    """Python aggregate per key in two steps, so that a hot key never meets in one task.

    ``partial`` folds the rows of one key inside an Arrow batch into a state tuple
    before the shuffle; ``merge`` joins two states; ``finish`` makes the result.
    Only one state per (batch, key) is shuffled, and a task merges the states of a
    key batch by batch.
    """
    keys = list(keys)
    part = T.StructType.fromDDL(state) if isinstance(state, str) else state
    final = part if result is None else (T.StructType.fromDDL(result) if isinstance(result, str) else result)
    key_fields = [df.schema[k] for k in keys]
    states_arrow = to_arrow_schema(T.StructType([*key_fields, *part.fields]))

    def fold(batches):
        for batch in batches:
            pdf = batch.to_pandas(types_mapper=pd.ArrowDtype)  # NULL and large integers stay as they are
            rows = [(*(k if isinstance(k, tuple) else (k,)), *partial(g)) for k, g in pdf.groupby(keys, dropna=False)]
            rows = [tuple(None if v is pd.NA else v for v in row) for row in rows]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), states_arrow)], schema=states_arrow)

    final_arrow = to_arrow_schema(T.StructType([*key_fields, *final.fields]))

    def combine(key, batches):
        total = None
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in part.names]):
                total = row if total is None else merge(total, row)
        result = (*[k.as_py() for k in key], *(finish(total) if finish else total))
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(result, final_arrow)], schema=final_arrow)

    from collections.abc import Iterator as _It
    combine.__annotations__ = {"key": tuple, "batches": _It[pa.RecordBatch], "return": _It[pa.RecordBatch]}
    states = df.mapInArrow(fold, T.StructType([*key_fields, *part.fields]))
    return states.groupBy(*keys).applyInArrow(combine, T.StructType([*key_fields, *final.fields]))


def chunked_batches(df: DataFrame, order: Sequence[str], func: Callable[[pd.DataFrame], pd.DataFrame],
                    schema: T.StructType | str, position: str = "pos") -> DataFrame:
    """Apply ``func`` to chunks of rows in parallel; ``position`` keeps the input order.

    ``func`` must pass the position column on. Chunks are Arrow batches
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows).
    """
    placed = with_position(df, order, position)

    def run(batches):
        for pdf in batches:
            yield func(pdf)

    return placed.mapInPandas(run, schema)
