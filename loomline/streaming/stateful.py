"""Order-dependent operators over logs: batch form and stream form of the same steps."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from loomline.plans.sequential import sequential_scan
from loomline.streaming import steps

OUTPUTS = {
    "state_transitions": "accepted boolean, state_before string, state_after string",
}


def run_steps(log: DataFrame, kind: str, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str],
              made: tuple, **kw) -> DataFrame:
    """Batch form: exact for keys of any size (see ``plans.sequential``)."""
    step, init = made
    return sequential_scan(log, keys, order, inputs, step, init, T.StructType.fromDDL(OUTPUTS[kind]), **kw)


def state_transition_audit(log, keys, order, status, allowed, initial, **kw) -> DataFrame:
    return run_steps(log, "state_transitions", keys, order, [status], steps.state_transitions(allowed, initial), **kw)


class StepProcessor(StatefulProcessor):
    """Runs a step per key on rows as they come; the state of the step is one JSON value per key.

    Rows of a key are put in order within each micro-batch, whose size the source
    bounds (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``).
    """

    def __init__(self, step, init, order: Sequence[str], inputs: Sequence[str], names: Sequence[str], added: Sequence[str]):
        self._step, self._init = step, init
        self._order, self._inputs, self._names, self._added = list(order), list(inputs), list(names), list(added)

    def init(self, handle) -> None:
        self._state = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._run([tuple(r[c] for c in self._names) for r in rows])

    def _run(self, rows: list[tuple]) -> Iterator[Row]:
        place, made = {c: i for i, c in enumerate(self._names)}, Row(*self._names, *self._added)
        # a missing value sorts first, as in Spark
        rows.sort(key=lambda r: [(r[place[c]] is not None, r[place[c]] if r[place[c]] is not None else 0) for c in self._order])
        stored = self._state.get()
        state = json.loads(stored[0]) if stored is not None else self._init
        for row in rows:
            state, values = self._step(state, tuple(row[place[c]] for c in self._inputs))
            yield made(*row, *values)
        self._state.update((json.dumps(state),))

    def close(self) -> None:
        pass


class DueRows:
    """Typed rows of a key by the millisecond they are due: a map state by (due, number), so a timer touches its own rows only."""

    def __init__(self, handle, schema: T.StructType):
        due, number = T.StructField("due", T.LongType()), T.StructField("n", T.LongType())
        self._handle = handle
        self._counts = handle.getMapState("counts", T.StructType([due]), T.StructType([number]))
        self._rows = handle.getMapState("rows", T.StructType([due, number]), schema)

    def add(self, rows: Iterator[tuple[int, tuple]]) -> None:
        counts: dict[int, int] = {}
        for due, row in rows:
            if due not in counts:
                counts[due] = self._counts.getValue((due,))[0] if self._counts.containsKey((due,)) else 0
                self._handle.registerTimer(due)
            self._rows.updateValue((due, counts[due]), row)
            counts[due] += 1
        for due, n in counts.items():
            self._counts.updateValue((due,), (n,))

    def take(self, due: int) -> list[tuple]:
        if not self._counts.containsKey((due,)):
            return []
        keys = [(due, i) for i in range(self._counts.getValue((due,))[0])]
        rows = [tuple(self._rows.getValue(k)) for k in keys]
        for k in keys:
            self._rows.removeKey(k)
        self._counts.removeKey((due,))
        return rows


class OrderedStepProcessor(StepProcessor):
    """As ``StepProcessor``, but each row waits until the watermark has passed its time, so late rows run in their place."""

    def __init__(self, step, init, order, inputs, schema: T.StructType, added):
        super().__init__(step, init, order, inputs, schema.names, added)
        self._schema = schema

    def init(self, handle) -> None:
        super().init(handle)
        self._due = DueRows(handle, self._schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._due.add((r[DUE], tuple(r[c] for c in self._names)) for r in rows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._run(self._due.take(expiredTimerInfo.getExpiryTimeInMs()))


DUE = "_due_ms"


def stream_steps(log: DataFrame, kind: str, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str],
                 made: tuple, ts: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Stream form; needs the RocksDB state store provider.

    With the event time ``ts``, on which ``order`` must begin, rows are taken in its order even if they come up to
    ``delay`` late in a later micro-batch, and come out when the watermark has passed them; rows later than that are
    dropped by Spark. Without it rows run in the order of their micro-batches. Values keep their types.
    """
    out = T.StructType.fromDDL(OUTPUTS[kind])
    made_rows = dict(outputStructType=T.StructType([*log.schema.fields, *out.fields]), outputMode="Append")
    if ts is None:
        processor = StepProcessor(made[0], made[1], order, inputs, log.columns, out.names)
        return log.groupBy(*keys).transformWithState(statefulProcessor=processor, timeMode="None", **made_rows)
    processor = OrderedStepProcessor(made[0], made[1], order, inputs, log.schema, out.names)
    timed = log.withWatermark(ts, delay).withColumn(DUE, F.unix_millis(ts) + 1)
    return timed.groupBy(*keys).transformWithState(statefulProcessor=processor, timeMode="EventTime", **made_rows)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unit_quota_by_day(log: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], limit: int) -> DataFrame:
    """Quota of one unit per row and calendar day, without state: the first ``limit`` rows of a day pass."""
    from loomline.plans.ordered import ordered_window, row_number
    numbered = ordered_window(log, order, {"_rn": row_number()}, keys=[*keys, day])
    return numbered.withColumn("admitted", F.col("_rn") <= limit).withColumn(
        "remaining", F.greatest(F.lit(limit) - F.col("_rn"), F.lit(0))).drop("_rn")


class DelayProcessor(StatefulProcessor):
    """Keeps the items of a key and releases each when event time passes its release time."""

    def __init__(self, schema: T.StructType, release_us: str):
        self._schema, self._release = schema, schema.names.index(release_us)

    def init(self, handle) -> None:
        self._due = DueRows(handle, self._schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._due.add((r[DUE], tuple(r[c] for c in self._schema.names)) for r in rows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ready, made = self._due.take(expiredTimerInfo.getExpiryTimeInMs()), Row(*self._schema.names)
        for row in sorted(ready, key=lambda r: r[self._release]):
            yield made(*row)

    def close(self) -> None:
        pass


def stream_delayed_release(items: DataFrame, keys: Sequence[str], ts: str, release_us: str, delay: str = "0 seconds") -> DataFrame:
    """Stream form of ``flow.delayed_release``: the rows of a key come out in order of their release time.

    ``items`` has the event time ``ts`` and ``release_us`` (epoch microseconds; items without one are never released and
    not kept). A timer touches only the items due in its millisecond. Needs the RocksDB state store provider.
    """
    kept = items.select(*[c for c in items.columns if c != ts]).schema
    due = F.expr(f"`{release_us}` div 1000") + 1
    timed = items.withWatermark(ts, delay).filter(F.col(release_us).isNotNull()).withColumn(DUE, due)
    return timed.groupBy(*keys).transformWithState(
        statefulProcessor=DelayProcessor(kept, release_us), outputStructType=kept, outputMode="Append", timeMode="EventTime")
