"""Packing of token pieces into fixed windows by minimum bin slack.

A document is cut into whole windows and a rest. How many rests have which length is a table of at most
``capacity`` rows, whatever the corpus; the plan is made from it on the driver. Each step takes the longest
length left, finds by a bitset subset-sum over the other lengths (each as often as it is left) the sum
that fills the window closest to its capacity, backtracks how often each length is in it, and repeats the
pattern as long as the counts last. A step uses a length up or nearly so, so there are few patterns. The
n-th piece of a length then finds its pattern, repetition and place by arithmetic.

Defined cases: a null text is an empty one and gives one piece with the end id alone; equal rows are packed
each; rows with a null id are packed like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.ranks import spread_rank
from loomline.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
BATCH_BYTES = 8 << 20


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens): windows of ``capacity`` ids and the rest; ``ids`` as little-endian uint32."""
    path = tokenizer or default_tokenizer()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        encode = encoder(path)
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at: 4 * (at + capacity)]
                    rows.append((doc.as_py(), at, len(piece) // 4, piece, n))
                    held += len(piece)
                    if held > BATCH_BYTES or len(rows) >= 5000:
                        yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)

    return picked.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")


def slack_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(length -> how often, repetitions)]; every piece is in exactly one pattern."""
    left = {length: n for length, n in counts.items() if n > 0}
    patterns = []
    while left:
        longest = max(left)
        room = capacity - longest
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for length in sorted((x for x in left if x <= room), reverse=True):
            spare = min(left[length] - (length == longest), room // length)
            times = 1
            while spare > 0 and not reach >> room & 1:
                now = min(times, spare)
                steps.append((length, now, reach))
                reach |= reach << (now * length) & mask
                spare -= now
                times *= 2
            if reach >> room & 1:
                break
        at, taken = reach.bit_length() - 1, {longest: 1}
        for length, now, before in reversed(steps):
            if not before >> at & 1:
                at -= now * length
                taken[length] = taken.get(length, 0) + now
        again = min(left[length] // n for length, n in taken.items())
        patterns.append((taken, again))
        for length, n in taken.items():
            left[length] -= n * again
            if not left[length]:
                del left[length]
    return patterns


def _places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after, times in a window, first window, offset) of every pattern's every length."""
    rows, used, window = [], {}, 0
    for taken, again in patterns:
        offset = 0
        for length, n in taken.items():
            first = used.get(length, 0)
            used[length] = first + n * again
            rows.append((length, first, used[length], n, window, offset))
            offset += n * length
        window += again
    return rows


def pack(pieces: DataFrame, length_col: str = "length", salt: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The same rows with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``.

    Only the table of counts by length (at most ``capacity`` rows) comes to the driver; the table of places,
    of a few rows for each pattern, is broadcast.
    """
    spark = pieces.sparkSession
    salt = salt or [c for c, kind in pieces.dtypes if kind in ("bigint", "int", "string")]
    ranked = spread_rank(pieces, [length_col], salt, salt, "_rank")
    counts = {r[0]: r[1] for r in ranked.groupBy(length_col).count().collect()}
    places = _places(slack_patterns(counts, capacity))
    table = F.broadcast(spark.createDataFrame(places, "_len long, _from long, _to long, _times long, _window long, _at long"))
    on = (F.col(length_col) == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    here = F.col("_rank") - F.col("_from")
    return ranked.join(table, on).select(
        *pieces.columns, (F.col("_window") + F.expr("(_rank - _from) div _times")).alias("sequence_id"),
        (F.col("_at") + F.pmod(here, F.col("_times")) * F.col(length_col)).alias("offset"))


def padding(total: int, capacity: int = CAPACITY) -> int:
    """Padding of a sequence: none at a power of two, else up to ``capacity``."""
    return 0 if total > 0 and math.log2(total).is_integer() else capacity - total
