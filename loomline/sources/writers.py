"""Writers. Each writes one folder of part files, in parallel."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import materialize


def write_json_records(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_csv_records(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> bool:
    """Columns in table order; an empty table writes nothing and gives False."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("escape", '"').csv(path, sep=sep, header=header)
    return True


def write_xml_records(df: DataFrame, path: str, root: str = "root", item: str = "item") -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", item).save(path)


def report_line(df: DataFrame, sep: str = "\n") -> Column:
    """``key: value`` pairs of a row joined by ``sep``; a NULL value shows as None."""
    pairs = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in df.columns]
    return F.concat_ws(sep, *pairs)


def write_text_report(df: DataFrame, path: str, sep: str = ", ") -> None:
    df.select(report_line(df, sep).alias("value")).write.mode("overwrite").text(path)


def fan_out_write(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame], object]]) -> dict[str, bool]:
    """The same rows to every sink; the table is computed once, a failing sink does not stop the others."""
    rows = materialize(df, "fanout")
    done = {}
    for name, sink in sinks.items():
        try:
            sink(rows)
            done[name] = True
        except Exception:  # noqa: BLE001 - reported per target
            done[name] = False
    return done


def fan_out_batch(targets: Mapping[str, str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes a micro-batch to several folders, idempotent by batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for path in targets.values():
                batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def metric_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide metric rows to (keys, name, value); only numeric columns count."""
    names = [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, _NUMBERS)]
    doubles = df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot(keys, names, "name", "value")


def _spelt(c: Column, chars: str) -> Column:
    """A backslash before each of the characters that mean something to the line form."""
    return F.regexp_replace(c, f"([{chars}])", "\\\\$1")


def line_protocol(measurement: Column, tags: dict[str, Column], at_ns: Column | None = None) -> Column:
    """``measurement,tag=x name=value time`` text of a metric row; NULL and empty tags are left out."""
    marked = [F.when(value.cast("string") != "", F.concat(F.lit(f",{name}="), _spelt(value.cast("string"), ",= "))) for name, value in sorted(tags.items())]
    head = F.concat(_spelt(measurement, ", "), *[F.coalesce(m, F.lit("")) for m in marked])
    body = F.concat(_spelt(F.col("name"), ",= "), F.lit("="), F.col("value").cast("string"))
    return F.concat_ws(" ", head, body, *([] if at_ns is None else [at_ns.cast("string")]))


def statsd_line(prefix: str = "pipeline.", kind: str = "g") -> Column:
    """``prefixname:value|kind`` text of a metric row (g: gauge, c: counter, ms: time)."""
    return F.concat(F.lit(prefix), F.regexp_replace("name", "[:|@]", "_"), F.lit(":"), F.col("value").cast("string"), F.lit(f"|{kind}"))


def exposition_line(prefix: str = "pipeline_") -> Column:
    """``prefixname value`` text of a metric row."""
    return F.concat(F.lit(prefix), F.replace("name", F.lit("-"), F.lit("_")), F.lit(" "), F.col("value").cast("string"))
