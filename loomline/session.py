"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}
_given_paths: list[str] = []


def build_session(app_name: str = "loomline", master: str | None = None, **conf) -> SparkSession:
    """A session with AQE, UTC and Arrow; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. A machine-local
    folder is used only when that is unset and the master is local.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="loomline-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str = "t") -> str:
    """A fresh path below the scratch root."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _given_paths.append(path)
    return path


def materialize(df: DataFrame, label: str = "t", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch area and return a scan of it.

    The scan survives lost executors, carries exact size statistics (so Spark
    can choose a broadcast by size) and has no lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, files = _filesystem(spark, path)
    return files.exists(hadoop_path)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop_path, files = _filesystem(spark, path)
    return files.exists(hadoop_path) and files.getFileStatus(hadoop_path).isDirectory()


def read_written(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet folder that a stream wrote; no rows when it had nothing to write."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path is not None:
            hadoop_path, files = _filesystem(table.sparkSession, path)
            files.delete(hadoop_path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch path handed out so far; results that read them are gone then."""
    while _given_paths:
        hadoop_path, files = _filesystem(spark, _given_paths.pop())
        files.delete(hadoop_path, True)


def materialize_some(df: DataFrame, label: str = "t", when: Column | None = None, partition_by: str | None = None
                     ) -> tuple[DataFrame, bool]:
    """``materialize``, and whether any row was written (for which ``when`` holds).

    The test rides on the write itself, so a loop needs one job per round.
    """
    seen = Observation()
    count = F.count(F.lit(1)) if when is None else F.count_if(when)
    written = materialize(df.observe(seen, count.alias("n")), label, partition_by)
    return written, seen.get["n"] > 0


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
