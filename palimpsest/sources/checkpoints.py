"""Agent checkpoints and pending writes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.schema import CHECKPOINT_WRITES, CHECKPOINTS


def envelope(value: Column) -> Column:
    """(type, bytes) as (type, base64 text), for JSON."""
    return F.struct(value["type"].alias("type"), F.base64(value["data"]).alias("data"))


def opened(value: Column) -> Column:
    """The reverse of :func:`envelope`."""
    return F.struct(value["type"].alias("type"), F.unbase64(value["data"]).alias("data"))


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last put of every key: appended rows are upserts by ``version``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])


def latest(rows: DataFrame) -> DataFrame:
    """The checkpoint with the greatest id of every thread; a map-side maximum, so long threads cost one state a task."""
    now = current(rows, ["thread_id", "checkpoint_id"])
    others = [c for c in now.columns if c != "thread_id"]
    return now.groupBy("thread_id").agg(F.max_by(F.struct(*others), "checkpoint_id").alias("_v")).select("thread_id", *[F.col(f"_v.{c}").alias(c) for c in others])


def newest(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Checkpoints with their ``position`` in the thread, ids in descending order; no limit, or 0, keeps all."""
    order = Window.partitionBy("thread_id").orderBy(F.col("checkpoint_id").desc())
    out = current(rows, ["thread_id", "checkpoint_id"]).withColumn("position", F.row_number().over(order))
    return out.where(F.col("position") <= limit) if limit else out


def write_rows(rows: DataFrame) -> DataFrame:
    """Lists of (channel, value) as one row per write, ``idx`` in list order."""
    keys = ["thread_id", "checkpoint_id", "task_id"]
    return rows.select(*keys, "version", F.posexplode("writes").alias("idx", "_w")).select(*keys, "idx", F.col("_w.channel").alias("channel"), F.col("_w.value").alias("value"), "version")


def read_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """The checkpoint table of a store; empty where nothing was put yet."""
    return _read(spark, f"{folder}/checkpoints", CHECKPOINTS)


def read_writes(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/writes", CHECKPOINT_WRITES)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_json_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Old JSON checkpoint files; what cannot be parsed is kept in ``_corrupt_record``. Pickles are never loaded."""
    shape = "checkpoint struct<type:string,data:string>, metadata string, parent_config string, timestamp string, _corrupt_record string"
    rows = spark.read.schema(shape).option("mode", "PERMISSIVE").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("checkpoint", F.when(F.col("checkpoint").isNotNull(), opened(F.col("checkpoint"))))
