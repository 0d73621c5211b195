"""Micro-batch jobs over file streams: epoch flushes, windows, latest states."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.clock import wall_micros
from palimpsest.schema import ATOMS
from palimpsest.session import ensure_checkpoint_dir
from palimpsest.sources.epoch_files import read_epochs
from palimpsest.sources.tables import table


#: The files of the test table are in no order of time, so a row may be as late as the table is long.
UNORDERED = "400 days"


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, root: str, name: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A file stream over the Parquet table ``name``, whether it is one file or a folder of parts."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def flush_epochs(stream: DataFrame, path: str, state: str):
    """Write every micro-batch into the epoch store; a batch that is run again replaces its own files only.

    One directory per epoch and batch: ``epoch_id=.../`` holds files of several
    batches, told apart by the batch column, so that a repeated batch is
    overwritten and not doubled.
    """

    def flush(batch: DataFrame, number: int) -> None:
        target = batch.withColumn("batch", F.lit(number))
        target.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch", "epoch_id").parquet(path)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", state).trigger(availableNow=True).start()


def flush_available(spark: SparkSession, root: str) -> DataFrame:
    folder = work_folder(spark)
    flush_epochs(stream_of(spark, root, "atoms", ATOMS), f"{folder}/store", f"{folder}/state").awaitTermination()
    return read_epochs(spark, f"{folder}/store")


def _settled(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run what is available through an updating aggregate; the last state of every key stands."""
    folder = work_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/_n={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{folder}/out/*")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])


def windowed(events: DataFrame, late: str, length: str = "1 day") -> DataFrame:
    """``day_us, event_type, events, value``: tumbling event-time windows of a stream.

    Rows more than ``late`` behind the newest row of earlier batches are dropped;
    a window's state is freed once no row can come for it any more.
    """
    return (
        events.withColumn("ts", F.timestamp_micros(wall_micros("ts"))).withWatermark("ts", late)
        .groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
        .select(F.unix_micros("w.start").alias("day_us"), "event_type", "events", "value")
    )


def windowed_available(spark: SparkSession, root: str, late: str = UNORDERED) -> DataFrame:
    """:func:`windowed` over everything that the ``events`` table holds now."""
    events = stream_of(spark, root, "events", table(spark, root, "events").schema)
    return _settled(spark, windowed(events, late), "update", ["day_us", "event_type"])


def latest_available(spark: SparkSession, root: str) -> DataFrame:
    """``user_id, event_type, event_id``: the newest event of each user and type."""
    events = stream_of(spark, root, "events", table(spark, root, "events").schema)
    newest = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    return _settled(spark, newest, "update", ["user_id", "event_type"])
