"""The epoch-partitioned Parquet store, and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import ATOMS


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_epochs(atoms: DataFrame, path: str, mode: str = "append") -> None:
    """Append atoms, one directory per epoch, ZSTD; nothing is written for no rows."""
    atoms.write.mode(mode).partitionBy("epoch_id").option("compression", "zstd").parquet(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """All atoms of a store; a filter on ``epoch_id`` prunes directories. An absent store is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], ATOMS)
    return spark.read.schema(ATOMS).parquet(path)


def read_epoch(spark: SparkSession, path: str, epoch_id: str) -> DataFrame:
    return read_epochs(spark, path).where(F.col("epoch_id") == epoch_id)


def lookup(spark: SparkSession, path: str, ids: list[str], epoch_id: str | None = None) -> DataFrame:
    """Atoms with the given ids; the id filter is pushed to the scan, the epoch filter prunes directories."""
    rows = read_epochs(spark, path) if epoch_id is None else read_epoch(spark, path, epoch_id)
    return rows.where(F.col("id").isin(list(ids)))


def catalog(spark: SparkSession, path: str) -> list[str]:
    """Epoch ids, in order."""
    return [r["epoch_id"] for r in read_epochs(spark, path).select("epoch_id").distinct().orderBy("epoch_id").collect()]


def decode_legacy(rows: DataFrame) -> DataFrame:
    """Atoms from old rows: triples as a JSON list of lists, created_at in seconds, optional INT8 vectors with ``embedding_max``."""
    listed = F.from_json("triples", "array<array<string>>")
    triples = F.coalesce(F.transform(listed, lambda t: F.struct(t[0].alias("subj"), t[1].alias("pred"), t[2].alias("obj"))), F.array().cast("array<struct<subj:string,pred:string,obj:string>>"))
    vec = F.col("embedding")
    if "embedding_max" in rows.columns:
        vec = F.transform("embedding", lambda x: x.cast("double") / F.lit(127.0) * F.col("embedding_max"))
    return rows.select("id", "payload", vec.cast("array<float>").alias("embedding"), triples.alias("triples"), F.timestamp_micros((F.col("created_at") * 1_000_000).cast("long")).alias("created_at"), F.col("access_count").cast("long").alias("access_count"), "epoch_id")


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """``lsn, op, data`` of JSON-lines logs; blank and torn lines are skipped."""
    shape = "lsn long, op string, data string"
    if not exists(spark, path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).option("mode", "DROPMALFORMED").json(path).where(F.col("op").isNotNull())
