"""Session construction, shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast explicitly only below this many serialised bytes.
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "palimpsest", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster pass your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make a private one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files, so that lost executors lose nothing.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when nothing refers to them any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_bytes(df: DataFrame) -> int:
    """Serialised size of a (materialised, small) frame; computed by the executors, one number comes back."""
    cols = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns]
    total: Column = sum(cols[1:], cols[0]).cast("long")
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()["b"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the measured size is below ``limit``; beyond it the plan keeps its shuffle join.

    ``df`` should already be materialised (see :func:`cut`), because it is measured first.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for explicit range partitioning: the session's own shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cpus_from_env(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="palimpsest-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._palimpsest_shipped = True
