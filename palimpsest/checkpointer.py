"""Checkpoints of agents, kept as append-only tables with upserts by version."""

from __future__ import annotations

import asyncio
import json
import time
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import CHECKPOINT_WRITES, CHECKPOINTS
from palimpsest.sources import checkpoints


class JsonSerde:
    """Values as JSON bytes; any object with the same two methods may stand in."""

    def dumps_typed(self, value: Any) -> tuple[str, bytes]:
        return "json", json.dumps(value).encode()

    def loads_typed(self, typed: tuple[str, bytes]) -> Any:
        return json.loads(typed[1].decode())


class StoredCheckpoint(NamedTuple):
    config: dict
    checkpoint: Any
    metadata: Any
    parent_config: dict | None


class AgentCheckpointer:
    """put, get_tuple, list and put_writes, and their async forms."""

    def __init__(self, spark: SparkSession, folder: str, serde: Any = None):
        self.spark, self.folder, self.serde = spark, folder, serde or JsonSerde()
        self._last = 0

    def _version(self) -> int:
        self._last = max(time.time_ns() // 1000, self._last + 1)
        return self._last

    def put(self, config: dict, checkpoint: dict, metadata: Any, new_versions: dict | None = None) -> dict:
        thread = config["configurable"]["thread_id"]
        kind, data = self.serde.dumps_typed(checkpoint)
        v = self._version()
        parent = config.get("parent_config")
        row = (thread, checkpoint["id"], (kind, bytearray(data)), json.dumps(metadata), json.dumps(parent) if parent is not None else None, None, v)
        rows = self.spark.createDataFrame([row], CHECKPOINTS).withColumn("timestamp", F.timestamp_micros("version"))
        rows.coalesce(1).write.mode("append").partitionBy("thread_id").parquet(f"{self.folder}/checkpoints")
        return {"configurable": {"thread_id": thread, "checkpoint_id": checkpoint["id"]}}

    def _of(self, thread: str):
        return checkpoints.read_checkpoints(self.spark, self.folder).where(F.col("thread_id") == thread)

    def _open(self, config: dict, row: Any) -> StoredCheckpoint:
        value = self.serde.loads_typed((row["checkpoint"]["type"], bytes(row["checkpoint"]["data"])))
        return StoredCheckpoint(config, value, json.loads(row["metadata"]), json.loads(row["parent_config"]) if row["parent_config"] else None)

    def get_tuple(self, config: dict) -> StoredCheckpoint | None:
        """The named checkpoint, or the thread's latest; None if there is none. The given config is echoed."""
        named = config["configurable"]
        if not named.get("thread_id"):
            return None
        rows = self._of(named["thread_id"])
        if named.get("checkpoint_id"):
            rows = rows.where(F.col("checkpoint_id") == named["checkpoint_id"])
        row = checkpoints.latest(rows).first()
        return self._open(config, row) if row else None

    def list(self, config: dict, *, before: dict | None = None, limit: int | None = None) -> Iterator[StoredCheckpoint]:
        """A thread's checkpoints, ids descending; ``before`` is accepted and has no effect, limit 0 means all."""
        thread = config["configurable"].get("thread_id")
        if not thread:
            return
        for row in checkpoints.newest(self._of(thread), limit).orderBy("position").toLocalIterator():
            yield self._open({"configurable": {"thread_id": thread, "checkpoint_id": row["checkpoint_id"]}}, row)

    def put_writes(self, config: dict, writes: list[tuple[str, Any]], task_id: str, task_path: str = "") -> None:
        named, v = config["configurable"], self._version()
        rows = [(named["thread_id"], named["checkpoint_id"], task_id, i, channel, (k, bytearray(d)), v) for i, (channel, (k, d)) in enumerate((c, self.serde.dumps_typed(x)) for c, x in writes)]
        if rows:
            self.spark.createDataFrame(rows, CHECKPOINT_WRITES).coalesce(1).write.mode("append").partitionBy("thread_id").parquet(f"{self.folder}/writes")

    def writes(self, config: dict) -> list[tuple[str, int, str, Any]]:
        """Pending writes of a checkpoint: (task, idx, channel, value); a task's last put stands as a whole."""
        named = config["configurable"]
        rows = checkpoints.read_writes(self.spark, self.folder).where((F.col("thread_id") == named["thread_id"]) & (F.col("checkpoint_id") == named["checkpoint_id"]))
        last = rows.groupBy("task_id").agg(F.max("version").alias("version"))
        return [(r["task_id"], r["idx"], r["channel"], self.serde.loads_typed((r["value"]["type"], bytes(r["value"]["data"])))) for r in rows.join(last, ["task_id", "version"]).orderBy("task_id", "idx").collect()]

    async def aput(self, *args: Any, **kw: Any) -> dict:
        return await asyncio.to_thread(self.put, *args, **kw)

    async def aget_tuple(self, config: dict) -> StoredCheckpoint | None:
        return await asyncio.to_thread(self.get_tuple, config)

    async def aput_writes(self, *args: Any, **kw: Any) -> None:
        await asyncio.to_thread(self.put_writes, *args, **kw)

    async def alist(self, config: dict, **kw: Any):
        for found in await asyncio.to_thread(lambda: [*self.list(config, **kw)]):
            yield found
