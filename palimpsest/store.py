"""A store of memories over Parquet tables: ingest, flush, recall.

The store is a folder on any Hadoop file system::

    metadata.json  dimension and creation time
    wal/           JSON-lines files, several for one call
    atoms/         Parquet by epoch_id, ``active`` until it is flushed
    index/         the entity index, one row per entity and atom, by epoch_id
    vectors/       an index of the closed epochs' vectors, once it was built
    deltas/        access counts since the atoms were written
    lock           host and pid of the single writer

Additions are durable once the call returns: they are appended to the active
epoch before the log gets its COMMIT, and whatever the log holds beyond that is
recovered on opening. An addition whose write fails gets a ROLLBACK, and is not.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.vector import normalized
from palimpsest.operators import ann, entities, kg, lifecycle, recall, vectors
from palimpsest.schema import ACCESS_DELTAS, ACTIVE_EPOCH, ATOMS, ENTITY_INDEX
from palimpsest.session import cut, ensure_checkpoint_dir, ship
from palimpsest.sources import epoch_files
from palimpsest.sources.folder import Folder


class WriterLock:
    """One writer at a time: a file with the writer's host and pid; the lock of a dead process of this host is taken over."""

    def __init__(self, folder: Folder, name: str = "lock"):
        self.folder, self.name = folder, name
        self.mine = f"{socket.gethostname()}:{os.getpid()}"
        self.held = False

    def acquire(self) -> None:
        for _ in range(3):
            if self.folder.write(self.name, self.mine, new=True):
                self.held = True
                return
            host, _, pid = (self.folder.read(self.name) or "").partition(":")
            if pid.isdigit() and (host != socket.gethostname() or _alive(int(pid))):
                raise RuntimeError(f"the store is open in process {pid} of {host}")
            self.folder.remove(self.name)
        raise RuntimeError("the store's lock cannot be taken")

    def release(self) -> None:
        if self.held and self.folder.read(self.name) == self.mine:
            self.folder.remove(self.name)
        self.held = False


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class MemoryStore:
    """Memories on disk. ``embed`` turns a list of texts into vectors, for :meth:`remember` and :meth:`recall_text`."""

    def __init__(self, spark: SparkSession, folder: str, dim: int = 384, epoch_seconds: int = 3600, embed: Callable[[list[str]], Iterable[Iterable[float]]] | None = None):
        self.spark, self.folder, self.dim, self.epoch_seconds, self.embed = spark, Folder(spark, str(folder)), dim, epoch_seconds, embed
        ship(spark)
        ensure_checkpoint_dir(spark)
        self.folder.make()
        self._check_dim()
        self.lock = WriterLock(self.folder)
        self.lock.acquire()
        self._last_us = 0
        self._epoch_began = time.time()
        self._recover()

    # -- opening and closing

    def _check_dim(self) -> None:
        meta = self.folder.read("metadata.json")
        if meta is None:
            self.folder.write("metadata.json", json.dumps({"dim": self.dim, "created_at": time.time()}))
        elif json.loads(meta)["dim"] != self.dim:
            raise ValueError(f"the store has vectors of {json.loads(meta)['dim']} values, not {self.dim}")

    def _recover(self) -> None:
        """Bring back additions that the log holds and the active epoch, or the index, does not."""
        wal = epoch_files.read_wal(self.spark, self._path("wal"))
        lost = lifecycle.wal_recoverable(wal).select(F.from_json("data", ATOMS).alias("a")).select("a.*")
        stored = self.atoms().select("id")
        missing = lost.dropDuplicates(["id"]).join(stored, "id", "left_anti")
        rows = missing.select(*ATOMS.fieldNames())
        if not rows.isEmpty():
            epoch_files.write_epochs(rows, self._path("atoms"))
        if not lost.isEmpty():
            epoch_files.write_epochs(kg.entity_index(lost), self._path("index"))  # rows that are there already count once
        self._clear_wal()

    def close(self) -> None:
        self.lock.release()

    def __enter__(self) -> MemoryStore:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    # -- tables

    def _path(self, name: str) -> str:
        return self.folder.path(name)

    def atoms(self) -> DataFrame:
        return epoch_files.read_epochs(self.spark, self._path("atoms"))

    def index(self) -> DataFrame:
        """The stored entity index, one row per entity and atom."""
        if not self.folder.exists("index"):
            return kg.entity_index(self.atoms())
        return kg.usable_index(self.spark.read.schema(ENTITY_INDEX).parquet(self._path("index")))

    def rebuild_index(self) -> None:
        """Derive the entity index anew from the triples of all atoms."""
        fresh = cut(kg.entity_index(self.atoms()))
        self.folder.remove("index")
        epoch_files.write_epochs(fresh, self._path("index"))

    def build_vector_index(self, recall_wanted: float = 0.95) -> None:
        """Index the vectors of all closed epochs; :func:`palimpsest.operators.ann.search` reads it."""
        ann.build_index(self.atoms().where(F.col("epoch_id") != ACTIVE_EPOCH), self._path("vectors"), self.dim, recall=recall_wanted)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """``query_id, atom_id, epoch_id, sim, epoch_rank``: the active epoch exactly, closed epochs by their index if it was built."""
        if not self.folder.exists("vectors"):
            return vectors.topk_per_epoch(self.atoms(), queries)
        closed = ann.search(self.spark, self._path("vectors"), queries)
        return closed.unionByName(vectors.topk_per_epoch(self.atoms().where(F.col("epoch_id") == ACTIVE_EPOCH), queries))

    def deltas(self) -> DataFrame:
        if not epoch_files.exists(self.spark, self._path("deltas")):
            return self.spark.createDataFrame([], ACCESS_DELTAS)
        return self.spark.read.schema(ACCESS_DELTAS).parquet(self._path("deltas"))

    # -- writing

    def _next_us(self) -> int:
        self._last_us = max(int(time.time() * 1_000_000), self._last_us + 1)
        return self._last_us

    def add_memory(self, payload: Any, embedding: Iterable[float], triples: Iterable[tuple] | None = None) -> str:
        return self.add_memory_batch([{"payload": payload, "embedding": embedding, "triples": triples}])[0]

    def add_memory_batch(self, items: list[dict]) -> list[str]:
        """Add memories in one commit; ids in the order given. A vector of another dimension is refused."""
        if not items:
            return []
        rows = []
        for item in items:
            vec = [float(x) for x in item["embedding"]]
            if len(vec) != self.dim:
                raise ValueError(f"the store has vectors of {self.dim} values, not {len(vec)}")
            triples = [dict(zip(("subj", "pred", "obj"), t)) for t in item.get("triples") or []]
            rows.append((str(uuid.uuid4()), json.dumps(item["payload"], ensure_ascii=False), vec, triples, self._next_us()))
        shape = "id string, payload string, embedding array<float>, triples array<struct<subj:string,pred:string,obj:string>>, us long"
        made = self.spark.createDataFrame(rows, shape)
        made = made.select("id", "payload", normalized(F.col("embedding")).alias("embedding"), "triples", F.timestamp_micros("us").alias("created_at"), F.lit(0).cast("long").alias("access_count"), F.lit(ACTIVE_EPOCH).alias("epoch_id"))
        self._log([("ADD", r["data"]) for r in made.select(F.to_json(F.struct("*")).alias("data")).collect()])
        try:
            epoch_files.write_epochs(made, self._path("atoms"))
        except BaseException:
            self._log([("ROLLBACK", None)])
            raise
        epoch_files.write_epochs(kg.entity_index(made), self._path("index"))
        self._log([("COMMIT", None)])
        self._expire()
        return [r[0] for r in rows]

    def remember(self, text: str, triples: Iterable[tuple] | None = None) -> str:
        return self.remember_batch([text], [triples])[0]

    def remember_batch(self, texts: list[str], triples: list[Iterable[tuple] | None] | None = None) -> list[str]:
        """Add texts in one commit; their vectors come from one call of the embedding function."""
        return self.add_memory_batch([{"payload": t, "embedding": v, "triples": x} for t, v, x in zip(texts, self._embedded(texts), triples or [None] * len(texts))])

    def _embedded(self, texts: list[str]) -> list[list[float]]:
        if self.embed is None:
            raise ValueError("the store was opened without an embedding function")
        return [[float(x) for x in v] for v in self.embed(texts)]

    def _log(self, records: list[tuple[str, str | None]]) -> None:
        lines = [json.dumps({"lsn": self._next_us(), "op": op, "data": data}) for op, data in records]
        self.folder.write(f"wal/{self._next_us():020d}.json", "".join(x + "\n" for x in lines))

    def _clear_wal(self) -> None:
        for name in self.folder.names("wal"):
            self.folder.remove(f"wal/{name}")

    def _expire(self) -> None:
        if time.time() - self._epoch_began > self.epoch_seconds:
            self.force_checkpoint()

    def force_checkpoint(self) -> str | None:
        """Close the active epoch: its atoms move to a new epoch directory. None if it is empty."""
        self._epoch_began = time.time()
        if not self.folder.exists(f"atoms/epoch_id={ACTIVE_EPOCH}"):
            return None
        name = f"epoch_{uuid.uuid4().hex[:8]}"
        self.folder.rename(f"atoms/epoch_id={ACTIVE_EPOCH}", f"atoms/epoch_id={name}")  # one step: readers see the atoms in one epoch or the other
        if self.folder.exists(f"index/epoch_id={ACTIVE_EPOCH}"):
            self.folder.rename(f"index/epoch_id={ACTIVE_EPOCH}", f"index/epoch_id={name}")
        self._clear_wal()
        return name

    # -- reading

    def _query(self, vec: Iterable[float], top_k: int, hops: int, named: list[str] | None) -> DataFrame:
        shape = "query_id string, query_emb array<float>, top_k int, expand_hops int, query_entities array<string>"
        return self.spark.createDataFrame([("q", [float(x) for x in vec], top_k, hops, named)], shape)

    def recall(self, embedding: Iterable[float], top_k: int = 5, expand_hops: int = 1, query_entities: list[str] | None = None) -> list[dict]:
        """The best memories for a query, best first; their access counts go up by one."""
        atoms = self.atoms()
        found = recall.recall(atoms, self.index(), self._query(embedding, top_k, expand_hops, query_entities), self.deltas())
        rows = found.join(atoms.drop("access_count"), F.col("atom_id") == F.col("id")).orderBy("position").select("id", "payload", "embedding", "triples", "created_at", "access_count", "epoch_id", "score").collect()
        if rows:
            self.spark.createDataFrame([(r["id"], 1) for r in rows], ACCESS_DELTAS).coalesce(1).write.mode("append").parquet(self._path("deltas"))
        self._expire()
        return [{**r.asDict(recursive=True), "payload": json.loads(r["payload"])} for r in rows]

    def recall_text(self, text: str, top_k: int = 5, expand_hops: int = 1, query_entities: list[str] | None = None) -> list[dict]:
        named = self.extract_entities(text) if query_entities is None else query_entities
        return self.recall(self._embedded([text])[0], top_k, expand_hops, named)

    def extract_entities(self, text: str) -> list[str]:
        """Entities of the index that a text mentions, in order."""
        atoms = self.atoms()
        preds = atoms.select(F.explode("triples").alias("t")).select(F.col("t.pred").alias("pred")).distinct()
        asked = self.spark.createDataFrame([("q", text)], "query_id string, text string")
        return [r["entity"] for r in entities.extract_entities(asked, self.index(), preds, "query_id", "text").orderBy("entity").collect()]

    def merge_deltas(self) -> None:
        """Fold the access deltas into one row per atom."""
        once = lifecycle.merged_deltas(self.deltas())
        once.coalesce(1).write.mode("overwrite").parquet(self._path("deltas_new"))
        self.folder.remove("deltas")
        self.folder.rename("deltas_new", "deltas")
