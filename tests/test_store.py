import asyncio
import json
import os
import socket

import pytest

from palimpsest.checkpointer import AgentCheckpointer
from palimpsest.embedding import hashed
from palimpsest.sources import epoch_files
from palimpsest.sources.folder import Folder
from palimpsest.store import MemoryStore, WriterLock


def unit(i, n=4):
    return [1.0 if j == i else 0.0 for j in range(n)]


def test_store_round_trip(spark, tmp_path):
    with MemoryStore(spark, str(tmp_path / "s"), dim=4) as db:
        a = db.add_memory({"role": "user", "turn": 3, "content": "é"}, [0, 2, 0, 0], [('"x\\', "is", "ñ")])
        b = db.add_memory("plain", unit(2))
        assert db.atoms().where("epoch_id = 'active'").count() == 2
        epoch = db.force_checkpoint()
        assert epoch_files.catalog(spark, db._path("atoms")) == [epoch] and db.force_checkpoint() is None
        got = db.recall(unit(1), top_k=1)
        assert got[0]["id"] == a and got[0]["payload"] == {"role": "user", "turn": 3, "content": "é"} and got[0]["access_count"] == 1
        assert got[0]["triples"] == [{"subj": '"x\\', "pred": "is", "obj": "ñ"}] and got[0]["embedding"] == unit(1)
        assert db.recall(unit(1), top_k=1)[0]["access_count"] == 2
        db.merge_deltas()
        assert db.deltas().collect()[0]["delta"] == 2
        assert epoch_files.lookup(spark, db._path("atoms"), [b]).count() == 1
        with pytest.raises(ValueError):
            db.add_memory("x", [1.0])
        with pytest.raises(ValueError):
            db.remember("x")
    with pytest.raises(ValueError):
        MemoryStore(spark, str(tmp_path / "s"), dim=5)


def test_lost_additions_are_recovered(spark, tmp_path):
    db = MemoryStore(spark, str(tmp_path / "s"), dim=4)
    row = {"id": "lost", "payload": json.dumps("x"), "embedding": unit(0), "triples": [], "created_at": "2024-01-01T00:00:00.000Z", "access_count": 0, "epoch_id": "active"}
    db._log([("ADD", json.dumps(row))])
    (tmp_path / "s" / "wal" / "torn.json").write_text('{"lsn": 5, "op": "AD')
    db.close()
    with MemoryStore(spark, str(tmp_path / "s"), dim=4) as again:
        assert [r["id"] for r in again.atoms().collect()] == ["lost"]


def test_lock(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}")
    lock = WriterLock(folder, "l")
    lock.acquire()
    with pytest.raises(RuntimeError):
        WriterLock(folder, "l").acquire()
    lock.release()
    for left in (f"{socket.gethostname()}:999999999", "broken", ""):
        (tmp_path / "l").write_text(left)
        (tmp_path / ".l.crc").unlink(missing_ok=True)
        other = WriterLock(folder, "l")
        other.acquire()
        assert (tmp_path / "l").read_text() == f"{socket.gethostname()}:{os.getpid()}"
        other.release()
        assert not (tmp_path / "l").exists()
    (tmp_path / "l").write_text("another-host:1")
    (tmp_path / ".l.crc").unlink(missing_ok=True)
    with pytest.raises(RuntimeError):
        WriterLock(folder, "l").acquire()


def test_a_failed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    with MemoryStore(spark, root, dim=4) as db:
        kept = db.add_memory("kept", unit(0))
        real = epoch_files.write_epochs
        monkeypatch.setattr(epoch_files, "write_epochs", lambda *a, **k: (_ for _ in ()).throw(OSError("disk full")))
        with pytest.raises(OSError):
            db.add_memory("lost", unit(1), [("a", "b", "c")])
        monkeypatch.setattr(epoch_files, "write_epochs", real)
        ops = [r["op"] for r in epoch_files.read_wal(spark, db._path("wal")).orderBy("lsn").collect()]
        assert ops == ["ADD", "COMMIT", "ADD", "ROLLBACK"]
    with MemoryStore(spark, root, dim=4) as again:
        assert [r["id"] for r in again.atoms().collect()] == [kept] and again.index().count() == 0


def test_stored_indexes(spark, tmp_path):
    with MemoryStore(spark, str(tmp_path / "s"), dim=4, embed=lambda ts: [unit(len(t) % 4) for t in ts]) as db:
        one, two = db.remember_batch(["a", "bb"], [[("Ann", "knows", "Bob")], None])
        epoch = db.force_checkpoint()
        three = db.add_memory("ccc", unit(3), [("Bob", "knows", "Cy")])
        assert {(r["entity"], r["atom_id"], r["epoch_id"]) for r in db.index().collect()} == {(e, one, epoch) for e in ("Ann", "knows", "Bob")} | {(e, three, "active") for e in ("Bob", "knows", "Cy")}
        before = {tuple(r) for r in db.index().collect()}
        db.rebuild_index()
        assert {tuple(r) for r in db.index().collect()} == before
        db.build_vector_index()
        asked = spark.createDataFrame([("q", unit(1), 5)], "query_id string, query_emb array<float>, pool int")
        assert {r["atom_id"] for r in db.nearest(asked).collect()} >= {one, three}
        scan = epoch_files.read_epoch(spark, db._path("atoms"), epoch)
        assert scan.count() == 2 and "PartitionFilters: [isnotnull(epoch_id" in scan._jdf.queryExecution().toString()


def test_an_index_that_was_not_written_is_recovered(spark, tmp_path):
    db = MemoryStore(spark, str(tmp_path / "s"), dim=4)
    db.add_memory("x", unit(0), [("s", "p", "o")])
    db.folder.remove("index")
    db.close()
    with MemoryStore(spark, str(tmp_path / "s"), dim=4) as again:
        assert again.folder.exists("index") and again.index().count() == 3 and again.atoms().count() == 1


def test_json_checkpoints_that_are_broken_are_set_apart(spark, tmp_path):
    from palimpsest.sources import checkpoints

    (tmp_path / "good.json").write_text(json.dumps({"checkpoint": {"type": "json", "data": "eyJhIjogMX0="}, "metadata": "m"}))
    (tmp_path / "bad.json").write_text("{broken")
    rows = checkpoints.read_json_checkpoints(spark, str(tmp_path)).collect()
    assert sorted((r["_corrupt_record"] or "", bytes(r["checkpoint"]["data"]) if r["checkpoint"] else None) for r in rows) == [("", b'{"a": 1}'), ("{broken", None)]


def test_embedding_as_a_column(spark):
    from palimpsest.embedding import hashed_column
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("b a",), ("",), (None,)], "t string")
    got = [r["v"] for r in df.select(hashed_column(F.col("t"), 8).alias("v")).collect()]
    assert got == hashed(["b a", "", None], 8).tolist()


def test_remember_and_recall_text(spark, tmp_path):
    with MemoryStore(spark, str(tmp_path / "s"), dim=32, embed=lambda t: hashed(t, 32)) as db:
        db.remember("the meeting moved to Friday", [("meeting", "moved_to", "Friday")])
        db.remember("soup is served at noon")
        assert db.extract_entities("When is the meeting?") == ["meeting"]
        assert db.recall_text("when is the meeting", top_k=1)[0]["payload"] == "the meeting moved to Friday"


def test_legacy_rows(spark):
    rows = spark.createDataFrame([("a", '"p"', [127, 0], '[["s","p","o"]]', 1.5, 0, "e", 2.0), ("b", '"p"', [0, 64], "broken", 1.0, 0, "e", 1.0)], "id string, payload string, embedding array<int>, triples string, created_at double, access_count int, epoch_id string, embedding_max double")
    got = {r["id"]: r for r in epoch_files.decode_legacy(rows).collect()}
    assert got["a"]["embedding"] == [2.0, 0.0] and got["a"]["triples"][0]["obj"] == "o" and got["b"]["triples"] == []


def test_checkpointer(spark, tmp_path):
    c = AgentCheckpointer(spark, str(tmp_path / "c"))
    cfg = {"configurable": {"thread_id": "t/../1"}}
    assert c.get_tuple(cfg) is None and list(c.list(cfg)) == []
    for i in range(3):
        out = c.put(cfg, {"id": f"cp_{i}", "v": i}, {"step": i})
    assert out["configurable"]["checkpoint_id"] == "cp_2"
    c.put(cfg, {"id": "cp_1", "v": 10}, {"step": 1})
    assert c.get_tuple(cfg).checkpoint["v"] == 2
    assert [x.checkpoint["v"] for x in c.list(cfg)] == [2, 10, 0] and len(list(c.list(cfg, limit=2))) == 2
    c.put_writes(out, [("a", "x"), ("b", 3)], "task")
    c.put_writes(out, [("a", "y")], "task")
    assert c.writes(out) == [("task", 0, "a", "y")]
    assert asyncio.run(c.aget_tuple(out)).metadata == {"step": 2}
