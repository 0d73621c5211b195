"""Candidates that leave the tasks as the result: no row of a query and an atom is shuffled or laid out before."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ann, kg, recall, vectors, whole

SHAPE = "query_id string, query_emb array<float>, top_k int, expand_hops int, query_entities array<string>"


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(5)
    names = [f"E{i}" for i in range(20)] + ["hub"] * 9 + [None, ""]
    rows = []
    for i in range(240):
        triples = [{"subj": rng.choice(names), "pred": rng.choice(["likes", "Works_at", "moved", None]), "obj": rng.choice(names)} for _ in range(rng.randint(0, 3))]
        vec = rng.choice([[rng.gauss(0, 1) for _ in range(4)], [1.0, 0.0, 0.0, 0.0], [0.0] * 4, [1.0, 2.0], [float("nan")] * 4, None])
        rows.append((f"a{i:03d}", rng.choice([f"p{i}", "copy", None]), vec, triples or None, rng.choice([None, *range(40)]), rng.choice(["active", "e1", "e2", None])))
    atoms = spark.createDataFrame(rows, "id string, payload string, embedding array<float>, triples array<struct<subj:string,pred:string,obj:string>>, at long, epoch_id string")
    atoms = atoms.select("id", "payload", "embedding", "triples", F.timestamp_seconds("at").alias("created_at"), F.lit(1).cast("long").alias("access_count"), "epoch_id")
    asked = [(f"q{i:02d}", rng.choice([[rng.gauss(0, 1) for _ in range(4)], [1.0, 0.5], None, [1.0, 0.0, 0.0, 0.0]]), rng.choice([1, 2, 3, None]), rng.randint(0, 3), rng.choice([None, [], ["hub"], ["E1", "likes"], ["nobody"], ["E2", None], ["e3", "moved"]])) for i in range(50)]
    index = kg.entity_index(atoms).unionByName(spark.createDataFrame([("E1", "gone", "e1"), ("E1", "a001", "e9"), (None, "a002", "e1")], "entity string, atom_id string, epoch_id string"))
    return atoms, index, recall.prepared(spark.createDataFrame(asked, SHAPE))


def _rounded(rows):
    return {(r["query_id"], r["atom_id"]): tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in rows}


def test_whole_ranking_is_that_of_range_partitions(store, monkeypatch):
    found = recall.ranked(*store)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow") < plan.index("Exchange"), "only queries are shuffled, candidates are not"
    got = found.collect()
    monkeypatch.setattr(whole, "WORKER_BYTES", 0)
    want = recall.ranked(*store).collect()
    assert len(got) == len(want) > 2000 and _rounded(got) == _rounded(want)


def test_asked_columns_only(store):
    assert recall.ranked(*store, columns=["score"]).columns == ["query_id", "atom_id", "score"]


def test_positions_alone_are_those_of_the_full_table(store):
    full = {(r["query_id"], r["atom_id"]): (r["position"], r["score"]) for r in recall.ranked(*store).collect()}
    assert {(r["query_id"], r["atom_id"]): (r["position"], r["score"]) for r in recall.ranked(*store, columns=["position", "score"]).collect()} == full


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_hops_leave_the_tasks_as_they_are(store, monkeypatch, held):
    """Also where vectors are read again for every few queries."""
    monkeypatch.setattr(whole, "VECTOR_BYTES", held)
    found = recall.hops(*store)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Join" not in plan
    got = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(whole, "WORKER_BYTES", -1)
    assert got == sorted(tuple(r) for r in recall.hops(*store).collect()) and len(got) > 2000


def test_seeds_are_distinct_without_a_shuffle_of_pairs(store, spark):
    index = store[1].unionByName(store[1])
    known = spark.createDataFrame([("q1", "hub"), ("q1", "E1"), ("q2", "E1"), ("q2", "likes"), ("q2", "E1"), ("q3", "nobody"), ("q3", ""), (None, "E2")], "query_id string, entity string")
    found = recall.seeds(known, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange"), "nothing is shuffled after the join"
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, kg.lookup(index, known).select("query_id", "atom_id").distinct().collect()), key=str)


@pytest.mark.parametrize("most", [1 << 17, 10])
def test_hits_of_an_epoch_are_ranked_where_it_is_read(store, tmp_path, monkeypatch, most):
    """Also of epochs that are worked off in pieces."""
    atoms, _, queries = store
    monkeypatch.setattr(ann, "PIECE_ROWS", most)
    ann.build_index(atoms, str(tmp_path), 4)
    found = ann.search(atoms.sparkSession, str(tmp_path), queries, widen=float("inf"))
    assert ("Window" in found._jdf.queryExecution().executedPlan().toString()) == (most == 10)
    usable = "size(embedding) = 4 AND exists(embedding, x -> x <> 0 AND NOT isnan(x))"
    want = vectors.topk_per_epoch(atoms.where(usable), queries.where("size(query_emb) = 4"))
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and found.count() > 300


def test_laid_out_store_goes_with_the_result(store, spark):
    import gc
    import time
    from pathlib import Path
    from urllib.parse import urlparse

    root = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    before = {*root.rglob("atoms")}
    found = recall.ranked(*store, columns=["position", "score"]).where("position > 1")
    laid = {*root.rglob("atoms")} - before
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    assert len(laid) == 1 and found.count() > 2000, "while the result is referred to, the store stays"
    del found
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        if not any(p.exists() for p in laid):
            break
    assert not any(p.exists() for p in laid)
