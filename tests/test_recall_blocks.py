"""Recall of many queries at once, against plain Python and against the full ranking."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import kg, recall, vectors

SHAPE = "query_id string, query_emb array<float>, top_k int, expand_hops int, query_entities array<string>"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    names = [f"E{i}" for i in range(30)] + ["hub"] * 15
    rows = []
    for i in range(160):
        triples = [{"subj": rng.choice(names), "pred": rng.choice(["likes", "works_at", "moved"]), "obj": rng.choice(names)} for _ in range(rng.randint(0, 3))]
        rows.append((f"a{i:03d}", rng.choice([f"p{i}", "copy", None]), [rng.gauss(0, 1) for _ in range(4)], triples, rng.randint(0, 60), rng.choice(["active", "e1", "e2"])))
    atoms = spark.createDataFrame(rows, "id string, payload string, embedding array<float>, triples array<struct<subj:string,pred:string,obj:string>>, at long, epoch_id string")
    atoms = atoms.select("id", "payload", "embedding", "triples", F.timestamp_seconds("at").alias("created_at"), F.lit(1).cast("long").alias("access_count"), "epoch_id")
    asked = [(f"q{i:02d}", [rng.gauss(0, 1) for _ in range(4)], rng.choice([1, 2, 3]), rng.randint(0, 3), rng.choice([None, [], ["hub"], ["E1", "likes"], ["nobody"], ["E2", None]])) for i in range(70)]
    return rows, asked, atoms, spark.createDataFrame(asked, SHAPE)


def test_expansion_against_plain_python(world):
    rows, asked, atoms, queries = world
    index = kg.entity_index(atoms)
    q = recall.prepared(queries)
    pool = {}
    for r in vectors.topk_per_epoch(atoms, q).collect():
        pool.setdefault(r["query_id"], []).append(r)
    ends = {r[0]: {e for t in r[3] for e in (t["subj"], t["obj"])} for r in rows}
    under = {}
    for r in rows:
        for t in r[3]:
            for e in t.values():
                under.setdefault(e, set()).add(r[0])
    want, want_known = set(), set()
    for qid, _, _, hops, named in asked:
        known = {e for e in named or [] if e is not None}
        if not known:
            best = [r for r in pool[qid] if r["epoch_id"] == "active" and r["epoch_rank"] <= 2 and r["sim"] > 0.5]
            known = {e for r in best for e in ends[r["atom_id"]]}
        seen = {r["atom_id"]: 0 for r in pool[qid]} | {a: 0 for e in known for a in under.get(e, ())}
        frontier = set(seen)
        for hop in range(1, hops + 1):
            fresh = {e for a in frontier for e in ends[a]}
            known |= fresh
            frontier = {a for e in fresh for a in under.get(e, ())} - set(seen)
            seen |= dict.fromkeys(frontier, hop)
        want |= {(qid, a, h) for a, h in seen.items()}
        want_known |= {(qid, e) for e in known}
    got = {tuple(r) for r in recall.hops(atoms, index, q).collect()}
    assert (sorted(got - want)[:5], sorted(want - got)[:5]) == ([], [])
    assert {tuple(r) for r in recall.known(atoms, index, q).collect()} == want_known


@pytest.mark.parametrize("heads", [64, 1])
def test_heads_give_the_full_ranking(world, monkeypatch, heads):
    """Also where the heads are too short, so that they must be lengthened, or everything ranked."""
    monkeypatch.setattr(recall, "HEADS", heads - 6 if heads == 1 else heads)
    monkeypatch.setattr(recall, "LONGER", 2 if heads == 1 else 8)
    _, asked, atoms, queries = world
    index = kg.entity_index(atoms)
    most = {a[0]: a[2] for a in asked}
    full = recall.ranked(atoms, index, recall.prepared(queries)).collect()
    want = {(r["query_id"], r["position"], r["atom_id"], round(r["score"], 14)) for r in full if r["position"] <= most[r["query_id"]]}
    got = {(r["query_id"], r["position"], r["atom_id"], round(r["score"], 14)) for r in recall.recall(atoms, index, queries).collect()}
    assert got == want and len(got) > 100


def test_one_query_that_reaches_every_atom(spark, atom):
    atoms = atom(*[(f"a{i:03d}", f"p{i}", [1.0, i / 100, 0.0, 0.0], [("hub", "holds", f"x{i}")], i) for i in range(300)])
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0], 3, 1, ["hub"])], SHAPE)
    found = recall.ranked(atoms, kg.entity_index(atoms), recall.prepared(q))
    assert found.count() == 300
    assert [r["atom_id"] for r in recall.recall(atoms, kg.entity_index(atoms), q).orderBy("position").collect()] == [r["atom_id"] for r in found.where("position <= 3").orderBy("position").collect()]


def test_empty_tables(spark, atom):
    q = spark.createDataFrame([("q", [1.0, 0.0], 3, 1, None), ("n", None, None, None, [None])], SHAPE)
    none = atom(("x",)).limit(0)
    index = kg.entity_index(none)
    assert recall.recall(none, index, q).count() == 0 and recall.ranked(none, index, recall.prepared(q)).count() == 0
    assert recall.recall(atom(("a",)), kg.entity_index(atom(("a",))), q.limit(0)).count() == 0


def test_topk_keeps_the_least_ids_of_ties(spark, atom):
    atoms = atom(*[(f"t{i:02d}", None, [1.0, 0.0, 0.0, 0.0]) for i in range(80)])
    q = recall.prepared(spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0], 1, 0, None)], SHAPE))
    assert [r["atom_id"] for r in vectors.topk(atoms, q).orderBy("rank").collect()] == [f"t{i:02d}" for i in range(10)]
