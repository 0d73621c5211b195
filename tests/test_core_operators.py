import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import clock, payload, text, vector
from palimpsest.operators import entities, kg, lifecycle, metrics, recall, vectors


def one(df, col):
    return df.select(col.alias("x")).first()["x"]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<float>, z array<float>, s array<float>")
    assert one(df, vector.normalized(F.col("a"))) == pytest.approx([0.6, 0.8])
    assert one(df, vector.normalized(F.col("z"))) == [0, 0]
    assert one(df, vector.cosine(F.col("a"), F.col("z"))) == 0
    assert one(df, vector.cosine(F.col("a"), F.col("s"))) is None
    q = df.select(vector.quantized(F.col("a")).alias("q"))
    assert one(q, vector.dequantized(F.col("q.codes"), F.col("q.top"))) == pytest.approx([3, 4], abs=0.02)


def test_payload_expressions(spark):
    rows = [json.dumps("café\n\"x\""), json.dumps({"role": "user", "content": "hi"}), "bare { text", "", None, '{"role": "x"}', "12", '"broken', "'quoted'"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = [r["t"] for r in df.select(payload.decoded_text(F.col("p")).alias("t")).collect()]
    assert got == ['café\n"x"', "hi", "bare { text", "", None, None, "12", '"broken', "'quoted'"]


def test_text_expressions(spark):
    df = spark.createDataFrame([("Who's  Dr. Chen?  The LAB, ok", 1)], "t string, n int")
    assert one(df, text.cleaned(F.col("t"))) == "who  dr chen  the lab ok"
    assert one(df, text.long_words(text.cleaned(F.col("t")))) == ["who", "chen", "the", "lab"]
    assert one(df, text.capitalized(F.col("t"))) == ["Who's", "Dr", "Chen", "The", "LAB"]
    assert len(one(df, text.rule_triples(F.col("t"), [(["chen", "lab"], ("a", "b", "c")), (["nope"], ("d", "e", "f"))]))) == 1


def test_clock(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 3, 9, 9, 9, 20])], "seq int, c long")
    got = [r["ts_us"] for r in clock.monotonic_micros(df, "c", "seq").orderBy("seq").collect()]
    last, want = 0, []
    for c in [5, 5, 3, 9, 9, 9, 20]:
        last = max(c, last + 1)
        want.append(last)
    assert got == want


def test_extract_entities(spark):
    texts = spark.createDataFrame([("q", "Where is Anna's lab, and who WORKS there?"), ("n", None), ("e", "")], "id string, t string")
    index = spark.createDataFrame([(x,) for x in ["Anna", "lab", "user", "Dr. Chen", "", None, "ann"]], "entity string")
    preds = spark.createDataFrame([("works_at",), ("likes",), ("labels",), ("the",)], "pred string")
    got = {(r["id"], r["entity"]) for r in entities.extract_entities(texts, index, preds, "id", "t").collect()}
    assert got == {("q", "Anna"), ("q", "lab"), ("q", "ann"), ("q", "works_at")}


def test_wal(spark):
    ops = "ADD ADD COMMIT ADD ROLLBACK ADD ADD".split()
    wal = spark.createDataFrame([(i, o, f"d{i}") for i, o in enumerate(ops)], "lsn long, op string, data string")
    assert [r["lsn"] for r in lifecycle.wal_pending(wal).orderBy("lsn").collect()] == [5, 6]
    assert [r["lsn"] for r in lifecycle.wal_recoverable(wal).orderBy("lsn").collect()] == [0, 1, 5, 6]
    assert lifecycle.wal_pending(wal.limit(0)).count() == 0 and lifecycle.wal_recoverable(wal.limit(0)).count() == 0


def test_deltas_and_upsert(spark, atom):
    atoms = atom(("a",), ("b",)).withColumn("access_count", F.lit(None).cast("long"))
    deltas = spark.createDataFrame([("a", 2), ("a", 2), ("a", None), (None, 5), ("zz", 1)], "atom_id string, delta long")
    assert {r["id"]: r["access_count"] for r in lifecycle.with_deltas(atoms, deltas).collect()} == {"a": 4, "b": 0}
    both = lifecycle.idempotent_append(atoms.select("id"), atom(("b",), ("c",), ("c",)).select("id"))
    assert sorted(r["id"] for r in both.collect()) == ["a", "b", "c"]


def test_superseded_and_active(atom):
    atoms = atom(("a", None, None, [("S", "p", "1")], 1), ("b", None, None, [("s", "P", "2"), ("t", "p", "x")], 2), ("c", None, None, [("t", "p", "y")], 2), ("d", None, None, None, 3))
    rows = atoms.select(F.col("id").alias("atom_id"), "created_at", "triples")
    assert {r["atom_id"] for r in lifecycle.superseded(rows, []).collect()} == {"a", "b"}
    assert {(r["subj"], r["atom_id"]) for r in lifecycle.active_state(atoms).collect()} == {("s", "b"), ("t", "c")}


def query(spark, vec, top_k=5, hops=1, named=None):
    return spark.createDataFrame([("q", vec, top_k, hops, named)], "query_id string, query_emb array<float>, top_k int, expand_hops int, query_entities array<string>")


def unit(i, n=4):
    return [1.0 if j == i else 0.0 for j in range(n)]


def ids(found):
    return [r["atom_id"] for r in found.orderBy("position").collect()]


def test_topk_skips_unusable_vectors(spark, atom):
    atoms = atom(("a", None, unit(0)), ("b", None, unit(1)), ("bad", None, [1.0]), ("nan", None, [float("nan")] * 4), ("none", None, None), ("zero", None, [0.0] * 4))
    q = recall.prepared(query(spark, unit(0)))
    assert [r["atom_id"] for r in vectors.topk(atoms, q).orderBy("rank").collect()] == ["a", "b", "zero"]
    assert vectors.topk(atoms.limit(0), q).count() == 0
    assert vectors.topk(atoms, q.limit(0)).count() == 0


def test_recall_scenarios(spark, atom):
    chain = [("c1", "p1", unit(0), [("A", "knows", "B")], 1, "e1"), ("c2", "p2", unit(1), [("B", "knows", "C")], 2, "e2"), ("c3", "p3", unit(2), [("C", "knows", "D")], 3, "e2")]
    noise = [(f"n{i}", f"noise {i}", unit(3), None, 10 + i, "active") for i in range(10)]
    atoms = atom(*chain, *noise)
    index = kg.entity_index(atoms)
    assert "c3" in ids(recall.recall(atoms, index, query(spark, unit(3), 10, 3, ["A"])))
    first = recall.recall(atoms, index, query(spark, unit(3), 20, 1, ["A"]))
    assert ids(first)[0] == "c1" and "c2" in ids(first)
    assert first.where("atom_id = 'c1'").first()["access_count"] == 1
    assert "c3" not in ids(recall.recall(atoms, index, query(spark, unit(3), 1, 0)))


def test_recall_dedups_payloads_and_demotes_old_facts(spark, atom):
    atoms = atom(("a", "same", unit(0)), ("b", "same", unit(0)), ("old", "o", unit(1), [("s", "p", "1")], 1), ("new", "n", unit(1), [("s", "p", "2")], 2))
    got = ids(recall.recall(atoms, kg.entity_index(atoms), query(spark, unit(1), 10, 0)))
    assert len(got) == 3 and got.index("new") < got.index("old")


def test_topic_lock_rules(spark):
    kind = "array<struct<subj:string,pred:string,obj:string>>"
    qe = "array<struct<low:string,broad:boolean>>"

    def locked(triple, low, broad=False):
        df = spark.createDataFrame([([triple], [(low, broad)])], f"t {kind}, q {qe}")
        return one(df, recall.topic_locked(F.col("t"), F.col("q")))

    assert locked(("Ann", "works_at", "Lab"), "ann") and not locked(("Ann", "works_at", "Lab"), "ann", True)
    assert locked(("Ann", "works_at", "Lab"), "works_at", True) and locked(("a", "works_at", None), "workshop")
    assert not locked(("a", "works_at", "b"), "wor ") and locked(("a", "p", "b"), "")
    assert not locked(("a", None, None), "zz")


def test_metrics(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "x", 1)], "query_id string, item string, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("q", "c"), ("s", "y")], "query_id string, item string")
    got = {r["query_id"]: (r["precision"], r["recall"]) for r in metrics.precision_recall_at_k(results, relevant, 2).collect()}
    assert got == {"q": (0.5, 0.5), "r": (0.0, None), "s": (0.0, 0.0)}
    assert metrics.same_set(results, results) and not metrics.same_set(results, results.limit(1))
