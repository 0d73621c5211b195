import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import history, skew


def test_heavy_keys_and_degree(spark):
    rows = [("hot", f"a{i % 7}", "e") for i in range(60)] + [(None, "a1", "e"), ("", "a1", "e"), ("rare", None, "e")] + [(f"k{i}", f"b{i}", "e") for i in range(40)]
    df = spark.createDataFrame(rows, "entity string, atom_id string, epoch_id string").withColumn("n", F.lit(1))
    heavy = {tuple(r) for r in skew.heavy_keys(df, {"entity": F.col("entity"), "atom_id": F.col("atom_id")}, 0.05).select("key_kind", "key_value", "n").collect()}
    want = {("entity", "hot", 60)} | {("atom_id", k, n) for k, n in Counter(r[1] for r in rows if r[1]).items() if n >= 0.05 * len(rows)}
    assert heavy == want
    got = {r["entity"]: (r["n_rows"], r["n_partners"]) for r in skew.degree(df.drop("n"), "entity", "atom_id").collect()}
    assert got["hot"] == (60, 7) and got["rare"] == (1, 0) and got[None] == (1, 1)
    assert skew.heavy_keys(df.limit(0), {"entity": F.col("entity")}, 0.1).count() == 0


def test_competition_rank_with_hot_key_and_ties(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", f"i{i}", rng.choice([None, 0.0, 1.0, float(rng.randrange(50))])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i string, s double")
    got = {r["i"]: r["r"] for r in skew.competition_rank(df, ["k"], {"s": "r"}).collect()}
    for k, i, s in rows:
        better = sum(1 for k2, _, s2 in rows if k2 == k and s2 is not None and (s is None or s2 > s))
        assert got[i] == better + 1


def brute_versions(said):
    by = defaultdict(list)
    for s, p, at, o in said:
        by[s, p].append((at, o))
    out = set()
    for (s, p), v in by.items():
        v.sort()
        starts = [x for j, x in enumerate(v) if j == 0 or v[j - 1][1] != x[1]]
        for j, (at, o) in enumerate(starts):
            out.add((s, p, o, at, starts[j + 1][0] if j + 1 < len(starts) else -1))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_versions_match_brute_force(spark, seed):
    rng = random.Random(seed)
    said = {}
    for i in range(900):
        key = ("hot", "plan") if rng.random() < 0.6 else (f"s{rng.randrange(9)}", rng.choice(["plan", "role"]))
        said[(*key, rng.randrange(2000))] = rng.choice("aabbbc")
    rows = [(*k, v) for k, v in said.items()]
    df = spark.createDataFrame(rows, "subj string, pred string, at long, obj string")
    assert {tuple(r) for r in history.versions(df).collect()} == brute_versions(rows)


def test_statements(spark, atom):
    atoms = atom(
        ("a", None, None, [("Ann  B", "ROLE", " Boss "), ("x", "y", "z"), ("n", "role", None)], 5),
        ("b", None, None, [("ann b", "role", "cook")], 5),
        ("c", None, None, None, 6),
    ).withColumn("extra", F.lit(1))
    preds = spark.createDataFrame([("role",), (None,)], "pred string")
    got = [(r["subj"], r["pred"], r["obj"]) for r in history.statements(atoms, preds).collect()]
    assert got == [("ann b", "role", "cook")]
    assert history.versions(history.statements(atoms.limit(0), preds)).count() == 0
