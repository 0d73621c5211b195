import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ann, recall, vectors


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(60, 16))
    x = centre[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.4
    rows = [(f"v{i:05d}", f"e{i % 3}", [float(v) for v in x[i]]) for i in range(6000)]
    rows += [("zero", "e0", [0.0] * 16), ("short", "e0", [1.0]), ("nan", "e1", [float("nan")] * 16), ("none", "e1", None)]
    return spark.createDataFrame(rows, "id string, epoch_id string, embedding array<float>")


def test_stored_index_finds_what_exact_search_finds(spark, vecs, tmp_path):
    ann.build_index(vecs, str(tmp_path), 16, k=5, recall=0.95)
    asked = vecs.where("id like 'v000%'").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_emb"), F.lit(5).alias("pool"))
    truth = vectors.topk_per_epoch(vecs.where("id not in ('zero')"), asked)
    found = ann.search(spark, str(tmp_path), asked)
    assert ann.recall_of(found, truth).first()["recall"] >= 0.9
    exact = ann.search(spark, str(tmp_path), asked, widen=float("inf"))
    assert {tuple(r) for r in exact.collect()} == {tuple(r) for r in truth.select(exact.columns).collect()}
    tree, dim, widen = ann.load_tree(spark, str(tmp_path))
    assert dim == 16 and 0 < widen < float("inf") and tree.leaves > 10
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 6000


def test_leaves_that_are_not_visited_are_not_read(spark, vecs, tmp_path):
    ann.build_index(vecs, str(tmp_path), 16, k=5, recall=0.9)
    asked = vecs.where("id = 'v00007'").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_emb"), F.lit(5).alias("pool"))
    plan = ann.search(spark, str(tmp_path), asked)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "leaf" in plan.split("PushedFilters")[1][:400]


def test_index_of_nothing(spark, vecs, tmp_path):
    ann.build_index(vecs.limit(0), str(tmp_path), 16)
    asked = spark.createDataFrame([("q", [1.0] * 16, 3), ("z", [0.0] * 16, 3), ("s", [1.0], 3)], "query_id string, query_emb array<float>, pool int")
    assert ann.search(spark, str(tmp_path), asked).count() == 0
