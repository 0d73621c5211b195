"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import holds_all


def precision_recall_at_k(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, precision, recall`` of results (``query_id, item, rank``) against relevant pairs (``query_id, item``).

    Precision is hits / max(returned, 1), recall hits / relevant; a query without
    relevant items has null recall, one without results precision 0.
    """
    top = results.where(F.col("rank") <= k).select("query_id", "item").distinct()
    hits = top.join(relevant.select("query_id", "item").distinct(), ["query_id", "item"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    returned = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    total = relevant.select("query_id", "item").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    joined = returned.join(total, "query_id", "full").join(hits, "query_id", "left").fillna(0, ["hits", "returned"])
    return joined.select("query_id", (F.col("hits") / F.greatest("returned", F.lit(1))).alias("precision"), (F.col("hits") / F.col("total")).alias("recall"))


def answer_hit(results: DataFrame, questions: DataFrame, text: str = "payload") -> DataFrame:
    """``query_id, hit``: whether any result of the question holds all its terms (``query_id, terms``)."""
    got = questions.join(results, "query_id", "left")
    return got.groupBy("query_id").agg(F.coalesce(F.bool_or(holds_all(F.coalesce(F.col(text), F.lit("")), F.col("terms"))), F.lit(False)).alias("hit"))


def first_hop(found: DataFrame) -> DataFrame:
    """``query_id, atom_id, min_hop``: the least hop at which an atom appears."""
    return found.groupBy("query_id", "atom_id").agg(F.min("hop").alias("min_hop"))


def mean_recall(found: DataFrame) -> DataFrame:
    """One row: the mean of per-chain recalls (``recall``), nulls left out."""
    return found.agg(F.avg("recall").alias("mean_recall"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, repeated rows included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def compression(raw_bytes: int, stored_bytes: int) -> float:
    return raw_bytes / stored_bytes if stored_bytes else 0.0
