"""One ranking from several scores on different scales.

Scores are replaced by their ranks within the query, so no scale dominates; the
correlation matrix of the ranks is aggregated in one distributed pass; its first
principal component, with signs turned to the declared directions, weights the
ranks; items are ordered by their projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.skew import competition_rank, range_laid, running_total
from palimpsest.session import cut


#: Digits of a projection that count.
DIGITS = 9


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; null where lengths differ, a vector is zero or a value is not finite."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    v = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(~F.isnan(v), v))


def first_component(ranked: DataFrame, columns: list[str]) -> list[float]:
    """Loadings of the first principal component of the columns' correlation matrix.

    The moments are one distributed aggregate; only a matrix of
    ``len(columns)`` squared reaches the driver. The declared direction of
    every column is "greater is better". The component's sign is chosen so that its
    loadings agree with the declared directions in sum; where columns correlate
    negatively one loading or more still opposes its direction, and stands as it
    is (:func:`loadings` reports it). A column without spread has no weight; if
    none is left, all weigh the same.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.avg(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs],
    ).first()
    k = len(columns)
    if not row["n"]:
        return [1.0 / np.sqrt(k)] * k
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] - row[f"m{i}"] * row[f"m{j}"]
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    alive = sd > 1e-12
    if not alive.any():
        return [1.0 / np.sqrt(k)] * k
    corr = np.eye(k)
    corr[np.ix_(alive, alive)] = cov[np.ix_(alive, alive)] / np.outer(sd[alive], sd[alive])
    corr[~alive] = corr[:, ~alive] = 0
    values, vectors = np.linalg.eigh(corr)
    v = vectors[:, -1]
    v = v if v.sum() >= 0 else -v
    return [float(x) for x in v / np.linalg.norm(v)]


def _ranked(items: DataFrame, key: str, item: str, scores: list[str]) -> tuple[DataFrame, list[float]]:
    """One row an item with ranks and, as ``_u0...``, the shares of the key's items that are not better; and the loadings."""
    one = cut(items.groupBy(key, item).agg(*[F.max(s).alias(s) for s in scores]))
    sizes = one.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    ranked = competition_rank(one, [key], {s: f"{s}_rank" for s in scores}).join(sizes, key)
    ranked = cut(ranked.select("*", *[(1.0 - (F.col(f"{s}_rank") - 1) / F.col("_size")).alias(f"_u{i}") for i, s in enumerate(scores)]))
    return ranked, first_component(ranked, [f"_u{i}" for i in range(len(scores))])


def loadings(items: DataFrame, key: str, item: str, scores: list[str]) -> DataFrame:
    """``score, loading, agrees``: the weights of the fused ranking, and whether each agrees with its declared direction."""
    _, weights = _ranked(items, key, item, scores)
    return items.sparkSession.createDataFrame([(s, w, w >= 0) for s, w in zip(scores, weights)], "score string, loading double, agrees boolean")


def fused_ranking(items: DataFrame, key: str, item: str, scores: list[str]) -> DataFrame:
    """One order per ``key``: columns ``key, item, <score>_rank..., projection, position``.

    Repeated (key, item) rows count once (the greatest scores stand). Null scores
    rank last. Rank 1 is best, ties share a rank; the rank is turned into the
    share of the key's items that are not better, the projection is the weighted
    sum of those shares, and ties of the projection are ordered by item. Keys
    with very many items are spread over tasks throughout.
    """
    ranked, weights = _ranked(items, key, item, scores)
    projection = sum((F.col(f"_u{i}") * F.lit(w) for i, w in enumerate(weights[1:], 1)), F.col("_u0") * F.lit(weights[0]))
    ranked = ranked.withColumn("projection", F.round(projection, DIGITS))
    order = [F.col("projection").desc(), F.col(item).asc()]
    placed = running_total(range_laid(ranked, [key], order), [key], order, F.lit(1).cast("long"), "position")
    return placed.select(key, item, *scores, *[f"{s}_rank" for s in scores], "projection", "position")


def heads(items: DataFrame, key: str, item: str, scores: list[str], most: int) -> DataFrame:
    """``key, item``: items than which, on every score, fewer than ``most`` of the key's items are strictly better.

    They are looked for where the projection is high: an item with all its shares
    in the top has at least the projection of one that is ``most``-th everywhere
    (opposing loadings: first). The ranks of what remains are then checked.
    """
    ranked, weights = _ranked(items, key, item, scores)
    projection = sum((F.col(f"_u{i}") * F.lit(w) for i, w in enumerate(weights[1:], 1)), F.col("_u0") * F.lit(weights[0]))
    lowest = F.lit(sum(weights)) - F.lit(sum(w for w in weights if w > 0) * (most - 1)) / F.col("_size")
    high = ranked.where(projection >= lowest - F.lit(1e-9))
    return high.where(" and ".join(f"`{s}_rank` <= {most}" for s in scores)).select(key, item)


def recall_scores(atoms: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates with their scores: ``query_id, atom_id, access, created, likeness``.

    A null access count is 0. An unusable embedding has a null likeness.
    Candidates without atom or query have no row.
    """
    pool = candidates.select("query_id", "atom_id").where(F.col("query_id").isNotNull() & F.col("atom_id").isNotNull()).distinct()
    atoms = atoms.select(F.col("id").alias("atom_id"), "embedding", F.unix_micros("created_at").alias("created"), F.coalesce("access_count", F.lit(0)).alias("access"))
    return (
        pool.join(atoms, "atom_id")
        .join(queries.select("query_id", "query_emb"), "query_id")
        .select("query_id", "atom_id", "access", "created", cosine(F.col("embedding"), F.col("query_emb")).alias("likeness"))
    )
