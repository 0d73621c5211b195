"""Results per key where a few keys hold most rows.

Everything here is an algebraic aggregate: each task folds its rows into a
hash table of partial states keyed by the group (Spark's partial aggregation,
bounded by the task's memory and spilled when full), and only those compact
states are shuffled. A key that holds a third of all rows contributes at most
one state per map task, so no reducer sees its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import cut, shuffle_width


def key_counts(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows per key value, for several kinds of key in one scan.

    ``keys`` maps the name of a key kind to its column. Returns ``key_kind,
    key_value, n``; null keys come out as one null group per kind, and an empty
    input as no rows. Repeated rows count each time.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in keys.items()]))
    return (
        df.select(pairs.alias("p"))
        .groupBy(F.col("p.kind").alias("key_kind"), F.col("p.value").alias("key_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heavy_keys(df: DataFrame, keys: dict[str, Column], share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, with their row count and the total.

    Null and empty keys are never reported, but their rows are in the total.
    The total is a count without columns, so the keys are read once.
    """
    counts = key_counts(df, keys)
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()  # one number, no join
    return (
        counts.where(F.col("key_value").isNotNull() & (F.col("key_value") != ""))
        .withColumn("total", total)
        .where(F.col("n") >= F.col("total") * F.lit(float(share)))
        .select("key_kind", "key_value", "n", "total")
    )


def degree(df: DataFrame, key: str, partner: str) -> DataFrame:
    """Rows and distinct partners per key: ``key, n_rows, n_partners``.

    The distinct count is taken in two steps: (key, partner) pairs are folded
    first, spread over all tasks by the pair, then counted per key with partial
    sums. Null partners are no partners; null keys form one group.
    """
    pairs = df.groupBy(F.col(key), F.col(partner)).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(key).agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.col(partner)).alias("n_partners"),
    )


def range_laid(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` range-partitioned by ``keys`` then ``order``, with the partition number in ``_part``; written out.

    A key with very many rows spans several partitions; rows equal in all sort
    columns stay together, so fold ties first when they can be many.
    """
    n = shuffle_width(df.sparkSession)
    laid = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    return cut(laid)


def running(laid: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], fold: Callable[[str], Column], own: bool = True) -> DataFrame:
    """Running ``fold`` (``F.sum``, ``F.bit_or`` or ``F.max``) per key in ``order`` over :func:`range_laid` rows, without one task per key.

    ``values`` maps new columns to what is folded; with ``own`` a row's own value
    is in. Inside a partition a window folds; what earlier partitions hold of the
    same key is folded in from a table with one row per (partition, key).
    """
    outs = list(values)
    both = F.greatest if fold is F.max else (lambda a, b: a + b) if fold is F.sum else (lambda a, b: a.bitwiseOR(b))
    zero = lambda c: c if fold is F.max else F.coalesce(c, F.lit(0))
    v = laid.withColumns({f"_v{o}": c for o, c in values.items()})
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part = v.groupBy("_part", *keys).agg(*[fold(f"_v{o}").alias(f"_s{o}") for o in outs])
    part = part.select(F.col("_part").alias("_bp"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[zero(fold(f"_s{o}").over(before)).alias(f"_p{o}") for o in outs])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_bp"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    return v.select("*", *[zero(fold(f"_v{o}").over(inside)).alias(f"_i{o}") for o in outs]).join(part, same).select(*laid.columns, *[both(F.col(f"_i{o}"), F.col(f"_p{o}")).alias(o) for o in outs])


def running_total(laid: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per key; see :func:`running`."""
    return running(laid, keys, order, {out: value}, F.sum)


def competition_rank(df: DataFrame, keys: list[str], scores: dict[str, str]) -> DataFrame:
    """For each score, 1 + the number of rows of the same key that are strictly better (greater).

    ``scores`` maps a numeric score column to the name of its rank column. All
    scores are ranked in one pass over unpivoted rows. Ties are folded into levels
    with a count before anything is ordered, so neither a hot key nor a hot value
    lands in one task. Null scores rank behind all others and tie with each other.
    """
    whole = {s: df.schema[s].dataType.typeName() in ("byte", "short", "integer", "long") for s in scores}
    none = F.lit(None)
    as_long = lambda s: (F.col(s) if whole[s] else none).cast("long")
    as_double = lambda s: (none if whole[s] else F.col(s)).cast("double")
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("_k"), as_long(s).alias("_l"), as_double(s).alias("_d")) for i, s in enumerate(scores)]))
    levels = df.select(*keys, one.alias("_e")).select(*keys, "_e.*").groupBy(*keys, "_k", "_l", "_d").agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col("_l").desc_nulls_last(), F.col("_d").desc_nulls_last()]
    within = [*keys, "_k"]
    total = cut(running_total(range_laid(levels, within, order), within, order, F.col("_n"), "_upto").drop("_part"))
    for i, (score, out) in enumerate(scores.items()):
        value = "_l" if whole[score] else "_d"
        ranks = total.where(F.col("_k") == i).select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col(value).alias("_score"), (F.col("_upto") - F.col("_n") + 1).alias(out))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.col(score).eqNullSafe(F.col("_score")))
        df = df.join(ranks, same).drop("_score", *[f"_k{j}" for j in range(len(keys))])
    return df
