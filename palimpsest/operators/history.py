"""Full history of entity attributes from dated statements, by presence bitmaps.

Each distinct instant at which something is said about an attribute is one
snapshot of that attribute. Of every value one bit per snapshot is kept, in
words of 64 snapshots, built by a map-side ``bit_or``. Runs of set bits are the
periods in which the value held; a run that ends gives way to another value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.skew import range_laid, running_total
from palimpsest.session import cut

BITS = 64
_KEYS = ["subj", "pred"]


def plain_name(c: Column) -> Column:
    """Lower case, trimmed, inner white space reduced to one blank."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def statements(atoms: DataFrame, preds: DataFrame) -> DataFrame:
    """One row per (subj, pred, instant): the value stated then, of the greatest atom id.

    Only predicates in ``preds`` (column ``pred``) take part. Statements with a
    null part or without a date are ignored. Of several statements by the same
    atom at one instant the greatest value counts.
    """
    said = (
        atoms.where(F.col("created_at").isNotNull() & (F.size("triples") > 0))
        .select("id", F.unix_micros("created_at").alias("at"), F.explode("triples").alias("t"))
        .select("id", "at", plain_name(F.col("t.subj")).alias("subj"), plain_name(F.col("t.pred")).alias("pred"), plain_name(F.col("t.obj")).alias("obj"))
        .where(F.col("obj").isNotNull() & F.col("subj").isNotNull())
    )
    wanted = preds.select(plain_name(F.col("pred")).alias("pred")).where(F.col("pred").isNotNull()).distinct()
    return (
        said.join(wanted, "pred", "left_semi")
        .groupBy("subj", "pred", "at")
        .agg(F.max(F.struct("id", "obj"))["obj"].alias("obj"))
    )


def _bits(word: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftrightunsigned", word, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def versions(said: DataFrame) -> DataFrame:
    """History of every attribute: ``subj, pred, obj, valid_from_us, valid_to_us``.

    ``said`` has one row per (subj, pred, at) with the value ``obj`` (see
    :func:`statements`). A value that is repeated makes no new version; one that
    returns later does. ``valid_to_us`` is -1 for the version that still holds.
    An attribute with very many snapshots is spread over several range
    partitions, and its bitmap words over all tasks.
    """
    by_time = [F.col("at").asc()]
    laid = range_laid(said.select("subj", "pred", "at", "obj"), _KEYS, by_time)
    dated = cut(
        running_total(laid, _KEYS, by_time, F.lit(1).cast("long"), "ord")
        .withColumn("ord", F.col("ord") - 1)
        .select("_part", "subj", "pred", "obj", "at", "ord", F.floor(F.col("ord") / BITS).cast("long").alias("block"))
    )
    bit = F.expr(f"shiftleft(1L, cast(ord % {BITS} as int))")
    words = dated.groupBy("subj", "pred", "block", "obj").agg(F.bit_or(bit).alias("word"))
    # a word whose first bit is set goes on from the word before it if that one's last bit is set
    carry = words.where(F.col("word") < 0).select("subj", "pred", (F.col("block") + 1).alias("block"), "obj", F.lit(1).cast("long").alias("_on"))
    words = words.join(carry, ["subj", "pred", "block", "obj"], "left")
    first = F.col("word").bitwiseAND(F.bitwise_not(F.shiftleft("word", 1).bitwiseOR(F.coalesce("_on", F.lit(0).cast("long")))))
    starts = words.withColumn("_first", first).where(F.col("_first") != 0).select(
        "subj", "pred", F.explode(_bits(F.col("_first"))).alias("_b"), "block"
    ).select("subj", "pred", (F.col("block") * BITS + F.col("_b")).alias("ord"))
    begun = dated.join(starts, ["subj", "pred", "ord"])
    return next_value(begun, _KEYS, F.col("at"), "valid_to_us").select(
        "subj", "pred", "obj", F.col("at").alias("valid_from_us"), F.coalesce("valid_to_us", F.lit(-1).cast("long")).alias("valid_to_us")
    )


def next_value(laid: DataFrame, keys: list[str], by: Column, out: str) -> DataFrame:
    """The following row's ``by`` per key, over rows that still carry the ``_part`` of :func:`range_laid`."""
    rows = laid.withColumn("_by", by)
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy("_part", *keys).agg(F.min("_by").alias("_first")).withColumn("_after", F.min("_first").over(ahead)).drop("_first")
    inside = Window.partitionBy("_part", *keys).orderBy("_by")
    return (
        rows.withColumn("_in", F.lead("_by").over(inside))
        .join(firsts, ["_part", *keys])
        .withColumn(out, F.coalesce("_in", "_after"))
        .drop("_by", "_in", "_after", "_part")
    )
