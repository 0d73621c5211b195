"""Time expressions; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saliency(access_count: Column, created_at: Column, now: Column) -> Column:
    """access_count / (age in hours + 1)."""
    hours = (F.unix_micros(now) - F.unix_micros(created_at)) / F.lit(3_600_000_000.0)
    return F.coalesce(access_count, F.lit(0)) / (hours + F.lit(1.0))


def epoch_of(ts: Column, seconds: int) -> Column:
    """Number of the fixed-length epoch that an instant lies in."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def expired(start: Column, now: Column, seconds: int) -> Column:
    return (F.unix_micros(now) - F.unix_micros(start)) > F.lit(seconds * 1_000_000)


def monotonic_micros(df: DataFrame, clock_us: str, seq: str, writer: str | None = None, out: str = "ts_us") -> DataFrame:
    """Strictly increasing microseconds per writer: the clock, or one more than the last value if that is later.

    ``ts[i] = max(clock[i], ts[i-1] + 1)`` has the closed form
    ``i + max over j <= i of (clock[j] - j)``, so a running count and a running
    maximum do it, over range partitions: a busy writer, or all rows of the only
    one, are spread over tasks.
    """
    from palimpsest.operators.skew import range_laid, running

    keys, order = [writer] if writer else [], [F.col(seq).asc()]
    laid = range_laid(df, keys, order)
    counted = running(laid, keys, order, {"_n": F.lit(1).cast("long")}, F.sum)
    return running(counted, keys, order, {"_m": F.col(clock_us) - F.col("_n")}, F.max).withColumn(out, F.col("_n") + F.col("_m")).drop("_n", "_m", "_part")


def wall_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")
