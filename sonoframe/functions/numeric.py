"""Column arithmetic of the signal operators: levels, rounding and ranks with defined edge cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LUFS_OFFSET = -0.691
SILENCE_DB = float("-inf")


def round_half_up(x: Column) -> Column:
    """Rounds to a long, halves toward positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def amplitude_db(x: Column, floor: float = SILENCE_DB) -> Column:
    """20 log10 of an amplitude, not under `floor`; 0 and below give `floor`."""
    return F.when(x > 0, F.greatest(F.lit(floor), 20 * F.log10(x))).otherwise(F.lit(floor))


def power_lufs(p: Column) -> Column:
    """Loudness of a weighted mean square."""
    return F.when(p > 0, F.lit(LUFS_OFFSET) + 10 * F.log10(p)).otherwise(F.lit(SILENCE_DB))


def db_factor(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)


def clamp(x: Column, low: float, high: float) -> Column:
    """Held to [low, high]; NaN and null become `low`."""
    return F.when(x.isNull() | F.isnan(x), F.lit(low)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), x)))


def share_of_range(x: Column, low: float, high: float) -> Column:
    """Where x lies between low and high, in percent, held to 0 to 100."""
    return F.lit(0.0) if low == high else clamp((x - low) / (high - low) * 100, 0.0, 100.0)


def fade_gain(t: Column, curve: str) -> Column:
    """Gain at the share t of a fade."""
    return {"linear": t, "exp": t * t, "log": F.sqrt(t), "scurve": t * t * (3 - 2 * t)}[curve]


def semitone_ratio(n: Column) -> Column:
    return F.pow(F.lit(2.0), n / 12)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the values at share * (n - 1) of the sorted list, the place rounded: ranks are picked, never interpolated.

    Equal values are counted before they are ranked, so the shuffle carries distinct values only.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    ranked = counted.withColumn("_to", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(whole))
    at = {name: F.floor(F.lit(share) * (F.col("_all") - 1) + 0.5) for name, share in shares.items()}
    inside = {name: (F.col("_to") > k) & (F.col("_to") - F.col("_n") <= k) for name, k in at.items()}
    return ranked.groupBy(*keys).agg(*[F.max(F.when(inside[name], F.col(value))).alias(name) for name in shares])
