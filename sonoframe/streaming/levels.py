"""Live levels: windows over a stream of blocks, and over events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import numeric as N


def block_levels(blocks: DataFrame) -> DataFrame:
    """(clip_id, channel, block_idx, peak, db) of each arriving block; stateless, so it appends."""
    v = lambda x: x.cast("double")
    power = F.aggregate("samples", F.lit(0.0), lambda a, x: a + v(x) * v(x)) / F.greatest(F.lit(1), F.size("samples"))
    return blocks.select("clip_id", "channel", "block_idx", F.array_max(F.transform("samples", lambda x: F.abs(v(x)))).alias("peak"), N.amplitude_db(F.sqrt(power)).alias("db"))


def event_levels(events: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, start, rms) of tumbling windows; a window is emitted once the watermark has passed it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, window), F.col(key).alias("key")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return out.select("key", F.col("window.start").alias("start"), "rms")


def quiet_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, stop, n): sessions parted by quiet of at least `gap`."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
