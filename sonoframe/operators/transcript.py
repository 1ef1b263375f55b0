"""Transcript segments: repairing times, paragraphs, cues and subtitle files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions import text as X


def repair(chunks: DataFrame, total: str = "total") -> DataFrame:
    """(clip, idx, start, stop, text) of raw chunks (clip, idx, start, stop, text, total) with missing or reversed times.

    A missing start is the end of the segment before (after its own repair), a missing stop the next chunk's start or the
    clip's end; a stop not after its start becomes start + 1.2 s at most the clip's end. Chunks without text go. A
    repaired end may be the next start, so a clip's chunks go through one fold; a clip's transcript is one group.
    """
    ahead = chunks.withColumn("next", F.lead("start").over(Window.partitionBy("clip").orderBy("idx"))).withColumn("text", F.trim("text")).where("text != ''")
    listed = ahead.groupBy("clip", total).agg(F.array_sort(F.collect_list(F.struct("idx", "start", "stop", "next", "text"))).alias("c"))
    empty = F.array().cast("array<struct<idx:int,start:double,stop:double,text:string>>")

    def step(acc: Column, c: Column) -> Column:
        start = F.coalesce(c["start"], F.when(F.size(acc) > 0, F.element_at(acc, -1)["stop"]), F.lit(0.0))
        stop = F.coalesce(c["stop"], c["next"], F.col(total))
        stop = F.when(stop <= start, F.least(F.col(total), start + 1.2)).otherwise(stop)
        return F.concat(acc, F.array(F.struct(c["idx"].cast("int").alias("idx"), start.alias("start"), stop.alias("stop"), c["text"].alias("text"))))

    return listed.select("clip", F.inline(F.aggregate("c", empty, step)))


def paragraphs(segments: DataFrame, gap: float = 2.0) -> DataFrame:
    """(clip, paragraph, text): segments joined by spaces; a pause over `gap` seconds ends a paragraph."""
    order = Window.partitionBy("clip").orderBy("idx")
    pause = F.coalesce((F.col("start") - F.lag("stop").over(order) > gap).cast("int"), F.lit(0))
    marked = segments.withColumn("_p", pause).withColumn("paragraph", F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = marked.groupBy("clip", "paragraph").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("s"))
    return joined.select("clip", "paragraph", F.array_join(F.col("s.text"), " ").alias("text"))


def fast_cues(segments: DataFrame, most: float = 22.0) -> DataFrame:
    """Adds characters per second and whether a cue is too fast to read."""
    speed = F.length("text") / F.greatest(F.lit(0.001), F.col("stop") - F.col("start"))
    return segments.withColumn("cps", speed).withColumn("fast", speed > most)


def _file(segments: DataFrame, cue: Column) -> DataFrame:
    numbered = segments.withColumn("_n", F.row_number().over(Window.partitionBy("clip").orderBy("idx")))
    cues = numbered.select("clip", "_n", cue.alias("_c")).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("_n", "_c"))).alias("_l"))
    return cues.select("clip", F.concat(F.array_join(F.col("_l._c"), "\n\n"), F.lit("\n")).alias("content"))


def to_srt(segments: DataFrame) -> DataFrame:
    return _file(segments, F.concat(F.col("_n").cast("string"), F.lit("\n"), X.subtitle_time(F.col("start")), F.lit(" --> "), X.subtitle_time(F.col("stop")), F.lit("\n"), F.col("text")))


def to_vtt(segments: DataFrame) -> DataFrame:
    body = _file(segments, F.concat(X.subtitle_time(F.col("start"), "."), F.lit(" --> "), X.subtitle_time(F.col("stop"), "."), F.lit("\n"), F.col("text")))
    return body.withColumn("content", F.concat(F.lit("WEBVTT\n\n"), F.col("content")))
