"""Speech or music by weighted votes over measured features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature, weight, shape, from, to, sign, whether enough pitched frames are needed, and the codes it gives as a reason for speech and for music.
VOTES = [
    ("on_notes", 2.5, "ramp", 0.12, 0.35, -1, True, "pitch:glides", "pitch:notes"),
    ("syllables", 1.5, "ramp", 2.5, 5.0, 1, False, "level:syllables", None),
    ("voiced", 1.5, "ramp", 0.15, 0.45, 1, False, "voices:one", "voices:many"),
    ("held", 2.0, "rise", 0.25, 0.45, -1, True, None, "notes:held"),
    ("consonants", 1.0, "ramp", 0.5, 1.1, 1, False, "consonants:many", "consonants:few"),
    ("gaps", 1.0, "ramp", 0.08, 0.22, 1, False, "gaps:many", "gaps:few"),
    ("beat", 1.0, "rise", 0.3, 0.6, -1, False, None, "beat:steady"),
    ("bass", 1.0, "rise", 0.2, 0.45, -1, False, None, "bass:strong"),
    ("width", 1.0, "rise", 0.0, 0.12, -1, False, None, "stereo:wide"),
]
START, SPEECH_AT, MUSIC_AT, PITCH_FRAMES, MONO_CORRELATION, MOST_REASONS = -2.0, 2.5, -1.5, 40, 0.97, 3


def evidence(x: Column, shape: str, low: float, high: float) -> Column:
    """-1 to 1 ('ramp') or 0 to 1 ('rise') between two values; 0 where the feature is not measured."""
    t = (x - low) / (high - low)
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t * 2 - 1)) if shape == "ramp" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), held).otherwise(0.0)


def classify(measures: DataFrame) -> DataFrame:
    """(clip_id, kind, confident, total, reasons) of measured clips: all votes in one projection, reasons ranked in an array."""
    m = measures.withColumn("width", F.lit(MONO_CORRELATION) - F.col("correlation"))
    cast = []
    for k, (name, weight, shape, low, high, sign, pitched, speech, music) in enumerate(VOTES):
        value = evidence(F.col(name), shape, low, high) * sign * weight
        if pitched:
            value = F.when(F.col("voiced_frames") >= PITCH_FRAMES, value).otherwise(0.0)
        cast.append(F.struct(value.alias("value"), F.lit(weight).alias("weight"), F.lit(k).alias("k"), F.lit(speech).cast("string").alias("speech"), F.lit(music).cast("string").alias("music")))
    voted = m.select("clip_id", F.array(*cast).alias("votes")).withColumn("total", F.aggregate("votes", F.lit(START), lambda acc, v: acc + v["value"]))
    speech = F.col("total") >= SPEECH_AT
    sign = F.when(speech, 1.0).otherwise(-1.0)
    for_it = F.filter("votes", lambda v: v["value"] * sign >= v["weight"] * 0.5)
    ranked = F.array_sort(F.transform(for_it, lambda v: F.struct((-v["value"] * sign).alias("order"), v["k"].alias("k"), F.when(speech, v["speech"]).otherwise(v["music"]).alias("reason"))))
    reasons = F.slice(F.filter(F.transform(ranked, lambda r: r["reason"]), lambda r: r.isNotNull()), 1, MOST_REASONS)
    out = voted.withColumn("reasons", reasons)
    unsure = ((F.col("total") < SPEECH_AT) & (F.col("total") > MUSIC_AT)) | (F.size("reasons") == 0)
    return out.select("clip_id", F.when(unsure | ~speech, "music").otherwise("speech").alias("kind"), (~unsure).alias("confident"), "total", F.when(unsure, F.array(F.lit("unsure"))).otherwise(F.col("reasons")).alias("reasons"))
