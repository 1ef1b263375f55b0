"""Golden rows of encoders' behaviour, and the planner's promise."""

import pytest
from pyspark.sql import functions as F

from sonoframe.functions import delivery as D
from sonoframe.functions import text as X
from sonoframe.operators import catalog, planner

# Measured MP3 output (rate, channels, kbps asked, rate written, kbps written).
MP3 = [
    (44100, 2, 64, 24000, 64), (44100, 2, 96, 32000, 96), (44100, 2, 128, 44100, 128), (44100, 2, 320, 44100, 320), (48000, 2, 64, 24000, 64), (48000, 2, 128, 48000, 128),
    (32000, 2, 320, 32000, 320), (22050, 2, 128, 22050, 128), (22050, 2, 192, 22050, 160), (22050, 2, 320, 22050, 160), (16000, 2, 64, 16000, 64), (16000, 2, 192, 16000, 160),
    (16000, 1, 192, 16000, 160), (11025, 2, 64, 11025, 64), (8000, 2, 128, 8000, 64), (44100, 1, 64, 44100, 64), (44100, 1, 128, 44100, 128),
]
# Measured Vorbis limits (channels, rate, lowest kbps, highest kbps).
VORBIS = [
    (1, 8000, 8, 42), (2, 8000, 12, 84), (1, 11025, 12, 50), (2, 11025, 16, 100), (1, 12000, 12, 50), (2, 12000, 16, 100), (1, 16000, 16, 100), (2, 16000, 24, 200), (1, 22050, 16, 90), (2, 22050, 30, 180),
    (1, 24000, 16, 90), (2, 24000, 30, 180), (1, 32000, 30, 190), (2, 32000, 36, 380), (1, 44100, 32, 240), (2, 44100, 45, 500), (1, 48000, 32, 240), (2, 48000, 45, 500), (3, 48000, 96, 720), (6, 48000, 84, 1440),
    (3, 8000, 24, 126), (3, 16000, 48, 300), (3, 22050, 48, 270), (3, 32000, 90, 570), (6, 8000, 48, 252), (6, 16000, 96, 600), (6, 22050, 96, 540), (6, 32000, 180, 1140),
]


def test_mp3_rows(spark):
    df = spark.createDataFrame(MP3, "rate int, ch int, kbps int, to_rate int, to_kbps int")
    rate, kbps = D.mp3_output(F.col("rate"), F.col("kbps"), F.col("ch"))
    assert df.where((rate != F.col("to_rate")) | (kbps != F.col("to_kbps"))).count() == 0


def test_vorbis_rows(spark):
    df = spark.createDataFrame(VORBIS, "ch int, rate int, low int, high int")
    low, high = D.vorbis_range(F.col("rate"), F.col("ch"))
    assert df.where((low != F.col("low")) | (high != F.col("high"))).count() == 0


def test_every_route_fits(spark):
    rows = [(f"{d}/{c}/{k}/{m}", m * 60.0, m * 60 * 176400, "wav", d, c, k, 44100, 2) for d, x in planner.DESTINATIONS.items() for c in x[0] for k in ("speech", "music") for m in (1, 5, 12, 20, 45, 90, 180, 360)]
    routes = planner.routes(spark.createDataFrame(rows, "id string, seconds double, source_bytes long, source_ext string, destination string, ceiling string, kind string, sample_rate int, channels int"))
    assert routes.where("route != 'escape' AND part_bytes > budget").count() == 0
    assert planner.recommend(routes).count() == len(rows)


def test_scalar_text(spark):
    one = spark.range(1)
    row = one.select(
        X.timecode(F.lit(6.05)).alias("a"), X.timecode(F.lit(3725.5)).alias("b"), X.timecode(F.lit(float("nan"))).alias("c"), X.duration(F.lit(59.7)).alias("d"), X.parse_timecode(F.lit("01:02:03.25")).alias("e"),
        X.parse_timecode(F.lit("1:2:3:4")).alias("f"), X.file_size(F.lit(1536)).alias("g"), X.base_name(F.lit("a/b.c.mp3")).alias("h"), X.extension(F.lit(".hidden")).alias("i"), X.output_name(F.lit("song-trimmed.mp3"), "trimmed", "wav").alias("j"),
        X.db_label(F.lit(-6.5)).alias("k"), X.rate_label(F.lit(44100)).alias("l"), X.scrub(F.lit("lost Voice Memo 3.m4a")).alias("m"), X.subtitle_time(F.lit(2.9996)).alias("n"), X.part_name(F.lit("x"), F.lit(3), F.lit(12)).alias("o"),
        X.title(F.lit("set_output_format")).alias("p"),
    ).first()
    assert list(row) == ["0:06.05", "1:02:05.50", "0:00.00", "1:00", 3723.25, None, "1.5 KB", "b.c", "", "song-trimmed.wav", "−6.5 dB", "44.1 kHz", X.REDACTED, "00:00:03,000", "x-part-03-of-12", "Set output format"]


def test_agent_parameters():
    manifest = [{"key": "threshold", "type": "number", "min": -70, "max": -20}, {"key": "fade", "type": "boolean"}, {"key": "mode", "type": "string", "enum": ["keep", "cut"]}]
    used, ignored = catalog.coerce(manifest, {"threshold": -90, "fade": "yes", "mode": "cut", "other": 1})
    assert used == {"threshold": -70, "mode": "cut"} and ignored == ["fade", "other"]
    assert catalog.coerce(manifest, {"threshold": float("nan")}) == ({}, ["threshold"])
    assert catalog.parameter_schema(manifest)["additionalProperties"] is False
