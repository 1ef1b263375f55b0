"""Queries of the kernels: clips are made from suppliers, one for each, and measured or changed clip by clip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonoframe.frame import AudioFrame
from sonoframe.kernels import classify, demix, filters, mux, sampling, spectrum
from sonoframe.operators import series, votes
from sonoframe.plans.signal import _t, spread
from sonoframe.sources import headers, wav
from sonoframe.streaming import pieces

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RATE, SECONDS = 8000, 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sound(key: int) -> list[np.ndarray]:
    """Two channels: a tone, a softer overtone, and decaying clicks at the clip's own pace."""
    t = np.arange(RATE * SECONDS) / RATE
    beat = 60 / (80 + key % 90)
    tone = 0.2 * np.sin(2 * np.pi * (110 + key % 300) * t)
    since = t % beat
    click = 0.6 * np.exp(-40 * since) * np.sin(2 * np.pi * 900 * since)
    return [(tone + click).astype(np.float32), (tone * 0.5 + click + 0.05 * np.sin(2 * np.pi * 2000 * t)).astype(np.float32)]


def clips(spark, sf_dir) -> AudioFrame:
    keys = spread(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), 64)
    rows = keys.select(
        F.concat(F.lit("s"), "key").alias("clip_id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("container"), F.lit("pcm_f32").alias("codec"), F.lit(RATE).alias("sample_rate"),
        F.lit(2).alias("channels"), F.lit(RATE * SECONDS).cast("long").alias("frames"), F.lit(float(SECONDS)).alias("duration"), F.lit(None).cast("long").alias("source_bytes"),
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sonoframe.frame import blocks_table

        for batch in batches:
            for key in batch.column("key").to_pylist():
                yield from blocks_table(f"s{key}", _sound(key)).to_batches()

    return AudioFrame.making(rows, keys, blocks, RATE)


def _each(frame: AudioFrame, names: str, f) -> "DataFrame":  # noqa: F821
    """One row (clip_id, *names) of each clip; f(channels, rate) gives the values."""
    kinds = [pa.string(), *[{"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in names.split(", ")]]
    columns = ["clip_id", *[x.split()[0] for x in names.split(", ")]]

    def run(clip_id: str, rate: int, channels: list[np.ndarray]) -> pa.Table:
        return pa.table([pa.array([v], k) for v, k in zip([clip_id, *f(channels, rate)], kinds)], names=columns)

    return frame._per_clip(run, f"clip_id string, {names}")


@query()
def clip_loudness(spark, sf_dir):
    return clips(spark, sf_dir).loudness()


@query("SELECT 's' || s_suppkey AS clip_id, (80 + s_suppkey % 90)::BIGINT AS bpm, 60 / (80 + s_suppkey % 90)::DOUBLE < .5 AS fast, 0::BIGINT AS beats_off FROM supplier")
def clip_tempo(spark, sf_dir):
    """Clicks at each clip's pace, from its beginning on: beats a minute, whether a beat is under half a second, and how far the grid is off the clicks, in twentieths of a second."""
    off = F.pmod(F.col("beat_offset") + F.col("beat_period") / 2, F.col("beat_period")) - F.col("beat_period") / 2
    return clips(spark, sf_dir).tempo().select("clip_id", F.round("bpm").cast("long").alias("bpm"), (F.round("beat_period", 3) < 0.5).alias("fast"), F.abs(F.round(off * 20)).cast("long").alias("beats_off"))


@query()
def clip_keys(spark, sf_dir):
    return clips(spark, sf_dir).keys()


@query()
def clip_kinds(spark, sf_dir):
    names = ("syllables", "gaps", "consonants", "voiced", "voiced_frames", "on_notes", "held", "beat", "bass", "correlation")

    def measures(xs, r):
        found = classify.measure(xs, r)
        return [found[n] for n in names]

    return votes.classify(_each(clips(spark, sf_dir), ", ".join(f"{n} double" for n in names), measures))


@query()
def true_peaks(spark, sf_dir):
    return _each(clips(spark, sf_dir), "true_peak double, peak double", lambda xs, r: [max(sampling.true_peak(x) for x in xs), float(max(np.abs(x).max() for x in xs))])


@query()
def spectrum_shares(spark, sf_dir):
    return _each(clips(spark, sf_dir), "share double", lambda xs, r: [spectrum.share_above(spectrum.average_spectrum(xs[1]), r, 1500.0)])


@query("SELECT 's' || s_suppkey AS clip_id, true AS round_trip, 32000::BIGINT AS frames FROM supplier")
def stft_round_trip(spark, sf_dir):
    def trip(xs, r):
        back = spectrum.istft(spectrum.stft(xs[0], 1024, 256), 1024, 256, len(xs[0]))
        return [bool(np.abs(back - xs[0]).max() < 1e-6), len(back)]

    return _each(clips(spark, sf_dir), "round_trip boolean, frames long", trip)


@query("SELECT 's' || s_suppkey AS clip_id, 11025 AS sample_rate, 44100::BIGINT AS frames, 4.0::DOUBLE AS duration FROM supplier")
def resampled(spark, sf_dir):
    return clips(spark, sf_dir).resample(11025).clips.select("clip_id", "sample_rate", "frames", "duration")


@query("SELECT 's' || s_suppkey AS clip_id, 48000::BIGINT AS frames FROM supplier")
def stretched(spark, sf_dir):
    return clips(spark, sf_dir).stretch(1.5).clips.select("clip_id", "frames")


@query("SELECT 's' || s_suppkey AS clip_id, 'wav' AS container, 'pcm_s16' AS codec, 8000::BIGINT AS rate, 2::BIGINT AS channels, 4.0::DOUBLE AS seconds, 128000::BIGINT AS audio_bytes FROM supplier")
def wav_headers(spark, sf_dir):
    def run(clip_id: str, rate: int, channels: list[np.ndarray]) -> pa.Table:
        h = headers.inspect(wav.encode(channels, rate, 16))
        return pa.table({"clip_id": [clip_id], **{n: [h[n]] for n in ("container", "codec", "rate", "channels", "seconds", "audio_bytes")}})

    return clips(spark, sf_dir)._per_clip(run, "clip_id string, container string, codec string, rate long, channels long, seconds double, audio_bytes long")


@query("SELECT 's' || s_suppkey AS clip_id, 44100::BIGINT AS rate, 2::BIGINT AS channels, (100 * (100 + s_suppkey % 50))::BIGINT AS audio_bytes, (100 * (107 + s_suppkey % 50))::BIGINT AS adts_bytes FROM supplier")
def muxed_headers(spark, sf_dir):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist():
                packets = [bytes(100 + key % 50)] * 100
                h = headers.inspect(mux.mp4(packets, 44100, 2))
                rows.append({"clip_id": f"s{key}", "rate": h["rate"], "channels": h["channels"], "audio_bytes": h["audio_bytes"], "adts_bytes": len(mux.adts(packets, 44100, 2))})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("clip_id", pa.string()), *[(n, pa.int64()) for n in ("rate", "channels", "audio_bytes", "adts_bytes")]]))

    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")).mapInArrow(run, "clip_id string, rate long, channels long, audio_bytes long, adts_bytes long")


@query("SELECT 's' || s_suppkey AS clip_id, true AS same FROM supplier")
def identity_demix(spark, sf_dir):
    def same(xs, r):
        mix = np.stack(xs).astype(np.float64)
        return [bool(np.abs(demix.demix(mix, lambda z: z, 1024, 256, 513, 33) - mix).max() < 1e-6)]

    return _each(clips(spark, sf_dir), "same boolean", same)


@query("""WITH t AS (SELECT s_suppkey AS k, i, 2 * pi() * i / 8000 AS w FROM supplier, (SELECT unnest(range(32000)) AS i)), b AS (SELECT k, w, 60 / (80 + k % 90)::DOUBLE AS p, w / (2 * pi()) AS s FROM t), c AS (SELECT k, w, s - p * floor(s / p) AS m FROM b),
v AS (SELECT k, .2 * sin((110 + k % 300) * w) AS tone, .6 * exp(-40 * m) * sin(2 * pi() * 900 * m) AS click, w FROM c)
SELECT 's' || k AS clip_id, round(greatest(max(abs(tone + click)), max(abs(tone * .5 + click + .05 * sin(2000 * w)))), 4) AS peak, round(sqrt(avg((pow(tone + click, 2) + pow(tone * .5 + click + .05 * sin(2000 * w), 2)) / 2)), 4) AS rms FROM v GROUP BY k""")
def clip_levels(spark, sf_dir):
    return clips(spark, sf_dir).levels().select("clip_id", F.round("peak", 4).alias("peak"), F.round("rms", 4).alias("rms"))


class _WeightedEnergy:
    """Energy of a sound after K-weighting, piece by piece, in double precision."""

    def __init__(self, rate: float, channels: int):
        self.filters, self.states = filters.k_weighting(rate), [None, None]

    def push(self, samples: np.ndarray) -> list[tuple]:
        x = samples[0]
        for k, f in enumerate(self.filters):
            x, self.states[k] = filters.biquad(x, f, self.states[k])
        return [(0, len(x), float(x @ x), float(np.abs(samples).max(initial=0.0)))]

    def end(self) -> list[tuple]:
        return []


#: The two stages of ITU-R BS.1770 weighting at 48 kHz, as the recommendation prints them (fixed values).
_STAGE_1 = "1.53512485958697 * el.x - 2.69169618940638 * s.x1 + 1.19839281085285 * s.x2 + 1.69065929318241 * s.u1 - 0.73248077421585 * s.u2"
_STAGE_2 = f"({_STAGE_1}) - 2 * s.u1 + s.u2 + 1.99004745483398 * s.y1 - 0.99007225036621 * s.y2"


@query(f"""WITH l AS (SELECT user_id AS key, count(*) AS n, max(abs(value::FLOAT::DOUBLE)) AS peak,
  list({{'x': value::FLOAT::DOUBLE, 'x1': 0::DOUBLE, 'x2': 0::DOUBLE, 'u1': 0::DOUBLE, 'u2': 0::DOUBLE, 'y1': 0::DOUBLE, 'y2': 0::DOUBLE, 'e': 0::DOUBLE}} ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
r AS (SELECT key, n, peak, list_reduce(list_prepend({{'x': 0::DOUBLE, 'x1': 0::DOUBLE, 'x2': 0::DOUBLE, 'u1': 0::DOUBLE, 'u2': 0::DOUBLE, 'y1': 0::DOUBLE, 'y2': 0::DOUBLE, 'e': 0::DOUBLE}}, v),
  lambda s, el: {{'x': el.x, 'x1': el.x, 'x2': s.x1, 'u1': {_STAGE_1}, 'u2': s.u1, 'y1': {_STAGE_2}, 'y2': s.y1, 'e': s.e + pow({_STAGE_2}, 2)}}) AS s FROM l)
SELECT key::VARCHAR AS key, n, round(s.e, 3) AS energy, round(peak, 3) AS peak FROM r""")
def carried_filter(spark, sf_dir):
    """Each user's values as a sound at 48 kHz: K-weighted energy by filters whose state is carried from block to block."""
    s = series.sampled(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    block = F.floor(F.col("i") / 64)  # short blocks, so that state is carried
    listed = s.groupBy(F.col("key").cast("string").alias("clip_id"), block.cast("int").alias("block_idx")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("rows"))
    blocks = listed.select("clip_id", F.lit(0).alias("channel"), "block_idx", (F.col("block_idx").cast("long") * 64).alias("start"), F.transform("rows", lambda r: r["v"].cast("float")).alias("samples"), F.lit(48000).alias("sample_rate"), F.lit(1).alias("channels"))
    cells = pieces.along(blocks, _WeightedEnergy, pieces.Cells)
    return cells.groupBy(F.col("clip_id").alias("key")).agg(F.sum("stop").alias("n"), F.round(F.sum("energy"), 3).alias("energy"), F.round(F.max("peak"), 3).alias("peak"))


@query("""WITH t AS (SELECT s_suppkey AS k, i, 2 * pi() * i / 8000 AS w FROM supplier, (SELECT unnest(range(32000)) AS i)), b AS (SELECT k, w, 60 / (80 + k % 90)::DOUBLE AS p, w / (2 * pi()) AS s FROM t), c AS (SELECT k, w, s - p * floor(s / p) AS m FROM b),
v AS (SELECT k, .2 * sin((110 + k % 300) * w) AS tone, .6 * exp(-40 * m) * sin(2 * pi() * 900 * m) AS click, w FROM c)
SELECT 's' || k AS clip_id, round(.5 * greatest(max(abs(tone + click)), max(abs(tone * .5 + click + .05 * sin(2000 * w)))), 3) AS peak, round(.5 * sqrt(avg((pow(tone + click, 2) + pow(tone * .5 + click + .05 * sin(2000 * w), 2)) / 2)), 3) AS rms FROM v GROUP BY k""")
def stem_levels(spark, sf_dir):
    """Levels of the part that a model of half the strength finds, chunk by chunk."""
    stem = clips(spark, sf_dir).separate(lambda z: 0.5 * z, 1024, 256, 513, 33, rate=RATE)
    return stem.levels().select("clip_id", F.round("peak", 3).alias("peak"), F.round("rms", 3).alias("rms"))


@query("""WITH d AS (SELECT s_suppkey AS key, 2 * pi() * (20 + (s_suppkey * 13) % 20000) / 44100 AS w FROM supplier),
f AS (SELECT *, pow(10, db / 40) AS a, 2 * pi() * hz / 44100 AS w0 FROM (VALUES ('shelf', 100::DOUBLE, 6::DOUBLE, .7::DOUBLE), ('peak', 1000, -4, 1.1), ('pass', 40, 0, .707)) t(kind, hz, db, q)),
c AS (SELECT kind, a, cos(w0) AS c, CASE WHEN kind = 'shelf' THEN sin(w0) / 2 * sqrt(2) ELSE sin(w0) / (2 * q) END AS al FROM f),
k AS (SELECT kind,
  CASE kind WHEN 'shelf' THEN a * (a + 1 - (a - 1) * c + 2 * sqrt(a) * al) WHEN 'peak' THEN 1 + al * a ELSE (1 + c) / 2 END AS b0,
  CASE kind WHEN 'shelf' THEN 2 * a * (a - 1 - (a + 1) * c) WHEN 'peak' THEN -2 * c ELSE -(1 + c) END AS b1,
  CASE kind WHEN 'shelf' THEN a * (a + 1 - (a - 1) * c - 2 * sqrt(a) * al) WHEN 'peak' THEN 1 - al * a ELSE (1 + c) / 2 END AS b2,
  CASE kind WHEN 'shelf' THEN a + 1 + (a - 1) * c + 2 * sqrt(a) * al WHEN 'peak' THEN 1 + al / a ELSE 1 + al END AS a0,
  CASE kind WHEN 'shelf' THEN -2 * (a - 1 + (a + 1) * c) ELSE -2 * c END AS a1,
  CASE kind WHEN 'shelf' THEN a + 1 + (a - 1) * c - 2 * sqrt(a) * al WHEN 'peak' THEN 1 - al / a ELSE 1 - al END AS a2 FROM c)
SELECT key, round(sum(10 * log10((pow(b0 + b1 * cos(w) + b2 * cos(2 * w), 2) + pow(b1 * sin(w) + b2 * sin(2 * w), 2)) / (pow(a0 + a1 * cos(w) + a2 * cos(2 * w), 2) + pow(a1 * sin(w) + a2 * sin(2 * w), 2)))), 4) + 0 AS db FROM d, k GROUP BY key""")
def equalizer_curves(spark, sf_dir):
    """Response in dB at each supplier's frequency of a shelf, a peak and a band filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = [filters.equalizer("lowshelf", 44100, 100, 6.0, 0.7), filters.equalizer("peaking", 44100, 1000, -4.0, 1.1), filters.equalizer("highpass", 44100, 40, 0.0, 0.707)]
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(filters.response_db(bands, 44100, 20.0 + keys * 13 % 20000))], ["key", "db"])

    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")).mapInArrow(run, "key long, db double").withColumn("db", F.round("db", 4) + 0.0)
