"""Carried state: pieces give what the whole gives, in batch and over a stream with early, late and missing blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe import schema
from sonoframe.frame import AudioFrame, blocks_table
from sonoframe.kernels import filters, loudness, pieces
from sonoframe.operators import gating
from sonoframe.streaming import pieces as streaming

RATE = 11025  # a hop of 1102.5 samples: block edges do not fall together


def sound(seed, seconds=7, channels=2, rate=RATE):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    level = np.where((t % 3) > 2.4, 1e-4, 0.1 + 0.5 * np.abs(np.sin(0.7 * t + seed)))
    return [(level * (0.5 * np.sin(2 * np.pi * 220 * (c + 1) * t) + 0.2 * rng.normal(size=len(t)))).astype(np.float32) for c in range(channels)]


def cuts(n, sizes, seed=0):
    rng, at = np.random.default_rng(seed), 0
    while at < n:
        size = int(rng.integers(1, sizes))
        yield at, min(n, at + size)
        at += size


def test_equalizer_pieces():
    x = np.stack(sound(1))
    bands = [("lowshelf", 100, 6.0, 0.7), ("peaking", 1000, -4.0, 1.1), ("highpass", 40, 0.0, 0.707)]
    whole = pieces.Equalizer(RATE, 2, bands).push(x)
    effect = pieces.Equalizer(RATE, 2, bands)
    assert np.abs(np.concatenate([effect.push(x[:, a:b]) for a, b in cuts(x.shape[1], 5000)], axis=1) - whole).max() < 1e-9


@pytest.mark.parametrize("rate", [8000, 11025, 44100])
def test_cells_make_up_all_blocks(rate):
    x = np.stack(sound(2, 5, 2, rate))
    want = [loudness.weighted(c, rate).astype(np.float64) ** 2 for c in x]
    cells = pieces.LoudnessCells(rate, 2)
    found = [r for a, b in cuts(x.shape[1], 9000, rate) for r in cells.push(x[:, a:b])] + cells.end()
    assert [r[0] for r in found[1:]] == [r[1] for r in found[:-1]] and found[0][0] == 0 and found[-1][1] == x.shape[1]
    for start, stop, energy, peak in found:
        assert energy == pytest.approx(sum(w[start:stop].sum() for w in want), rel=1e-7, abs=1e-12) and peak == np.abs(x[:, start:stop]).max()


def table(spark, clips):
    import pyarrow as pa

    found = pa.concat_tables([blocks_table(k, x, 4096) for k, x in clips.items()])
    return spark.createDataFrame(found).withColumns({"sample_rate": F.lit(RATE), "channels": F.lit(2)})


CLIPS = {"a": sound(3), "b": sound(4, 5.3), "short": [x[:2000] for x in sound(5)], "silent": [np.zeros(9000, np.float32)] * 2}


def check_loudness(cells, clips, names):
    found = {r.key: r for r in gating.cell_loudness(cells.select(F.col("clip_id").alias("key"), F.col("sample_rate").alias("rate"), "start", "stop", "energy", "peak")).collect()}
    assert set(found) == set(names)
    for k in names:
        want = loudness.measure(clips[k], RATE)
        for name in ("integrated", "range", "peak"):
            assert found[k][name] == pytest.approx(want[name], abs=1e-9), (k, name)


def test_batch_loudness_by_cells(spark):
    check_loudness(streaming.loudness_cells(table(spark, CLIPS)), CLIPS, CLIPS)


def drain(spark, parts, tmp_path, make, name):
    """Rows that the stream gives for tables that arrive one after the other."""
    spark.conf.set(*streaming.STORE)
    source = str(tmp_path / "in")
    parts[0].limit(0).write.parquet(source)
    stream = spark.readStream.schema(parts[0].schema).parquet(source)
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_loudness_equals_batch_in_any_order(spark, tmp_path):
    clips = {k: [x[: len(x) // 4096 * 4096] for x in CLIPS[k]] for k in "ab"}
    blocks = table(spark, clips)
    order = F.xxhash64("clip_id", "channel", "block_idx") % 2 == 0  # of neighbouring blocks either comes first
    parts = [blocks.where(F.floor(F.col("block_idx") / 6) == k).where(order if early else ~order) for k in range(4) for early in (True, False)]
    cells = drain(spark, parts, tmp_path, streaming.loudness_cells, "cells_out")
    done = {r.clip_id: r.n for r in cells.groupBy("clip_id").agg(F.max("stop").alias("n")).collect()}
    assert all(0 <= len(clips[k][0]) - done[k] < 1200 for k in "ab")
    check_loudness(cells, {k: [x[: done[k]] for x in clips[k]] for k in "ab"}, "ab")


def test_streamed_sound_with_late_and_missing_blocks(spark, tmp_path):
    clips = {"a": [x[: 20 * 4096] for x in sound(6, 10)]}
    blocks = table(spark, clips)
    missing = (F.col("block_idx") == 3) | ((F.col("block_idx") == 5) & (F.col("channel") == 1))
    parts = [blocks.where(~missing & (F.col("block_idx") < 17)), blocks.where("block_idx = 3"), blocks.where("block_idx >= 17")]
    bands = [("peaking", 1000, -6.0, 1.0)]
    out = drain(spark, parts, tmp_path, lambda b: streaming.streamed(b, lambda r, n: pieces.Equalizer(r, n, bands), patience=4), "sound_out")
    x = np.stack(clips["a"])
    x[:, 3 * 4096 : 4 * 4096] = 0
    x[1, 5 * 4096 : 6 * 4096] = 0
    want = pieces.Equalizer(RATE, 2, bands).push(x)
    for c in range(2):
        rows = out.where(F.col("channel") == c).orderBy("start").collect()
        found = np.concatenate([r.samples for r in rows])
        assert len(found) == 20 * 4096 // schema.BLOCK * schema.BLOCK and np.abs(found - want[c, : len(found)]).max() < 1e-6


def test_in_order_counts_what_is_late_and_filled():
    class Echo:
        def push(self, x):
            return x.copy()

        def end(self):
            return np.zeros((1, 0))

    order = pieces.InOrder(lambda r, n: Echo(), 8000, 1, patience=2)
    one = np.ones(10, np.float32)
    got = [*order.add(10, 0, one), *order.add(20, 0, one)]
    assert not got
    got = order.add(30, 0, one)  # now three wait, and silence stands in for the first
    assert [(a, x.tolist()[0][0]) for a, x in got] == [(0, 0.0), (10, 1.0), (20, 1.0), (30, 1.0)] and order.filled == 10
    assert order.add(0, 0, one) == [] and order.late == 1
    assert order.add(50, 0, one) == [] and [a for a, x in order.end() if x.shape[1]] == [40, 50]


def test_frames_keep_blocks_in_place(spark):
    clips = {k: (RATE, x) for k, x in CLIPS.items()}
    frame = AudioFrame.from_arrays(spark, clips).equalize([("highpass", 100, 0.0, 0.707)])
    rows = frame.blocks.orderBy("clip_id", "channel", "start").collect()
    for k, (_, x) in clips.items():
        for c in range(2):
            found = np.concatenate([r.samples for r in rows if (r.clip_id, r.channel) == (k, c)])
            want = filters.biquad(x[c], filters.equalizer("highpass", RATE, 100, 0.0, 0.707))[0]
            assert len(found) == len(want) and np.abs(found - want).max() < 1e-6
    assert all(r.start == r.block_idx * schema.BLOCK for r in rows)


def test_loudness_by_stretches_equals_the_whole(spark, monkeypatch):
    monkeypatch.setattr(schema, "STRETCH", 2)  # 32,768 samples a block: several stretches a clip
    clips = {"long": (RATE, [np.concatenate([sound(k, 11)[0] for k in (c, c + 5)]) for c in range(2)]), **{k: (RATE, x) for k, x in CLIPS.items()}, "six": (RATE, sound(8, 4, 6))}
    found = {r.clip_id: r for r in AudioFrame.from_arrays(spark, clips).loudness().collect()}
    assert set(found) == set(clips) and found["silent"].integrated == float("-inf")
    for k, (_, x) in clips.items():
        want = loudness.measure(x, RATE)
        for name in ("integrated", "range", "peak", "true_peak"):
            assert found[k][name] == pytest.approx(want[name], abs=1e-9), (k, name)
        assert found[k].momentary == pytest.approx(want["momentary"], abs=1e-4)  # running sums of the whole lose digits where it is quiet
