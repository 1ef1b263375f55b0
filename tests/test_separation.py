"""Separation by chunks on many tasks equals the kernel over the whole clip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.frame import AudioFrame
from sonoframe.kernels import demix

SIZES = (256, 64, 129, 33)  # 2,048 samples a chunk, 1,792 made by each
RATE = 8000


def low_half(z):
    out = z.copy()
    out[:, 40:] = 0
    return out


def sound(frame, clip):
    rows = frame.blocks.where(F.col("clip_id") == clip).orderBy("channel", "start").collect()
    return np.stack([np.concatenate([r.samples for r in rows if r.channel == c]) for c in range(2)])


def test_chunks_equal_the_whole(spark):
    rng = np.random.default_rng(7)
    clips = {k: (RATE, [rng.normal(scale=0.2, size=n).astype(np.float32) for _ in range(channels)]) for k, n, channels in (("long", 70_001, 2), ("one", 1792, 2), ("short", 50, 2), ("mono", 9000, 1))}
    frame = AudioFrame.from_arrays(spark, clips)
    stem, same = frame.separate(low_half, *SIZES, rate=RATE), frame.separate(lambda z: z, *SIZES, rate=RATE)
    assert stem.blocks.where("clip_id = 'long' AND channel = 0").count() == 40
    for k, (_, x) in clips.items():
        mix = np.stack(x if len(x) == 2 else x * 2).astype(np.float64)
        assert np.abs(sound(same, k) - mix).max() < 1e-6
        assert np.abs(sound(stem, k) - demix.demix(mix, low_half, *SIZES)).max() < 1e-6
    rest = frame.set_channels(2).rest(stem)
    for k in ("long", "short"):
        assert np.abs(sound(rest, k) + sound(stem, k) - np.stack(clips[k][1])).max() < 1e-6


def test_clips_made_in_a_task_are_separated_there(spark, sf_dir):
    """For stem_levels: where a clip's blocks follow one another in one task, no sample is shuffled, and chunks are the same."""
    from sonoframe.plans import audio

    frame = audio.clips(spark, sf_dir)
    dealt = AudioFrame(frame.clips, frame.blocks.where("clip_id IN ('s1', 's2')"))
    here, there = (f.separate(low_half, *SIZES, rate=RATE) for f in (frame, dealt))
    plan = [line for line in here.levels()._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert plan and not any("samples" in line for line in plan) and "FlatMapCoGroups" not in here.blocks._jdf.queryExecution().executedPlan().toString()
    order = ["clip_id", "channel", "start"]
    rows = [[(r.clip_id, r.channel, r.block_idx, r.start, r.samples) for r in f.blocks.where("clip_id IN ('s1', 's2')").orderBy(*order).collect()] for f in (here, there)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 * 2 * 18
    levels = [{r.clip_id: (r.peak, r.rms) for r in f.levels().where("clip_id IN ('s1', 's2')").collect()} for f in (here, there)]
    assert levels[0].keys() == levels[1].keys() and all(levels[0][k] == pytest.approx(levels[1][k]) for k in ("s1", "s2"))
    few = spark.createDataFrame([("e", k, np.zeros(0, np.float32).tolist()) for k in (0, 1)], "clip_id string, channel int, samples array<float>").selectExpr("clip_id", "channel", "0 AS block_idx", "0L AS start", "samples")
    empty = AudioFrame(frame.clips.limit(1).selectExpr("'e' AS clip_id", *[c for c in frame.clips.columns if c != "clip_id"]), few.coalesce(1), RATE)
    assert empty.separate(low_half, *SIZES, rate=RATE).blocks.count() == 0
