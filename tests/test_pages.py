"""Edits with the rules of their pages, silence windows, mono reports, replanning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.frame import AudioFrame
from sonoframe.functions import delivery as D
from sonoframe.kernels import edit
from sonoframe.operators import planner, series

RATE = 8000


def test_silence_has_windows_of_20_ms_and_lasts_to_the_end():
    x = np.full(RATE * 3 + 70, 0.5)
    x[RATE : 2 * RATE] = 0.0
    x[int(2.4 * RATE) :] = 0.0
    assert edit.silences([x], RATE) == [(1.0, 2.0), (2.4, len(x) / RATE)]
    x[RATE + 4000 : RATE + 4080] = 0.004  # 10 ms under and 10 ms over one threshold: the window's mean decides
    assert edit.silences([x], RATE, -45.0) == [(1.0, 2.0), (2.4, len(x) / RATE)]
    assert edit.silences([x], RATE, -55.0, 0.3) == [(1.0, 1.5), (1.52, 2.0), (2.4, len(x) / RATE)]
    assert edit.silences([np.zeros(100)], RATE) == [] and edit.silences([np.zeros(0)], RATE) == []
    kept = edit.remove_silence([x], RATE)[0]
    assert len(kept) == len(x) - round(0.84 * RATE) - round((len(x) / RATE - 2.4 - 0.16) * RATE) - 2 * 40


def test_silence_against_window_by_window():
    rng = np.random.default_rng(2)
    level = np.repeat(rng.choice([0.01, 0.5, 30.0], 92), 787)[: 9 * RATE + 33]
    x = np.stack([rng.normal(scale=0.01, size=9 * RATE + 33) * level for _ in range(2)])
    size, threshold, found, begun = 160, 10 ** (-45 / 20), [], None
    for a in [*range(0, x.shape[1], size), None]:
        quiet = a is not None and np.sqrt(np.mean(x[:, a : a + size] ** 2)) < threshold
        if quiet and begun is None:
            begun = a
        elif not quiet and begun is not None:
            stop = x.shape[1] if a is None else a
            if (stop - begun) / RATE >= 0.2:
                found.append((begun / RATE, stop / RATE))
            begun = None
    assert found and edit.silences(list(x), RATE, -45.0, 0.2) == found


def test_ringtones_and_trims():
    x = [np.ones(RATE * 40)]
    tone = edit.ringtone(x, RATE, 2.0, 39.0)[0]
    assert len(tone) == 30 * RATE and tone[0] == 0 and tone[160] == 1 and tone[-2 * RATE - 1] == 1 and tone[-RATE] == pytest.approx(0.25, abs=1e-3)
    assert len(edit.ringtone(x, RATE, 2.0, 39.0, None, None)[0]) == 37 * RATE and edit.ringtone(x, RATE, 2.0, 39.0, None)[0][-161] == 1
    assert edit.ringtone(x, RATE, 0.0, 1.0, 0.05)[0][-1600] < 1  # a tail of at least 0.2 s
    kept = edit.trimmed(x, RATE, 1.0, 2.0)[0]
    assert len(kept) == RATE and kept[0] == 0 and kept[-1] == 0 and kept[160] == 1
    middle = edit.trimmed(x, RATE, 1.0, 2.0, keep=False)[0]
    assert middle[0] == 1 and middle[-1] == 1
    first, last = edit.trimmed(x, RATE, 0.0, 2.0, keep=False)[0], edit.trimmed(x, RATE, 38.0, 40.0, keep=False)[0]
    assert (first[0], first[-1], last[0], last[-1]) == (0, 1, 1, 0) and edit.trimmed(x, RATE, 1.0, 2.0, faded=False)[0].min() == 1


def test_crossfade_is_held_to_half_of_the_shortest():
    parts = [(RATE, [np.ones(RATE)]), (RATE, [np.ones(RATE // 2)])]
    assert len(edit.crossfade_join(parts, 2.0)[1][0]) == RATE + RATE // 2 - RATE // 4
    assert len(edit.crossfade_join(parts, 0.1)[1][0]) == RATE + RATE // 2 - 800 and len(edit.crossfade_join(parts, -1)[1][0]) == RATE + RATE // 2


def test_frames(spark):
    t = np.arange(RATE) / RATE
    tone = (0.25 * np.sin(2 * np.pi * 300 * t)).astype(np.float32)
    frame = AudioFrame.from_arrays(spark, {"a": (RATE, [tone, -tone]), "b": (RATE, [tone[:4000], tone[:4000]])})

    def sound(f, clip):
        rows = f.blocks.where(F.col("clip_id") == clip).orderBy("channel", "block_idx").collect()
        return [np.concatenate([r.samples for r in rows if r.channel == c]) for c in sorted({r.channel for r in rows})]

    assert np.abs(sound(frame.boost("normalize", target_db=-1.0), "a")[0]).max() == pytest.approx(10 ** (-1 / 20), abs=1e-4)
    assert np.abs(sound(frame.boost("gain", 20.0), "a")[0]).max() == 1.0
    small = frame.smaller(mono=True, rate=4000)
    assert len(sound(small, "a")) == 1 and len(sound(small, "a")[0]) == 4000 and np.abs(sound(small, "a")[0]).max() < 1e-6
    assert {r.sample_rate for r in small.clips.collect()} == {4000}
    order = spark.createDataFrame([("j", 0, "a"), ("j", 1, "b")], "joined string, position int, clip_id string")
    assert len(sound(frame.concat(order, 3.0, held=True), "j")[0]) == 8000 + 4000 - 2000
    assert len(sound(frame.ringtone(0.1, 0.6), "a")[0]) == 4000 and len(sound(frame.trimmed(0.25, 0.5), "a")[1]) == 2000


def stereo(spark, channels):
    rows = [(k, i, float(left), float(right)) for k, (ls, rs) in channels.items() for i, (left, right) in enumerate(zip(ls, rs))]
    return spark.createDataFrame(rows, "key string, i long, l double, r double")


def test_mono_report(spark):
    t = np.arange(6000) / RATE
    low, high = np.sin(2 * np.pi * 250 * t), 0.5 * np.sin(2 * np.pi * 2000 * t)
    s = stereo(spark, {"same": (low, low), "against": (low, -low), "left": (low, 0 * low), "mixed": (low + high, low - high), "silent": (0 * low, 0 * low), "short": (low[:100], low[:100])})
    found = {r.key: r for r in series.overall_correlation(series.block_correlation(s, 400)).collect()}
    assert found["same"].overall == pytest.approx(1) and found["against"].overall == pytest.approx(-1) and found["left"].overall == 0 and found["mixed"].overall == pytest.approx(0.6, abs=1e-3)
    assert found["silent"].overall == 0 and found["same"].blocks == 15 and "short" not in found
    bands = {(r.key, r.hz): r for r in series.side_shares(s, RATE, 1024).collect()}
    assert bands["same", 250].share == pytest.approx(0, abs=1e-9) and bands["against", 250].share == pytest.approx(1) and bands["left", 250].share == pytest.approx(0.5)
    assert bands["mixed", 250].share == pytest.approx(0, abs=1e-3) and bands["mixed", 2000].share == pytest.approx(1, abs=1e-3) and bands["mixed", 250].lost == pytest.approx(0.2, abs=1e-3)
    assert bands["same", 4000].share is None and bands["silent", 250].share is None and bands["silent", 250].lost == 0


@pytest.mark.parametrize("n, size, most", [(100, 7, 600), (100, 7, 5), (29, 7, 3), (7, 7, 3), (15, 4, 1), (5000, 13, 48)])
def test_spread_blocks_begin_where_they_should(spark, n, size, most):
    s = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("i"), F.lit(1.0).alias("l"))
    found = {}
    for r in series.spread_blocks(s, size, most).collect():
        found.setdefault(r.b, {})[r.p] = r.i
    blocks = min(most, n // size)
    assert {b: v[0] for b, v in found.items()} == {b: b * (n - size) // max(1, blocks - 1) for b in range(blocks)}
    assert all(sorted(v) == list(range(size)) and [v[p] - v[0] for p in range(size)] == list(range(size)) for v in found.values())


def test_plans_are_cut_anew_near_pauses_until_all_parts_fit(spark):
    plans = spark.createDataFrame([("fits", 600.0, 10_000_000, 1.0), ("over", 1200.0, 5_000_000, 1.0), ("swells", 1200.0, 10_000_000, 1.3), ("never", 1200.0, 3_000_000, 1.0)], "key string, seconds double, budget long, swells double")
    silences = spark.createDataFrame([("over", 590.0, 592.0), ("swells", 399.0, 403.0)], "key string, start double, stop double")
    estimate = lambda s: D.lossy_bytes(s, F.lit(64.0))
    seen = []

    def encode(parts):
        seen.append({r.key: [(x.start, x.stop) for x in sorted(r.spans)] for r in parts.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).collect()})
        return parts.select("key", "part", (F.floor(estimate(F.col("stop") - F.col("start")) * F.col("swells")) + F.when(F.col("key") == "never", 3_500_000).otherwise(0)).alias("bytes"))

    found = {r.key: r for r in planner.encoded_plans(plans, silences, encode, estimate).collect()}
    assert (found["fits"].attempts, found["fits"].parts, found["fits"].fits) == (1, 1, True)
    assert (found["over"].attempts, found["over"].parts) == (1, 2) and seen[0]["over"] == [(0.0, 591.0), (591.0, 1200.0)]
    assert found["swells"].attempts == 2 and found["swells"].fits and found["swells"].parts >= 2 and found["swells"].largest <= 10_000_000
    assert not found["never"].fits and found["never"].attempts == 4
    assert set(seen[1]) == {"swells", "never"} and set(seen[3]) == {"never"}
