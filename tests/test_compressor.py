import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.frame import AudioFrame
from sonoframe.kernels import filters
from sonoframe.operators import readouts

#: threshold, knee, ratio, level in, level out (golden rows, to 0.005 dB)
CURVE = [
    (-20, 6, 4, -17, -17.7411), (-20, 6, 4, -14, -16.5859), (-20, 6, 4, -6, -14.5859), (-20, 6, 4, 0, -13.086),
    (-28, 3, 10, -27, -27.2816), (-28, 3, 10, -25, -26.7754), (-28, 3, 10, -10, -25.2754),
    (-40, 40, 1.5, -30, -30.0488), (-40, 40, 1.5, -10, -10.9609), (-40, 40, 1.5, 0, -3.0359), (-30, 0, 20, -29, -29.9499), (-30, 0, 20, -10, -28.9998),
]
#: threshold, knee, ratio, makeup (golden rows, to 0.005 dB)
MAKEUP = [(-20, 6, 4, 7.8515), (-18, 10, 3, 5.282), (-12, 12, 2, 1.7081), (-28, 3, 10, 14.5652), (-30, 0, 20, 17.0999), (-40, 40, 1.5, 1.8215)]


def test_golden_rows():
    for threshold, knee, ratio, level, out in CURVE:
        assert float(filters.compressor_curve(level, threshold, knee, ratio)) == pytest.approx(out, abs=0.005)
    for threshold, knee, ratio, makeup in MAKEUP:
        assert filters.auto_makeup(threshold, knee, ratio) == pytest.approx(makeup, abs=0.005)
    assert filters.auto_makeup(-20, 6, 1) == pytest.approx(0, abs=0.05)


def test_golden_rows_as_columns(spark):
    rows = spark.createDataFrame([tuple(map(float, r)) for r in CURVE], "t double, k double, r double, db double, out double")
    for row in rows.select("out", readouts.compressor_out(F.col("db"), F.col("t"), F.col("k"), F.col("r")).alias("v")).collect():
        assert row.v == pytest.approx(row.out, abs=0.005)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in MAKEUP], "t double, k double, r double, out double")
    for row in rows.select("out", readouts.auto_makeup(F.col("t"), F.col("k"), F.col("r")).alias("v")).collect():
        assert row.v == pytest.approx(row.out, abs=0.005)


@pytest.mark.parametrize("threshold, knee, ratio", [(-20, 6, 4), (-28, 3, 10), (-40, 40, 1.5), (-30, 0, 20)])
def test_shape(threshold, knee, ratio):
    levels = np.arange(-90, 0.05, 0.1)
    out = filters.compressor_curve(levels, threshold, knee, ratio)
    assert (np.diff(out) > 0).all() and (np.diff(out) < 0.1 + 1e-9).all()
    assert np.allclose(out[levels <= threshold], levels[levels <= threshold])
    top = threshold + knee
    a, b = filters.compressor_curve(np.array([top, top + 6]), threshold, knee, ratio)
    assert (b - a) / 6 == pytest.approx(1 / ratio, abs=1e-9)


def test_settings_are_held():
    curve = filters.compressor_curve
    assert curve(-60, -150, 6, 4) == curve(-60, -100, 6, 4) and curve(-10, -20, 60, 4) == curve(-10, -20, 40, 4) and curve(-10, -20, 6, 50) == curve(-10, -20, 6, 20)


SETTINGS = {"threshold": -24, "knee": 12, "ratio": 6, "makeup": 0.0}


def test_render_is_the_same_however_it_is_cut():
    rng = np.random.default_rng(3)
    sound = rng.normal(scale=0.3, size=(2, 20_011)) * np.repeat(rng.uniform(0, 2, 20_011 // 1000 + 1), 1000)[:20_011]
    whole = np.stack(filters.compress(list(sound), 44100, **SETTINGS))
    assert whole.shape == sound.shape
    for seed in range(4):
        effect, out, at = filters.Compressor(44100, 2, **SETTINGS), [], 0
        sizes = np.random.default_rng(seed)
        while at < sound.shape[1]:
            n = int(sizes.integers(0, (5, 100, 3000, 20_011)[seed] + 1))
            out.append(effect.push(sound[:, at : at + n]))
            at += n
        out.append(effect.end())
        assert np.array_equal(np.concatenate(out, axis=1), whole)
    assert filters.compress([np.zeros(0)], 44100, **SETTINGS)[0].shape == (0,)


def test_steady_levels_settle_on_the_curve():
    t = np.arange(44100 * 2) / 44100
    for level in (-40, -20, -12, -3):
        tone = 10 ** (level / 20) * np.sin(2 * np.pi * 440 * t)
        out = filters.compress([tone], 44100, **SETTINGS)[0][44100:]
        assert 20 * np.log10(np.abs(out).max()) == pytest.approx(float(filters.compressor_curve(level, -24, 12, 6)), abs=0.02)


def test_attack_and_release():
    x = np.concatenate([np.full(22050, 0.01), np.full(22050, 0.9), np.full(66150, 0.01)])
    out = filters.compress([x], 44100, attack=0.01, release=0.2, **SETTINGS)[0]
    gain = 20 * np.log10(out / x)
    low = float(filters.compressor_curve(20 * np.log10(0.9), -24, 12, 6)) - 20 * np.log10(0.9)
    assert abs(gain[:21000]).max() < 1e-9 and gain[44000] == pytest.approx(low, abs=0.01)
    assert gain[22050] < low * 0.3  # the look-ahead has begun before the step
    assert gain[44100 + 8820] == pytest.approx(low * np.exp(-1), abs=0.4) and abs(gain[-1]) < 0.1


def test_frame(spark):
    t = np.arange(40_000) / 8000
    clips = {k: (8000, [(0.9 * np.sin(2 * np.pi * f * t)).astype(np.float32), (0.1 * np.sin(2 * np.pi * f * t)).astype(np.float32)]) for k, f in (("a", 300), ("b", 500))}
    out = AudioFrame.from_arrays(spark, clips).compress(**SETTINGS).blocks.where("channel = 1").orderBy("clip_id", "block_idx").collect()
    for k in "ab":
        found = np.concatenate([r.samples for r in out if r.clip_id == k])
        assert np.allclose(found, filters.compress(clips[k][1], 8000, **SETTINGS)[1], atol=1e-6)
