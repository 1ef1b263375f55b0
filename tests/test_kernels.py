import math

import numpy as np
import pytest

from sonoframe.kernels import filters, loudness, sampling, spectrum


def noise(n, seed):
    out, state = np.empty(n), seed
    for i in range(n):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = state / 2**31 - 1
    return out


def material(seconds, rate, channels, seed=1):
    n = round(seconds * rate)
    hiss = noise(n * channels, seed).reshape(channels, n)
    i = np.arange(n)
    t = i / rate
    crest = np.where((t > 2) & (t < 2.5), 0.97 * np.sin(np.pi * i / 2 + np.pi / 4), 0)
    return [(np.where(t % 9 > 7.5, 1e-4, 1.0) * ((0.15 + 0.6 * np.abs(np.sin(t * 0.7 + c))) * (0.5 * np.sin(2 * np.pi * 220 * (c + 1) * t) + 0.3 * hiss[c])) + crest).astype(np.float32) for c in range(channels)]


@pytest.mark.parametrize("args, pins, blocks", [
    ((12, 44100, 2, 1), (-6.693518593142058, 8.75199440003512, 4.390764553859051, 2.155507238881984), 117),
    ((10, 8000, 6, 7), (-2.044076083988819, 8.344229108829294, 4.533424738692302, 2.154650839550078), 97),
])
def test_loudness_pins(args, pins, blocks):
    found = loudness.measure(material(*args), args[1])
    assert [found[k] for k in ("integrated", "range", "true_peak", "peak")] == pytest.approx(pins, rel=1e-9)
    assert len(found["momentary"]) == blocks


def test_loudness_edges():
    silent = loudness.measure([np.zeros(132300, np.float32)] * 2, 44100)
    assert silent["integrated"] == -math.inf and silent["range"] == 0 and loudness.normalizing_gain_db(silent) == 0
    short = loudness.measure(material(0.3, 44100, 2, 5), 44100)
    assert math.isfinite(short["integrated"]) and short["range"] == 0


@pytest.mark.parametrize("phase", [math.pi / 4, math.pi / 3])
def test_true_peak_between_samples(phase):
    i = np.arange(48000)
    ramp = np.minimum(1, np.minimum(i, 47999 - i) / 480)
    db = 20 * math.log10(sampling.true_peak((0.5 * ramp * np.sin(2 * np.pi * 12000 * i / 48000 + phase)).astype(np.float32)))
    assert -6.42 < db < -5.82


def test_biquad_in_pieces_and_against_recursion():
    x, f = noise(5000, 3), filters.equalizer("peaking", 44100, 1000, 6)
    whole, _ = filters.biquad(x, f)
    state, parts = None, []
    for a in range(0, 5000, 997):
        y, state = filters.biquad(x[a : a + 997], f, state)
        parts.append(y)
    assert np.abs(np.concatenate(parts) - whole).max() < 1e-12
    x1 = x2 = y1 = y2 = 0.0
    for v, y in zip(x, whole):
        w = f.b0 * v + f.b1 * x1 + f.b2 * x2 - f.a1 * y1 - f.a2 * y2
        x2, x1, y2, y1 = x1, v, y1, w
        assert abs(w - y) < 1e-10


def test_equalizer_response():
    rate = 44100
    db = filters.response_db([filters.equalizer("peaking", rate, 1000, 6, 1.0)], rate, np.array([20, 1000, 20000]))
    assert db == pytest.approx([0, 6, 0], abs=0.1)
    assert filters.response_db([filters.equalizer("lowshelf", rate, 200, -9)], rate, np.array([10.0]))[0] == pytest.approx(-9, abs=0.1)


def test_stft_round_trip_and_parseval():
    x = noise(5000, 9)
    s = spectrum.stft(x, 1024, 256)
    assert s.shape == (5000 // 256 + 1, 513)
    assert np.abs(spectrum.istft(s, 1024, 256, 5000) - x).max() < 1e-12


def tone(hz, seconds, rate=22050):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.exp(-1.1 * t) * np.sin(2 * np.pi * hz * k * t) / k for k in (1, 2, 3, 4))


def chord(root, kind, seconds=1.5):
    steps = (0, 4, 7) if kind == "major" else (0, 3, 7)
    return sum(tone(261.63 * 2 ** ((root + s) / 12), seconds) for s in steps)


@pytest.mark.parametrize("root", range(12))
def test_major_keys(root):
    x = np.concatenate([chord((root + s) % 12, k) for s, k in ((0, "major"), (7, "major"), (9, "minor"), (5, "major"))])
    best = spectrum.rank_keys(spectrum.chroma(x, 22050))[0]
    assert best[1:] == (root, "major")


@pytest.mark.parametrize("root", range(0, 12, 2))
def test_minor_keys(root):
    x = np.concatenate([chord((root + s) % 12, k) for s, k in ((0, "minor"), (5, "minor"), (7, "major"), (0, "minor"))])
    assert spectrum.rank_keys(spectrum.chroma(x, 22050))[0][1:] == (root, "minor")


def test_key_names():
    assert spectrum.key_name(10, "minor") == "Bb minor" and spectrum.key_name(6, "major") == "F# major" and spectrum.key_name(9, "minor") == "A minor"
    assert spectrum.camelot(0, "major") == "8B" and spectrum.camelot(9, "minor") == "8A"


def test_resample_keeps_a_tone():
    t = np.arange(44100) / 44100
    y = sampling.resample(np.sin(2 * np.pi * 440 * t), 44100, 48000)
    assert len(y) == 48000
    assert np.abs(y[500:-500] - np.sin(2 * np.pi * 440 * np.arange(48000) / 48000)[500:-500]).max() < 1e-4
    assert np.array_equal(sampling.resample(t, 8000, 11025), np.concatenate([sampling.resample(t, 8000, 11025, piece=997)]))


@pytest.mark.parametrize("rate, to", [(8000, 11025), (44100, 48000), (48000, 8000), (8000, 8001), (96000, 1000)])
def test_resampling_by_phases(rate, to, monkeypatch):
    """For resampled: weights between whole rates are worked out once, not for each sample; every sample is as with weights of its own."""
    reached, made = sampling._reached, []
    x = np.random.default_rng(5).normal(size=100_003).astype(np.float32)
    odd = x.copy()
    odd[[700, 60_000]] = np.inf, np.nan
    n = len(sampling.resample(x, rate, to))
    sampling._phases.cache_clear()
    monkeypatch.setattr(sampling, "_reached", lambda centre, scale: made.append(len(centre)) or reached(centre, scale))
    found = [sampling.resample(s, rate, to, length) for s, length in ((x, None), (x, None), (x, n + 999), (x, n // 2))]
    assert sum(made) <= n / 4
    scale = min(1.0, to / rate) * sampling.ROLLOFF
    with np.errstate(invalid="ignore"):
        whole = [sampling._between(s, 0, n, rate / to, scale) for s in (x, odd)]
        got = sampling.resample(odd, rate, to)
    assert all(np.abs(a[:n] - whole[0][: len(a)]).max() < 1e-6 for a in found)
    assert [len(a) for a in found] == [n, n, n + 999, n // 2] and not found[2][n + int(sampling.CROSSINGS / scale * to / rate) + 2 :].any()
    assert np.array_equal(np.isfinite(got), np.isfinite(whole[1])) and np.abs(got - whole[1])[np.isfinite(got)].max() < 1e-6


def test_all_int16_values_survive():
    k = np.arange(-32768, 32768)
    floats = np.where(k < 0, k / 32768, k / 32767)
    assert np.array_equal(sampling.to_int16(floats), k)
    assert (sampling.to_int16(k / 32768) != k).sum() <= 16384 and sampling.fits_16_bits(k / 32768)


def test_echo_tail():
    assert filters.echo_tail(0.4, 0) == 0.4 and filters.echo_tail(0.3, 0.99) == filters.echo_tail(0.3, 0.85)
    assert len(filters.echo(np.ones(100), 100, 0.3, 0.85, 0.5)) == pytest.approx(100 + 100 * filters.echo_tail(0.3, 0.85))
