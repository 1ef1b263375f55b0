"""Measures of a clip that the speech or music vote reads."""

from __future__ import annotations

import numpy as np

from sonoframe.kernels.filters import biquad, equalizer

#: Seconds of a frame, frames of a modulation window, syllable rates in Hz, and pitches that are looked for.
FRAME, WINDOW, SYLLABLES, PITCHES = 0.01, 256, (2.5, 7.0), (70.0, 600.0)
#: Edges of the bands whose rises make the beat, in Hz.
BANDS = (200.0, 800.0, 2000.0)
#: How deep a dip of the difference function must be to be a pitch, and to be one where none is that deep.
DIP, FALLBACK = 0.15, 0.2
#: Seconds of the probes, and how many there are at most.
PROBE, PROBES = 20.0, 3


def frames_of(x: np.ndarray, size: int) -> np.ndarray:
    return x[: len(x) // size * size].reshape(-1, size)


def syllable_swing(level_db: np.ndarray) -> float:
    """Mean amplitude in dB of the level's swings at syllable rates, over half-overlapping Hann windows."""
    if len(level_db) < WINDOW:
        return float("nan")
    starts = np.arange(0, len(level_db) - WINDOW + 1, WINDOW // 2)
    windows = level_db[starts[:, None] + np.arange(WINDOW)]
    hann = np.hanning(WINDOW + 1)[:-1]
    spectrum = np.abs(np.fft.rfft((windows - windows.mean(axis=1, keepdims=True)) * hann, axis=1)) * 2 / hann.sum()
    hz = np.fft.rfftfreq(WINDOW, FRAME)
    inside = (hz >= SYLLABLES[0]) & (hz <= SYLLABLES[1])
    return float(np.sqrt((spectrum[:, inside] ** 2).sum(axis=1)).mean())


def gap_share(levels: np.ndarray, per_group: int = 100) -> float:
    """Mean share of frames, second by second, that are under half the second's mean level."""
    groups = frames_of(levels, per_group)
    return float((groups < groups.mean(axis=1, keepdims=True) / 2).mean()) if len(groups) else float("nan")


def consonants(crossings: np.ndarray, sounding: np.ndarray) -> float:
    """How much the rate of zero crossings varies over sounding frames, relative to its mean."""
    some = crossings[sounding]
    return float(some.std() / some.mean()) if len(some) and some.mean() > 0 else float("nan")


def pitch_track(x: np.ndarray, rate: float, hop: int) -> np.ndarray:
    """Pitch in cents above 440 Hz at every hop, NaN where none is: dips of the normalised difference function (de Cheveigne and Kawahara, 2002)."""
    longest, shortest = int(rate / PITCHES[0]), int(rate / PITCHES[1])
    size = 2 * longest
    out = []
    for at in range(0, len(x) - 2 * size, hop):
        head, whole = x[at : at + size], x[at : at + 2 * size]
        power = np.concatenate([[0.0], np.cumsum(whole * whole)])
        lags = np.arange(longest + 1)
        product = np.fft.irfft(np.fft.rfft(whole, 4 * size) * np.conj(np.fft.rfft(head, 4 * size)), 4 * size)[: longest + 1]
        difference = np.maximum(power[size] - power[0] + power[lags + size] - power[lags] - 2 * product, 0.0)
        total = np.cumsum(difference[1:])
        normal = np.concatenate([[1.0], difference[1:] * lags[1:] / np.maximum(total, 1e-12)])
        part = normal[shortest:]
        deep = np.flatnonzero(part < DIP)
        if len(deep):
            k = deep[0]
            while k + 1 < len(part) and part[k + 1] < part[k]:
                k += 1
        else:
            k = int(part.argmin())
        lag = float(k + shortest)
        if power[size] < 1e-6 * size or part[k] > FALLBACK:
            out.append(np.nan)
            continue
        a, b, c = (normal[int(min(max(lag + d, 0), longest))] for d in (-1, 0, 1))
        if a - 2 * b + c > 0:
            lag += float(np.clip(0.5 * (a - c) / (a - 2 * b + c), -0.5, 0.5))
        out.append(1200 * np.log2(rate / lag / 440))
    return np.array(out)


def notes(cents: np.ndarray, frames_per_second: float) -> tuple[float, float]:
    """(on_notes, held): how closely pitches gather about one tuning of semitones, and the share of pitched frames that stay within 15 cents for 60 ms."""
    found = cents[~np.isnan(cents)]
    if not len(found):
        return float("nan"), float("nan")
    on_notes = float(np.abs(np.exp(2j * np.pi * found / 100).mean()))
    back = max(1, int(np.ceil(0.06 * frames_per_second)))
    both = np.abs(cents[back:] - cents[:-back])
    return on_notes, float((both <= 15).sum() / len(found))


def beat_strength(bands_db: np.ndarray) -> float:
    """The highest correlation of onsets with themselves 0.3 to 1.5 seconds later, at most 1. bands_db: (frames, bands)."""
    onset = np.clip(np.diff(bands_db, axis=0), 0, None).sum(axis=1)
    onset = onset - onset.mean() if len(onset) else onset
    first, last = int(0.3 / FRAME), min(int(1.5 / FRAME), len(onset) - 1)
    energy = float((onset * onset).sum())
    if last <= first or energy <= 0:
        return float("nan")
    size = 1 << (2 * len(onset)).bit_length()
    found = np.fft.irfft(np.abs(np.fft.rfft(onset, size)) ** 2, size)[first : last + 1]
    return float(min(1.0, (found * len(onset) / (len(onset) - np.arange(first, last + 1)) / energy).max()))


def _probe(channels: list[np.ndarray], rate: float) -> dict[str, float]:
    mono = np.mean([np.asarray(x, np.float64) for x in channels], axis=0)
    size = max(1, round(rate * FRAME))
    cut = frames_of(mono, size)
    level = np.sqrt((cut * cut).mean(axis=1))
    level_db = 20 * np.log10(np.maximum(level, 1e-4))
    crossings = (np.diff(np.signbit(cut), axis=1) != 0).sum(axis=1).astype(float)
    low, bands = mono, []
    for hz in reversed(BANDS):
        if hz < rate / 2:
            below = biquad(low, equalizer("lowpass", rate, hz))[0]
            bands.append(low - below)
            low = below
    bands.append(low)
    power = np.stack([(frames_of(b, size) ** 2).mean(axis=1) for b in bands], axis=1)
    step = max(1, int(rate // 8000))
    slow = frames_of(mono, step).mean(axis=1)
    track = pitch_track(slow, rate / step, max(1, round(rate / step * 2 * FRAME)))
    on_notes, held = notes(track, 1 / (2 * FRAME))
    voiced = ~np.isnan(track)
    sounding = level > 0.1 * level.max() if len(level) else level > 0
    total = power.sum()
    both = np.stack([np.asarray(x, np.float64) for x in (channels[0], channels[-1])])
    energy = np.sqrt((both[0] ** 2).sum() * (both[1] ** 2).sum())
    return {
        "syllables": syllable_swing(level_db), "gaps": gap_share(level), "consonants": consonants(crossings, sounding), "voiced": float(voiced.mean()) if len(voiced) else float("nan"),
        "voiced_frames": float(voiced.sum()), "on_notes": on_notes, "held": held, "beat": beat_strength(10 * np.log10(np.maximum(power, 1e-8))),
        "bass": float(power[:, -1].sum() / total) if total > 0 else float("nan"), "correlation": float((both[0] * both[1]).sum() / energy) if energy > 0 else 1.0,
    }


def measure(channels: list[np.ndarray], rate: float) -> dict[str, float | None]:
    """The measures of a clip: medians over a few evenly spread probes, of those that have a value; pitched frames are summed."""
    n, size = len(channels[0]), int(PROBE * rate)
    count = min(PROBES, max(1, n // max(1, size)))
    starts = [int((n - min(n, size)) * k / max(1, count - 1)) for k in range(count)]
    found = [_probe([x[a : a + size] for x in channels], rate) for a in starts]
    out: dict[str, float | None] = {}
    for name in found[0]:
        values = np.array([f[name] for f in found])
        values = values[np.isfinite(values)]
        out[name] = None if not len(values) else float(values.sum() if name == "voiced_frames" else np.median(values))
    return out
