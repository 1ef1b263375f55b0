"""Short-time spectra, pitch classes and keys."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


@lru_cache(16)
def hann(n: int, periodic: bool = True) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else max(1, n - 1)))


def stft(x: np.ndarray, size: int, hop: int, keep: int | None = None) -> np.ndarray:
    """(frames, bins) of a signal padded by reflection: len // hop + 1 frames centred on multiples of hop."""
    pad = size // 2
    x = np.asarray(x, float)
    if len(x) > pad:
        padded = np.concatenate([x[pad:0:-1], x, x[-2 : -pad - 2 : -1]])
    elif len(x) > 1:
        period = 2 * (len(x) - 1)
        index = np.abs(np.arange(-pad, len(x) + pad)) % period
        padded = x[np.where(index >= len(x), period - index, index)]
    else:
        padded = x[np.zeros(len(x) + 2 * pad, int)]
    frames = len(x) // hop + 1
    if (frames - 1) * hop + size > len(padded):
        padded = np.pad(padded, (0, (frames - 1) * hop + size - len(padded)), "edge")
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:frames] * hann(size), axis=1)[:, :keep]


def _overlapped(frames: np.ndarray, n: int, hop: int) -> np.ndarray:
    """The sum of n frames, or n times one, that begin `hop` after one another; added in their order."""
    size = frames.shape[1]
    out = np.zeros(size + hop * (n - 1))
    if size % hop:
        for k in range(n):
            out[k * hop : k * hop + size] += frames[k % len(frames)]
        return out
    cells, parts = out.reshape(-1, hop), frames.reshape(len(frames), size // hop, hop)
    for j in range(size // hop - 1, -1, -1):
        cells[j : j + n] += parts[:, j]
    return out


def istft(spectrum: np.ndarray, size: int, hop: int, length: int) -> np.ndarray:
    """The signal of a short-time spectrum: overlap-add over the sum of squared windows; bins left out count as 0."""
    frames = np.fft.irfft(spectrum, size, axis=1)
    frames *= hann(size)
    norm = _overlapped((hann(size) ** 2)[None], len(frames), hop)
    added = _overlapped(frames, len(frames), hop)
    whole = np.divide(added, norm, out=np.zeros_like(added), where=norm > 1e-11)[size // 2 :]
    return np.pad(whole, (0, max(0, length - len(whole))))[:length]


def average_spectrum(x: np.ndarray, size: int = 4096, most: int = 64) -> np.ndarray:
    """Mean magnitude over at most `most` evenly spread windows."""
    last = len(x) - size
    if last < 0:
        return np.zeros(size // 2 + 1)
    n = max(1, min(most, last // size + 1))
    starts = [0] if n == 1 else [last * k // (n - 1) for k in range(n)]
    return np.mean([np.abs(np.fft.rfft(x[s : s + size] * hann(size))) for s in starts], axis=0)


def share_above(magnitudes: np.ndarray, rate: float, hz: float) -> float:
    total = magnitudes[1:].sum()
    bins = np.arange(1, len(magnitudes))
    return float(magnitudes[1:][bins * rate / (2 * (len(magnitudes) - 1)) > hz].sum() / total) if total > 0 else 0.0


def chroma(x: np.ndarray, rate: float, size: int = 8192, low: float = 65.0, high: float = 2000.0) -> np.ndarray:
    """Shares of the twelve pitch classes in the magnitudes between two frequencies; all 0 for a clip shorter than a window."""
    hop = size // 2
    bins = np.arange(max(1, math.floor(low * size / rate)), min(size // 2, math.ceil(high * size / rate)))
    cls = np.floor(69 + 12 * np.log2(bins * rate / size / 440) + 0.5).astype(int) % 12
    out = np.zeros(12)
    x = np.asarray(x, np.float64)
    for start in range(0, len(x) - size + 1, hop):
        out += np.bincount(cls, np.abs(np.fft.rfft(x[start : start + size] * hann(size)))[bins], 12)
    return out / out.sum() if out.sum() > 0 else out


# Probe-tone ratings of Krumhansl and Kessler, from the tonic upwards.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
# Names of pitch classes, and the tonics whose keys are written with flats.
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
FLAT_TONICS = {"major": (1, 3, 5, 8, 10), "minor": (3, 10)}
# The wheel of keys that mix, by tonic.
CAMELOT = {"major": (8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1), "minor": (5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10)}


def key_name(tonic: int, mode: str) -> str:
    return f"{(FLATS if tonic in FLAT_TONICS[mode] else SHARPS)[tonic]} {mode}"


def camelot(tonic: int, mode: str) -> str:
    return f"{CAMELOT[mode][tonic]}{'B' if mode == 'major' else 'A'}"


def rank_keys(weights: np.ndarray) -> list[tuple[float, int, str]]:
    """(score, tonic, mode) of all 24 keys, best first; of equals, the lower tonic and major first."""
    out = []
    centred = np.asarray(weights, float) - np.mean(weights)
    for tonic in range(12):
        for mode, profile in (("major", MAJOR), ("minor", MINOR)):
            p = np.roll(profile, tonic) - np.mean(profile)
            scale = math.sqrt(float(centred @ centred) * float(p @ p))
            out.append((float(centred @ p) / scale if scale > 0 else 0.0, tonic, mode))
    return sorted(out, key=lambda k: -k[0])


def key_confidence(ranked: list[tuple[float, int, str]]) -> float:
    return min(1.0, max(0.0, (ranked[0][0] - ranked[1][0]) / 0.15))
