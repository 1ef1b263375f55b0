"""Reconstruction between samples: true peak, resampling; and sample formats."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

PEAK_REACH = 8
CROSSINGS, SHAPE, ROLLOFF, TABLE_STEPS = 16, 8.0, 0.94, 512
#: Output samples whose weights are one matrix, and the weights that are kept of a pair of rates.
PHASES, MOST_WEIGHTS = 64, 1 << 20


@lru_cache(1)
def _peak_phases() -> np.ndarray:
    k = np.arange(-PEAK_REACH + 1, PEAK_REACH + 1)
    d = np.array([0.25, 0.5, 0.75])[:, None] - k
    return np.sinc(d) * (0.5 + 0.5 * np.cos(np.pi * d / PEAK_REACH))


def true_peak(x: np.ndarray, before: int = 0, after: int = 0, piece: int = 1 << 16) -> float:
    """The largest magnitude of the samples and of three points between neighbours, by a 16-tap reconstruction filter.

    Points among the first `before` and the last `after` samples are left out, for stretches of a longer sound whose neighbours hold them.
    """
    x = np.asarray(x, np.float64)
    if not len(x):
        return 0.0
    peak = float(np.abs(x).max())
    first, stop = (before and before - 1), len(x) - 1 - (after and after - 1)  # places of points: each lies behind its sample
    if len(x) < 2 or stop <= first:
        return peak
    padded = np.pad(x, (PEAK_REACH - 1, PEAK_REACH))
    for at in range(first, stop, piece):
        part = padded[at : min(stop, at + piece) + 2 * PEAK_REACH - 1]
        for taps in _peak_phases():
            found = np.convolve(part, taps[::-1], "valid")
            peak = max(peak, float(found.max()), -float(found.min()))
    return peak


@lru_cache(1)
def _kernel() -> np.ndarray:
    t = np.arange(CROSSINGS * TABLE_STEPS + 1)
    table = np.sinc(t / TABLE_STEPS) * np.i0(SHAPE * np.sqrt(1 - (t / t[-1]) ** 2)) / np.i0(SHAPE)
    return np.concatenate([table, [0.0]])


def _reached(centre: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of output samples that lie at these places of the input: the first and the last input sample in reach, and the weights from the first on."""
    table, reach = _kernel(), CROSSINGS / scale
    low, high = np.ceil(centre - reach).astype(np.int64), np.floor(centre + reach).astype(np.int64)
    place = np.abs(centre[:, None] - (low[:, None] + np.arange(int(2 * reach) + 2))) * (scale * TABLE_STEPS)
    k = np.minimum(place.astype(np.int64), len(table) - 2)
    return low, high, table[k] + (table[k + 1] - table[k]) * (place - k)


def _between(x: np.ndarray, at: int, stop: int, step: float, scale: float) -> np.ndarray:
    """Output samples from `at` on, each with weights of its own."""
    low, high, weight = _reached(np.arange(at, stop) * step, scale)
    index = low[:, None] + np.arange(weight.shape[1])
    inside = (index >= 0) & (index < len(x)) & (index <= high[:, None])
    return (np.where(inside, x[np.clip(index, 0, len(x) - 1)], 0.0) * weight).sum(1) * scale


@lru_cache(4)
def _phases(up: int, down: int, scale: float) -> list[tuple[int, np.ndarray]]:
    """The weights of the `up` output samples that come of `down` input samples, PHASES at a time: (first input sample, a matrix from input to output samples)."""
    low, high, weight = _reached(np.arange(up) * down / up, scale)
    found = []
    for a in range(0, up, PHASES):
        lows, highs = low[a : a + PHASES], high[a : a + PHASES]
        matrix = np.zeros((int(highs.max() - lows[0]) + 1, len(lows)))
        for k, (first, last) in enumerate(zip(lows, highs)):
            matrix[first - lows[0] : last - lows[0] + 1, k] = weight[a + k, : last - first + 1] * scale
        found.append((int(lows[0]), matrix))
    return found


def resample(x: np.ndarray, rate: float, to: float, length: int | None = None, piece: int = 1 << 14) -> np.ndarray:
    """A channel at another rate: a windowed sinc with its cutoff under the lower Nyquist, in single precision out.

    Each output sample is a sum over the input alone, so pieces of the output may be worked out anywhere. Between whole rates the weights come again
    after some samples: they are worked out once, and pieces are products of matrices.
    """
    x = np.asarray(x, np.float32)
    n = length if length is not None else max(1, math.floor(len(x) * to / rate + 0.5))
    if rate == to:
        return np.pad(x, (0, max(0, n - len(x))))[:n].astype(np.float32)
    scale = min(1.0, to / rate) * ROLLOFF
    out = np.zeros(n, np.float32)
    if not len(x):
        return out
    if rate == int(rate) and to == int(to):
        common = math.gcd(int(rate), int(to))
        up, down = int(to) // common, int(rate) // common
        if 4 * up <= n and up * (min(up, PHASES) * down / up + 2 * CROSSINGS / scale) <= MOST_WEIGHTS:
            return _by_phases(x, up, down, scale, out)
    for at in range(0, n, piece):
        out[at : at + piece] = _between(x, at, min(n, at + piece), rate / to, scale)
    return out


def _by_phases(x: np.ndarray, up: int, down: int, scale: float, out: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    phases = _phases(up, down, scale)
    size = max(1, min(piece // up, (1 << 20) // max(len(m) for _, m in phases))) * up
    first, last = phases[0][0], max(low + len(m) for low, m in phases)
    for at in range(0, len(out), size):
        part = out[at : at + size]
        rounds, begin = -(-len(part) // up), at // up * down
        sound = np.zeros((rounds - 1) * down + last - first)
        a, b = max(0, begin + first), min(len(x), begin + first + len(sound))
        if b > a:
            sound[a - begin - first : b - begin - first] = x[a:b]
        if not np.isfinite(sound).all():  # a product would carry it to samples that it does not reach
            for k in range(0, len(part), 1 << 14):
                put = part[k : k + (1 << 14)]
                put[:] = _between(x, at + k, at + k + len(put), down / up, scale)
            continue
        made = np.empty((rounds, up), np.float32)
        for k, (low, matrix) in enumerate(phases):
            windows = np.lib.stride_tricks.sliding_window_view(sound[low - first :], len(matrix))[::down][:rounds]
            made[:, k * PHASES : (k + 1) * PHASES] = np.ascontiguousarray(windows) @ matrix
        part[:] = made.reshape(-1)[: len(part)]
    return out


def clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(np.asarray(x, np.float64), nan=0.0), -1.0, 1.0)


def to_int16(x: np.ndarray) -> np.ndarray:
    """Negative samples by 32768, positive by 32767, halves rounded up."""
    x = clamp(x)
    return np.floor(np.where(x < 0, x * 32768, x * 32767) + 0.5).astype(np.int16)


def to_int24(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(clamp(x) * 8388608 + 0.5), -8388608, 8388607).astype(np.int32)


def fits_16_bits(x: np.ndarray, most: int = 1_000_000) -> bool:
    """Whether evenly spread samples all lie on the 16-bit grid."""
    some = np.asarray(x, np.float64)[:: max(1, -(-len(x) // most))]
    near = lambda s: np.abs(some * s - np.round(some * s)) < 1e-3
    return bool((near(32768) | near(32767)).all())
