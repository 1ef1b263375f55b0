"""Loudness of a clip (ITU-R BS.1770, EBU Tech 3342) from its channels."""

from __future__ import annotations

import math

import numpy as np

from sonoframe.kernels.filters import biquad, k_weighting
from sonoframe.kernels.sampling import true_peak

BLOCK_S, HOP_S, ABSOLUTE_GATE, RELATIVE_GATE, RANGE_BLOCK_S, RANGE_HOP_S, RANGE_GATE = 0.4, 0.1, -70.0, -10.0, 3.0, 1.0, -20.0


def channel_weight(index: int, channels: int) -> float:
    """Up to two channels weigh 1; beyond, the fourth is left out and those after it weigh 1.41."""
    if channels <= 2:
        return 1.0
    return 0.0 if index == 3 else 1.41 if index > 3 else 1.0


def lufs(power: float) -> float:
    return -0.691 + 10 * math.log10(power) if power > 0 else -math.inf


def weighted(x: np.ndarray, rate: float) -> np.ndarray:
    """K-weighted samples, in single precision after each stage."""
    shelf, high_pass = k_weighting(rate)
    once = biquad(np.asarray(x, np.float32), shelf)[0].astype(np.float32)
    return biquad(once, high_pass)[0].astype(np.float32)


def _powers(squares: list[tuple[float, np.ndarray]], n: int, block: int, hop: int) -> np.ndarray:
    starts = np.arange(0, n - block + 1, hop)
    total = np.zeros(len(starts))
    for weight, sums in squares:
        total += weight * (sums[starts + block] - sums[starts]) / block
    return total


def measure(channels: list[np.ndarray], rate: float) -> dict:
    """integrated, range, true_peak, peak (dB), momentary (list) and momentary_step of a clip."""
    n = len(channels[0]) if channels else 0
    squares = []
    for k, x in enumerate(channels):
        weight = channel_weight(k, len(channels))
        if weight:
            y = weighted(x, rate).astype(np.float64)
            squares.append((weight, np.concatenate([[0.0], np.cumsum(y * y)])))
    block, hop = math.floor(BLOCK_S * rate + 0.5), math.floor(HOP_S * rate + 0.5)
    if n < block:
        power = sum(w * s[-1] / max(1, n) for w, s in squares)
        integrated, spread, momentary = lufs(power), 0.0, [lufs(power)] if n else []
    else:
        p = _powers(squares, n, block, hop)
        momentary = [lufs(v) for v in p]
        over = p[np.array(momentary) > ABSOLUTE_GATE]
        integrated = -math.inf
        if len(over):
            gate = lufs(over.mean()) + RELATIVE_GATE
            kept = over[[lufs(v) > gate for v in over]]
            integrated = lufs((kept if len(kept) else over).mean())
        levels = np.array([lufs(v) for v in _powers(squares, n, math.floor(RANGE_BLOCK_S * rate + 0.5), math.floor(RANGE_HOP_S * rate + 0.5))])
        levels = levels[levels > ABSOLUTE_GATE]
        spread = 0.0
        if len(levels):
            gate = 10 * math.log10(np.mean(10 ** (levels / 10))) + RANGE_GATE
            levels = np.sort(levels[levels > gate])
            if len(levels) > 1:
                spread = float(levels[math.floor((len(levels) - 1) * 0.95 + 0.5)] - levels[math.floor((len(levels) - 1) * 0.1 + 0.5)])
    db = lambda v: 20 * math.log10(v) if v > 0 else -math.inf
    peak = max((float(np.abs(x).max()) if len(x) else 0.0 for x in channels), default=0.0)
    return {"integrated": integrated, "range": spread, "true_peak": db(max((true_peak(x) for x in channels), default=0.0)), "peak": db(peak), "momentary": momentary, "momentary_step": HOP_S}


def normalizing_gain_db(measured: dict, target: float = -14.0, ceiling: float = -1.0) -> float:
    """Gain to the target that keeps true peaks under the ceiling; 0 for silence."""
    gain = min(target - measured["integrated"], ceiling - measured["true_peak"])
    return gain if math.isfinite(gain) else 0.0
