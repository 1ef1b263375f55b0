"""Effects and measures over pieces of a sound, with state carried from piece to piece.

Each has `push(samples)`, a channels x n array in, and `end()`; both return what is complete by then. How a sound is cut changes nothing
but rounding. `Compressor` (filters) is one of them. State is small and can be pickled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from sonoframe.kernels.filters import biquad, equalizer, k_weighting
from sonoframe.kernels.loudness import BLOCK_S, HOP_S, RANGE_BLOCK_S, RANGE_HOP_S, channel_weight
from sonoframe.kernels.sampling import PEAK_REACH, true_peak


class Equalizer:
    """Filters in series, (kind, Hz, dB, Q) each; per channel four numbers a filter are carried."""

    def __init__(self, rate: float, channels: int, bands: list[tuple[str, float, float, float]]):
        self.filters = [equalizer(kind, rate, hz, db, q) for kind, hz, db, q in bands]
        self.states = [[None] * len(self.filters) for _ in range(channels)]

    def push(self, samples: np.ndarray) -> np.ndarray:
        out = np.asarray(samples, np.float64).copy()
        for c, states in enumerate(self.states):
            for k, f in enumerate(self.filters):
                out[c], states[k] = biquad(out[c], f, states[k])
        return out

    def end(self) -> np.ndarray:
        return np.zeros((len(self.states), 0))


def cell_edges(rate: float, start: int, stop: int) -> np.ndarray:
    """Places in [start, stop) where a momentary or a range block begins or ends: sums between them make up all blocks."""
    found = []
    for block_s, hop_s in ((BLOCK_S, HOP_S), (RANGE_BLOCK_S, RANGE_HOP_S)):
        block, hop = math.floor(block_s * rate + 0.5), math.floor(hop_s * rate + 0.5)
        for shift in (0, block):
            first = max(0, -(-(start - shift) // hop))
            found.append(np.arange(first * hop + shift, stop, hop))
    edges = np.unique(np.concatenate(found))
    return edges[(edges >= start) & (edges < stop)]


class LoudnessCells:
    """K-weighted energy between the edges of loudness blocks, and peaks. `push` and `end` give rows (start, stop, energy, peak) of complete cells; the energy is weighted by channel."""

    def __init__(self, rate: float, channels: int):
        self.rate, self.weights = rate, [channel_weight(k, channels) for k in range(channels)]
        self.states = [[None, None] for _ in range(channels)]
        self.at, self.open = 0, (0, 0.0, 0.0)  # samples so far; start, energy and peak of the cell that is open

    def push(self, samples: np.ndarray) -> list[tuple[int, int, float, float]]:
        samples = np.asarray(samples, np.float32)
        n = samples.shape[1]
        if not n:
            return []
        energy = np.zeros(n)
        for x, weight, states in zip(samples, self.weights, self.states):
            if weight:
                for k, f in enumerate(k_weighting(self.rate)):
                    x, states[k] = biquad(x, f, states[k])
                    x = x.astype(np.float32)
                energy += weight * np.square(x.astype(np.float64))
        peaks = np.abs(samples).max(axis=0).astype(np.float64)
        edges = cell_edges(self.rate, self.at, self.at + n)
        begins = np.concatenate([[0], edges - self.at]) if not len(edges) or edges[0] > self.at else edges - self.at
        sums, tops = np.add.reduceat(energy, begins), np.maximum.reduceat(peaks, begins)
        out = []
        for begin, total, top in zip((begins + self.at).tolist(), sums.tolist(), tops.tolist()):
            if begin == self.at and not (len(edges) and edges[0] == begin):  # goes on with what is open
                self.open = (self.open[0], self.open[1] + total, max(self.open[2], top))
                continue
            if begin > self.open[0]:
                out.append((self.open[0], begin, self.open[1], self.open[2]))
            self.open = (begin, total, top)
        self.at += n
        return out

    def end(self) -> list[tuple[int, int, float, float]]:
        return [(self.open[0], self.at, self.open[1], self.open[2])] if self.at > self.open[0] else []


def segment_cells(channels: list[np.ndarray], rate: float, at: int, warm: int, last: bool) -> tuple[list[tuple[int, int, float, float]], float]:
    """Cells and true peak (a magnitude) of a stretch of a clip that begins with `warm` samples of the one before, at the clip's sample `at`.

    The filters have forgotten what was before the warm samples to far below rounding, so stretches can be measured anywhere. What
    lies between samples near a stretch's end is left to the next stretch, which has the samples on both sides.
    """
    effect = LoudnessCells(rate, len(channels))
    sound = np.stack(channels)
    effect.at = at
    effect.open = (at, 0.0, 0.0)
    own = at + warm
    effect.push(sound[:, :warm])
    effect.open = (own, 0.0, 0.0)
    cells = [*effect.push(sound[:, warm:]), *effect.end()]
    first, stop = max(0, warm - 2 * PEAK_REACH), sound.shape[1]
    peak = 0.0
    for x in sound:
        peak = max(peak, true_peak(x[first:], 0 if not warm else PEAK_REACH, 0 if last else PEAK_REACH) if stop > first else 0.0)
    return cells, peak


class InOrder:
    """Brings the blocks of one clip's channels into order and pushes them into an effect.

    A block that comes early waits; once `patience` later places wait for one that is missing, silence stands in for it. A
    block before the place that is reached is late: it is dropped and counted. A channel that is missing at a place where
    later ones wait is silent there.
    """

    def __init__(self, make: Callable[[float, int], object], rate: float, channels: int, patience: int = 8):
        self.effect, self.channels, self.patience = make(rate, channels), channels, patience
        self.reached, self.late, self.filled = 0, 0, 0
        self.waiting: dict[int, dict[int, np.ndarray]] = {}

    def add(self, start: int, channel: int, samples: np.ndarray) -> list:
        """What the effect gives for all that is in order now, a value for each push."""
        if start < self.reached or channel in self.waiting.get(start, {}):
            self.late += 1
            return []
        self.waiting.setdefault(start, {})[channel] = np.asarray(samples, np.float32)
        return self._on(lambda start: len(self.waiting[start]) == self.channels, self.patience)

    def _on(self, complete: Callable[[int], bool], patience: int) -> list:
        out = []
        while self.waiting:
            start = min(self.waiting)
            due = len(self.waiting) > patience
            if start > self.reached and due:
                out.append((self.reached, self.effect.push(np.zeros((self.channels, start - self.reached), np.float32))))
                self.filled += start - self.reached
                self.reached = start
            elif start == self.reached and (complete(start) or due):
                found = self.waiting.pop(start)
                piece = np.zeros((self.channels, max(map(len, found.values()))), np.float32)
                for c, x in found.items():
                    piece[c, : len(x)] = x
                out.append((start, self.effect.push(piece)))
                self.reached += piece.shape[1]
            else:
                break
        return out

    def end(self) -> list:
        """Pushes what waits, missing places silent, and ends the effect."""
        return [*self._on(lambda _: True, 0), (self.reached, self.effect.end())]
