"""Edits of whole clips: fades, trimming, padding, loops, widths, channels, joins, silence removal. Channels are arrays of one length."""

from __future__ import annotations

import numpy as np

from sonoframe.kernels.sampling import resample

Channels = list[np.ndarray]
#: Seconds of the crossfade at a cut, and at a removed silence.
CUT_FADE, SILENCE_FADE = 0.010, 0.005


def fade(x: Channels, first: int, last: int, curve: str = "linear") -> Channels:
    n = len(x[0])
    shape = {"linear": lambda t: t, "exp": lambda t: t * t, "log": np.sqrt, "scurve": lambda t: t * t * (3 - 2 * t)}[curve]
    gain = np.ones(n)
    if first > 0:
        gain[: min(n, first)] *= shape(np.arange(min(n, first)) / first)
    if last > 0:
        tail = np.arange(min(n, last))
        gain[n - len(tail) :] *= shape(tail[::-1] / last)
    return [c * gain for c in x]


def trim(x: Channels, threshold_db: float = -50.0, quiet_length: int = 1) -> Channels:
    """Without what is at or under the threshold in all channels at both ends."""
    loud = np.flatnonzero(np.max(np.abs(x), axis=0) > 10 ** (threshold_db / 20))
    return [c[loud[0] : loud[-1] + 1] if len(loud) else c[:quiet_length] for c in x]


def pad(x: Channels, lead: int, tail: int) -> Channels:
    return [np.pad(c, (lead, tail)) for c in x]


def loop(x: Channels, times: int, gap: int = 0) -> Channels:
    return [np.concatenate([part for k in range(times) for part in ([c] if k == times - 1 or not gap else [c, np.zeros(gap)])]) for c in x]


def set_channels(x: Channels, n: int) -> Channels:
    """One channel is the mean of two, or of layouts of four and six by their speakers' weights; more are copies."""
    if n == len(x):
        return x
    if n == 2 and len(x) == 4:
        return [(x[0] + x[2]) / 2, (x[1] + x[3]) / 2]
    if n == 2 and len(x) == 6:
        h = np.sqrt(0.5)
        return [x[0] + h * (x[2] + x[4]), x[1] + h * (x[2] + x[5])]
    if n == 1:
        if len(x) == 6:
            h = np.sqrt(0.5)
            return [h * (x[0] + x[1]) + x[2] + 0.5 * (x[4] + x[5])]
        return [np.mean(x, axis=0)]
    return [x[min(k, len(x) - 1)] if len(x) > 1 else x[0] for k in range(n)]


def width(x: Channels, amount: float) -> Channels:
    if len(x) < 2:
        return x
    mid, side = (x[0] + x[1]) / 2, (x[0] - x[1]) / 2 * amount
    return [np.clip(mid + side, -1, 1), np.clip(mid - side, -1, 1), *x[2:]]


def concat(parts: list[tuple[int, Channels]], crossfade: float = 0.0) -> tuple[int, Channels]:
    """(rate, channels) of parts (rate, channels) in order, at the highest rate and with the most channels; each fades in over the end of what is there, at equal power."""
    parts = [(r, x) for r, x in parts if len(x[0])]
    if not parts:
        return 44100, [np.zeros(1)]
    rate, count = max(r for r, _ in parts), max(len(x) for _, x in parts)
    same = [set_channels([c if r == rate else resample(c, r, rate) for c in x], count) for r, x in parts]
    overlap = max(0, round(crossfade * rate))
    length = max(1, sum(len(x[0]) for x in same) - overlap * (len(same) - 1))
    out = np.zeros((count, length))
    at = 0
    for k, x in enumerate(same):
        n = len(x[0])
        fade_in = min(overlap, n) if k else 0
        angle = np.ones(n) * np.pi / 2
        if fade_in:
            angle[:fade_in] *= np.linspace(0, 1, fade_in) if fade_in > 1 else 1.0
        take = max(0, min(n, length - at))
        out[:, at : at + take] = out[:, at : at + take] * np.cos(angle[:take]) * (np.arange(take) < fade_in) + np.asarray(x)[:, :take] * np.sin(angle[:take])
        at += n - overlap
    return rate, list(out)


def cut_out(x: Channels, rate: int, start: float, stop: float) -> Channels:
    """Without the span from start to stop (seconds), its edges joined by a short crossfade."""
    n = len(x[0])
    a, b = (min(n, max(0, round(t * rate))) for t in (start, stop))
    if b <= a:
        return x
    if a == 0 or b == n:
        return [np.concatenate([c[:a], c[b:]]) if a or b < n else np.zeros(1) for c in x]
    seconds = min(CUT_FADE, a / rate, (n - b) / rate)
    return concat([(rate, [c[:a] for c in x]), (rate, [c[b:] for c in x])], seconds)[1]


def silences(x: Channels, rate: int, threshold_db: float = -45.0, least: float = 0.4) -> list[tuple[float, float]]:
    """Spans (seconds) whose 20 ms windows are all under the threshold, of at least `least` seconds. The last window may be shorter; a silence in it lasts to the end."""
    size, n = max(1, int(rate * 0.02)), len(x[0])
    if not n:
        return []
    starts = np.arange(0, n, size)
    power = np.add.reduceat(np.sum([np.square(np.asarray(c, np.float64)) for c in x], axis=0), starts) / (np.diff(np.append(starts, n)) * len(x))
    quiet = np.concatenate([[False], np.sqrt(power) < 10 ** (threshold_db / 20), [False]])
    edges = np.append(starts, n)[np.flatnonzero(quiet[1:] != quiet[:-1])].reshape(-1, 2)
    return [(a / rate, b / rate) for a, b in edges.tolist() if b / rate - a / rate >= least]


def remove_silence(x: Channels, rate: int, threshold_db: float = -45.0, least: float = 0.4, keep: float = 0.08) -> Channels:
    """Without silent spans, each shorter by `keep` at both ends; what is left is joined by short crossfades, and a tenth of a second at most if nothing is."""
    n = len(x[0])
    at, parts = 0, []
    for start, stop in silences(x, rate, threshold_db, least):
        a, b = round((start + keep) * rate), round((stop - keep) * rate)
        if b > a:
            parts.append((at, a))
            at = b
    parts = [(a, b) for a, b in [*parts, (at, n)] if b > a]
    if not parts:
        return [c[: max(1, round(0.1 * rate))] for c in x]
    return concat([(rate, [c[a:b] for c in x]) for a, b in parts], SILENCE_FADE if len(parts) > 1 else 0.0)[1]


def crossfade_join(parts: list[tuple[int, Channels]], fade_s: float) -> tuple[int, Channels]:
    """Joins with one fade for all seams, at most half of the shortest part."""
    shortest = min((len(x[0]) / r for r, x in parts), default=0.0)
    return concat(parts, max(0.0, min(fade_s, shortest / 2)))


#: Seconds of the fade that hides a cut, the least and the longest fade at a ringtone's end, and the longest ringtone.
EDGE_FADE, LEAST_TAIL, RINGTONE = 0.02, 0.2, 30.0


def span(x: Channels, rate: int, start: float, stop: float) -> Channels:
    n = len(x[0])
    a = min(n, max(0, round(start * rate)))
    return [c[a : max(a + 1, min(n, round(stop * rate)))] for c in x]


def ringtone(x: Channels, rate: int, start: float, stop: float, tail: float | None = 2.0, limit: float | None = RINGTONE) -> Channels:
    """A span of at most `limit` seconds with a short fade in, and at its end one of `tail` seconds (the short one with None), both quadratic."""
    out = span(x, rate, start, stop if limit is None else min(stop, start + limit))
    seconds = EDGE_FADE if tail is None else min(max(tail, LEAST_TAIL), len(out[0]) / rate)
    return fade(out, round(EDGE_FADE * rate), round(seconds * rate), "exp")


def trimmed(x: Channels, rate: int, start: float, stop: float, keep: bool = True, faded: bool = True) -> Channels:
    """The span alone, or all but the span; the fade is at edges that the cut made: both of a kept span, and those of the clip that a removed span reaches."""
    out = span(x, rate, start, stop) if keep else cut_out(x, rate, start, stop)
    if not faded:
        return out
    edge = round(EDGE_FADE * rate)
    return fade(out, edge if keep or start <= 0 else 0, edge if keep or stop >= len(x[0]) / rate else 0)
