"""Second-order filters, loudness weighting, equalizers, echo and reverb."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Biquad:
    b0: float
    b1: float
    b2: float
    a1: float
    a2: float


def k_weighting(rate: float) -> tuple[Biquad, Biquad]:
    """The two stages of ITU-R BS.1770 weighting at a sample rate: high shelf, then high pass."""
    # Fixed values of the recommendation's analogue prototypes.
    f_shelf, gain_db, q_shelf, f_pass, q_pass, slope = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 38.13547087602444, 0.5003270373238773, 0.4996667741545416
    k = math.tan(math.pi * f_shelf / rate)
    high = 10 ** (gain_db / 20)
    mid = high**slope
    d = 1 + k / q_shelf + k * k
    shelf = Biquad((high + mid * k / q_shelf + k * k) / d, 2 * (k * k - high) / d, (high - mid * k / q_shelf + k * k) / d, 2 * (k * k - 1) / d, (1 - k / q_shelf + k * k) / d)
    k = math.tan(math.pi * f_pass / rate)
    d = 1 + k / q_pass + k * k
    return shelf, Biquad(1.0, -2.0, 1.0, 2 * (k * k - 1) / d, (1 - k / q_pass + k * k) / d)


def equalizer(kind: str, rate: float, hz: float, db: float = 0.0, q: float = 0.707) -> Biquad:
    """The public audio-EQ formulas: peaking, lowshelf, highshelf, lowpass, highpass, bandpass, notch."""
    w = 2 * math.pi * min(hz, rate / 2 * 0.999) / rate
    c, s, a = math.cos(w), math.sin(w), 10 ** (db / 40)
    alpha = s / (2 * q)
    if kind == "peaking":
        b, d = (1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)
    elif kind in ("lowshelf", "highshelf"):
        alpha, sign = s / 2 * math.sqrt(2), 1 if kind == "lowshelf" else -1
        r = 2 * math.sqrt(a) * alpha
        b = (a * (a + 1 - sign * (a - 1) * c + r), sign * 2 * a * (a - 1 - sign * (a + 1) * c), a * (a + 1 - sign * (a - 1) * c - r))
        d = (a + 1 + sign * (a - 1) * c + r, -sign * 2 * (a - 1 + sign * (a + 1) * c), a + 1 + sign * (a - 1) * c - r)
    elif kind == "lowpass":
        b, d = ((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha)
    elif kind == "highpass":
        b, d = ((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha)
    elif kind == "bandpass":
        b, d = (alpha, 0.0, -alpha), (1 + alpha, -2 * c, 1 - alpha)
    elif kind == "notch":
        b, d = (1.0, -2 * c, 1.0), (1 + alpha, -2 * c, 1 - alpha)
    else:
        raise ValueError(f"no filter is called {kind}")
    return Biquad(b[0] / d[0], b[1] / d[0], b[2] / d[0], d[1] / d[0], d[2] / d[0])


def response_db(filters: list[Biquad], rate: float, hz: np.ndarray) -> np.ndarray:
    """Gain of filters in series at frequencies."""
    z = np.exp(-2j * np.pi * np.asarray(hz) / rate)
    out = np.zeros(len(z))
    for f in filters:
        out += 20 * np.log10(np.abs((f.b0 + f.b1 * z + f.b2 * z * z) / (1 + f.a1 * z + f.a2 * z * z)))
    return out


def biquad(x: np.ndarray, f: Biquad, state: np.ndarray | None = None, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filters x in double precision from a state (two delayed inputs, two delayed outputs); returns samples and the new state.

    The signal is laid out in columns of `rows` samples, about as many as columns unless told. All columns run at once from rest; then the state each column really
    began with is carried from column to column, and the free response to it is added. A piece after a piece gives
    what the whole would, up to rounding.
    """
    x = np.asarray(x, np.float64)
    x1, x2, y1, y2 = np.zeros(4) if state is None else state
    n = len(x)
    if not n:
        return x, np.array([x1, x2, y1, y2])
    rows = rows or max(32, min(2048, math.isqrt(n)))
    past = np.concatenate([[x2, x1], x])
    forced = f.b0 * past[2:] + f.b1 * past[1:-1] + f.b2 * past[:-2]
    columns = -(-n // rows)
    u = np.zeros(columns * rows)
    u[:n] = forced
    y = np.ascontiguousarray(u.reshape(columns, rows).T)
    one, two = np.zeros(columns), np.zeros(columns)
    for r in range(rows):
        y[r] -= f.a1 * one + f.a2 * two
        one, two = y[r], one
    free = np.zeros((rows + 2, 2))  # responses to y[-1] = 1 and to y[-2] = 1
    free[1, 0] = free[0, 1] = 1.0
    for r in range(2, rows + 2):
        free[r] = -f.a1 * free[r - 1] - f.a2 * free[r - 2]
    free = free[2:]
    a, b, begun = float(y1), float(y2), []
    (p, q), (r, s) = free[-1].tolist(), free[-2].tolist()
    for last, before in zip(y[-1].tolist(), y[-2].tolist()):
        begun.append((a, b))
        a, b = last + p * a + q * b, before + r * a + s * b
    starts = np.array(begun)
    y += free[:, :1] * starts[:, 0]
    y += free[:, 1:] * starts[:, 1]
    out = y.T.reshape(-1)[:n]
    tail = np.concatenate([[y2, y1], out])
    return out, np.array([past[-1], past[-2], tail[-1], tail[-2]])


def echo(x: np.ndarray, rate: float, delay: float, feedback: float, mix: float) -> np.ndarray:
    """Dry sound and its repeats, each weaker by `feedback`, to 60 dB down. Repeats are shifted copies: no recursion over samples."""
    feedback = min(0.85, max(0.0, feedback))
    step = max(1, round(delay * rate))
    repeats = 1 if feedback <= 0 else max(1, math.ceil(math.log(0.001) / math.log(feedback)))
    out = np.zeros(len(x) + step * repeats)
    out[: len(x)] += x * (1 - 0.5 * mix)
    for k in range(1, repeats + 1):
        out[k * step : k * step + len(x)] += x * mix * feedback ** (k - 1)
    return out


def echo_tail(delay: float, feedback: float) -> float:
    """Seconds that an echo sounds on."""
    feedback = min(0.85, max(0.0, feedback))
    return delay if feedback <= 0 else delay * max(1, math.ceil(math.log(0.001) / math.log(feedback)))


def convolve(x: np.ndarray, impulse: np.ndarray) -> np.ndarray:
    n = len(x) + len(impulse) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(impulse, size), size)[:n]


def reverb(x: np.ndarray, rate: float, decay: float, pre_delay: float, mix: float, seed: int = 1) -> np.ndarray:
    """Dry sound and a convolution with seeded, decaying noise of unit energy."""
    noise = np.random.default_rng(seed).uniform(-1, 1, max(1, round(decay * rate)))
    impulse = noise * (1 - np.arange(len(noise)) / len(noise)) ** 2
    wet = convolve(x, impulse / np.sqrt((impulse**2).sum()))
    lead = round(pre_delay * rate)
    out = np.zeros(max(len(x), lead + len(wet)))
    out[: len(x)] += x * (1 - mix)
    out[lead : lead + len(wet)] += wet * mix
    return out


#: Ranges of a compressor's threshold, knee and ratio, of the knee's constant, and halvings of the latter (fixed values).
THRESHOLDS, KNEES, RATIOS, KNEE_CONSTANTS, HALVINGS = (-100.0, 0.0), (0.0, 40.0), (1.0, 20.0), (0.1, 10000.0), 30


def held(value: float, bounds: tuple[float, float]) -> float:
    return min(bounds[1], max(bounds[0], float(value)))


def knee_constant(threshold: float, knee: float, ratio: float) -> float:
    """k of the knee y = t + (1 - exp(-k (x - t))) / k over amplitudes, t being the threshold's.

    It is found by halving its logarithm's range so that the slope at the knee's upper end, in dB per dB, is 1 / ratio.
    """
    low, top = 10 ** (threshold / 20), 10 ** ((threshold + knee) / 20)
    a, b = (math.log(k) for k in KNEE_CONSTANTS)
    for _ in range(HALVINGS):
        k = math.exp((a + b) / 2)
        rest = math.exp(-k * (top - low))
        a, b = (a, (a + b) / 2) if top * rest < (low + (1 - rest) / k) / ratio else ((a + b) / 2, b)
    return math.exp((a + b) / 2)


def compressor_curve(db: np.ndarray, threshold: float, knee: float, ratio: float) -> np.ndarray:
    """Static curve in dB: straight to the threshold, an exponential knee above it, then straight with a slope of 1 / ratio.

    Settings are held to their ranges. The curve is continuous and rising.
    """
    threshold, knee, ratio = held(threshold, THRESHOLDS), held(knee, KNEES), held(ratio, RATIOS)
    low, k = 10 ** (threshold / 20), knee_constant(threshold, knee, ratio)
    db = np.asarray(db, float)
    soft = np.clip(db, threshold, threshold + knee)
    bend = 20 * np.log10(low + (1 - np.exp(-k * (10 ** (soft / 20) - low))) / k)
    return np.where(db <= threshold, db, bend + np.maximum(db - threshold - knee, 0.0) / ratio)


def auto_makeup(threshold: float, knee: float, ratio: float) -> float:
    """dB that bring back six tenths of what full scale loses."""
    return -0.6 * float(compressor_curve(0.0, threshold, knee, ratio))


class Compressor:
    """A compressor over pieces of a sound: what is pushed in comes out later by the look-ahead; cutting changes nothing.

    The gain is set every CELL samples: the largest magnitude of all channels within the look-ahead gives the curve's gain,
    which is followed in dB with the attack's constant down and the release's up, and read as a straight line between.
    """

    CELL = 32

    def __init__(self, rate: float, channels: int, threshold: float, knee: float, ratio: float, attack: float = 0.003, release: float = 0.25, makeup: float | None = None, look_ahead: float = 0.006):
        self.curve = (held(threshold, THRESHOLDS), held(knee, KNEES), held(ratio, RATIOS))
        self.makeup = auto_makeup(*self.curve) if makeup is None else makeup
        self.down, self.up = (math.exp(-self.CELL / (rate * max(t, 1e-6))) for t in (attack, release))
        self.ahead = max(1, math.ceil(look_ahead * rate / self.CELL))
        self.waiting = np.zeros((channels, 0))  # samples whose gain isn't known yet, from the start of a cell
        self.levels: np.ndarray = np.zeros(0)  # peaks of their whole cells
        self.gain = 0.0  # dB at the start of the first waiting cell

    def _out(self, cells: int, levels: np.ndarray) -> np.ndarray:
        """The first cells, with the levels of them and of what lies ahead."""
        views = np.lib.stride_tricks.sliding_window_view(np.pad(levels, (0, max(0, cells + self.ahead - len(levels)))), self.ahead + 1)[:cells]
        db = 20 * np.log10(np.maximum(views.max(axis=1), 1e-6))
        wanted = (compressor_curve(db, *self.curve) - db).tolist()
        points = [self.gain]
        for w in wanted:
            points.append(w + (points[-1] - w) * (self.down if w < points[-1] else self.up))
        self.gain = points[-1]
        steps = np.arange(self.CELL) / self.CELL
        points = np.array(points)
        gain = (points[:-1, None] + (points[1:] - points[:-1])[:, None] * steps).reshape(-1)
        n = min(cells * self.CELL, self.waiting.shape[1])
        done, self.waiting = self.waiting[:, :n] * 10 ** ((gain[:n] + self.makeup) / 20), self.waiting[:, n:]
        return done

    def push(self, samples: np.ndarray) -> np.ndarray:
        self.waiting = np.concatenate([self.waiting, np.asarray(samples, np.float64)], axis=1)
        known = len(self.levels) * self.CELL
        whole = self.waiting.shape[1] // self.CELL * self.CELL
        if whole > known:
            self.levels = np.concatenate([self.levels, np.abs(self.waiting[:, known:whole]).max(axis=0).reshape(-1, self.CELL).max(axis=1)])
        cells = max(0, len(self.levels) - self.ahead)
        if not cells:
            return self.waiting[:, :0]
        out = self._out(cells, self.levels)
        self.levels = self.levels[cells:]
        return out

    def end(self) -> np.ndarray:
        n = self.waiting.shape[1]
        if not n:
            return self.waiting
        tail = self.waiting[:, len(self.levels) * self.CELL :]
        levels = np.append(self.levels, np.abs(tail).max()) if tail.shape[1] else self.levels
        out = self._out(-(-n // self.CELL), levels)
        self.levels = np.zeros(0)
        return out


def compress(channels: list[np.ndarray], rate: float, **settings: float) -> list[np.ndarray]:
    """A whole clip through a Compressor, at the old places."""
    effect = Compressor(rate, len(channels), **settings)
    sound = np.stack([np.asarray(x, np.float64) for x in channels])
    return list(np.concatenate([effect.push(sound), effect.end()], axis=1))
