"""Separation by a model over short-time spectra: what feeds it and puts its output together. The model itself is any function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sonoframe.kernels.spectrum import istft, stft


def geometry(hop: int, dim_t: int, n_fft: int) -> tuple[int, int, int]:
    """(samples of a chunk, samples left out at each end, samples made by each chunk)."""
    chunk = hop * (dim_t - 1)
    return chunk, n_fft // 2, chunk - 2 * (n_fft // 2)


def demix(mix: np.ndarray, runner: Callable[[np.ndarray], np.ndarray], n_fft: int, hop: int, dim_f: int, dim_t: int, compensate: float = 1.0) -> np.ndarray:
    """(2, n) of a part that `runner` finds in (2, n): it maps (4, dim_f, dim_t), real and imaginary parts of both channels, to the like.

    Chunks overlap by what their spectra blur at the ends; only their middles are kept.
    """
    chunk, trim, made = geometry(hop, dim_t, n_fft)
    n = mix.shape[1]
    count = -(-n // made)
    padded = np.pad(np.asarray(mix, np.float64), ((0, 0), (trim, count * made - n + trim)))
    parts = [demix_chunk(padded[:, k * made : k * made + chunk], runner, n_fft, hop, dim_f, dim_t, compensate) for k in range(count)]
    return np.concatenate(parts, axis=1)[:, :n] if parts else np.zeros((2, 0))


def demix_chunk(sound: np.ndarray, runner: Callable[[np.ndarray], np.ndarray], n_fft: int, hop: int, dim_f: int, dim_t: int, compensate: float = 1.0) -> np.ndarray:
    """The middle of the part that `runner` finds in one chunk of two channels."""
    chunk, trim, made = geometry(hop, dim_t, n_fft)
    spectra = [stft(x, n_fft, hop)[:dim_t, :dim_f] for x in sound]
    found = runner(np.stack([part for s in spectra for part in (s.real, s.imag)]).transpose(0, 2, 1))
    out = np.zeros((2, made))
    for c in range(2):
        whole = np.empty((dim_t, n_fft // 2 + 1), complex)
        whole[:, dim_f:] = 0
        whole.real[:, :dim_f], whole.imag[:, :dim_f] = found[2 * c].T, found[2 * c + 1].T
        out[c] = istft(whole, n_fft, hop, chunk)[trim : trim + made] * compensate
    return out


def complement(stem: str) -> str:
    """The part that the rest of a mix is, without a given one."""
    return {"vocals": "instrumental", "instrumental": "vocals"}.get(stem, f"no {stem}")


def framed(x: np.ndarray, runner: Callable[[np.ndarray], np.ndarray], size: int = 480, delay: int = 480) -> np.ndarray:
    """A stateful frame-by-frame effect over a channel, its delay taken out; silence stays silence."""
    x = np.asarray(x, np.float64)
    if not np.any(x):
        return x.copy()
    padded = np.pad(x, (0, -len(x) % size + delay))
    frames = padded[: len(padded) // size * size].reshape(-1, size)
    out = np.concatenate([runner(f) for f in frames])
    return out[delay : delay + len(x)]
