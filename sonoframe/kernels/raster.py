"""Pictures of waveforms: one bar a column, written as 8-bit grey PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Grey of the ground, of a column's whole reach, and of the part within its root mean square.
GROUND, REACH, BODY = 0, 128, 255


def rows_of(values: np.ndarray, height: int) -> np.ndarray:
    """The row from the top that a value from -1 to 1 falls on; others are held to that range."""
    return np.floor((1 - np.clip(values, -1.0, 1.0)) / 2 * (height - 1) + 0.5).astype(np.int64)


def draw(low: np.ndarray, high: np.ndarray, rms: np.ndarray, height: int) -> np.ndarray:
    """(height, columns) of greys: from the lowest to the highest value of each column, brighter within the root mean square."""
    y = np.arange(height)[:, None]
    top, bottom = rows_of(high, height), rows_of(low, height)
    inner_top, inner_bottom = np.maximum(top, rows_of(rms, height)), np.minimum(bottom, rows_of(-rms, height))
    out = np.where((y >= top) & (y <= bottom), REACH, GROUND)
    return np.where((y >= inner_top) & (y <= inner_bottom), BODY, out).astype(np.uint8)


def png(grey: np.ndarray) -> bytes:
    """A PNG file of one 8-bit grey channel, no filter."""
    height, width = grey.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = grey
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def pixels(data: bytes) -> np.ndarray:
    """The greys of a picture that `png` wrote; its checksums are verified."""
    at, body, size = 8, b"", (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a part of the picture is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", part[:8])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)[:, 1:]
