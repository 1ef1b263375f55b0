"""Pictures of waveforms, pixel by pixel."""

import struct
import zlib

import numpy as np
import pytest

from sonoframe.kernels import raster
from sonoframe.operators import series


def test_pixels_equal_a_drawing_by_hand():
    rng = np.random.default_rng(1)
    low, high = np.sort(rng.uniform(-1.3, 1.3, (2, 50)), axis=0)
    rms = rng.uniform(0, 1, 50)
    found = raster.pixels(raster.png(raster.draw(low, high, rms, 41)))
    row = lambda v: int((1 - min(1.0, max(-1.0, v))) / 2 * 40 + 0.5)
    for x in range(50):
        for y in range(41):
            reach = row(high[x]) <= y <= row(low[x])
            body = reach and row(rms[x]) <= y <= row(-rms[x])
            assert found[y, x] == (raster.BODY if body else raster.REACH if reach else raster.GROUND)


def test_the_file_is_a_png():
    data = raster.png(np.array([[0, 128, 255]], np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 1) and data[24:29] == bytes([8, 0, 0, 0, 0])
    at = data.index(b"IDAT")
    (n,) = struct.unpack(">I", data[at - 4 : at])
    assert zlib.decompress(data[at + 4 : at + 4 + n]) == bytes([0, 0, 128, 255])
    broken = bytearray(data)
    broken[at + 6] ^= 1
    with pytest.raises(ValueError):
        raster.pixels(bytes(broken))


def test_tiles(spark):
    rows = [(k, c, -0.1 * (c % 10), 0.1 * (c % 10), 0.05) for k in ("a", "b") for c in range(70 if k == "a" else 5) if c != 3]
    found = {(r.key, r.tile): (r.columns, raster.pixels(bytes(r.png))) for r in series.waveform_tiles(spark.createDataFrame(rows, "key string, col long, low double, high double, rms double"), 32, 21).collect()}
    assert {k: v[0] for k, v in found.items()} == {("a", 0): 32, ("a", 1): 32, ("a", 2): 6, ("b", 0): 5}
    assert not found["a", 0][1][:, 3].any() and found["a", 1][1].shape == (21, 32) and (found["a", 0][1][10] == raster.BODY).sum() == 31
