import struct

import numpy as np
import pytest

from sonoframe.sources import headers, wav


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def mp4(codec=b"mp4a", config=b"\x12\x10", rate=44100, channels=2, sizes=(100, 200, 300), long=False):
    esds = box(b"esds", b"\0" * 4, b"\x03\x19\0\0\0", b"\x04\x11" + b"\0" * 13, bytes([5, len(config)]) + config)
    extra = esds if codec == b"mp4a" else b""
    entry = box(codec, b"\0" * 6, b"\0\1", b"\0" * 8, struct.pack(">HHHH", channels, 16, 0, 0), struct.pack(">I", rate << 16), extra)
    mdhd = box(b"mdhd", b"\1\0\0\0" + b"\0" * 16 + struct.pack(">IQ", 44100, 88200) + b"\0" * 4) if long else box(b"mdhd", b"\0" * 12, struct.pack(">II", 44100, 88200), b"\0" * 4)
    stsz = box(b"stsz", b"\0" * 4, struct.pack(">II", 0, len(sizes)), b"".join(struct.pack(">I", s) for s in sizes))
    stbl = box(b"stbl", box(b"stsd", b"\0" * 4, b"\0\0\0\1", entry), stsz)
    trak = box(b"trak", box(b"mdia", mdhd, box(b"hdlr", b"\0" * 8, b"soun", b"\0" * 12), box(b"minf", stbl)))
    return box(b"ftyp", b"M4A \0\0\0\0") + box(b"mdat", b"\0" * 50) + box(b"moov", trak)


@pytest.mark.parametrize("long", [False, True])
def test_mp4(long):
    found = headers.inspect(mp4(long=long))
    assert found == {"container": "mp4", "codec": "mp4a", "rate": 44100, "channels": 2, "seconds": 2.0, "audio_bytes": 600}
    assert headers.kbps(2.0, 60000) == 240
    assert headers.inspect(mp4(b"Opus"))["rate"] == 48000
    assert headers.inspect(mp4()[:120])["rate"] is None


def test_aac_rates():
    assert headers.aac_config(bytes([0b00010_011, 0b1_0001_000])) == {"rate": None, "channels": 1}  # a 24 kHz core may be doubled
    assert headers.aac_config(bytes([0b00010_010, 0b0_0010_000])) == {"rate": 44100, "channels": 2}
    assert headers.aac_config(b"") is None


def test_mp3_flac_and_tags():
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + b"\0" * 413
    found = headers.inspect(b"ID3\4\0\0\0\0\0\5xxxxx" + b"junk" + frame * 3)
    assert (found["container"], found["rate"], found["channels"]) == ("mp3", 44100, 2)
    assert headers.inspect(frame)["container"] is None
    packed = (48000 << 44 | 1 << 41 | 15 << 36 | 96000).to_bytes(8, "big")
    info = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + packed + b"\0" * 16
    found = headers.inspect(b"fLaC" + b"\0\0\0\x22" + info)
    assert (found["rate"], found["channels"], found["seconds"]) == (48000, 2, 2.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode([np.zeros(8000, np.float32)], 8000))
    (tmp_path / "b.bin").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in headers.inspect_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (rows["a.wav"].codec, rows["a.wav"].seconds) == ("pcm_s16", 1.0) and rows["b.bin"].container is None
