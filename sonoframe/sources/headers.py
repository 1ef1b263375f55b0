"""What the headers of audio files say: container, codec, sample rate, channels, seconds, bytes of audio. Nothing is decoded.

`inspect` takes the bytes of a file (or of its beginning); `inspect_files` maps it over Spark's binaryFile rows.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sonoframe.sources.wav import MAX_RATE, MIN_RATE, read_header

# Layer III bitrates (kbps) of MPEG-1 and of MPEG-2 and 2.5 by index, and MPEG-1 sample rates by index.
_MP3_KBPS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_MP3_RATES = (44100, 48000, 32000)
# Sample rates of AAC by index.
_AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
#: Bytes of an MP3 in which two frames in a row must be found, boxes and bytes of an MP4's index that are looked at.
MP3_SEARCH, MP4_BOXES, MP4_INDEX = 8192, 32, 32 << 20
#: Bytes that are read of a file before anything is known of it.
PREFIX = 64 << 10


def id3_end(data: bytes) -> int:
    """Where the audio begins after an ID3v2 tag."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    return 10 + size + (10 if data[5] & 0x10 else 0)


def mpeg_frame(data: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(version, sample rate, channels, length in bytes) of a layer III frame at a place."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 3}.get(data[at + 1] >> 3 & 3), data[at + 1] >> 1 & 3
    bits, rate = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version is None or layer != 1 or rate == 3 or bits in (0, 15):
        return None
    hz = _MP3_RATES[rate] >> (version - 1)
    kbps = _MP3_KBPS[min(version, 2)][bits]
    length = (144 if version == 1 else 72) * kbps * 1000 // hz + (data[at + 2] >> 1 & 1)
    return version, hz, 1 if data[at + 3] >> 6 == 3 else 2, length


def _mp3(data: bytes) -> dict | None:
    start = id3_end(data)
    for at in range(start, min(len(data), start + MP3_SEARCH)):
        one = mpeg_frame(data, at)
        if one:
            two = mpeg_frame(data, at + one[3])
            if two and two[:3] == one[:3]:
                return {"container": "mp3", "codec": "mp3", "rate": one[1], "channels": one[2]}
    return None


def _flac(data: bytes) -> dict | None:
    start = id3_end(data)
    if data[start : start + 4] != b"fLaC" or len(data) < start + 26:
        return None
    b = data[start + 8 :]
    rate = b[10] << 12 | b[11] << 4 | b[12] >> 4
    frames = (b[13] & 15) << 32 | struct.unpack(">I", b[14:18])[0]
    return {"container": "flac", "codec": "flac", "rate": rate, "channels": (b[12] >> 1 & 7) + 1, "seconds": frames / rate if rate and frames else None} if MIN_RATE <= rate <= MAX_RATE else None


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the contents of boxes; a size of 1 is followed by 64 bits, one of 0 reaches to the end."""
    while start + 8 <= end:
        size, kind, head = struct.unpack(">I", data[start : start + 4])[0], data[start + 4 : start + 8], 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack(">Q", data[start + 8 : start + 16])[0], 16
        elif size == 0:
            size = end - start
        if size < head:
            return
        yield kind, start + head, min(end, start + size)
        start += size


def _find(data: bytes, span: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    for name in path:
        span = next(((a, b) for kind, a, b in boxes(data, *span) if kind == name), None)
        if span is None:
            return None
    return span


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("out of bits")
        return self.value >> self.left & (1 << n) - 1


def aac_config(config: bytes) -> dict | None:
    """Rate and channels of an AudioSpecificConfig; the rate is None where a core of 24 kHz or less may be doubled unannounced."""
    try:
        bits = _Bits(config)

        def kind() -> int:
            k = bits.take(5)
            return 32 + bits.take(6) if k == 31 else k

        def rate() -> int | None:
            k = bits.take(4)
            return bits.take(24) if k == 15 else _AAC_RATES[k] if k < len(_AAC_RATES) else None

        first, core, channels = kind(), rate(), bits.take(4)
        if core is None:
            return None
        channels = {7: 8}.get(channels, channels) or None
        if first in (5, 29):
            return {"rate": rate(), "channels": 2 if first == 29 else channels}
        return {"rate": None if first == 2 and core <= 24000 else core, "channels": channels}
    except ValueError:
        return None


def _descriptor(data: bytes, at: int, end: int, wanted: int) -> bytes | None:
    """The content of a descriptor inside an esds box, which nest."""
    while at + 2 <= end:
        tag, size, at = data[at], 0, at + 1
        for _ in range(4):
            more, size, at = data[at] & 0x80, size << 7 | data[at] & 0x7F, at + 1
            if not more:
                break
        if tag == wanted:
            return data[at : at + size]
        if tag == 3:
            at += 3
        elif tag == 4:
            at += 13
        else:
            at += size
    return None


def _mp4(data: bytes) -> dict | None:
    top = []
    for k, box in enumerate(boxes(data, 0, len(data))):
        if k >= MP4_BOXES:
            break
        top.append(box)
    if not any(kind in (b"ftyp", b"moov") for kind, *_ in top):
        return None
    moov = next(((a, b) for kind, a, b in top if kind == b"moov"), None)
    for kind, a, b in boxes(data, *moov) if moov else ():
        if kind != b"trak" or not (mdia := _find(data, (a, b), b"mdia")):
            continue
        hdlr, mdhd, stbl = _find(data, mdia, b"hdlr"), _find(data, mdia, b"mdhd"), _find(data, mdia, b"minf", b"stbl")
        if not hdlr or data[hdlr[0] + 8 : hdlr[0] + 12] != b"soun" or not mdhd or not stbl:
            continue
        if data[mdhd[0]] == 1:
            scale, length = struct.unpack(">IQ", data[mdhd[0] + 20 : mdhd[0] + 32])
        else:
            scale, length = struct.unpack(">II", data[mdhd[0] + 12 : mdhd[0] + 20])
        out = {"container": "mp4", "codec": None, "rate": None, "channels": None, "seconds": length / scale if scale else None}
        if stsd := _find(data, stbl, b"stsd"):
            for codec, x, y in boxes(data, stsd[0] + 8, stsd[1]):
                out |= {"codec": codec.decode("latin-1"), "channels": struct.unpack(">H", data[x + 16 : x + 18])[0], "rate": struct.unpack(">I", data[x + 24 : x + 28])[0] >> 16}
                if codec == b"Opus":
                    out["rate"] = 48000
                elif codec == b"mp4a" and (esds := _find(data, (x + 28, y), b"esds")):
                    config = _descriptor(data, esds[0] + 4, esds[1], 5)
                    found = aac_config(config) if config else None
                    if found:
                        out |= {"rate": found["rate"], "channels": found["channels"] or out["channels"]}
                elif codec == b"alac" and (cookie := _find(data, (x + 28, y), b"alac")) and cookie[1] - cookie[0] >= 28:
                    out |= {"channels": data[cookie[0] + 13], "rate": struct.unpack(">I", data[cookie[0] + 24 : cookie[0] + 28])[0]}
                break
        if stsz := _find(data, stbl, b"stsz"):
            fixed, count = struct.unpack(">II", data[stsz[0] + 4 : stsz[0] + 12])
            sizes = data[stsz[0] + 12 : stsz[0] + 12 + 4 * count]
            out["audio_bytes"] = fixed * count if fixed else sum(struct.unpack(f">{len(sizes) // 4}I", sizes[: len(sizes) // 4 * 4]))
        return out
    return {"container": "mp4", "codec": None, "rate": None, "channels": None} if moov else None


def inspect(data: bytes) -> dict:
    """container, codec, rate, channels, seconds, audio_bytes; None for what the header doesn't say."""
    out = dict.fromkeys(("container", "codec", "rate", "channels", "seconds", "audio_bytes"))
    try:
        wav = read_header(io.BytesIO(data)) if data[:4] == b"RIFF" else None
        if wav:
            return out | {"container": "wav", "codec": f"pcm_{'f' if wav.floats else 's'}{wav.bits}", "rate": wav.rate, "channels": wav.channels, "seconds": wav.frames / wav.rate, "audio_bytes": wav.frames * wav.channels * wav.bits // 8}
        return out | (_flac(data) or _mp4(data) or _mp3(data) or {})
    except (struct.error, IndexError):
        return out


FILES = "path string, container string, codec string, rate int, channels int, seconds double, audio_bytes long"


def inspect_stream(f) -> dict:
    """The same for an open file, of which only what is needed is read: a prefix, what stands behind an ID3 tag, the index of an MP4 wherever it stands."""
    prefix = f.read(PREFIX)
    if prefix[:4] == b"RIFF":
        f.seek(0)
        wav = read_header(f)
        if wav:
            return dict(zip(("container", "codec", "rate", "channels", "seconds", "audio_bytes"), ("wav", f"pcm_{'f' if wav.floats else 's'}{wav.bits}", wav.rate, wav.channels, wav.frames / wav.rate, wav.frames * wav.channels * wav.bits // 8)))
    start = id3_end(prefix)
    if start + MP3_SEARCH > len(prefix) and start:
        f.seek(start)
        return inspect(f.read(PREFIX))
    at, seen = 0, b""
    f.seek(0, 2)
    end = f.tell()
    for _ in range(MP4_BOXES):
        f.seek(at)
        head = f.read(16)
        if len(head) < 8:
            break
        size = struct.unpack(">I", head[:4])[0]
        size = struct.unpack(">Q", head[8:16])[0] if size == 1 and len(head) == 16 else end - at if size == 0 else size
        if size < 8 or not at and head[4:8] != b"ftyp":
            break
        if head[4:8] in (b"ftyp", b"moov") and size <= MP4_INDEX:
            f.seek(at)
            seen += f.read(size)
        if head[4:8] == b"moov":
            return inspect(seen)
        at += size
    return inspect(prefix)


def inspect_files(files: DataFrame) -> DataFrame:
    """Header facts for rows (path, ...), such as spark.read.format("binaryFile") lists; the content column is not read. Paths may be of any store that pyarrow opens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", path))
                with store.open_input_file(name) as f:
                    rows.append(inspect_stream(f))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            names = ("container", "codec", "rate", "channels", "seconds", "audio_bytes")
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]], ["path", *names])

    return files.select("path").mapInArrow(kernel, FILES)


def kbps(seconds: float | None, audio_bytes: int | None) -> int | None:
    """The exact mean bitrate of a track."""
    return int(audio_bytes * 8 / seconds / 1000 + 0.5) if seconds and audio_bytes else None
