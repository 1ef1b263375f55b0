"""WAV as a Spark data source: spark.read.format("wav").load(path), df.write.format("wav").

Reading: option `table` is `block` (default) or `clip`; clips read headers alone. Each file, or each `framesPerPartition` frames of a
file, is a partition, so a long recording is read by many tasks. Paths are local or on a mount that all executors share.
Writing takes block rows of whole clips, partitioned by clip: option `depth` is 16, 24 or 32 (float), `rate` the sample rate.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sonoframe import schema
from sonoframe.kernels.sampling import to_int16, to_int24

MIN_RATE, MAX_RATE = 3000, 768000


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    bits: int
    floats: bool
    data_at: int
    frames: int


def read_header(f) -> Header | None:
    """The header of an open WAV file: chunks are walked, odd ones are padded; None for what can't be read."""
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    kind = None
    while len(chunk := f.read(8)) == 8:
        name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            body = f.read(size + (size & 1))
            if len(body) < 16:
                return None
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == 0xFFFE and len(body) >= 26:
                tag = struct.unpack("<H", body[24:26])[0]
            kind = (tag, channels, rate, bits)
        elif name == b"data":
            if not kind:
                return None
            tag, channels, rate, bits = kind
            if tag not in (1, 3) or not channels or not MIN_RATE <= rate <= MAX_RATE or bits not in (8, 16, 24, 32, 64):
                return None
            at = f.tell()
            f.seek(0, 2)
            size = min(size, f.tell() - at)
            return Header(rate, channels, bits, tag == 3, at, size // (channels * bits // 8))
        else:
            f.seek(size + (size & 1), 1)
    return None


def decode(data: bytes, header: Header) -> np.ndarray:
    """(frames, channels) of interleaved bytes, as 32-bit floats."""
    if header.floats:
        x = np.frombuffer(data, "<f4" if header.bits == 32 else "<f8").astype(np.float32)
    elif header.bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif header.bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = (np.concatenate([np.zeros((len(b), 1), np.uint8), b], 1).view("<i4").reshape(-1) >> 8).astype(np.float32) / 8388608
    else:
        x = (np.frombuffer(data, f"<i{header.bits // 8}") / 2.0 ** (header.bits - 1)).astype(np.float32)
    return x.reshape(-1, header.channels)


def encode(channels: list[np.ndarray], rate: int, depth: int = 16) -> bytes:
    """A WAV file: 16 or 24 bits, or 32-bit floats that keep what lies over full scale."""
    x = np.stack(channels, 1) if channels else np.zeros((0, 1), np.float32)
    if depth == 16:
        body = to_int16(x).astype("<i2").tobytes()
    elif depth == 24:
        body = to_int24(x).astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    elif depth == 32:
        body = np.nan_to_num(x, nan=0.0).astype("<f4").tobytes()
    else:
        raise ValueError("depth is 16, 24 or 32")
    if len(body) + 36 > 0xFFFFFFFF:
        raise ValueError("a WAV file holds no more than 4 GB")
    frame = x.shape[1] * depth // 8
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3 if depth == 32 else 1, x.shape[1], rate, rate * frame, frame, depth)
    return head + b"data" + struct.pack("<I", len(body)) + body


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, "**", "*.wav"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))


def _name(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


@dataclass
class _Range(InputPartition):
    """Blocks that begin between two bytes of a file."""

    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        super().__init__(None)
        self.path, self.start, self.stop = path, start, stop


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return schema.CLIP if self.options.get("table") == "clip" else schema.BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


#: Bytes of a frame for planning; the true width is in the header, which only tasks read.
PLAN_WIDTH = 4


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.clips = options.get("table") == "clip"
        self.step = max(1, int(options.get("framespartition", options.get("framesPerPartition", 64 * schema.BLOCK))) * PLAN_WIDTH)

    def partitions(self) -> list[_Range]:
        out = []
        for path in _files(self.options["path"]):
            if self.clips:
                out.append(_Range(path, 0, 0))
                continue
            size = os.path.getsize(path)  # files are planned by size; only tasks open them
            out += [_Range(path, at, at + self.step) for at in range(0, max(1, size), self.step)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            header = read_header(f)
            if self.clips:
                size = os.path.getsize(partition.path)
                if header:
                    codec = f"pcm_{'f' if header.floats else 's'}{header.bits}"
                    yield (_name(partition.path), partition.path, "wav", codec, header.rate, header.channels, header.frames, header.frames / header.rate, size)
                else:
                    yield (_name(partition.path), partition.path, None, None, None, None, None, None, size)
                return
            if not header:
                return
            width = header.channels * header.bits // 8
            for start in range(0, header.frames, schema.BLOCK):
                if not partition.start <= header.data_at + start * width < partition.stop:
                    continue
                f.seek(header.data_at + start * width)
                x = decode(f.read(min(schema.BLOCK, header.frames - start) * width), header)
                for c in range(header.channels):
                    yield (_name(partition.path), c, start // schema.BLOCK, start, x[:, c].tolist())


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.rate, self.depth = int(options["rate"]), int(options.get("depth", 16))

    def write(self, rows) -> WriterCommitMessage:
        clips: dict[str, list] = {}
        for r in rows:
            clips.setdefault(r.clip_id, []).append((r.channel, r.block_idx, r.samples))
        os.makedirs(self.path, exist_ok=True)
        for clip_id, parts in clips.items():
            parts.sort(key=lambda p: p[:2])
            channels = [np.concatenate([np.asarray(s, np.float32) for k, _, s in parts if k == c]) for c in sorted({p[0] for p in parts})]
            to = os.path.join(self.path, f"{clip_id}.wav")
            with open(to + ".part", "wb") as f:
                f.write(encode(channels, self.rate, self.depth))
            os.replace(to + ".part", to)  # a second attempt of a task leaves the same file
        return WriterCommitMessage()


def register(spark) -> None:
    spark.dataSource.register(WavSource)
