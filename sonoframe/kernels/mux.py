"""Containers around coded audio packets: ADTS streams and MP4 files, by the public formats (ISO/IEC 14496-3 and 14496-12)."""

from __future__ import annotations

import struct

RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
PACKET, CHUNK = 1024, 64


def adts(packets: list[bytes], rate: int, channels: int, object_type: int = 2) -> bytes:
    """Each packet behind a header of seven bytes."""
    index = RATES.index(rate)
    out = []
    for p in packets:
        n = len(p) + 7
        bits = 0xFFF << 44 | 1 << 40 | (object_type - 1) << 38 | index << 34 | channels << 30 | n << 13 | 0x7FF << 2
        out.append(bits.to_bytes(7, "big") + p)
    return b"".join(out)


def _box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def _full(kind: str, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _descriptor(tag: int, body: bytes) -> bytes:
    return bytes([tag, 0x80, 0x80, 0x80, len(body)]) + body


def mp4(packets: list[bytes], rate: int, channels: int, frames: int | None = None, delay: int = 0, object_type: int = 2) -> bytes:
    """A file with the index in front: ftyp, moov, mdat. An edit list leaves out `delay` samples and what is past `frames`."""
    sizes = [len(p) for p in packets]
    made = PACKET * len(packets)
    shown = made - delay if frames is None else frames
    index = RATES.index(rate)
    config = struct.pack(">H", object_type << 11 | index << 7 | channels << 3)
    mean = sum(sizes) * 8 * rate // max(1, made)
    es = _descriptor(3, struct.pack(">HB", 0, 0) + _descriptor(4, bytes([0x40, 0x15, 0, 0, 0]) + struct.pack(">II", mean, mean) + _descriptor(5, config)) + _descriptor(6, b"\x02"))
    entry = _box("mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", channels, 16, 0, 0, rate << 16), _full("esds", 0, es))
    last = max(1, min(PACKET, shown + delay - PACKET * (len(packets) - 1))) if packets else 0
    times = [(len(packets) - 1, PACKET), (1, last)] if len(packets) > 1 else [(len(packets), last)]
    full, rest = divmod(len(packets), CHUNK)
    runs = ([(1, CHUNK)] if full else []) + ([(full + 1, rest)] if rest else [])
    unity = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    ftyp = _box("ftyp", b"M4A \x00\x00\x00\x00M4A mp42isom")

    def moov(at: int) -> bytes:
        starts, place = [], at
        for k in range(0, len(packets), CHUNK):
            starts.append(place)
            place += sum(sizes[k : k + CHUNK])
        table = _box(
            "stbl",
            _full("stsd", 0, struct.pack(">I", 1), entry),
            _full("stts", 0, struct.pack(">I", len(times)), *[struct.pack(">II", *x) for x in times]),
            _full("stsc", 0, struct.pack(">I", len(runs)), *[struct.pack(">III", first, n, 1) for first, n in runs]),
            _full("stsz", 0, struct.pack(">II", 0, len(sizes)), *[struct.pack(">I", n) for n in sizes]),
            _full("stco", 0, struct.pack(">I", len(starts)), *[struct.pack(">I", x) for x in starts]),
        )
        media = _box(
            "mdia",
            _full("mdhd", 0, struct.pack(">IIIIHH", 0, 0, rate, made - PACKET + last if packets else 0, 0x55C4, 0)),
            _full("hdlr", 0, bytes(4), b"soun", bytes(12), b"sound\x00"),
            _box("minf", _full("smhd", 0, bytes(4)), _box("dinf", _full("dref", 0, struct.pack(">I", 1), _full("url ", 1))), table),
        )
        edits = _box("edts", _full("elst", 0, struct.pack(">IIiHH", 1, shown, delay, 1, 0)))
        track = _box("trak", _full("tkhd", 7, struct.pack(">IIIIIIIHHHH", 0, 0, 1, 0, shown, 0, 0, 0, 1, 0x0100, 0), unity, bytes(8)), edits, media)
        head = _full("mvhd", 0, struct.pack(">IIIIIH", 0, 0, rate, shown, 1 << 16, 0x0100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
        return _box("moov", head, track)

    before = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(before) + _box("mdat", *packets)
