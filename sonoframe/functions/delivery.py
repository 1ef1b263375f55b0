"""What encoders write: rates, bitrates and sizes, as column expressions.

Fixed values: the tables below describe encoders' public behaviour (bitrate tables of MPEG audio, lowpass choices of the common
MP3 encoder, ranges of the Vorbis encoder) and stand in natural order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.functions.numeric import round_half_up

# Format, lossy, tier (0 and 1 need no download), bitrates offered.
FORMATS = {
    "mp3": (True, 1, (64, 96, 128, 160, 192, 256, 320)),
    "wav": (False, 0, (64, 96, 128, 160, 192, 256, 320)),
    "m4a": (True, 2, (64, 96, 128, 160, 192, 256)),
    "ogg": (True, 2, (64, 96, 128, 160, 192, 256, 320)),
    "opus": (True, 2, (32, 48, 64, 96, 128, 160, 192)),
    "flac": (False, 2, (64, 96, 128, 160, 192, 256, 320)),
    "aac": (True, 2, (64, 96, 128, 160, 192, 256)),
    "aiff": (False, 2, (64, 96, 128, 160, 192, 256, 320)),
    "wma": (True, 2, (64, 96, 128, 160, 192)),
    "m4r": (True, 2, (64, 96, 128, 160, 192, 256)),
}
# MP3 bitrate and the lowpass that goes with it.
MP3_LOWPASS = [(8, 2000), (16, 3700), (24, 3900), (32, 5500), (40, 7000), (48, 7500), (56, 10000), (64, 11000), (80, 13500), (96, 15100), (112, 15600), (128, 17000), (160, 17500), (192, 18600), (224, 19400), (256, 19700), (320, 20500)]
# The highest lowpass that a rate carries.
MP3_CARRIES = [(3970, 8000), (4510, 11025), (5420, 12000), (7230, 16000), (9970, 22050), (11220, 24000), (15250, 32000), (15960, 44100)]
# The rates MP3 knows, and the bitrates of MPEG-1, MPEG-2 and MPEG-2.5 layer III.
MP3_RATES = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000)
MPEG_1 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG_2 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MPEG_25 = (8, 16, 24, 32, 40, 48, 56, 64)
# Fixed values of the Vorbis encoder: lowest rate, kbps a channel (low, high), stereo kbps (low, high), overshoot over 24 kbps a channel and at or under it.
VORBIS = [
    (8000, 8, 42, 12, 84, 1.11, 1.42), (9000, 12, 50, 16, 100, 1.12, 1.45), (15000, 16, 100, 24, 200, 1.06, 1.28),
    (19000, 16, 90, 30, 180, 1.32, 1.64), (26000, 30, 190, 36, 380, 1.31, 1.47), (40000, 32, 240, 45, 500, 1.28, 1.28),
]


def _choose(options: Sequence, cuts: Sequence[float], x: Column, at_cut_lower: bool = True) -> Column:
    """options[k], k being how many of the rising cuts lie under x. One lookup: nested conditions outgrow a compiled method."""
    array = F.array(*[F.lit(c) for c in cuts])
    k = F.size(F.filter(array, (lambda c: c < x) if at_cut_lower else (lambda c: c <= x)))
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), k + 1)


def nearest(x: Column, options: Sequence[int], lower: bool = True) -> Column:
    """The option nearest to x; of two as near, the lower one, or the higher."""
    return _choose(options, [(a + b) / 2 for a, b in zip(options, options[1:])], x.cast("double"), lower)


def mp3_output(rate: Column, kbps: Column, channels: Column) -> tuple[Column, Column]:
    """(sample rate, kbps) that an MP3 of this request has."""
    source = nearest(rate, MP3_RATES)
    tops = [k for k, _ in MP3_LOWPASS]
    table = _choose([float(f) for _, f in MP3_LOWPASS], [(a + b) / 2 for a, b in zip(tops, tops[1:])], kbps.cast("double"), False)
    lowpass = F.least(table * F.when(channels == 1, 1.5).otherwise(1.0), source / 2)
    out = F.least(source, _choose([r for _, r in MP3_CARRIES] + [source], [float(f) for f, _ in MP3_CARRIES], lowpass))
    # The three tables in one, by the rate's version: an index into a list of tables.
    version = F.when(out >= 32000, 1).when(out >= 16000, 2).otherwise(3)
    return out, F.element_at(F.array(*[nearest(kbps, t) for t in (MPEG_1, MPEG_2, MPEG_25)]), version)


def vorbis_rate(rate: Column) -> Column:
    return F.when(rate > 50000, 48000).when(rate < 8000, 8000).otherwise(rate)


def _vorbis(rate: Column, field: int) -> Column:
    return _choose([b[field] for b in VORBIS], [float(b[0]) for b in VORBIS[1:]], vorbis_rate(rate).cast("double"), False)


def vorbis_range(rate: Column, channels: Column) -> tuple[Column, Column]:
    """Lowest and highest kbps that the encoder opens at."""
    low, high = _vorbis(rate, 1), _vorbis(rate, 2)
    six = (channels == 6) & (_vorbis(rate, 0) == 40000)
    return F.when(channels == 2, _vorbis(rate, 3)).when(six, 14 * 6).otherwise(low * channels), F.when(channels == 2, _vorbis(rate, 4)).otherwise(high * channels)


def vorbis_kbps(kbps: Column, rate: Column, channels: Column) -> Column:
    low, high = vorbis_range(rate, channels)
    return F.least(high, F.greatest(low, kbps))


def vorbis_overshoot(kbps: Column, rate: Column, channels: Column) -> Column:
    return F.when(vorbis_kbps(kbps, rate, channels) / channels > 24, _vorbis(rate, 5)).otherwise(_vorbis(rate, 6))


def aac_ceiling(rate: Column, channels: Column) -> Column:
    one = rate * 4.4 / 1000 + 6
    return F.when(channels == 1, one).otherwise(one * 0.9 * channels)


def effective_kbps(fmt: Column, kbps: Column, rate: Column, channels: Column) -> Column:
    """What an encoder averages for a requested bitrate, with its overshoot."""
    aac = F.least(kbps * F.when(rate >= 32000, 1.08).otherwise(1.15), aac_ceiling(rate, channels))
    mp3 = mp3_output(rate, kbps, F.least(F.lit(2), channels))[1].cast("double")
    return F.when(fmt == "mp3", mp3).when(fmt.isin("m4a", "m4r", "aac"), aac).when(fmt == "opus", kbps * 1.03).when(fmt == "ogg", vorbis_kbps(kbps, rate, channels) * vorbis_overshoot(kbps, rate, channels)).when(fmt == "wma", kbps * 1.08).otherwise(kbps.cast("double"))


def written_kbps(fmt: Column, kbps: Column, rate: Column, channels: Column) -> Column:
    """The bitrate that a label shows: what is written, without overshoot."""
    aac = round_half_up(F.least(kbps.cast("double"), aac_ceiling(rate, channels)))
    return F.when(fmt == "mp3", mp3_output(rate, kbps, F.least(F.lit(2), channels))[1]).when(fmt.isin("m4a", "m4r", "aac"), aac).when(fmt == "ogg", vorbis_kbps(kbps, rate, channels)).otherwise(kbps).cast("long")


def output_rate(fmt: Column, kbps: Column, rate: Column, channels: Column) -> Column:
    return F.when(fmt == "mp3", mp3_output(rate, kbps, F.least(F.lit(2), channels))[0]).when(fmt == "opus", 48000).when(fmt == "ogg", vorbis_rate(rate)).otherwise(rate).cast("long")


def wav_bytes(frames: Column, channels: Column, bits: int = 16) -> Column:
    return (44 + frames * channels * (bits // 8)).cast("long")


def lossy_bytes(seconds: Column, kbps: Column) -> Column:
    return round_half_up(kbps * 1000 * seconds / 8) + 2048


def estimated_bytes(fmt: Column, seconds: Column, kbps: Column, rate: Column, channels: Column, bits: int = 16) -> Column:
    """The size that an export is announced with."""
    frames = round_half_up(seconds * rate)
    deep, share = (16, 0.55) if bits == 16 else (24, 0.65)
    mp3 = round_half_up(effective_kbps(F.lit("mp3"), kbps, rate, channels) * 1000 * seconds / 8) + 512
    return F.when(fmt == "wav", wav_bytes(frames, channels, bits)).when(fmt == "aiff", 54 + frames * channels * 2).when(fmt == "flac", round_half_up(wav_bytes(frames, channels, deep) * share)).when(fmt == "mp3", mp3).otherwise(lossy_bytes(seconds, effective_kbps(fmt, kbps, rate, channels))).cast("long")


def bytes_for(fmt: Column, seconds: Column, kbps: Column, rate: Column, channels: Column) -> Column:
    """The size that plans count with: lossy formats by what their encoder averages, with the larger header."""
    lossy = fmt.isin(*[f for f, x in FORMATS.items() if x[0]])
    return F.when(lossy, lossy_bytes(seconds, effective_kbps(fmt, kbps, rate, channels))).otherwise(estimated_bytes(fmt, seconds, kbps, rate, channels))


# Extensions of files that a lossy encoder made.
LOSSY_EXTENSIONS = ("mp3", "m4a", "aac", "ogg", "oga", "opus", "wma", "amr", "m4b", "weba", "webm", "mp4", "mov", "mkv", "avi", "3gp")
# Extensions of the MP4 family, whose codec decides, and its codecs without loss.
MP4_EXTENSIONS = ("mp4", "m4v", "mov", "3gp", "m4a", "m4b")
LOSSLESS_CODECS = ("alac", "fLaC", "lpcm", "ipcm", "fpcm", "sowt", "twos", "in24", "in32", "fl32", "fl64")


def is_lossy_source(extension: Column, codec: Column) -> Column:
    """By the codec where the container names one, else by the extension."""
    return F.when(codec.isNotNull() & extension.isin(*MP4_EXTENSIONS), ~codec.isin(*LOSSLESS_CODECS)).otherwise(extension.isin(*LOSSY_EXTENSIONS))


#: More than this isn't one audio track's bitrate.
MOST_KBPS = 512


def source_kbps(size: Column, seconds: Column) -> Column:
    k = round_half_up(F.try_divide(size * 8, seconds) / 1000)
    return F.when((seconds > 0) & (k <= MOST_KBPS), k)


def conversion_verdict(lossy_source: Column, kbps: Column, lossy_target: Column, target_kbps: Column, narrowed: Column) -> Column:
    """What a conversion does to quality, by name."""
    return (
        F.when(~lossy_source & ~lossy_target & narrowed, "lossless_16_bit").when(~lossy_source & ~lossy_target, "lossless").when(~lossy_source & lossy_target, "first_lossy")
        .when(lossy_source & ~lossy_target, "no_gain").when(kbps.isNotNull() & (target_kbps > kbps * 1.15), "bitrate_above_source").otherwise("second_lossy")
    )


def size_change(before: Column, after: Column) -> Column:
    """'about the same' within 3 percent, else how much larger or smaller."""
    d = F.when(before > 0, round_half_up((after - before) / before * 100)).otherwise(0)
    return F.when(F.abs(d) < 3, "about the same").when(d > 0, F.concat(d.cast("string"), F.lit("% larger"))).otherwise(F.concat(F.abs(d).cast("string"), F.lit("% smaller")))


def export_engine(fmt: Column, without_codec: Column) -> Column:
    """What writes a format: sample frames, MP3 blocks, or a codec core; AAC falls back to the platform where the core is missing."""
    tiers = F.create_map(*[x for name, (_, tier, _) in FORMATS.items() for x in (F.lit(name), F.lit(tier))])
    tier = tiers[fmt]
    return F.when(tier == 0, "frames").when(tier == 1, "blocks").when(without_codec & fmt.isin("m4a", "m4r", "aac"), "platform").otherwise("core")
