"""Formatting, parsing and classifying of strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.functions.numeric import round_half_up

_MINUS = "−"


def _finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN, infinite or negative."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")), x).otherwise(0.0)


def _two(x: Column, width: int = 2) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def timecode(seconds: Column, show_hours: bool = False) -> Column:
    """m:ss.cc, or h:mm:ss.cc from an hour on."""
    cs = round_half_up(_finite(seconds) * 100)
    h, m, s, c = F.floor(cs / 360000), F.floor(cs % 360000 / 6000), F.floor(cs % 6000 / 100), cs % 100
    tail = F.concat(_two(s), F.lit("."), _two(c))
    return F.when((h > 0) | F.lit(show_hours), F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), tail)).otherwise(F.concat(m.cast("string"), F.lit(":"), tail))


def duration(seconds: Column) -> Column:
    """m:ss or h:mm:ss, in whole seconds."""
    t = round_half_up(_finite(seconds))
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), _two(s)))


def parse_timecode(text: Column) -> Column:
    """Seconds of '90', '1:30', '1:30.5' or '01:02:03.25'; null for anything else."""
    t = F.trim(text)
    total = F.aggregate(F.split(t, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))
    return F.when(t.rlike(r"^\d{1,3}(:\d{1,2}){0,2}(\.\d{1,3})?$"), total)


def file_size(size: Column) -> Column:
    """Bytes in steps of 1024, with a decimal under 10."""
    def unit(power: int, name: str) -> Column:
        v = size / float(1024**power)
        return F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(round_half_up(v).cast("string")), F.lit(" " + name))

    return F.when(size.isNull() | (size < 0), "0 B").when(size < 1024, F.concat(round_half_up(size).cast("string"), F.lit(" B"))).when(size < 1024**2, unit(1, "KB")).when(size < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def rate_label(rate: Column) -> Column:
    k = rate / 1000
    return F.concat(F.when(k == F.floor(k), F.floor(k).cast("string")).otherwise(F.format_string("%.1f", k)), F.lit(" kHz"))


def channel_label(n: Column) -> Column:
    return F.when(n == 1, "Mono").when(n == 2, "Stereo").otherwise(F.concat(n.cast("string"), F.lit(" channels")))


def db_label(value: Column) -> Column:
    sign = F.when(value > 0, "+").when(value < 0, _MINUS).otherwise("")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(_MINUS + "∞ dB")).otherwise(F.concat(sign, F.format_string("%.1f", F.abs(value)), F.lit(" dB")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def base_name(path: Column) -> Column:
    """The name without folders and without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def output_name(original: Column, suffix: str, ext: str) -> Column:
    """Appends the suffix once, however often a file goes through."""
    base = F.when(base_name(original) == "", "audio").otherwise(base_name(original))
    return F.concat(base, F.when(F.lower(base).endswith("-" + suffix.lower()), "").otherwise("-" + suffix), F.lit("." + ext))


def part_name(base: Column, part: Column, parts: Column) -> Column:
    """base-part-03-of-12, padded to the width of the number of parts."""
    return F.concat(base, F.lit("-part-"), F.lpad(part.cast("string"), F.length(parts.cast("string")), F.lit("0")), F.lit("-of-"), parts.cast("string"))


def title(name: Column) -> Column:
    """snake_case to words, the first with a capital."""
    words = F.regexp_replace(name, "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def duration_bucket(seconds: Column) -> Column:
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    return F.when(~finite, "unknown").when(seconds < 30, "under 30s").when(seconds < 120, "30s to 2m").when(seconds < 600, "2m to 10m").when(seconds < 3600, "10m to 1h").otherwise("over 1h")


# What user agents hold, in the order in which it decides.
_AGENTS = [
    ("iPhone|iPad|iPod", [("CriOS", "ios-chrome"), ("FxiOS", "ios-firefox"), ("EdgiOS", "ios-edge")], "ios-safari"),
    ("Android", [("SamsungBrowser", "android-samsung"), ("Firefox", "android-firefox"), ("Chrome", "android-chrome")], "android-other"),
    ("", [("Edg/", "desktop-edge"), ("Firefox/", "desktop-firefox"), ("Chrome/", "desktop-chrome"), ("Safari/", "desktop-safari")], "other"),
]


def browser_class(agent: Column) -> Column:
    out = F.lit(None)
    for system, kinds, rest in reversed(_AGENTS):
        kind = F.lit(rest)
        for mark, name in reversed(kinds):
            kind = F.when(agent.contains(mark), name).otherwise(kind)
        out = F.when(agent.rlike(system), kind).otherwise(out) if system else kind
    return out


# Extensions that betray a file's name, and schemes of local addresses.
MEDIA_EXTENSIONS = "mp3 wav m4a m4p m4b aac ogg oga opus flac weba webm mp4 m4v mov avi mkv wma aif aiff amr ape ac3 dts 3gp caf aax aa".split()
_FILEISH = r"(?i)\.(?:" + "|".join(MEDIA_EXTENSIONS) + r")\b"
_URLISH = r"""(?i)\b(?:blob|data|file):[^\s)"']+"""
REDACTED = "<redacted: possible filename>"


def scrub(text: Column) -> Column:
    """Local addresses are blanked; a text that may hold a file's name goes whole."""
    clean = F.regexp_replace(text, _URLISH, "<url>")
    return F.when(clean.rlike(_FILEISH), REDACTED).otherwise(clean)


def error_message(text: Column, most: int = 160) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _URLISH, "<url>"), r"\s+", " "))
    return F.when(clean.rlike(_FILEISH), REDACTED).when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 1), F.lit("…"))).otherwise(clean)


def error_name(text: Column) -> Column:
    name = F.regexp_extract(text, r"^([A-Za-z]*Error|[A-Za-z]*Exception)\b", 1)
    return F.when(text.isNull(), "null").when(name == "", "string").otherwise(name)


# What messages say, in the order in which it decides.
_ERRORS = [
    ("allocation|out of memory|Array buffer allocation", "out-of-memory"),
    ("EncodingError|Unable to decode|decodeAudioData|Decoding failed", "decode-failed"),
    ("dynamically imported module|Importing a module script failed|Could not locate file|failed to start", "model-load-failed"),
]


def error_code(text: Column) -> Column:
    out = F.lit("unknown-error")
    for pattern, code in reversed(_ERRORS):
        out = F.when(text.rlike("(?i)" + pattern), code).otherwise(out)
    return F.when(text.rlike("^AbortError"), "cancelled").otherwise(out)


def is_media(name: Column, mime: Column) -> Column:
    return F.coalesce(mime.rlike("^(?:audio|video)/"), F.lit(False)) | extension(name).isin(*MEDIA_EXTENSIONS)


def subtitle_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm."""
    t = round_half_up(F.greatest(F.lit(0.0), seconds) * 1000)
    return F.concat(_two(F.floor(t / 3600000)), F.lit(":"), _two(F.floor(t % 3600000 / 60000)), F.lit(":"), _two(F.floor(t % 60000 / 1000)), F.lit(mark), _two(t % 1000, 3))


# --- axes -----------------------------------------------------------------------------------------------------------------

# Seconds between marks of a time axis.
TIME_STEPS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0, 3600.0)


def nice_step(span: Column, marks: int) -> Column:
    """1, 2 or 5 times a power of ten, so that a span has at most about `marks` steps."""
    raw = span / marks
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw <= base, base).when(raw <= 2 * base, 2 * base).when(raw <= 5 * base, 5 * base).otherwise(10 * base)


def time_step(span: Column, marks: int) -> Column:
    """The least usual step of a time axis with at most `marks` marks; else the longest."""
    steps = F.array(*[F.lit(x) for x in TIME_STEPS])
    return F.coalesce(F.array_min(F.filter(steps, lambda x: x >= span / marks)), F.lit(TIME_STEPS[-1]))
