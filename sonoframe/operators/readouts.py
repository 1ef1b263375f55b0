"""Readouts that follow from measures: reports of cuts, splits, seams, joins, clipping, spectra, targets, tempo, keys and routes.

All of them are projections and aggregates over tables of measures; verdicts are codes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonoframe.functions.numeric import round_half_up
from sonoframe.kernels import filters

# Loudness targets of platforms, in LUFS.
TARGETS = [("spotify", -14.0), ("apple-music", -16.0), ("youtube", -14.0), ("amazon", -14.0), ("tidal", -14.0), ("apple-podcasts", -16.0), ("spotify-podcasts", -14.0), ("ebu", -23.0)]
# Names of intervals by semitones.
INTERVALS = ("unison", "minor second", "major second", "minor third", "major third", "perfect fourth", "tritone", "perfect fifth", "minor sixth", "major sixth", "minor seventh", "major seventh", "octave")
# Numbers of the major keys from C on, on the wheel that harmonic mixing uses.
WHEEL = (8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1)


def decibels(x: Column) -> Column:
    """20 log10(x); null where x is not positive."""
    return F.when(x > 0, 20 * F.log10(x))


# --- cuts, splits and markers -------------------------------------------------------------------------------------------


def silence_report(extents: DataFrame, silent: DataFrame, pad: float) -> DataFrame:
    """(key, gaps, cuts, removed, total, share, outcome) for (key, total) and silent (key, start, stop), each cut shorter by pad at both ends."""
    span = F.greatest(F.lit(0.0), F.col("stop") - F.col("start") - 2 * pad)
    found = silent.groupBy("key").agg(F.count("*").alias("gaps"), F.count_if(span > 0).alias("cuts"), F.sum(span).alias("removed"))
    all_ = extents.join(found, "key", "left").fillna(0, ["gaps", "cuts"]).fillna(0.0, ["removed"])
    outcome = F.when(F.col("gaps") == 0, "none").when(F.col("cuts") == 0, "padding keeps all").otherwise("cut")
    return all_.select("key", "gaps", "cuts", "removed", "total", round_half_up(F.col("removed") / F.col("total") * 100).alias("share"), outcome.alias("outcome"))


def split_at_silences(extents: DataFrame, silent: DataFrame, guard: float = 0.25) -> DataFrame:
    """(key, start, stop): parts between the middles of silences that lie clear of both ends."""
    middle = (F.col("start") + F.col("stop")) / 2
    inner = silent.select("key", middle.alias("at")).join(extents, "key").where((F.col("at") > guard) & (F.col("at") < F.col("total") - guard)).select("key", "at")
    points = inner.unionByName(extents.select("key", F.lit(0.0).alias("at"))).unionByName(extents.select("key", F.col("total").alias("at")))
    return points.withColumn("stop", F.lead("at").over(Window.partitionBy("key").orderBy("at"))).where("stop IS NOT NULL").select("key", F.col("at").alias("start"), "stop")


def split_plan(parts: DataFrame, alike: float = 0.5) -> DataFrame:
    """(key, parts, shortest, longest, even) of (key, start, stop)."""
    span = F.col("stop") - F.col("start")
    return parts.groupBy("key").agg(F.count("*").alias("parts"), F.min(span).alias("shortest"), F.max(span).alias("longest")).withColumn("even", F.col("longest") - F.col("shortest") < alike)


def clean_markers(markers: Column, total: Column, clear: float = 0.05) -> Column:
    """Markers rounded to milliseconds, once each, clear of both ends, rising."""
    rounded = F.transform(markers, lambda t: F.floor(t * 1000 + 0.5) / 1000)
    return F.array_sort(F.array_distinct(F.filter(rounded, lambda t: (t > clear) & (t < total - clear))))


def marker_segments(clips: DataFrame, least: float = 0.01) -> DataFrame:
    """(key, part, start, stop) between the markers of (key, markers, total); slivers are left out, the rest numbered."""
    edges = F.concat(F.array(F.lit(0.0)), "markers", F.array("total"))
    spans = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    kept = F.filter(spans, lambda s: s["stop"] - s["start"] > least)
    return clips.select("key", F.posexplode(kept).alias("part", "s")).select("key", "part", "s.start", "s.stop")


def clamp_selection(start: Column, stop: Column, total: Column, least: float = 0.01) -> tuple[Column, Column]:
    """A selection held inside the clip, and at least `least` long."""
    a = F.greatest(F.lit(0.0), F.least(start, total - least))
    return a, F.least(total, F.greatest(stop, a + least))


def audition_window(start: Column, stop: Column, total: Column, seconds: float = 15.0) -> tuple[Column, Column]:
    """`seconds` about the middle of a selection, moved to lie inside the clip."""
    a = F.greatest(F.lit(0.0), F.least((start + stop) / 2 - seconds / 2, total - seconds))
    return a, F.least(total, a + seconds)


# --- seams and joins ----------------------------------------------------------------------------------------------------


def edge_levels(s: DataFrame, edge: int, last: int) -> DataFrame:
    """(key, head, tail, step, stop_level) of samples (key, i, v): root mean squares of the first and last `edge` samples, the step from last to first, the peak of the last `last`."""
    n = s.join(s.groupBy("key").agg((F.max("i") + 1).alias("n")), "key")
    rms = lambda inside: F.sqrt(F.avg(F.when(inside, F.col("v") * F.col("v"))))
    return n.groupBy("key").agg(
        rms(F.col("i") < edge).alias("head"), rms(F.col("i") >= F.col("n") - edge).alias("tail"),
        F.abs(F.max(F.when(F.col("i") == 0, F.col("v"))) - F.max(F.when(F.col("i") == F.col("n") - 1, F.col("v")))).alias("step"),
        F.max(F.when(F.col("i") >= F.col("n") - last, F.abs("v"))).alias("stop_level"),
    )


def loop_seam(levels: DataFrame, gap: float) -> DataFrame:
    """(key, gap_db, step, stop_level, verdict): what repeating a clip will sound like at the join."""
    gap_db = F.when((F.col("head") > 0) & (F.col("tail") > 0), F.abs(20 * F.log10(F.col("head") / F.col("tail"))))
    verdict = F.when(F.col("stop_level") > 0.05, "ticks into silence").otherwise("stops quietly") if gap > 0 else F.when(F.col("step") > 0.03, "click").when(F.coalesce("gap_db", F.lit(math.inf)) > 4, "level jump").otherwise("clean")
    return levels.withColumn("gap_db", gap_db).select("key", "gap_db", "step", "stop_level", verdict.alias("verdict"))


def join_totals(parts: DataFrame, group: str, seconds: str, gap: float, fade: float) -> DataFrame:
    """(group, parts, with_gaps, with_fades, fade): lengths of all parts joined with gaps, or with crossfades; the fade that fits, half the shortest part at most."""
    n = F.count("*")
    out = parts.groupBy(group).agg(n.alias("parts"), (F.sum(seconds) + gap * (n - 1)).alias("with_gaps"), (F.sum(seconds) - fade * (n - 1)).alias("with_fades"), F.least(F.lit(fade), F.min(seconds) / 2).alias("fade"))
    return out


def concat_crossfade(parts: DataFrame, overlap: int) -> DataFrame:
    """(key, i, v) of parts (key, part, i, v) joined in order, each fading over `overlap` samples into the one before at equal power.

    Where a part starts comes from its key's part lengths alone; samples of one place are folded in the order of parts: in its
    fade a part weighs what is there by a cosine and itself by a sine, after it the part stands alone.
    """
    lengths = parts.groupBy("key", "part").agg((F.max("i") + 1).alias("n"))
    order = Window.partitionBy("key").orderBy("part")
    placed = lengths.select("key", "part", "n", (F.row_number().over(order) - 1).alias("k"), (F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("all"), F.count("*").over(Window.partitionBy("key")).alias("parts"))
    placed = placed.select("key", "part", "k", (F.col("before") - overlap * F.col("k")).alias("start"), F.when(F.col("k") > 0, F.least(F.lit(overlap), F.col("n"))).otherwise(0).alias("fade"), (F.col("all") - overlap * (F.col("parts") - 1)).alias("length"))
    t = F.when(F.col("fade") == 1, 1.0).otherwise(F.col("i") / (F.col("fade") - 1)) * (math.pi / 2)
    inside = F.col("i") < F.col("fade")
    laid = parts.join(placed, ["key", "part"]).select("key", "k", (F.col("start") + F.col("i")).alias("i"), "length", F.when(inside, F.cos(t)).otherwise(0.0).alias("old"), (F.when(inside, F.sin(t)).otherwise(1.0) * F.col("v")).alias("new"))
    stacked = laid.where("i >= 0 AND i < length").groupBy("key", "i").agg(F.array_sort(F.collect_list(F.struct("k", "old", "new"))).alias("x"))
    return stacked.select("key", "i", F.aggregate("x", F.lit(0.0), lambda acc, x: acc * x["old"] + x["new"]).alias("v"))


def cut_with_crossfade(s: DataFrame, start: int, stop: int, overlap: int) -> DataFrame:
    """Samples without start to stop - 1, what is left joined at equal power."""
    part = F.when(F.col("i") < start, 0).when(F.col("i") >= stop, 1)
    kept = s.withColumn("part", part).where("part IS NOT NULL")
    return concat_crossfade(kept.withColumn("i", F.when(F.col("part") == 1, F.col("i") - stop).otherwise(F.col("i"))), overlap)


def keep_with_crossfade(s: DataFrame, regions: DataFrame, overlap: int) -> DataFrame:
    """Samples inside regions (key, start, stop), in order, joined at equal power."""
    inside = s.join(regions, "key").where((F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")))
    return concat_crossfade(inside.select("key", F.col("start").alias("part"), (F.col("i") - F.col("start")).alias("i"), "v"), overlap)


def join_with_gaps(parts: DataFrame, gap: int) -> DataFrame:
    """(key, i, v) of parts (key, part, i, v) in order, with `gap` samples of silence between, none after the last."""
    lengths = parts.groupBy("key", "part").agg((F.max("i") + 1).alias("n"))
    order = Window.partitionBy("key").orderBy("part")
    placed = lengths.select("key", "part", "n", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("key")).alias("parts"), F.coalesce(F.sum(F.col("n") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    sound = parts.join(placed.select("key", "part", "start"), ["key", "part"]).select("key", (F.col("start") + F.col("i")).alias("i"), "v")
    if not gap:
        return sound
    quiet = placed.where("k < parts").select("key", F.explode(F.sequence(F.col("start") + F.col("n"), F.col("start") + F.col("n") + gap - 1)).alias("i"), F.lit(0.0).alias("v"))
    return sound.unionByName(quiet)


# --- channels and mixes --------------------------------------------------------------------------------------------------


def extract_channel(s: DataFrame, channel: int) -> DataFrame:
    """Samples (key, i, v) of one channel of (key, channel, i, v), held to those that a key has."""
    most = s.groupBy("key").agg(F.max("channel").alias("most"))
    return s.join(most, "key").where(F.col("channel") == F.least(F.lit(max(0, channel)), F.col("most"))).select("key", "i", "v")


def swap_channels(s: DataFrame) -> DataFrame:
    return s.withColumn("channel", F.when(F.col("channel") == 0, 1).when(F.col("channel") == 1, 0).otherwise(F.col("channel")))


def _held(s: DataFrame, most: float, to: float) -> DataFrame:
    """Scaled so that a key's peak is `to` where it passes `most`."""
    peaks = s.groupBy("key").agg(F.max(F.abs("v")).alias("peak"))
    return s.join(peaks, "key").withColumn("v", F.when(F.col("peak") > most, F.col("v") * to / F.col("peak")).otherwise(F.col("v"))).drop("peak")


def residual(mix: DataFrame, primary: DataFrame) -> DataFrame:
    """(key, i, v): the mix without a primary part; scaled only where its peak passes full scale."""
    both = mix.join(primary.withColumnRenamed("v", "p"), ["key", "i"], "left")
    return _held(both.select("key", "i", (F.col("v") - F.coalesce("p", F.lit(0.0))).alias("v")), 1.0, 1.0)


def mixdown(stems: DataFrame, mixer: DataFrame) -> DataFrame:
    """(key, i, v) of stems (key, stem, i, v) under a mixer (stem, level, mute, solo): if any stem is solo, only solo ones sound."""
    solo = F.max(F.col("solo").cast("int")).over(Window.partitionBy()) == 1
    heard = mixer.withColumn("heard", F.when(solo, F.col("solo")).otherwise(~F.col("mute"))).where("heard").select("stem", "level")
    summed = stems.join(F.broadcast(heard), "stem").groupBy("key", "i").agg(F.sum(F.col("v") * F.col("level")).alias("v"))  # a mixer has a row for each stem
    return _held(summed, 1.0, 0.999)


def blend(dry: DataFrame, wet: DataFrame, amount: float) -> DataFrame:
    """(key, i, v): wet by `amount` and dry by the rest."""
    return dry.join(wet.withColumnRenamed("v", "w"), ["key", "i"]).select("key", "i", (F.col("w") * amount + F.col("v") * (1 - amount)).alias("v"))


def hold_peak(source: DataFrame, effect: DataFrame, ceiling_db: float = -1.0) -> DataFrame:
    """The effect scaled so that its peak is no higher than the source's or the ceiling, whichever is higher."""
    top = source.groupBy("key").agg(F.greatest(F.max(F.abs("v")), F.lit(10 ** (ceiling_db / 20))).alias("top"))
    peak = effect.groupBy("key").agg(F.max(F.abs("v")).alias("peak"))
    both = effect.join(top, "key").join(peak, "key")
    return both.select("key", "i", F.when(F.col("peak") > F.col("top"), F.col("v") * F.col("top") / F.col("peak")).otherwise(F.col("v")).alias("v"))


# --- verdicts -----------------------------------------------------------------------------------------------------------


def boost_warning(peak: Column, gain_db: float) -> tuple[Column, Column, Column]:
    """(peak after the gain in dB, whether it clips, the gain that just does not)."""
    db = decibels(peak)
    after = db + gain_db
    return after, F.coalesce(after > 0.05, F.lit(False)), -db


def mono_fold(mid: Column, side: Column, width: float) -> Column:
    """dB that folding to mono loses after widening."""
    return F.when(mid > 0, 20 * F.log10(mid / F.sqrt(mid * mid + side * side * width * width)))


def spectrum_loss(share: Column, source_rate: Column, rate: Column) -> Column:
    """What a change of rate does to the spectrum, from the share of energy over the new limit."""
    return F.when(rate > source_rate, "upsampled").when(rate == source_rate, "kept").when(share < 0.005, "trace").when(share < 0.01, "inaudible").otherwise("duller")


def share_above(bins: DataFrame, limit: Column) -> DataFrame:
    """(key, share): of the energy of (key, bin, power) what lies at or over the limit."""
    return bins.groupBy("key").agg(F.when(F.sum("power") > 0, F.sum(F.when(F.col("bin") >= limit, F.col("power")).otherwise(0.0)) / F.sum("power")).otherwise(0.0).alias("share"))


def target_deltas(measured: DataFrame) -> DataFrame:
    """(key, target, delta, verdict) of (key, loudness): a row for each platform's target."""
    rows = F.array(*[F.struct(F.lit(n).alias("target"), F.lit(v).alias("lufs")) for n, v in TARGETS])
    each = measured.withColumn("t", F.explode(rows)).withColumn("delta", F.col("loudness") - F.col("t.lufs"))
    verdict = F.when(F.col("delta").isNull(), "nothing").when(F.abs("delta") <= 0.5, "on target").when(F.col("delta") > 0, "too loud").otherwise("quieter")
    return each.select("key", "t.target", "delta", verdict.alias("verdict"))


def meter_panel(true_peak: Column, range_: Column) -> tuple[Column, Column]:
    """(true peak close to clipping, kind of range)."""
    return true_peak > -1, F.when(range_ < 4, "narrow").when(range_ > 12, "wide").otherwise("usual")


def _within(value: Column | float, bounds: tuple[float, float]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value.cast("double") if isinstance(value, Column) else F.lit(float(value))))


def knee_constant(threshold: Column, knee: Column, ratio: Column) -> Column:
    """The constant of an exponential knee (`kernels.filters.knee_constant`) where settings are columns: a fold of fixed steps."""
    amplitude = lambda db: F.pow(F.lit(10.0), db / 20)
    low, top = amplitude(threshold), amplitude(threshold + knee)
    span = F.struct(*[F.lit(math.log(k)).alias(n) for k, n in zip(filters.KNEE_CONSTANTS, "ab")])

    def halve(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        rest = F.exp(-F.exp(middle) * (top - low))
        flat = top * rest < (low + (1 - rest) / F.exp(middle)) / ratio
        return F.struct(F.when(flat, s["a"]).otherwise(middle).alias("a"), F.when(flat, middle).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(filters.HALVINGS)), span, halve, lambda s: F.exp((s["a"] + s["b"]) / 2))


def compressor_out(db: Column, threshold: Column | float, knee: Column | float, ratio: Column | float, constant: Column | None = None) -> Column:
    """Static curve in dB: straight to the threshold, an exponential knee above it, then straight with a slope of 1 / ratio. Numbers as settings fold to literals. constant: that of the knee, where it is worked out already."""
    given = (threshold, knee, ratio)
    threshold, knee, ratio = (_within(v, b) for v, b in zip(given, (filters.THRESHOLDS, filters.KNEES, filters.RATIOS)))
    if constant is not None:
        k = constant
    elif any(isinstance(v, Column) for v in given):
        k = knee_constant(threshold, knee, ratio)
    else:
        k = F.lit(filters.knee_constant(*(filters.held(v, b) for v, b in zip(given, (filters.THRESHOLDS, filters.KNEES, filters.RATIOS)))))
    low = F.pow(F.lit(10.0), threshold / 20)
    soft = F.greatest(threshold, F.least(db, threshold + knee))
    bend = 20 * F.log10(low + (1 - F.exp(-k * (F.pow(F.lit(10.0), soft / 20) - low))) / k)
    return F.when(db <= threshold, db).otherwise(bend + F.greatest(db - threshold - knee, F.lit(0.0)) / ratio)


def held_knee_constant(threshold: Column, knee: Column, ratio: Column) -> Column:
    """The constant that `compressor_out` takes for settings that are columns."""
    return knee_constant(*(_within(v, b) for v, b in zip((threshold, knee, ratio), (filters.THRESHOLDS, filters.KNEES, filters.RATIOS))))


def auto_makeup(threshold: Column | float, knee: Column | float, ratio: Column | float, constant: Column | None = None) -> Column:
    """dB that bring back six tenths of what full scale loses."""
    return -0.6 * compressor_out(F.lit(0.0), threshold, knee, ratio, constant)


def compressor_facts(level: Column, peak: Column, threshold: float, knee: float, ratio: float, makeup: float, ceiling: float = -1.0) -> tuple[Column, Column, Column]:
    """(reduction in dB, verdict, the makeup that keeps the exported peak under the ceiling; null where it does already)."""
    reduction = level - compressor_out(level, threshold, knee, ratio)
    lower = F.when((peak > ceiling) & F.lit(makeup > 0), F.greatest(F.lit(0.0), F.floor((makeup - (peak - ceiling)) * 2) / 2))
    return reduction, F.when(lower.isNotNull(), "clips").when(reduction < 0.1, "untouched").when(reduction > 12, "heavy").otherwise("moderate"), lower


def interval(semitones: Column) -> tuple[Column, Column, Column]:
    """(name, cents beyond it, direction) of a shift; names stop at one octave."""
    steps = F.floor(F.abs(semitones) * 100 + 0.5) / 100
    whole = F.floor(steps)
    name = F.element_at(F.array(*[F.lit(x) for x in INTERVALS]), F.least(whole, F.lit(12)).cast("int") + 1)
    direction = F.when(steps == 0, "none").when(semitones > 0, "up").otherwise("down")
    return name, F.floor((steps - whole) * 100 + 0.5).cast("int"), direction


def tempo_verdict(bpm: Column, confidence: Column) -> tuple[Column, Column, Column, Column]:
    """(verdict, half-time reading, double-time reading, whether a grid is shown)."""
    verdict = F.when(bpm == 0, "none").when(confidence >= 0.55, "high").when(confidence >= 0.3, "fair").otherwise("unclear")
    return verdict, F.round(bpm / 2, 1), F.round(bpm * 2, 1), (bpm > 0) & (confidence > 0.15)


def camelot(tonic: Column, minor: Column) -> Column:
    """The code of a key on the wheel: a minor key has the number of its relative major."""
    at = F.when(minor, (tonic + 3) % 12).otherwise(tonic)
    return F.concat(F.element_at(F.array(*[F.lit(n) for n in WHEEL]), at.cast("int") + 1).cast("string"), F.when(minor, "A").otherwise("B"))


def camelot_neighbours(code: Column) -> Column:
    """The other letter, then one number down and one up."""
    number, letter = F.regexp_extract(code, r"\d+", 0).cast("int"), F.right(code, F.lit(1))
    text = lambda n: n.cast("string")
    return F.array(F.concat(text(number), F.when(letter == "A", "B").otherwise("A")), F.concat(text((number + 10) % 12 + 1), letter), F.concat(text(number % 12 + 1), letter))


def speed_interval(semitones: Column) -> tuple[Column, Column]:
    """(name, direction) of what a speed does to the pitch: none within 0.02, an interval within 0.06 of one up to an octave, whole octaves beyond, else `free`."""
    whole = F.floor(semitones + 0.5)
    size, exact = F.abs(whole), F.abs(semitones - whole) < 0.06
    name = F.element_at(F.array(*[F.lit(x) for x in INTERVALS]), F.least(size, F.lit(12)).cast("int") + 1)
    octaves = F.concat((size / 12).cast("int").cast("string"), F.lit(" octaves"))
    named = F.when(F.abs(semitones) < 0.02, "none").when(exact & (size <= 12), name).when(exact & (size % 12 == 0), octaves).otherwise("free")
    return named, F.when(F.abs(semitones) < 0.02, "none").when(semitones > 0, "up").otherwise("down")


#: Confidence under which the second key is as good a reading (fixed value).
CLOSE_KEYS = 0.34


def close_runner_up(confidence: Column, runner_up: Column) -> Column:
    """The second key where the first is not much better, else null."""
    return F.when(confidence < CLOSE_KEYS, runner_up)


def note_panel(notes: DataFrame, scale: tuple[int, ...] = (0, 2, 4, 5, 7, 9, 11)) -> DataFrame:
    """(key, note, share, in_key) of (key, note, energy): shares of the loudest note, which is taken as the tonic; of equals the lowest."""
    top = notes.groupBy("key").agg(F.max("energy").alias("most"), F.max_by("note", F.struct(F.col("energy"), -F.col("note"))).alias("tonic"))
    degree = F.pmod(F.col("note") - F.col("tonic"), F.lit(12)).cast("int")
    return notes.join(top, "key").select("key", "note", F.when(F.col("most") > 0, F.col("energy") / F.col("most")).otherwise(0.0).alias("share"), F.array_contains(F.array(*[F.lit(x) for x in scale]), degree).alias("in_key"))


def largest_boost(bands: DataFrame) -> DataFrame:
    """(key, hz, gain, kind) of (key, hz, gain): the band raised most; of equals the lowest."""
    top = bands.groupBy("key").agg(F.max_by("hz", F.struct(F.col("gain"), -F.col("hz"))).alias("hz"), F.max("gain").alias("gain"), F.min("gain").alias("low"))
    return top.select("key", "hz", "gain", F.when((F.col("gain") <= 0) & (F.col("low") >= 0), "flat").when(F.col("gain") <= 0, "cuts only").otherwise("boost").alias("kind"))


# --- sizes and routes -----------------------------------------------------------------------------------------------------


def best_bitrates(clips: DataFrame, limits: list[tuple[str, int]], ladder: tuple[int, ...]) -> DataFrame:
    """(key, limit, kbps) of (key, seconds, bytes): for each limit that the file exceeds the highest step that fits; null if none does."""
    each = clips.withColumn("l", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).cast("long").alias("fits")) for n, b in limits]))).where(F.col("bytes") > F.col("l.fits"))
    fitting = F.filter(F.array(*[F.lit(k) for k in ladder]), lambda k: F.ceil(F.col("seconds") * k * 125) <= F.col("l.fits"))
    return each.select("key", F.col("l.name").alias("limit"), F.array_max(fitting).alias("kbps"))


def recosted(total: Column, budget: Column) -> tuple[Column, Column]:
    """(parts, bytes of a part) of a route whose format or bitrate was changed by hand."""
    parts = F.greatest(F.lit(1), F.ceil(total / budget)).cast("long")
    return parts, F.ceil(total / parts).cast("long")


def verified_cuts(clips: DataFrame, attempts: int = 8) -> DataFrame:
    """(key, parts) of (key, spans, fits): spans are lists of part lengths for a rising number of parts; the first whose parts all cost at most `fits` bytes, or the last.

    All counts are worked out at once and the first that passes is taken.
    """
    passing = F.filter(F.slice("spans", 1, attempts), lambda s: F.forall(s, lambda x: x <= F.col("fits")))
    return clips.select("key", F.size(F.coalesce(F.try_element_at(passing, F.lit(1)), F.element_at("spans", -1))).alias("parts"))


def processing_estimate(clips: DataFrame, chosen: DataFrame, models: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, seconds, stems, download): of (key, seconds) under chosen (key, model): one pass a stem, and the bytes of models not yet stored."""
    wanted = chosen.distinct()
    missing = models.join(stored, "model", "left_anti")
    cost = wanted.join(F.broadcast(missing), "model", "left").groupBy("key").agg(F.count("*").alias("stems"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("download"))  # a row for each model
    return clips.join(cost, "key").select("key", (F.col("seconds") * F.col("stems")).alias("seconds"), "stems", "download")


# --- generators and frames -------------------------------------------------------------------------------------------------


def tones(clips: DataFrame, rate: int) -> DataFrame:
    """(key, i, v): sines of (key, hz, db, samples)."""
    each = clips.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1)))
    return each.select("key", "i", (F.sin(2 * math.pi * F.col("hz") * F.col("i") / rate) * F.pow(F.lit(10.0), F.col("db") / 20)).alias("v"))


def chunk_geometry(hop: Column, dim_t: Column, n_fft: Column) -> tuple[Column, Column, Column]:
    """(chunk, trim, samples made by each chunk) of a model that reads spectra of n_fft bins, dim_t frames a hop apart."""
    chunk = hop * (dim_t - 1)
    trim = F.floor(n_fft / 2).cast("long")
    return chunk, trim, chunk - 2 * trim
