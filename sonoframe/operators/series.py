"""Operators over sampled series: tables of (key, i, v), where i counts the samples of a key from 0.

All of them are DataFrame plans: maps stay in one stage; what is one number a key is pre-aggregated and joined back, so that a
long key is never held by one task for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions import numeric as N


def _by(key: str) -> Window:
    return Window.partitionBy(key)


def sampled(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, i, v) of a table: i numbers a key's rows in `order`."""
    return df.select(F.col(key).alias("key"), (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("i"), F.col(value).cast("double").alias("v"))


def with_length(s: DataFrame) -> DataFrame:
    return s.join(s.groupBy("key").agg((F.max("i") + 1).alias("n")), "key")


# --- pointwise -----------------------------------------------------------------------------------------------------


def gain(s: DataFrame, db: float, clip: float | None = 1.0) -> DataFrame:
    v = F.col("v") * N.db_factor(db)
    return s.withColumn("v", v if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), v)))


def normalize_peak(s: DataFrame, target_db: float = -1.0) -> DataFrame:
    """Scales each key so that its peak is at target_db; silence stays."""
    peaks = s.groupBy("key").agg(F.max(F.abs("v")).alias("peak"))
    return s.join(peaks, "key").withColumn("v", F.when(F.col("peak") > 0, F.col("v") * N.db_factor(target_db) / F.col("peak")).otherwise(F.col("v"))).drop("peak")


def invert(s: DataFrame) -> DataFrame:
    return s.withColumn("v", -F.col("v"))


def fade(s: DataFrame, rise: int, fall: int, curve: str = "linear") -> DataFrame:
    """Fades over the first `rise` samples and the last `fall` of what is left."""
    s = with_length(s)
    first = F.least(F.lit(rise), F.col("n"))
    last = F.least(F.lit(fall), F.col("n") - first)
    up = F.when(F.col("i") < first, N.fade_gain(F.col("i") / first, curve)).otherwise(1.0)
    left = F.col("n") - 1 - F.col("i")
    down = F.when(left < last, N.fade_gain(left / last, curve)).otherwise(1.0)
    return s.select("key", "i", (F.col("v") * up * down).alias("v"))


def stereo_width(s: DataFrame, left: str, right: str, width: float) -> DataFrame:
    """Widens (l, r) columns by scaling their difference; held to +-1."""
    mid, side = (F.col(left) + F.col(right)) / 2, (F.col(left) - F.col(right)) / 2 * F.lit(width)
    hold = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    return s.withColumns({left: hold(mid + side), right: hold(mid - side)})


#: Gains of speaker layouts folded to two channels, (layout, from, to, gain).
FOLD = [
    (1, 0, 0, 1.0), (1, 0, 1, 1.0), (2, 0, 0, 1.0), (2, 1, 1, 1.0), (4, 0, 0, 0.5), (4, 2, 0, 0.5), (4, 1, 1, 0.5), (4, 3, 1, 0.5),
    (6, 0, 0, 1.0), (6, 2, 0, 0.5**0.5), (6, 4, 0, 0.5**0.5), (6, 1, 1, 1.0), (6, 2, 1, 0.5**0.5), (6, 5, 1, 0.5**0.5),
]


def to_mono(s: DataFrame) -> DataFrame:
    """(key, channel, i, v) to one channel, the mean of all."""
    return s.groupBy("key", "i").agg(F.avg("v").alias("v"))


def fold_to_stereo(s: DataFrame, layout: int) -> DataFrame:
    """(key, channel, i, v) of a layout of 1, 2, 4 or 6 channels to two, by the table of gains."""
    gains = s.sparkSession.createDataFrame([(f, t, g) for k, f, t, g in FOLD if k == layout], "channel int, to int, gain double")
    return s.join(F.broadcast(gains), "channel").groupBy("key", F.col("to").alias("channel"), "i").agg(F.sum(F.col("v") * F.col("gain")).alias("v"))


# --- slicing -------------------------------------------------------------------------------------------------------


def slice_samples(s: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Samples start to stop - 1 (both held to the key's length), numbered from 0; an empty slice is one sample of silence."""
    s = with_length(s)
    a = F.greatest(F.lit(0), F.least(start, F.col("n")))
    b = F.greatest(a, F.least(stop, F.col("n")))
    kept = s.select("key", "i", "v", a.alias("a"), b.alias("b"))
    inside = kept.where("i >= a AND i < b").select("key", (F.col("i") - F.col("a")).alias("i"), "v")
    empty = kept.where("a >= b").select("key", F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("v")).distinct()
    return inside.unionByName(empty)


def cut_out(s: DataFrame, start: int, stop: int) -> DataFrame:
    """Drops samples start to stop - 1 and closes the gap."""
    return s.where((F.col("i") < start) | (F.col("i") >= stop)).withColumn("i", F.when(F.col("i") >= stop, F.col("i") - (stop - start)).otherwise(F.col("i")))


def trim_ends(s: DataFrame, threshold_db: float = -50.0, quiet_length: int = 1) -> DataFrame:
    """Drops what is at or under the threshold at both ends; a key that is quiet throughout keeps its first quiet_length samples."""
    loud = F.abs("v") > N.db_factor(threshold_db)
    s = s.join(s.groupBy("key").agg(F.min(F.when(loud, F.col("i"))).alias("a"), F.max(F.when(loud, F.col("i"))).alias("b")), "key")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(quiet_length - 1))
    return s.where((F.col("i") >= a) & (F.col("i") <= b)).select("key", (F.col("i") - a).alias("i"), "v")


def reverse(s: DataFrame) -> DataFrame:
    return with_length(s).select("key", (F.col("n") - 1 - F.col("i")).alias("i"), "v")


def pad_silence(s: DataFrame, lead: int, tail: int) -> DataFrame:
    """Zeros before and after."""
    ends = s.groupBy("key").agg((F.max("i") + 1).alias("n"))
    before = ends.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lead - 1).cast("long"))).alias("i"), F.lit(0.0).alias("v")) if lead else None
    after = ends.select("key", F.explode(F.sequence(F.col("n") + lead, F.col("n") + lead + tail - 1)).alias("i"), F.lit(0.0).alias("v")) if tail else None
    out = s.withColumn("i", F.col("i") + lead)
    for part in (before, after):
        out = out if part is None else out.unionByName(part)
    return out


def loop(s: DataFrame, times: int, gap: int = 0) -> DataFrame:
    """Repeats each key with `gap` zeros between, none after the last."""
    n = with_length(s)
    turns = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select("key", (F.col("k") * (F.col("n") + gap) + F.col("i")).cast("long").alias("i"), "v")
    if not gap or times < 2:
        return turns
    ends = s.groupBy("key").agg((F.max("i") + 1).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 2)))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(gap - 1))))
    return turns.unionByName(ends.select("key", (F.col("k") * (F.col("n") + gap) + F.col("n") + F.col("g")).cast("long").alias("i"), F.lit(0.0).alias("v")))


def split_equal(lengths: DataFrame, parts: int) -> DataFrame:
    """(key, part, start, stop) of (key, n): `parts` even spans of samples."""
    k = lengths.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    at = lambda p: N.round_half_up(F.col("n") * p / parts)
    return k.select("key", "part", at(F.col("part")).alias("start"), at(F.col("part") + 1).alias("stop"))


def split_length(lengths: DataFrame, length: int, sliver: int) -> DataFrame:
    """(key, part, start, stop): spans of `length` samples; a last one shorter than `sliver` joins the one before."""
    cuts = F.greatest(F.lit(1), F.ceil((F.col("n") - sliver) / F.lit(length)))
    k = lengths.withColumn("parts", cuts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    return k.select("key", "part", (F.col("part") * length).cast("long").alias("start"), F.when(F.col("part") == F.col("parts") - 1, F.col("n")).otherwise((F.col("part") + 1) * length).cast("long").alias("stop"))


def stride_sample(s: DataFrame, stride: int) -> DataFrame:
    return s.where(F.col("i") % stride == 0)


#: Most pairs that a scatter of two channels is drawn from (fixed value).
SCATTER_PAIRS = 12_000


def strided_pairs(s: DataFrame, lengths: DataFrame, most: int = SCATTER_PAIRS) -> DataFrame:
    """(key, k, l, r) of (key, i, l, r): every stride-th pair, at most `most`. The stride is one more than the whole quotient, so that it is no round part of a rate; the last sample is never taken."""
    stride = F.floor(F.col("n") / F.least(F.lit(most), F.col("n"))) + 1
    at = s.join(lengths.select("key", "n", stride.alias("stride")), "key").where(F.col("i") % F.col("stride") == 0)
    at = at.where((F.col("i") + 1 < F.col("n")) & (F.col("i") / F.col("stride") < F.floor(F.col("n") / F.col("stride"))))
    return at.select("key", (F.col("i") / F.col("stride")).cast("long").alias("k"), "l", "r")


def spread_blocks(s: DataFrame, size: int, most: int) -> DataFrame:
    """Adds (b, p): samples of at most `most` blocks of `size`, spread evenly from the first sample to the last; p is the place in the block. Shorter keys have none.

    Where a block may begin follows from its number, and so does the number from a sample's place: no join with the blocks.
    """
    n = s.groupBy("key").agg((F.max("i") + 1).alias("_n")).where(F.col("_n") >= size)
    last, room = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("_n") / size))) - 1, F.col("_n") - size
    sized = s.join(n.select("key", last.cast("long").alias("_k"), room.cast("long").alias("_d")), "key")
    b = F.when((F.col("_k") == 0) | (F.col("_d") == 0), 0).otherwise(F.least(F.col("_k"), F.expr("(_k * (i + 1) + _d - 1) div _d - 1")))
    placed = sized.withColumn("b", b.cast("long")).withColumn("p", F.col("i") - F.expr("b * _d div greatest(1, _k)"))
    return placed.where(F.col("p") < size).drop("_k", "_d")


def block_correlation(stereo: DataFrame, size: int, most: int = 600) -> DataFrame:
    """(key, b, correlation, energy) of (key, i, l, r): likeness of two channels block by block; silent blocks read 0 and weigh nothing."""
    sums = spread_blocks(stereo, size, most).groupBy("key", "b").agg(F.sum(F.col("l") * F.col("r")).alias("lr"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    scale = F.sqrt(F.col("ll") * F.col("rr"))
    return sums.select("key", "b", F.when(scale > 1e-12, F.col("lr") / scale).otherwise(0.0).alias("correlation"), (F.col("ll") + F.col("rr")).alias("energy"))


def overall_correlation(blocks: DataFrame) -> DataFrame:
    """(key, blocks, overall, least) of block_correlation's rows, weighted by energy; 0 for silence."""
    overall = F.when(F.sum("energy") > 0, F.sum(F.col("correlation") * F.col("energy")) / F.sum("energy")).otherwise(0.0)
    return blocks.groupBy("key").agg(F.count("*").alias("blocks"), overall.alias("overall"), F.min("correlation").alias("least"))


def waveform_tiles(columns: DataFrame, width: int = 1024, height: int = 256) -> DataFrame:
    """(key, tile, columns, png) of (key, col, low, high, rms): pictures of `width` columns each, the last of a key narrower; columns that are missing stay dark."""
    from sonoframe.kernels.raster import draw, png

    kind = columns.schema["key"].dataType.simpleString()
    tiled = columns.select("key", F.floor(F.col("col") / width).alias("tile"), (F.col("col") % width).cast("int").alias("x"), *[F.col(c).cast("double").alias(c) for c in ("low", "high", "rms")])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("x"))
        n = int(x.max()) + 1
        out = np.zeros((height, n), np.uint8)
        out[:, x] = draw(*(np.asarray(table.column(c)) for c in ("low", "high", "rms")), height)
        return pa.table({"key": table.column("key").slice(0, 1), "tile": table.column("tile").slice(0, 1), "columns": pa.array([n], pa.int32()), "png": pa.array([png(out)], pa.binary())})

    return tiled.groupBy("key", "tile").applyInArrow(run, f"key {kind}, tile long, columns int, png binary")


# Centres of the octave bands of a mono report, and how far under the loudest a band has no reading.
OCTAVES, READABLE = (63, 125, 250, 500, 1000, 2000, 4000, 8000, 16000), 1e-4


def side_shares(stereo: DataFrame, rate: float, size: int = 4096, most: int = 48) -> DataFrame:
    """(key, hz, share, lost) of (key, i, l, r): what part of each octave band, and of all, is in the difference of two channels and goes when they are summed.

    Spectra of evenly spread frames are worked out frame by frame; only their bands' energies meet at a key. A band 40 dB under the loudest has no share.
    """
    frames = spread_blocks(stereo, size, most).groupBy("key", "b").agg(F.array_sort(F.collect_list(F.struct("p", "l", "r"))).alias("rows"))
    whole = frames.select("key", F.transform("rows", lambda x: x["l"].cast("double")).alias("l"), F.transform("rows", lambda x: x["r"].cast("double")).alias("r"))
    kind = stereo.schema["key"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, half = rate / size, size // 2
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        spans = [(max(1, math.floor(c / math.sqrt(2) / width)), min(half - 1, math.ceil(c * math.sqrt(2) / width))) for c in OCTAVES]
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.asarray(batch.column(c).flatten(), np.float64).reshape(-1, size) for c in "lr")
            mid, side = (np.abs(np.fft.rfft(x / 2 * window, axis=1)[:, :half]) ** 2 for x in (left + right, left - right))
            for hz, (a, b) in [(0, (1, half - 1)), *zip(OCTAVES, spans)]:
                rows = [pa.array(x[:, a : b + 1].sum(axis=1)) for x in (mid, side)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([hz] * batch.num_rows, pa.int32()), *rows], ["key", "hz", "mid", "side"])

    bands = whole.mapInArrow(kernel, f"key {kind}, hz int, mid double, side double").groupBy("key", "hz").agg(F.sum("mid").alias("mid"), F.sum("side").alias("side"))
    total = F.col("mid") + F.col("side")
    lost = bands.where("hz = 0").select("key", F.when(total > 0, F.col("side") / total).otherwise(0.0).alias("lost"))
    tops = bands.where("hz > 0").groupBy("key").agg(F.max(total).alias("top"))
    share = F.when((total > 0) & (total >= F.col("top") * READABLE), F.col("side") / total)
    return bands.where("hz > 0").join(tops, "key").join(lost, "key").select("key", "hz", share.alias("share"), "lost")


def typical_level(s: DataFrame, window: int, floor_db: float = -60.0, share: float = 0.95) -> DataFrame:
    """(key, level) of (key, i, v), all channels together: the level in dB that `share` of the windows' peaks stay under; windows of near silence don't count, a last part one neither.

    Equal levels are counted before they are ranked.
    """
    n = s.groupBy("key").agg((F.max("i") + 1).alias("n"))
    peaks = s.groupBy("key", F.floor(F.col("i") / window).alias("w")).agg(F.max(F.abs("v")).alias("peak")).join(n, "key").where(((F.col("w") + 1) * window <= F.col("n")) & (F.col("peak") > 1e-5))
    counted = peaks.groupBy("key", "peak").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("key").orderBy("peak"))
    rank = F.least(F.sum("m").over(Window.partitionBy("key")) - 1, F.floor(F.sum("m").over(Window.partitionBy("key")) * share))
    top = counted.select("key", "peak", upto.alias("upto"), rank.alias("rank")).where("upto > rank").groupBy("key").agg(F.min("peak").alias("peak"))
    return n.select("key").join(top, "key", "left").select("key", F.coalesce(20 * F.log10("peak"), F.lit(floor_db)).alias("level"))


def probe_ranges(lengths: DataFrame, span: int, centres: tuple[float, ...] = (0.2, 0.5, 0.8)) -> DataFrame:
    """(key, start, stop): at most `span` samples around shares of each key, equal starts once."""
    size = F.least(F.lit(span), F.col("n"))
    starts = F.array_distinct(F.array(*[F.greatest(F.lit(0), F.least(F.col("n") - size, N.round_half_up(F.col("n") * c - size / 2))).cast("long") for c in centres]))
    return lengths.select("key", F.explode(starts).alias("start"), size.alias("size")).select("key", "start", (F.col("start") + F.col("size")).alias("stop"))


def concat_offsets(parts: DataFrame, group: str, order: str, length: str, overlap: int = 0, block: int = 100_000) -> DataFrame:
    """Where each part of a group begins when they are joined, each overlapping the one before by at most its own length.

    `order` is a whole number, unique in its group. Running sums are kept inside blocks of its values; the blocks of a group,
    of which there are few, are summed by themselves.
    """
    blocked = parts.withColumn("_b", F.floor(F.col(order) / block))
    inside = Window.partitionBy(group, "_b").orderBy(order)
    shared = F.when(F.row_number().over(inside) == 1, 0).otherwise(F.least(F.lit(overlap), F.col(length), F.lag(length, 1, 0).over(inside)))
    placed = blocked.withColumn("_shared", shared).withColumn("_at", F.sum(F.col(length) - F.col("_shared")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length))
    sums = placed.groupBy(group, "_b").agg(F.sum(F.col(length) - F.col("_shared")).alias("_sum"), F.min_by(length, order).alias("_first"), F.max_by(length, order).alias("_last"))
    across = Window.partitionBy(group).orderBy("_b")
    seam = F.coalesce(F.least(F.lit(overlap), F.col("_first"), F.lag("_last").over(across)), F.lit(0))
    seam = F.when(F.row_number().over(across) == 1, 0).otherwise(seam)
    starts = sums.withColumn("_seam", seam).withColumn("_start", F.sum(F.col("_sum") - F.col("_seam")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum"))
    return placed.join(starts.select(group, "_b", "_start"), [group, "_b"]).withColumn("start", F.col("_start") + F.col("_at")).drop("_b", "_shared", "_at", "_start")


def finest_covering(scans: DataFrame, columns: list[tuple[int, int]]) -> DataFrame:
    """(key, at, scan): for each column (from, to) of a key the scan (key, scan, start, stop, step) with the least step that covers all of it; of equals the least."""
    each = scans.withColumn("c", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(b).cast("long").alias("to")) for a, b in columns])))
    covering = each.where((F.col("start") <= F.col("c.at")) & (F.col("stop") >= F.col("c.to")))
    return covering.groupBy("key", F.col("c.at").alias("at")).agg(F.min_by("scan", F.struct("step", "scan")).alias("scan"))


# --- aggregates ------------------------------------------------------------------------------------------------------


def levels(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Peak and root mean square of each group."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.max(F.abs(v)).alias("peak"), F.sqrt(F.sum(v * v) / F.count(v)).alias("rms"))


def envelope(s: DataFrame, width: int, floor_db: float = -80.0) -> DataFrame:
    """(key, w, rms, db) of windows of `width` samples."""
    out = s.groupBy("key", F.floor(F.col("i") / width).alias("w")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return out.withColumn("db", N.amplitude_db(F.col("rms"), floor_db))


def waveform_columns(s: DataFrame, columns: int) -> DataFrame:
    """(key, col, min, max, rms): a picture of each key in `columns` columns; min and max include 0, the last column takes the rest."""
    s = with_length(s)
    per = F.greatest(F.lit(1), F.floor(F.col("n") / columns))
    col = F.least(F.lit(columns - 1), F.floor(F.col("i") / per))
    return s.groupBy("key", col.alias("col")).agg(F.least(F.lit(0.0), F.min("v")).alias("min"), F.greatest(F.lit(0.0), F.max("v")).alias("max"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def correlation_about_zero(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Sum of products over the root of the sums of squares, not centred; 1 where one side is silent."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sums = df.groupBy(*keys).agg(F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"))
    power = F.col("_xx") * F.col("_yy")
    return sums.select(*keys, F.when(power > 0, F.col("_xy") / F.sqrt(power)).otherwise(1.0).alias("correlation"))


def mid_side(df: DataFrame, keys: list[str], left: str, right: str, width: float = 1.0) -> DataFrame:
    """Levels of sum and difference, and the peak that a width gives."""
    m, d = (F.col(left) + F.col(right)) / 2, (F.col(left) - F.col(right)) / 2
    return df.groupBy(*keys).agg(F.sqrt(F.avg(m * m)).alias("mid"), F.sqrt(F.avg(d * d)).alias("side"), F.max(F.abs(m) + F.abs(d) * width).alias("peak"))


def onset_envelope(e: DataFrame, key: str = "key", index: str = "w", value: str = "rms") -> DataFrame:
    """Half-wave rectified rise of an envelope, less its mean, cut at 0."""
    w = Window.partitionBy(key).orderBy(index)
    rise = F.greatest(F.lit(0.0), F.col(value) - F.lag(value, 1, 0.0).over(w))
    out = e.select(key, index, rise.alias("rise"))
    return out.withColumn("onset", F.greatest(F.lit(0.0), F.col("rise") - F.avg("rise").over(Window.partitionBy(key))))


def smooth(e: DataFrame, taps: tuple[float, ...], key: str, index: str, value: str) -> DataFrame:
    """A symmetric kernel over neighbours; where it hangs over an end, the taps inside are weighed anew."""
    w = Window.partitionBy(key).orderBy(index)
    half = len(taps) // 2
    total, norm = F.lit(0.0), F.lit(0.0)
    for k, tap in enumerate(taps):
        x = F.lag(value, half - k).over(w) if k <= half else F.lead(value, k - half).over(w)
        total, norm = total + F.coalesce(x * tap, F.lit(0.0)), norm + F.when(x.isNotNull(), tap).otherwise(0.0)
    return e.withColumn("smooth", total / norm)


def autocorrelation(e: DataFrame, lags: int, key: str, index: str, value: str) -> DataFrame:
    """(key, lag, acf): mean product of values `lag` apart, by one equi-join on the shifted index."""
    shifted = e.select(F.col(key), F.col(index), F.col(value), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")).select(key, (F.col(index) + F.col("lag")).alias(index), "lag", F.col(value).alias("_x"))
    return e.select(key, index, value).join(shifted, [key, index]).groupBy(key, "lag").agg(F.avg(F.col(value) * F.col("_x")).alias("acf"))


def reduction_db(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """How much quieter `after` is: 0 if there was silence before, infinite if there is silence after."""
    a, b = F.sqrt(F.avg(F.col(before) ** 2)), F.sqrt(F.avg(F.col(after) ** 2))
    return df.groupBy(*keys).agg(a.alias("_a"), b.alias("_b")).select(*keys, F.when(F.col("_a") <= 0, 0.0).when(F.col("_b") <= 0, float("inf")).otherwise(20 * F.log10(F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")))).alias("reduction_db"))
