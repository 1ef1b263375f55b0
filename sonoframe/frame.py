"""Clips and their blocks of samples as two DataFrames; every operator returns a new frame.

Pointwise operators stay in the JVM, on arrays. Kernels that need a channel's samples in order get them grouped by clip, which is the
unit that cannot be cut (filters carry state); parallelism comes from many clips. Where a frame says that a clip's blocks already follow one another
in one task, kernels read them as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe import schema
from sonoframe.functions import numeric as N


def channels_of(table: pa.Table) -> list[np.ndarray]:
    """The channels of one clip from its blocks, in order."""
    order = np.lexsort((np.asarray(table.column("block_idx")), np.asarray(table.column("channel"))))
    if (order != np.arange(len(order))).any():
        table = table.take(pa.array(order))
    _, first, count = np.unique(np.asarray(table.column("channel")), return_index=True, return_counts=True)
    lists = table.column("samples").combine_chunks()
    return [np.asarray(lists.slice(a, n).flatten(), np.float32) for a, n in zip(first.tolist(), count.tolist())]


def blocks_table(clip_id: str, channels: list[np.ndarray], block: int = schema.BLOCK) -> pa.Table:
    rows = [(clip_id, c, k, k * block, x[k * block : (k + 1) * block]) for c, x in enumerate(channels) for k in range(max(1, -(-len(x) // block)))]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32())]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["clip_id", "channel", "block_idx", "start", "samples"])


_CELLS = "clip_id string, rate int, start long, stop long, energy double, peak double, true_peak double"


@dataclass(frozen=True)
class AudioFrame:
    clips: DataFrame
    blocks: DataFrame
    #: The rate of all clips, set where each clip's blocks follow one another in one task: kernels then need no shuffle.
    rate: int | None = None
    #: Rows, and what makes the blocks of their record batches by mapInArrow: kernels then go on in the same Python worker, and samples do not go to the JVM and back.
    made: tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]] | None = None

    @staticmethod
    def making(clips: DataFrame, rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rate: int) -> "AudioFrame":
        """A frame whose blocks are made of rows, a clip's one after another in one task."""
        return AudioFrame(clips, rows.mapInArrow(make, schema.BLOCKS), rate, (rows, make))

    @staticmethod
    def from_arrays(spark: SparkSession, clips: dict[str, tuple[int, list[np.ndarray]]]) -> "AudioFrame":
        """A frame of small clips held by the driver: {clip_id: (rate, channels)}."""
        rows = [(k, None, None, "pcm_f32", rate, len(x), len(x[0]), len(x[0]) / rate, None) for k, (rate, x) in clips.items()]
        blocks = pa.concat_tables([blocks_table(k, x) for k, (_, x) in clips.items()])
        return AudioFrame(spark.createDataFrame(rows, schema.CLIP), spark.createDataFrame(blocks))

    # --- pointwise -------------------------------------------------------------------------------------------------

    def map_samples(self, f: Callable[[Column], Column]) -> "AudioFrame":
        return AudioFrame(self.clips, self.blocks.withColumn("samples", F.transform("samples", lambda x: f(x.cast("double")).cast("float"))))

    def gain(self, db: float, clip: bool = True) -> "AudioFrame":
        factor = 10 ** (db / 20)
        return self.map_samples(lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * factor)) if clip else x * factor)

    def invert(self) -> "AudioFrame":
        return self.map_samples(lambda x: -x)

    def scaled(self, factors: DataFrame) -> "AudioFrame":
        """Multiplies each clip by its factor in (clip_id, factor)."""
        joined = self.blocks.hint("merge").join(factors, "clip_id")
        return AudioFrame(self.clips, joined.withColumn("samples", F.transform("samples", lambda x: (x.cast("double") * F.col("factor")).cast("float"))).drop("factor"))

    def normalize_peak(self, target_db: float = -1.0) -> "AudioFrame":
        peaks = self.levels().select("clip_id", F.when(F.col("peak") > 0, F.lit(10 ** (target_db / 20)) / F.col("peak")).otherwise(1.0).alias("factor"))
        return self.scaled(peaks)

    def normalize_loudness(self, target: float = -14.0, ceiling: float = -1.0) -> "AudioFrame":
        gain = F.least(F.lit(target) - F.col("integrated"), F.lit(ceiling) - F.col("true_peak"))
        finite = gain.isNotNull() & ~F.isnan(gain) & (F.abs(gain) < float("inf"))
        return self.scaled(self.loudness().select("clip_id", F.when(finite, N.db_factor(gain)).otherwise(1.0).alias("factor")))

    def samples(self) -> DataFrame:
        """(clip_id, channel, i, v): for SQL; blocks are the cheaper form."""
        return self.blocks.select("clip_id", "channel", "start", F.posexplode("samples").alias("p", "v")).select("clip_id", "channel", (F.col("start") + F.col("p")).alias("i"), "v")

    # --- slicing -----------------------------------------------------------------------------------------------------

    def slice(self, start_s: float, stop_s: float) -> "AudioFrame":
        """The samples between two times. Blocks outside are pruned before any array is touched."""
        rated = self._rated("sample_rate", "frames")
        a = F.least(F.col("frames"), F.greatest(F.lit(0), N.round_half_up(F.lit(start_s) * F.col("sample_rate"))))
        b = F.greatest(a + 1, F.least(F.col("frames"), N.round_half_up(F.lit(stop_s) * F.col("sample_rate"))))
        cut = rated.select("*", a.alias("a"), b.alias("b")).where((F.col("start") < F.col("b")) & (F.col("start") + F.size("samples") > F.col("a")))
        first = F.greatest(F.lit(0).cast("long"), F.col("a") - F.col("start"))
        part = F.slice("samples", (first + 1).cast("int"), F.least(F.size("samples") - first, F.col("b") - F.col("start") - first).cast("int"))
        moved = cut.select("clip_id", "channel", part.alias("samples"), (F.greatest("start", "a") - F.col("a")).alias("start"))
        order = Window.partitionBy("clip_id", "channel").orderBy("start")
        blocks = moved.select("clip_id", "channel", (F.row_number().over(order) - 1).alias("block_idx"), "start", "samples")
        frames = F.greatest(F.lit(1), F.least(F.col("frames"), N.round_half_up(F.lit(stop_s) * F.col("sample_rate"))) - F.least(F.col("frames"), N.round_half_up(F.lit(start_s) * F.col("sample_rate"))))
        return AudioFrame(self.clips.withColumn("frames", frames).withColumn("duration", F.col("frames") / F.col("sample_rate")), blocks)

    def reverse(self) -> "AudioFrame":
        with_n = self._rated("frames")
        last = F.max("block_idx").over(Window.partitionBy("clip_id", "channel"))
        return AudioFrame(self.clips, with_n.select("clip_id", "channel", (last - F.col("block_idx")).alias("block_idx"), (F.col("frames") - F.col("start") - F.size("samples")).alias("start"), F.reverse("samples").alias("samples")))

    # --- aggregates -----------------------------------------------------------------------------------------------------

    def levels(self) -> DataFrame:
        """(clip_id, peak, rms): partial sums of blocks, then of clips."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [np.asarray(x.values, np.float64) if x.is_valid else np.empty(0) for x in batch.column("samples")]
                peaks = pa.array([float(np.abs(x).max()) if len(x) else None for x in lists], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("clip_id"), peaks, pa.array([float(np.square(x).sum()) for x in lists], pa.float64()), pa.array([len(x) for x in lists], pa.int64())], ["clip_id", "p", "e", "n"])

        out = "clip_id string, p double, e double, n long"
        part = self.blocks.select("clip_id", "samples").mapInArrow(run, out) if self.made is None else self._batches(run, out)
        return part.groupBy("clip_id").agg(F.max("p").alias("peak"), F.sqrt(F.sum("e") / F.sum("n")).alias("rms"))

    # --- kernels ----------------------------------------------------------------------------------------------------------

    def _batches(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
        if self.made is None:
            return self.blocks.mapInArrow(f, out)
        rows, make = self.made
        return rows.mapInArrow(lambda batches: f(make(batches)), out)

    @staticmethod
    def _in_turn(kernel: Callable[[str, int, list[np.ndarray]], pa.Table], rate: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The kernel over clips whose blocks follow one another."""

        def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                names = batch.column("clip_id").to_pylist()
                at = 0
                for stop in range(1, len(names) + 1):
                    if stop == len(names) or names[stop] != names[at]:
                        if held and held[0].column("clip_id")[0].as_py() != names[at]:
                            yield from kernel(held[0].column("clip_id")[0].as_py(), rate, channels_of(pa.Table.from_batches(held))).to_batches()
                            held = []
                        held.append(batch.slice(at, stop - at))
                        at = stop
            if held:
                yield from kernel(held[0].column("clip_id")[0].as_py(), rate, channels_of(pa.Table.from_batches(held))).to_batches()

        return in_turn

    def _per_clip(self, kernel: Callable[[str, int, list[np.ndarray]], pa.Table], out: str) -> DataFrame:
        if self.rate is not None:
            return self._batches(self._in_turn(kernel, self.rate), out)

        def run(table: pa.Table) -> pa.Table:
            return kernel(table.column("clip_id")[0].as_py(), table.column("sample_rate")[0].as_py(), channels_of(table))

        return self._rated("sample_rate").groupBy("clip_id").applyInArrow(run, out)

    def _rated(self, *columns: str) -> DataFrame:
        """The blocks with columns of their clips. Spark may take generated blocks for small, so neither side is broadcast: both are sorted by clip, as kernels need them."""
        return self.blocks.hint("merge").join(self.clips.select("clip_id", *columns), "clip_id")

    def map_channels(self, f: Callable[[np.ndarray, int], np.ndarray], rate: int | None = None) -> "AudioFrame":
        """Applies f(samples, rate) to each channel; `rate` is the new sample rate where it changes."""
        return self._map_clips(lambda xs, r: [np.asarray(f(x, r), np.float32) for x in xs], rate)

    def resample(self, to: int) -> "AudioFrame":
        from sonoframe.kernels.sampling import resample

        return self.map_channels(lambda x, r: resample(x, r, to), to)

    def equalize(self, bands: list[tuple[str, float, float, float]]) -> "AudioFrame":
        """Filters in series: (kind, Hz, dB, Q). Bands that would change nothing are left out."""
        from sonoframe.kernels.pieces import Equalizer

        some = [b for b in bands if b[0] not in ("peaking", "lowshelf", "highshelf") or abs(b[2]) > 0.01]
        return self.along(lambda r, n: Equalizer(r, n, some)) if some else self

    def echo(self, delay: float, feedback: float, mix: float) -> "AudioFrame":
        from sonoframe.kernels.filters import echo

        return self.map_channels(lambda x, r: echo(x, r, delay, feedback, mix))

    def reverb(self, decay: float, pre_delay: float = 0.02, mix: float = 0.3, seed: int = 1) -> "AudioFrame":
        from sonoframe.kernels.filters import reverb

        return self.map_channels(lambda x, r: reverb(x, r, decay, pre_delay, mix, seed))

    def compress(self, threshold: float = -24.0, knee: float = 30.0, ratio: float = 4.0, attack: float = 0.003, release: float = 0.25, makeup: float | None = None) -> "AudioFrame":
        """Channels of a clip are turned down together; without a makeup in dB the settings' own is taken."""
        from sonoframe.kernels.filters import Compressor

        return self.along(lambda r, n: Compressor(r, n, threshold, knee, ratio, attack, release, makeup))

    def along(self, make: Callable[[int, int], object]) -> "AudioFrame":
        """An effect of carried state (`kernels.pieces`), made by make(rate, channels), that keeps lengths. A clip passes through its task block by block."""
        from sonoframe.streaming.pieces import along

        return AudioFrame(self.clips, along(self._rated("sample_rate", "channels"), make))

    def _map_clips(self, f: Callable[[list[np.ndarray], int], list[np.ndarray]], rate: int | None = None) -> "AudioFrame":
        """Applies f(channels, rate), which may change the length; `rate` is the new sample rate where it changes."""
        out = self._mapped(lambda k, r, xs: blocks_table(k, f(xs, r)), rate)
        frames = out._frames().groupBy("clip_id").agg(F.sum("n").alias("frames"))
        new = F.col("sample_rate") if rate is None else F.lit(rate)
        clips = self.clips.drop("frames").withColumn("sample_rate", new).hint("merge").join(frames, "clip_id").withColumn("duration", F.col("frames") / F.col("sample_rate"))
        return AudioFrame(clips.select(*self.clips.columns), out.blocks, out.rate, out.made)

    def _mapped(self, kernel: Callable[[str, int, list[np.ndarray]], pa.Table], rate: int | None = None) -> "AudioFrame":
        """The blocks that a kernel makes of each clip; rows of clips stay."""
        blocks = self._per_clip(kernel, schema.BLOCKS)
        if self.rate is None:
            return AudioFrame(self.clips, blocks)
        made = None
        if self.made is not None:
            rows, make = self.made
            step = self._in_turn(kernel, self.rate)
            made = rows, lambda batches: step(make(batches))
        return AudioFrame(self.clips, blocks, self.rate if rate is None else rate, made)

    def _frames(self) -> DataFrame:
        """(clip_id, n): samples of the first channel, in parts."""
        if self.made is None:
            return self.blocks.where("channel = 0").select("clip_id", F.size("samples").cast("long").alias("n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = batch.filter(pa.compute.equal(batch.column("channel"), 0))
                yield pa.RecordBatch.from_arrays([first.column("clip_id"), pa.compute.list_value_length(first.column("samples")).cast(pa.int64())], ["clip_id", "n"])

        return self._batches(run, "clip_id string, n long")

    def stretch(self, factor: float) -> "AudioFrame":
        from sonoframe.kernels.rhythm import stretch

        return self._map_clips(lambda xs, r: stretch(xs, r, factor))

    def tempo_change(self, multiplier: float) -> "AudioFrame":
        return self.stretch(1 / min(4.0, max(0.25, multiplier)))

    def pitch_shift(self, semitones: float) -> "AudioFrame":
        from sonoframe.kernels.rhythm import pitch_shift

        return self._map_clips(lambda xs, r: pitch_shift(xs, r, semitones))

    def change_speed(self, factor: float) -> "AudioFrame":
        from sonoframe.kernels.rhythm import change_speed

        return self._map_clips(lambda xs, r: [change_speed(x, r, factor) for x in xs])

    # --- edits --------------------------------------------------------------------------------------------------------------

    def fade(self, first_s: float, last_s: float, curve: str = "linear") -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.fade(xs, round(first_s * r), round(last_s * r), curve))

    def trim(self, threshold_db: float = -50.0) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.trim(xs, threshold_db, max(1, round(0.1 * r))))

    def pad(self, lead_s: float, tail_s: float) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.pad(xs, round(lead_s * r), round(tail_s * r)))

    def loop(self, times: int, gap_s: float = 0.0) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.loop(xs, times, round(gap_s * r)))

    def cut_out(self, start_s: float, stop_s: float) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.cut_out(xs, r, start_s, stop_s))

    def remove_silence(self, threshold_db: float = -45.0, least_s: float = 0.4, keep_s: float = 0.08) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.remove_silence(xs, r, threshold_db, least_s, keep_s))

    def ringtone(self, start_s: float, stop_s: float, tail_s: float | None = 2.0, limit_s: float | None = 30.0) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.ringtone(xs, r, start_s, stop_s, tail_s, limit_s))

    def trimmed(self, start_s: float, stop_s: float, keep: bool = True, faded: bool = True) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.trimmed(xs, r, start_s, stop_s, keep, faded))

    def boost(self, mode: str = "gain", db: float = 6.0, target_db: float = -1.0) -> "AudioFrame":
        """Louder by a gain that is held at full scale, or normalized to a peak."""
        return self.normalize_peak(target_db) if mode == "normalize" else self.gain(db)

    def smaller(self, mono: bool = False, rate: int | None = None) -> "AudioFrame":
        """Folded to one channel, then at another rate; what is so already stays."""
        folded = self.set_channels(1) if mono else self
        return folded.resample(rate) if rate else folded

    def stereo_width(self, amount: float) -> "AudioFrame":
        from sonoframe.kernels import edit

        return self._map_clips(lambda xs, r: edit.width(xs, amount))

    def set_channels(self, n: int) -> "AudioFrame":
        from sonoframe.kernels import edit

        out = self._map_clips(lambda xs, r: edit.set_channels(xs, n))
        return AudioFrame(out.clips.withColumn("channels", F.lit(n)), out.blocks, out.rate, out.made)

    def extract_channel(self, channel: int) -> "AudioFrame":
        out = self._map_clips(lambda xs, r: [xs[min(max(0, channel), len(xs) - 1)]])
        return AudioFrame(out.clips.withColumn("channels", F.lit(1)), out.blocks, out.rate, out.made)

    def swap_channels(self) -> "AudioFrame":
        return AudioFrame(self.clips, self.blocks.withColumn("channel", F.when(F.col("channel") == 0, 1).when(F.col("channel") == 1, 0).otherwise(F.col("channel"))))

    def concat(self, order: DataFrame, crossfade_s: float = 0.0, held: bool = False) -> "AudioFrame":
        """Joins clips under new names: order holds (joined, position, clip_id); the highest rate and the most channels hold for all of a join. held: the fade is at most half of a join's shortest clip."""
        from sonoframe.kernels import edit

        rated = self._rated("sample_rate").hint("merge").join(order.select("joined", "position", "clip_id"), "clip_id")

        def run(table: pa.Table) -> pa.Table:
            name = table.column("joined")[0].as_py()
            places = np.asarray(table.column("position"))
            parts = []
            for place in np.unique(places):
                part = table.filter(pa.array(places == place))
                parts.append((part.column("sample_rate")[0].as_py(), [x.astype(np.float64) for x in channels_of(part)]))
            rate, channels = edit.crossfade_join(parts, crossfade_s) if held else edit.concat(parts, crossfade_s)
            out = blocks_table(name, [np.asarray(x, np.float32) for x in channels])
            return out.append_column("sample_rate", pa.array([rate] * out.num_rows, pa.int32()))

        joined = rated.groupBy("joined").applyInArrow(run, schema.BLOCKS + ", sample_rate int")
        facts = joined.groupBy("clip_id", "sample_rate").agg((F.max("channel") + 1).alias("channels"), F.sum(F.when(F.col("channel") == 0, F.size("samples"))).alias("frames"))
        none = lambda kind: F.lit(None).cast(kind)
        clips = facts.select("clip_id", none("string").alias("path"), none("string").alias("container"), F.lit("pcm_f32").alias("codec"), "sample_rate", "channels", "frames", (F.col("frames") / F.col("sample_rate")).alias("duration"), none("long").alias("source_bytes"))
        return AudioFrame(clips, joined.drop("sample_rate"))

    def separate(self, runner: Callable[[np.ndarray], np.ndarray], n_fft: int, hop: int, dim_f: int, dim_t: int, compensate: float = 1.0, rate: int = 44100) -> "AudioFrame":
        """The part of each clip that a model finds (`kernels.demix`), in two channels at `rate`. A clip's overlapping chunks are rows of their own, so a long one is shared by many tasks;
        where a clip's blocks already follow one another in one task, it goes through them chunk by chunk and no sample is shuffled."""
        from sonoframe.kernels.demix import demix_chunk, geometry

        frame = self.set_channels(2)
        if frame.rate != rate:
            frame = frame.resample(rate)
        chunk, trim, made = geometry(hop, dim_t, n_fft)

        def found(clip_id: str, k: int, n: int, sound: np.ndarray) -> tuple[list[str], list[int], list[int], list[int], list[np.ndarray]]:
            out = demix_chunk(sound, runner, n_fft, hop, dim_f, dim_t, compensate)[:, : n - k * made].astype(np.float32)
            return [clip_id] * 2, [0, 1], [k] * 2, [k * made] * 2, list(out)

        def rows_of(parts: list[tuple]) -> pa.Table:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32())]
            columns = [[v for part in column for v in part] for column in zip(*parts)] or [[]] * 5
            return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["clip_id", "channel", "block_idx", "start", "samples"])

        def whole(clip_id: str, rate: int, channels: list[np.ndarray]) -> pa.Table:
            n, parts = len(channels[0]), []
            for k in range(-(-n // made)):
                sound, begin = np.zeros((2, chunk)), k * made - trim
                a, b = max(0, begin), min(begin + chunk, n)
                for c, x in enumerate(channels):
                    sound[c, a - begin : b - begin] = x[a:b]
                parts.append(found(clip_id, k, n, sound))
            return rows_of(parts)

        if frame.rate is not None:
            return frame._mapped(whole)
        size = F.size("samples")
        last = F.col("start") + size - 1 + trim
        first = F.greatest(F.lit(0), F.floor((F.col("start") + trim - chunk) / made) + 1)
        ends = frame.blocks.groupBy("clip_id").agg(F.max(F.col("start") + size).alias("n"))
        facts = ends.select(F.col("clip_id").alias("of_clip"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / made))).alias("of_chunk")).where("n > 0")
        placed = frame.blocks.where(size > 0).select("clip_id", "channel", "start", "samples", F.explode(F.sequence(first.cast("long"), F.floor(last / made))).alias("chunk"))
        begin = F.col("chunk") * made - trim  # of a block only what lies in the chunk goes to it
        at, stop = F.greatest(F.col("start"), begin), F.least(F.col("start") + size, begin + chunk)
        placed = placed.where(stop > at).select("clip_id", "channel", at.alias("start"), F.slice("samples", (at - F.col("start") + 1).cast("int"), (stop - at).cast("int")).alias("samples"), "chunk")

        def run(blocks: pa.Table, facts: pa.Table) -> pa.Table:
            if not facts.num_rows or not blocks.num_rows:  # what lies beyond a clip's last chunk
                return blocks_table("", [])
            clip_id, n, k = (facts.column(c)[0].as_py() for c in ("of_clip", "n", "of_chunk"))
            sound, begin = np.zeros((2, chunk)), k * made - trim
            for c, start, samples in zip(blocks.column("channel").to_pylist(), blocks.column("start").to_pylist(), blocks.column("samples")):
                x = np.asarray(samples.values, np.float64)
                a, b = max(begin, start), min(begin + chunk, start + len(x))
                if b > a:
                    sound[c, a - begin : b - begin] = x[a - start : b - start]
            return rows_of([found(clip_id, k, n, sound)])

        blocks = placed.groupBy("clip_id", "chunk").cogroup(facts.groupBy("of_clip", "of_chunk")).applyInArrow(run, schema.BLOCKS)
        return AudioFrame(frame.clips, blocks)

    def rest(self, part: "AudioFrame") -> "AudioFrame":
        """What is left of this frame without a part of it, sample by sample; both have the same clips, channels and lengths."""
        whole, minus = (f.samples().select("clip_id", "channel", "i", F.col("v").alias(name)) for f, name in ((self, "whole"), (part, "part")))
        left = whole.join(minus, ["clip_id", "channel", "i"], "left").select("clip_id", "channel", "i", (F.col("whole") - F.coalesce("part", F.lit(0.0))).cast("float").alias("v"))
        idx = F.floor(F.col("i") / schema.BLOCK)
        listed = left.groupBy("clip_id", "channel", idx.cast("int").alias("block_idx")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("rows"))
        return AudioFrame(self.clips, listed.select("clip_id", "channel", "block_idx", (F.col("block_idx").cast("long") * schema.BLOCK).alias("start"), F.transform("rows", lambda r: r["v"]).alias("samples")))

    def tempo(self) -> DataFrame:
        from sonoframe.kernels.rhythm import tempo

        return self._per_clip(lambda k, r, xs: pa.Table.from_pylist([{"clip_id": k, **tempo(xs, r)}], schema=_arrow(schema.TEMPO)), schema.TEMPO)

    def loudness(self) -> DataFrame:
        """(clip_id, integrated, range, true_peak, peak, momentary, momentary_step). A clip is measured by stretches, on as many tasks; only energies of a tenth of a second meet."""
        from sonoframe.kernels.pieces import segment_cells

        names = ["clip_id", "rate", "start", "stop", "energy", "peak", "true_peak"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

        def run(blocks: pa.Table, facts: pa.Table) -> pa.Table:
            if not facts.num_rows or not blocks.num_rows:  # the tail of a clip's last stretch goes to none
                return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
            clip_id, rate, last = (facts.column(c)[0].as_py() for c in ("of_clip", "sample_rate", "last"))
            own = np.asarray(blocks.column("own"))
            warm = len(channels_of(blocks.filter(pa.array(~own)))[0]) if not own.all() else 0
            at = pa.compute.min(blocks.column("start")).as_py()
            cells, top = segment_cells(channels_of(blocks), rate, at, warm, last)
            cells = cells or [(at + warm, at + warm, 0.0, 0.0)]
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(clip_id, rate, *cell, top) for cell in cells]), kinds)], names)

        def stretches(clip_id: str, rate: int, channels: list[np.ndarray]) -> pa.Table:
            size, tail, n = schema.STRETCH * schema.BLOCK, schema.BLOCK, len(channels[0])
            found = []
            for at in range(0, max(1, n), size):
                warm = tail if at else 0
                cells, top = segment_cells([x[at - warm : at + size] for x in channels], rate, at - warm, warm, at + size >= n)
                found += [(clip_id, rate, *cell, top) for cell in cells or [(at, at, 0.0, 0.0)]]
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        if self.rate is not None:
            return self._loudness_of(self._per_clip(stretches, _CELLS))
        ends = self.blocks.groupBy("clip_id").agg(F.floor(F.max("block_idx") / schema.STRETCH).alias("end"))
        facts = ends.join(self.clips.select("clip_id", "sample_rate"), "clip_id").select("clip_id", "sample_rate", "end", F.explode(F.sequence(F.lit(0).cast("long"), "end")).alias("stretch"))
        facts = facts.select(F.col("clip_id").alias("of_clip"), F.col("stretch").alias("of_stretch"), "sample_rate", (F.col("stretch") == F.col("end")).alias("last"))
        stretch = F.floor(F.col("block_idx") / schema.STRETCH)
        tail = F.col("block_idx") % schema.STRETCH == schema.STRETCH - 1
        places = F.array_compact(F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")), F.when(tail, F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("own")))))
        placed = self.blocks.select("clip_id", "channel", "block_idx", "start", "samples", F.explode(places).alias("place")).select("clip_id", "channel", "block_idx", "start", "samples", "place.*")
        return self._loudness_of(placed.groupBy("clip_id", "stretch").cogroup(facts.groupBy("of_clip", "of_stretch")).applyInArrow(run, _CELLS))

    @staticmethod
    def _loudness_of(cells: DataFrame) -> DataFrame:
        from sonoframe.kernels.loudness import HOP_S
        from sonoframe.operators.gating import cell_loudness

        return cell_loudness(cells.withColumnRenamed("clip_id", "key")).select(F.col("key").alias("clip_id"), "integrated", "range", "true_peak", "peak", "momentary", F.lit(HOP_S).alias("momentary_step"))

    def keys(self) -> DataFrame:
        from sonoframe.kernels import spectrum as S

        def run(clip_id: str, rate: int, channels: list[np.ndarray]) -> pa.Table:
            weights = S.chroma(np.mean(channels, axis=0), rate)
            ranked = S.rank_keys(weights)
            score, tonic, mode = ranked[0]
            row = {"clip_id": clip_id, "tonic": tonic, "mode": mode, "name": S.key_name(tonic, mode), "camelot": S.camelot(tonic, mode), "score": score, "runner_up": S.key_name(*ranked[1][1:]), "confidence": S.key_confidence(ranked), "chroma": weights.tolist()}
            return pa.Table.from_pylist([row], schema=_arrow(schema.KEY))

        return self._per_clip(run, schema.KEY)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])
