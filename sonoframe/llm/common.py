"""Helpers that the text operators share: shared storage, hashing over Arrow buffers, token caches, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a kernel holds as Python objects at a time, and bytes of text at a time.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Rows of an Arrow batch while `materialize` writes: an executor and its Python worker hold a batch whole, in buffers that grow by doubling.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. In local mode, where one machine is all there is, a temporary one is named if the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sonoframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of a narrow table that make a partition.
NARROW_ROWS = 1 << 14


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later plans start from files that outlive any executor.

    The files go with `release`, or when the driver's JVM ends. A narrow table (a few numbers a row) is read in as many
    partitions as its rows make, so that rounds over few rows are not spread over all shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    with short_batches(spark):
        (df.observe(seen, F.count(F.lit(1)).alias("n")) if narrow else df).write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    found = spark.read.schema(df.schema).parquet(path)
    if narrow:
        rows = seen.get["n"]
        found = found.coalesce(max(1, -(-rows // NARROW_ROWS)))
        found._rows = rows
    found._stored_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` wrote, once their last reader is done.

    Spark's cleaner drops the broadcasts and shuffle files of what ran only once the driver's JVM has collected its garbage, which it puts off
    while its heap can grow; so that is asked for here.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of at most `rows` rows and about `size` bytes of `column` (a single longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    values = batch.column(column)
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


# --- memory of Python workers ------------------------------------------------------------------------------------


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends Python at most BATCH_ROWS rows at a time, or the session's own number where that is less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if 0 < int(own) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, own)


_kept: dict[Hashable, object] = {}
_kept_for: list[int] = []


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """make(), once for each Python worker: it stays from task to task, until the worker gets a task of another stage by `map_arrow`."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _begin() -> None:
    task = TaskContext.get()
    stage = [task.stageId()] if task else []
    if stage != _kept_for:
        _kept.clear()
        _kept_for[:] = stage


def _give_back() -> None:
    """Freed memory goes back to the system: Arrow's pool and the C library hold on to it, and a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, its workers keeping nothing that a task of another stage left (see `kept`) nor what they have freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        try:
            yield from kernel(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


# --- hashing -------------------------------------------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _MULT, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space) of texts laid end to end.

    data: UTF-8 bytes of all texts; offsets: where each text begins, and the end. Returns the hashes in order and,
    for each text, the index of its first word (one more entry than texts). All in numpy: a polynomial in the bytes
    modulo 2**64, from prefix sums, and the splitmix64 finaliser.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    ends = np.flatnonzero(last) + 1
    up, down = power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mix64(hashes + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, from 0; a null is an empty text. No copy is made of a column without nulls."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text and the index of the text; a shorter text with words gives one shingle of all of them."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    if len(words) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(words) - width + 1
    if n > 0:
        value = np.zeros(n, np.uint64)
        for i in range(width):
            value = mix64(value * np.uint64(31) + words[i : i + n])
        whole = text[:n] == text[width - 1 :]
        value, at = value[whole], text[:n][whole]
    else:
        value, at = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for j, k in enumerate(short):
            v = np.zeros(1, np.uint64)
            for w in words[first[k] : first[k + 1]]:
                v = mix64(v * np.uint64(31) + w)
            extra[j] = mix64(v + np.uint64(counts[k]))[0]
        value, at = np.concatenate([value, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return value, at


# --- caches of what a tokenizer makes of a chunk ----------------------------------------------------------------

#: A longer run of bytes is worked out anew each time; the cache takes no more entries than these, and is emptied after as many misses.
CHUNK_BYTES, CACHE_ENTRIES = 48, 200_000


class _Known(dict):
    """Looks in `extra` for what it does not hold itself."""

    extra: dict = {}

    def __missing__(self, key):
        return self.extra[key]


class ChunkCache:
    """Values of the white-space-separated chunks of texts; frequent chunks come early and stay, the rest is worked out anew."""

    def __init__(self, compute: Callable[[list[bytes]], list], entries: int = CACHE_ENTRIES):
        self.compute, self.entries, self.known, self.missed = compute, entries, _Known(), 0

    def of(self, chunk_lists: list[list[bytes]]) -> dict[bytes, object]:
        """A mapping that holds the value of every chunk of the lists until the next call."""
        known = self.known
        wanted = set().union(*chunk_lists)
        missing = [c for c in wanted if c not in known]
        known.extra = {}
        if not missing:
            return known
        if self.missed > 2 * self.entries:
            known.clear()
            self.missed, missing = 0, list(wanted)
        new = dict(zip(missing, self.compute(missing)))
        self.missed += len(missing)
        if len(known) + len(missing) <= self.entries:
            known.update(new if max(map(len, missing)) <= CHUNK_BYTES else {c: v for c, v in new.items() if len(c) <= CHUNK_BYTES})
        known.extra = new
        return known


def segments(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Cuts a long text at white space into parts of about `size` bytes; no chunk is cut."""
    at = 0
    while len(text) - at > size:
        stop = at + size
        cut = max(text.rfind(b" ", at, stop), text.rfind(b"\n", at, stop))
        if cut <= at:
            found = [x for x in (text.find(b" ", stop), text.find(b"\n", stop)) if x >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


# --- connected components ----------------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of a task's links (u, v); the root is the least node of the component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = root(u), root(v)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b: long): rows (node, root), root being the least node of the component.

    Alternates large-star and small-star steps (Kiveris et al., 2014). A hub's neighbours are joined with the hub's
    minimum, which is pre-aggregated, so no list of neighbours is ever built. Each step is written to the shared
    folder, and the one before is deleted; the number of rounds grows with the logarithm of the number of nodes. So few
    links that `materialize` reads them as one partition (at most `NARROW_ROWS`) are settled by that partition's task, without
    rounds: their plans would cost the driver far more than the links. Nodes without a link aren't returned.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges", narrow=True)
    if edges._rows <= NARROW_ROWS:
        found = materialize(map_arrow(edges, _forest, "node long, root long"), "components", narrow=True)
        release(edges)
        return found
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        kept = low.where("m < u").select("u", F.col("m").alias("v"))
        star = materialize(large.unionByName(kept).distinct(), "stars", narrow=True)  # read three times below
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        seen = Observation()  # what tells a round from the one before comes with its write
        new = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, materialize(new.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges", narrow=True)
        release(old, star)
        now = seen.get
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components", narrow=True)
    release(edges)
    return found


# --- Bloom filters ------------------------------------------------------------------------------------------------

#: Bits for each key, and the most bits of a filter: 16 MB to broadcast. More keys than 1e7 only make it let more through.
BLOOM_KEY_BITS, BLOOM_MOST_BITS = 12, 1 << 27


class Bloom:
    """A Bloom filter over pairs of longs (hashes). It is built by an aggregate of its words, of which there are few."""

    def __init__(self, keys: DataFrame, k1: str, k2: str, rows: int | None = None):
        n = max(1, keys.count() if rows is None else rows)
        self.bits = min(BLOOM_MOST_BITS, max(1 << 16, 1 << (BLOOM_KEY_BITS * n - 1).bit_length()))
        mask = F.lit(self.bits - 1)
        places = F.array(F.col(k1).bitwiseAND(mask), F.shiftrightunsigned(F.col(k1), 32).bitwiseAND(mask), F.col(k2).bitwiseAND(mask))
        words = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))
        self.words = np.zeros(self.bits >> 6, np.uint64)
        found = words.toArrow()
        self.words[np.asarray(found.column("w"), np.int64)] = np.asarray(found.column("bits"), np.int64).view(np.uint64)

    def hits(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        k1, k2, mask = k1.view(np.uint64), k2.view(np.uint64), np.uint64(self.bits - 1)
        out = np.ones(len(k1), bool)
        for p in (k1 & mask, (k1 >> np.uint64(32)) & mask, k2 & mask):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def split_by_bloom(df: DataFrame, bloom, k1: str, k2: str, hit: bool) -> DataFrame:
    """The rows whose keys the broadcast filter lets through (or the others); a shuffle of the rest is spared. Only the keys go to Python."""

    @F.arrow_udf("boolean")
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(bloom.value.hits(*(np.asarray(x).astype(np.int64) for x in (a, b))) == hit)

    return df.where(found(k1, k2))
