"""Near-duplicate documents by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF weighted word shingles.

A document is the set of its runs of five words. A run's weight is (1 + ln tf) times a smoothed inverse document
frequency: 2 for runs in at most `COMMON` of all documents, falling to 1 for runs in all of them. Document frequencies of
the common runs are exact over the corpus: lossy counting in every task names the few that may be common (fewer than
1 / COMMON runs for each run of a mean document), one more pass counts those.

Consistent weighted samples of a document collide with another's with probability equal to their weighted Jaccard
similarity; `BANDS` bands of `ROWS` samples make the candidates, and the weighted Jaccard similarity itself decides.

Equal texts are one node from the start. In each bucket the node that shares most buckets with others is the centre, and
each other node is compared with it: where a group of copies has an original, that is the centre. If y is not linked to its
centre x, then y can only be linked to nodes z that differ from x in runs in which y does (else similarity(y, z) <=
similarity(y, x)), and the nearer z is to x, the less that takes. So those still apart are compared with the member most
similar to the centre, then with the next one, until a round links nothing. A large group of copies costs a few comparisons
a node, and no list of members is gathered in one task. What buckets still hold apart then is joined exactly: runs are ordered
from rare to frequent, and of two texts over the threshold the first run that both have lies in the first tenth or so of the shorter's weight and in
the first fifth of the longer's (prefix filter), so pairs that share such a run are compared, all of them. Texts alike in a
template alone share none.

Defined cases: null and empty texts, and texts without words, are equal to texts of the same bytes alone; shorter texts
than five words are one run; repeated rows are one group; a null id is a member like others and never a group's name
unless all are null; where the least id of a group stands on several of its texts, or on several rows, one of them stays (the
one with the least hashes); an empty table gives no rows; very long texts are taken whole; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import Bloom, components, map_arrow, materialize, mix64, release, segments, shingle_hashes, short_batches, slices, split_by_bloom, table, text_buffer, word_hashes

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 10, 3
#: Runs in more than this share of the documents are common; lossy counting errs by at most the second share.
COMMON, COUNT_ERROR = 0.05, 0.01
#: Counts by which runs are ordered from rare to frequent. Runs that share one only change the order.
RARITY = 1 << 18
#: 64-bit words of the mask that marks which rare runs a text has, in the join of what buckets hold apart.
MASK_WORDS = 16
#: Parts that the members of one centre are dealt into while they are compared.
SALTS = 64
#: An id below all others stands for null.
_NULL_ID = -(1 << 63)
#: Bytes of text that a kernel hashes at a time: its arrays are some fifty times as large.
SLICE = 1 << 19

Frequencies = tuple[np.ndarray, np.ndarray]


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, first): the distinct runs of each text, and where each text's begin."""
    data, offsets = text_buffer(texts)
    if len(data) <= 4 * SLICE:
        words, first = word_hashes(data, offsets)
    else:  # a very long text: its words are hashed in parts cut at white space, each part's arrays being freed in turn
        lists = [np.concatenate([word_hashes(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0] for part in segments(data[a:b].tobytes(), SLICE)]) for a, b in zip(offsets[:-1], offsets[1:])]
        words, first = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    runs, at = shingle_hashes(words, first, WIDTH)
    if not len(runs):
        return runs, np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    order = np.lexsort((runs, at))
    runs, at = runs[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (at[1:] != at[:-1])]))
    counts = np.diff(np.append(new, len(runs)))
    return runs[new], counts, np.searchsorted(at[new], np.arange(len(texts) + 1))


def _log_weights(runs: np.ndarray, counts: np.ndarray, common: Frequencies) -> np.ndarray:
    weight = np.where(counts == 1, 1.0, 1.0 + np.log(counts)) * 2.0
    known, idf = common
    if len(known) and len(runs):
        k = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        hit = known[k] == runs
        weight[hit] *= idf[k[hit]] / 2.0
    return np.log(weight).astype(np.float32)


def common_runs(docs: DataFrame) -> Frequencies:
    """Hashes of the common runs, sorted, and their inverse document frequencies, between 1 and 2."""
    total = docs.count()
    if not total:
        return np.empty(0, np.uint64), np.empty(0)
    least_docs = int(2 / COUNT_ERROR)

    def may_be_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = counts > n * COUNT_ERROR  # of few documents every run goes on: one that is left out of a count weighs too much
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often], pa.int64())], ["run", "n"])

        for part in slices(batches, "text", size=SLICE):
            runs, _, _ = _runs(part.column("text"))
            held.append(runs)
            n, size = n + part.num_rows, size + len(runs)
            if n >= least_docs and size >= 1_000_000:
                yield flush()
                held.clear()
                n = size = 0
        yield flush()

    texts = docs.select(F.col("text").cast("string").alias("text"))
    parts = texts.coalesce(max(1, total // (4 * least_docs)))  # lossy counting needs enough documents in a task
    likely = map_arrow(parts, may_be_common, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= (COMMON - COUNT_ERROR) * total).select("run")
    with short_batches(docs.sparkSession):
        found = likely.collect()
    names = np.sort(np.array([r.run for r in found], np.int64).view(np.uint64))  # bounded by runs of a mean document / (COMMON - COUNT_ERROR)
    if not len(names):
        return names, np.empty(0)
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        counts = np.zeros(len(known), np.int64)
        for part in slices(batches, "text", size=SLICE):
            runs, _, _ = _runs(part.column("text"))
            k = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            counts += np.bincount(k[known[k] == runs], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["k", "n"])

    df = np.zeros(len(names))
    with short_batches(docs.sparkSession):
        for r in map_arrow(texts, count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            df[r.k] = r.n
    often = df >= COMMON * total
    return names[often], 1.0 + np.log(total / df[often]) / np.log(1 / COMMON)


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


_tables: list[np.ndarray] = []


def samples(runs: np.ndarray, log_weights: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each text that has runs, as the bits of the least ln a: (n, texts) of int32.

    ln a depends on the run, the sample's number and the weight's step t alone, so equal bits are an equal (run, t).
    """
    if not _tables:
        q = _gamma_quantiles()
        _tables[:] = [q.astype(np.float32), np.log(q).astype(np.float32)]
    r_table, c_table = _tables
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((n, len(starts)), np.float32)
    if not len(starts):
        return out.view(np.int32)
    low = np.uint64(0xFFFF)
    for k in range(n):
        z = mix64(runs ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = r_table[(z & low).astype(np.int32)]
        c = c_table[((z >> np.uint64(16)) & low).astype(np.int32)]
        b = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weights / r + b)
        out[k] = np.minimum.reduceat(c - r * (t - b + np.float32(1)), starts)
    return out.view(np.int32)


def _signer(common, n: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", size=SLICE):
            runs, counts, first = _runs(part.column("text"))
            s = samples(runs, _log_weights(runs, counts, common.value), first, n)
            sizes = np.where(np.diff(first) > 0, n, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(s.T.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2")), lists], ["doc_id", "k1", "k2", "samples"])

    return kernel


def _with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): 128 bits that name a text. Null texts are named as empty ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(20240229), text).alias("k2"), text.alias("text"))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted runs, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    k = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][k] == a[0]
    both = float(np.minimum(a[1][hit], b[1][k[hit]]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def _comparer(common):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by centre and part, the centre's own text first."""
        held = own = None
        for part in slices(batches, "text", size=SLICE):
            runs, counts, first = _runs(part.column("text"))
            weights = np.exp(_log_weights(runs, counts, common.value).astype(np.float64))
            out: list[tuple[int, int, float]] = []
            for k, (center, salt, role, node) in enumerate(zip(*(part.column(c).to_pylist() for c in ("center", "salt", "role", "node")))):
                vector = runs[first[k] : first[k + 1]], weights[first[k] : first[k + 1]]
                if role == 0:
                    held, own = (center, salt), vector
                elif held == (center, salt):
                    out.append((node, center, weighted_jaccard(vector, own)))
                else:
                    raise RuntimeError("a centre's text is missing")
            if own is not None:
                own = own[0].copy(), own[1].copy()
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["node", "center", "sim"])

    return kernel


def _compare(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, common) -> DataFrame:
    """(node, center, sim) of pairs (node, center). A centre's members are dealt into parts, each with a copy of its text.

    A text crosses the network once to find its pairs and once for each of its centres; texts without pairs stay where they are.
    """
    salted = pairs.select("center", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"), "node")
    roles = salted.withColumn("role", F.lit(1)).unionByName(salted.select("center", "salt", F.col("center").alias("node"), F.lit(0).alias("role")).distinct())
    texts, done = _with_texts(roles, nodes, keyed)
    dealt = texts.select("center", "salt", "role", "node", "text").repartition("center", "salt").sortWithinPartitions("center", "salt", "role")
    found = materialize(map_arrow(dealt, _comparer(common), "node long, center long, sim double").distinct(), "similarities", narrow=True)
    done()
    return found


def _with_texts(rows: DataFrame, nodes: DataFrame, keyed: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Rows with a node and their node's text, and what gives back the storage once they are read."""
    wanted = materialize(rows.join(nodes.select("node", "k1", "k2", F.coalesce("first_doc", F.lit(_NULL_ID)).alias("id")), "node"), "wanted", narrow=True)
    bloom = keyed.sparkSession.sparkContext.broadcast(Bloom(wanted, "k1", "id", wanted._rows))
    texts = split_by_bloom(keyed.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), "k1", "k2", "text"), bloom, "k1", "id", True)

    def done() -> None:
        bloom.unpersist()
        release(wanted)

    return texts.join(wanted, ["k1", "k2", "id"]), done


def _rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n): how many of the texts' runs fall into each of RARITY places."""
    counts = np.zeros(RARITY, np.int64)
    for part in slices(batches, "text", size=SLICE):
        runs, _, _ = _runs(part.column("text"))
        counts += np.bincount((runs & np.uint64(RARITY - 1)).astype(np.int64), minlength=RARITY)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["place", "n"])


def prefixes(runs: np.ndarray, weights: np.ndarray, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, int, float]:
    """(runs, n, total): a text's rarest runs, of which one is shared with any text as heavy or lighter that is similar by the threshold; the first n suffice where the other is as heavy or heavier.

    Two such texts of weights a <= b share at least threshold * b and 2 * threshold / (1 + threshold) * a; what comes after the runs given weighs less.
    """
    order, left = _by_rarity(runs, weights, rarity)
    total = float(weights.sum())
    rest = np.append(left[1:], 0.0)
    long, short = (min(len(runs), int(np.argmax(rest < share * total * (1 - 1e-9))) + 1) for share in (threshold, 2 * threshold / (1 + threshold)))
    return runs[order[:long]], short, total


def _by_rarity(runs: np.ndarray, weights: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, left): the order of a text's runs from rare to frequent, and for each the weight of it and all after it."""
    order = np.lexsort((runs, rarity[(runs & np.uint64(RARITY - 1)).astype(np.int64)]))
    return order, np.cumsum(weights[order][::-1])[::-1]


def masks(runs: np.ndarray, first: np.ndarray, common: Frequencies) -> np.ndarray:
    """(texts, MASK_WORDS) of int64: bits that a text's runs set, common ones left out. A bit that one of two texts has alone stands for a run of weight 2 or more that the other lacks."""
    out = np.zeros((len(first) - 1, 64 * MASK_WORDS), bool)
    at = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rare = ~np.isin(runs, common[0])
    out[at[rare], (runs[rare] >> np.uint64(40)).astype(np.int64) % out.shape[1]] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


_MASK = [f"m{k}" for k in range(MASK_WORDS)]


def may_be_near(threshold: float) -> Column:
    """For two texts (total, left, m0, ...) and (z_total, z_left, z_m0, ...) whose first shared run is the row's: false only where their similarity is under the threshold.

    By the weights that each has left from that run on, of which they share no more, and by the bits of their masks that differ.
    """
    both = F.col("total") + F.col("z_total")
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"z_{m}"))) for m in _MASK[1:]), F.bit_count(F.col("m0").bitwiseXOR(F.col("z_m0"))))
    return (F.least("left", "z_left") >= both * (threshold / (1 + threshold) * (1 - 1e-9))) & (differ * 2.0 <= both * ((1 - threshold) / (1 + threshold) * (1 + 1e-6)))


def _prefixer(common, rarity, threshold: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", size=SLICE):
            runs, counts, first = _runs(part.column("text"))
            weights = np.exp(_log_weights(runs, counts, common.value).astype(np.float64))
            found = [prefixes(runs[a:b], weights[a:b], rarity.value, threshold) if b > a else (runs[:0], 0, 0.0) for a, b in zip(first[:-1], first[1:])]
            sizes = [len(x) for x, _, _ in found]
            node = np.repeat(np.asarray(part.column("node")), sizes)
            short = np.concatenate([np.arange(len(x)) < n for x, n, _ in found])
            left = np.concatenate([_by_rarity(runs[a:b], weights[a:b], rarity.value)[1][:n] for a, b, n in zip(first[:-1], first[1:], sizes)])
            columns = np.concatenate([x for x, _, _ in found]).view(np.int64), node, np.repeat([t for _, _, t in found], sizes), short, left, *np.repeat(masks(runs, first, common.value), sizes, axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run", "node", "total", "short", "left", *_MASK])

    return kernel


def _rest(live: DataFrame, comp: DataFrame, tried: DataFrame, nodes: DataFrame, keyed: DataFrame, common, threshold: float) -> DataFrame | None:
    """Similarities (node, center, sim), those of `tried` among them, that settle what buckets hold apart; None where they hold nothing apart.

    First the lightest text of each run is compared with the others, so that a large group comes together in one round; then all pairs that are still apart.
    """
    spark = keyed.sparkSession
    rooted = _with_root(live.select("key", "node"), comp, "node", "root")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
    apart = materialize(rooted.join(mixed, "key").select("node").distinct(), "apart", narrow=True)
    if not apart._rows:
        return None
    found, done = _with_texts(apart, nodes, keyed)
    texts = materialize(found.select("node", "text").dropDuplicates(["node"]), "apart-texts")
    done()
    with short_batches(spark):
        counts = map_arrow(texts, _rarity, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(RARITY, np.int64)
    rarity[np.asarray(counts.column("place"), np.int64)] = np.asarray(counts.column("n"), np.int64)
    rows = materialize(map_arrow(texts, _prefixer(common, spark.sparkContext.broadcast(rarity), threshold), "run long, node long, total double, short boolean, left double, " + ", ".join(f"{m} long" for m in _MASK)), "prefixes")
    release(texts)
    facts = ["node", "total", "left", *_MASK]
    for heads in (True, False):
        least = rows.where("short")
        if heads:
            least = least.groupBy("run").agg(F.min(F.struct("total", *(c for c in facts if c != "total"))).alias("h")).select("run", "h.*")
        least = _with_root(least.select("run", *(F.col(c).alias(f"z_{c}") for c in facts)), comp, "z_node", "z_root")
        near = _with_root(rows.select("run", *facts), comp, "node", "root").join(least, "run")
        near = near.where((F.col("root") != F.col("z_root")) & (F.struct("total", "node") > F.struct("z_total", "z_node")) & may_be_near(threshold))
        pairs = near.select("node", F.col("z_node").alias("center")).distinct()
        fresh = materialize(_untried(pairs, tried), "rest-pairs", narrow=True)
        if fresh._rows:
            tried = tried.unionByName(_compare(fresh, nodes, keyed, common))
            comp = components(tried.where(F.col("sim") >= threshold).select(F.col("node").alias("a"), F.col("center").alias("b")))
        release(fresh)
    release(rows, apart)
    return tried


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (node, center) that were compared in neither order."""
    x, y = F.greatest("node", "center").alias("x"), F.least("node", "center").alias("y")
    old = tried.select(x, y)
    return pairs.select("node", "center", x, y).join(old, ["x", "y"], "left_anti").select("node", "center").dropDuplicates()


def _elect(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(center, node) for rows (key, node): in each key the node that shares most rows with others is the centre of the others. Also the rows whose key others have."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2")
    live = materialize(rows.join(counts, "key"), "shared-keys", narrow=True)
    weights = live.groupBy("node").agg(F.sum("n").alias("w"))
    best = live.join(weights, "node").groupBy("key").agg(F.max(F.struct("w", "node")).alias("best")).select("key", F.col("best.node").alias("center"))
    found = materialize(live.join(best, "key").where("node != center").select("center", "node").distinct(), "members", narrow=True)
    return found, live


def _with_root(df: DataFrame, comp: DataFrame, column: str, to: str) -> DataFrame:
    return df.join(comp.select(F.col("node").alias(column), F.col("root").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))


def _next_pairs(members: DataFrame, comp: DataFrame, before: DataFrame | None, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For members (center, node, sim): (center, node, sim) of the most similar one after those of `before`, and pairs (node, center) of it and members in other components."""
    rest = members
    if before is not None:
        last = before.select("center", F.struct("sim", "node").alias("last"))
        rest = members.join(last, "center").where(F.struct("sim", "node") < F.col("last")).drop("last")
    top = materialize(rest.groupBy("center").agg(F.max(F.struct("sim", "node")).alias("top")).select("center", F.col("top.node").alias("node"), F.col("top.sim").alias("sim")), "nearest", narrow=True)
    named = _with_root(top.select("center", F.col("node").alias("z")), comp, "z", "z_root")
    apart = _with_root(members.select("center", "node"), comp, "node", "root").join(named, "center").where("root != z_root")
    return top, materialize(_untried(apart.select("node", F.col("z").alias("center")).distinct(), tried), "next-pairs", narrow=True)


def groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, class_id, class_size, s1, s2): one row for each row of docs.

    class_id is the least id of the group, (s1, s2) the keys of the text that stands for it.
    """
    spark = docs.sparkSession
    keyed = _with_keys(docs)
    common = spark.sparkContext.broadcast(common_runs(docs))
    signed = materialize(map_arrow(keyed, _signer(common, bands * rows), "doc_id long, k1 long, k2 long, samples array<int>"), "signatures")
    nodes = materialize(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.max("samples").alias("samples")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    band = [F.xxhash64(F.lit(b), *[F.col("samples")[b * rows + r] for r in range(rows)]) for b in range(bands)]
    pairs, live = _elect(nodes.where(F.size("samples") > 0).select("node", F.explode(F.array(*band)).alias("key")))
    members = tried = sims = _compare(pairs, nodes, keyed, common)
    near = F.col("sim") >= threshold
    top = None
    while True:
        comp = components(tried.where(near).select(F.col("node").alias("a"), F.col("center").alias("b")))
        release(pairs)
        top, pairs = _next_pairs(members, comp, top, tried)
        if not pairs._rows:
            break
        sims = _compare(pairs, nodes, keyed, common)
        tried = tried.unionByName(sims)
        if 10 * sims.where(near).count() < pairs._rows:
            break
        release(comp)
    settled = _rest(live, comp, tried, nodes, keyed, common, threshold)
    if settled is not None:
        comp = components(settled.where(near).select(F.col("node").alias("a"), F.col("center").alias("b")))
    release(live)
    rooted = _with_root(nodes, comp, "node", "root")
    least = F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "k1", "k2"))
    named = rooted.groupBy("root").agg(least.alias("least"), F.sum("n").alias("class_size"))
    classes = rooted.select("k1", "k2", "root").join(named, "root").select("k1", "k2", F.col("least.first_doc").alias("class_id"), "class_size", F.col("least.k1").alias("s1"), F.col("least.k2").alias("s2"))
    return signed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"])


_STAYS = "doc_id <=> class_id AND k1 = s1 AND k2 = s2"


def mark(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_size, kept): kept is whether the row is its group's one that stays (repeated rows of it alike)."""
    return groups(docs, **options).select("doc_id", "class_id", "class_size", F.expr(_STAYS).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, one of each group: the one with the least id (of repeated rows, one)."""
    stay = materialize(groups(docs, **options).where(_STAYS).groupBy("k1", "k2").agg(F.min(F.coalesce("doc_id", F.lit(_NULL_ID))).alias("id"), F.count("*").alias("n")), "stay")
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom(stay, "k1", "id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(20240229), text).alias("k2"))
    kept = split_by_bloom(rows, bloom, "k1", "id", True).join(stay, ["k1", "k2", "id"])
    if stay.where("n > 1").head(1):  # rows that repeat id and text
        kept = kept.groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.select("row.*")


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"))
