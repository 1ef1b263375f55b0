"""Phrase collocations: word pairs and triples that stand together more often than their parts suggest, by language.

Texts are lower-cased (A-Z), cut at punctuation and line breaks into pieces, and those at blanks into words. A first reading
counts the words and samples paths; a second one builds tries of depth three, one a language and some megabytes of text: a
path is what stands from a word on, up to two more words of its piece, or the end of the piece. Only leaves are kept, with
their counts; an inner node counts what stands below it.

Tries are serialised sorted, words standing as 64-bit hashes, and cut by ranges of paths, which the sample bounds, so a
frequent word's or pair's subtree is spread over many ranges. Within a range the parts come by their first path, and are
merged k ways: what lies before the next part's first path is complete. A walk over the merged leaves gives the counts of
triples, and of pairs but for the two at a range's ends, which are summed afterwards.

The pruned trie (counts of `least` or more) holds all prefixes and suffixes of its nodes. The left part of a cut is an
ancestor of the node, the right part the node that its suffix link (the path without its first word) names: joins of
the pruned trie with itself, far smaller than the texts.

Counts are exact: the vocabulary is counted by the words themselves, and if two words of a language had one hash, all would
be counted again under another seed. Scores are whole-number arithmetic of 38 digits (counts up to 10**15).

Defined cases: a null text is an empty one; a null language is `und`; a text longer than a window is counted in windows that
overlap by two words; repeated rows count as often as they stand there; an empty table gives no rows; other columns
are left out. A word that has no neighbour in its piece counts in n and in its own frequency.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import materialize, mix64, release, slices, table, utf8

#: Bytes of text of a trie. Paths are numbered in 63 bits, which holds for two million different words: more than stand in these bytes.
WINDOW_BYTES = 3 << 20
#: Leaves of a serialised part (at most 20,000: words of a part are numbered in 16 bits), leaves that a merge sorts at a time, leaves of a range at the mean, and the most ranges.
PART_LEAVES, MERGE_LEAVES, RANGE_LEAVES, MOST_RANGES = 4096, 1 << 18, 1 << 20, 50_000
#: One of so many different paths of a window is sampled, and at most so many for each bound of a range are gathered.
SAMPLED, GATHERED = 1 << 13, 32
#: Different words that a task counts before it gives them away.
WORDS_HELD = 1 << 18

_END = np.int64(-(1 << 63))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_CUT, _TWO_WORDS = re.compile(rb"[ \t.,;:!?\x0a-\x0d]"), re.compile(rb"(?:[ \t]+[^ \t.,;:!?\x0a-\x0d]+){0,2}")

WORDS = "lang string, word string, h1 long, h2 long, h3 long, n long"
_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("n", pa.int64())])
PARTS = "range int, lang string, h1 long, h2 long, h3 long, leaves binary"
_PARTS = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("leaves", pa.binary())])
NODES = "lang string, h1 long, h2 long, h3 long, n long"
_NODES = pa.schema([("lang", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("n", pa.int64())])


def windows(text: bytes, size: int = WINDOW_BYTES) -> Iterator[tuple[bytes, int]]:
    """Parts of a text and how many bytes of each are its own; behind these stand up to two words of context."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        stop = found.start()
        yield text[at : _TWO_WORDS.match(text, stop).end()], stop - at
        at = stop
    yield text[at:], len(text) - at


class Trie:
    """The words of some windows, their counts, and the leaves of their trie."""

    def __init__(self, parts: list[tuple[bytes, int]], seed: int):
        data = _LOWER[np.frombuffer(b"\n" + b"\n".join(p for p, _ in parts) + b"\n", np.uint8)]
        inside = ~_APART[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
        code, self.words = np.asarray(coded.indices), coded.dictionary
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words.cast(pa.binary()).to_pylist()), np.uint64, len(self.words)).view(np.int64)
        self.hashes = np.where(hashes == _END, _END + 1, hashes)
        own = np.ones(len(starts), bool)
        at = 1
        for part, counted in parts:
            if counted < len(part):
                own[np.searchsorted(starts, at + counted) : np.searchsorted(starts, at + len(part))] = False
            at += len(part) + 1
        self.counts = np.bincount(code[own], minlength=len(self.words))
        # words are numbered by their hashes from 1 on; 0 is the end of a piece
        order = np.argsort(self.hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        self.named, self.base = np.concatenate([[_END], self.hashes[order]]), len(order) + 1
        first = rank[code]
        second, third = np.zeros_like(first), np.zeros_like(first)
        same = piece[1:] == piece[:-1]
        second[:-1] = np.where(same, first[1:], 0)
        third[:-2] = np.where(same[1:] & same[:-1], first[2:], 0)
        self.paths = ((first * self.base + second) * self.base + third)[own]

    def numbers(self, paths: np.ndarray) -> list[np.ndarray]:
        return [paths // (self.base * self.base), paths // self.base % self.base, paths % self.base]

    def leaves(self) -> list[np.ndarray]:
        """Sorted leaves: numbers of three words, and counts."""
        paths, counts = np.unique(self.paths, return_counts=True)
        return [*self.numbers(paths), counts.astype(np.int32)]

    def sample(self, sampled: int) -> list[np.ndarray]:
        """Hashes of the words of some of the different paths: those whose own hash is a multiple of `sampled`."""
        h = [self.named[x] for x in self.numbers(self.paths)]
        mixed = mix64(h[0].view(np.uint64) + mix64(h[1].view(np.uint64) + mix64(h[2].view(np.uint64))))
        paths = np.unique(self.paths[mixed % np.uint64(sampled) == 0])
        return [self.named[x] for x in self.numbers(paths)]


def _pack(numbers: list[np.ndarray], counts: np.ndarray, named: np.ndarray) -> bytes:
    """Leaves with the hashes of their words once each."""
    used = np.zeros(len(named), bool)
    for x in numbers:
        used[x] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    hashes = named[used]
    return b"".join([np.array([len(counts), len(hashes)], np.int32).tobytes(), hashes.tobytes(), *(place[x].astype(np.uint16).tobytes() for x in numbers), counts.tobytes()])


def _unpack(part: bytes) -> list[np.ndarray]:
    k, d = np.frombuffer(part, np.int32, 2).tolist()
    hashes = np.frombuffer(part, np.int64, d, 8)
    at = 8 + 8 * d
    return [*(hashes[x] for x in np.frombuffer(part, np.uint16, 3 * k, at).reshape(3, k)), np.frombuffer(part, np.int32, k, at + 6 * k).astype(np.int64)]


def _filled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, list[tuple[bytes, int]]]]:
    """Windows by language, about `size` bytes at a time."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    filled = 0
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text")):
            for part, counted in windows(text, size):
                if filled and filled + len(part) > size:
                    yield held
                    held, filled = {}, 0
                held.setdefault(lang, []).append((part, counted))
                filled += len(part) + 1
    yield held


def _words(seed: int, size: int, sampled: int):
    """Counts of words, and sampled paths (word null)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        names = ["lang", "word", "h1"]

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(names).aggregate([("n", "sum")]).rename_columns([*names, "n"])

        def given(found: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in found.combine_chunks().to_batches(1 << 16):
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), none, none, b.column(3)], schema=_WORDS)

        for group in _filled(batches, size):
            for lang, parts in group.items():
                trie = Trie(parts, seed)
                some = pa.array(np.flatnonzero(trie.counts))
                held.append(pa.table([pa.array([lang] * len(some), pa.string()), trie.words.take(some), pa.array(trie.hashes).take(some), pa.array(trie.counts).take(some)], [*names, "n"]))
                paths = trie.sample(sampled)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(paths[0]), pa.string()), pa.nulls(len(paths[0]), pa.string()), *map(pa.array, paths), pa.nulls(len(paths[0]), pa.int64())], schema=_WORDS)
            if sum(map(len, held)) > WORDS_HELD:
                held = [summed()]
                if len(held[0]) > WORDS_HELD // 2:
                    yield from given(held.pop())
        if held:
            yield from given(summed())

    return kernel


def _places(leaves: list[np.ndarray], named: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """For each bound how many leaves come before it: one binary search for all bounds."""
    low, high = np.zeros(len(bounds[0]), np.int64), np.full(len(bounds[0]), len(leaves[3]))
    while (open_ := low < high).any():
        mid = np.minimum((low + high) >> 1, len(leaves[3]) - 1)
        before, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for x, b in zip(leaves, bounds):
            value = named[x[mid]]
            before |= equal & (value < b)
            equal &= value == b
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low


def _tries(seed: int, size: int, part_leaves: int, bounds: list[tuple]):
    """Serialised tries, cut by the ranges of paths that begin at `bounds`."""
    langs = [b[0] for b in bounds]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _filled(batches, size):
            for lang, parts in group.items():
                trie = Trie(parts, seed)
                leaves = trie.leaves()
                a, b = bisect.bisect_left(langs, lang), bisect.bisect_right(langs, lang)
                cuts = [0, *_places(leaves, trie.named, [np.array([x[i] for x in bounds[a:b]], np.int64) for i in (1, 2, 3)]).tolist(), len(leaves[3])]
                out = [(a + k, at, min(at + part_leaves, stop)) for k, (start, stop) in enumerate(zip(cuts, cuts[1:])) for at in range(start, stop, part_leaves)]
                for at in range(0, len(out), 64):
                    some = out[at : at + 64]
                    firsts = [pa.array(trie.named[x[[r[1] for r in some]]]) for x in leaves[:3]]
                    packed = [_pack([x[i:j] for x in leaves[:3]], leaves[3][i:j], trie.named) for _, i, j in some]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([lang] * len(some)), *firsts, pa.array(packed, pa.binary())], schema=_PARTS)

    return kernel


class _Walk:
    """Counts of the nodes over merged leaves, block by block."""

    def __init__(self, least: int):
        self.least, self.open, self.first = least, None, True

    def over(self, h1, h2, h3, n) -> list[tuple]:
        """Nodes (h1, h2, h3, n) that are complete with these leaves. The first pair of all is given whatever its count."""
        begins = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        sums = np.add.reduceat(n, begins)
        p1, p2 = h1[begins], h2[begins]
        if self.open and self.open[:2] == (p1[0], p2[0]):
            sums[0] += self.open[2]
        elif self.open:
            p1, p2, sums = (np.concatenate([[x], y]) for x, y in zip(self.open, (p1, p2, sums)))
        self.open = (p1[-1], p2[-1], sums[-1])
        p1, p2, sums = p1[:-1], p2[:-1], sums[:-1]
        taken = sums >= self.least
        if self.first and len(taken):
            taken[0], self.first = True, False
        taken &= p2 != _END
        leaf = (n >= self.least) & (h3 != _END)
        return [(h1[leaf], h2[leaf], h3[leaf], n[leaf]), (p1[taken], p2[taken], np.full(int(taken.sum()), _END), sums[taken])]

    def end(self) -> list[tuple]:
        """The last pair, whatever its count."""
        return [tuple(np.array([x]) for x in (*self.open[:2], _END, self.open[2]))] if self.open and self.open[1] != _END else []


def _merged(least: int, merge_leaves: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, filled, full, walk = None, [], 0, merge_leaves, None

        def settle(before) -> list[tuple]:
            """Merges what is held; what is not before the path `before` stays."""
            nonlocal held, filled, full
            leaves = [np.concatenate(x) for x in zip(*held)]
            order = np.lexsort(leaves[2::-1])
            leaves = [x[order] for x in leaves]
            stop = len(order) if before is None else bisect.bisect_left(range(len(order)), before, key=lambda i: (leaves[0][i], leaves[1][i], leaves[2][i]))
            held = [[x[stop:] for x in leaves]] if stop < len(order) else []
            filled = len(order) - stop
            full = max(merge_leaves, 2 * filled)  # parts may overlap for long: what stays is not sorted anew for each of them
            if not stop:
                return []
            h1, h2, h3, n = (x[:stop] for x in leaves)
            begins = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (h3[1:] != h3[:-1])]))
            return walk.over(h1[begins], h2[begins], h3[begins], np.add.reduceat(n, begins))

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*found)] if found else []
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array([now[1]] * len(columns[0])), *(pa.array(x.astype(np.int64)) for x in columns)], schema=_NODES)

        for batch in batches:
            for k, lang, h1, h2, h3, part in zip(*map(batch.column, ("range", "lang", "h1", "h2", "h3", "leaves"))):
                k, lang, h1, h2, h3 = k.as_py(), lang.as_py(), h1.as_py(), h2.as_py(), h3.as_py()
                if (k, lang) != now:
                    if now:
                        yield from rows([*settle(None), *walk.end()])
                    now, held, filled, full, walk = (k, lang), [], 0, merge_leaves, _Walk(least)
                elif filled >= full:
                    yield from rows(settle((h1, h2, h3)))
                held.append(_unpack(part.as_buffer()))
                filled += len(held[-1][0])
        if now:
            yield from rows([*settle(None), *walk.end()])

    return kernel


def _bounds(paths: DataFrame, range_leaves: int, sampled: int) -> list[tuple]:
    """Paths (lang, h1, h2, h3) that cut the leaves of all tries into ranges of about as many; from a bounded part of the sample."""
    n = paths.count()
    ranges = min(MOST_RANGES, -(-n * sampled // range_leaves))
    if ranges < 2:
        return []
    found = sorted(map(tuple, paths.sample(min(1.0, GATHERED * ranges / n), seed=11).collect()))
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def counted(docs: DataFrame, least: int, window_bytes: int = WINDOW_BYTES, range_leaves: int = RANGE_LEAVES, seed: int = 11, part_leaves: int = PART_LEAVES, merge_leaves: int = MERGE_LEAVES, sampled: int = SAMPLED) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (lang, word, h, n), and the trie's nodes (lang, h1, h2, h3, n) of two and three words (h3 null for two) that count `least` or more."""
    wanted = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = materialize(wanted.mapInArrow(_words(seed, window_bytes, sampled), WORDS), "words")
    words = materialize(read.where("word IS NOT NULL").groupBy("lang", "word", F.col("h1").alias("h")).agg(F.sum("n").alias("n")), "vocabulary")
    if not words.groupBy("lang", "h").count().where("count > 1").isEmpty():
        release(read, words)
        return counted(docs, least, window_bytes, range_leaves, seed + 1, part_leaves, merge_leaves, sampled)
    bounds = _bounds(read.where("word IS NULL").select("lang", "h1", "h2", "h3"), range_leaves, sampled)
    release(read)
    parts = wanted.mapInArrow(_tries(seed, window_bytes, part_leaves, bounds), PARTS)
    merged = parts.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "lang", "h1", "h2", "h3").mapInArrow(_merged(least, merge_leaves), NODES)
    end = F.lit(int(_END))
    nodes = merged.groupBy("lang", "h1", "h2", "h3").agg(F.sum("n").alias("n")).where(F.col("n") >= least).withColumn("h3", F.when(F.col("h3") != end, F.col("h3")))
    return words, materialize(nodes, "trie", narrow=True)


def _score(a: str, left: str, right: str) -> str:
    wide = lambda x: f"CAST({x} AS DECIMAL(16, 0))"
    return f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})"


def _first_rows(df: DataFrame, top: int) -> DataFrame:
    """The first rows of each language, with their rank: of many parts of it first, then of a few, then of all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in (256, 8):
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).drop("rank")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, **sizes) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) of all phrases of two or three words that stand `least` times or more.

    Left out is a pair that stands within a triple of at least `inside` hundredths of its own count. The cut with the least score counts, of equals the first.
    """
    words, nodes = counted(docs, least, **sizes)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    known = words.where(F.col("n") >= least).select("lang", "h", "word", F.col("n").alias("f"))
    pairs = nodes.where("h3 IS NULL").select("lang", "h1", "h2", F.col("n").alias("a"))
    for k in "12":
        pairs = pairs.join(known.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}")), ["lang", f"h{k}"])
    pairs = materialize(pairs, "pairs", narrow=True)
    parent = pairs.select("lang", "h1", "h2", F.col("a").alias("f12"), "w1", "f1")
    suffix = pairs.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f2").alias("f3"))
    triples = nodes.where("h3 IS NOT NULL").select("lang", "h1", "h2", "h3", F.col("n").alias("a")).join(parent, ["lang", "h1", "h2"]).join(suffix, ["lang", "h2", "h3"])
    scored = triples.selectExpr("*", f"{_score('a', 'f1', 'f23')} AS s1", f"{_score('a', 'f12', 'f3')} AS s2")
    scored = materialize(scored.selectExpr("lang", "h1", "h2", "h3", "concat_ws(' ', w1, w2, w3) AS phrase", "a", "if(s1 <= s2, f1, f12) AS l", "if(s1 <= s2, f23, f3) AS r", "least(s1, s2) AS score"), "triples", narrow=True)
    longest = scored.select("lang", "h1", "h2", "a").unionByName(scored.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("lang", "h1", "h2").agg(F.max("a").alias("longer"))
    alone = pairs.join(longest, ["lang", "h1", "h2"], "left").where(f"longer IS NULL OR 100 * longer < {inside} * a")
    found = alone.selectExpr("lang", "concat_ws(' ', w1, w2) AS phrase", "a", "f1 AS l", "f2 AS r", f"{_score('a', 'f1', 'f2')} AS score").unionByName(scored.drop("h1", "h2", "h3"))
    return found.join(totals, "lang").select("lang", "phrase", "a", "l", "r", F.col("n_lang").alias("n"), "score")


def mine(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000, **sizes) -> DataFrame:
    """The `top` collocations of each language: by score, then by count, then by the phrase's bytes."""
    return _first_rows(collocations(docs, least, inside, **sizes), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), longer_than_one AS (
  SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
), cuts AS (
  SELECT lang, phrase, k, a, w, c, array_to_string(w[1 : c], ' ') AS lp, array_to_string(w[c + 1 : k], ' ') AS rp
  FROM longer_than_one, (VALUES (1), (2)) AS places(c) WHERE c < k
), scored AS (
  SELECT cuts.*, p.n AS l, q.n AS r, ((1000000::HUGEINT * a * a) // (p.n::HUGEINT * q.n))::BIGINT AS score
  FROM cuts JOIN f AS p ON p.lang = cuts.lang AND p.phrase = lp AND p.k = c JOIN f AS q ON q.lang = cuts.lang AND q.phrase = rp AND q.k = cuts.k - c
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, c) = 1
), inner_pairs AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM longer_than_one WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inner_pairs AS i ON i.lang = best.lang AND i.phrase = best.phrase AND best.k = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
