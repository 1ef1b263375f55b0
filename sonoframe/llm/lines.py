"""Line deduplication by a segment-partition edit join.

A line is what stands between line feeds, white space at its ends and runs of it inside left out. Lines equal or within
`max_edits` edits (insertions, deletions, substitutions of code points) are linked, and linked lines are one class. Unless
a number is given, the edits follow the shorter line's length: one under 32 code points, and one more at each doubling.

The join takes edits + 1 segments of a line: two lines that near share one of them unchanged. Lengths fall into ranges of
an eighth of their size, and segments are as long in all lines of a range; the first ones lie at fixed places from the line's
start, the last ones from its end, so that few shifts are left: i edits at most stand before segment i, and the others
behind it (the multi-match-aware bounds of Li et al., PASS-JOIN, 2011, from each side). Segments are indexed by (range,
number, content); a line probes its own range and those that a line shorter by its edits may have. Only hashes of segments
and lines travel, packed by partition; keys that unlike lines share name groups of candidates, one for each least line.

A group of at most `LOCAL_LINES` lines is settled in one task: what all its lines begin and end with is left out, lines are
compared with the least one, and while several components and over `FEW` lines remain, the group is split anew by segments of what
is left, a shared segment being left out in turn. Each split is exact for the same reason as the first: of edits + 1 pieces
of the rest one stands unchanged. Larger groups are split in the same way by a shuffle, as often as it takes. So lines that
share a template are never compared in all pairs. A bit-parallel edit distance, held to the band that the threshold allows,
verifies a pair. Each removed segment leaves a mark, so what is left shrinks with every split and the mark stays aligned. Where
no more is left of a line than the edits, segments end: such lines and those up to as much longer are linked by what they keep when some of their
characters are left out (deletion neighbourhoods): two that are near keep an equal string, and the places of what they leave
out, at most the edits of them together, prove it without a comparison.

A line goes if its class has an earlier line in the same document, or if its class stands in `least_docs` or more documents
and this isn't the first of them (by id); a line of `long_words` or more words goes from the second document on. A document keeps its first lines of each class
if near-duplicate detection is certain to take it whole: if its text stands under a lesser id too, or if one earlier document has so many of its lines that the
runs of five words inside these lines alone make the two similar by `COPY` or more.

Defined cases: a null text stays null and has no lines; lines without a word stay; lines shorter than `least_chars` code
points are linked when equal only; repeated rows (equal id and text) are one document; a null id comes first; an empty
table gives no rows; texts and lines of any length are taken whole.
"""

from __future__ import annotations

import os.path
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import Bloom, components, map_arrow, materialize, mix64, partitions, power_table, release, slices, split_by_bloom, table

LEAST_CHARS, LEAST_DOCS, LONG_WORDS = 16, 3, 20
#: Similarity that shared lines alone must reach for a document to be left to near-duplicate detection, and the run length there.
COPY, RUN = 0.8, 5
#: Lines, and code points, of a group that one task settles; lines that are compared pair by pair, always and where segments part them too little.
LOCAL_LINES, LOCAL_CHARS, FEW, SOME = 20_000, 32 << 20, 32, 2000
#: Bins of the counts that rule out pairs before their edit distance is worked out.
BINS = 128
#: Pairs whose edit distances are worked out together, and places of their lines at most; longer lines are compared one by one.
BATCH, BATCH_CHARS = 2000, 2 << 20
#: Lines that a task remembers to have seen.
SEEN_LINES = 200_000
#: Code points of lines whose keys a task works out at a time, and those whose keys make a partition.
SLICE_CHARS, PART_CHARS = 1 << 20, 10 << 20
_NULL_ID = -(1 << 63)
#: Stands where a segment was removed; no line has it.
MARK = "\n"


def normalized(line: str) -> str:
    return " ".join(line.split())


def line_hash(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode())
    return (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def edits_of(length: int, max_edits: int | None) -> int:
    """Edits up to which a line is near to one of at least this length."""
    return max(1, length.bit_length() - 4) if max_edits is None else max_edits


def range_of(length: int) -> int:
    """The least length of the range that a length falls into; edits_of() is the same in all of it."""
    return length - length % max(1, 1 << length.bit_length() >> 4)


_places: dict[tuple[int, int | None], np.ndarray] = {}


def places_of(length: int, max_edits: int | None) -> np.ndarray:
    """(from, to, indexed, seed) of the segments that a line of this length is indexed under or probes with; the seed tells ranges and numbers apart."""
    found = _places.get((length, max_edits))
    if found is None:
        rows, seeds = [], []
        own = range_of(length)
        for low in sorted({range_of(n) for n in range(max(1, length - edits_of(length, max_edits)), length + 1)}):
            k = edits_of(low, max_edits)
            size = low // (k + 1)
            if not size:
                continue
            for i in range(k + 1):
                at, shift = (i * size, i) if 2 * i <= k else (length - (k + 1 - i) * size, k - i)
                for p in range(max(0, at - shift), min(length - size, at + shift) + 1):
                    rows.append((p, p + size, low == own and p == at))
                    seeds.append(low << 16 | i)
        found = np.empty((len(rows), 4), np.int64)
        found[:, :3] = np.array(rows, np.int64).reshape(-1, 3)
        found[:, 3] = mix64(np.array(seeds, np.uint64)).view(np.int64)
        if len(_places) > 20_000:
            _places.clear()
        _places[length, max_edits] = found
    return found


def segment_keys(lines: list[str], max_edits: int | None) -> tuple[np.ndarray, ...]:
    """(key, line, indexed, from, to) for all segments of lines laid end to end: polynomial hashes from prefix sums, all in numpy."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = power_table(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    each = [places_of(len(x), max_edits) for x in lines]
    start, stop, indexed, seed = np.concatenate([np.empty((0, 4), np.int64), *each]).T
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in each])
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)[owner]
    keys = mix64((sums[first + stop] - sums[first + start]) * down[first + start] + np.ascontiguousarray(seed).view(np.uint64))
    return keys, owner, indexed.astype(bool), start, stop


def keys_of(line: str, max_edits: int | None) -> tuple[set[int], set[int]]:
    """Keys under which a line is indexed, and further keys with which it probes indexes of its range and shorter ones."""
    keys, _, indexed, _, _ = segment_keys([line], max_edits)
    index = set(keys[indexed].tolist())
    return index, set(keys.tolist()) - index


def _common(most: int, equal: Callable[[int], bool]) -> int:
    """The greatest n up to `most` for which `equal` holds; it holds for all lesser ones."""
    low, high = 0, most
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if equal(n) else (low, n - 1)
    return low


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most `limit`: bit-parallel levels (Wu and Manber, 1992) over a band.

    The band is 2 * limit + 1 diagonals, a bit each, that moves down a row with each column; one word for each number of
    edits. A common prefix and a common suffix are taken off first.
    """
    if abs(len(a) - len(b)) > limit:
        return False
    if len(a) > len(b):
        a, b = b, a
    start = _common(len(a), lambda n: a[:n] == b[:n])
    a, b = a[start:], b[start:]
    end = _common(len(a), lambda n: a[len(a) - n :] == b[len(b) - n :])
    a, b = a[: len(a) - end], b[: len(b) - end]
    m, n = len(a), len(b)
    if not m:
        return n <= limit
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << (2 * limit + 1)) - 1
    # Bit d of level[e]: the cell d - limit rows below the column's diagonal is at most e.
    level = [((1 << (e + 1)) - 1) << limit & full for e in range(limit + 1)]
    for j in range(n):
        eq = places.get(b[j], 0)
        same = (eq >> (j - limit) if j >= limit else eq << (limit - j)) & full
        before, level[0] = level[0], level[0] & same
        for e in range(1, limit + 1):
            here = level[e] & same | before | before >> 1 | level[e - 1] << 1 & full
            before, level[e] = level[e], here
        if not level[limit]:
            return False
    return bool(level[limit] >> (m - n + limit) & 1)


def within_many(lines: list[str], pairs: list[tuple[int, int]], limit: int) -> np.ndarray:
    """`within` for many pairs of lines at once: the same levels, a word of each pair in one array; pairs drop out as they fail or end."""
    good = np.zeros(len(pairs), bool)
    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
    size = np.array([len(x) for x in lines], np.int64)
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    who = np.flatnonzero(size[j] - size[i] <= limit)
    if not len(who):
        return good
    used = np.unique(np.concatenate([i[who], j[who]]))
    codes = np.full((len(used), int(size[used].max()) + 2 * limit + 1), 0xFFFFFFFF, np.uint32)  # `limit` places before each line stand for nothing
    for row, k in enumerate(used.tolist()):
        codes[row, limit : limit + size[k]] = np.frombuffer(lines[k].encode("utf-32-le", "surrogatepass"), np.uint32)
    word, band = np.uint64, 2 * limit + 1
    full, one, weights = word((1 << band) - 1), word(1), word(1) << np.arange(band, dtype=word)
    a, b, m, n = codes[np.searchsorted(used, i[who])], codes[np.searchsorted(used, j[who])], size[i[who]], size[j[who]]
    level = [np.full(len(who), ((1 << (e + 1)) - 1) << limit & int(full), word) for e in range(limit + 1)]
    for column in range(int(n.max())):
        same = (a[:, column : column + band] == b[:, column + limit, None]).dot(weights)
        before, level[0] = level[0], level[0] & same
        for e in range(1, limit + 1):
            here = level[e] & same | before | before >> one | level[e - 1] << one & full
            before, level[e] = level[e], here
        ended = n == column + 1
        if ended.any():
            good[who[ended]] = (level[limit][ended] >> (m - n + limit)[ended].astype(word) & one).astype(bool)
        if column % 16 == 15 or ended.any():
            stay = ~ended & (level[limit] != 0) & (n > column + 1)
            if not stay.any():
                break
            if stay.mean() < 0.8:
                who, a, b, m, n = who[stay], a[stay], b[stay], m[stay], n[stay]
                level = [x[stay] for x in level]
    return good


class Group:
    """Lines that one task settles. Links are those that all pairs would give, as far as components go."""

    def __init__(self, lines: list[str], max_edits: int | None):
        self.lines, self.max_edits = lines, max_edits
        self.edits = edits_of(max(map(len, lines), default=1), max_edits)
        self.parent = list(range(len(lines)))
        self.links: list[tuple[int, int]] = []
        self.failed: set[tuple[int, int]] = set()
        self.pairs = self._pair_counts(lines)

    @staticmethod
    def _pair_counts(lines: list[str]) -> np.ndarray:
        """For each line how often its pairs of neighbouring characters fall into each of BINS bins. An edit changes four counts at most."""
        out = np.zeros((len(lines), BINS), np.int32)
        at = 0
        while at < len(lines):  # some lines at a time; a long one stands alone
            stop, chars = at, 0
            while stop < len(lines) and (stop == at or chars + len(lines[stop]) <= 1 << 18):
                chars += len(lines[stop])
                stop += 1
            codes = np.frombuffer("".join(lines[at:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
            owner = np.repeat(np.arange(stop - at), [len(x) for x in lines[at:stop]])
            inside = owner[1:] == owner[:-1]
            bins = ((codes[:-1] * np.uint32(31) + codes[1:] * np.uint32(7)) % np.uint32(BINS)).astype(np.int64)
            out[at:stop] = np.bincount((owner[1:] * BINS + bins)[inside], minlength=BINS * (stop - at)).reshape(-1, BINS)
            at = stop
        return out

    def likely(self, i: int, others: list[int]) -> list[int]:
        """Those whose counts do not rule out a link with i."""
        apart = np.abs(self.pairs[others] - self.pairs[i]).sum(axis=1)
        return [j for j, d in zip(others, apart.tolist()) if d <= 4 * self.edits]

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def compare(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        pair = (i, j) if i < j else (j, i)
        if x == y or pair in self.failed:
            return
        a, b = self.lines[i], self.lines[j]
        if within(a, b, edits_of(min(len(a), len(b)), self.max_edits)):
            self.parent[x] = y
            self.links.append(pair)
        else:
            self.failed.add(pair)

    def apart(self, own: list[int]) -> bool:
        return len({self.root(i) for i in own}) > 1

    def settle(self, own: list[int], rest: list[str]) -> None:
        """own: numbers of lines (a number may stand twice); rest: what is left of each."""
        for j in self.likely(own[0], own[1:]):
            self.compare(own[0], j)
        if not self.apart(own):
            return
        n = len(own)
        if n <= FEW:
            return self.all_pairs(own)
        rest = stripped(rest)
        keys, owners, _, start, stop = segment_keys(rest, self.edits)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.append(begins, len(keys)))
        if n <= SOME and 2 * int((sizes * sizes).sum()) >= n * n:  # segments part them too little
            return self.all_pairs(own)
        short = [i for i, r in zip(own, rest) if len(r) <= self.edits]  # no segments, and all near each other by what is left
        for i in short:
            self.compare(short[0], i)
            for j, r in zip(own, rest):
                if self.edits < len(r) <= 2 * self.edits:
                    self.compare(i, j)
        for a, m in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            some = order[a : a + m]
            who = owners[some].tolist()
            if self.apart([own[k] for k in who]):
                self.settle([own[k] for k in who], [rest[k][:s] + rest[k][e:] for k, s, e in zip(who, start[some].tolist(), stop[some].tolist())])

    def all_pairs(self, own: list[int]) -> None:
        if len(own) <= FEW:
            for x in range(1, len(own)):
                for j in self.likely(own[x], own[:x]):
                    self.compare(own[x], j)
            return
        waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        size = [len(x) for x in self.lines]
        for x in range(1, len(own)):
            for j in self.likely(own[x], own[:x]):
                pair = (own[x], j) if own[x] < j else (j, own[x])
                if self.root(own[x]) != self.root(j) and pair not in self.failed:
                    waiting[edits_of(min(size[own[x]], size[j]), self.max_edits)].append(pair)
            for limit, pairs in waiting.items():
                if len(pairs) >= BATCH or x == len(own) - 1 and pairs:
                    self.compare_many(pairs, limit)
                    pairs.clear()

    def compare_many(self, pairs: list[tuple[int, int]], limit: int) -> None:
        longest = max(len(self.lines[k]) for pair in pairs for k in pair)
        if limit > 31 or longest * len(pairs) > BATCH_CHARS:  # wider than a word, or too much to hold
            for i, j in pairs:
                self.compare(i, j)
            return
        for (i, j), near in zip(pairs, within_many(self.lines, pairs, limit).tolist()):
            if not near:
                self.failed.add((i, j))
            elif (x := self.root(i)) != (y := self.root(j)):
                self.parent[x] = y
                self.links.append((i, j))


def stripped(rest: list[str]) -> list[str]:
    """Without what all begin with, and then without what all end with: edit distances stay."""
    start = len(os.path.commonprefix([min(rest), max(rest)]))
    back = [r[start:][::-1] for r in rest]
    end = len(os.path.commonprefix([min(back), max(back)]))
    return [r[end:][::-1] for r in back]


def _lines_of(part: pa.RecordBatch, least_chars: int) -> Iterator[str]:
    for text in part.column("text").to_pylist():
        for line in text.split("\n"):
            line = normalized(line)
            if len(line) >= least_chars:
                yield line


OCCURRENCES = "id long, t long, all_words int, line int, words int, l1 long, l2 long"
FACTS = f"part int, entries binary, {OCCURRENCES}"


def _facts(max_edits: int | None, least_chars: int, parts: int):
    """Rows of two kinds from one reading of the texts: the lines of each document, and packed keys (part, entries).

    Entries are keys, their first bit telling whether the line is indexed, and first halves of line hashes, 14 bytes each.
    """
    schema = pa.schema([("part", pa.int32()), ("entries", pa.binary()), *[(x.split()[0], pa.int64() if x.endswith("long") else pa.int32()) for x in OCCURRENCES.split(", ")]])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def pack(lines: dict[int, str]) -> pa.RecordBatch:
        names = np.fromiter(lines, np.int64, len(lines))
        keys, owners, indexed, _, _ = segment_keys(list(lines.values()), max_edits)
        to = ((keys >> np.uint64(32)).astype(np.int64) * parts) >> 32
        entries = np.empty((len(keys), 14), np.uint8)
        entries[:, :6] = (keys & np.uint64(0xFFFFFFFFFFFE) | indexed.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :6]
        entries[:, 6:] = names[owners].view(np.uint8).reshape(-1, 8)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(parts + 1))
        packed = memoryview(entries.view("V14").reshape(-1)[order]).cast("B")
        some = np.flatnonzero(np.diff(bounds))
        return rows(part=some, entries=[bytes(packed[14 * bounds[p] : 14 * bounds[p + 1]]) for p in some.tolist()])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # spares most repeats their way through the shuffle
        lines: dict[int, str] = {}
        chars, least = 0, max(least_chars, (max_edits or 1) + 1)
        for part in slices(batches, "text"):
            out: list[tuple[int, ...]] = []
            for doc_id, t, text in zip(part.column("id").to_pylist(), part.column("t").to_pylist(), part.column("text").to_pylist()):
                split = [(k, line.split()) for k, line in enumerate(text.split("\n"))]
                all_words = sum(len(words) for _, words in split)
                for k, words in split:
                    if not words:
                        continue
                    line = " ".join(words)
                    l1, l2 = line_hash(line)
                    out.append((doc_id, t, all_words, k, len(words), l1, l2))
                    if len(line) >= least and l1 not in seen:
                        if len(seen) < SEEN_LINES:
                            seen.add(l1)
                        lines[l1] = line
                        chars += len(line)
                if chars >= SLICE_CHARS:
                    yield pack(lines)
                    lines, chars = {}, 0
            columns = list(zip(*out)) or [()] * 7
            yield rows(**{x.split()[0]: c for x, c in zip(OCCURRENCES.split(", "), columns)})
        if lines:
            yield pack(lines)

    return kernel


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, l1): lines of each key that unlike lines share and one is indexed under; g is the least of them."""
    found = [np.frombuffer(x, np.uint8).reshape(-1, 14) for batch in batches for x in batch.column("entries").to_pylist()]
    entries = np.concatenate(found) if found else np.empty((0, 14), np.uint8)
    found.clear()
    keys = np.zeros((len(entries), 8), np.uint8)
    keys[:, :6] = entries[:, :6]
    keys = keys.view(np.uint64).reshape(-1)
    names = entries[:, 6:].copy().view(np.int64).reshape(-1)
    indexed, keys = (keys & np.uint64(1)).astype(bool), keys >> np.uint64(1)
    order = np.lexsort((names, keys))
    keys, names, indexed = keys[order], names[order], indexed[order]
    if len(keys):
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begins, len(keys)))
        least, most = names[begins], np.maximum.reduceat(names, begins)
        good = (least != most) & np.logical_or.reduceat(indexed, begins)
        pairs = np.stack([np.repeat(least, sizes), names], axis=1)[np.repeat(good, sizes)]
        pairs = np.unique(pairs, axis=0)
    else:
        pairs = np.empty((0, 2), np.int64)
    for at in range(0, max(1, len(pairs)), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16), 0]), pa.array(pairs[at : at + (1 << 16), 1])], ["g", "l1"])


def _texts_of(bloom, least_chars: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = {line: line_hash(line) for line in _lines_of(part, least_chars)}
            lines = list(found)
            hashes = np.array(list(found.values()), np.int64).reshape(-1, 2)
            some = np.flatnonzero(bloom.value.hits(hashes[:, 0].copy(), hashes[:, 0].copy()))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[some, 0]), pa.array(hashes[some, 1]), pa.array([lines[k] for k in some], pa.string())], ["l1", "l2", "content"])

    return kernel


def _settle(max_edits: int | None):
    """Links (a, b) of rows (g, node, content, rest), which come sorted by g."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in slices(batches, "content"):
                yield from zip(*(part.column(c).to_pylist() for c in ("g", "node", "content", "rest")))

        out: list[tuple[int, int]] = []
        for _, members in groupby(rows(), key=lambda r: r[0]):
            numbers: dict[int, int] = {}
            own, lines, rest = [], [], []
            for _, node, content, left in members:
                if node not in numbers:
                    numbers[node] = len(lines)
                    lines.append(content)
                own.append(numbers[node])
                rest.append(content if left is None else left)
            group, nodes = Group(lines, max_edits), list(numbers)
            group.settle(own, rest)
            out += [(nodes[i], nodes[j]) for i, j in group.links]
            if len(out) >= 10_000:
                yield _pairs(out)
                out.clear()
        yield _pairs(out)

    return kernel


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def kept_strings(rest: str, edits: int, shorter: bool) -> Iterator[tuple[str, str]]:
    """(what is kept, how many characters are left out before, between and after the kept ones) for a rest of at most 2 * edits characters.

    Marks are always kept. Two rests within `edits` of each other, one of which has no more characters than that, keep an
    equal string somewhere, the greater of the two counts at each place adding up to `edits` at most. shorter: whether this
    may be the one; else no more than `edits` characters are kept, since the other has no more.
    """
    chars = [k for k, c in enumerate(rest) if c != MARK]
    for out in range(max(0, len(chars) - edits), min(edits, len(chars)) + 1):
        if not shorter and len(chars) - out > edits:
            continue
        for gone in combinations(chars, out):
            left, kept, gaps = set(gone), [], [0]
            for k, c in enumerate(rest):
                if k in left:
                    gaps[-1] += 1
                else:
                    kept.append(c)
                    gaps.append(0)
            yield "".join(kept), ",".join(map(str, gaps))


def _split(max_edits: int | None):
    """From rows of large groups with what all their lines begin and end with: links (node, least) to the least line, rows (g, node, content, rest)
    of smaller groups, and strings that short rests keep (keep, gaps, node)."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["g", "node", "content", "rest", "least", "keep", "gaps"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def given() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

        for part in slices(batches, "content"):
            for g, node, content, rest, least, least_content, low, high, rlow, rhigh, longest, shortest, least_left in zip(*(c.to_pylist() for c in part.columns)):
                if node != least and within(content, least_content, edits_of(min(len(content), len(least_content)), max_edits)):
                    out.append((None, node, None, None, least, None, None))
                start = len(os.path.commonprefix([low, high]))
                end = min(len(os.path.commonprefix([rlow, rhigh])), min(len(low), len(high), len(rlow), len(rhigh)) - start)
                before = len(rest) - rest.count(MARK)
                rest = rest[start : len(rest) - end]
                edits = edits_of(longest, max_edits)
                places = [k for k, c in enumerate(rest) if c != MARK]
                n = len(places)
                if n > edits:
                    keys, _, _, begin, stop = segment_keys(["".join(rest[k] for k in places)], edits)
                    for key, b, e in zip(keys.tolist(), begin.tolist(), stop.tolist()):
                        b, e = places[b], places[e - 1] + 1
                        out.append((xxhash.xxh3_64_intdigest(f"{g} {key} {rest[b:e]}".encode()) - (1 << 63), node, content, rest[:b] + MARK + rest[e:], None, None, None))
                if least_left - (before - n) <= edits:
                    for own in range(edits_of(shortest, max_edits), edits_of(len(content), max_edits) + 1):
                        if n <= 2 * own:
                            for kept, gaps in kept_strings(rest, own, n <= own):
                                out.append((None, node, None, None, None, xxhash.xxh3_64_intdigest(f"{g} {own} {kept}".encode()) - (1 << 63), f"{own}:{gaps}"))
                if len(out) >= 20_000:
                    yield given()
            yield given()

    return kernel


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (keep, gaps, rep), sorted by keep: those whose greater gaps add up to the edits at most."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("keep", "gaps", "rep"))))
    out: list[tuple[int, int]] = []
    for _, members in groupby(rows, key=lambda r: r[0]):
        members = list(members)  # at most one for each way to place the gaps
        if len(members) > 1:
            edits = int(members[0][1].split(":")[0])
            gaps = np.array([list(map(int, m[1].split(":")[1].split(","))) for m in members])
            for k in range(1, len(members)):
                near = np.maximum(gaps[:k], gaps[k]).sum(axis=1) <= edits
                out += [(members[k][2], members[j][2]) for j in np.flatnonzero(near).tolist() if members[j][2] != members[k][2]]
            if len(out) >= 10_000:
                yield _pairs(out)
                out.clear()
    yield _pairs(out)


def _group_links(rows: DataFrame, max_edits: int | None, local_lines: int) -> DataFrame:
    """Links (a, b) among the lines of each group of rows (g, node, content, rest). With every level less is left of the lines of a large group."""
    links, level = None, rows
    left = F.length(F.replace("rest", F.lit(MARK), F.lit("")))
    while True:
        sizes = level.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
        sizes = materialize(sizes.where("n >= 2").withColumn("large", ((F.col("n") > local_lines) | (F.col("chars") > LOCAL_CHARS)) & (F.col("n") > FEW)), "line-group-sizes", narrow=True)
        small = level.join(sizes.where("NOT large").select("g"), "g").select("g", "node", "content", "rest")
        found = materialize(map_arrow(small.repartition("g").sortWithinPartitions("g", "node"), _settle(max_edits), "a long, b long"), "line-links", narrow=True)
        links = found if links is None else links.unionByName(found)
        if not sizes.where("large").head(1):
            return links
        large = level.join(sizes.where("large").select("g"), "g").withColumn("rest", F.coalesce("rest", "content"))
        common = large.groupBy("g").agg(
            F.min(F.struct("node", "content")).alias("least"), F.min("rest").alias("low"), F.max("rest").alias("high"), F.min(F.reverse("rest")).alias("rlow"), F.max(F.reverse("rest")).alias("rhigh"),
            F.max(F.length("content")).alias("longest"), F.min(F.length("content")).alias("shortest"), F.min(left).alias("least_left"),
        )
        facts = ["low", "high", "rlow", "rhigh", "longest", "shortest", "least_left"]
        common = common.select("g", F.col("least.node").alias("least"), F.col("least.content").alias("least_content"), *facts)
        split = large.join(common, "g").select("g", "node", "content", "rest", "least", "least_content", *facts)
        done = materialize(map_arrow(split, _split(max_edits), "g long, node long, content string, rest string, least long, keep long, gaps string"), "line-splits")
        kept = done.where("keep IS NOT NULL").select("keep", "gaps", "node")
        reps = materialize(kept.groupBy("keep", "gaps").agg(F.min("node").alias("rep")), "line-kept")
        star = kept.join(reps, ["keep", "gaps"]).where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        meet = map_arrow(reps.repartition("keep").sortWithinPartitions("keep"), _meeting, "a long, b long")
        to_least = done.where("least IS NOT NULL").select(F.col("node").alias("a"), F.col("least").alias("b"))
        links = links.unionByName(materialize(to_least.unionByName(star).unionByName(meet).distinct(), "line-links", narrow=True))
        level = done.where("g IS NOT NULL").select("g", "node", "content", "rest")


def near_lines(texts: DataFrame, packed: DataFrame, max_edits: int | None, least_chars: int, local_lines: int = LOCAL_LINES) -> DataFrame:
    """(l1, l2, c1, c2, near): lines that are linked to another, the line that names their class, and the number of other lines in it."""
    spark = texts.sparkSession
    members = materialize(map_arrow(packed, _shared, "g long, l1 long").distinct(), "line-members", narrow=True)
    wanted = members.select("l1").distinct()
    bloom = spark.sparkContext.broadcast(Bloom(wanted, "l1", "l1"))
    found = map_arrow(texts, _texts_of(bloom, least_chars), "l1 long, l2 long, content string").dropDuplicates(["l1", "l2"])
    nodes = materialize(found.join(wanted, "l1").withColumn("node", F.monotonically_increasing_id()), "line-nodes")
    bloom.unpersist()
    rows = materialize(members.join(nodes, "l1").select("g", "node", "content", F.lit(None).cast("string").alias("rest")), "line-groups")
    comp = components(_group_links(rows, max_edits, local_lines))
    release(members, rows)
    sizes = comp.groupBy("root").agg((F.count("*") - 1).alias("near"))
    names = nodes.select(F.col("node").alias("root"), F.col("l1").alias("c1"), F.col("l2").alias("c2"))
    return comp.join(nodes.select("node", "l1", "l2"), "node").join(names.join(sizes, "root"), "root").select("l1", "l2", "c1", "c2", "near")


def _identified(docs: DataFrame) -> DataFrame:
    """(row, id, t, text): the row as it is, and what names it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.col("text").cast("string").alias("text"))


def _copies(here: DataFrame, totals: DataFrame, copy: float) -> DataFrame:
    """(id, t, copy) of documents that near-duplicate detection will take: by what one shares with the first that has the same line, by the runs inside the lines alone."""
    lesser = totals.groupBy("t").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n >= 2")
    shared = here.where("source != id").groupBy("id", "t", "l1", "l2", "source").agg(F.max("words").alias("words"))
    shared = shared.groupBy("id", "t", "source").agg(F.sum(F.greatest(F.col("words") - (RUN - 1), F.lit(0))).alias("shared"))
    most = F.greatest(F.lit(1), F.col("words") - (RUN - 1))
    own = totals.select("id", "t", most.alias("own"))
    other = totals.groupBy(F.col("id").alias("source")).agg(F.max(most).alias("other"))
    alike = shared.join(own, ["id", "t"]).join(other, "source").where(F.col("shared") >= copy * (F.col("own") + F.col("other") - F.col("shared"))).select("id", "t")
    equals = totals.join(lesser, "t").where("id > least").select("id", "t")
    return alike.unionByName(equals).distinct().withColumn("copy", F.lit(True))


def removals(docs: DataFrame, max_edits: int | None = None, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, long_words: int = LONG_WORDS, copy: float | None = COPY) -> DataFrame:
    """(id, t, gone, links, classes, copy): numbers of the lines that each document loses; links of its lines to unlike lines, and the classes these stand for; whether it is a copy (none is with copy=None)."""
    texts = _identified(docs).where("text IS NOT NULL").select("id", "t", "text")
    spark = docs.sparkSession
    parts = max(partitions(spark), -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS))
    facts = materialize(map_arrow(texts, _facts(max_edits, least_chars, parts), FACTS), "line-facts")
    found = facts.where("l1 IS NOT NULL").select(*[x.split()[0] for x in OCCURRENCES.split(", ")])  # repeated rows give theirs again
    near = near_lines(texts.select("text"), facts.where("part IS NOT NULL").select("part", "entries").repartitionById(parts, F.col("part")), max_edits, least_chars)
    equal = found.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.min("id").alias("source"))
    live = equal.join(near, ["l1", "l2"], "left").where("n >= 2 OR c1 IS NOT NULL").select("l1", "l2", "source", F.coalesce("c1", "l1").alias("c1"), F.coalesce("c2", "l2").alias("c2"), F.coalesce("near", F.lit(0)).alias("near"))
    here = materialize(found.join(live, ["l1", "l2"]), "live-lines")
    totals = materialize(found.groupBy("id", "t").agg(F.max("all_words").alias("words")), "document-words") if copy is not None else None
    release(facts)
    classes = materialize(here.groupBy("c1", "c2", "id", "t").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.max("words").alias("words"), F.max("near").alias("near")), "line-classes")
    spread = classes.groupBy("c1", "c2").agg(F.count("*").alias("docs"), F.min("id").alias("first")).where("docs >= 2")
    judged = classes.join(spread, ["c1", "c2"], "left")
    rule = (F.col("docs") >= F.when(F.col("words") >= long_words, F.lit(2)).otherwise(F.lit(least_docs))) & (F.col("id") != F.col("first"))
    judged = judged.select("id", "t", F.when(F.col("near") > 0, F.col("c1")).alias("class"), "near", F.slice("lines", 2, 1 << 30).alias("again"), F.when(rule, F.slice("lines", 1, 1)).alias("elsewhere"))
    lost = judged.groupBy("id", "t").agg(F.flatten(F.collect_list("again")).alias("again"), F.flatten(F.collect_list("elsewhere")).alias("elsewhere"), F.sum("near").alias("links"), F.array_sort(F.collect_set("class")).alias("classes"))
    if copy is None:
        lost = lost.withColumn("copy", F.lit(False))
    else:
        lost = lost.join(_copies(here, totals, copy), ["id", "t"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    return lost.select("id", "t", F.when(F.col("copy"), F.col("again")).otherwise(F.concat("again", "elsewhere")).alias("gone"), "links", "classes", "copy")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, without the lines that go."""
    return _deduplicate(docs, **options)[0].select("row.*")


def _deduplicate(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(row with its text changed, id, t), and what each document loses (see `removals`)."""
    spark = docs.sparkSession
    lost = materialize(removals(docs, **options), "line-removals")
    gone = lost.where("size(gone) > 0").select("id", "t", "gone")
    rows = _identified(docs).drop("text")
    bloom = spark.sparkContext.broadcast(Bloom(gone, "t", "id"))
    touched = split_by_bloom(rows, bloom, "t", "id", True).join(gone, ["id", "t"], "left")
    text = F.col("row.text").cast("string")
    stay = F.array_join(F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains("gone", k)), "\n")
    kept = F.when(F.size("gone") > 0, stay).otherwise(text).cast(docs.schema["text"].dataType)
    untouched = split_by_bloom(rows, bloom, "t", "id", False)
    return touched.withColumn("row", F.col("row").withField("text", kept)).drop("gone").unionByName(untouched), lost


def op4_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kept_lines and removed_lines, links (of its lines to unlike lines), the classes of linked lines, and size and CRC-32 of the text that stays."""
    rows, lost = _deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), copy=None)
    text = F.coalesce("row.text", F.lit(""))
    digests = rows.select(
        F.col("row.doc_id").alias("doc_id"), "id", "t",
        F.size(F.split(text, "\n")).cast("long").alias("kept_lines"), F.length(text).cast("long").alias("kept_chars"), F.crc32(text).alias("kept_crc32"),
    )
    return digests.join(lost.where("size(gone) > 0 OR links > 0"), ["id", "t"], "left").select(
        "doc_id",
        "kept_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce(F.col("links"), F.lit(0)).cast("long").alias("links"),
        F.coalesce("classes", F.array().cast("array<long>")).alias("line_classes"),
        "kept_chars",
        "kept_crc32",
    )
