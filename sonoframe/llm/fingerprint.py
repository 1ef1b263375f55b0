"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences.

Leaves are sentences (a paragraph's text cut after sentence ends, or every `LEAF_WORDS` words where no end comes); nodes
above hash their children. The root covers every code point, so equal roots are equal texts. The fingerprint string is
the root and then the branches: sections parted by '|', each a short digest and then its paragraphs, parted by '/', each a
short digest, '=' and its leaves, parted by '.', each a short digest and its length. Two fingerprints are compared from the
top: equal roots at once; else equal sections are matched whole, only the paragraphs of the others are looked at, and
of these only the leaves of the ones without a match; unlike branches locate the edits. Likeness is the length of what
is matched (as multisets) over the longer text.

The query pairs each document with the next by id. Ids alone are ranged first, which gives the least id of each range;
then one shuffle brings each text to its range, and the first document of a range also to the range before. No text is
shuffled twice and no window runs over the whole table.

Defined cases: a null text is an empty one, whose tree is a root without branches; likeness of two empty texts is 1, of an
empty and another 0; rows with one id are ordered by text and follow each other; a null id comes before all others; an
empty table gives no rows; very long texts are cut into leaves like others; other columns are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import materialize, partitions, slices, table

LEAF_WORDS = 16
#: Hexadecimal digits of a leaf's digest in the fingerprint; the root keeps all of its digest.
LEAF_DIGITS = 8
_BLANK = re.compile(r"\n{2,}")
_LEAF = re.compile(r"(?:\S+\s+){0,%d}?(?:\S*[.!?…](?=\s)\s+|\S*\Z)|(?:\S+\s+){%d}|\s+" % (LEAF_WORDS - 1, LEAF_WORDS))


def leaves(paragraph: str) -> list[str]:
    """A paragraph cut into sentences of at most LEAF_WORDS words; the pieces joined are the paragraph."""
    out, at = [], 0
    while at < len(paragraph):
        m = _LEAF.match(paragraph, at)
        stop = m.end() if m and m.end() > at else len(paragraph)
        out.append(paragraph[at:stop])
        at = stop
    return out


def tree(text: str) -> list[list[list[str]]]:
    """Sections (parted by blank lines) of paragraphs (lines) of leaves; all pieces joined are the text."""
    out, at = [], 0
    for stop in [*(m.end() for m in _BLANK.finditer(text)), len(text)]:
        if stop > at:
            out.append([leaves(line) for line in text[at:stop].splitlines(keepends=True)])
        at = stop
    return out


def _hash(parts: list[bytes], kind: bytes) -> bytes:
    h = hashlib.sha256(kind)
    for p in parts:
        h.update(p)
    return h.digest()


def fingerprint(text: str | None) -> str:
    sections, tops = [], []
    for section in tree(text or ""):
        paragraphs, nodes = [], []
        for paragraph in section:
            digests = [hashlib.sha256(b"\x00" + leaf.encode()).digest() for leaf in paragraph]
            nodes.append(_hash(digests, b"\x01"))
            paragraphs.append(_short(nodes[-1]) + "=" + ".".join(f"{_short(d)}{len(leaf):x}" for d, leaf in zip(digests, paragraph)))
        tops.append(_hash(nodes, b"\x02"))
        sections.append("/".join([_short(tops[-1]), *paragraphs]))
    return f"{_hash(tops, b'\x03').hex()}:{'|'.join(sections)}"


def _short(digest: bytes) -> str:
    return digest[: LEAF_DIGITS // 2].hex()


def _sections(print_: str) -> list[str]:
    return print_[65:].split("|") if len(print_) > 65 else []


def _paragraphs(sections: list[str]) -> list[str]:
    return [p for s in sections for p in s.split("/")[1:]]


def _leaves(paragraphs: list[str]) -> list[str]:
    return [leaf for p in paragraphs for leaf in p[LEAF_DIGITS + 1 :].split(".")]


def _length(leaves_: list[str]) -> int:
    return sum(int(x[LEAF_DIGITS:], 16) for x in leaves_)


def _unmatched(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    """Nodes of either side beyond those that both have, as multisets of digests."""
    out = []
    for one, other in ((left, right), (right, left)):
        known = Counter(x[:LEAF_DIGITS] for x in other)
        rest = []
        for x in one:
            if known[x[:LEAF_DIGITS]] > 0:
                known[x[:LEAF_DIGITS]] -= 1
            else:
                rest.append(x)
        out.append(rest)
    return out[0], out[1]


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 exactly when the roots are equal."""
    if a[:64] == b[:64]:
        return 1.0
    left, right = _sections(a), _sections(b)
    total = max(_length(_leaves(_paragraphs(left))), _length(_leaves(_paragraphs(right))))
    if not total:
        return 0.0
    left, right = _unmatched(left, right)
    left, right = _unmatched(_paragraphs(left), _paragraphs(right))
    left, right = _leaves(left), _leaves(right)
    apart = max(_length(left), _length(right))
    left, right = Counter(left), Counter(right)
    common = _length(list((left & right).elements()))
    return min((total - apart + common) / total, 1.0 - 1e-9)


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Spans (from, to in a's text; from, to in b's) that differ, found from the top: only unlike sections, and in them unlike paragraphs, are looked into."""
    import difflib

    if a[:64] == b[:64]:
        return []
    found: list[tuple[int, int, int, int]] = []

    def compare(left: list[str], right: list[str], at_left: int, at_right: int, depth: int) -> None:
        down = (lambda x: _leaves(_paragraphs(x)), _leaves, list)[depth]
        opcodes = difflib.SequenceMatcher(None, [x[:LEAF_DIGITS] for x in left], [x[:LEAF_DIGITS] for x in right], autojunk=False).get_opcodes()
        for tag, i, j, k, m in opcodes:
            n_left, n_right = _length(down(left[i:j])), _length(down(right[k:m]))
            if tag == "replace" and depth < 2:
                below = (_paragraphs, _leaves)[depth]
                compare(below(left[i:j]), below(right[k:m]), at_left, at_right, depth + 1)
            elif tag != "equal":
                found.append((at_left, at_left + n_left, at_right, at_right + n_right))
            at_left, at_right = at_left + n_left, at_right + n_right

    compare(_sections(a), _sections(b), 0, 0, 0)
    return found


#: An id below all others stands for null.
_NULL_ID = -(1 << 63)


def _least_ids(ids: DataFrame, ranges: int) -> list[int]:
    """The least id of each of at most `ranges` ranges that hold about as many rows each: the ranges' bounds."""
    found = ids.repartitionByRange(ranges, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low")).select("low").collect()
    return sorted(r.low for r in found)


def _labels(spark: SparkSession, parts: int) -> list[int]:
    """For each of `parts` hash partitions a number that falls into it, so that each range has a partition of its own."""
    rows = spark.range(32 * parts).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(parts)).alias("p")).agg(F.min("label").alias("label")).collect()
    found = {r.p: r.label for r in rows}
    return [found.get(p, p) for p in range(parts)]


def _deal(bounds: list[int], labels: list[int]):
    firsts = set(bounds)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the range of each row; the first id of a range goes to the range before as well, the first of all to the last."""
        for part in slices(batches, "text"):
            at = [bisect.bisect_right(bounds, x) - 1 for x in part.column("id").to_pylist()]
            extra = [k for k, x in enumerate(part.column("id").to_pylist()) if x in firsts]
            yield pa.RecordBatch.from_arrays([pa.array([labels[x] for x in at], pa.int32()), pa.array([0] * len(at), pa.int32()), *part.columns], ["range", "seam", "id", "text"])
            if extra:
                some = part.take(pa.array(extra))
                yield pa.RecordBatch.from_arrays([pa.array([labels[(at[k] - 1) % len(bounds)] for k in extra], pa.int32()), pa.array([1] * len(extra), pa.int32()), *some.columns], ["range", "seam", "id", "text"])

    return kernel


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for part in slices(batches, "text"):
            yield from zip(*(c.to_pylist() for c in part.columns))

    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*out)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PAIRED.split(", ")])

    for _, group in groupby(rows(), key=lambda r: r[0]):
        held = None  # (id, text, fingerprint)
        for _, seam, doc_id, text in group:
            text = text or ""
            mark = fingerprint(text)
            if held:
                n = len(held[1])
                edited = held[1][: n - n // 4] + text[: n // 4]
                print_ = fingerprint(edited)
                out.append((None if held[0] == _NULL_ID else held[0], n, hashlib.sha256(edited.encode()).hexdigest(), held[2], print_, likeness(held[2], print_), likeness(held[2], mark)))
                if len(out) >= 500:
                    yield flush()
                    out.clear()
            held = None if seam else (doc_id, text, mark)
            if seam:
                break
    yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited forms, which end in the beginning of the next document by id."""
    wanted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = 4 * partitions(spark)
    bounds = _least_ids(wanted.select("id"), ranges)
    if not bounds:
        return spark.createDataFrame([], PAIRED)
    dealt = wanted.mapInArrow(_deal(bounds, _labels(spark, ranges)), "range int, seam int, id long, text string")
    return dealt.repartition(ranges, "range").sortWithinPartitions("range", "seam", "id", "text").mapInArrow(_pairs, PAIRED)


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
