"""Bounded-space online packing of token sequences.

Each task keeps `open_windows` windows open. A document's ids (its tokens and a closing id) fill whole windows of their
own as long as they can; the rest goes, uncut, into the open window that it leaves least room in. When none has room,
the fullest window is emitted and a fresh one takes the piece. What stays open at the end of the tasks is merged, whole
windows at a time, best fit by falling size, in groups of bounded size. No token ids leave their task: only places,
lengths and checksums do.

Defined cases: a null or empty text is the closing id alone; a document of any length is tokenised in parts cut at white
space; repeated rows are packed once each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import ChunkCache, kept, map_arrow, materialize, segments, slices, table, utf8

MAX_TOKENS, CLOSING_ID, OPEN_WINDOWS = 4096, 2, 64
#: Windows that one merging task gets at the mean.
MERGE_WINDOWS = 512

_MARK = b"\x01"
#: Chunks of these characters are lower-cased and split alike by every Unicode version; others go to the library itself.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_END = "\0"


def _merge_engine(path: str):
    """A merge engine over the tokenizer file's merges, and the ids of its ranks.

    A word ends in a NUL that joins its last byte first, as the file's end-of-word suffix does. Merging by the rank of
    the joined bytes is merging by the rank of the pair, since every token of the file is reached by one pair alone when
    merged by itself; a file of which that isn't true gives None.
    """
    import tiktoken
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of = {pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of |= {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    suffix = model["end_of_word_suffix"]

    def as_bytes(token: str) -> bytes:
        body, end = (token[: -len(suffix)], b"\0") if token.endswith(suffix) else (token, b"")
        return bytes(byte_of[c] for c in body) + end

    vocab = model["vocab"]
    char_of = {b: c for c, b in byte_of.items()}
    ranks = {bytes([b, 0]): b for b in range(1, 256)}
    ids = {b: vocab[char_of[b] + suffix] for b in range(1, 256)}
    for k, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        token = as_bytes(left) + as_bytes(right)
        if token in ranks:
            return None
        ranks[token] = 1000 + k
        ids[1000 + k] = vocab[left + right]
    top = 1000 + len(model["merges"])
    ranks |= {bytes([b]): top + b for b in range(256)}
    ids |= {top + b: vocab[char_of[b]] for b in range(1, 256)}
    lookup = np.zeros(top + 256, "<u4")
    lookup[list(ids)] = list(ids.values())
    ends = np.zeros(top + 256, bool)
    ends[[r for token, r in ranks.items() if token.endswith(b"\0")]] = True
    return tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={}), lookup, ends


class WordIds:
    """Token ids of white-space-separated chunks, as little-endian unsigned 32-bit integers.

    The pre-tokenizer never joins what white space parts, so a text's ids are those of its chunks, one after the other.
    Chunks not seen yet are worked out together: plain ones by the merge engine, others by the `tokenizers` library, with
    a mark between them that is a word of its own. The results are the library's (tests compare them).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]  # found in texts as tokens of their own
        (self.mark,) = self._ids(_MARK.decode())
        self.engine = _merge_engine(path)
        self.cache = ChunkCache(self.compute)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def compute(self, chunks: list[bytes]) -> list[bytes]:
        if self.engine is None:
            return self._by_library(chunks)
        texts = [c.decode() for c in chunks]
        plain = [k for k, t in enumerate(texts) if _PLAIN.fullmatch(t) and not any(a in t.lower() for a in self.added)]
        words = [_WORDS.findall(texts[k].lower()) for k in plain]
        engine, lookup, ends = self.engine
        out: list[bytes] = [b""] * len(chunks)
        if plain:
            found = np.array(engine.encode_ordinary("".join([w + _END for ws in words for w in ws])), np.int64)
            last = np.flatnonzero(ends[found]) + 1
            stops = last[np.cumsum([len(ws) for ws in words]) - 1] * 4
            joined = lookup[found].tobytes()
            at = 0
            for k, stop in zip(plain, stops.tolist()):
                out[k] = joined[at:stop]
                at = stop
        if len(plain) < len(chunks):
            rest = sorted(set(range(len(chunks))).difference(plain))
            for k, value in zip(rest, self._by_library([chunks[k] for k in rest])):
                out[k] = value
        return out

    def _by_library(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(chunks), 1024):
            part = chunks[at : at + 1024]
            plain = [c for c in part if _MARK not in c]
            found = {}
            if plain:
                ids = np.array(self._ids((b" " + _MARK + b" ").join(plain).decode()), "<u4")
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) == len(plain) - 1:
                    found = {c: ids[a:b].tobytes() for c, a, b in zip(plain, [0, *(cuts + 1)], [*cuts, len(ids)])}
            out += [found[c] if c in found else np.array(self._ids(c.decode()), "<u4").tobytes() for c in part]
        return out

    def of(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        small = [t.split() if t and len(t) <= 1 << 20 else [] for t in texts]
        known = self.cache.of(small)
        for t, chunks in zip(texts, small):
            if t and len(t) > 1 << 20:
                out.append(b"".join(self._long(t)))
            else:
                out.append(b"".join(map(known.__getitem__, chunks)))
        return out

    def _long(self, text: bytes) -> Iterator[bytes]:
        for part in segments(text):
            chunks = part.split()
            known = self.cache.of([chunks])
            yield b"".join(map(known.__getitem__, chunks))


def encoder(path: str) -> WordIds:
    """One for each Python worker; it keeps its cache from task to task of a stage."""
    return kept(("word ids", path), lambda: WordIds(path))


class Windows:
    """The open windows of one task. `place` returns the window and offset of a piece and the windows that it closed."""

    def __init__(self, first_id: int, size: int, most: int):
        self.next_id, self.size, self.most = first_id, size, most
        self.room: list[tuple[int, int]] = []  # (room, window), least room first

    def place(self, length: int) -> tuple[int, int, int | None]:
        closed = None
        k = bisect.bisect_left(self.room, (length, -1))
        if k < len(self.room):
            room, window = self.room.pop(k)
        else:
            if len(self.room) >= self.most:
                closed = self.room.pop(0)[1]
            room, window = self.size, self.next_id
            self.next_id += 1
        if room > length:
            bisect.insort(self.room, (room - length, window))
        return window, self.size - room, closed


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, left_open boolean, first_open boolean"


def _packer(path: str, size: int, most: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        task = TaskContext.get()
        windows = Windows((task.partitionId() if task else 0) << 31, size, most)
        waiting: dict[int, list[tuple]] = {}  # pieces of open windows
        done: list[tuple] = []
        closing = np.array([CLOSING_ID], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "left_open", "first_open"])

        for part in slices(batches, "text"):
            for doc_id, mine in zip(part.column("doc_id").to_pylist(), ids.of(utf8(part, "text"))):
                mine += closing
                total = len(mine) // 4
                for start in range(0, total, size):
                    piece = mine[4 * start : 4 * (start + size)]
                    length = len(piece) // 4
                    row = (doc_id, start, length, zlib.crc32(piece), total)
                    if length == size:
                        done.append((*row, windows.next_id, 0, False, False))
                        windows.next_id += 1
                        continue
                    window, offset, closed = windows.place(length)
                    waiting.setdefault(window, []).append((*row, window, offset))
                    if offset + length == size:
                        done.extend((*x, False, False) for x in waiting.pop(window))
                    if closed is not None:
                        done.extend((*x, False, False) for x in waiting.pop(closed))
            if len(done) >= 10_000:
                yield flush()
                done.clear()
        for pieces in waiting.values():
            done.extend((*x, True, k == 0) for k, x in enumerate(pieces))
        yield flush()

    return kernel


def _merge(size: int):
    def kernel(table: pa.Table) -> pa.Table:
        """Best fit by falling size: where each window goes, and how far in."""
        table = table.sort_by([("fill", "descending"), ("window", "ascending")])
        room: list[tuple[int, int]] = []
        to, at = [], []
        for window, fill in zip(table.column("window").to_pylist(), table.column("fill").to_pylist()):
            k = bisect.bisect_left(room, (fill, -1))
            free, target = room.pop(k) if k < len(room) else (size, window)
            to.append(target)
            at.append(size - free)
            if free > fill:
                bisect.insort(room, (free - fill, target))
        return pa.table({"window": table.column("window"), "sequence_id": pa.array(to, pa.int64()), "shift": pa.array(at, pa.int64())})

    return kernel


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = MAX_TOKENS, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _packer(path, size, open_windows), PIECES), "pieces")
    left = pieces.where("left_open").groupBy("window").agg(F.sum("length").alias("fill"))
    groups = max(1, -(-pieces.where("first_open").count() // MERGE_WINDOWS))
    moves = left.withColumn("g", F.pmod(F.xxhash64("window"), F.lit(groups))).groupBy("g").applyInArrow(_merge(size), "window long, sequence_id long, shift long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    moved = pieces.where("left_open").join(moves, "window").select(*columns, "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
    return pieces.where("NOT left_open").select(*columns, F.col("window").alias("sequence_id"), "offset").unionByName(moved)


def op8_bounded_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
