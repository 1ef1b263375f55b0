"""Count-only Viterbi: how many pieces the best segmentation of a text under a unigram vocabulary has.

An Aho-Corasick automaton names every vocabulary piece that ends at each position; the dynamic programme carries the best
score and its number of pieces, and never the pieces. The tie rule is the unigram tokenizers': among equal scores the
piece that begins first stands, since a later candidate must be strictly better. A character that is no piece by itself
may stand as unknown, at the lowest score of the vocabulary less 10, and counts as its UTF-8 bytes (byte fallback).

The vocabulary file gives pieces in order of rank; the unigram score of rank r is -ln(r + 2), rounded to 1/1024 so that
sums of scores are exact in any order. A text is ' ' and its content, with every space written as U+2581. No piece has that
mark after another character and none holds a line feed, so a text falls into independent segments, and the counts of
segments are cached.

Defined cases: a null or empty text has 0 pieces; texts of any length are taken whole, in bounded parts; repeated rows
are counted once each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import ChunkCache, slices, table, utf8

SPACE_MARK, UNKNOWN_PENALTY = "▁", 10.0
_SEGMENT = re.compile(rb" +[^ \n]*|\n|[^ \n]+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a vocabulary file that match text, with scores by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(p, -round(math.log(r + 2) * 1024) / 1024) for r, p in enumerate(pieces)]


class Counter:
    """Piece counts of texts under a vocabulary of (piece, score)."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (piece, _) in enumerate(vocab):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p, _ in vocab])
        self.scores = np.array([s for _, s in vocab])
        self.single = frozenset(p for p, _ in vocab if len(p) == 1)
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        for piece, _ in vocab:
            if "\n" in piece or SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError("a piece crosses the segments that texts are cut into")
        self.cache = ChunkCache(self.segments)

    def segments(self, chunks: list[bytes]) -> list[tuple[int, int]]:
        """(pieces, bytes that fell back) of the best segmentation of each chunk.

        One pass of the automaton over all chunks, with a line feed after each; then one step of the dynamic programme for
        each distance from a chunk's begin, over all chunks at once. A few very long chunks go one by one instead.
        """
        out: dict[bytes, tuple[int, int]] = {c: self.segment(c.decode().replace(" ", SPACE_MARK)) for c in chunks if len(c) > 256}
        short = [c for c in chunks if len(c) <= 256]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            out.update(zip(part, self._many([c.decode().replace(" ", SPACE_MARK) for c in part])))
        return [out[c] for c in chunks]

    def _many(self, texts: list[str]) -> list[tuple[int, int]]:
        sizes = np.array([len(t) for t in texts])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        joined = "\n".join(texts)
        pairs = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(joined)), np.int64)
        where, which = pairs[0::2] + 1, pairs[1::2]  # by end; of those with one end, the longest (that begins first) comes first
        length, score = self.lengths[which], self.scores[which]
        worth, fell = np.ones(len(where), np.int64), np.zeros(len(where), np.int64)
        strange = {c for c in set(joined) if c not in self.single and c != "\n"}
        if strange:  # an unknown character is one more candidate of length 1, after all pieces that end with it
            alien = np.array([m.start() for m in re.finditer("[" + re.escape("".join(strange)) + "]", joined)], np.int64)
            size = np.array([len(joined[k].encode()) for k in alien.tolist()], np.int64)
            at = np.searchsorted(where, alien + 1, "right")
            where, length, score = np.insert(where, at, alien + 1), np.insert(length, at, 1), np.insert(score, at, self.unknown)
            worth, fell = np.insert(worth, at, size), np.insert(fell, at, size)
        step = where - np.repeat(begins, np.bincount(np.searchsorted(begins, where - 1, "right") - 1, minlength=len(begins)))
        order = np.argsort(step.astype(np.uint16), kind="stable")
        where, length, score, worth, fell, step = (x[order] for x in (where, length, score, worth, fell, step))
        best, pieces, fallback = np.zeros(len(joined) + 2), np.zeros(len(joined) + 2, np.int64), np.zeros(len(joined) + 2, np.int64)
        bounds = np.searchsorted(step, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            w = where[a:b]
            came = w - length[a:b]
            total = best[came] + score[a:b]
            group = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, np.int64)
            if not len(group):
                continue
            top = np.maximum.reduceat(total, group)
            at_top = np.flatnonzero(total == np.repeat(top, np.diff(np.append(group, len(w)))))
            chosen = at_top[np.searchsorted(at_top, group)]  # the first of equals
            best[w[chosen]] = top
            pieces[w[chosen]] = pieces[came[chosen]] + worth[a:b][chosen]
            fallback[w[chosen]] = fallback[came[chosen]] + fell[a:b][chosen]
        stops = begins + sizes
        # A line feed is a chunk of its own: never a piece, one byte.
        return [(1, 1) if t == "\n" else (p, f) for t, p, f in zip(texts, pieces[stops].tolist(), fallback[stops].tolist())]

    def segment(self, text: str) -> tuple[int, int]:
        """(pieces, bytes that fell back) of the best segmentation of one text."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        pieces, fallback = [0] * (n + 1), [0] * (n + 1)
        lengths, scores = self.lengths.tolist(), self.scores.tolist()
        done = 0

        def unknowns(to: int) -> None:
            """Closes the positions up to `to`: after all pieces that end there, the unknown character may."""
            nonlocal done
            while done < to:
                c = text[done]
                if c not in self.single:
                    score = best[done] + self.unknown
                    if best[done + 1] is None or score > best[done + 1]:
                        size = len(c.encode())
                        best[done + 1], pieces[done + 1], fallback[done + 1] = score, pieces[done] + size, fallback[done] + size
                done += 1

        for last, k in self.automaton.iter(text):
            end = last + 1
            if done < last:
                unknowns(last)
            score = best[end - lengths[k]] + scores[k]
            if best[end] is None or score > best[end]:
                best[end], pieces[end], fallback[end] = score, pieces[end - lengths[k]] + 1, fallback[end - lengths[k]]
        unknowns(n)
        return pieces[n], fallback[n]

    def of(self, texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
        small = [_SEGMENT.findall(b" " + t) if t and len(t) <= 1 << 20 else [] for t in texts]
        known = self.cache.of(small)
        sums = [self._sum(known, chunks) for chunks in small]
        for text, found in zip(texts, sums):
            if text and len(text) > 1 << 20:
                parts = [self._sum(self.cache.of([chunks]), chunks) for chunks in self._parts(b" " + text)]
                found = sum(p for p, _ in parts), sum(f for _, f in parts)
            yield found

    @staticmethod
    def _sum(known: dict, chunks: list[bytes]) -> tuple[int, int]:
        values = list(map(known.__getitem__, chunks))
        return sum(v[0] for v in values), sum(v[1] for v in values)

    @staticmethod
    def _parts(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
        if len(text) <= size:
            yield _SEGMENT.findall(text)
            return
        part: list[bytes] = []
        held = 0
        for m in _SEGMENT.finditer(text):
            part.append(m.group())
            held += len(m.group())
            if held >= size:
                yield part
                part, held = [], 0
        yield part


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_chars, n_tokens, n_fallback_bytes) for (doc_id, text)."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in slices(batches, "text"):
            found = list(count.of(utf8(part, "text")))
            chars = pa.compute.fill_null(pa.compute.utf8_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), chars, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "n_chars", "n_tokens", "n_fallback_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, n_chars long, n_tokens long, n_fallback_bytes long")


def op10_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
