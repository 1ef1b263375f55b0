"""Quality rules from tokenizer fertility: what public vocabularies make of a text, against bands for its language.

Base counts come first. Then two vocabularies measure a text: characters per token under a byte-fallback vocabulary and
under a byte-level one, the share of tokens that fell back to bytes, and the entropy of the tokens. The bands come from
the corpus itself, over all documents that pass the base rules: for each language (where the language is null, the
script that most letters have) the median and the median absolute deviation; entropy also by the power of two of the
number of tokens, since it grows with it. A text outside `width` robust deviations on the bad side of a band is
rejected. Where a group has fewer than `least` documents, the next wider one sets the band: the script, then all documents;
for entropy the language with the neighbouring powers of two, the script with the same one, with neighbouring ones, all
documents likewise, and last all documents of any size, however few they are. So every document is judged.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows count each; an
empty table gives no rows; other columns are left out; very long texts are measured whole, in parts cut at white space.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import ChunkCache, materialize, segments, slices, table, utf8

SYMBOLS = b"#*$%&|<>"
#: Robust standard deviations that a band is wide, its least width as a share of the median, and documents that a group needs to set one before wider groups do.
BAND_WIDTH, BAND_FLOOR, GROUP_LEAST = 5.0, 0.04, 50

_RANGES = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)]


def script(text: bytes) -> str:
    """The script that most characters of a text have, of a fixed list, or 'other'."""
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    counts = [int(((points >= a) & (points <= b)).sum()) for _, a, b in _RANGES]
    return _RANGES[int(np.argmax(counts))][0] if max(counts) else "other"


def repeated_words(words: list[bytes]) -> int:
    """Words inside runs of three that occur twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    runs = list(zip(words, words[1:], words[2:]))
    if len(set(runs)) == n:
        return 0
    counts = Counter(runs)
    total = covered = 0
    for i, run in enumerate(runs):
        if counts[run] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


class Vocabularies:
    """Tokens of chunks under the two vocabularies: (ids under the byte-fallback one, number under the byte-level one)."""

    def __init__(self, fallback_path: str, level_path: str):
        import base64

        import sentencepiece
        import tiktoken

        self.fallback = sentencepiece.SentencePieceProcessor(model_file=fallback_path)
        with open(level_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.level = tiktoken.Encoding("level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.fallback.is_byte(i) for i in range(self.fallback.get_piece_size())])
        self.cache = ChunkCache(self.compute)

    def compute(self, chunks: list[bytes]) -> list[tuple[bytes, int]]:
        texts = [c.decode() for c in chunks]
        ids = self.fallback.encode(texts, num_threads=1)
        level = self.level.encode_ordinary
        return [(np.array(x, "<u4").tobytes(), len(level(" " + t))) for x, t in zip(ids, texts)]


_vocabularies: dict[tuple[str, str], Vocabularies] = {}

METRICS = "doc_id long, band string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_level_token double, fallback_share double, token_entropy double"


def _measure(paths: tuple[str, str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _vocabularies:
            _vocabularies[paths] = Vocabularies(*paths)
        v = _vocabularies[paths]
        for part in slices(batches, "text"):
            rows = []
            texts = [t or b"" for t in utf8(part, "text")]
            chars = pa.compute.fill_null(pa.compute.utf8_length(part.column("text")), 0).to_pylist()
            word_lists = [t.split() for t in texts]
            known = v.cache.of([w for w, t in zip(word_lists, texts) if len(t) <= 1 << 20])
            for doc_id, lang, text, n, words in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), texts, chars, word_lists):
                lines = [x for x in text.split(b"\n") if x.strip()]
                if len(text) <= 1 << 20:
                    found = [list(map(known.__getitem__, words))]
                else:
                    found = []
                    for chunks in (s.split() for s in segments(text)):
                        part_known = v.cache.of([chunks])
                        found.append(list(map(part_known.__getitem__, chunks)))
                    known = v.cache.of([w for w, t in zip(word_lists, texts) if len(t) <= 1 << 20])
                counts = np.zeros(0, np.int64)
                for values in found:
                    more = np.bincount(np.frombuffer(b"".join([x[0] for x in values]), "<u4"), minlength=len(counts))
                    more[: len(counts)] += counts
                    counts = more
                total, level = int(counts.sum()), sum(x[1] for values in found for x in values)
                some = counts[counts > 0]
                word_chars = n - sum(text.count(b) for b in b" \t\n\v\f\r")
                entropy = float(math.log2(total) - (some * np.log2(some)).sum() / total) if total else 0.0
                fell = int(counts[v.is_byte[: len(counts)]].sum())
                letters = script(text)
                rows.append((
                    doc_id, lang or letters, letters, len(words), word_chars, sum(text.count(b) for b in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
                    total, word_chars / total if total else 0.0, word_chars / level if level else 0.0, fell / total if total else 0.0, entropy,
                ))
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in METRICS.split(", ")])

    return kernel


def _key(*parts) -> Column:
    return F.concat_ws("\x1f", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _rungs() -> tuple[list[tuple[Column, Column]], list[tuple[Column, Column]]]:
    """For the plain measures and for entropy, from the narrowest group to the widest: the key of the group that judges a document, and the keys of those that it counts in."""
    levels = [_key("band", F.col("band")), _key("script", F.col("script")), _key("all")]
    plain = [(k, F.array(k)) for k in levels]
    sized = []
    for level in levels:
        for apart in (0, 1):
            sized.append((_key(level, apart, F.col("size")), F.array(*[_key(level, apart, F.col("size") + d) for d in range(-apart, apart + 1)])))
    return plain, [*sized, (_key("all"), F.array(_key("all")))]


#: Rows of a table of bands that may be broadcast; a larger one (as many languages as that) is joined by its key.
MOST_BANDS = 50_000


def _small(bands: DataFrame) -> DataFrame:
    return F.broadcast(bands) if bands._rows <= MOST_BANDS else bands


def _bands(passed: DataFrame, rungs: list[tuple[Column, Column]], measures: list[str], least: int) -> DataFrame:
    """For each group of the rungs that may set a band: the median m_x and the median absolute deviation d_x of each measure."""
    members = passed.select(F.explode(F.flatten(F.array(*[keys for _, keys in rungs]))).alias("group"), *measures)
    enough = (F.col("n") >= least) | (F.col("group") == _key("all"))
    middle = members.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile_approx(x, 0.5).alias(f"m_{x}") for x in measures]).where(enough).drop("n")
    middle = materialize(middle, "fertility-middle", narrow=True)  # a row for each language, script and size
    deviations = members.join(_small(middle), "group").groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5).alias(f"d_{x}") for x in measures])
    return materialize(middle.join(deviations, "group"), "fertility-bands", narrow=True)


def _with_bands(docs: DataFrame, bands: DataFrame, rungs: list[tuple[Column, Column]], measures: list[str]) -> DataFrame:
    """The documents with the band of the narrowest of their groups that sets one."""
    names = [f"{a}_{x}" for x in measures for a in "md"]
    found = docs
    for i, (key, _) in enumerate(rungs):
        rung = bands.select(F.col("group").alias(f"_g{i}"), F.struct(*names).alias(f"_b{i}"))
        found = found.withColumn(f"_k{i}", key).join(F.broadcast(rung) if bands._rows <= MOST_BANDS else rung, F.col(f"_k{i}") == F.col(f"_g{i}"), "left").drop(f"_k{i}", f"_g{i}")
    band = F.coalesce(*[F.col(f"_b{i}") for i in range(len(rungs))])
    return found.select(*docs.columns, *[band[n].alias(n) for n in names])


def judge(docs: DataFrame, fallback_path: str | None = None, level_path: str | None = None, width: float = BAND_WIDTH, floor: float = BAND_FLOOR, least: int = GROUP_LEAST) -> DataFrame:
    """Base counts, measures and the verdict `kept` for (doc_id, text, lang)."""
    paths = (fallback_path or public_tokenizers.path("piece_bpe_32k.model"), level_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialize(source.mapInArrow(_measure(paths), METRICS).withColumn("base_failed", failed).withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1))))), "fertility")
    passed = measured.where("NOT base_failed")
    plain, sized = ["chars_per_token", "chars_per_level_token", "fallback_share"], ["token_entropy"]
    plain_rungs, sized_rungs = _rungs()
    judged = _with_bands(measured, _bands(passed, plain_rungs, plain, least), plain_rungs, plain)
    judged = _with_bands(judged, _bands(passed, sized_rungs, sized, least), sized_rungs, sized)

    def slack(x: str):
        return F.greatest(F.lit(width * 1.4826) * F.col(f"d_{x}"), F.lit(floor) * F.abs(F.col(f"m_{x}")))

    outside = F.lit(False)
    for x in ("chars_per_token", "chars_per_level_token"):  # too short: broken words or symbols; too long: runs of one piece
        outside |= F.coalesce(F.abs(F.col(x) - F.col(f"m_{x}")) > slack(x), F.lit(False))
    outside |= F.coalesce(F.col("fallback_share") > F.col("m_fallback_share") + F.greatest(slack("fallback_share"), F.lit(0.02)), F.lit(False))
    outside |= F.coalesce(F.col("token_entropy") < F.col("m_token_entropy") - slack("token_entropy"), F.lit(False))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, (~F.col("base_failed") & ~outside).alias("kept"), "n_tokens", "chars_per_token", "chars_per_level_token", "fallback_share", "token_entropy")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
