"""Integrity of files against a manifest: sizes and SHA-256 digests of ranges, so that a long file is read by many tasks and a changed byte is located."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_BYTES = 16 << 20
DIGESTS = "path string, part long, bytes long, sha256 string"
_READ = 1 << 20


def digest_files(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, part, bytes, sha256) of rows (path, length), such as spark.read.format("binaryFile") lists without their content. An empty file has one part of no bytes (that source leaves such files out)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist()):
                store, name = fs.FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", path))
                with store.open_input_file(name) as f:
                    f.seek(part * range_bytes)
                    digest, left = hashlib.sha256(), range_bytes
                    while left and (data := f.read(min(_READ, left))):
                        digest.update(data)
                        left -= len(data)
                rows.append((path, part, range_bytes - left, digest.hexdigest()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], [x.split()[0] for x in DIGESTS.split(", ")])

    parts = F.greatest(F.lit(1), F.ceil(F.col("length") / range_bytes)).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return ranges.repartition("path", "part").mapInArrow(kernel, DIGESTS)


def verdicts(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, verdict, bad): both are (path, part, bytes, sha256). missing: nowhere found; unknown: not in the manifest; size: as a whole longer or shorter; changed: of that
    size, but with other content; else intact. bad lists the parts that differ or are on one side alone."""
    want, have = (d.select("path", "part", F.struct("bytes", "sha256").alias(name)) for d, name in ((manifest, "want"), (found, "have")))
    both = want.join(have, ["path", "part"], "full")
    total = lambda side: F.sum(F.col(f"{side}.bytes"))
    differs = ~F.col("want").eqNullSafe(F.col("have"))
    seen = both.groupBy("path").agg(total("want").alias("w"), total("have").alias("h"), F.array_sort(F.collect_list(F.when(differs, F.col("part")))).alias("bad"))
    verdict = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "unknown").when(F.col("h") != F.col("w"), "size").when(F.size("bad") > 0, "changed").otherwise("intact")
    return seen.select("path", verdict.alias("verdict"), "bad")
