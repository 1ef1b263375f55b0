"""Effects with carried state over blocks of samples: in batch along sorted partitions, and over a stream with a state store.

Blocks are rows (clip_id, channel, block_idx, start, samples) with the clip's sample_rate and channels beside them. A partition
is read block by block, so a clip of any length takes the memory of one block and the effect's state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from sonoframe import schema
from sonoframe.kernels.pieces import InOrder, LoudnessCells

CELLS = "clip_id string, sample_rate int, start long, stop long, energy double, peak double"
#: The state store that keeps more than one value a key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sound:
    """Rows of blocks of what an effect gives, in blocks of the usual size from the clip's start on."""

    schema = schema.BLOCKS

    def __init__(self):
        self.at, self.held = 0, None

    def rows(self, clip_id: str, rate: int, pieces: list, last: bool = False) -> Iterator[tuple]:
        found = [x for x in (self.held, *(x for _, x in pieces)) if x is not None and x.shape[1]]
        whole = np.concatenate(found, axis=1) if found else None
        self.held = None
        while whole is not None and whole.shape[1] and (whole.shape[1] >= schema.BLOCK or last):
            for c, x in enumerate(whole[:, : schema.BLOCK]):
                yield clip_id, c, self.at // schema.BLOCK, self.at, x.astype(np.float32)
            self.at += min(schema.BLOCK, whole.shape[1])
            whole = whole[:, schema.BLOCK :]
        if whole is not None and whole.shape[1]:
            self.held = whole


class Cells:
    """Rows of loudness cells."""

    schema = CELLS

    def rows(self, clip_id: str, rate: int, pieces: list, last: bool = False) -> Iterator[tuple]:
        for _, cells in pieces:
            for cell in cells:
                yield clip_id, rate, *cell


def _kinds(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def along(blocks: DataFrame, make: Callable[[float, int], object], out: type = Sound) -> DataFrame:
    """An effect over all clips in batch: one shuffle by clip, then block by block."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            for batch in batches:
                lists = batch.column("samples")
                names = [batch.column(c).to_pylist() for c in ("clip_id", "start", "channel", "sample_rate", "channels")]
                for k, row in enumerate(zip(*names)):
                    yield *row, np.asarray(lists[k].values, np.float32) if lists[k].is_valid else np.zeros(0, np.float32)

        kinds, held, size = _kinds(out.schema), [], 0
        for clip_id, rows in groupby(read(), key=lambda r: r[0]):
            order, giver, rate = None, out(), None
            for _, start, channel, rate, channels, samples in rows:
                order = order or InOrder(make, rate, channels)
                for row in giver.rows(clip_id, rate, order.add(start, channel, samples)):
                    held.append(row)
                    size += len(row[-1]) if isinstance(row[-1], np.ndarray) else 1
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
                    held, size = [], 0
            held += giver.rows(clip_id, rate, order.end(), True)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    dealt = blocks.select("clip_id", "start", "channel", "sample_rate", "channels", "samples").repartition("clip_id").sortWithinPartitions("clip_id", "start", "channel")
    return dealt.mapInArrow(kernel, out.schema)


class _Stateful(StatefulProcessor):
    """Carries a clip's InOrder and its giver, pickled, from one micro-batch to the next."""

    def __init__(self, make: Callable[[float, int], object], out: type, patience: int):
        self.make, self.out, self.patience = make, out, patience

    def init(self, handle) -> None:
        self.state = handle.getValueState("clip", "carried binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        order, giver = pickle.loads(self.state.get()[0]) if self.state.exists() else (None, self.out())
        found: list[tuple] = []
        for part in rows:
            part = part.sort_values(["start", "channel"])
            for start, channel, rate, channels, samples in zip(part["start"], part["channel"], part["sample_rate"], part["channels"], part["samples"]):
                order = order or InOrder(self.make, int(rate), int(channels), self.patience)
                found += giver.rows(key[0], int(rate), order.add(int(start), int(channel), np.asarray(samples, np.float32)))
        self.state.update((pickle.dumps((order, giver)),))
        yield pd.DataFrame(found, columns=[f.name for f in _kinds(self.out.schema)])

    def close(self) -> None:
        pass


def streamed(blocks: DataFrame, make: Callable[[float, int], object], out: type = Sound, patience: int = 8) -> DataFrame:
    """An effect over a stream of blocks that may come in any order (see `InOrder` for late and missing ones). The session's state store must be `STORE`'s.

    A stream has no end, so what an effect holds back (a look-ahead, an open cell, the rest of a block) comes with the blocks that follow.
    """
    return blocks.groupBy("clip_id").transformWithStateInPandas(statefulProcessor=_Stateful(make, out, patience), outputStructType=out.schema, outputMode="Append", timeMode="None")


def loudness_cells(blocks: DataFrame, patience: int = 8) -> DataFrame:
    """Rows (clip_id, sample_rate, start, stop, energy, peak) of K-weighted cells, of a table or a stream of blocks."""
    return streamed(blocks, LoudnessCells, Cells, patience) if blocks.isStreaming else along(blocks, LoudnessCells, Cells)
