"""Sums of long count vectors over a whole table, of a fixed size whatever the input.

A task counts into one vector and sends it in compressed blocks; blocks are summed by block number. The
sum has a fixed, documented length, so it may be collected and broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = 64


def _packed(counts: np.ndarray) -> bytes:
    """A block of counts: as they are, or as places and counts where few places have any."""
    at = np.flatnonzero(counts)
    if len(at) * 4 < len(counts):
        return b"s" + zlib.compress(np.concatenate([np.diff(at, prepend=0).astype(np.uint32), counts[at].astype(np.uint32)]).tobytes(), 1)
    return b"d" + zlib.compress(counts.astype(np.uint32).tobytes(), 1)


def _add(total: np.ndarray, packed: bytes) -> None:
    data = np.frombuffer(zlib.decompress(packed[1:]), np.uint32)
    if packed[:1] == b"d":
        total += data
    else:
        half = len(data) // 2
        total[np.cumsum(data[:half].astype(np.int64))] += data[half:]


def summed(df: DataFrame, indexes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], length: int, presence: bool = False) -> np.ndarray:
    """How often each index below ``length`` comes in the index arrays that ``indexes`` yields over the table.

    With ``presence``: 1 where it comes at all, as bytes.
    """
    width = -(-length // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = None, [], 0
        for index in indexes(batches):
            waiting.append(index)
            n += len(index)
            if n > length:
                part = np.bincount(np.concatenate(waiting), minlength=length)
                total = part if total is None else total + part
                waiting, n = [], 0
        if n * 8 < length and total is None:  # few: never as long as the vector
            places, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
        else:
            if n:
                part = np.bincount(np.concatenate(waiting), minlength=length)
                total = part if total is None else total + part
            places = np.flatnonzero(total)
            counts = total[places]
        if presence:
            counts = np.minimum(counts, 1)
        ends = np.searchsorted(places, np.arange(BLOCKS + 1) * width)
        for i in range(BLOCKS):
            if ends[i] < ends[i + 1]:
                block = np.zeros(min(width, length - i * width), np.int64)
                block[places[ends[i] : ends[i + 1]] - i * width] = counts[ends[i] : ends[i + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(block)], pa.binary())], names=["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        total = np.zeros(min(width, length - block * width), np.int64)
        for packed in pdf["counts"]:
            _add(total, packed)
        return pd.DataFrame({"block": [block], "counts": [_packed(total)]})

    kind = "block int, counts binary"
    out = np.zeros(length, np.uint8 if presence else np.int64)
    for r in df.mapInArrow(run, kind).groupBy("block").applyInPandas(add, kind).collect():  # BLOCKS rows at most
        part = out[r["block"] * width : (r["block"] + 1) * width]
        total = np.zeros(len(part), np.int64)
        _add(total, bytes(r["counts"]))
        part[:] = total > 0 if presence else total
    return out
