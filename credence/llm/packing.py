"""Operator 7: packing by first-fit decreasing over a tournament tree of bin capacities.

A document's ids (with its end id) are cut into pieces of the sequence length and one rest. Full pieces
are sequences of their own. The rests are dealt at random into groups of about ``GROUP`` pieces; each group
is packed by itself, longest first, each into the first bin that still has room. A tournament tree over
the bins' free room finds that bin in logarithmic time. Groups are bounded, so no task grows with the input.

Defined cases: a null text is the empty text and one piece of one id. Repeated rows are packed each.
Ties in length are broken by document id, start and input row. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import bpe, common, words

LENGTH, END_ID, GROUP = 2048, 1, 4096
PIECE = "doc_id long, rid long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str | None, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path or bpe.default_vocabulary()).encode
        end = struct.pack("<I", end_id)
        for batch, _, _ in words.groups(batches):
            rows: list[tuple] = []
            for doc, rid, raw in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                raw += end
                total = len(raw) // 4
                for at in range(0, total, length):
                    part = raw[4 * at : 4 * (at + length)]
                    rows.append((doc, rid, at, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "rid", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Tournament:
    """Free room of bins 0, 1, 2, ...; finds the first bin with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with ``size`` free; its room is taken."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size; the sizes must come in descending order."""
    tree = Tournament(max(1, len(sizes)), capacity)
    used: dict[int, int] = {}
    bins, offsets = [], []
    for size in sizes:
        b = tree.place(size)
        bins.append(b)
        offsets.append(used.get(b, 0))
        used[b] = offsets[-1] + size
    return bins, offsets


def _pack_group(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "rid"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pieces["length"].tolist(), capacity)
        out = pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = 2 * ((pieces["bucket"].to_numpy(np.int64) << 31) | np.array(bins, np.int64))
        out["offset"] = np.array(offsets, np.int64)
        return out

    return run


def pack(spark: SparkSession, documents: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row a piece. Even sequence ids are packed bins, odd ones full pieces."""
    common.short_batches(spark)
    buckets = max(1, -(-documents.count() // group))
    rows = common.texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", F.monotonically_increasing_id()), "doc_id", "rid")
    pieces = common.stage(rows.mapInArrow(_pieces(vocabulary, length, end_id), PIECE), "pieces")
    full = pieces.where(F.col("length") == length).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1)
    rest = pieces.where(F.col("length") < length).withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    packed = rest.groupBy("bucket").applyInPandas(_pack_group(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.unionByName(full.select(*columns, F.lit(0).cast("long").alias("offset")))
