"""Operator 9: shards by a minimax contiguous partition.

Documents with equal texts are one atomic group. Groups are ordered by the SHA-256 of their text, and
their sizes (UTF-8 bytes plus one for each document) are cut into contiguous shards whose largest is as small
as can be: a binary search over the capacity, each tried by filling shards greedily, then cuts at the smallest feasible one.

The driver never holds the groups. It holds a radix tree of digest prefixes with exact sums: a first level of
``16 ** STEP`` nodes, and below a node only where a cut of a tried capacity can fall. A node of one group is atomic.
With bounds in place of exact cuts the check answers most capacities without looking deeper.

Defined cases: a null text has the size 1 and the digest of the empty text. Repeated rows are documents of their own.
A group larger than the ideal shard stays whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm import common

STEP = 3  # hexadecimal digits of a level


@dataclass
class Node:
    size: int
    atomic: bool
    last: str  # the greatest digest below it
    children: list[Node] | None = field(default=None)
    prefix: str = ""


class Tree:
    """Ordered sums of groups, known as deep as was asked for."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.nodes = self._level([""])[""]
        self.total = sum(n.size for n in self.nodes)

    def _level(self, prefixes: list[str]) -> dict[str, list[Node]]:
        """The children of the given nodes, which have prefixes of one length; at most 16 ** STEP each."""
        deep = len(prefixes[0])
        rows = self.rows if not deep else self.rows.where(F.substring("digest", 1, deep).isin(prefixes))
        found = rows.groupBy(F.substring("digest", 1, deep + STEP).alias("prefix")).agg(F.sum("size").alias("size"), F.min("digest").alias("first"), F.max("digest").alias("last"))
        out: dict[str, list[Node]] = {p: [] for p in prefixes}
        for r in sorted(found.collect(), key=lambda r: r["prefix"]):
            out[r["prefix"][:deep]].append(Node(r["size"], r["first"] == r["last"], r["last"], None, r["prefix"]))
        return out

    def open(self, nodes: list[Node]) -> None:
        by_depth: dict[int, list[Node]] = {}
        for n in nodes:
            by_depth.setdefault(len(n.prefix), []).append(n)
        for same in by_depth.values():
            got = self._level([n.prefix for n in same])
            for n in same:
                n.children = got[n.prefix]

    def leaves(self) -> list[Node]:
        def below(nodes):
            for n in nodes:
                yield from below(n.children) if n.children is not None else [n]

        return list(below(self.nodes))


def _try(leaves: list[Node], ends: list[int], capacity: int, shards: int) -> tuple[bool | None, set[int], list[int]]:
    """Whether ``shards`` greedy fills reach the end: yes, no, or unknown until the returned leaves are opened. Also the cuts (leaf counts)."""
    low = high = 0  # the last cut lies between them
    cuts, blurred = [], set()
    for _ in range(shards):
        i, j = bisect_right(ends, low + capacity), bisect_right(ends, high + capacity)
        new_low = max(low, ends[i - 1] if i else 0)
        if j < len(ends) and not leaves[j].atomic:
            new_high = min(high + capacity, ends[j])
        else:
            new_high = max(high, ends[j - 1] if j else 0)
        for k in range(i, min(j, len(leaves) - 1) + 1):
            if not leaves[k].atomic and (ends[k - 1] if k else 0) <= high + capacity and ends[k] > low + capacity:
                blurred.add(k)
        low, high = new_low, max(new_low, new_high)
        cuts.append(i)
    total = ends[-1] if ends else 0
    if low >= total:
        return True, set(), cuts
    if high < total:
        return False, set(), cuts
    return None, blurred, cuts


def smallest_capacity(tree: Tree, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity and the greatest digest of each shard but the last."""
    if not tree.total:
        return 0, []

    def check(capacity: int) -> list[str] | None:
        """The cuts, where the capacity is feasible."""
        while True:
            leaves, ends, at = tree.leaves(), [], 0
            for n in leaves:
                at += n.size
                ends.append(at)
            answer, blurred, cuts = _try(leaves, ends, capacity, shards)
            if answer is not None:
                return [leaves[c - 1].last for c in cuts if 0 < c < len(leaves)] if answer else None
            tree.open([leaves[k] for k in sorted(blurred)])

    lo, hi = -(-tree.total // shards), tree.total
    while lo < hi:
        mid = (lo + hi) // 2
        if check(mid) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, check(lo) or []


def shard_documents(spark: SparkSession, documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest"))
    n = common.tasks(spark)
    ordered = rows.repartitionByRange(n, "digest", "doc_id").sortWithinPartitions("digest", "doc_id", "size")
    kept = common.stage(ordered.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "shards")
    _, cuts = smallest_capacity(Tree(kept.select("digest", "size")), shards)
    shard = F.lit(0)
    for last in cuts:
        shard = shard + (F.col("digest") > F.lit(last)).cast("int")
    placed = kept.withColumn("shard", shard.cast("int"))
    before, offsets = {}, []
    for r in placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("shard", "part").collect():  # a few rows a part
        offsets.append((r["shard"], r["part"], before.get(r["shard"], 0)))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    table = F.broadcast(spark.createDataFrame(offsets, "shard int, part int, before long"))
    order = Window.partitionBy("part", "shard").orderBy("row")
    slots = placed.withColumn("inside", F.row_number().over(order) - 1).join(table, ["shard", "part"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))
