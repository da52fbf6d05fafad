"""Operator 6: self-join of documents by the Jaccard similarity of their word shingles.

Prefix filtering, rare first. (1) A count of all shingles in ``BUCKETS`` hash buckets gives one global order, rarest
bucket first. (2) With threshold t, two sets link only if they share k of their ``n - ceil(t n) + k`` first shingles, for each k.
Only these are dealt out by shingle, with k a tenth of the set. There, documents of a shingle are chained where their lengths allow a link;
a task chains its own documents first and sends on only the ends of a chain, so a shingle in very many
documents stays a few rows a task. (3) The chains' connected components are disjoint blocks that
hold every possible link. A set of whose first shingles fewer than the k of its smallest possible partner are in any chain of two sets
links with nothing and leaves its block; this holds back texts that share a passage only, however coarse the order is. (4) Each block is joined by itself: exact local order, prefix index, length, positional and suffix
filters, then each surviving pair is verified once on its whole sets with integers. A pair already
connected by other links is not verified, since only components are asked for. A block of more than ``WEIGHT``
shingles is dealt over tiles: cells of a length class and a salt meet in pairs of equal or neighbouring classes.
(5) Tiles' links are connected again.

Equal sets are one node from the start, so copies never multiply. A node's id is a 63-bit hash of its set.

Defined cases: null text or no words: no shingles, linked with nothing. Fewer than ``SIZE`` words: the whole sequence is the one
shingle. Repeated rows link with each other. ``component_id`` is the smallest ``doc_id`` of the component; null ids are not
counted for it. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import common, vectors, words
from credence.llm.components import components

SIZE, PERCENT = 5, 80
BUCKETS, BLOOM = 1 << 22, 1 << 25
WEIGHT = 1_500_000
CLASS = 1.25  # 100 / PERCENT: linked sets are of equal or neighbouring length classes


def _top(h: np.ndarray, size: int) -> np.ndarray:
    """The leading bits of hashes as an index below ``size``, a power of two."""
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _shingles(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, bounds = words.word_hashes(raw, offs, words.SPACE)
    return words.windows(hashes, bounds, SIZE)


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for _, raw, offs in words.groups(batches):
        yield _top(_shingles(raw, offs)[0], BUCKETS)


def _node(sorted_set: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sorted_set.tobytes(), digest_size=8).digest(), "little") >> 1


def prefix_length(n: np.ndarray | int):
    """How many first shingles must be looked at for a set of ``n``."""
    return n - (PERCENT * n + 99) // 100 + 1


def _overlap(n):
    """How many of their first shingles linked sets must share, if neither has fewer than ``n``."""
    return n // 10 + 1


def long_prefix(n: np.ndarray | int):
    """How many first shingles of a set of ``n`` are dealt out."""
    return prefix_length(n) - 1 + _overlap(n)


class Union:
    """Disjoint sets over 0 .. n - 1; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _chains(token: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal tokens chained where lengths allow a link.

    For each chain: token, one node, least and greatest length, whether it has two nodes; then the edges; then, for
    each ``fresh`` row in a chain of two nodes, its node and least length.
    """
    order = np.lexsort((low, token))
    token, node, low, high, fresh = token[order], node[order], low[order], high[order], fresh[order]
    if not len(token):
        return token, node, low, high, fresh, node, node, node, low
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    # the greatest length so far within a token: a running maximum that starts anew with each token
    lift = np.cumsum(first).astype(np.int64) << 32
    reach = np.maximum.accumulate(lift + high) - lift
    new = first.copy()
    new[1:] |= 100 * reach[:-1] < PERCENT * low[1:]
    chain = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    head_node = node[heads]
    least = np.minimum.reduceat(low, heads)
    most = np.maximum.reduceat(high, heads)
    other = node != head_node[chain]
    several = np.logical_or.reduceat(other, heads)
    edges = np.unique(np.stack([node[other], head_node[chain][other]], axis=1), axis=0)
    shared = fresh & several[chain]
    return token[heads], head_node, least, most, several, edges[:, 0], edges[:, 1], node[shared], low[shared]


def _tally(node: np.ndarray, size: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, size and summed count of each node."""
    names, first, place = np.unique(node, return_index=True, return_inverse=True)
    return names, size[first], np.bincount(place, weights=count, minlength=len(names)).astype(np.int64)


def _prefixes(order: object, buckets: int):
    """Per task: chains of its own documents' prefix shingles, in one packed row for each bucket of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = order.value, set()
        tokens, nodes, sizes = [], [], []
        for _, raw, offs in words.groups(batches):
            shingles, bounds = _shingles(raw, offs)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b:
                    continue
                own = np.unique(shingles[a:b])
                node = _node(own)
                if node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                sizes.append(len(own))
                p = long_prefix(len(own))
                if p < len(own):
                    own = own[np.lexsort((own, rank[_top(own, BUCKETS)]))[:p]]
                tokens.append(own)
        if not tokens:
            return
        lengths = [len(own) for own in tokens]
        token = np.concatenate(tokens)
        tokens.clear()
        size = np.repeat(np.array(sizes, np.int64), lengths)
        token, node, low, high, several, left, right, counted, counted_size = _chains(token, np.repeat(np.array(nodes, np.int64), lengths), size, size, np.ones(len(size), bool))
        del size
        counted, counted_size, count = _tally(counted, counted_size, np.ones(len(counted)))
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        short = (token // np.uint64(buckets)).astype(np.uint32)  # equal shingles stay equal; unequal ones that meet only make a block larger
        parted = []
        for key in (bucket, left % buckets, counted % buckets):
            by = np.argsort(key, kind="stable")
            parted.append((by, np.searchsorted(key[by], np.arange(buckets + 1))))
        for k in range(buckets):
            i, j, c = (by[ends[k] : ends[k + 1]] for by, ends in parted)
            if len(i) or len(j) or len(c):
                names, first, place = np.unique(node[i], return_index=True, return_inverse=True)
                wide = np.flatnonzero(high[i] != low[i])  # a chain begins with its shortest set, so only its greatest length is more
                parts = (short[i], place.astype(np.uint32), names, low[i][first].astype(np.uint32), wide.astype(np.uint32), high[i][wide].astype(np.uint32), np.flatnonzero(several[i]).astype(np.uint32))
                parts += (left[j], right[j], counted[c], counted_size[c].astype(np.uint32), count[c].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["bucket", *_PACKED])

    return run


_PACKED = {"token": np.uint32, "place": np.uint32, "node": np.int64, "size": np.uint32, "wide": np.uint32, "high": np.uint32, "several": np.uint32, "a": np.int64, "b": np.int64, "counted": np.int64, "counted_size": np.uint32, "count": np.uint32}


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: of each bucket, edges between nodes, and each node's size and how many of its tokens are in a chain of two nodes."""
    bucket, rows = None, []
    for batch in batches:
        for row in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in _PACKED), strict=True):
            if row[0] != bucket and rows:
                yield from _meet_bucket(rows)
                rows = []
            bucket = row[0]
            rows.append({c: np.frombuffer(x.as_buffer(), kind) for (c, kind), x in zip(_PACKED.items(), row[1:], strict=True)})
    if rows:
        yield from _meet_bucket(rows)


def _meet_bucket(rows: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Tokens that only one task sent are left out before anything else is built."""
    token = np.concatenate([r["token"] for r in rows])
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    meets = np.zeros(len(token), bool)
    meets[order[1:][same]] = True
    meets[order[:-1][same]] = True
    del order, same
    token = token[meets]
    node, low, high, fresh, at = [], [], [], [], 0
    for r in rows:
        n = len(r["token"])
        keep = np.flatnonzero(meets[at : at + n])
        at += n
        place = r["place"][keep]
        node.append(r["node"][place])
        low.append(r["size"][place].astype(np.int64))
        most = r["size"][r["place"]]
        most[r["wide"]] = r["high"]
        high.append(most[keep].astype(np.int64))
        unseen = np.ones(n, bool)  # not counted by the task that sent it
        unseen[r["several"]] = False
        fresh.append(unseen[keep])
    *_, more_left, more_right, more, more_size = _chains(token, np.concatenate(node), np.concatenate(low), np.concatenate(high), np.concatenate(fresh))
    a = np.concatenate([*(r["a"] for r in rows), more_left])
    b = np.concatenate([*(r["b"] for r in rows), more_right])
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = Union(len(names))
    for i, j in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
        sets.join(i, j)
    roots = np.array([sets.find(i) for i in range(len(names))], np.int64)
    out = roots != np.arange(len(names))
    none = pa.nulls(int(out.sum()), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(names[out], pa.int64()), pa.array(names[roots[out]], pa.int64()), none, none], names=["a", "b", "n", "shared"])
    every = [np.concatenate([*(r[c] for r in rows), x]) for c, x in (("counted", more), ("counted_size", more_size), ("count", np.ones(len(more))))]
    nodes, sizes, shared = _tally(*every)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.nulls(len(nodes), pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], names=["a", "b", "n", "shared"])


def _blocks(met: DataFrame) -> DataFrame:
    """node, root: the sets that share enough, in blocks of two or more."""
    least = F.floor(F.floor((F.max("n") * PERCENT + 99) / 100) / 10) + 1  # the overlap that the smallest partner asks for
    able = met.where("shared is not null").groupBy(F.col("a").alias("node")).agg(F.sum("shared").alias("shared"), least.alias("least")).where("shared >= least").select("node")
    held = common.stage(components(met.where("b is not null").select("a", "b")).join(able, "node"), "held")
    several = held.groupBy("root").count().where("count > 1").select("root")
    return common.stage(held.join(several, "root").select("node", "root"), "blocks")


def _documents(members: object):
    """Every document with its node and size; the set itself once a task for nodes that may be in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, seen = members.value, set()
        for batch, raw, offs in words.groups(batches):
            shingles, bounds = _shingles(raw, offs)
            nodes, sizes, sets = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b:
                    nodes.append(None)
                    sizes.append(0)
                    sets.append(None)
                    continue
                own = np.unique(shingles[a:b])
                node = _node(own)
                nodes.append(node)
                sizes.append(len(own))
                wanted = node not in seen and may[_bloom(np.array([node]))[0]]
                seen.add(node)
                sets.append(own.tobytes() if wanted else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "node", "n", "shingles"])

    return run


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and the text's node (null without shingles)."""
    for batch, raw, offs in words.groups(batches):
        shingles, bounds = _shingles(raw, offs)
        nodes = [_node(np.unique(shingles[a:b])) if a != b else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(nodes, pa.int64())], names=["doc_id", "text", "node"])


def _bloom(nodes: np.ndarray) -> np.ndarray:
    return _top(words.mix(nodes.astype(np.uint64)), BLOOM)


def _member_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield _bloom(batch.column("node").to_numpy())


def join_block(sets: list[np.ndarray], side: np.ndarray | None = None) -> Union:
    """Components of the link graph of the given sets; with ``side`` only pairs of unlike sides are looked at."""
    m = len(sets)
    result = Union(m)
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, index, df = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(df), np.int64)  # local rank: rarest first
    place[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
    ranks = place[index]
    owner = np.repeat(np.arange(m), n)
    order = np.lexsort((ranks, owner))
    ranks = ranks[order]
    start = np.concatenate([[0], np.cumsum(n)])
    df_by_rank = np.sort(df)
    position = np.arange(len(ranks)) - np.repeat(start[:-1], n)
    in_prefix = (position < np.repeat(prefix_length(n), n)) & (df_by_rank[ranks] > 1)
    p_rank, p_owner, p_position = ranks[in_prefix], owner[in_prefix], position[in_prefix]
    p_start = np.searchsorted(p_owner, np.arange(m + 1))
    by = np.lexsort((p_owner, p_rank))
    post_rank, post_owner, post_position = p_rank[by], p_owner[by], p_position[by]
    lo_of = np.searchsorted(post_rank, p_rank, side="left")
    hi_of = np.searchsorted(post_rank, p_rank, side="right")
    roots = np.arange(m)
    rare = np.add.reduceat((df_by_rank[ranks] == 1).astype(np.int64), start[:-1])
    turn = np.empty(m, np.int64)  # sets with the fewest shingles of their own come first: they link most
    turn[np.lexsort((np.arange(m), rare / n))] = np.arange(m)
    marked = np.zeros(len(df), bool)
    for x in np.argsort(turn).tolist():
        span = slice(p_start[x], p_start[x + 1])
        counts = hi_of[span] - lo_of[span]
        if not counts.sum():
            continue
        take = np.repeat(lo_of[span] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        y, y_pos = post_owner[take], post_position[take]
        x_pos = np.repeat(p_position[span], counts)
        ok = (turn[y] < turn[x]) & (100 * np.minimum(n[y], n[x]) >= PERCENT * np.maximum(n[y], n[x]))
        if side is not None:
            ok &= side[y] != side[x]
        y, y_pos, x_pos = y[ok], y_pos[ok], x_pos[ok]
        if not len(y):
            continue
        y, firsts, shared = np.unique(y, return_index=True, return_counts=True)
        need = -(-PERCENT * (n[y] + n[x]) // (100 + PERCENT))
        most = shared + np.minimum(n[y] - y_pos[firsts] - 1, n[x] - x_pos[firsts] - 1)  # positional: from the first shared shingle on
        fine = most >= need
        y, shared, need = y[fine], shared[fine], need[fine]
        mine = ranks[start[x] : start[x + 1]]
        half = n[y] // 2  # suffix: split both sets at the middle shingle of y
        at = np.searchsorted(mine, ranks[start[y] + half])
        fine = np.minimum(half, at) + np.minimum(n[y] - half, n[x] - at) >= need
        y, shared, need = y[fine], shared[fine], need[fine]
        if not len(y):
            continue
        marked[mine] = True
        by_shared = np.argsort(-shared, kind="stable")
        y, need = y[by_shared], need[by_shared]
        for chunk in range(0, len(y), 64):
            part, wanted = y[chunk : chunk + 64], need[chunk : chunk + 64]
            for k in np.flatnonzero(roots[part] != result.find(x)).tolist():
                other = int(part[k])
                if result.find(other) != result.find(x) and marked[ranks[start[other] : start[other + 1]]].sum() >= wanted[k]:
                    result.join(x, other)
            roots[part] = [result.find(int(i)) for i in part]
        marked[mine] = False
    return result


def _join_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile: the links of each tile, as one edge to the tile's root for each linked node."""

    def done(rows: dict[int, tuple[np.ndarray, int]]) -> pa.RecordBatch:
        nodes = sorted(rows)
        sides = np.array([rows[k][1] for k in nodes])
        found = join_block([rows[k][0] for k in nodes], sides if (sides >= 0).all() else None)
        pairs = [(nodes[i], nodes[found.find(i)]) for i in range(len(nodes))]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    tile, rows = None, {}
    for batch in batches:
        for t, node, side, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "side", "shingles")), strict=True):
            if t != tile:
                if len(rows) > 1:
                    yield done(rows)
                tile, rows = t, {}
            if node not in rows:
                rows[node] = np.frombuffer(data, np.uint64), side
    if len(rows) > 1:
        yield done(rows)


def _tiles(held: DataFrame) -> DataFrame:
    """tile, side, node for (node, n, root): small blocks as one tile, large ones as pairs of cells."""
    weights = held.groupBy("root").agg(F.sum("n").alias("weight"))
    placed = held.join(weights, "root")
    small = placed.where(F.col("weight") <= WEIGHT).select(F.col("root").cast("string").alias("tile"), F.lit(-1).alias("side"), "node")
    large = placed.where(F.col("weight") > WEIGHT).withColumn("cls", F.floor(F.ln(F.col("n").cast("double")) / F.lit(math.log(CLASS)) + F.lit(1e-9)).cast("int"))
    cells = large.groupBy("root", "cls").agg(F.greatest(F.ceil(F.sum("n") * 2 / F.lit(WEIGHT)).cast("int"), F.lit(1)).alias("k"))
    near = cells.select("root", (F.col("cls") + 1).alias("cls"), F.col("k").alias("k_before"))
    after = cells.select("root", (F.col("cls") - 1).alias("cls"), F.col("k").alias("k_after"))
    dealt = large.join(cells, ["root", "cls"]).join(near, ["root", "cls"], "left").join(after, ["root", "cls"], "left").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))

    def key(low: object, high: object, i: object, j: object, side: object) -> object:
        return F.struct(F.concat_ws(":", F.col("root").cast("string"), low.cast("string"), high.cast("string"), i.cast("string"), j.cast("string")).alias("tile"), side.alias("side"))

    none = F.array().cast("array<struct<tile:string,side:int>>")
    cls, i = F.col("cls"), F.col("i")
    # a cell meets itself (side -1), the cells of its class, and those of the next class and of the one before
    own = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: key(cls, cls, F.least(i, j), F.greatest(i, j), F.when(i == j, F.lit(-1)).otherwise((i > j).cast("int"))))
    up = F.when(F.col("k_after").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("k_after", F.lit(1)) - 1), lambda j: key(cls, cls + 1, i, j, F.lit(0))))
    down = F.when(F.col("k_before").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("k_before", F.lit(1)) - 1), lambda j: key(cls - 1, cls, j, i, F.lit(1))))
    spread = dealt.select("node", F.explode(F.concat(own, up, down)).alias("at")).select("at.tile", "at.side", "node")
    return small.unionByName(spread)


def link_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return _linked(spark, documents).select("doc_id", "n_shingles", "component_id")


def _linked(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node (null without shingles)."""
    common.short_batches(spark)
    n = common.tasks(spark)
    rows = common.texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    text = rows.select("text")
    counts = vectors.summed(text, _count_shingles, BUCKETS)
    order = spark.sparkContext.broadcast(np.minimum(counts, 65535).astype(np.uint16))  # 8 MB whatever the input
    buckets = max(4, n // 4)  # fewer buckets join more of a block at once, so fewer edges remain
    packed = text.mapInArrow(_prefixes(order, buckets), "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))
    met = common.stage(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long, n long, shared long"), "met")
    blocks = _blocks(met)
    bits = spark.sparkContext.broadcast(np.packbits(vectors.summed(blocks.select("node"), _member_bits, BLOOM, presence=True) > 0))
    docs = common.stage(rows.mapInArrow(_documents(_Bits(bits)), "doc_id long, node long, n long, shingles binary"), "sets")
    sets = docs.where("shingles is not null")
    members = sets.select("node", "n").distinct().join(blocks, "node")
    # the sets themselves move twice: to their nodes' tiles' names, and to the tiles
    named = sets.select("node", "shingles").join(_tiles(members).hint("merge"), "node")
    tiles = named.repartition(n, "tile").sortWithinPartitions("tile", "node")
    links = tiles.mapInArrow(_join_tiles, "a long, b long")
    classes = components(links)
    least = docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classed = least.join(classes, "node", "left").withColumn("class", F.coalesce("root", "node"))
    ids = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    by_node = classed.join(ids, "class").select("node", "component_id")
    out = docs.select("doc_id", "node", F.col("n").alias("n_shingles")).join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node")


class _Bits:
    """A broadcast bit set of fixed size, read by index."""

    def __init__(self, packed: object):
        self.packed = packed

    @property
    def value(self) -> _Bits:
        return self

    def __getitem__(self, i: int) -> bool:
        return bool(self.packed.value[i >> 3] >> (7 - (i & 7)) & 1)


def one_of_each(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents without those whose component holds a smaller id.

    Of rows with the same id and the same text one stays; other rows with the same id are told apart by their text. Rows without an id stay.
    """
    found = _linked(spark, documents)
    per_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("doc_id") != F.col("component_id"), 1)).alias("repeats"))
    known = common.stage(per_id.where("rows > 1 or repeats > 0"), "repeats")
    all_gone = known.where("repeats = rows").select(F.col("doc_id").alias("__repeat"))
    kept = documents.join(all_gone, F.col("doc_id").cast("long") == F.col("__repeat"), "left_anti")
    if not known.where("rows > 1").limit(1).count():
        return kept
    mixed = known.where("repeats > 0 and repeats < rows").select("doc_id")
    if mixed.limit(1).count():  # ids of which some rows are repeats: their rows are told apart by their sets
        gone = found.join(mixed, "doc_id", "left_semi").where("doc_id <> component_id").select(F.col("doc_id").alias("__repeat"), F.col("node").alias("__node")).distinct()
        names = kept.withColumn("__id", F.col("doc_id").cast("long"))
        some = names.join(mixed.select(F.col("doc_id").alias("__id")), "__id", "left_semi")
        texts = some.select("__id", F.col("text").alias("__text")).distinct()
        node = common.texts(texts.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text")), "doc_id").mapInArrow(_nodes, "doc_id long, text string, node long")
        bad = node.join(gone, (F.col("doc_id") == F.col("__repeat")) & (F.col("node") == F.col("__node"))).select(F.col("doc_id").alias("__bad"), F.col("text").alias("__text"))
        kept = kept.join(bad, (F.col("doc_id").cast("long") == F.col("__bad")) & (F.col("text").cast("string") == F.col("__text")), "left_anti")
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
