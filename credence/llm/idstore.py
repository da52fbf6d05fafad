"""Operator 10: a content-addressed store of token ids.

Each document's ids (a public vocabulary, then one end id) are cut into chunks where a
rolling hash over the last ids says so, between a least and a greatest length. A chunk is
named by the SHA-256 of its bytes and stored once. A recipe lists a document's chunks; the
recipes are in ascending document order, range-partitioned. Each document has a Merkle root over
its chunk names, each recipe part a root over its documents, and the manifest one over the parts. Reading computes all of them again
from the recipes and chunks read back; a missing, added or swapped chunk, recipe row, document or part is an error, as is a root that differs.
Roots cover chunk names and the order of documents, not the documents' ids.

Defined cases: a null text is the empty text, whose only id is the end id. Documents with the same
``doc_id`` are kept apart, in the order of the input's rows. A null ``doc_id`` comes first. An empty
table gives an empty store. Columns besides ``doc_id`` and ``text`` are ignored.

A lost executor costs a recomputation of its tasks only: every intermediate is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import bpe, common, words

END_ID = 2
LEAST, MOST, MEAN_BITS, WINDOW = 64, 4096, 9, 16
CHUNK = "doc_id long, rid long, seq long, n long, digest binary, payload binary"


@dataclass
class IdStore:
    """``chunks``: digest, n, payload. ``recipes``: part, doc_id, rid, seq, n, digest. ``manifest``: part, documents, ids, root."""

    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    root: str


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is. No leaves: the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last ``WINDOW`` ids asks for a cut."""
    rolled = words.mix(ids.astype(np.uint64) + np.uint64(1))
    width, base = 1, int(words._BASE)
    while width < WINDOW:
        power = np.uint64(pow(base, width, 1 << 64))
        moved = rolled.copy()
        moved[width:] += rolled[:-width] * power
        rolled, width = moved, width * 2
    return np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + 1


def cuts(wanted: list[int], at: int, end: int) -> list[int]:
    """Ends of the chunks of the ids from ``at`` to ``end``; ``wanted`` has the ascending marks among them.

    No chunk but a document's last is shorter than ``LEAST``, which is more than ``WINDOW``, so the ids
    before ``at`` in the same array have no part in the result.
    """
    out, i = [], 0
    while end - at > LEAST:
        while i < len(wanted) and wanted[i] - at < LEAST:
            i += 1
        at = min(wanted[i] if i < len(wanted) else end, at + MOST, end)
        out.append(at)
    if not out or out[-1] < end:
        out.append(end)
    return out


def _pack(ids: np.ndarray) -> bytes:
    """The file format of a chunk: one byte for the width of an id, then the ids, little-endian."""
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) and int(ids.max()) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[:1] == b"\2" else "<u4", offset=1).astype("<u4")


def _cut_documents(path: str | None, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path or bpe.default_vocabulary()).encode
        end = struct.pack("<I", end_id)
        seen: set[bytes] = set()
        for batch, _, _ in words.groups(batches):
            rows: list[tuple] = []
            streams = [raw + end for raw in encode(batch.column("text").to_pylist())]
            ids = np.frombuffer(b"".join(streams), "<u4")
            wanted, at = marks(ids), 0
            for doc, rid, stream in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), streams, strict=True):
                to = at + len(stream) // 4
                lo, hi = np.searchsorted(wanted, (at, to), side="right")
                for seq, cut in enumerate(cuts(wanted[lo:hi].tolist(), at, to)):
                    payload = _pack(ids[at:cut])
                    digest = hashlib.sha256(payload).digest()
                    rows.append((doc, rid, seq, cut - at, digest, None if digest in seen else payload))
                    if len(seen) < 1_000_000:  # later repeats are only sent once more
                        seen.add(digest)
                    at = cut
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, the first of each digest."""
    last = None
    for batch in batches:
        keep = []
        for d in batch.column("digest").to_pylist():
            keep.append(d != last)
            last = d
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crc32 of each stored chunk as 32-bit ids; a payload that doesn't match its name is an error."""
    for batch in batches:
        digests, crcs, counts = batch.column("digest").to_pylist(), [], []
        for digest, payload in zip(digests, batch.column("payload").to_pylist(), strict=True):
            if hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            ids = unpack(payload)
            crcs.append(zlib.crc32(ids.tobytes()))
            counts.append(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], names=["digest", "chunk_crc", "chunk_n"])


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


_shift_cache: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes modulo the CRC-32 polynomial."""
    if n_bytes not in _shift_cache:
        out, square, n = 1 << 31, 1 << 30, 8 * n_bytes
        while n:
            if n & 1:
                out = _times(square, out)
            square, n = _times(square, square), n >> 1
        _shift_cache[n_bytes] = out
    return _shift_cache[n_bytes]


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from (crc32, bytes) of its pieces."""
    crc = 0
    for c, n in pieces:
        crc = _times(_shift(n), crc) ^ c
    return crc


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle([d["digest"] for d in row]) for row in batch.column("list").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "rid", "ids")), pa.array(roots, pa.binary())], names=["part", "doc_id", "rid", "ids", "root"])


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and document: one root a part."""
    part, leaves, ids = None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for p, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "ids", "root")), strict=True):
            if p != part and leaves:
                out.append((part, len(leaves), ids, merkle(leaves)))
                leaves, ids = [], 0
            part = p
            leaves.append(root)
            ids += n
    if leaves:
        out.append((part, len(leaves), ids, merkle(leaves)))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["part", "documents", "ids", "root"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crc32 and root of each document; a chunk that is missing, repeated or of another length than its recipe's is an error."""
    for batch in batches:
        crcs, roots = [], []
        lists = batch.column("list")
        at, flat = 0, lists.flatten()
        seq, n, digest, crc, chunk_n = (flat.field(c).to_pylist() for c in ("seq", "n", "digest", "chunk_crc", "chunk_n"))
        for size in lists.value_lengths().to_pylist():
            to = at + size
            if seq[at:to] != list(range(size)):
                raise ValueError("a recipe's chunks are not numbered one by one")
            if None in crc[at:to]:
                raise ValueError(f"chunk {digest[at + crc[at:to].index(None)].hex()} is missing")
            if n[at:to] != chunk_n[at:to]:
                raise ValueError("a chunk's length is not its recipe's")
            crcs.append(joined_crc([(c, 4 * k) for c, k in zip(crc[at:to], n[at:to], strict=True)]))
            roots.append(merkle(digest[at:to]))
            at = to
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "rid", "ids")), pa.array(crcs, pa.int64()), pa.array(roots, pa.binary())], names=["part", "doc_id", "rid", "n_tokens", "ids_crc32", "root"])


def _placed(manifest: dict[int, tuple[int, int, int, bytes]]):
    """Rows sorted by part and document, with one row without a root for each part of the manifest: starts, and each part against its entry.

    ``manifest``: ids before the part, documents, ids, root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves, ids = None, [], 0

        def check() -> None:
            if part is not None and (part not in manifest or manifest[part][1:] != (len(leaves), ids, merkle(leaves))):
                raise ValueError(f"part {part} is not what the manifest's root says")

        for batch in batches:
            starts, keep = [], []
            for p, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                if p != part:
                    check()
                    part, leaves, ids = p, [], 0
                keep.append(root is not None)
                starts.append(manifest[p][0] + ids if p in manifest else None)
                if root is not None:
                    leaves.append(root)
                    ids += n
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), *(batch.column(c) for c in ("n_tokens", "ids_crc32", "part"))], names=["doc_id", "start", "n_tokens", "ids_crc32", "part"])
            yield out.filter(pa.array(keep, pa.bool_()))
        check()

    return run


def write_store(spark: SparkSession, documents: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> IdStore:
    """Encode, cut and write the store into the shared folder."""
    common.short_batches(spark)
    rows = common.texts(documents.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "doc_id", "rid")
    cut = common.stage(rows.mapInArrow(_cut_documents(vocabulary, end_id), CHUNK), "ids-cut")
    n = common.tasks(spark)
    first = cut.where("payload is not null").select("digest", "n", "payload").repartition(n, "digest").sortWithinPartitions("digest")
    chunks = common.stage(first.mapInArrow(_first_of_each, "digest binary, n long, payload binary"), "ids-chunks")
    ordered = cut.drop("payload").repartitionByRange(n, "doc_id", "rid").sortWithinPartitions("doc_id", "rid", "seq")
    recipes = common.stage(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "rid", "seq", "n", "digest"), "ids-recipes")
    common.drop(cut)
    listed = recipes.groupBy("part", "doc_id", "rid").agg(F.sum("n").alias("ids"), F.sort_array(F.collect_list(F.struct("seq", "digest"))).alias("list"))
    roots = listed.mapInArrow(_roots, "part int, doc_id long, rid long, ids long, root binary")
    per_part = roots.repartition(n, "part").sortWithinPartitions("part", "doc_id", "rid").mapInArrow(_part_roots, "part int, documents long, ids long, root binary")
    manifest = common.stage(per_part, "ids-manifest")
    parts = manifest.select("part", "root").orderBy("part").collect()  # one row a part
    return IdStore(chunks, recipes, manifest, merkle([bytes(r["root"]) for r in parts]).hex())


def read_store(store: IdStore) -> DataFrame:
    """Every document back from the files: doc_id, start, n_tokens, ids_crc32, part. Reading all of it fails unless every root is the stored one."""
    spark = store.chunks.sparkSession
    before, manifest = 0, {}
    for r in store.manifest.select("part", "documents", "ids", "root").orderBy("part").collect():  # one row a part
        manifest[r["part"]] = (before, r["documents"], r["ids"], bytes(r["root"]))
        before += r["ids"]
    if merkle([root for *_, root in manifest.values()]).hex() != store.root:
        raise ValueError("the manifest is not what the store's root says")
    checked = store.chunks.select("digest", "payload").mapInArrow(_verify, "digest binary, chunk_crc long, chunk_n long")
    listed = store.recipes.join(checked, "digest", "left").groupBy("part", "doc_id", "rid").agg(F.sum("n").alias("ids"), F.sort_array(F.collect_list(F.struct("seq", "n", "digest", "chunk_crc", "chunk_n"))).alias("list"))
    kinds = "part int, doc_id long, rid long, n_tokens long, ids_crc32 long, root binary"
    marks_ = spark.createDataFrame([(p, None, -1, 0, None, None) for p in manifest], kinds)  # so that a part without any row is missed
    back = listed.mapInArrow(_joined, kinds).unionByName(marks_).repartition(common.tasks(spark), "part").sortWithinPartitions("part", "doc_id", "rid")
    return back.mapInArrow(_placed(manifest), "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's ids from its chunks in order; a missing, damaged, repeated or wrongly long chunk is an error."""
    for batch in batches:
        streams = []
        for row in batch.column("list").to_pylist():
            if [c["seq"] for c in row] != list(range(len(row))):
                raise ValueError("a recipe's chunks are not numbered one by one")
            pieces = []
            for c in row:
                if c["payload"] is None:
                    raise ValueError(f"chunk {c['digest'].hex()} is missing")
                if hashlib.sha256(c["payload"]).digest() != c["digest"]:
                    raise ValueError(f"chunk {c['digest'].hex()} is damaged")
                pieces.append(unpack(c["payload"]))
                if len(pieces[-1]) != c["n"]:
                    raise ValueError("a chunk's length is not its recipe's")
            streams.append(np.concatenate(pieces).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rid"), pa.array([len(x) // 4 for x in streams], pa.int64()), pa.array(streams, pa.binary())],
            names=["doc_id", "rid", "n_tokens", "ids"],
        )


def read_ids(store: IdStore) -> DataFrame:
    """Every document's ids themselves (little-endian, 32 bits), rebuilt from its recipe: doc_id, rid (its input row), n_tokens, ids.

    A chunk moves once for each place that holds it. ``read_store`` gives counts and checksums without that, and checks the Merkle roots.
    """
    common.short_batches(store.chunks.sparkSession)
    placed = store.recipes.join(store.chunks.select("digest", "payload"), "digest", "left")
    listed = placed.groupBy("part", "doc_id", "rid").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "digest", "payload"))).alias("list"))
    return listed.mapInArrow(_rebuilt, "doc_id long, rid long, n_tokens long, ids binary")
