"""Operator 4: benchmark decontamination by latent semantic retrieval.

Texts become runs of word columns: a word of the benchmark has its column, any other word none. Inverse passage frequencies
are counted over all passages of all documents (runs of ``WINDOW`` words, one every ``STRIDE``). The TF-IDF matrix of the benchmark's passages and of
those of all documents that lie side by side (so that every word counts, once), each of length 1, gives a latent space of ``RANK`` dimensions by a distributed randomised SVD: tasks
multiply their passages with a random sketch and add the products up by word, once for a basis and once more for the singular vectors in
it; blocks of the sums are added in executors. Every passage that can hold a leak (by the bound below) is projected, and its cosine with each
benchmark passage in that space gives candidates (``COSINE``). A candidate is checked on the words around it: the longest common subsequence with the
whole item (bit-parallel), within a stretch of bounded length. ``VERBATIM`` of the item's words in order is a leak; from
``PARAPHRASE`` on it is one if the item's answer (its last sentence) is found there in order, too. What the latent search finds may also have been
put in another order: a candidate is a leak (``reordered``), too, if some stretch as long as the item holds ``VERBATIM`` of its words in whatever order.

What a space of few dimensions blurs is made up for by an exact bound (``_near``): of an item of L words of which m must match, all but
L - m + k rarest may be missing only if k of these are near the passage, whatever their order. Candidates out of that bound can't pass either check and
are not tried; pairs within it that are no candidates are checked for words in order all the same, so that no such leak is lost. ``retrieved`` tells
which leaks the latent search gave; reordered ones come from it alone.

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text (a longer item is one by itself), so what is broadcast doesn't grow with the number of
items. Documents are never dropped, cut or sampled.

Defined cases: a null or empty text has no passages. Items without words leak nowhere; an item with fewer words than a window is one
passage. Repeated documents or items are reported each. Equal leaks in one document give the first place. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import common, vectors, words

WINDOW, STRIDE = 48, 24
BLOCK_BYTES, RANK, OVERSAMPLE = 1 << 19, 64, 8
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.5, 0.8, 0.55, 0.6
CHUNK, SUMS, TASK_PASSAGES = 1024, 32, 100_000  # passages multiplied at once; blocks of a sum; passages a task sums up at least
RUN = 8
LEAK = "doc_id long, item_id long, start_word long, matched long, item_words long, cosine double, verbatim boolean, retrieved boolean, reordered boolean"


@dataclass
class Items:
    """One block of the benchmark: its vocabulary (sorted word hashes) and its items as columns."""

    vocabulary: np.ndarray
    ids: list[int]
    columns: list[np.ndarray]
    answers: list[np.ndarray]


def _hashes(texts: list[str]) -> list[np.ndarray]:
    column = pa.array(texts, pa.string())
    h, bounds = words.word_hashes(*words.string_parts(column), words.PUNCT)
    return [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def read_items(rows: list) -> Items:
    """From (item_id, text) rows; items without words are left out."""
    found = [(r["item_id"], h, r["text"]) for r, h in zip(rows, _hashes([r["text"] or "" for r in rows]), strict=True) if len(h)]
    vocabulary = np.unique(np.concatenate([h for _, h, _ in found])) if found else np.zeros(0, np.uint64)
    last = [[s for s in re.split(r"[.!?\n]+", t) if re.search(r"\w", s)][-1:] or [t] for _, _, t in found]
    answers = _hashes([s[0] for s in last]) if found else []
    return Items(vocabulary, [i for i, _, _ in found], [np.searchsorted(vocabulary, h) for _, h, _ in found], [np.searchsorted(vocabulary, a) for a in answers])


def _columns_of(h: np.ndarray, vocabulary: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Column of each word, or -1; ``table`` maps leading hash bits to whether any vocabulary word has them."""
    out = np.full(len(h), -1, np.int32)
    may = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, h[may]), len(vocabulary) - 1)
    hit = vocabulary[at] == h[may]
    out[may[hit]] = at[hit]
    return out


def _to_columns(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 20, bool)
        table[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch, raw, offs in words.groups(batches):
            h, bounds = words.word_hashes(raw, offs, words.PUNCT)
            columns = _columns_of(h, vocabulary, table)
            data = [columns[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "columns"])

    return run


def _starts(n: int) -> np.ndarray:
    """First words of the passages of a text of ``n`` words; the last passage reaches the end."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    return np.minimum(starts, n - WINDOW)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of documents: ids, their columns, all columns in a row, and start and end of every passage in it."""
    for batch in batches:
        docs, data = batch.column("doc_id").to_pylist(), [np.frombuffer(x, np.int32) for x in batch.column("columns").to_pylist()]
        at = 0
        while at < len(docs):
            to, size = at, 0
            while to < len(docs) and (to == at or size + len(data[to]) <= 1 << 20):
                size += len(data[to])
                to += 1
            part = data[at:to]
            base = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            starts = [_starts(len(x)) for x in part]
            owner = np.repeat(np.arange(len(part)), [len(s) for s in starts])
            start = np.concatenate(starts) + base[owner] if len(owner) else np.zeros(0, np.int64)
            end = np.minimum(start + WINDOW, base[owner + 1]) if len(owner) else start
            yield docs[at:to], part, np.concatenate(part), start, np.stack([end, owner])
            at = to


def _frequencies(width: int):
    """Index arrays: each benchmark word once a passage, and ``width`` once a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, flat, start, (end, _) in _passages(batches):
            known = np.flatnonzero(flat >= 0)
            lo, hi = np.searchsorted(known, start), np.searchsorted(known, end)
            counts = hi - lo
            take = known[np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
            key = np.unique(np.repeat(np.arange(len(start)), counts) * width + flat[take])
            yield key % width
            yield np.full(len(start), width, np.int64)

    return run


def _windows(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The word columns of each passage, -1 beyond its end."""
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], flat[np.minimum(at, len(flat) - 1)], -1)


def _benchmark_windows(items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The benchmark's passages, and the item of each (ascending)."""
    out, item_of = [], []
    for i, columns in enumerate(items.columns):
        starts = _starts(len(columns))
        out.append(_windows(columns, starts, np.minimum(starts + WINDOW, len(columns))))
        item_of += [i] * len(starts)
    return np.concatenate(out), np.array(item_of)


def _with_none(table: np.ndarray) -> np.ndarray:
    """The table with a row of zeros at its end, which is that of a word without a column (-1)."""
    return np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


def _sums(windows: np.ndarray, weighted: np.ndarray, square: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A right) of these passages to ``total`` but for the last weighting: ``weighted`` is idf * right, ``square`` idf * idf."""
    for at in range(0, len(windows), CHUNK):
        some = windows[at : at + CHUNK]
        length = square[some].sum(axis=1)
        product = weighted[some].sum(axis=1) / np.maximum(length, 1e-9)[:, None]
        word = some.ravel()
        order = np.argsort(word, kind="stable")
        word = word[order]
        edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total[word[edges]] += np.add.reduceat(product[order // WINDOW], edges, axis=0)


def _apart(start: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Every other passage of each document, and its last: those that together hold each word, the fewest of them twice."""
    place = np.arange(len(start)) - np.searchsorted(owner, owner)
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
    return (place % (WINDOW // STRIDE) == 0) | last


def _sketch(spark: SparkSession, columns: DataFrame, own: np.ndarray, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'(A right) over the passages of all documents that lie side by side and those of the benchmark (``own``)."""
    width, rank = right.shape
    rows = -(-width // SUMS)
    shared = spark.sparkContext.broadcast((_with_none(idf[:, None] * right), np.append(idf * idf, 0.0).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, square = shared.value
        total = np.zeros((width + 1, rank), np.float32)
        for _, _, flat, start, (end, owner) in _passages(batches):
            apart = _apart(start, owner)
            start, end = start[apart], end[apart]
            for at in range(0, len(start), CHUNK):
                _sums(_windows(flat, start[at : at + CHUNK], end[at : at + CHUNK]), weighted, square, total)
        parts = [total[:width][k * rows : (k + 1) * rows].tobytes() for k in range(SUMS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SUMS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in pdf["part"]], axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"block": [key[0]], "part": [total.tobytes()]})

    kind = "block int, part binary"
    # first those of a few tasks each, so that no group holds the parts of all tasks
    some = columns.mapInArrow(run, kind).withColumn("few", F.spark_partition_id() % 64)
    once = some.groupBy("block", "few").applyInPandas(add, kind)
    total = np.zeros((width + 1, rank))
    for r in once.groupBy("block").applyInPandas(add, kind).toLocalIterator():  # SUMS rows, which together are one matrix
        part = np.frombuffer(r["part"], np.float32).reshape(-1, rank)
        total[r["block"] * rows : r["block"] * rows + len(part)] += part
    _sums(own, *shared.value, total)
    shared.unpersist()
    return idf[:, None] * total[:width]


def _latent(spark: SparkSession, columns: DataFrame, own: np.ndarray, idf: np.ndarray, passages: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages, by a randomised SVD; words x dimensions."""
    width = len(idf)
    rank = min(RANK, width)
    few = columns.coalesce(max(2 * spark.sparkContext.defaultParallelism, passages // TASK_PASSAGES))
    sketch = np.random.default_rng(seed).normal(size=(width, min(rank + OVERSAMPLE, width)))
    sketch = np.linalg.qr(_sketch(spark, few, own, idf, sketch))[0]
    small = sketch.T @ _sketch(spark, few, own, idf, sketch)
    values, vectors_ = np.linalg.eigh((small + small.T) / 2)
    return sketch @ vectors_[:, np.argsort(-values)[:rank]]


def _projected(windows: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The passages in the latent space, each of length 1 (or 0)."""
    out = space[windows].sum(axis=1)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)[:, None]


def _places(a: np.ndarray) -> dict[int, int]:
    """For each word, the bits of its places in ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    return places


def _matched(n: int, places: dict[int, int], b: np.ndarray) -> int:
    full = (1 << n) - 1
    row = full
    for x in b.tolist():
        match = places.get(x, 0)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    return _matched(len(a), _places(a), b)


def gathered(a: np.ndarray, b: np.ndarray) -> int:
    """Most words of ``a``, each as often as there at most and in any order, in a stretch of ``b`` as long as ``a``."""
    n, found, most = len(a), 0, 0
    missing = Counter(a.tolist())
    b = b.tolist()
    for k, x in enumerate(b):
        if x in missing:
            found += missing[x] > 0
            missing[x] -= 1
        if k >= n and (gone := b[k - n]) in missing:
            missing[gone] += 1
            found -= missing[gone] > 0
        most = max(most, found)
    return most


def _held(columns: np.ndarray, b: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Which words of ``b`` are among ``columns``; ``none`` has a False for each word and for -1, and is left so."""
    none[columns] = True
    held = none[b]
    none[columns] = False
    return held


def _can_gather(n: int, held: np.ndarray) -> bool:
    """Whether enough of the item's words for ``gathered``, counted with repeats, lie in a stretch of ``n``."""
    count = np.concatenate([[0], np.cumsum(held)])
    return (count[-1] if len(held) <= n else (count[n:] - count[:-n]).max()) / n >= VERBATIM


@dataclass
class Rare:
    """The rarest words of each item: ``items`` has those of word c from ``first[c]`` to ``first[c + 1]``. ``needed`` of them, and ``least`` of all words (in order or not), are in any leak."""

    first: np.ndarray
    items: np.ndarray
    needed: np.ndarray
    least: np.ndarray
    sizes: np.ndarray


def _rare(items: Items, counted: np.ndarray) -> Rare:
    sizes = np.array([len(c) for c in items.columns])
    least = np.array([next(m for m in range(n + 1) if m / n >= PARAPHRASE) for n in sizes])  # the check's own comparison
    needed = np.maximum(1, least // 2)
    words_, owners = [], []
    for i, c in enumerate(items.columns):
        own = np.unique(c[np.argsort(counted[c], kind="stable")[: sizes[i] - least[i] + needed[i]]])
        words_.append(own)
        owners.append(np.full(len(own), i))
    word, owner = np.concatenate(words_), np.concatenate(owners)
    order = np.argsort(word, kind="stable")
    return Rare(np.searchsorted(word[order], np.arange(len(items.vocabulary) + 1)), owner[order], needed, least, sizes)


def _near(rare: Rare, flat: np.ndarray, base: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (passage, item) whose words around the passage can hold as many of the item's as a leak must; sorted by document, item and passage.

    A match pairs each matched word of the item with a word of the text of its own. At most as many of an item's words as are
    not among its rarest are matched outside these, so ``needed`` words of the text are among the rarest.
    """
    known = np.flatnonzero(flat >= 0)
    n = rare.first[flat[known] + 1] - rare.first[flat[known]]
    at = np.repeat(known, n)
    item = rare.items[np.repeat(rare.first[flat[known]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    owner = np.searchsorted(base, at, side="right") - 1
    order = np.argsort(owner * len(rare.sizes) + item, kind="stable")
    at, item, owner = at[order], item[order], owner[order]
    from_ = np.arange(len(at))
    to = from_ + rare.needed[item] - 1
    inside = to < len(at)
    from_, to = from_[inside], to[inside]
    same = (item[from_] == item[to]) & (owner[from_] == owner[to]) & (at[to] - at[from_] < WINDOW + 2 * rare.sizes[item[from_]])
    from_, to = from_[same], to[same]
    item, owner, size = item[from_], owner[from_], rare.sizes[item[from_]]
    # passages around which both the first and the last of these words lie
    lo = np.searchsorted(start, np.maximum(at[to] - WINDOW - size + 1, base[owner]))
    hi = np.searchsorted(start, np.minimum(at[from_] + size, base[owner + 1] - 1), side="right")
    # ranges of one document and item ascend: each begins where the one before it has ended
    new = np.ones(len(lo), bool)
    new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
    if len(lo):
        lo = np.maximum(lo, np.where(new, 0, np.concatenate([[0], hi[:-1]])))
    n = np.maximum(hi - lo, 0)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(item, n)


def _search(shared: object):
    """Latent cosines of all passages, then the check of each (document, item) on the words around its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, space, latent, item_of, rare = shared.value
        places, answers = [_places(c) for c in items.columns], [_places(a) for a in items.answers]
        first = np.flatnonzero(np.concatenate([[True], np.diff(item_of) > 0]))
        none = np.zeros(len(space), bool)
        for docs, part, flat, start, (end, owner) in _passages(batches):
            if not len(start):
                continue
            base = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            passages, found = _near(rare, flat, base, start)
            cosine = np.zeros(len(passages), np.float32)
            order = np.argsort(passages, kind="stable")
            tried = np.unique(passages)
            for at in range(0, len(tried), CHUNK):
                some = tried[at : at + CHUNK]
                product = _projected(_windows(flat, start[some], end[some]), space) @ latent.T
                best_of = np.maximum.reduceat(product, first, axis=1)
                mine = order[slice(*np.searchsorted(passages, (some[0], some[-1] + 1), sorter=order))]
                cosine[mine] = best_of[np.searchsorted(some, passages[mine]), found[mine]]
            # pairs in runs of neighbours; what isn't in the words around a run isn't around any passage of it
            apart = (np.diff(passages) != 1) | (np.diff(found) != 0) | (np.diff(owner[passages]) != 0)
            run_no = np.cumsum(np.concatenate([[0], apart])) if len(passages) else passages
            run_no = run_no * (len(passages) + 1) + (np.arange(len(passages)) - np.searchsorted(run_no, run_no)) // RUN
            edges = np.flatnonzero(np.concatenate([[True], run_no[1:] != run_no[:-1], [True]])) if len(passages) else np.zeros(1, np.int64)
            candidates = np.maximum.reduceat(cosine, edges[:-1]) >= COSINE if len(passages) else []
            close: set[tuple[int, int]] = set()
            for a, b, candidate in zip(edges[:-1].tolist(), edges[1:].tolist(), candidates, strict=True):
                i, o = int(found[a]), int(owner[passages[a]])
                n = len(items.columns[i])
                around = part[o][max(0, start[passages[a]] - base[o] - n) : start[passages[b - 1]] - base[o] + WINDOW + n]
                held = _held(items.columns[i], around, none)
                n_held = np.count_nonzero(held)
                if n_held < rare.least[i]:
                    continue
                any_order = candidate and n_held / n >= VERBATIM and _can_gather(n, held)
                if _matched(n, places[i], around[held]) >= rare.least[i] or (any_order and gathered(items.columns[i], around) / n >= VERBATIM):
                    close.update((p, i) for p in passages[a:b].tolist())
            scores = {pair: float(x) for *pair_, x in zip(passages.tolist(), found.tolist(), cosine, strict=True) if (pair := tuple(pair_)) in close}
            best: dict[tuple[int, int], tuple] = {}
            retrieved: set[tuple[int, int]] = set()
            for (p, i), score in sorted(scores.items()):
                o, n = int(owner[p]), len(items.columns[i])
                lo = int(max(0, start[p] - base[o] - n))
                near = part[o][lo : start[p] - base[o] + WINDOW + n]
                matched = _matched(n, places[i], near)
                verbatim = matched / n >= VERBATIM
                ordered = matched >= rare.least[i] and (verbatim or _matched(len(items.answers[i]), answers[i], near) >= ANSWER * len(items.answers[i]))
                if not ordered and (score < COSINE or gathered(items.columns[i], near) / n < VERBATIM):
                    continue
                if score >= COSINE:
                    retrieved.add((o, i))
                if (o, i) not in best or (ordered, matched, score) > best[o, i][:3]:
                    best[o, i] = (ordered, matched, score, lo, n, verbatim)
            out = [(docs[o], items.ids[i], lo, matched, n, score, verbatim, (o, i) in retrieved, not ordered) for (o, i), (ordered, matched, score, lo, n, verbatim) in best.items()]
            if out:
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in LEAK.split(", ")])

    return run


def _search_block(spark: SparkSession, rows: DataFrame, items: Items) -> DataFrame:
    width = len(items.vocabulary)
    columns = common.stage(rows.mapInArrow(_to_columns(items.vocabulary), "doc_id long, columns binary"), "columns")
    counted = vectors.summed(columns, _frequencies(width), width + 1)
    n = int(counted[width])
    idf = np.log((n + 2) / (counted[:width] + 1))  # of every word, however frequent, more than 0
    own, item_of = _benchmark_windows(items)
    space = _with_none(idf[:, None] * _latent(spark, columns, own, idf, n))
    latent = np.concatenate([_projected(own[at : at + CHUNK], space) for at in range(0, len(own), CHUNK)])
    shared = spark.sparkContext.broadcast((items, space, latent, item_of, _rare(items, counted)))
    common.give_back()
    return columns.mapInArrow(_search(shared), LEAK)


def leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, start_word, matched, item_words, cosine, verbatim, retrieved, reordered."""
    common.short_batches(spark)
    rows = common.texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = spark.createDataFrame([], LEAK)
    for k in range(blocks):
        block = read_items(sorted(placed.where(F.col("block") == k).collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or "")))  # about BLOCK_BYTES
        if len(block.vocabulary):
            found = found.unionByName(_search_block(spark, rows, block))
    return found


def remove(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those in which an item was found; null ids are kept."""
    return documents.join(leaks(spark, documents, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)
