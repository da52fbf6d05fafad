"""Operator 3: a quality classifier by co-training.

Two views of a document: its text content (presence of hashed words and word beginnings) and its page metadata (source, language, length and layout
statistics in bins). A classifier is fitted on each from the labelled rows, then for some rounds each hands its most confident
pseudo-labels on unlabelled documents to the other, in the proportion of the labels: only of a class, and only from a score on, for which it
was right on ``PRECISE`` of labelled rows that training left out. A hand-over that makes the combination's loss on those rows greater is taken back.
The views are calibrated on other labelled rows, and a logistic combination fitted on yet others of the two calibrated views scores every whole document.

Training runs in one executor task and is bounded: about ``LABELLED`` labelled and ``UNLABELLED`` other documents, chosen by a hash of the id. Word features must
differ between the classes by ``Z`` standard errors to be used, so the model stays small and long clean documents don't add up noise.
Scoring covers every document. A document is good if ``quality`` is 1 and ``toxic`` 0.

Defined cases: a null or empty text has no words and the layout of an empty page. Labels with a null are ignored; conflicting labels
of one id count as bad. Without labels, or with one class only, every score is that class's share (1 without labels). A null id is scored like
any other. Repeated rows get equal scores. An empty table gives no rows. Other columns are ignored; ``lang`` and ``source`` may be null or missing.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import common, words

LABELLED, UNLABELLED = 12_000, 6_000
DIMS, META = 1 << 20, 512
STEM, SEEN, Z, ROUNDS, HANDED = 5, 10, 6.0, 4, 0.05
PARTS = (0.55, 0.2, 0.125, 0.125)  # of the labelled rows: training, choosing pseudo-labels, calibrating, combining
PRECISE, PROVEN = 0.99, 20
KEEP = 0.5
Example = tuple[np.ndarray, np.ndarray]
Labelled = tuple[bool, np.ndarray, np.ndarray]

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[46, 44, 59, 58, 39, 34, 40, 41, 45]] = 6
_CLASS[[33, 63]] = 7
_CLASS[124] = 8
_CLASS[128:] = 9
_LINE = words.byte_map(b"\n")


def _bin(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _features(batch: pa.RecordBatch, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all texts and their bounds; metadata features (documents x features, as indexes below META)."""
    h, bounds = words.word_hashes(raw, offs, words.PUNCT)
    stems, _ = words.word_hashes(raw, offs, words.PUNCT, prefix=STEM)
    dims = np.empty((len(h), 2), np.int64)  # each word, and its first bytes, which its inflected forms share
    dims[:, 0] = h >> np.uint64(44)
    dims[:, 1] = words.mix(stems + np.uint64(STEM)) >> np.uint64(44)
    dims = dims.ravel()
    bounds = 2 * bounds
    n = batch.num_rows
    counts = np.zeros((n, 10))
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        counts[i] = np.bincount(_CLASS[raw[a:b]], minlength=10)
    size = np.maximum(counts.sum(axis=1), 1)
    share = counts / size[:, None]
    n_words = np.diff(bounds) // 2
    lines, line_bounds = words.word_hashes(raw, offs, _LINE)
    n_lines = np.diff(line_bounds)
    repeated = np.array([1 - len(np.unique(lines[a:b])) / max(1, b - a) for a, b in zip(line_bounds[:-1], line_bounds[1:], strict=True)])
    variety = np.array([len(np.unique(dims[a:b:2])) / max(1, (b - a) // 2) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    fine = [0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6]
    stats = [_bin(share[:, k], fine) for k in (0, 2, 3, 5, 6, 7, 8, 9)]
    stats.append(_bin(np.log2(size), list(range(3, 18))))
    stats.append(_bin(size / np.maximum(n_words, 1), [3, 4, 5, 5.5, 6, 6.5, 7, 8, 10, 15]))
    stats.append(_bin(repeated, fine))
    stats.append(_bin(variety, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))
    stats.append(_bin(n_lines, [1, 2, 4, 8, 16, 32, 64]))
    meta = [16 * k + np.minimum(s, 15) for k, s in enumerate(stats)]
    for name, base in (("source", 256), ("lang", 448)):
        values = batch.column(name).to_pylist()
        room = 192 if name == "source" else 64
        meta.append(np.array([base + zlib.crc32(repr(v).encode()) % room for v in values], np.int64))
    return dims, bounds, np.stack(meta, axis=1) if n else np.zeros((0, len(meta)), np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offs in words.groups(batches):
        dims, bounds, meta = _features(batch, raw, offs)
        own = [np.unique(dims[a:b]).astype(np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(own, pa.binary()), pa.array([m.astype(np.uint16).tobytes() for m in meta], pa.binary())], names=["doc_id", "good", "words", "meta"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class View:
    """A logistic regression over sparse sets of features, trained by gradient steps with a ridge."""

    def __init__(self, size: int):
        self.weights, self.bias, self.scale, self.shift = np.zeros(size), 0.0, 1.0, 0.0

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[s].sum() for s in sets]) + self.bias if sets else np.zeros(0)

    def fit(self, sets: list[np.ndarray], good: np.ndarray, used: np.ndarray | None, steps: int = 300, ridge: float = 1e-4) -> None:
        size = len(self.weights)
        if used is not None:
            place = np.full(size, -1, np.int64)
            place[used] = np.arange(len(used))
            sets = [p[p >= 0] for p in (place[s] for s in sets)]
            size = len(used)
        n = len(sets)
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        column = np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64)
        w, b = np.zeros(size), float(np.log((good.sum() + 1) / (n - good.sum() + 1)))
        heat, heat_b = np.full(size, 1e-8), 1e-8
        for _ in range(steps):  # full-batch steps with a rate for each weight
            p = _sigmoid(np.bincount(row, weights=w[column], minlength=n) + b)
            gap = (p - good) / n
            slope = np.bincount(column, weights=gap[row], minlength=size) + ridge * w / max(1, size) ** 0.5
            heat += slope * slope
            heat_b += gap.sum() ** 2
            w -= 0.5 * slope / np.sqrt(heat)
            b -= 0.2 * gap.sum() / np.sqrt(heat_b)
        self.bias = b
        self.weights[:] = 0
        if used is not None:
            self.weights[used] = w
        else:
            self.weights[:] = w

    def calibrate(self, sets: list[np.ndarray], good: np.ndarray) -> None:
        """A logistic curve over the raw score, on rows that training left out."""
        self.scale, self.shift = _logistic(self.raw(sets)[:, None], good)[[0, -1]]
        self.scale = max(self.scale, 1e-3)

    def logit(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.raw(sets) * self.scale + self.shift


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a small logistic regression; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + ridge * w), -2, 2)
    return w


def _telling(sets: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Word features of at least ``SEEN`` documents whose rate differs between the classes by ``Z`` standard errors."""
    counts = np.zeros((2, DIMS), np.int64)
    for own, g in zip(sets, good, strict=True):
        counts[int(g), own] += 1  # a set holds each feature once
    in_bad, in_good = counts
    n_good, n_bad = max(1, good.sum()), max(1, (~good).sum())
    pooled = (in_good + in_bad) / (n_good + n_bad)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_good + 1 / n_bad))
    return np.flatnonzero((in_good + in_bad >= SEEN) & (np.abs(in_bad / n_bad - in_good / n_good) >= Z * error))


def _both(text_logit: np.ndarray, meta_logit: np.ndarray) -> np.ndarray:
    """What the combination sees: both calibrated views and the worse of them."""
    return np.stack([text_logit, meta_logit, np.minimum(text_logit, meta_logit)], axis=1)


@dataclass
class Model:
    text: View | None
    meta: View | None
    mix: np.ndarray
    constant: float
    handed: int = 0  # pseudo-labels that were exchanged and kept

    def score(self, text_logit: np.ndarray, meta_logit: np.ndarray) -> np.ndarray:
        return _sigmoid(_both(text_logit, meta_logit) @ self.mix[:-1] + self.mix[-1])


def _splits(good: np.ndarray, seed: int) -> list[np.ndarray]:
    """Row numbers for training, for choosing pseudo-labels, for calibrating and for combining; a part that lacks a class is all rows."""
    order = np.random.default_rng(seed).permutation(len(good))
    ends = np.round(np.cumsum(PARTS) * len(good)).astype(int)
    parts = [np.sort(x) for x in np.split(order, ends[:-1])]
    return [x if len({*good[x].tolist()}) == 2 else np.arange(len(good)) for x in parts]


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y, -z, z)))) if len(y) else 0.0


def _sure(scores: np.ndarray, right: np.ndarray) -> float:
    """The least score from which on ``right`` holds for a share of ``PRECISE`` of the chosen rows, of which there are ``PROVEN`` at least."""
    order = np.argsort(-scores, kind="stable")
    n = np.arange(1, len(order) + 1)
    fine = np.flatnonzero((np.cumsum(right[order]) >= PRECISE * n) & (n >= PROVEN))
    return float(scores[order[fine[-1]]]) if len(fine) else np.inf


def co_train(labelled: list[Labelled], unlabelled: list[Example], seed: int = 3, rounds: int = ROUNDS) -> Model:
    """From (good, words, metadata) and (words, metadata) examples; ``rounds`` 0 is the same without any exchange."""
    good = np.array([g for g, _, _ in labelled], bool)
    if len(good) < 10 or good.all() or not good.any():
        return Model(None, None, np.zeros(4), float(good.mean()) if len(good) else 1.0)
    train, choose, calibrate, combine = _splits(good, seed)
    sides = ([w for _, w, _ in labelled], [m for _, _, m in labelled])
    pool_sides = ([w for w, _ in unlabelled], [m for _, m in unlabelled])
    pick = lambda sets, rows: [sets[i] for i in rows]
    given: list[dict[int, bool]] = [{}, {}]  # pseudo-labels by pool row, for each view

    def fitted(k: int, extra: dict[int, bool]) -> View:
        view = View((DIMS, META)[k])
        sets = pick(sides[k], train) + pick(pool_sides[k], extra)
        y = np.concatenate([good[train], np.array([*extra.values()], bool)])
        view.fit(sets, y, _telling(sets, y) if k == 0 else None)
        view.calibrate(pick(sides[k], calibrate), good[calibrate])
        return view

    def combined(pair: list[View]) -> tuple[np.ndarray, float]:
        """The combination of two views, and its loss on the rows that choose."""
        x = lambda rows: _both(*(view.logit(pick(sides[k], rows)) for k, view in enumerate(pair)))
        mix = _logistic(x(combine), good[combine])
        return mix, _loss(x(choose) @ mix[:-1] + mix[-1], good[choose])

    views = [fitted(0, {}), fitted(1, {})]
    (mix, best), open_to, handed = combined(views), {0, 1}, 0
    for _ in range(rounds if unlabelled else 0):
        chosen = [view.logit(pick(sides[k], choose)) for k, view in enumerate(views)]
        pool = [view.logit(pool_sides[k]) for k, view in enumerate(views)]
        # a view hands out what it has been right about on rows of known label, for each class by itself
        least = [{True: _sure(chosen[k], good[choose]), False: _sure(-chosen[k], ~good[choose])} for k in (0, 1)]
        room = max(2, int(HANDED * len(unlabelled)))
        for to in sorted(open_to):
            giver, extra = 1 - to, dict(given[to])
            for label, share in ((True, good.mean()), (False, 1 - good.mean())):
                own, other = (pool[giver], pool[to]) if label else (-pool[giver], -pool[to])
                free = [i for i in np.argsort(-own, kind="stable").tolist() if own[i] >= least[giver][label] and -other[i] < least[to][not label] and i not in extra]
                extra.update((i, label) for i in free[: max(1, round(room * share))])
            if len(extra) == len(given[to]):
                continue
            pair = [view if k != to else fitted(to, extra) for k, view in enumerate(views)]
            new, loss = combined(pair)
            if loss > best:  # these pseudo-labels hurt: the view stays as it is, and takes no more
                open_to.discard(to)
                continue
            handed += len(extra) - len(given[to])
            given[to], views, mix, best = extra, pair, new, loss
    return Model(*views, mix, 0.0, handed)


def _score(shared: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(shared.value)
        for batch, raw, offs in words.groups(batches):
            n = batch.num_rows
            if model.text is None:
                t = m = np.zeros(n)
                score = np.full(n, model.constant)
            else:
                dims, bounds, meta = _features(batch, raw, offs)
                telling = np.flatnonzero(model.text.weights[dims])
                owner = np.searchsorted(bounds, telling, side="right") - 1
                pairs = np.unique(owner * DIMS + dims[telling])
                t = (np.bincount(pairs // DIMS, weights=model.text.weights[pairs % DIMS], minlength=n) + model.text.bias) * model.text.scale + model.text.shift
                m = (model.meta.weights[meta].sum(axis=1) + model.meta.bias) * model.meta.scale + model.meta.shift
                score = model.score(t, m)
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("text", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(score), pa.array(_sigmoid(t)), pa.array(_sigmoid(m))], names=[*(batch.schema.names[i] for i in keep), "score", "text_score", "meta_score"])

    return run


def _views(documents: DataFrame) -> DataFrame:
    names = {c.lower() for c in documents.columns}
    given = [F.col(c).cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *given, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def train(documents: DataFrame, labels: DataFrame, seed: int = 3) -> bytes:
    """Fit on a bounded sample of the labelled documents and of others, in an executor; the packed model."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")) == 1).alias("good"))
    share = min(1.0, LABELLED / max(1, known.count()))
    hashed = lambda salt, column: F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1_000_000))
    chosen = F.broadcast(known.where(hashed(seed, "doc_id") < round(share * 1_000_000)))  # about LABELLED rows
    views = _views(documents)
    others = min(1.0, UNLABELLED / max(1, documents.count()))
    mixed = views.join(chosen, "doc_id", "left").where(F.col("good").isNotNull() | (hashed(seed + 1, "doc_id") < round(others * 1_000_000)))
    examples = mixed.mapInArrow(_examples, "doc_id long, good boolean, words binary, meta binary")
    return common.in_one_task(examples, lambda batches: packed(_learned(batches, seed)))


def _learned(batches: list[pa.RecordBatch], seed: int) -> Model:
    """Train on the examples of the sample; equal examples count once, for copies of a document would outweigh the others."""
    rows = []
    for batch in batches:
        for doc, good, own, meta in zip(*(batch.column(c) for c in ("doc_id", "good", "words", "meta")), strict=True):
            own, meta, doc = own.as_buffer(), meta.as_buffer(), doc.as_py()
            named = hashlib.sha256(own).digest()
            rows.append(((doc is None, doc or 0, named, bytes(meta)), good.as_py(), named, np.frombuffer(own, np.int32), np.frombuffer(meta, np.uint16).astype(np.int32)))
    rows.sort(key=lambda r: r[0])
    once = {(good, named): (key, good, own, meta) for key, good, named, own, meta in reversed(rows)}
    rows = sorted(once.values(), key=lambda r: r[0])
    return co_train([r[1:] for r in rows if r[1] is not None], [r[2:] for r in rows if r[1] is None], seed)


def packed(model: Model) -> bytes:
    """The model with only the weights that are not 0."""
    views = [v and (len(v.weights), at := np.flatnonzero(v.weights), v.weights[at], v.bias, v.scale, v.shift) for v in (model.text, model.meta)]
    return pickle.dumps((views, model.mix, model.constant, model.handed))


def unpacked(raw: bytes) -> Model:
    views, mix, constant, handed = pickle.loads(raw)
    out: list[View | None] = []
    for parts in views:
        view = None
        if parts is not None:
            size, at, weights, *rest = parts
            view = View(size)
            view.weights[at] = weights
            view.bias, view.scale, view.shift = rest
        out.append(view)
    return Model(*out, mix, constant, handed)


def score(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (probability of a good document), text_score, meta_score, keep."""
    common.short_batches(spark)
    shared = spark.sparkContext.broadcast(train(documents, labels))
    found = _views(documents).mapInArrow(_score(shared), "doc_id long, score double, text_score double, meta_score double")
    return found.withColumn("keep", F.col("score") >= KEEP)


def keep_good(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; each row is judged by itself."""
    common.short_batches(spark)
    shared = spark.sparkContext.broadcast(train(documents, labels))
    run, names = _score(shared), list(documents.columns)
    place = {c.lower(): i for i, c in enumerate(names)}
    seen = [place.get(c) for c in ("doc_id", "source", "lang", "text")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            none = pa.nulls(batch.num_rows, pa.string())
            views = [none if i is None else batch.column(i) for i in seen]
            views = [views[0].cast(pa.int64()), *(v.cast(pa.string()) for v in views[1:])]
            views[3] = views[3].fill_null("")
            shown = pa.RecordBatch.from_arrays(views, names=["doc_id", "source", "lang", "text"])
            scores = np.concatenate([out.column("score").to_numpy() for out in run(iter([shown]))])
            yield batch.filter(pa.array(scores >= KEEP))

    return documents.mapInArrow(judge, documents.schema)
