"""Operator 8: language identification by averaged hashed subword embeddings and a linear softmax.

The model has an embedding for each of ``BUCKETS`` hashed byte n-grams (2 to 4 bytes, white space one blank, A-Z lower) and a
linear layer over the labels. A text is the mean of its n-grams' embeddings. Both layers are trained by stochastic
gradient descent in numpy, in one executor task, on a bounded sample of labelled rows (about ``TRAIN_ROWS``, chosen by a hash of the row's id, whole
texts reduced to n-gram counts on the executors). Scores are calibrated by a temperature fitted on a part of the
sample that training left out; a prediction below the calibrated threshold is marked ``rejected``.
Prediction covers every whole text. For it, the two layers are multiplied once into one table of bounded size.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Without any labelled row all are ``und``.
Rows with a null label are not learned from. Ties between labels go to the first in sorted order.
Repeated rows are predicted each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import common, words

BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (2, 3, 4)
TRAIN_ROWS, EPOCHS, RATE, WRONG_RATE = 6000, 8, 0.5, 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")  # numbers such as a superscript two are among these, too
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[[9, 10, 11, 12, 13]] = 32


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: the logits of an n-gram
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pieces of about a megabyte: text numbers and buckets of all n-grams."""
    lo, end = int(offs[0]), int(offs[-1])
    for at in range(lo, end, words.PIECE):
        to = min(at + words.PIECE, end)
        low = _LOW[raw[at : min(to + max(ORDERS) - 1, end)]].astype(np.uint32)
        owner = np.searchsorted(offs, np.arange(at, at + len(low)), side="right") - 1
        for n in ORDERS:
            m = min(to - at, len(low) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for j in range(n):
                h = (h ^ low[j : m + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            same = owner[:m] == owner[n - 1 : m + n - 1]
            yield owner[:m][same], (h[same] & np.uint32(BUCKETS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: the n-gram counts of each whole text."""
    for batch, raw, offs in words.groups(batches):
        n = batch.num_rows
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for owner, bucket in _grams(raw, offs):
            k, c = np.unique(np.concatenate([keys, owner * BUCKETS + bucket]), return_inverse=True)
            counts = np.bincount(c, weights=np.concatenate([counts, np.ones(len(bucket), np.int64)])).astype(np.int64)
            keys = k
        ends = np.searchsorted(keys, np.arange(n + 1) * BUCKETS)
        ids = [(keys[a:b] % BUCKETS).astype("<u2").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        cts = [counts[a:b].astype("<f4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.binary()), pa.array(cts, pa.binary())], names=["label", "grams", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: DataFrame, seed: int = 7) -> Model | None:
    """Train on rows with ``label``, ``text`` and ``rid``: all, or the share of them whose hash of ``rid`` is low enough that about ``TRAIN_ROWS`` remain."""
    labelled = rows.where(F.col("label").isNotNull())
    share = min(1.0, TRAIN_ROWS / max(1, labelled.count()))
    chosen = labelled.where((F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))) & F.col("text").rlike(r"\p{L}"))
    counted = chosen.select("label", "text").mapInArrow(_counts, "label string, grams binary, counts binary")
    return pickle.loads(common.in_one_task(counted, lambda batches: pickle.dumps(_learned(batches, seed))))


def _learned(batches: list[pa.RecordBatch], seed: int) -> Model | None:
    """Train both layers on the sample's n-gram counts and calibrate."""
    found = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("label", "grams", "counts")), strict=True) if r[1])
    examples = [(label, np.frombuffer(grams, "<u2").astype(np.int64), np.frombuffer(counts, "<f4")) for label, grams, counts in found]
    if not examples:
        return None
    labels = sorted({e[0] for e in examples})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    held = order[: len(order) // 5] if len(order) >= 50 else order
    train = order[len(order) // 5 :] if len(order) >= 50 else order
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out = np.zeros((WIDTH, len(labels)))
    out += rng.normal(0, 0.1, out.shape)
    bias = np.zeros(len(labels))
    place = {w: i for i, w in enumerate(labels)}
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for e in rng.permutation(train):
            label, ids, counts = examples[e]
            share = counts / counts.sum()
            mean = share @ emb[ids]
            slope = _softmax(mean @ out + bias)
            slope[place[label]] -= 1
            back = out @ slope
            out -= rate * np.outer(mean, slope)
            bias -= rate * slope
            emb[ids] -= rate * np.outer(share * len(ids) ** 0.5, back)
    table = emb @ out
    logits = np.stack([(examples[e][2] / examples[e][2].sum()) @ table[examples[e][1]] + bias for e in held])
    truth = np.array([place[examples[e][0]] for e in held])
    losses = [(-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in (0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)]
    temperature = min(losses)[1]
    p = _softmax(logits / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    by = np.argsort(-top)
    wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
    fine = np.flatnonzero(wrong <= WRONG_RATE)
    threshold = float(top[by][fine[-1]]) if len(fine) else 1.0
    return Model(labels, table.astype(np.float32), bias, temperature, threshold)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offs in words.groups(batches):
            n = batch.num_rows
            named, scores, rejected = [UNKNOWN] * n, [0.0] * n, [True] * n
            if model is not None:
                k = len(model.labels)
                sums, counts = np.zeros((n, k)), np.zeros(n)
                for owner, bucket in _grams(raw, offs):
                    gathered = model.table[bucket]
                    for c in range(k):
                        sums[:, c] += np.bincount(owner, weights=gathered[:, c], minlength=n)
                    counts += np.bincount(owner, minlength=n)
                p = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)
                best = p.argmax(axis=1)
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if has_letter(text):
                        named[i], scores[i] = model.labels[best[i]], float(p[i, best[i]])
                        rejected[i] = scores[i] < model.threshold
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(named), pa.array(scores, pa.float64()), pa.array(rejected)], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "rejected"])

    return run


def identify(spark: SparkSession, documents: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, lang_pred, score, rejected. Learns only from rows for which ``learn_from`` holds."""
    common.short_batches(spark)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = base.where(learn_from).select(F.col("lang").alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("rid"))
    model = fit(rows)
    everything = base.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return everything.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")
