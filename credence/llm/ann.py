"""Operator 5: nearest neighbours by a block matrix join on int8 tiles.

A vector is written as a power of two times components of at most 1, and these are quantised to int8 with a scale of their own. Query
blocks meet candidate blocks in tiles; a tile is one matrix product of int8 values (exact in float32 while ``dimensions * 127**2 <
2**24``). By Cauchy-Schwarz the quantised product differs from the true one by at most ``|q - q'| |c| + |q'| |c - c'|``, so each pair
has a lower and an upper bound. A task goes through the candidate blocks of a query block one after another and carries each query's
``k`` largest lower bounds along; pairs whose upper bound is below the ``k``-th go. The floors of all tasks together thin the
pairs once more. Only for the survivors original vectors are fetched; their products are computed in double
precision, and each query's best are merged by a heap of bounded size. The result is exact: no pair is lost to quantisation.

Only int8 values, scales and norms travel to the tiles, in blocks of ``BLOCK`` vectors; no side is broadcast, and a tile's memory is
fixed. Of equal candidate vectors only the ``k + 1`` with the smallest ids travel, as no other can be among the nearest.

Where a product's magnitude could leave the range in which doubles are exact to a relative error (beyond ``2 ** +-WILD``), a pair has no
bounds and survives; only such extreme vectors make more survivors than their number of queries times ``k``.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither do rows
with a null id. Only vectors of equal length are compared. A row is no neighbour of a query with its own id. Repeated
rows of a candidate are candidates each; repeated query rows count once, with the smallest vector where they differ. Ties go to the
smaller id. A product that overflows is infinite, one that is no number (of infinite terms of both signs) comes last, as negative
infinity. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm import common

BLOCK = 4096
ROWS = 512
WILD = 900
_BLOCK = "block int, dims int, rids binary, ids binary, small binary, sizes binary"
_SIZES = 5  # exponent, scale, norms of the scaled vector, of the quantised one and of the error


def _valid(vectors: DataFrame) -> DataFrame:
    given = vectors.schema["embedding"].dataType
    kind = "array<float>" if given.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 values, and ``_SIZES`` doubles for each vector."""
    exponent = np.frexp(np.abs(x).max(axis=1))[1].astype(np.float64)
    half = np.trunc(exponent / 2).astype(np.int32)  # in two steps, as one power may be out of range
    y = np.ldexp(np.ldexp(x, -half[:, None]), (half - exponent.astype(np.int32))[:, None])
    scale = np.abs(y).max(axis=1) / 127.0
    q = np.rint(y / scale[:, None])
    back = q * scale[:, None]
    norm = lambda m: np.sqrt((m * m).sum(axis=1)) * (1 + 1e-9)
    return q.astype(np.int8), np.stack([exponent, scale, norm(y), norm(back), norm(y - back)], axis=1)


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of about ``BLOCK`` quantised vectors."""

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        small, sizes = _quantise(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        raw = {"rids": pdf["rid"].to_numpy("<i8"), "ids": pdf["vec_id"].to_numpy("<i8"), "small": small, "sizes": sizes}
        return pd.DataFrame({"block": [key[0]], "dims": [key[1]], **{k: [x.tobytes()] for k, x in raw.items()}})

    salted = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("dims", F.size("v"))
    return salted.groupBy("block", "dims").applyInPandas(gather, _BLOCK)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last; what is no number is negative infinity."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            out += a[:, d] * b[:, d]
    return np.where(np.isnan(out), -np.inf, out)


def bounds(q: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all products of two quantised blocks, in units of the query's power of two."""
    (q8, qz), (c8, cz) = q, c
    exact = np.float32 if q8.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (q8.astype(exact) @ c8.astype(exact).T).astype(np.float64)
    product *= qz[:, None, 1] * cz[None, :, 1]
    error = (qz[:, None, 4] * cz[None, :, 2] + qz[:, None, 3] * cz[None, :, 4]) * (1 + 1e-6) + 1e-11 * qz[:, None, 2] * cz[None, :, 2]
    wild = (np.abs(qz[:, None, 0] + cz[None, :, 0]) > WILD) | (np.abs(cz[None, :, 0]) > WILD)
    unit = np.ldexp(1.0, np.where(np.abs(cz[:, 0]) > WILD, 0, cz[:, 0]).astype(np.int32))
    lower, upper = (product - error) * unit, (product + error) * unit
    lower[wild], upper[wild] = -np.inf, np.inf
    return lower, upper


def _tiles(k: int):
    """Rows sorted by query block: survivors of each tile, with the floor of the query block carried from tile to tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, np.zeros((0, k))
        names = ("q_block", "dims", "q_rids", "q_ids", "q_small", "q_sizes", "rids", "ids", "small", "sizes")
        for batch in batches:
            for q_block, dims, *raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                q_rid, q_id, rid, c_id = (np.frombuffer(raw[i], "<i8") for i in (0, 1, 4, 5))
                q8, c8 = (np.frombuffer(raw[i], np.int8).reshape(-1, dims) for i in (2, 6))
                qz, cz = (np.frombuffer(raw[i], np.float64).reshape(-1, _SIZES) for i in (3, 7))
                if (q_block, dims) != at:
                    at, best = (q_block, dims), np.full((len(q_rid), k), -np.inf)
                for lo in range(0, len(q_rid), ROWS):
                    part = slice(lo, lo + ROWS)
                    lower, upper = bounds((q8[part], qz[part]), (c8, cz))
                    own = q_id[part, None] == c_id[None, :]
                    lower[own] = -np.inf
                    known = np.concatenate([best[part], lower], axis=1)
                    known.partition(known.shape[1] - k, axis=1)
                    best[part] = known[:, -k:]
                    i, j = np.nonzero((upper >= best[part].min(axis=1)[:, None]) & ~own)
                    columns = (q_rid[part][i], rid[j], lower[i, j], upper[i, j])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_rid", "rid", "lower", "upper"])

    return run


def _thin(k: int):
    """Of one query's survivors of all tasks, those that reach the floor of all tasks together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lower = pdf["lower"].to_numpy()
        floor = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
        return pdf.loc[pdf["upper"].to_numpy() >= floor, ["q_rid", "rid"]]

    return run


def _merge(k: int):
    """One query's rows: its own vector and those of its survivors; the best by a heap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy()
        query, rest = pdf[own], pdf[~own]
        if not len(rest):
            return pd.DataFrame({"query_id": [], "rank": [], "vec_id": [], "score": []})
        b = np.stack(rest["v"].to_numpy()).astype(np.float64)
        a = np.broadcast_to(np.asarray(query["v"].iloc[0], np.float64), b.shape)
        found = zip(-exact_products(a, b), rest["vec_id"].to_numpy(np.int64), rest["copies"].to_numpy(np.int64), strict=True)
        best = [x for x in heapq.nsmallest(k, found) for _ in range(min(k, x[2]))][:k]
        return pd.DataFrame({"query_id": int(query["vec_id"].iloc[0]), "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [v for _, v, _ in best], "score": [-s + 0.0 for s, _, _ in best]})

    return run


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    # equal rows once, with their number; of equal vectors the smallest ids (a partial limit comes before the shuffle)
    once = _valid(vectors).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    first = Window.partitionBy("v").orderBy("vec_id")
    few = once.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")
    rows = common.stage(few.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asked = _valid(vectors.where(is_query)).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = common.stage(asked.withColumn("rid", F.monotonically_increasing_id()), "queries")
    q_blocks, c_blocks = (max(1, -(-t.count() // block)) for t in (queries, rows))
    left = _blocks(queries, q_blocks).select(F.col("block").alias("q_block"), "dims", *(F.col(c).alias(f"q_{c}") for c in ("rids", "ids", "small", "sizes")))
    right = _blocks(rows, c_blocks).withColumnRenamed("block", "c_block")
    # every query block meets every candidate block once; a task has a stretch of one query block's tiles
    n = 4 * common.tasks(spark)
    runs = max(1, min(c_blocks, -(-n // q_blocks)))
    keys, n = ("q_block", "run", "dims"), min(q_blocks * runs, n)
    wide = left.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartition(n, *keys)
    pairs = right.withColumn("run", (F.col("c_block") % runs).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).repartition(n, *keys)
    tiles = wide.join(pairs, list(keys)).sortWithinPartitions(*keys, "c_block")
    hits = tiles.mapInArrow(_tiles(k), "q_rid long, rid long, lower double, upper double")
    kept = hits.groupBy("q_rid").applyInPandas(_thin(k), "q_rid long, rid long")
    fetched = kept.join(rows, "rid").select("q_rid", F.lit(False).alias("own"), "vec_id", "v", "copies")
    own = queries.select(F.col("rid").alias("q_rid"), F.lit(True).alias("own"), "vec_id", "v", F.lit(1).cast("long").alias("copies"))
    return fetched.unionByName(own).groupBy("q_rid").applyInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")
