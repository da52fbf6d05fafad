"""Deterministic picks by a portable hash: the same rows for the same seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TOP, STEP = 100_000, 3


def order_key(seed: int, stage: str, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stage), *[F.col(c).cast("string") for c in columns]))


def exact_count(size: int, rate: float) -> int:
    """How many of ``size`` a rate means: at least one unless either is 0; halves round to even."""
    return min(size, max(1, round(size * rate))) if size and rate else 0


def pick(rows: DataFrame, k: int, seed: int, stage: str, *columns: str) -> DataFrame:
    """The ``k`` rows that come first by hash, and by ``columns`` on ties.

    More than ``TOP`` are found by counting hash prefixes: all rows below the prefix in which the last one lies, and of
    that prefix as many as are wanted still. So no task holds more than ``TOP`` rows in order, nor does the driver more than a level of prefixes.
    """
    keyed = rows.withColumn("__key", order_key(seed, stage, *columns))
    inside, below, deep = keyed, None, 0
    while k > TOP and deep < 32:
        deep += STEP
        counted = inside.groupBy(F.substring("__key", 1, deep).alias("prefix")).count().orderBy("prefix").collect()  # 16 ** STEP rows at most
        last = None
        for r in counted:
            if r["count"] > k:
                last = r["prefix"]
                break
            k -= r["count"]
        taken = inside if last is None else inside.where(F.substring("__key", 1, deep) < last)
        below = taken if below is None else below.unionByName(taken)
        if last is None:
            return below.drop("__key")
        inside = inside.where(F.substring("__key", 1, deep) == last)
    first = inside.orderBy("__key", *columns).limit(k)
    return (first if below is None else below.unionByName(first)).drop("__key")


def sample_users(frame: DataFrame, max_journeys: int = 100_000, stratify: bool = True, seed: int = 42) -> tuple[DataFrame, dict]:
    """All events of a bounded number of users, converters and others in proportion; and what was done."""
    users = frame.groupBy("user_id").agg(F.max("conversion").alias("converter"))
    got = {r["converter"]: r["count"] for r in users.groupBy("converter").count().collect()}
    n = sum(got.values())
    meta = {"users": n, "sampled_users": min(n, max_journeys), "random_state": seed, "stratified": stratify}
    if n <= max_journeys:
        return frame, meta
    if stratify:
        won = min(got.get(True, 0), max(1, round(max_journeys * got.get(True, 0) / n)))
        lost = min(got.get(False, 0), max_journeys - won)
        won = min(got.get(True, 0), max_journeys - lost)
        kept = pick(users.where("converter"), won, seed, "users", "user_id").unionByName(pick(users.where("not converter"), lost, seed, "users", "user_id"))
    else:
        kept = pick(users, max_journeys, seed, "users", "user_id")
    return frame.join(kept.select("user_id"), "user_id", "left_semi"), meta
