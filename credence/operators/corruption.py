"""Deterministic damage to a canonical frame: lost identities, lost touches, copies, shifts and noise, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.durations import micros, shifted
from credence.operators.sampling import exact_count, order_key, pick


@dataclass
class CorruptedFrame:
    frame: DataFrame
    requested: dict
    applied: dict = field(default_factory=dict)
    row_counts: dict = field(default_factory=dict)
    random_state: int = 42


def _rate(name: str, value) -> float:
    if isinstance(value, bool) or not 0 <= value <= 1:
        raise ValueError(f"{name} must be between 0 and 1")
    return float(value)


def lose_identity(frame: DataFrame, rate: float, seed: int) -> DataFrame:
    """Half of the exposures of some users move to a new id."""
    exposures = frame.groupBy("user_id").agg(F.count_if(~F.col("conversion")).alias("exposures"), F.max("conversion").alias("converter"))
    eligible = exposures.where((F.col("exposures") >= 1) & ((F.col("exposures") >= 2) | F.col("converter")))
    chosen = pick(eligible, exact_count(eligible.count(), rate), seed, "identity", "user_id").select("user_id", F.greatest(F.floor(F.col("exposures") / 2), F.lit(1)).alias("moved"))
    place = Window.partitionBy("user_id", "conversion").orderBy(order_key(seed, "fragment", "row_id"), "row_id")
    ranked = frame.join(chosen, "user_id", "left").withColumn("__place", F.row_number().over(place))
    moves = F.col("moved").isNotNull() & ~F.col("conversion") & (F.col("__place") <= F.col("moved"))
    old = F.col("user_id").cast("string")
    return ranked.withColumn("user_id", F.when(moves, F.concat(F.lit("__fragment__"), old)).otherwise(old)).drop("moved", "__place")


def lose_rows(frame: DataFrame, eligible, rate: float, seed: int, stage: str) -> DataFrame:
    rows = frame.where(eligible & ~F.col("conversion")).select("row_id")
    gone = pick(rows, exact_count(rows.count(), rate), seed, stage, "row_id")
    return frame.join(gone, "row_id", "left_anti")


def corrupt(frame: DataFrame, *, identity_loss: float = 0.0, touchpoint_loss: float = 0.0, impression_loss: float = 0.0, click_loss: float = 0.0, conversion_delay_shift=None, missing_channel_rate: float = 0.0, timestamp_noise=None, duplicate_rate: float = 0.0, duplicate_kind: str = "exact", event_type_col: str | None = None, random_state: int = 42) -> CorruptedFrame:
    """``frame`` is canonical. ``event_type_col`` names the column that says which rows are impressions and clicks, in place of flag columns. Conversions are never lost. Stages apply in the order of the arguments."""
    rates = {"identity_loss": identity_loss, "touchpoint_loss": touchpoint_loss, "impression_loss": impression_loss, "click_loss": click_loss, "missing_channel_rate": missing_channel_rate, "duplicate_rate": duplicate_rate}
    rates = {k: _rate(k, v) for k, v in rates.items()}
    if duplicate_kind not in ("exact", "near"):
        raise ValueError("duplicate_kind is exact or near")
    if event_type_col is not None and event_type_col not in frame.columns:
        raise ValueError(f"no column {event_type_col}")
    for k in ("impression", "click"):
        if rates[f"{k}_loss"] and event_type_col is None and k not in frame.columns:
            raise ValueError(f"{k}_loss needs a column {k} or event_type_col")
    seed, out, counts = random_state, frame, {"input": frame.count()}
    if rates["identity_loss"]:
        out = lose_identity(out, rates["identity_loss"], seed)
    if rates["touchpoint_loss"]:
        out = lose_rows(out, F.lit(True), rates["touchpoint_loss"], seed, "touchpoint")
    for k in ("impression", "click"):
        if rates[f"{k}_loss"]:
            kind = F.lower(F.trim(F.col(event_type_col).cast("string"))) == k if event_type_col else F.col(k).cast("boolean")
            out = lose_rows(out, F.coalesce(kind, F.lit(False)), rates[f"{k}_loss"], seed, k)
    if conversion_delay_shift is not None:
        out = out.withColumn("timestamp", F.when(F.col("conversion"), shifted(F.col("timestamp"), micros(conversion_delay_shift))).otherwise(F.col("timestamp")))
    if rates["missing_channel_rate"]:
        gone = pick(out.select("row_id"), exact_count(out.count(), rates["missing_channel_rate"]), seed, "channel", "row_id").withColumn("__gone", F.lit(True))
        out = out.join(gone, "row_id", "left").withColumn("channel", F.when(F.col("__gone"), F.lit(None)).otherwise(F.col("channel"))).drop("__gone")
    if timestamp_noise is not None:
        n = micros(timestamp_noise)
        offset = F.pmod(F.conv(F.substring(order_key(seed, "noise", "row_id"), 1, 12), 16, 10).cast("long"), F.lit(2 * n + 1)) - n
        out = out.withColumn("timestamp", shifted(F.col("timestamp"), offset))
    if rates["duplicate_rate"]:
        copies = pick(out, exact_count(out.count(), rates["duplicate_rate"]), seed, "duplicate", "row_id")
        if duplicate_kind == "near":
            copies = copies.withColumn("timestamp", shifted(F.col("timestamp"), 1))
        out = out.unionByName(copies.withColumn("row_id", F.col("row_id") + F.lit(1 << 50)))
    counts["output"] = out.count()
    counts["net_change"] = counts["output"] - counts["input"]
    return CorruptedFrame(out, rates | {"conversion_delay_shift": conversion_delay_shift, "timestamp_noise": timestamp_noise}, {k: v for k, v in rates.items() if v}, counts, seed)
