"""Readers and adapters of public attribution file layouts into the canonical schema."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.operators.sampling import pick
from credence.schema import ColumnMapping, SchemaError

IMPRESSION_LOG_COLUMNS = ("timestamp", "uid", "campaign", "conversion", "conversion_timestamp", "conversion_id", "click")
DAY = 86_400_000_000


class DatasetNotAvailableError(FileNotFoundError):
    """A data file that is neither given nor found; nothing is downloaded."""


def resolve_path(path: str | None, variable: str, names: list[str]) -> str:
    """The given path, or one named by an environment variable, or a known name in ``./data``. A given path that isn't there is an error."""
    places = (path,) if path else (os.environ.get(variable), *(str(Path("data") / n) for n in names))
    for found in places:
        if found and ("://" in found or Path(found).exists()):
            return found
    raise DatasetNotAvailableError(f"give a path, set {variable}, or put one of {names} into ./data")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or TSV by the file's ending."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if name.endswith(".tsv") else ",")


def _need(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")


def _numbered(df: DataFrame) -> DataFrame:
    return df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())


def read_impression_log(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """A tab-separated impression log; a gzip file is one split, so it is dealt out after reading."""
    df = spark.read.csv(path, header=True, sep="\t")  # one pass: kinds are known, so none is inferred
    _need(df, IMPRESSION_LOG_COLUMNS)
    df = _numbered(df.select(*(F.col(f"`{c}`").try_cast("double" if c in ("cost", "cpo") else "long").alias(c) for c in df.columns)))
    if nrows is not None:
        df = df.orderBy("row_id").limit(nrows)
    return df.repartition("uid") if path.endswith(".gz") else df


def impression_log_events(raw: DataFrame, sample_users: int | None = None, seed: int = 42) -> DataFrame:
    """Seconds to timestamps; of each (uid, conversion id), only the last impression up to the conversion converts (the first row on ties)."""
    _need(raw, IMPRESSION_LOG_COLUMNS)
    raw = _numbered(raw)
    if sample_users is not None:
        raw = raw.join(pick(raw.select("uid").distinct(), sample_users, seed, "users", "uid"), "uid", "left_semi")
    able = (F.col("conversion") == 1) & (F.col("conversion_id") != -1) & (F.col("timestamp") <= F.col("conversion_timestamp"))
    last = F.max(F.when(able, F.struct("timestamp", (-F.col("row_id")).alias("r")))).over(Window.partitionBy("uid", "conversion_id"))
    chosen = F.coalesce(able & (last["r"] == -F.col("row_id")), F.lit(False))
    extra = [c for c in raw.columns if c not in ("timestamp", "uid", "campaign", "conversion", "conversion_timestamp", "click", "row_id")]
    return raw.select(
        "row_id", F.col("uid").alias("user_id"), F.timestamp_seconds("timestamp").alias("timestamp"), F.col("campaign").cast("string").alias("channel"), F.col("campaign").cast("string").alias("campaign_id"),
        chosen.alias("conversion"), F.when(chosen & (F.col("conversion_timestamp") >= 0), F.timestamp_seconds("conversion_timestamp")).alias("conversion_timestamp"), (F.col("click") == 1).alias("click"), *extra,
    )


def impression_log_mapping() -> ColumnMapping:
    return ColumnMapping(conversion_timestamp="conversion_timestamp", campaign_id="campaign_id", click="click")


def journey_steps_events(touchpoints: DataFrame, journeys: DataFrame) -> DataFrame:
    """Touchpoints left-joined with journeys; the last step of a converted journey converts."""
    _need(touchpoints, ("journey_id", "step", "channel"))
    flag = journeys.select("journey_id", F.col("converted").cast("int").alias("__converted"))
    joined = _numbered(touchpoints).join(flag, "journey_id", "left")
    origin = F.unix_micros(F.lit("2020-01-01").cast("timestamp"))
    if "t_hours" in touchpoints.columns:
        ts = F.timestamp_micros(origin + F.round(F.col("t_hours") * 3_600_000_000).cast("long"))
    elif "timestamp" in touchpoints.columns:
        ts = F.col("timestamp").cast("timestamp")
    else:
        ts = F.timestamp_micros(origin + F.col("step").cast("long") * DAY)
    last = F.col("step") == F.max("step").over(Window.partitionBy("journey_id"))
    conv = F.coalesce((F.col("__converted") == 1) & last, F.lit(False))
    cost = F.col("cost").try_cast("double") if "cost" in touchpoints.columns else F.lit(None).cast("double")
    return joined.select("row_id", F.col("journey_id").alias("user_id"), ts.alias("timestamp"), "channel", conv.alias("conversion"), conv.cast("double").alias("conversion_value"), cost.alias("cost"))


def sequence_events(raw: DataFrame) -> DataFrame:
    """Numbered touches of a user, a day apart from 2024-01-01; the value is on conversion rows only."""
    _need(raw, ("uid", "touch_sequence", "channel", "conversion"))
    origin = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    conv = F.col("conversion").cast("int") == 1
    value = F.col("monetary_value").cast("double") if "monetary_value" in raw.columns else F.lit(1.0)
    return _numbered(raw).select("row_id", F.col("uid").alias("user_id"), F.timestamp_micros(origin + (F.col("touch_sequence").cast("long") - 1) * DAY).alias("timestamp"), "channel", conv.alias("conversion"), F.when(conv, value).otherwise(0.0).alias("conversion_value"))


def funnel_events(raw: DataFrame) -> DataFrame:
    """Journey-level flags moved to the journey's last touch, with the revenue."""
    _need(raw, ("journey_id", "channel", "touch_position", "touch_timestamp", "converted"))
    raw = _numbered(raw)
    back = Window.partitionBy("journey_id").orderBy(F.desc("touch_position"), F.desc("touch_timestamp"), F.desc("row_id"))
    conv = (F.max(F.col("converted").cast("int")).over(Window.partitionBy("journey_id")) == 1) & (F.row_number().over(back) == 1)
    revenue = F.max(F.col("revenue").cast("double")).over(Window.partitionBy("journey_id")) if "revenue" in raw.columns else F.lit(1.0)
    return raw.select("row_id", F.col("journey_id").alias("user_id"), F.col("touch_timestamp").cast("timestamp").alias("timestamp"), "channel", conv.alias("conversion"), F.when(conv, F.coalesce(revenue, F.lit(1.0))).otherwise(0.0).alias("conversion_value"))


def daily_touch_events(raw: DataFrame) -> DataFrame:
    """One row a touch with its own flag and a date or timestamp."""
    at = "touchpoint_date" if "touchpoint_date" in raw.columns else "timestamp"
    _need(raw, ("user_id", at, "channel", "conversion"))
    return _numbered(raw).select("row_id", "user_id", F.col(at).cast("timestamp").alias("timestamp"), "channel", (F.col("conversion").cast("int") == 1).alias("conversion"))
