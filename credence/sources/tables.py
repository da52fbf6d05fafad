"""Touch streams derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def touch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a canonical stream; ten synthetic users a user, so that some never convert."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("row_id"), (F.col("user_id") * 10 + F.col("event_id") % 10).alias("user_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("ch"), (k % 6).cast("string")).alias("channel"), F.concat(F.lit("c"), (k % 20).cast("string")).alias("campaign_id"),
        (F.col("event_type") == "purchase").alias("conversion"), (F.col("event_type") == "view").alias("impression"), (F.col("event_type") == "click").alias("click"), F.col("value").alias("conversion_value"),
    )


def with_copies(frame: DataFrame, every: int = 50) -> DataFrame:
    """The stream with each ``every``-th row once more."""
    copies = frame.where(F.col("row_id") % every == 0).withColumn("row_id", F.col("row_id") + 100_000_000)
    return frame.unionByName(copies)


def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a stream whose timestamps are dates."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderpriority").alias("channel"), (F.col("o_orderstatus") == "F").alias("conversion"), F.col("o_totalprice").alias("conversion_value"))
