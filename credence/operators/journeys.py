"""Journeys: one row a touch, sessionised by the user's conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.durations import positive, shifted

KEY = ["user_id", "seg"]


def _numbered(touches: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy("timestamp", "row_id")
    numbered = touches.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    return numbered.select("user_id", "seg", "pos", "n", "channel", "timestamp", "row_id", "converted", "end_ts", "value")


def _value(frame: DataFrame):
    return F.coalesce(F.col("conversion_value"), F.lit(1.0)) if "conversion_value" in frame.columns else F.lit(1.0)


def _plain(frame: DataFrame, lookback: int, window: int) -> DataFrame:
    """Each conversion row ends a segment, at its own time."""
    user = Window.partitionBy("user_id")
    before = user.orderBy("timestamp", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = frame.withColumn("seg", F.coalesce(F.sum(F.col("conversion").cast("long")).over(before), F.lit(0)))
    segment = Window.partitionBy(*KEY)
    ended = (
        cut.withColumn("converted", F.max("conversion").over(user))
        .withColumn("end_ts", F.when(F.col("converted"), F.max(F.when(F.col("conversion"), F.col("timestamp"))).over(segment)).otherwise(F.max("timestamp").over(user)))
        .withColumn("value", F.max(F.when(F.col("conversion"), _value(frame))).over(segment))
    )
    since = F.when(F.col("converted"), F.lit(min(lookback, window))).otherwise(F.lit(lookback))
    return ended.where(F.col("timestamp") >= shifted(F.col("end_ts"), -since))


def _general(frame: DataFrame, lookback: int, window: int) -> DataFrame:
    """With conversion timestamps: a conversion without touches in its window emits nothing, and its rows roll into the next segment."""
    row = F.struct("timestamp", "row_id", "channel", "conversion", _value(frame).alias("value"), F.unix_micros("timestamp").alias("t"), F.coalesce(F.unix_micros("conversion_timestamp"), F.unix_micros("timestamp")).alias("end"))
    users = frame.groupBy("user_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.max("conversion").alias("converted"))
    indexed = users.withColumn("rows", F.transform("rows", lambda r, i: F.struct(i.alias("i"), r["timestamp"].alias("timestamp"), r["row_id"].alias("row_id"), r["channel"].alias("channel"), r["conversion"].alias("conversion"), r["value"].alias("value"), r["t"].alias("t"), r["end"].alias("end"))))
    span = min(lookback, window)
    kept = lambda c, prev: F.filter("rows", lambda r: (r["i"] > prev) & (r["i"] <= c["i"]) & (r["t"] >= c["end"] - span) & (r["t"] <= c["end"]))
    empty = F.expr("CAST(array() AS array<struct<prev:int,i:int,end:bigint,value:double>>)")
    start = F.struct(F.lit(-1).alias("prev"), empty.alias("js"))

    def step(acc, c):
        hit = F.size(kept(c, acc["prev"])) > 0
        one = F.array(F.struct(acc["prev"].alias("prev"), c["i"].alias("i"), c["end"].alias("end"), c["value"].alias("value")))
        return F.struct(F.when(hit, c["i"]).otherwise(acc["prev"]).alias("prev"), F.when(hit, F.concat(acc["js"], one)).otherwise(acc["js"]).alias("js"))

    folded = indexed.where("converted").withColumn("js", F.aggregate(F.filter("rows", lambda r: r["conversion"]), start, step, lambda acc: acc["js"]))
    ends = folded.select("user_id", "rows", F.posexplode("js").alias("seg", "j"))
    touches = ends.select("user_id", F.col("seg").cast("long").alias("seg"), F.col("j"), F.explode(F.filter("rows", lambda r: (r["i"] > F.col("j")["prev"]) & (r["i"] <= F.col("j")["i"]) & (r["t"] >= F.col("j")["end"] - span) & (r["t"] <= F.col("j")["end"]))).alias("r"))
    won = touches.select("user_id", "seg", "r.timestamp", "r.row_id", "r.channel", F.lit(True).alias("converted"), F.timestamp_micros("j.end").alias("end_ts"), F.col("j.value").alias("value"))
    lost = indexed.where(~F.col("converted")).withColumn("last", F.array_max(F.transform("rows", lambda r: r["t"]))).select("user_id", "last", F.explode("rows").alias("r")).where(F.col("r.t") >= F.col("last") - lookback)
    none = lost.select("user_id", F.lit(0).cast("long").alias("seg"), "r.timestamp", "r.row_id", "r.channel", F.lit(False).alias("converted"), F.timestamp_micros("last").alias("end_ts"), F.lit(None).cast("double").alias("value"))
    return won.unionByName(none)


def build_journeys(frame: DataFrame, lookback_window="30D", conversion_window=None, include_non_converters: bool = True) -> DataFrame:
    """Touches of all journeys: user_id, seg, pos, n, channel, timestamp, row_id, converted, end_ts, value.

    ``frame`` is canonical. A user's rows after the last conversion belong to no journey; users without one have one journey.
    """
    lookback = positive(lookback_window, "lookback_window")
    window = positive(conversion_window, "conversion_window") if conversion_window is not None else lookback
    if "conversion_timestamp" in frame.columns:
        touches = _general(frame, lookback, window)
    else:
        touches = _plain(frame, lookback, window)
    if not include_non_converters:
        touches = touches.where("converted")
    return _numbered(touches)


def paths(journeys: DataFrame) -> DataFrame:
    """One row a journey: its path and lengths."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "channel"))), lambda x: x["channel"])
    return journeys.groupBy(*KEY).agg(
        F.max("converted").alias("converted"), F.max("value").alias("value"), F.max("end_ts").alias("end_ts"), F.min("timestamp").alias("start_ts"),
        F.count(F.lit(1)).alias("touches"), F.count_distinct("channel").alias("channels"), ordered.alias("path"),
    )


def summary(journeys: DataFrame) -> DataFrame:
    """One row: counts, lengths, rates."""
    p = paths(journeys)
    won, lost = F.when(F.col("converted"), F.col("touches")), F.when(~F.col("converted"), F.col("touches"))
    return p.agg(
        F.count(F.lit(1)).alias("journeys"), F.count_if("converted").alias("converted_journeys"), F.count_if(~F.col("converted")).alias("non_converted_journeys"),
        F.sum("touches").alias("touchpoints"), F.avg("touches").alias("mean_length"), F.median("touches").alias("median_length"), F.min("touches").alias("min_length"), F.max("touches").alias("max_length"),
        F.avg(F.col("converted").cast("double")).alias("conversion_rate"), F.avg((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6).alias("mean_duration_s"),
        F.count_distinct("path").alias("unique_paths"), F.avg(won).alias("converted_mean_length"), F.median(won).alias("converted_median_length"),
        F.avg(lost).alias("non_converted_mean_length"), F.median(lost).alias("non_converted_median_length"),
        F.try_divide(F.sum(F.col("touches") - F.col("channels")), F.sum("touches")).alias("repeated_touch_rate"),
    )


def channel_frequency(journeys: DataFrame) -> DataFrame:
    return journeys.groupBy("channel").agg(F.count(F.lit(1)).alias("touches"), F.count_if("converted").alias("converted_touches"))


def path_frequency(journeys: DataFrame) -> DataFrame:
    return paths(journeys).groupBy(F.array_join("path", ">").alias("path")).agg(F.count(F.lit(1)).alias("journeys"), F.count_if("converted").alias("conversions"))
