"""Duplicate rows: exact, by identity, near in time, and by meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.functions import truth
from credence.functions.durations import micros
from credence.operators.quality import Finding
from credence.schema import ColumnMapping

SECOND = 1_000_000


def _all_but(frame: DataFrame, *without: str) -> list[str]:
    return [c for c in frame.columns if c not in without]


def _prepared(events: DataFrame, columns) -> tuple[DataFrame, dict[str, str]]:
    found = ColumnMapping.of(columns).sources(events.columns)
    frame = events if "row_id" in events.columns else events.withColumn("row_id", F.monotonically_increasing_id())
    return frame, found


def flagged(events: DataFrame, columns=None) -> DataFrame:
    """Each row with ``exact``, ``identity`` (a later row of the same key), ``near`` and the flags of its kind."""
    frame, found = _prepared(events, columns)
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    user, ts, channel = (F.col(f"`{found[k]}`") for k in ("user_id", "timestamp", "channel"))
    whole = Window.partitionBy(*[F.col(f"`{c}`") for c in _all_but(frame, "row_id")]).orderBy("row_id")
    marked = frame.withColumn("__ts", ts.try_cast("timestamp")).withColumn("exact", F.row_number().over(whole) > 1)
    marked = marked.withColumn("identity", F.row_number().over(Window.partitionBy(user, ts, channel).orderBy("row_id")) > 1)
    before = F.lag("__ts").over(Window.partitionBy(user, channel).orderBy("__ts", "row_id"))
    gap = F.unix_micros("__ts") - F.unix_micros(before)
    marked = marked.withColumn("near", F.coalesce((gap > 0) & (gap <= SECOND), F.lit(False)) & ~F.col("exact"))
    for name in ("impression", "click", "conversion"):
        flag = truth.lenient(F.col(f"`{found[name]}`"), kinds[found[name]]) if name in found else F.lit(False)
        marked = marked.withColumn(f"is_{name}", flag)
    return marked


def duplicate_counts(events: DataFrame, columns=None) -> DataFrame:
    """One row: counts of each kind, and whether timestamps are dates."""
    f = flagged(events, columns)
    midnight = F.avg((F.col("__ts") == F.date_trunc("day", "__ts")).cast("double"))
    kind = lambda n: [F.count_if(F.col(f"is_{n}")).alias(f"{n}s"), F.count_if(F.col(f"is_{n}") & F.col("identity") & ~F.col("exact")).alias(f"repeated_{n}s")]
    return f.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("exact").alias("exact"), F.greatest(F.count_if("identity") - F.count_if("exact"), F.lit(0).cast("long")).alias("identity"), F.count_if("near").alias("near"),
        *kind("impression"), *kind("click"), *kind("conversion"), (midnight >= 0.9).alias("date_grain"), F.count_if("identity").alias("all_identity"),
    )


def duplicate_findings(events: DataFrame, columns=None) -> list[Finding]:
    got = duplicate_counts(events, columns).first()
    if got["date_grain"]:
        n = max(got["exact"], got["all_identity"])
        return [Finding("date_grain_repeated_touches", "INFO", f"timestamps are dates; {n} repeated touches", n)] if n else []
    names = {"exact": "exact_duplicates", "identity": "identity_duplicates", "near": "near_duplicates", "repeated_impressions": "repeated_impressions", "repeated_clicks": "repeated_clicks", "repeated_conversions": "repeated_conversions"}
    return [Finding(code, "MEDIUM", f"{got[k]} rows", got[k]) for k, code in names.items() if got[k]]


def _meaning(frame: DataFrame, found: dict[str, str], event_type: str | None) -> list:
    names = [found["user_id"], found["channel"], found["conversion"], *([event_type] if event_type else [])]
    return [F.col(f"`{n}`") for n in names]


def detect_duplicates(events: DataFrame, columns=None, event_type: str | None = None, near_tolerance="1s") -> DataFrame:
    """Each row with kind (exact, near, repeated, unique) and a flag for each."""
    frame, found = _prepared(events, columns)
    key, ts = _meaning(frame, found, event_type), F.col(f"`{found['timestamp']}`").try_cast("timestamp")
    order = Window.partitionBy(*key).orderBy("__ts", "row_id")
    gap = F.abs(F.unix_micros("__ts") - F.unix_micros(F.lag("__ts").over(order)))
    marked = frame.withColumn("__ts", ts)
    marked = marked.withColumn("is_exact", F.count(F.lit(1)).over(Window.partitionBy(*[F.col(f"`{c}`") for c in _all_but(frame, "row_id")])) > 1)
    marked = marked.withColumn("is_near", F.coalesce(gap <= micros(near_tolerance), F.lit(False)) & ~F.col("is_exact")).withColumn("is_repeated", F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1)
    kind = F.when(F.col("is_exact"), "exact").when(F.col("is_near"), "near").when(F.col("is_repeated"), "repeated").otherwise("unique")
    return marked.withColumn("kind", kind).withColumn("is_duplicate", F.col("kind") != "unique").drop("__ts")


def deduplicate(events: DataFrame, columns=None, event_type: str | None = None, near_tolerance=None) -> DataFrame:
    """Without later exact copies and, if asked, without rows close to the one before them of the same meaning."""
    frame, found = _prepared(events, columns)
    whole = Window.partitionBy(*[F.col(f"`{c}`") for c in _all_but(frame, "row_id")]).orderBy("row_id")
    kept = frame.withColumn("__copy", F.row_number().over(whole)).where("__copy = 1").drop("__copy")
    if near_tolerance is not None:
        ts = F.col(f"`{found['timestamp']}`").try_cast("timestamp")
        order = Window.partitionBy(*_meaning(frame, found, event_type)).orderBy(ts, "row_id")
        gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order))
        kept = kept.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > micros(near_tolerance))).drop("__gap")
    return kept
