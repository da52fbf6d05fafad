"""Stability audits as small aggregates over scenario-keyed credit tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.durations import positive
from credence.functions.stats import average_rank, pearson, share
from credence.operators.attribution import attribute
from credence.operators.journeys import build_journeys, paths


def scenario_grid(credits: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Every (scenario, channel), with 0 where a channel has no credit. Ranks are among a scenario's own channels; one that is absent there comes after all channels."""
    every = credits.select(scenario).distinct().join(credits.select("channel").distinct())
    own = credits.select(scenario, "channel", "attribution_credit", "share", F.rank().over(Window.partitionBy(scenario).orderBy(F.round("attribution_credit", 9).desc())).alias("rank"))
    filled = every.join(own, [scenario, "channel"], "left").fillna(0.0, ["attribution_credit", "share"])
    return filled.withColumn("rank", F.coalesce("rank", F.count(F.lit(1)).over(Window.partitionBy(scenario)) + 1))


def window_credits(frame: DataFrame, windows: Iterable = (7, 14, 30), model: str = "linear", lookback="30D") -> DataFrame:
    """Credit under each conversion window; ``scenario`` is the window in microseconds."""
    out = None
    for us in sorted({positive(w) for w in windows}):
        one = attribute(build_journeys(frame, lookback, f"{us}us"), model).withColumn("scenario", F.lit(us))
        out = one if out is None else out.unionByName(one)
    return out


def window_comparison(credits: DataFrame) -> DataFrame:
    """Each channel's change from the smallest to the largest scenario, and its widest difference in share."""
    g = scenario_grid(credits)
    first, last = F.min_by("attribution_credit", "scenario"), F.max_by("attribution_credit", "scenario")
    return g.groupBy("channel").agg(
        first.alias("credit_first"), last.alias("credit_last"), (last - first).alias("credit_change"), F.try_divide(last - first, F.nullif(first, F.lit(0.0))).alias("credit_change_ratio"),
        (F.max_by("rank", "scenario") - F.min_by("rank", "scenario")).cast("long").alias("rank_change"), (F.max("share") - F.min("share")).alias("share_volatility"),
    )


def _correlated(ranked: DataFrame, scenario: str) -> DataFrame:
    a, b = ranked.select(F.col(scenario).alias("a"), "channel", F.col("r").alias("ra")), ranked.select(F.col(scenario).alias("b"), "channel", F.col("r").alias("rb"))
    return a.join(b, "channel").where("a < b").groupBy("a", "b").agg(pearson("ra", "rb").alias("spearman"))


def rank_correlations(credits: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Correlation of the ranks of each pair of windows; absent channels come last."""
    return _correlated(scenario_grid(credits, scenario).withColumn("r", F.col("rank").cast("double")), scenario)


def share_ranks(credits: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Every (scenario, channel) with its share, 0 where absent, and the rank of that share; ties share their mean rank ``r``."""
    every = credits.select(scenario).distinct().join(credits.select("channel").distinct())
    filled = every.join(credits.select(scenario, "channel", "share"), [scenario, "channel"], "left").fillna(0.0, ["share"]).withColumn("x", -F.round("share", 12))
    return filled.withColumn("r", average_rank(F.col("x"), [scenario])).drop("x")


def period_correlations(credits: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Spearman correlation of the shares of each pair of periods."""
    return _correlated(share_ranks(credits, scenario), scenario)


def contamination_users(frame: DataFrame, short_window=7, reference_window=30) -> DataFrame:
    """Each user's class by the delay from first event to first conversion."""
    short, reference = positive(short_window), positive(reference_window)
    if short >= reference:
        raise ValueError("the short window must be shorter than the reference window")
    order = F.struct("timestamp", "row_id")
    at = F.coalesce("conversion_timestamp", "timestamp") if "conversion_timestamp" in frame.columns else F.col("timestamp")
    campaign = F.min_by("campaign_id", order) if "campaign_id" in frame.columns else F.lit(None).cast("string")
    users = frame.groupBy("user_id").agg(F.min("timestamp").alias("first_ts"), F.min_by("channel", order).alias("first_channel"), campaign.alias("first_campaign"), F.min_by(F.when(F.col("conversion"), at), F.when(F.col("conversion"), order)).alias("converted_at"))
    delay = F.unix_micros("converted_at") - F.unix_micros("first_ts")
    return users.withColumn("class", F.when(delay.isNull(), "none").when(delay <= short, "short").when(delay <= reference, "delayed").otherwise("post"))


def contamination(frame: DataFrame, by: str | None = None, **windows) -> DataFrame:
    """Users of each class, over all or by first channel or first campaign."""
    return count_classes(contamination_users(frame, **windows), by)


def count_classes(users: DataFrame, by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    grouped = users.groupBy(*keys) if keys else users.groupBy()
    classes = [F.count_if(F.col("class") == c).alias(c) for c in ("short", "delayed", "post", "none")]
    out = grouped.agg(F.count(F.lit(1)).alias("users"), *classes)
    return out.withColumn("delayed_rate", share(F.col("delayed"), F.col("users")))


def exposures(frame: DataFrame) -> DataFrame:
    """Rows up to each user's first conversion, or all of a user without one."""
    user = Window.partitionBy("user_id")
    first = F.min(F.when(F.col("conversion"), F.col("timestamp"))).over(user)
    return frame.withColumn("converted", F.max("conversion").over(user)).withColumn("endpoint", F.coalesce(first, F.max("timestamp").over(user))).where("timestamp <= endpoint")


def exposure_stats(frame: DataFrame) -> DataFrame:
    """Converters and others: users, lengths, variety of paths, recency."""
    seen = exposures(frame)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "row_id", "channel"))), lambda x: x["channel"])
    users = seen.groupBy("user_id").agg(F.max("converted").alias("converted"), F.count(F.lit(1)).alias("touches"), ordered.alias("path"), F.max("endpoint").alias("endpoint"), F.max(F.when(~F.col("conversion"), F.col("timestamp"))).alias("last_exposure"))
    recency = F.when(F.col("converted"), (F.unix_micros("endpoint") - F.unix_micros("last_exposure")) / 86_400e6)
    return users.groupBy("converted").agg(F.count(F.lit(1)).alias("users"), F.avg("touches").alias("mean_touches"), F.median("touches").alias("median_touches"), F.stddev_pop("touches").alias("std_touches"), F.count_distinct("path").alias("unique_paths"), (F.count_distinct("path") / F.count(F.lit(1))).alias("path_diversity"), F.avg(recency).alias("mean_recency_days"))


def exposure_mix_distance(frame: DataFrame, column: str = "channel") -> DataFrame:
    """Total variation between the mixes of converters and others."""
    mix = exposures(frame).where(F.col(column).isNotNull()).groupBy(column).agg(F.count_if("converted").alias("a"), F.count_if(~F.col("converted")).alias("b"))
    totals = mix.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return mix.join(F.broadcast(totals)).agg((F.sum(F.abs(share(F.col("a"), F.col("ta")) - share(F.col("b"), F.col("tb")))) * 0.5).alias("distance"))


def exposure_comparison(frame: DataFrame) -> dict:
    """The figures of the exposure audit, from small results. A group without users has no touches and an empty mix."""
    stats = {r["converted"]: r.asDict() for r in exposure_stats(frame).collect()}
    won, lost = stats.get(True), stats.get(False)
    ratio = (won["mean_touches"] if won else 0.0) / lost["mean_touches"] if lost and lost["mean_touches"] else None
    campaigns = exposure_mix_distance(frame, "campaign_id").first()["distance"] if "campaign_id" in frame.columns else None
    return {"ratio": ratio, "channel_distance": exposure_mix_distance(frame).first()["distance"] or 0.0, "campaign_distance": campaigns, "converters": won, "non_converters": lost}


def model_disagreement(credits: DataFrame) -> DataFrame:
    """Each pair of models: rank correlation, Jensen-Shannon divergence in bits, and widest difference in share."""
    every = credits.select("model").distinct().join(credits.select("channel").distinct())
    g = every.join(credits, ["model", "channel"], "left").fillna(0.0, ["share"]).withColumn("share", F.round("share", 12))
    g = g.withColumn("share", share(F.col("share"), F.sum("share").over(Window.partitionBy("model")))).withColumn("x", F.round("share", 12))
    g = g.withColumn("r", average_rank(F.col("x"), ["model"]))
    a = g.select(F.col("model").alias("a"), "channel", F.col("share").alias("pa"), F.col("r").alias("ra"))
    b = g.select(F.col("model").alias("b"), "channel", F.col("share").alias("pb"), F.col("r").alias("rb"))
    pairs = a.join(b, "channel").where("a < b").withColumn("m", (F.col("pa") + F.col("pb")) / 2)
    part = lambda p: F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / F.col("m"))).otherwise(0.0)
    return pairs.groupBy("a", "b").agg(pearson("ra", "rb").alias("spearman"), (F.sum(part("pa") + part("pb")) / 2).alias("jensen_shannon"), F.max(F.abs(F.col("pa") - F.col("pb"))).alias("max_share_difference"))


def agreement(credits: DataFrame) -> dict:
    """The combined agreement score of all models."""
    models = credits.select("model").distinct().count()
    if models < 2:
        return {"agreement_score": 100.0, "models": models}
    pairs = model_disagreement(credits).agg(F.avg("spearman").alias("spearman"), F.avg("jensen_shannon").alias("js"), F.max("max_share_difference").alias("difference")).first()
    every = credits.select("model").distinct().join(credits.select("channel").distinct())
    g = every.join(credits, ["model", "channel"], "left").fillna(0.0, ["share"]).withColumn("x", -F.round("share", 12))
    ranks = g.withColumn("r", average_rank(F.col("x"), ["model"])).groupBy("channel").agg(F.var_pop("r").alias("v"))
    got = ranks.agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).first()
    spread = min(1.0, got["v"] / max(1.0, (got["n"] - 1) ** 2 / 4))
    parts = [(pairs["spearman"] + 1) / 2, 1 - min(1.0, pairs["js"]), 1 - min(1.0, pairs["difference"]), 1 - spread]
    return {"agreement_score": 100 * min(1.0, max(0.0, sum(parts) / 4)), "models": models, "rank_variance": got["v"], "max_share_difference": pairs["difference"]}


def path_sparsity(journeys: DataFrame) -> DataFrame:
    counted = paths(journeys).groupBy("path").agg(F.count(F.lit(1)).alias("c"))
    return counted.agg(
        F.sum("c").alias("journeys"), F.count(F.lit(1)).alias("unique_paths"), share(F.count(F.lit(1)), F.sum("c")).alias("unique_path_ratio"), F.count_if(F.col("c") == 1).alias("singleton_paths"),
        share(F.count_if(F.col("c") == 1), F.count(F.lit(1))).alias("singleton_share"), F.avg("c").alias("mean_frequency"), F.max("c").alias("max_frequency"),
    )


def concentration(journeys: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """HHI, top-1 and top-3 shares of touches, conversions and each model's credit."""
    touches = journeys.groupBy("channel").agg(F.count(F.lit(1)).cast("double").alias("amount")).withColumn("measure", F.lit("touch"))
    won = journeys.where("converted").groupBy("channel").agg(F.sum(1 / F.col("n")).alias("amount")).withColumn("measure", F.lit("conversion"))
    both = touches.unionByName(won)
    if credits is not None:
        both = both.unionByName(credits.select("channel", F.col("share").alias("amount"), F.concat(F.lit("model:"), "model").alias("measure")))
    shares = both.withColumn("s", share(F.col("amount"), F.sum("amount").over(Window.partitionBy("measure"))))
    ranked = shares.withColumn("k", F.row_number().over(Window.partitionBy("measure").orderBy(F.round("s", 12).desc(), "channel")))
    return ranked.groupBy("measure").agg(F.sum(F.col("s") * F.col("s")).alias("hhi"), F.sum(F.when(F.col("k") <= 1, F.col("s"))).alias("top1"), F.sum(F.when(F.col("k") <= 3, F.col("s"))).alias("top3"))


PERIODS = {"W": "week", "M": "month", "D": "day", "Q": "quarter", "Y": "year"}


def by_period(journeys: DataFrame, period: str = "W") -> DataFrame:
    """Journeys with ``scenario``: the start of the calendar period of their end, as a date."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; use one of {sorted(PERIODS)}")
    return journeys.withColumn("scenario", F.date_format(F.date_trunc(PERIODS[period], "end_ts"), "yyyy-MM-dd"))


def period_summary(journeys: DataFrame, period: str = "W") -> DataFrame:
    first = by_period(journeys, period).where("pos = 1")
    return first.groupBy("scenario").agg(F.count(F.lit(1)).alias("journeys"), F.count_if("converted").alias("conversions"), F.avg(F.col("converted").cast("double")).alias("conversion_rate"))


def period_credits(journeys: DataFrame, model: str = "linear", period: str = "W") -> DataFrame:
    return attribute(by_period(journeys, period), model, ["scenario"])


def period_ranges(credits: DataFrame) -> DataFrame:
    return share_ranks(credits).groupBy("channel").agg((F.max("share") - F.min("share")).alias("share_range"), (F.max("r") - F.min("r")).alias("rank_range"))


def transition_similarity(edges: DataFrame) -> DataFrame:
    """Each pair of scenarios: 1 less the mean absolute difference over all cells of the union of their states, absorbing rows included."""
    states = edges.select("scenario", F.explode(F.array("src", "dst")).alias("state")).distinct()
    probs = edges.select("scenario", "src", "dst", "prob")
    a, b = probs.select(F.col("scenario").alias("a"), "src", "dst", F.col("prob").alias("pa")), probs.select(F.col("scenario").alias("b"), "src", "dst", F.col("prob").alias("pb"))
    names = states.select("scenario").distinct()
    pairs = names.select(F.col("scenario").alias("a")).join(names.select(F.col("scenario").alias("b"))).where("a < b")
    cells = pairs.join(states, (F.col("scenario") == F.col("a")) | (F.col("scenario") == F.col("b"))).groupBy("a", "b").agg(F.count_distinct("state").alias("k"))
    left = pairs.join(a, "a").join(b, ["b", "src", "dst"], "left").select("a", "b", "src", "dst", F.abs(F.col("pa") - F.coalesce("pb", F.lit(0.0))).alias("d"))
    right = pairs.join(b, "b").join(a, ["a", "src", "dst"], "left_anti").select("a", "b", "src", "dst", F.col("pb").alias("d"))
    summed = left.unionByName(right).groupBy("a", "b").agg(F.sum("d").alias("d"))
    return cells.join(summed, ["a", "b"]).select("a", "b", (1 - F.col("d") / (F.col("k") * F.col("k"))).alias("similarity"))


def share_drift(baseline: DataFrame, scenario: DataFrame, keys: list[str]) -> DataFrame:
    """Difference in share by channel between two credit tables."""
    a = baseline.select(*keys, "channel", F.col("share").alias("share_base"))
    b = scenario.select(*keys, "channel", F.col("share").alias("share_new"))
    joined = a.join(b, [*keys, "channel"], "full").fillna(0.0, ["share_base", "share_new"])
    return joined.withColumn("drift", F.col("share_new") - F.col("share_base"))


def total_variation(drift: DataFrame, keys: list[str]) -> DataFrame:
    return drift.groupBy(*keys).agg((F.sum(F.abs("drift")) * 0.5).alias("total_variation"), F.max(F.abs("drift")).alias("max_drift"))


def identification(journeys: DataFrame) -> DataFrame:
    """What a Markov model needs: journeys, channels, journeys that end in nothing."""
    return journeys.agg(F.count_if(F.col("pos") == 1).alias("journeys"), F.count_if((F.col("pos") == 1) & ~F.col("converted")).alias("null_paths"), F.count_distinct("channel").alias("channels"))


