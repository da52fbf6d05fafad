"""Sensitivity over scenarios, decision robustness, and bootstrap uncertainty."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.operators.attribution import RULES, chain_effects, credit, steps
from credence.operators.journeys import paths


def matrix(credits: DataFrame) -> DataFrame:
    """Long sensitivity matrix: scenario, channel, share and rank on the full grid."""
    every = credits.select("scenario").distinct().join(credits.select("channel").distinct())
    filled = every.join(credits.select("scenario", "channel", "share"), ["scenario", "channel"], "left").fillna(0.0, ["share"]).withColumn("share", F.round("share", 12))
    return filled.withColumn("rank", F.rank().over(Window.partitionBy("scenario").orderBy(F.desc("share"))))


def wide(credits: DataFrame, value: str = "rank") -> DataFrame:
    return matrix(credits).groupBy("channel").pivot("scenario").agg(F.first(value))


def classify(channels: Column, top1: Column, top2: Column, span: Column) -> Column:
    """The classes of a channel's rank stability."""
    many = F.when((top1 >= 0.75) & (top2 >= 0.90) & (span <= 1), "Robust").when((top1 >= 0.50) & (top2 >= 0.75) & (span <= 2), "Stable").when(top2 >= 0.50, "Uncertain").otherwise("Fragile")
    few = F.when((top1 >= 0.90) & (span == 0), "Robust").when((top1 >= 0.75) & (span <= 1), "Stable").when(top1 >= 0.50, "Uncertain").otherwise("Fragile")
    return F.when(channels < 3, few).otherwise(many)


def decision_robustness(credits: DataFrame, baseline: str, draws: DataFrame | None = None) -> DataFrame:
    """Each channel's ranks and shares over all scenarios, and its class. ``draws``: bootstrap draws of one model, whose ranks are listed beside them."""
    m = matrix(credits)
    span = F.percentile("rank", 0.95) - F.percentile("rank", 0.05)
    top = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    stats = m.groupBy("channel").agg(
        F.max(F.when(F.col("scenario") == baseline, F.col("rank"))).cast("long").alias("baseline_rank"), F.median("rank").alias("median_rank"), F.percentile("rank", 0.05).alias("p5_rank"), F.percentile("rank", 0.95).alias("p95_rank"),
        top(1).alias("p_top1"), top(2).alias("p_top2"), top(3).alias("p_top3"), F.min("share").alias("share_min"), F.max("share").alias("share_max"), F.stddev_pop("rank").alias("rank_std"), span.alias("span"),
    )
    channels = m.agg(F.count_distinct("channel").alias("n"))
    joined = stats.join(F.broadcast(channels))
    out = joined.withColumn("class", classify(F.col("n"), F.col("p_top1"), F.col("p_top2"), F.col("span"))).drop("n", "span")
    if draws is None:
        return out
    drawn = draws.groupBy("channel").agg(
        F.median("rank").alias("bootstrap_median_rank"), F.percentile("rank", 0.05).alias("bootstrap_p5_rank"), F.percentile("rank", 0.95).alias("bootstrap_p95_rank"),
        top(1).alias("bootstrap_p_top1"), top(2).alias("bootstrap_p_top2"), top(3).alias("bootstrap_p_top3"),
    )
    return out.join(drawn, "channel", "left")


def with_credit(credits: DataFrame) -> DataFrame:
    """Scenarios in which some channel has a share."""
    return credits.withColumn("__all", F.sum(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0))).over(Window.partitionBy("scenario"))).where("__all > 0").drop("__all")


def distinct_scenarios(credits: DataFrame) -> int:
    """How many scenarios differ in some share."""
    shares = F.sort_array(F.collect_list(F.struct("channel", F.round("share", 12).alias("share"))))  # a row a channel
    return credits.groupBy("scenario").agg(shares.alias("shares")).select("shares").distinct().count()


def interpret(decisions: DataFrame) -> str:
    """What the ranks say, in a few sentences."""
    rows = decisions.orderBy("baseline_rank", "channel").collect()  # a row a channel
    first = rows[0].asDict()
    said = [f"{first['channel']} ranks first in {first['p_top1']:.0%} of the scenarios and among the first two in {first['p_top2']:.0%}."]
    if first.get("bootstrap_p_top2") is not None:
        said.append(f"Over bootstrap draws it is among the first two in {first['bootstrap_p_top2']:.0%}.")
    moving = [r["channel"] for r in rows if r["class"] in ("Uncertain", "Fragile")]
    if moving:
        said.append(f"The order of {', '.join(moving[:3])} depends on the assumptions; this analysis alone does not support moving budget among them.")
    return "\n".join([*said, "These are frequencies over tested assumptions, not causal effects."])


@dataclass(frozen=True)
class BootstrapConfig:
    n_iterations: int = 200
    confidence_level: float = 0.90
    random_state: int = 42
    min_converted_journeys: int = 2

    def __post_init__(self):
        if self.n_iterations < 10 or not 0 < self.confidence_level < 1 or self.min_converted_journeys < 1:
            raise ValueError("at least 10 iterations, a level between 0 and 1, and at least one converted journey")


def _times(config: BootstrapConfig) -> Column:
    """How often an iteration draws a journey: Poisson with mean 1, from a hash of journey and iteration."""
    u = F.pmod(F.xxhash64(F.lit(config.random_state), "iteration", "user_id", "seg"), F.lit(1 << 30)) / float(1 << 30)
    chance, total, times = np.exp(-1.0), 0.0, F.lit(0)
    for k in range(1, 9):  # the inverse of the Poisson distribution
        total += chance
        times = times + (u >= float(total)).cast("int")
        chance /= k
    return times


def _each_iteration(rows: DataFrame, config: BootstrapConfig) -> DataFrame:
    every = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(config.n_iterations))).alias("iteration"))
    return every.withColumn("times", _times(config)).where("times > 0")


def bootstrap_draws(journeys: DataFrame, models: list[str], config: BootstrapConfig | None = None) -> DataFrame:
    """iteration, model, channel, share, rank.

    Journeys are resampled with replacement by Poisson counts that a hash of journey and iteration gives, so a draw needs no driver,
    is the same whatever the partitioning, and grows as journeys times iterations only in a map-side sum. A Markov chain's edges are
    summed by iteration in the same way, and each iteration's chain is solved in a group of its own.
    """
    config = config or BootstrapConfig()
    summed = None
    for m in models:
        if m == "markov":
            counted = _each_iteration(steps(journeys), config).groupBy("iteration", "src", "dst").agg(F.sum("times").alias("cnt"))
            edges = counted.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("iteration", "src")))
            one = chain_effects(edges, ["iteration"]).select("iteration", "channel", F.col("share").alias("credit"))
        else:
            one = _each_iteration(_journey_credit(journeys, m), config).groupBy("iteration", "channel").agg(F.sum(F.col("times") * F.col("credit")).alias("credit"))
        one = one.withColumn("model", F.lit(m))
        summed = one if summed is None else summed.unionByName(one)
    each = Window.partitionBy("iteration", "model")
    iterations = journeys.sparkSession.range(1, config.n_iterations + 1).select(F.col("id").cast("int").alias("iteration"))
    grid = summed.select("model", "channel").distinct().join(F.broadcast(iterations))  # a channel that a draw misses has share 0 there
    filled = grid.join(summed, ["iteration", "model", "channel"], "left").fillna(0.0, ["credit"])
    shares = filled.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("credit"), F.sum("credit").over(each)), F.lit(0.0)), 12))
    return shares.withColumn("rank", F.rank().over(each.orderBy(F.desc("share")))).select("iteration", "model", "channel", "share", "rank")


def _journey_credit(journeys: DataFrame, model: str) -> DataFrame:
    journey = Window.partitionBy("user_id", "seg")
    weighed = journeys.where("converted").withColumn("w", RULES[model]())
    return weighed.withColumn("credit", F.col("w") / F.sum("w").over(journey) * F.col("value")).groupBy("user_id", "seg", "channel").agg(F.sum("credit").alias("credit"))


def bootstrap_statistics(draws: DataFrame, level: float = 0.90) -> DataFrame:
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    top = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return draws.groupBy("model", "channel").agg(
        F.avg("share").alias("mean"), F.median("share").alias("median"), F.stddev_samp("share").alias("std"), F.percentile("share", low).alias("low"), F.percentile("share", high).alias("high"),
        F.median("rank").alias("median_rank"), F.percentile("rank", low).alias("low_rank"), F.percentile("rank", high).alias("high_rank"), top(1).alias("p_top1"), top(2).alias("p_top2"), top(3).alias("p_top3"),
    )


@dataclass(frozen=True)
class BootstrapResult:
    status: str  # evaluated or insufficient_evidence
    reason: str | None
    config: BootstrapConfig
    statistics: DataFrame | None = None
    draws: DataFrame | None = None

    @property
    def evaluated(self) -> bool:
        return self.status == "evaluated"


def bootstrap(journeys: DataFrame, models: list[str], config: BootstrapConfig | None = None) -> BootstrapResult:
    """Draws and their statistics, or why there are none."""
    config = config or BootstrapConfig()
    if not models:
        return BootstrapResult("insufficient_evidence", "no attribution model is given", config)
    got = paths(journeys).agg(F.count(F.lit(1)).alias("n"), F.count_if("converted").alias("won")).first()
    if got["n"] < 3 or got["won"] < config.min_converted_journeys:
        return BootstrapResult("insufficient_evidence", f"{got['n']} journeys, {got['won']} of them converted; at least 3 and {config.min_converted_journeys} are needed", config)
    draws = bootstrap_draws(journeys, models, config)
    return BootstrapResult("evaluated", None, config, bootstrap_statistics(draws, config.confidence_level), draws)


def custom_credit(journeys: DataFrame, weight: Column) -> DataFrame:
    """A user-defined model: any weight expression over pos, n, channel, timestamp, end_ts."""
    return credit(journeys, weight)


def frame_of(spark: SparkSession, shares: dict[str, dict[str, float]]) -> DataFrame:
    """Scenario shares given by hand, as a credit table."""
    return spark.createDataFrame([(s, c, float(v)) for s, m in shares.items() for c, v in m.items()], "scenario string, channel string, share double")
