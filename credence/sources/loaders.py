"""Public attribution data sets from files that are there, as canonical events. Nothing is downloaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from credence.sources import adapters

LOG_FILES = ["impression_log.tsv.gz", "impression_log.tsv"]


def load_impression_log(spark: SparkSession, path: str | None = None, sample_users: int | None = None, seed: int = 42, nrows: int | None = None) -> DataFrame:
    """The log at ``path``, at ``CREDENCE_IMPRESSION_LOG``, or in ``./data``. ``sample_users`` keeps all rows of that many users, ``nrows`` the first rows of the file."""
    found = adapters.resolve_path(path, "CREDENCE_IMPRESSION_LOG", LOG_FILES)
    return adapters.impression_log_events(adapters.read_impression_log(spark, found, nrows), sample_users, seed)


@dataclass(frozen=True)
class ImpressionLog:
    """The arguments of a load, to be carried about."""

    path: str | None = None
    sample_users: int | None = None
    seed: int = 42

    def load(self, spark: SparkSession) -> DataFrame:
        return load_impression_log(spark, self.path, self.sample_users, self.seed)


def load_journey_steps(spark: SparkSession, touchpoints: str | None = None, journeys: str | None = None) -> DataFrame:
    """Touchpoints and journeys, Parquet or CSV, by ``CREDENCE_TOUCHPOINTS`` and ``CREDENCE_JOURNEYS`` or in ``./data``."""
    names = lambda kind: [f"synthetic_{kind}.parquet", f"synthetic_{kind}.csv"]
    steps = adapters.read_table(spark, adapters.resolve_path(touchpoints, "CREDENCE_TOUCHPOINTS", names("touchpoints")))
    return adapters.journey_steps_events(steps, adapters.read_table(spark, adapters.resolve_path(journeys, "CREDENCE_JOURNEYS", names("journeys"))))


def load_funnel(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A table of journey touches with flags of the whole journey."""
    return adapters.funnel_events(adapters.read_table(spark, adapters.resolve_path(path, "CREDENCE_FUNNEL", ["funnel_touchpoints.csv", "funnel_touchpoints.parquet"])))


def load_daily_touches(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A table of dated touches with flags of their own."""
    return adapters.daily_touch_events(adapters.read_table(spark, adapters.resolve_path(path, "CREDENCE_DAILY_TOUCHES", ["daily_touches.csv", "daily_touches.parquet"])))


def describe_sampling(sample_users: int | None, loaded_users: int, of: str = "all users of the file") -> str:
    """One sentence for a report: what part of the data was read."""
    if sample_users is None:
        return f"All rows that were read are used: {loaded_users} users."
    return f"A sample of {loaded_users} users ({sample_users} asked for) out of {of}; shares and rates are estimates."
