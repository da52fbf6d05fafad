"""Synthetic event streams: seeded per user, so the result does not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "user_id string, timestamp timestamp, channel string, conversion boolean, conversion_value double"
_ORIGIN = pd.Timestamp("2024-01-01")


def _per_user(spark: SparkSession, users: int, make, seed: int, schema: str = EVENT) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in frames:
            rows = [r for i in ids["id"].tolist() for r in make(i, np.random.default_rng([seed, i]))]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return spark.range(users).mapInPandas(run, schema).withColumn("row_id", F.monotonically_increasing_id())


def simulate_brand_exposures(spark: SparkSession, users: int = 200, days: int = 5, brands: int = 2, positions: int = 2, mean_impressions: float = 1.5, seed: int = 42) -> DataFrame:
    """Poisson exposures a day; a decaying hidden state decides each day's conversion."""
    pull = np.random.default_rng(seed).normal(0.3, 0.2, (brands, positions))

    def make(i: int, rng: np.random.Generator):
        state = 0.0
        for day in range(days):
            shown = rng.poisson(mean_impressions, (brands, positions))
            state = 0.6 * state + float((shown * pull).sum())
            minute = 0
            for b, p in np.argwhere(shown > 0):
                minute += 1
                yield f"u{i}", _ORIGIN + pd.Timedelta(days=day, minutes=minute), f"brand{b}_pos{p}", False, 0.0
            if minute and rng.random() < 1 / (1 + np.exp(3 - state)):
                yield f"u{i}", _ORIGIN + pd.Timedelta(days=day, hours=12), f"brand{b}_pos{p}", True, 1.0

    return _per_user(spark, users, make, seed)


def simulate_trigger_labels(spark: SparkSession, users: int = 400, alpha_a: float = 0.2, alpha_b: float = 0.0, leave: float = 0.25, share_a: float = 0.5, steps: int = 16, seed: int = 42) -> DataFrame:
    """Two kinds of touch with known conversion chances; ``true_trigger_channel`` is what caused a conversion."""

    def make(i: int, rng: np.random.Generator):
        for step in range(steps):
            kind = "type_a" if rng.random() < share_a else "type_b"
            won = bool(rng.random() < (alpha_a if kind == "type_a" else alpha_b))
            yield f"u{i}", _ORIGIN + pd.Timedelta(hours=step), kind, won, float(won), kind if won else None
            if won or rng.random() < leave:
                return

    return _per_user(spark, users, make, seed, EVENT + ", true_trigger_channel string")


def simulate_touch_sequences(spark: SparkSession, users: int = 300, mean_touches: float = 4.0, channels: tuple[str, ...] = ("search", "social", "email", "display", "direct"), seed: int = 42) -> DataFrame:
    """A Poisson number of touches a user; the last may convert."""

    def make(i: int, rng: np.random.Generator):
        n = max(1, int(rng.poisson(mean_touches)))
        won = bool(rng.random() < min(0.9, 0.1 * n))
        for step in range(n):
            last = won and step == n - 1
            yield f"u{i}", _ORIGIN + pd.Timedelta(days=step), str(rng.choice(channels)), last, float(rng.gamma(2.0, 30.0)) if last else 0.0

    return _per_user(spark, users, make, seed)


#: Scenario -> (days between touches, [(path, converts, users)]).
STRESS = {
    "stable_dominant": (1, [("search,search", True, 80), ("display,search", True, 10), ("social", False, 20)]),
    "window_sensitive": (20, [("social,search", True, 70), ("email", True, 20), ("display", False, 20)]),
    "identity_fragmentation": (1, [("social,display,search", True, 60), ("email,search", True, 20), ("social,display", False, 20)]),
    "duplicate_contamination": (1, [("display,search", True, 30), ("email,search", True, 30)]),
    "model_disagreement": (1, [("social,display,search", True, 60), ("email,search", True, 20), ("display,email", False, 30)]),
    "noise_without_decision_change": (1, [("*,search,search", True, 100), ("*", False, 30)]),
}


#: What a ``*`` is drawn from, and what each scenario is for and expected to show.
MINOR = ("display", "social", "email")
PURPOSE = {
    "stable_dominant": "One channel leads under every model.",
    "window_sensitive": "Long gaps between touches make credit depend on the window.",
    "identity_fragmentation": "Long journeys, whose credit moves when ids are split.",
    "duplicate_contamination": "Exact copies of one channel's touches should be found.",
    "model_disagreement": "Models favour different places in the journey.",
    "noise_without_decision_change": "Noise in minor channels should not unseat the leader.",
}
EXPECTED = {
    "stable_dominant": ("robust leader", "high agreement of models"),
    "window_sensitive": ("shares move with the window", "low window stability"),
    "identity_fragmentation": ("share drift under identity loss",),
    "duplicate_contamination": ("finding of duplicates", "lower data quality", "shares move after removing copies"),
    "model_disagreement": ("low agreement of models", "ranks that move"),
    "noise_without_decision_change": ("some movement of measures", "robust leader"),
}


def stress_scenario(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    """One of six deterministic data sets with a known weakness."""
    if name not in STRESS:
        raise ValueError(f"unknown scenario {name!r}; use one of {sorted(STRESS)}")
    gap, listed = STRESS[name]
    rng, rows, user = np.random.default_rng(seed), [], 0
    for path, won, users in listed:
        for _ in range(users):
            touches = [str(rng.choice(MINOR)) if c == "*" else c for c in path.split(",")]
            end = pd.Timestamp("2026-01-01") + pd.Timedelta(days=int(user % 35 + len(touches) * gap))
            for i, c in enumerate(touches):
                last = won and i == len(touches) - 1
                row = (f"u{user}", (end - pd.Timedelta(days=gap * (len(touches) - 1 - i))).to_pydatetime(), c, last, float(last))
                rows += [row] * (3 if name == "duplicate_contamination" and c == "display" and not last else 1)
            user += 1
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id long, {EVENT}")
