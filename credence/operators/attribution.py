"""Rule-based credit and the absorbing Markov chain, keyed by any scenario columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.stats import share

START, CONVERSION, NULL, OTHER = "START", "CONVERSION", "NULL", "__OTHER__"
ATTRIBUTION_COLUMNS = ("channel", "attribution_credit", "share", "conversions")


class AttributionError(ValueError):
    """A model that cannot give credit."""


#: Weight of a touch by its place; weights of a journey are normalised to 1.
RULES: dict[str, Callable[[], Column]] = {
    "first_touch": lambda: (F.col("pos") == 1).cast("double"),
    "last_touch": lambda: (F.col("pos") == F.col("n")).cast("double"),
    "linear": lambda: F.lit(1.0),
}


def credit(journeys: DataFrame, weight: Column, by: list[str] | None = None) -> DataFrame:
    """Any rule model: ``weight`` is an expression over pos, n, channel, timestamp and end_ts."""
    by = by or []
    journey = Window.partitionBy(*by, "user_id", "seg")
    weighed = journeys.where("converted").withColumn("w", weight).withColumn("w", share(F.col("w"), F.sum("w").over(journey)))
    summed = weighed.where("w > 0").groupBy(*by, "channel").agg(F.sum(F.col("w") * F.col("value")).alias("attribution_credit"), F.sum("w").alias("conversions"))
    total = F.sum("attribution_credit").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return summed.select(*by, "channel", "attribution_credit", share(F.col("attribution_credit"), total).alias("share"), "conversions")


def steps(journeys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a step of each journey, START and the absorbing end included: user_id, seg, src, dst."""
    by = by or []
    order = Window.partitionBy(*by, "user_id", "seg").orderBy("pos")
    end = F.when(F.col("converted"), F.lit(CONVERSION)).otherwise(F.lit(NULL))
    after = journeys.select(*by, "user_id", "seg", F.col("channel").alias("src"), F.coalesce(F.lead("channel").over(order), end).alias("dst"), "pos")
    first = after.where("pos = 1").select(*by, "user_id", "seg", F.lit(START).alias("src"), F.col("src").alias("dst"))
    return after.drop("pos").unionByName(first)


def transitions(journeys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges of the chain of all journeys: src, dst, cnt, prob."""
    by = by or []
    counted = steps(journeys, by).groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*by, "src")))


def collapse(journeys: DataFrame, max_channels: int) -> DataFrame:
    """Keep the ``max_channels - 1`` channels with most touches; the others become one."""
    if max_channels < 2:
        raise AttributionError("max_channels must be at least 2")
    counted = journeys.groupBy("channel").agg(F.count(F.lit(1)).alias("touches"), F.min(F.struct("timestamp", "row_id")).alias("seen"))
    kept = counted.orderBy(F.desc("touches"), "seen").limit(max_channels - 1).select("channel", F.lit(True).alias("kept"))
    if counted.count() <= max_channels:
        return journeys
    return journeys.join(F.broadcast(kept), "channel", "left").withColumn("channel", F.when(F.col("kept"), F.col("channel")).otherwise(F.lit(OTHER))).drop("kept")


def _absorbed(states: list[str], p: np.ndarray) -> float:
    """Chance of ending in CONVERSION from START; p is over [START, channels, CONVERSION, NULL]."""
    k = len(states) - 2
    q, r = p[:k, :k], p[:k, k]
    try:
        x = np.linalg.solve(np.eye(k) - q, r)
    except np.linalg.LinAlgError:
        x = np.linalg.lstsq(np.eye(k) - q, r, rcond=None)[0]
    return float(np.clip(x[0], 0, 1))


def solve_chain(edges: pd.DataFrame, strategy: str = "reconnect") -> pd.DataFrame:
    """Conversion probability with and without each channel, removal effects and shares, from one chain's edges."""
    src, dst = edges["src"], edges["dst"]
    if (src.isin([CONVERSION, NULL]) | (dst == START) | ((src == START) & dst.isin([CONVERSION, NULL]))).any():
        raise AttributionError("a channel has the name of a state")
    channels = sorted((set(edges["src"]) | set(edges["dst"])) - {START, CONVERSION, NULL})
    states = [START, *channels, CONVERSION, NULL]
    at = {s: i for i, s in enumerate(states)}
    p = np.zeros((len(states), len(states)))
    p[[at[s] for s in edges["src"]], [at[d] for d in edges["dst"]]] = edges["prob"]
    base = _absorbed(states, p)
    rows = []
    if strategy == "redirect_to_null":  # what visits a channel is lost with it: one inverse serves all channels
        live = len(states) - 2
        try:
            visits = np.linalg.inv(np.eye(live) - p[:live, :live])
        except np.linalg.LinAlgError:
            visits = None
        if visits is not None:
            won = visits @ p[:live, live]
            lost = visits[0] / np.diag(visits) * won
            for i, c in enumerate(channels, 1):
                without = float(np.clip(won[0] - lost[i], 0, 1))
                rows.append((c, base, without, max(0.0, 1 - without / base) if base else 0.0))
    for c in channels if not rows else ():
        keep = [i for i, s in enumerate(states) if s != c]
        q = p[np.ix_(keep, keep)].copy()
        live = len(keep) - 2
        mass = q[:live].sum(axis=1)
        if strategy == "redirect_to_null":
            q[:live, -1] += 1 - mass
        else:
            q[:live][mass > 0] /= mass[mass > 0][:, None]
            q[:live, -1][mass <= 0] = 1
        without = _absorbed([states[i] for i in keep], q)
        rows.append((c, base, without, max(0.0, 1 - without / base) if base else 0.0))
    out = pd.DataFrame(rows, columns=["channel", "baseline", "without", "effect"])
    total = out["effect"].sum()
    out["share"] = out["effect"] / total if total else 1 / max(1, len(out))
    return out


def markov_effects(journeys: DataFrame, by: list[str] | None = None, strategy: str = "reconnect", max_channels: int | None = None) -> DataFrame:
    """channel, baseline, without, effect, share for each scenario. A chain has at most channels squared edges, one group each."""
    if strategy not in ("reconnect", "redirect_to_null"):
        raise AttributionError(f"unknown removal strategy {strategy!r}")
    by = by or []
    if max_channels:
        journeys = collapse(journeys, max_channels)
    return chain_effects(transitions(journeys, by), by, strategy)


def chain_effects(edges: DataFrame, by: list[str], strategy: str = "reconnect") -> DataFrame:
    """The effects of edges that are counted already."""
    keys = by or ["__all"]
    edges = edges if by else edges.withColumn("__all", F.lit(0))
    kinds = ", ".join(f"{k} {dict(edges.dtypes)[k]}" for k in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve_chain(pdf, strategy)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    solved = edges.groupBy(*keys).applyInPandas(solve, f"{kinds}, channel string, baseline double, without double, effect double, share double")
    return solved if by else solved.drop("__all")


def markov(journeys: DataFrame, by: list[str] | None = None, strategy: str = "reconnect", max_channels: int | None = None) -> DataFrame:
    """Credit by removal effects; channels without effect are listed with none."""
    by = by or []
    won = journeys.where("converted and pos = 1")
    totals = won.groupBy(*by).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    effects = markov_effects(journeys, by, strategy, max_channels)
    joined = effects.join(totals, by) if by else effects.join(F.broadcast(totals))
    return joined.select(*by, "channel", (F.col("share") * F.col("total")).alias("attribution_credit"), "share", (F.col("share") * F.col("n")).alias("conversions"))


def resolve(model: str) -> str:
    name = model.strip().lower().replace(" ", "_").replace("-", "_")
    name = {"markov_chain": "markov", "first": "first_touch", "last": "last_touch"}.get(name, name)
    if name not in (*RULES, "markov"):
        raise AttributionError(f"unknown model {model!r}")
    return name


def attribute(journeys: DataFrame, model: str | Callable[[], Column], by: list[str] | None = None) -> DataFrame:
    """Credit by a model's name, or by a function that gives a weight expression."""
    if callable(model):
        return credit(journeys, model(), by)
    name = resolve(model)
    return markov(journeys, by) if name == "markov" else credit(journeys, RULES[name](), by)


def _rule_credits(journeys: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    """All rule models in one aggregate, a weight column each, then one row a model and channel."""
    journey = Window.partitionBy(*by, "user_id", "seg")
    weighed = journeys.where("converted").select(*by, "channel", "value", "user_id", "seg", *(RULES[m]().alias(f"w{i}") for i, m in enumerate(models)))
    shares = [share(F.col(f"w{i}"), F.sum(f"w{i}").over(journey)).alias(f"w{i}") for i in range(len(models))]
    totals = [x for i in range(len(models)) for x in (F.sum(F.col(f"w{i}") * F.col("value")).alias(f"credit{i}"), F.sum(f"w{i}").alias(f"n{i}"))]
    summed = weighed.select(*by, "channel", "value", *shares).groupBy(*by, "channel").agg(*totals)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"credit{i}").alias("attribution_credit"), F.col(f"n{i}").alias("conversions")) for i, m in enumerate(models)]))
    rows = summed.select(*by, "channel", each.alias("x")).select(*by, "channel", "x.*").where("conversions > 0")
    total = F.sum("attribution_credit").over(Window.partitionBy(*by, "model"))
    return rows.select(*by, "channel", "attribution_credit", share(F.col("attribution_credit"), total).alias("share"), "conversions", "model")


def attribute_all(journeys: DataFrame, models: list[str], by: list[str] | None = None) -> DataFrame:
    """One table for all models, with the model as a column; rule models share one pass."""
    names = list(dict.fromkeys(resolve(m) for m in models))
    rules = [m for m in names if m in RULES]
    out = _rule_credits(journeys, rules, by or []) if rules else None
    if "markov" in names:
        chain = markov(journeys, by).withColumn("model", F.lit("markov"))
        out = chain if out is None else out.unionByName(chain)
    return out
