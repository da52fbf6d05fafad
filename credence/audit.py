"""The whole audit: checks, simulations, sensitivity, robustness and score as one report."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.durations import positive
from credence.operators import attribution, audits, corruption, duplicates, journeys, quality, robustness
from credence.operators.quality import Finding
from credence.schema import ColumnMapping, validate_events
from credence.scoring import ScoringWeights, component_scores, reliability_score, score_label
from credence.thresholds import ContaminationThresholds, ConversionWindowThresholds, ExposureThresholds, TemporalStabilityThresholds

SEVERITIES = ("PASS", "INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
EVIDENCE = ("evaluated", "insufficient_evidence", "not_applicable")


@dataclass
class CheckResult:
    check: str
    status: str  # one of EVIDENCE
    severity: str
    score: float | None
    findings: list[Finding] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)
    explanation: str | None = None
    scenarios: DataFrame | None = None  # scenario, channel, share: what the check adds to the sensitivity matrix

    @property
    def passed(self) -> bool:
        return not any(SEVERITIES.index(f.severity) >= SEVERITIES.index("HIGH") for f in self.findings)

    def visible_findings(self, minimum: str = "INFO") -> list[Finding]:
        return [f for f in self.findings if SEVERITIES.index(f.severity) >= SEVERITIES.index(minimum)]


#: Every check in the order of the report, and other names by which one may be asked for.
CHECKS = (
    "data_quality", "duplicates", "model_disagreement", "path_sparsity", "channel_concentration", "conversion_window", "converter_contamination", "model_stability", "exposure_comparison",
    "identity_loss", "touchpoint_loss", "event_loss", "markov_identification",
)
ALIASES = {
    "quality": "data_quality", "duplicate": "duplicates", "sparsity": "path_sparsity", "concentration": "channel_concentration", "window": "conversion_window", "contamination": "converter_contamination",
    "delayed_converter_contamination": "converter_contamination", "converter_exposure": "exposure_comparison", "stability": "model_stability", "temporal_stability": "model_stability", "exposure": "exposure_comparison", "disagreement": "model_disagreement", "identification": "markov_identification",
}
AT_ONCE = 4


def resolve_check(name: str) -> str:
    """A check's own name."""
    key = name.strip().lower().replace(" ", "_").replace("-", "_")
    key = ALIASES.get(key, key)
    if key not in CHECKS:
        raise ValueError(f"unknown check {name!r}; use some of {sorted(CHECKS)}")
    return key


def severity_of(name: str) -> str:
    """A severity's own name."""
    if str(name).strip().upper() not in SEVERITIES:
        raise ValueError(f"unknown severity {name!r}; use one of {SEVERITIES}")
    return str(name).strip().upper()


def _clean(x):
    if isinstance(x, dict):
        return {str(k): _clean(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_clean(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, str | int | float | bool | type(None)) else str(x)


@dataclass
class AuditReport:
    results: list[CheckResult]
    score: float | None
    label: str
    components: dict[str, float]
    attribution: DataFrame
    sensitivity: DataFrame | None = None
    robustness: DataFrame | None = None
    bootstrap: robustness.BootstrapResult | None = None
    minimum_severity: str = "INFO"
    journey_summary: dict = field(default_factory=dict)
    markov_identified: bool | None = None
    channel_grain: str = "channel"
    sensitivity_status: str = "evaluated"
    interpretation: str = ""
    sample_info: dict | None = None
    cached: list[DataFrame] = field(default_factory=list)

    def unpersist(self) -> None:
        """Free what the audit has kept in memory; the report's tables are computed anew if they are read after that."""
        for table in self.cached:
            table.unpersist()

    @property
    def findings(self) -> list[Finding]:
        return [f for r in self.results for f in r.visible_findings(self.minimum_severity)]

    def result(self, check: str) -> CheckResult:
        """The result of one check, which must have run."""
        name = resolve_check(check)
        for r in self.results:
            if r.check == name:
                return r
        raise ValueError(f"check {name!r} has not run")

    def rows(self) -> list[tuple]:
        """A row a finding, of checks that pass, too."""
        out = []
        for r in self.results:
            for f in r.findings or [Finding("pass", "PASS", "no findings")]:
                value = None if f.value is None else float(f.value)
                details = json.dumps(_clean(f.details), allow_nan=False)
                out.append((r.check, r.status, r.severity, r.score, f.code, f.severity, f.message, f.count, f.metric_name, value, details, f.recommendation, r.explanation, self.score))
        return out

    def to_dataframe(self, spark) -> DataFrame:
        kinds = "check string, status string, severity string, score double, code string, finding_severity string, message string, count long, metric_name string, metric_value double, details string, recommendation string, explanation string, report_score double"
        return spark.createDataFrame(self.rows(), kinds)

    @staticmethod
    def _table(frame: DataFrame | None) -> list[dict] | None:
        return None if frame is None else [r.asDict() for r in frame.collect()]  # a row a channel and model, scenario or draw

    def to_dict(self, include_bootstrap_draws: bool = False) -> dict:
        drawn = self.bootstrap
        uncertainty = None
        if drawn is not None:
            uncertainty = {"status": drawn.status, "reason": drawn.reason, "config": asdict(drawn.config), "statistics": self._table(drawn.statistics)}
            if include_bootstrap_draws:
                uncertainty["draws"] = self._table(drawn.draws)
        checks = [{"check": r.check, "status": r.status, "severity": r.severity, "score": r.score, "explanation": r.explanation, "metrics": r.metrics, "findings": [vars(f) for f in r.findings]} for r in self.results]
        return _clean({
            "score": self.score, "label": self.label, "components": self.components, "minimum_severity": self.minimum_severity, "journey_summary": self.journey_summary, "checks": checks,
            "attribution": self._table(self.attribution), "markov_identified": self.markov_identified, "channel_grain": self.channel_grain, "bootstrap": uncertainty,
            "sensitivity": {"status": self.sensitivity_status, "matrix": self._table(self.sensitivity)}, "decision_robustness": {"interpretation": self.interpretation, "channels": self._table(self.robustness)}, "sample_info": self.sample_info,
        })

    def to_json(self, indent: int | None = 2, include_bootstrap_draws: bool = False) -> str:
        return json.dumps(self.to_dict(include_bootstrap_draws), indent=indent, allow_nan=False)

    def save(self, folder: str) -> None:
        """findings, attribution, sensitivity and robustness as CSV, and the report as JSON, below a folder that Spark can write."""
        spark = self.attribution.sparkSession
        tables = {"findings": self.to_dataframe(spark), "attribution": self.attribution, "sensitivity": self.sensitivity, "robustness": self.robustness}
        for name, table in tables.items():
            if table is not None:
                table.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)  # a row a finding, or a channel and scenario
        spark.createDataFrame([(self.to_json(None),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")

    def sensitivity_matrix(self, metric: str = "rank") -> DataFrame | None:
        """Channels by scenario."""
        if metric not in ("rank", "share"):
            raise ValueError("metric is rank or share")
        return None if self.sensitivity is None else self.sensitivity.groupBy("channel").pivot("scenario").agg(F.first(metric))

    def sections(self) -> list[tuple[str, list[str]]]:
        """The report in parts: heading and lines."""
        seen = self.findings
        counts = {s: sum(f.severity == s for f in seen) for s in SEVERITIES if s != "PASS"}
        markov = {True: "identified", False: "not identified", None: "not evaluated"}[self.markov_identified]
        out = [
            ("Score", [f"{self.label}" + ("" if self.score is None else f" ({self.score:.1f} of 100)")]),
            ("Components", [f"{k.replace('_', ' ')}: {v:.1f}" for k, v in self.components.items()]),
            ("Checks", [f"{r.check}: {r.status}, {r.severity.lower()}" + ("" if r.score is None else f", {r.score:.1f}") for r in self.results]),
            ("Findings", [", ".join(f"{k.lower()} {n}" for k, n in counts.items()), *(f"{f.severity.lower()}: {f.message}" for f in seen)]),
            ("Markov removal effects", [markov]),
            ("Channel grain", [self.channel_grain]),
            ("Insufficient evidence", [f"{r.check}: {r.explanation or 'not enough evidence'}" for r in self.results if r.status == "insufficient_evidence"]),
            ("Bootstrap", [] if self.bootstrap is None else [self.bootstrap.status + ("" if self.bootstrap.reason is None else f": {self.bootstrap.reason}")]),
            ("Decision robustness", self.interpretation.splitlines()),
            ("Sample", [] if not self.sample_info else [f"{k}: {v}" for k, v in self.sample_info.items()]),
            ("Recommendations", list(dict.fromkeys(f.recommendation for f in seen if f.recommendation)) or ["none"]),
        ]
        return [(name, lines) for name, lines in out if lines]

    def summary(self) -> str:
        return "\n".join(["Reliability report", *(line for name, lines in self.sections() for line in (f"{name}:", *(f"- {x}" for x in lines)))])

    def to_markdown(self, most: int = 50) -> str:
        """All sections, and a table of the first ``most`` findings."""
        cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
        lines = ["# Attribution reliability", ""]
        for name, said in self.sections():
            lines += [f"## {name}", "", *(f"- {x}" for x in said), ""]
        lines += ["## All findings", "", "| check | status | severity | score | finding | message |", "|---|---|---|---|---|---|"]
        for check, status, severity, score, code, _, message, *_ in self.rows()[:most]:
            lines.append("| " + " | ".join(cell(x) for x in (check, status, severity, score, code, message)) + " |")
        return "\n".join(lines) + "\n"

    def to_html(self) -> str:
        parts = "".join(f"<h2>{html.escape(name)}</h2><ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in lines) + "</ul>" for name, lines in self.sections())
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if c is None else f'{c:.4g}' if isinstance(c, float) else str(c))}</td>" for c in row) + "</tr>" for row in self.rows())
        return f"<!doctype html><meta charset='utf-8'><title>Attribution reliability</title><h1>{html.escape(self.label)}</h1>{parts}<table>{body}</table>"

    def _figure(self, path: str, draw: Callable) -> None:
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise ImportError("plots need matplotlib") from e
        figure, axes = plt.subplots(figsize=(8, 4))
        draw(axes)
        figure.tight_layout()
        figure.savefig(path)
        plt.close(figure)

    def _pivot(self, prefix: str):
        shares = self.sensitivity.where(F.col("scenario").startswith(prefix)).toPandas()  # channels by windows or periods
        return shares.assign(scenario=shares["scenario"].str.removeprefix(prefix)).pivot(index="scenario", columns="channel", values="share")

    def plot_scorecard(self, path: str) -> None:
        scored = {r.check: r.score for r in self.results if r.score is not None}
        self._figure(path, lambda axes: (axes.barh(list(scored), list(scored.values())), axes.set_xlim(0, 100)))

    def plot_model_comparison(self, path: str) -> None:
        shares = self.attribution.toPandas().pivot(index="channel", columns="model", values="share").fillna(0)
        self._figure(path, lambda axes: shares.plot.bar(ax=axes))

    def plot_window_sensitivity(self, path: str) -> None:
        self.result("conversion_window")
        shares = self._pivot("conversion_window:")
        shares = shares.loc[sorted(shares.index, key=lambda x: float(x.rstrip("D")))]
        self._figure(path, lambda axes: shares.plot(ax=axes, marker="o"))

    def plot_channel_volatility(self, path: str, check: str = "model_stability") -> None:
        """Widest difference of each channel's share over windows or periods."""
        shares = self._pivot(f"{self.result(check).check}:")
        self._figure(path, lambda axes: (shares.max() - shares.min()).sort_values().plot.barh(ax=axes))


def _found(check: str, severity: str, score: float, message: str, metric: str, value, metrics: dict, advice: str, count: int = 0, thresholds=None, scenarios: DataFrame | None = None) -> CheckResult:
    """A check with one finding; advice goes with what doesn't pass."""
    limits = {} if thresholds is None else {"thresholds": asdict(thresholds)}
    finding = Finding(check, severity, message, count, limits, metric, value, None if severity == "PASS" else advice)
    return CheckResult(check, "evaluated", severity, score, [finding], metrics | limits, None, scenarios)


def _unknown(check: str, reason: str, metric: str, value=None, severity: str = "INFO", status: str = "insufficient_evidence", metrics: dict | None = None) -> CheckResult:
    return CheckResult(check, status, severity, None, [Finding(check, severity, reason, 0, {}, metric, value)], metrics or {}, reason)


def _kept(table: DataFrame) -> DataFrame:
    """A credit table (a row a channel, model and scenario) as it is now, so that what follows doesn't build journeys again."""
    return table.sparkSession.createDataFrame(table.toArrow())


def _mean_length(touches: DataFrame) -> float:
    got = touches.agg(F.count(F.lit(1)).alias("touches"), F.count_if(F.col("pos") == 1).alias("journeys")).first()
    return got["touches"] / got["journeys"] if got["journeys"] else 0.0


def _window_name(us) -> str:
    return f"{us / 86_400_000_000:g}D"


class ReliabilityAudit:
    """Runs the checks over an event frame. The last model drives the window and period checks.

    Each ``check_`` and ``simulate`` method also runs by itself; tables that ``run`` has at hand are given to them.
    """

    def __init__(self, events: DataFrame | None = None, columns: ColumnMapping | dict | None = None, lookback_window="30D", conversion_window=None, models: Iterable[str] = ("first_touch", "last_touch", "linear"), weights: ScoringWeights | Mapping | None = None,
                 include_non_converters: bool = True, minimum_severity: str = "INFO", sample_info: dict | None = None, **named):
        """``named``: columns by argument, such as ``user_id_col``, instead of ``columns``."""
        strange = [k for k in named if not k.endswith("_col")]
        if strange:
            raise TypeError(f"unknown arguments: {strange}")
        if named and columns is not None:
            raise ValueError("give columns or single column arguments, not both")
        short = {"user": "user_id"}
        given = {short.get(k.removesuffix("_col"), k.removesuffix("_col")): v for k, v in named.items() if v is not None}
        self.events, self.columns, self.lookback, self.window = events, ColumnMapping.of(given or columns), lookback_window, conversion_window
        self.models, self.weights = self._models(models), ScoringWeights.of(weights)
        self.non_converters, self.minimum_severity, self.sample_info = include_non_converters, severity_of(minimum_severity), sample_info

    @staticmethod
    def _models(models: Iterable[str] | str) -> list[str]:
        names = [attribution.resolve(m) for m in ([models] if isinstance(models, str) else models)]
        if not names or len(set(names)) != len(names):
            raise ValueError("models must be given, each once")
        return names

    def _source(self, events: DataFrame | None = None) -> DataFrame:
        found = events if events is not None else self.events
        if found is None:
            raise ValueError("give events to the audit or to the method")
        return found

    def _frame(self, frame: DataFrame | None) -> DataFrame:
        return frame if frame is not None else validate_events(self._source(), self.columns)[0]

    def _journeys(self, frame: DataFrame) -> DataFrame:
        return journeys.build_journeys(frame, self.lookback, self.window, self.non_converters)

    def _touches(self, touches: DataFrame | None) -> DataFrame:
        return touches if touches is not None else self._journeys(self._frame(None))

    def check_data_quality(self, events: DataFrame | None = None) -> CheckResult:
        found = quality.quality_findings(self._source(events), self.columns)
        return CheckResult("data_quality", "evaluated", max((f.severity for f in found), key=SEVERITIES.index, default="PASS"), quality.score(found), found, {"deductions": quality.deductions(found)})

    def check_duplicates(self, events: DataFrame | None = None) -> CheckResult:
        found = duplicates.duplicate_findings(self._source(events), self.columns)
        return CheckResult("duplicates", "evaluated", max((f.severity for f in found), key=SEVERITIES.index, default="PASS"), quality.score(found), found, {"deductions": quality.deductions(found)})

    def check_conversion_window(self, frame: DataFrame | None = None, windows=(7, 14, 30), model: str | None = None, thresholds: ConversionWindowThresholds | None = None) -> CheckResult:
        limits, model = thresholds or ConversionWindowThresholds(), attribution.resolve(model or self.models[-1])
        if not windows:
            raise ValueError("windows must be given")
        if len({positive(w) for w in windows}) < 2:
            return _unknown("conversion_window", "at least two different windows are needed", "window_count", 1)
        credits = _kept(audits.window_credits(self._frame(frame), windows, model, self.lookback))
        rhos = {f"{_window_name(r['a'])}__{_window_name(r['b'])}": r["spearman"] for r in audits.rank_correlations(credits).collect()}
        ranges = audits.scenario_grid(credits).groupBy("channel").agg((F.max("share") - F.min("share")).alias("shares"), (F.max("rank") - F.min("rank")).alias("ranks")).collect()  # a row a channel
        risky = sorted(r["channel"] for r in ranges if r["shares"] >= limits.high_risk_share_change or r["ranks"] >= limits.high_risk_rank_change)
        volatility, rho = max((r["shares"] for r in ranges), default=0.0), min(rhos.values(), default=1.0)
        if rho < limits.high_spearman or volatility >= limits.high_share_volatility:
            severity = "HIGH"
        elif rho < limits.low_spearman or volatility >= limits.share_volatility:
            severity = "MEDIUM"
        else:
            severity = "LOW" if risky else "PASS"
        score = 100 * min(1.0, max(0.0, 0.5 * (rho + 1) / 2 + 0.5 * (1 - volatility)))
        metrics = {"windows": [_window_name(w) for w in sorted({positive(w) for w in windows})], "model": model, "cross_window_spearman": rhos, "min_spearman": rho, "max_share_volatility": volatility, "high_risk_channels": risky}
        scenarios = credits.select(F.concat(F.lit("conversion_window:"), F.format_string("%sD", F.regexp_replace((F.col("scenario") / 86_400_000_000).cast("string"), r"\.0$", ""))).alias("scenario"), "channel", "share")
        message = f"over {len(metrics['windows'])} windows ranks correlate {rho:.3f} at least and a share moves by {volatility:.1%} at most"
        return _found("conversion_window", severity, score, message, "max_share_volatility", volatility, metrics, "Look at the channels at risk and give reasons for the window in use.", len(risky), limits, scenarios)

    def check_contamination(self, frame: DataFrame | None = None, short_window=7, reference_window=30, thresholds: ContaminationThresholds | None = None, exposure: Callable[[], dict] | None = None) -> CheckResult:
        limits, frame = thresholds or ContaminationThresholds(), self._frame(frame)
        users = audits.contamination_users(frame, short_window, reference_window).persist()
        got = audits.count_classes(users).first().asDict()
        won = got["short"] + got["delayed"] + got["post"]
        rate = got["delayed_rate"]
        got |= {"observed_converters": won, "delayed_rate_of_converters": got["delayed"] / won if won else 0.0, "exposure": exposure() if exposure else audits.exposure_comparison(frame)}
        got["by_channel"] = [r.asDict() for r in audits.count_classes(users, "first_channel").orderBy("first_channel").collect()]
        if "campaign_id" in frame.columns:
            got["by_campaign"] = [r.asDict() for r in audits.count_classes(users, "first_campaign").where("first_campaign is not null").orderBy("first_campaign").collect()]
        users.unpersist()
        severity = "CRITICAL" if rate >= limits.critical_rate else "HIGH" if rate >= limits.high_rate else "MEDIUM" if rate >= limits.medium_rate else "LOW" if got["delayed"] else "PASS"
        message = f"{got['delayed']} of {got['users']} users ({rate:.1%}) convert after the short window and within the reference window"
        return _found("converter_contamination", severity, 100 * (1 - min(1.0, rate / limits.critical_rate)), message, "delayed_rate", rate, got, "Don't take those without a conversion in the short window for negatives before the reference window has passed.", got["delayed"], limits)

    def check_exposure(self, frame: DataFrame | None = None, thresholds: ExposureThresholds | None = None, exposure: Callable[[], dict] | None = None) -> CheckResult:
        limits, got = thresholds or ExposureThresholds(), exposure() if exposure else audits.exposure_comparison(self._frame(frame))
        tv, ratio = got["channel_distance"], got["ratio"]
        widest = max(ratio, 1 / ratio) if ratio else 1.0
        severity = "MEDIUM" if tv >= limits.high_channel_mix_distance else "LOW" if tv >= limits.channel_mix_distance or widest >= limits.touch_count_ratio else "PASS"
        score = 100 * (1 - max(tv, min(1.0, abs((ratio or 1.0) - 1))))
        return _found("exposure_comparison", severity, score, "converters and others differ in exposure by association only; this is no causal effect", "channel_mix_distance", tv, got, "Read the difference as one of selection or coverage; test increments by a causal design.", 0, limits)

    def check_model_disagreement(self, credits: DataFrame | None = None) -> CheckResult:
        got = audits.agreement(credits if credits is not None else attribution.attribute_all(self._touches(None), self.models))
        if got["models"] < 2:
            return _unknown("model_disagreement", "at least two models are needed", "agreement_score")
        s = got["agreement_score"]
        severity = "PASS" if s >= 80 else "LOW" if s >= 60 else "MEDIUM" if s >= 40 else "HIGH"
        return _found("model_disagreement", severity, s, f"the models agree to {s:.1f} of 100", "agreement_score", s, got, "Look at the channels whose shares depend on the model.")

    def check_path_sparsity(self, touches: DataFrame | None = None) -> CheckResult:
        touches = self._touches(touches)
        got = audits.path_sparsity(touches).first().asDict()
        channels = touches.agg(F.count_distinct("channel")).first()[0]
        share = got["singleton_share"]
        severity = "PASS" if share <= 0.5 else "LOW" if share <= 0.75 else "MEDIUM"
        out = _found("path_sparsity", severity, 100 * (1 - share), f"{share:.1%} of the paths occur once", "singleton_path_ratio", share, got | {"channels": channels}, "Group rare paths or channels before trusting models of whole paths.")
        if channels > 50:
            out.findings.append(Finding("fine_channel_grain", "HIGH", f"{channels} channels: this looks like campaigns", channels, {}, "unique_channels", channels, "Map campaigns to channels."))
            out.severity, out.score = "HIGH", min(out.score, 40.0)
        return out

    def check_concentration(self, touches: DataFrame | None = None, credits: DataFrame | None = None) -> CheckResult:
        touches = self._touches(touches)
        credits = credits if credits is not None else attribution.attribute_all(touches, self.models)
        each = {r["measure"]: {k: r[k] for k in ("hhi", "top1", "top3")} for r in audits.concentration(touches, credits).collect()}  # a row a measure
        top = max((v["hhi"] or 0.0 for v in each.values()), default=0.0)
        severity = "PASS" if top < 0.25 else "LOW" if top < 0.4 else "MEDIUM"
        return _found("channel_concentration", severity, 100 * (1 - top), f"the greatest concentration index is {top:.3f}", "max_hhi", top, {"max_hhi": top, "measures": each}, "See whether the leading channels lead by coverage or by tracking.")

    def check_model_stability(self, touches: DataFrame | None = None, period: str = "W", model: str | None = None, thresholds: TemporalStabilityThresholds | None = None) -> CheckResult:
        limits, model, touches = thresholds or TemporalStabilityThresholds(), attribution.resolve(model or self.models[-1]), self._touches(touches)
        summary = [r.asDict() for r in audits.period_summary(touches, period).orderBy("scenario").collect()]  # a row a period
        if len(summary) < 2:
            return _unknown("model_stability", f"at least two periods are needed, there are {len(summary)}", "period_count", len(summary))
        rates = [r["conversion_rate"] for r in summary]
        credits = _kept(audits.period_credits(touches, model, period))
        ranges = audits.period_ranges(credits).agg(F.max("share_range").alias("s"), F.max("rank_range").alias("r")).first()
        shares, ranks, drift, same = ranges["s"] or 0.0, ranges["r"] or 0.0, max(rates) - min(rates), None
        flags = [shares / limits.share_volatility, ranks / limits.rank_volatility, drift / limits.conversion_rate_drift]
        if model == "markov":
            same = audits.transition_similarity(attribution.transitions(audits.by_period(touches, period), ["scenario"])).agg(F.avg("similarity")).first()[0]
        if same is not None:
            same = min(1.0, max(0.0, same))
            flags.append(max(0.0, limits.transition_stability - same) / max(limits.transition_stability, 1e-12))
        worst = max(flags)
        severity = "HIGH" if shares >= limits.high_share_volatility or worst >= 2 else "MEDIUM" if worst >= 1 else "LOW" if worst >= 0.5 else "PASS"
        rhos = {f"{r['a']}__{r['b']}": r["spearman"] for r in audits.period_correlations(credits).collect()}  # a row a pair of periods
        metrics = {"period": period, "model": model, "periods": len(summary), "period_summary": summary, "cross_period_spearman": rhos, "max_share_range": shares, "max_rank_range": ranks, "conversion_rate_range": drift, "transition_stability": same}
        message = f"over {len(summary)} periods a share moves by {shares:.1%} and the conversion rate by {drift:.1%} at most"
        scenarios = credits.select(F.concat(F.lit("model_stability:"), "scenario").alias("scenario"), "channel", "share")
        return _found("model_stability", severity, 100 * max(0.0, 1 - min(1.0, worst / 2)), message, "max_share_volatility", shares, metrics, "Look for changes of tracking or mix between the periods before moving budget.", 0, limits, scenarios)

    check_temporal_stability = check_model_stability
    check_delayed_converter_contamination = check_contamination

    def simulate(self, name: str, frame: DataFrame | None = None, rates: Iterable[float] | float = (0.05, 0.10, 0.20), models: Iterable[str] | str | None = None, seed: int = 42, touches: DataFrame | None = None, **losses) -> CheckResult:
        """Credit after damage at each rate, against credit before it. ``event_loss`` takes impression_loss, click_loss and event_type_col."""
        models, frame = self._models(models if models is not None else self.models), self._frame(frame)
        rates = [rates] if isinstance(rates, int | float) else list(dict.fromkeys(rates))
        if not rates:
            raise ValueError("rates must be given")
        if name == "event_loss":
            plan = [(f"impression={losses.get('impression_loss', 0):g},click={losses.get('click_loss', 0):g}", max(losses.get("impression_loss", 0), losses.get("click_loss", 0)), losses)]
        else:
            plan = [(f"{rate:g}", rate, {name: rate}) for rate in rates]
        touches = self._journeys(frame) if touches is None else touches
        size, base = _mean_length(touches), _kept(attribution.attribute_all(touches, models))
        users = frame.select(F.col("user_id").cast("string").alias("user_id")).distinct()
        known = users.count() if name == "identity_loss" else 0
        preferred = "linear" if "linear" in models else None
        scenarios, listed = None, []
        for i, (label, rate, args) in enumerate(plan):
            damaged = corruption.corrupt(frame, **args, random_state=seed + i)
            left = self._journeys(damaged.frame).persist()
            credits = _kept(attribution.attribute_all(left, models))
            moved = {r["model"]: (r["total_variation"] or 0.0, r["max_drift"] or 0.0) for r in audits.total_variation(audits.share_drift(base, credits, ["model"]), ["model"]).collect()}  # a row a model
            length = _mean_length(left)
            left.unpersist()
            new = damaged.frame.select(F.col("user_id").cast("string").alias("user_id")).distinct().join(users, "user_id", "left_anti").count() if known else 0
            listed.append({
                "label": label, "requested_rate": rate, "row_counts": damaged.row_counts, "max_share_drift": max((d for _, d in moved.values()), default=0.0), "instability": max((t for t, _ in moved.values()), default=0.0),
                "path_length_change": length - size, "fragmentation_rate": new / known if known else 0.0,
            })
            if preferred:
                one = credits.where(F.col("model") == preferred).select(F.lit(f"{name}:{label}").alias("scenario"), "channel", "share")
                scenarios = one if scenarios is None else scenarios.unionByName(one)
        worst = {k: max(abs(x[k]) for x in listed) for k in ("max_share_drift", "instability", "path_length_change", "fragmentation_rate")}
        drift = worst["max_share_drift"]
        severity = "HIGH" if drift >= 0.20 else "MEDIUM" if drift >= 0.10 else "LOW" if drift >= 0.05 else "PASS"
        score = max(0.0, 100 * (1 - min(1.0, 2 * drift + worst["instability"])))
        message = f"{name.replace('_', ' ')} moves a share by {drift:.1%} and the length of paths by {worst['path_length_change']:.2f} at most"
        return _found(name, severity, score, message, "max_share_drift", drift, worst | {"scenarios": listed}, "See whether tracking loses events, and of which channels.", scenarios=scenarios)

    def simulate_identity_loss(self, rates=(0.05, 0.10, 0.20), **options) -> CheckResult:
        return self.simulate("identity_loss", rates=rates, **options)

    def simulate_touchpoint_loss(self, rates=(0.05, 0.10, 0.20), rate: float | None = None, **options) -> CheckResult:
        return self.simulate("touchpoint_loss", rates=rates if rate is None else rate, **options)

    def simulate_event_loss(self, impression_loss: float = 0, click_loss: float = 0, event_type_col: str | None = None, **options) -> CheckResult:
        return self.simulate("event_loss", impression_loss=impression_loss, click_loss=click_loss, event_type_col=event_type_col, **options)

    def check_identification(self, touches: DataFrame | None = None, models: Iterable[str] | None = None) -> CheckResult:
        if "markov" not in (models or self.models):
            return _unknown("markov_identification", "no Markov model is among the models", "markov_identified", status="not_applicable")
        got = audits.identification(self._touches(touches)).first().asDict()
        if not got["null_paths"]:
            return _unknown("markov_identification", "no journey ends without a conversion, so removal effects are not identified", "markov_identified", 0, "HIGH", metrics=got)
        least = max(10, 2 * got["channels"])
        if got["journeys"] < least:
            return _unknown("markov_identification", f"{got['journeys']} journeys are few for {got['channels']} channels; {least} are needed", "markov_identified", 1, metrics=got)
        return _found("markov_identification", "PASS", 100.0, f"removal effects are identified from {got['null_paths']} journeys without conversion", "markov_identified", 1, got, "", got["null_paths"])

    def _damage(self, frame: DataFrame, touches: DataFrame, wanted: list[str], simulations: Mapping | None, models: list[str], seed: int) -> dict[str, Callable[[], CheckResult]]:
        """The simulations to run: by default both losses at 10 % on linear credit; those configured, on all models."""
        given = dict(simulations or {})
        unknown = set(given) - {"identity_loss", "touchpoint_loss", "event_loss"}
        if unknown:
            raise ValueError(f"unknown simulations: {sorted(unknown)}")
        out = {}
        for name in ("identity_loss", "touchpoint_loss", "event_loss"):
            value = given.get(name, (0.10,) if name in wanted and name != "event_loss" else {} if name in wanted else None)
            if value is None or value is False:
                continue
            options = {"models": models if name in given else ("linear",), "seed": seed}
            if isinstance(value, Mapping):
                options |= value
            elif value is not True:
                if name == "event_loss":
                    raise TypeError("event_loss takes a mapping")
                options["rates"] = value
            out[name] = lambda name=name, options=options: self.simulate(name, frame, touches=touches, **options)
        return out

    def run(self, simulations: Mapping | None = None, windows=(7, 14, 30), bootstrap: bool | robustness.BootstrapConfig | None = None, seed: int = 42, checks: Iterable[str] | str | None = None, events: DataFrame | None = None, models: Iterable[str] | None = None, n_bootstrap: int = 200) -> AuditReport:
        """All checks once, or those named in ``checks``. ``simulations`` maps identity_loss and touchpoint_loss (rates, True, arguments, or False to skip) and event_loss (arguments)."""
        source, models = self._source(events), self._models(models) if models is not None else self.models
        wanted = [c for c in CHECKS if c != "event_loss"] if checks is None else list(dict.fromkeys(resolve_check(c) for c in ([checks] if isinstance(checks, str) else checks)))
        frame, _ = validate_events(source, self.columns)
        frame = frame.persist()
        touches = self._journeys(frame).persist()
        touches.count()  # fills the cache once, before the checks read it side by side
        credits = _kept(attribution.attribute_all(touches, models))
        compare: list = []  # one comparison that two checks read
        work = {
            "data_quality": lambda: self.check_data_quality(source), "duplicates": lambda: self.check_duplicates(source), "model_disagreement": lambda: self.check_model_disagreement(credits), "path_sparsity": lambda: self.check_path_sparsity(touches),
            "channel_concentration": lambda: self.check_concentration(touches, credits), "conversion_window": lambda: self.check_conversion_window(frame, windows, models[-1]), "converter_contamination": lambda: self.check_contamination(frame, exposure=lambda: compare[0].result()),
            "model_stability": lambda: self.check_model_stability(touches, model=models[-1]), "exposure_comparison": lambda: self.check_exposure(frame, exposure=lambda: compare[0].result()), "markov_identification": lambda: self.check_identification(touches, models),
        }
        work = {k: f for k, f in work.items() if k in wanted} | self._damage(frame, touches, wanted, simulations, models, seed)
        with ThreadPoolExecutor(AT_ONCE) as pool:  # the checks are independent Spark jobs
            if {"converter_contamination", "exposure_comparison"} & set(work):
                compare.append(pool.submit(lambda: audits.exposure_comparison(frame)))  # submitted first, so whoever waits for it waits for a running job
            pending = {k: pool.submit(work[k]) for k in CHECKS if k in work}
            about = pool.submit(lambda: journeys.summary(touches).first().asDict())
            grain = pool.submit(lambda: touches.agg(F.count_distinct("channel")).first()[0])
            copies = pool.submit(lambda: duplicates.duplicate_counts(source, self.columns).first()["exact"])
            results = [f.result() for f in pending.values()]
            about, grain, copies = about.result(), grain.result(), copies.result()
        preferred = "linear" if "linear" in models else models[0]
        name = F.when(F.col("model") == preferred, "baseline").otherwise(F.concat(F.lit("model:"), "model"))
        scenarios = credits.select(name.alias("scenario"), "channel", "share")
        if copies:
            clean = attribution.attribute_all(self._journeys(duplicates.deduplicate(frame)), [preferred])
            scenarios = scenarios.unionByName(clean.select(F.lit("duplicate_handling:deduplicated").alias("scenario"), "channel", "share"))
        for r in results:
            if r.scenarios is not None:
                scenarios = scenarios.unionByName(r.scenarios)
        scenarios = _kept(robustness.with_credit(scenarios))
        drawn = None
        if bootstrap:
            drawn = robustness.bootstrap(touches, models, bootstrap if isinstance(bootstrap, robustness.BootstrapConfig) else robustness.BootstrapConfig(n_iterations=n_bootstrap, random_state=seed))
        different, channels = robustness.distinct_scenarios(scenarios), scenarios.select("channel").distinct().count()
        decisions, said = None, f"Decision robustness was not evaluated: {different} different scenarios and {channels} channels; two of each are needed."
        if different >= 2 and channels >= 2:
            ranks = drawn.draws.where(F.col("model") == preferred) if drawn is not None and drawn.evaluated else None
            decisions = _kept(robustness.decision_robustness(scenarios, "baseline", ranks))
            said = robustness.interpret(decisions)
        scores = {r.check: r.score for r in results if r.status == "evaluated" and r.score is not None}
        total = reliability_score(scores, self.weights)
        return AuditReport(
            results, total, score_label(total), component_scores(scores), credits, robustness.matrix(scenarios), decisions, drawn, self.minimum_severity, about, about["non_converted_journeys"] > 0 if "markov" in models else None,
            "campaign" if grain > 50 else "channel", "evaluated" if different >= 2 else "insufficient_evidence", said, self.sample_info, [frame, touches],
        )
