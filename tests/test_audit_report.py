"""The report and the single checks."""

import json
from datetime import datetime, timedelta

import pytest

from credence.audit import ReliabilityAudit, resolve_check
from credence.operators import robustness
from credence.sources import generators
from credence.thresholds import ContaminationThresholds

START = datetime(2026, 3, 2)


def rows(spark, listed):
    """(user, day, channel, conversion) rows."""
    data = [(i, u, START + timedelta(days=d), c, bool(v), 1.0, k) for i, (u, d, c, v, k) in enumerate(listed)]
    return spark.createDataFrame(data, "row_id long, user_id string, timestamp timestamp, channel string, conversion boolean, conversion_value double, kind string")


@pytest.fixture(scope="module")
def stream(spark):
    listed = []
    for i in range(12):
        listed += [(f"w{i}", i, "web", 0, "impression"), (f"w{i}", i + 1, "mail" if i % 3 else "tv", 0, "Click "), (f"w{i}", i + (9 if i < 3 else 2), "web" if i % 2 else "tv", 1, "order")]
    listed += [(f"n{i}", i, "tv", 0, "impression") for i in range(6)]
    return rows(spark, listed).persist()


@pytest.fixture(scope="module")
def report(spark, stream):
    audit = ReliabilityAudit(stream, models=("first_touch", "linear", "markov"), minimum_severity="low", sample_info={"users": 18})
    return audit.run(simulations={"identity_loss": (0.5,), "event_loss": {"click_loss": 0.5, "event_type_col": "kind"}}, bootstrap=robustness.BootstrapConfig(n_iterations=10))


def test_scenarios_are_models_windows_periods_and_losses(report):
    names = {r["scenario"] for r in report.sensitivity.select("scenario").distinct().collect()}
    assert {"baseline", "model:first_touch", "model:markov", "conversion_window:7D", "conversion_window:30D", "identity_loss:0.5", "touchpoint_loss:0.1", "event_loss:impression=0,click=0.5"} <= names
    assert any(n.startswith("model_stability:2026-03-") for n in names)
    shares = report.sensitivity.groupBy("scenario").agg({"share": "sum"}).collect()
    assert all(r["sum(share)"] == pytest.approx(1) for r in shares)


def test_decisions_list_bootstrap_ranks(report):
    got = {r["channel"]: r for r in report.robustness.collect()}
    assert set(got) == {"web", "mail", "tv"} and all(r["bootstrap_median_rank"] is not None for r in got.values())
    assert "scenarios" in report.interpretation and "bootstrap" in report.interpretation
    assert {r["model"] for r in report.bootstrap.draws.select("model").distinct().collect()} == {"first_touch", "linear", "markov"}
    full = report.bootstrap.draws.groupBy("model", "iteration").count().collect()
    assert len(full) == 30 and all(r["count"] == 3 for r in full if r["model"] != "first_touch")


def test_simulations_measure_paths_and_fragments(report):
    lost, cut = report.result("event_loss").metrics, report.result("identity_loss").metrics
    assert lost["scenarios"][0]["row_counts"]["net_change"] == -6 and lost["fragmentation_rate"] == 0 and lost["path_length_change"] == pytest.approx(6 / 18)
    assert cut["fragmentation_rate"] == pytest.approx(6 / 18) and report.result("touchpoint loss").metrics["fragmentation_rate"] == 0


def test_report_as_text_and_data(spark, report, tmp_path):
    data = json.loads(report.to_json())
    assert {"attribution", "sensitivity", "decision_robustness", "bootstrap", "journey_summary", "sample_info"} <= set(data) and "draws" not in data["bootstrap"]
    assert len(json.loads(report.to_json(include_bootstrap_draws=True))["bootstrap"]["draws"]) == report.bootstrap.draws.count()
    assert report.markov_identified and report.channel_grain == "channel" and data["journey_summary"]["journeys"] == 18
    for text in (report.summary(), report.to_markdown(), report.to_html()):
        assert "Recommendations" in text and "Decision robustness" in text
    frame = report.to_dataframe(spark)
    assert {"metric_name", "metric_value", "recommendation", "details", "explanation", "report_score"} <= set(frame.columns)
    assert all(f.severity not in ("PASS", "INFO") for f in report.findings)
    wide = report.sensitivity_matrix("share")
    assert wide.count() == 3 and "baseline" in wide.columns
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            report.plot_scorecard(str(tmp_path / "x.png"))
        return
    for draw in (report.plot_scorecard, report.plot_model_comparison, report.plot_window_sensitivity, report.plot_channel_volatility):
        draw(str(tmp_path / "x.png"))
        assert (tmp_path / "x.png").stat().st_size


def test_report_is_saved(spark, report, tmp_path):
    report.save(str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "sensitivity"), header=True).count() == report.sensitivity.count()
    assert json.loads(spark.read.text(str(tmp_path / "out" / "report")).first()[0])["label"] == report.label


def test_single_checks(spark, stream):
    audit = ReliabilityAudit(stream)
    got = audit.check_contamination()
    assert got.severity == "HIGH" and got.metrics["delayed"] == 3 and got.metrics["delayed_rate_of_converters"] == 0.25 and got.score == pytest.approx(100 * (1 - 3 / 18 / 0.3))
    assert audit.check_contamination(thresholds=ContaminationThresholds(critical_rate=0.16)).severity == "CRITICAL" and not got.passed
    window = audit.check_conversion_window(windows=(1, 30))
    assert window.metrics["windows"] == ["1D", "30D"] and set(window.metrics["cross_window_spearman"]) == {"1D__30D"} and window.metrics["high_risk_channels"]
    one = audit.check_conversion_window(windows=(7, "7D"))
    assert one.status == "insufficient_evidence" and one.explanation
    only = ReliabilityAudit(stream.where("user_id like 'n%'")).check_exposure()
    assert only.status == "evaluated" and only.severity == "MEDIUM" and only.score == 50
    sparse = ReliabilityAudit(stream.where("user_id like 'w%'"), models=["markov"]).check_identification()
    assert sparse.severity == "HIGH" and sparse.status == "insufficient_evidence"


def test_arguments(spark, stream):
    assert resolve_check("Converter exposure") == "exposure_comparison"
    renamed = stream.withColumnRenamed("user_id", "who")
    assert ReliabilityAudit(renamed, user_col="who").run(checks="sparsity", simulations={}).results[0].check == "path_sparsity"
    for wrong in ({"columns": {"user_id": "who"}, "user_col": "who"}, {"models": ()}, {"models": ("linear", "linear")}, {"minimum_severity": "grave"}):
        with pytest.raises(ValueError):
            ReliabilityAudit(renamed, **wrong)
    with pytest.raises(TypeError):
        ReliabilityAudit(renamed, colour="red")
    with pytest.raises(ValueError):
        ReliabilityAudit().run()
    with pytest.raises(ValueError):
        ReliabilityAudit(stream).run(simulations={"fire": True}, checks=["data_quality"])


def test_one_channel_has_no_decisions(spark):
    alone = rows(spark, [("a", 0, "tv", 0, ""), ("a", 1, "tv", 1, ""), ("b", 0, "tv", 1, "")])
    report = ReliabilityAudit(alone, models=["linear"]).run(checks=["path_sparsity", "model_disagreement"], simulations={"identity_loss": False}, bootstrap=True, n_bootstrap=10)
    assert report.robustness is None and report.sensitivity_status == "insufficient_evidence" and "not evaluated" in report.interpretation
    assert not report.bootstrap.evaluated and "Insufficient evidence" in report.summary() and json.loads(report.to_json())["bootstrap"]["statistics"] is None
