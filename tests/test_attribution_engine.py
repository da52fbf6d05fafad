"""Hand-computed cases of the attribution engine."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.audit import ReliabilityAudit
from credence.functions.durations import micros, positive
from credence.operators import attribution as att
from credence.operators import audits, corruption, duplicates, journeys, quality, robustness, sampling
from credence.schema import ColumnMapping, SchemaError, canonical, validate_events
from credence.scoring import ScoreThresholds, ScoringWeights, combine_scores, grade, reliability_score, score_label
from credence.sources import adapters, generators

DAY0 = datetime(2026, 1, 1)


def events(spark, rows):
    """(user, day, channel, conversion[, value]) rows."""
    data = [(i, r[0], DAY0 + timedelta(days=r[1]), r[2], bool(r[3]), float(r[4]) if len(r) > 4 else 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row_id long, user_id string, timestamp timestamp, channel string, conversion boolean, conversion_value double")


@pytest.fixture(scope="module")
def few(spark):
    """m: tv, web, shop worth 24; n: web twice, worth 6; o: tv, nothing."""
    return events(spark, [("m", 0, "tv", 0), ("m", 2, "web", 0), ("m", 5, "shop", 1, 24), ("n", 0, "web", 0), ("n", 1, "web", 1, 6), ("o", 3, "tv", 0)])


def table(df, key="channel", *values):
    return {r[key]: tuple(r[v] for v in values) if len(values) > 1 else r[values[0]] for r in df.collect()}


def test_rule_models(spark, few):
    j = journeys.build_journeys(few)
    assert table(att.attribute(j, "first_touch"), "channel", "attribution_credit", "conversions") == {"tv": (24, 1), "web": (6, 1)}
    assert table(att.attribute(j, "Last Touch"), "channel", "attribution_credit", "share") == {"shop": (24, 0.8), "web": (6, 0.2)}
    linear = table(att.attribute(j, "linear"), "channel", "attribution_credit", "share", "conversions")
    assert linear["tv"] == pytest.approx((8, 8 / 30, 1 / 3)) and linear["web"] == pytest.approx((14, 14 / 30, 4 / 3)) and linear["shop"] == pytest.approx((8, 8 / 30, 1 / 3))
    with pytest.raises(att.AttributionError):
        att.attribute(j, "nonsense")


def test_all_models_in_one_pass_are_each_model(spark, few):
    j = journeys.build_journeys(few.unionByName(generators.stress_scenario(spark, "model_disagreement").drop("x")))
    names = ["first_touch", "last_touch", "linear", "markov"]
    together = {(r["model"], r["channel"]): (r["attribution_credit"], r["share"], r["conversions"]) for r in att.attribute_all(j, names).collect()}
    alone = {(m, r["channel"]): (r["attribution_credit"], r["share"], r["conversions"]) for m in names for r in att.attribute(j, m).collect()}
    assert set(together) == set(alone) and all(together[k] == pytest.approx(alone[k]) for k in alone)


def test_markov(spark, few):
    """By hand: web and shop always convert, tv half of the time, so 2/3 of all journeys do."""
    j = journeys.build_journeys(few)
    p = {(r["src"], r["dst"]): r["prob"] for r in att.transitions(j).collect()}
    assert p["START", "tv"] == pytest.approx(2 / 3) and p["tv", "NULL"] == pytest.approx(1 / 2) and p["web", "shop"] == p["web", "web"] == p["web", "CONVERSION"] == pytest.approx(1 / 3)
    reconnect = table(att.markov_effects(j), "channel", "baseline", "without", "effect", "share")
    assert reconnect["tv"] == pytest.approx((2 / 3, 1, 0, 0)) and reconnect["web"] == pytest.approx((2 / 3, 0, 1, 1)) and reconnect["shop"] == pytest.approx((2 / 3, 2 / 3, 0, 0))
    redirect = table(att.markov_effects(j, strategy="redirect_to_null"), "channel", "without", "effect", "share")
    assert redirect["tv"] == pytest.approx((1 / 3, 1 / 2, 1 / 4)) and redirect["web"] == pytest.approx((0, 1, 1 / 2)) and redirect["shop"] == pytest.approx((1 / 3, 1 / 2, 1 / 4))
    assert table(att.markov(j), "channel", "attribution_credit") == pytest.approx({"tv": 0, "web": 30, "shop": 0})


def test_redirected_removals_are_those_of_single_solves():
    rng = np.random.default_rng(3)
    for _ in range(10):
        names = [f"c{i}" for i in range(6)]
        rows = [(s, d, w) for s in ["START", *names] for d, w in zip([*names, "CONVERSION", "NULL"], rng.dirichlet(np.ones(8)), strict=True) if s != "START" or d in names]
        edges = pd.DataFrame(rows, columns=["src", "dst", "prob"])
        edges["prob"] /= edges.groupby("src")["prob"].transform("sum")
        for r in att.solve_chain(edges, "redirect_to_null").itertuples():
            cut = edges[(edges["src"] != r.channel)].copy()
            cut.loc[cut["dst"] == r.channel, "dst"] = "dead"
            cut = pd.concat([cut, pd.DataFrame([("dead", "NULL", 1.0)], columns=cut.columns)])
            cut = cut.groupby(["src", "dst"], as_index=False)["prob"].sum()
            assert r.without == pytest.approx(att.solve_chain(cut)["baseline"].iloc[0])


def test_markov_rejects_state_names(spark):
    with pytest.raises(Exception, match="name of a state"):
        att.markov(journeys.build_journeys(events(spark, [("a", 0, "START", 0), ("a", 1, "x", 1), ("b", 0, "NULL", 0), ("b", 1, "x", 0)]))).collect()


def test_singular_chain_falls_back():
    edges = pd.DataFrame([("START", "A", 1.0), ("A", "B", 0.5), ("A", "CONVERSION", 0.5), ("B", "B", 0.5), ("B", "A", 0.5)], columns=["src", "dst", "prob"])
    out = att.solve_chain(edges)
    assert np.isfinite(out["effect"]).all()


def test_window_trims_touches(spark):
    e = events(spark, [("u", 0, "old", 0), ("u", 8, "search", 0), ("u", 9, "email", 1), ("u", 10, "social", 0), ("u", 11, "direct", 1)])
    got = sorted((r["seg"], tuple(r["path"])) for r in journeys.paths(journeys.build_journeys(e, "3D")).collect())
    assert got == [(0, ("search", "email")), (1, ("social", "direct"))]
    with pytest.raises(ValueError):
        journeys.build_journeys(e, "0D")


def test_general_plan_rolls_skipped_conversions(spark):
    """A conversion whose window holds no touch emits nothing; its rows belong to the next one."""
    e = events(spark, [("u", 0, "a", 0), ("u", 1, "b", 1), ("u", 2, "c", 1)]).withColumn("conversion_timestamp", F.when(F.col("channel") == "b", F.lit(DAY0 - timedelta(days=5))))
    got = [(r["seg"], tuple(r["path"])) for r in journeys.paths(journeys.build_journeys(e)).collect()]
    assert got == [(0, ("a", "b", "c"))]


def reference_journeys(rows, lookback_days):
    """The rule in plain Python, per user, over (day, channel, conversion, end day)."""
    out, users = [], {}
    for i, r in enumerate(rows):
        users.setdefault(r[0], []).append((r[1], i, r[2], r[3], r[4]))
    for user, mine in users.items():
        mine.sort()
        prev, seg = -1, 0
        for k, (day, _, _, conv, end) in enumerate(mine):
            if not conv:
                continue
            end = day if end is None else end
            path = [m[2] for m in mine[prev + 1 : k + 1] if end - lookback_days <= m[0] <= end]
            if path:
                out.append((user, seg, tuple(path), True))
                prev, seg = k, seg + 1
        if not any(m[3] for m in mine):
            last = mine[-1][0]
            out.append((user, 0, tuple(m[2] for m in mine if m[0] >= last - lookback_days), False))
    return sorted(out)


def test_general_plan_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = []
    for u in range(60):
        for _ in range(rng.integers(1, 9)):
            day, conv = int(rng.integers(0, 40)), bool(rng.random() < 0.35)
            rows.append((f"u{u}", day, f"c{rng.integers(4)}", conv, int(day + rng.integers(-30, 30)) if conv and rng.random() < 0.7 else None))
    data = [(i, r[0], DAY0 + timedelta(days=r[1]), r[2], r[3], 1.0, None if r[4] is None else DAY0 + timedelta(days=r[4])) for i, r in enumerate(rows)]
    e = spark.createDataFrame(data, "row_id long, user_id string, timestamp timestamp, channel string, conversion boolean, conversion_value double, conversion_timestamp timestamp")
    got = sorted((r["user_id"], r["seg"], tuple(r["path"]), r["converted"]) for r in journeys.paths(journeys.build_journeys(e, "10D")).collect())
    assert got == reference_journeys(rows, 10)


def test_summary(spark):
    e = events(spark, [("x", 0, "email", 0), ("x", 1, "email", 0), ("x", 2, "direct", 1), ("y", 0, "social", 0)])
    got = journeys.summary(journeys.build_journeys(e)).first()
    assert (got["journeys"], got["unique_paths"], got["converted_mean_length"], got["non_converted_mean_length"], got["repeated_touch_rate"]) == (2, 2, 3.0, 1.0, 0.25)


def test_mapping_and_validation(spark):
    raw = spark.createDataFrame([("a", "2026-01-01", " email ", "yes", 7), ("a", "2026-01-02", "direct", "0", 8)], "uid string, at string, medium string, converted string, extra int")
    frame, summary = validate_events(raw, {"user_id": "uid", "timestamp": "at", "channel": "medium", "conversion": "converted"})
    assert (summary.rows, summary.users, summary.conversions) == (2, 1, 1) and "extra" in frame.columns and frame.first()["channel"] == "email"
    for bad in ({"user_id": " "}, {"user_id": "timestamp"}, {"nothing": "x"}, {"campaign": "a", "campaign_id": "b"}):
        with pytest.raises(SchemaError):
            ColumnMapping.of(bad)
    with pytest.raises(SchemaError):
        canonical(raw)
    with pytest.raises(SchemaError):
        validate_events(raw.withColumn("converted", F.lit("maybe")), {"user_id": "uid", "timestamp": "at", "channel": "medium", "conversion": "converted"})


def test_quality_findings(spark):
    raw = spark.createDataFrame([("a", "bad", " ", 0), ("a", "2026-01-01", "email", 1), ("a", "2026-01-01", "email", 1)], "user_id string, timestamp string, channel string, conversion int")
    codes = {f.code for f in quality.quality_findings(raw, reference_time="2027-01-01")}
    assert {"invalid_timestamp", "empty_channel"} <= codes
    assert [f.code for f in duplicates.duplicate_findings(raw)] == ["date_grain_repeated_touches"]
    assert quality.quality_findings(raw.drop("channel"))[0].code == "missing_columns"
    zero = events(spark, [("a", 0, "x", 0, 0), ("a", 1, "x", 1, 0)])
    assert "zero_conversion_value" in {f.code for f in quality.quality_findings(zero, reference_time="2027-01-01")}


def test_windows_change_credit(spark):
    e = events(spark, [("one", 0, "early", 0), ("one", 20, "late", 1), ("two", 19, "early", 0), ("two", 20, "early", 1)])
    c = {(r["scenario"], r["channel"]): r["attribution_credit"] for r in audits.window_credits(e, (7, 30)).collect()}
    assert c[micros(7), "late"] == 1 and c[micros(30), "late"] == 0.5
    assert table(audits.window_comparison(audits.window_credits(e, (7, 30))), "channel", "credit_change")["early"] == pytest.approx(0.5)


def test_contamination_classes(spark):
    rows = [("s", 0, "a", 0), ("s", 3, "a", 1), ("d", 0, "b", 0), ("d", 10, "b", 1), ("l", 0, "c", 0), ("l", 40, "c", 1), ("n", 0, "a", 0)]
    got = audits.contamination(events(spark, rows)).first()
    assert (got["short"], got["delayed"], got["post"], got["none"], got["delayed_rate"]) == (1, 1, 1, 1, 0.25)


def test_corruption_contract(spark):
    rows = [("a", 0, "x", 0), ("a", 1, "y", 0), ("a", 2, "z", 1), ("b", 0, "x", 0), ("b", 1, "y", 0), ("b", 2, "z", 1), ("c", 0, "x", 0), ("c", 1, "y", 0)]
    e = events(spark, rows)
    lost = corruption.corrupt(e, touchpoint_loss=1.0)
    assert lost.row_counts == {"input": 8, "output": 2, "net_change": -6} and {r["conversion"] for r in lost.frame.collect()} == {True}
    twice = [sorted(r["row_id"] for r in corruption.corrupt(e, touchpoint_loss=0.5, random_state=7).frame.collect()) for _ in range(2)]
    assert twice[0] == twice[1] and len(twice[0]) == 5
    wide = corruption.corrupt(e.repartition(7), touchpoint_loss=0.5, random_state=7).frame
    assert sorted(r["row_id"] for r in wide.collect()) == twice[0]
    copies = corruption.corrupt(e, duplicate_rate=1.0).frame
    assert copies.count() == 16 and duplicates.deduplicate(copies).count() == 8
    assert duplicates.detect_duplicates(copies).where("kind = 'exact'").count() == 16
    moved = corruption.corrupt(e, identity_loss=1.0).frame
    assert moved.where("user_id like '__fragment__%'").count() == 3 and moved.where("conversion and user_id like '__fragment__%'").count() == 0
    with pytest.raises(ValueError):
        corruption.corrupt(e, touchpoint_loss=True)
    with pytest.raises(ValueError):
        corruption.corrupt(e, impression_loss=0.5)


def test_exact_count_rounds_half_to_even():
    assert [sampling.exact_count(n, r) for n, r in ((0, 0.5), (10, 0), (10, 0.01), (5, 0.5), (7, 0.5))] == [0, 0, 1, 2, 4]
    assert positive("30D") == positive(30) == positive(timedelta(days=30))


def test_sampling_keeps_whole_users(spark):
    rows = [(f"u{i}", d, "x", d == 1 and i % 3 == 0) for i in range(30) for d in range(2)]
    e = events(spark, rows)
    got, meta = sampling.sample_users(e, 12)
    users = {r["user_id"]: r["count"] for r in got.groupBy("user_id").count().collect()}
    assert len(users) == 12 and set(users.values()) == {2} and meta["sampled_users"] == 12
    assert sampling.sample_users(e, 100)[0] is e


def test_rank_reversal_is_not_robust(spark):
    credits = robustness.frame_of(spark, {"base": {"a": 0.6, "b": 0.3, "c": 0.1}, "other": {"a": 0.1, "b": 0.6, "c": 0.3}})
    got = table(robustness.decision_robustness(credits, "base"), "channel", "p_top1", "class")
    assert got["a"][0] == 0.5 and got["a"][1] != "Robust"


def test_bootstrap_is_stable_and_centred(spark, few):
    j = journeys.build_journeys(generators.stress_scenario(spark, "stable_dominant"))
    config = robustness.BootstrapConfig(n_iterations=40)
    a = robustness.bootstrap_draws(j, ["linear"], config).orderBy("iteration", "channel").collect()
    b = robustness.bootstrap_draws(j.repartition(5), ["linear"], config).orderBy("iteration", "channel").collect()
    assert a == b
    stats = table(robustness.bootstrap_statistics(robustness.bootstrap_draws(j, ["linear"], config)), "channel", "mean", "p_top1")
    true = table(att.attribute(j, "linear"), "channel", "share")
    assert stats["search"][0] == pytest.approx(true["search"], abs=0.03) and stats["search"][1] == 1
    with pytest.raises(ValueError):
        robustness.BootstrapConfig(n_iterations=2)
    nothing = robustness.bootstrap(journeys.build_journeys(few.where("user_id = 'n'")), ["linear"], config)
    assert not nothing.evaluated and "converted" in nothing.reason and nothing.draws is None


def test_scores():
    assert reliability_score({"data_quality": 50.0, "duplicates": 100.0, "model_disagreement": 50.0}, ScoringWeights()) == pytest.approx(62.5)
    assert reliability_score({}) is None and [score_label(x) for x in (95, 90, 80, 70, 60, 59, None)] == ["Robust", "Robust", "Stable", "Caution", "Fragile", "Highly Fragile", "Insufficient Evidence"]
    assert score_label(92, ScoreThresholds(95, 85, 75, 65)) == "Stable" and [grade(x) for x in (91, 81, 71, 61, 1, None)] == ["A", "B", "C", "D", "F", "N/A"]
    assert reliability_score({"data_quality": 50.0, "model_disagreement": 80.0}, {"data_quality": 1, "model_agreement": 3}) == pytest.approx(72.5)
    assert combine_scores([]) == 100 and combine_scores([50, 60]) == 55
    for wrong in ({"no_such": 1}, {"data_quality": True}):
        with pytest.raises(ValueError):
            ScoringWeights.of(wrong)
    with pytest.raises(ValueError):
        ScoreThresholds(80, 90, 70, 60)
    with pytest.raises(ValueError):
        ScoringWeights(data_quality=-1)


@pytest.mark.parametrize("name", ["stable_dominant", "duplicate_contamination"])
def test_audit_report(spark, name):
    report = ReliabilityAudit(generators.stress_scenario(spark, name)).run(simulations={"identity_loss": False, "touchpoint_loss": False}, windows=(7, 30))
    checks = {r.check: r for r in report.results}
    assert 0 <= report.score <= 100 and "Reliability" in report.summary() and "<table>" in report.to_html() and "nan" not in report.to_json().lower().replace("dominant", "")
    if name == "stable_dominant":
        assert table(report.robustness, "channel", "class")["search"] == "Robust"
    else:
        assert checks["duplicates"].score < 100 and report.sensitivity.where("scenario like 'duplicate%'").count() > 0
    assert report.to_dataframe(spark).count() >= len(report.results)


def test_audit_runs_the_checks_that_are_asked_for(spark):
    audit = ReliabilityAudit(generators.stress_scenario(spark, "stable_dominant"))
    report = audit.run(checks=["Sparsity", "data_quality", "identity loss"])
    assert [r.check for r in report.results] == ["data_quality", "path_sparsity", "identity_loss"]
    report.unpersist()
    with pytest.raises(ValueError):
        audit.run(checks=["no such check"])


def test_pick_of_many_is_the_first_by_hash(spark, monkeypatch):
    rows = spark.range(5000).withColumn("g", F.col("id") % 700)
    for k in (0, 1, 40, 4999, 5000, 6000):
        want = sorted(map(tuple, sampling.pick(rows, k, 5, "s", "g", "id").collect()))
        few_distinct = sorted(r["g"] for r in sampling.pick(rows, k, 5, "s", "g").collect())
        with monkeypatch.context() as m:
            m.setattr(sampling, "TOP", 30)
            assert sorted(map(tuple, sampling.pick(rows, k, 5, "s", "g", "id").collect())) == want and len(want) == min(k, 5000)
            assert sorted(r["g"] for r in sampling.pick(rows, k, 5, "s", "g").collect()) == few_distinct


def test_quality_counts_affected_users(spark):
    bad = events(spark, [("a", 0, " ", 0), ("a", 1, " ", 0), ("b", 0, "x", 0), ("b", 1, "", 1), ("c", 0, "x", 1)]).withColumn("conversion_id", F.when(F.col("user_id") != "a", F.lit("k")))
    found = {f.code: f for f in quality.quality_findings(bad)}
    assert found["empty_channel"].details == {"affected_rows": 3, "affected_users": 2, "affected_conversions": 1, "rate": 3 / 5, "unit": "rows"}
    assert found["malformed_journeys"].details["affected_users"] == 1 and found["repeated_conversion_ids"].count == 2


def test_stress_scenarios_are_described(spark):
    assert set(generators.STRESS) == set(generators.PURPOSE) == set(generators.EXPECTED)
    noise = generators.stress_scenario(spark, "noise_without_decision_change")
    assert {r["channel"] for r in noise.select("channel").distinct().collect()} == {"search", *generators.MINOR}


def test_timestamp_noise_moves_exposures_within_its_bound(spark):
    e = generators.stress_scenario(spark, "stable_dominant")
    out = corruption.corrupt(e, timestamp_noise="2h", random_state=3).frame
    moved = out.select("row_id", F.unix_micros("timestamp").alias("t")).join(e.select("row_id", F.unix_micros("timestamp").alias("o")), "row_id").select(F.abs(F.col("t") - F.col("o")).alias("d")).agg(F.max("d"), F.min("d"), F.count(F.lit(1))).first()
    assert 0 < moved[0] <= 2 * 3600 * 1_000_000 and moved[2] == e.count()


def test_generators_do_not_depend_on_partitions(spark):
    a = sorted(map(tuple, generators.simulate_touch_sequences(spark, 40).drop("row_id").collect()))
    spark.conf.set("spark.default.parallelism", "3")
    b = sorted(map(tuple, generators.simulate_touch_sequences(spark, 40).drop("row_id").collect()))
    assert a == b and generators.simulate_brand_exposures(spark, 20).count() > 20
    labels = generators.simulate_trigger_labels(spark, 50)
    assert labels.where("conversion").select("true_trigger_channel").distinct().count() == 1


def test_adapters(spark, tmp_path):
    log = tmp_path / "log.tsv"
    head = "timestamp\tuid\tcampaign\tconversion\tconversion_timestamp\tconversion_id\tclick"
    log.write_text("\n".join([head, "10\t1\t100\t1\t400\t7\t0", "80\t1\t200\t1\t400\t7\t1", "500\t1\t300\t1\t400\t7\t0", "20\t2\t100\t0\t-1\t-1\t0"]))
    got = adapters.impression_log_events(adapters.read_impression_log(spark, str(log)))
    assert [r["channel"] for r in got.where("conversion").collect()] == ["200"]
    steps = spark.createDataFrame([("a", 1, "x", 0.0), ("a", 2, "y", 1.0), ("b", 1, "x", 0.0)], "journey_id string, step int, channel string, t_hours double")
    flags = spark.createDataFrame([("a", 1), ("b", 0)], "journey_id string, converted int")
    assert [(r["user_id"], r["channel"]) for r in adapters.journey_steps_events(steps, flags).where("conversion").collect()] == [("a", "y")]
    funnel = spark.createDataFrame([(1, "ad", 1, "2026-01-01", 1, 9.0), (1, "email", 2, "2026-01-02", 1, 9.0), (2, "ad", 1, "2026-01-01", 0, 0.0)], "journey_id int, channel string, touch_position int, touch_timestamp string, converted int, revenue double")
    assert [(r["channel"], r["conversion_value"]) for r in adapters.funnel_events(funnel).where("conversion").collect()] == [("email", 9.0)]
    daily = spark.createDataFrame([(1, "2026-01-01", "display", 0), (1, "2026-01-02", "search", 1)], "user_id int, touchpoint_date string, channel string, conversion int")
    assert [r["channel"] for r in adapters.daily_touch_events(daily).where("conversion").collect()] == ["search"]
    with pytest.raises(adapters.DatasetNotAvailableError):
        adapters.resolve_path(None, "NO_SUCH_VARIABLE", ["none.tsv"])
