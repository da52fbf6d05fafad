"""Loaders find their files and map them."""

import pytest

from credence.sources import adapters, loaders

LOG = "timestamp\tuid\tcampaign\tconversion\tconversion_timestamp\tconversion_id\tclick\tcost\n10\t1\t100\t1\t400\t7\t0\t0.5\n80\t1\t200\t1\t400\t7\t1\t0.25\n20\t2\t100\t0\t-1\t-1\t0\t1\n"


def test_impression_log(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.tsv"
    path.write_text(LOG)
    got = loaders.load_impression_log(spark, str(path))
    assert dict(got.dtypes)["cost"] == "double" and [r["channel"] for r in got.where("conversion").collect()] == ["200"]
    assert loaders.load_impression_log(spark, str(path), nrows=1).count() == 1 and loaders.ImpressionLog(str(path), sample_users=1).load(spark).select("user_id").distinct().count() == 1
    monkeypatch.setenv("CREDENCE_IMPRESSION_LOG", str(path))
    assert loaders.load_impression_log(spark).count() == 3
    with pytest.raises(adapters.DatasetNotAvailableError):
        loaders.load_impression_log(spark, str(tmp_path / "none.tsv"))


def test_tables(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "data").mkdir()
    steps, flags = tmp_path / "data" / "synthetic_touchpoints.csv", tmp_path / "data" / "synthetic_journeys.csv"
    steps.write_text("journey_id,step,channel\na,1,x\na,2,y\nb,1,x\n")
    flags.write_text("journey_id,converted\na,1\nb,0\n")
    assert [r["channel"] for r in loaders.load_journey_steps(spark, str(steps), str(flags)).where("conversion").collect()] == ["y"]
    assert loaders.load_journey_steps(spark, str(steps), str(flags)).count() == 3
    funnel = tmp_path / "f.csv"
    funnel.write_text("journey_id,channel,touch_position,touch_timestamp,converted,revenue\n1,ad,1,2026-01-01,1,9\n1,mail,2,2026-01-02,1,9\n")
    assert [(r["channel"], r["conversion_value"]) for r in loaders.load_funnel(spark, str(funnel)).where("conversion").collect()] == [("mail", 9.0)]
    daily = tmp_path / "d.csv"
    daily.write_text("user_id,touchpoint_date,channel,conversion\n1,2026-01-01,tv,0\n1,2026-01-02,web,1\n")
    assert [r["channel"] for r in loaders.load_daily_touches(spark, str(daily)).where("conversion").collect()] == ["web"]


def test_sampling_is_described():
    assert "5 users" in loaders.describe_sampling(None, 5) and "sample of 4" in loaders.describe_sampling(9, 4)
