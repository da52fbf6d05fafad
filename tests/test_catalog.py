"""Spark queries against their DuckDB twins on the smallest tables."""

import math
import os

import duckdb
import pytest

from credence.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return round(float(x), 5) if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert plain(mine.select(*[f"`{c}`" for c in columns]).collect()) == plain(theirs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_reports_run_with_the_operators_defaults(spark, monkeypatch):
    checks = [r["check"] for r in catalog.QUERIES["score_components"](spark, SF).collect()]
    assert {"identity_loss", "touchpoint_loss"} <= set(checks) and len(checks) == len(set(checks))
    seen = []
    draws = catalog.robustness.bootstrap_draws
    monkeypatch.setattr(catalog.robustness, "bootstrap_draws", lambda *a: seen.append(draws(*a)) or seen[-1])
    catalog.QUERIES["bootstrap_stats"](spark, SF)
    assert seen[0].select("iteration").distinct().count() == catalog.robustness.BootstrapConfig().n_iterations
