"""Plan shape: what Catalyst should pick for the heavy operators."""

from pyspark.sql import functions as F

from raceboard.operators.ranking import top_n
from raceboard.plans import queries as q


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_uses_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    assert "WindowGroupLimit" in plan_of(top_n(df, ["g"], [F.col("v").desc()], 3))


def test_cumulative_leaderboard_limits_before_shuffle(spark):
    rows = [(2000 + y, t, i, "X", "c", "#000000", "w", "s", "Points", float(i % 5), i)
            for y in range(3) for t in ("Driver", "Constructor") for i in range(20)]
    rep = spark.createDataFrame(rows, "year int, type string, id long, name string, constructor_name string, "
                                      "constructor_color string, wiki_url string, season_wiki_url string, "
                                      "metric string, metric_value double, position int")
    out = q.seasons_rank(rep, "Points", True, 2001, 3)
    assert "WindowGroupLimit" in plan_of(out)
    assert out.count() == 2 * 2 * 3


def test_no_python_udfs_in_reports(spark):
    import glob
    import importlib
    import os
    root = os.path.dirname(importlib.import_module("raceboard").__file__)
    paths = [p for p in glob.glob(f"{root}/**/*.py", recursive=True) if os.path.relpath(p, root).split(os.sep)[0] != "llm"]
    assert paths
    for path in paths:
        text = open(path).read()
        assert "udf(" not in text and "pandas_udf" not in text, path
    importlib.import_module("raceboard.plans.reports")


FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def test_no_python_eval_or_nested_loop_joins(spark):
    import os

    import pytest

    from raceboard.plans import reports
    from raceboard.plans.registry import registry
    from raceboard.plans.warehouse import built_warehouse
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/lineitem.parquet"):
        pytest.skip("no test tables")
    wh = built_warehouse(spark, sf)
    plans = {name: plan_of(build()) for name, build in reports.builders(wh.conformed).items()}
    plans.update({name: plan_of(fn(spark, sf)) for name, fn in registry().items()
                  if not name.startswith("stg_")})
    bad = {name: op for name, p in plans.items() for op in FORBIDDEN if op in p}
    assert not bad
