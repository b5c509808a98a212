"""Ranks by ranges, top-N with large N, totals from any season, entries, layouts and analysed tables."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from raceboard.operators.grid import MAX_CALENDAR, dense_period_metrics
from raceboard.operators import grid, ranking
from raceboard.operators.ranking import can_qualify, leaderboard_position, range_ordinal, top_n_by_value
from raceboard.plans import queries as q
from raceboard.plans import reports
from raceboard.sources import store

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), rnd.choice([None, 0.0, 0.0, 5.0, rnd.random() * 100]), i) for i in range(3000)]
    return spark.createDataFrame(rows, "g int, v double, id long").repartition(5)


def want_of(df):
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), F.col("id").asc())
    return {r.id: r.n for r in df.withColumn("n", F.row_number().over(w)).collect()}


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_range_ordinal_equals_row_number(spark, scores, tasks):
    got = range_ordinal(scores, ["g"], [F.col("v").desc_nulls_last(), F.col("id").asc()], "n", tasks=tasks)
    assert {r.id: r.n for r in got.collect()} == want_of(scores)
    assert got.columns == ["g", "v", "id", "n"] and dict(got.dtypes)["n"] == "int"
    assert range_ordinal(scores.limit(0), ["g"], [F.col("id").asc()], "n").count() == 0


def test_one_group_of_distinct_values_is_shared_by_all_tasks(spark):
    """A group of two million distinct values: one wide exchange, and no task over twice its share."""
    staged = {}

    def stage(name, df):
        staged[name] = (plan_of(df), ranking._scratch(name, df))
        return staged[name][1]

    n, tasks = 2_000_000, 8
    df = spark.range(n).select(F.lit(1).alias("g"), (F.xxhash64("id") / 1e3).alias("v"), "id")
    ranked = range_ordinal(df, ["g"], [F.col("v").desc()], "n", stage, tasks)
    assert staged["placed"][0].count("Exchange") == 1 and "rangepartitioning" in staged["placed"][0]
    sizes = [r["count"] for r in staged["placed"][1].groupBy(F.shiftright("__at", 33)).count().collect()]
    assert len(sizes) == tasks and max(sizes) < 2 * n / tasks
    assert "Window" not in plan_of(ranked)
    assert ranked.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, n, n)


@pytest.mark.parametrize("n", [3, 400, 1900, 10_000])
def test_large_top_n_equals_the_plain_one(spark, scores, monkeypatch, n):
    monkeypatch.setattr(ranking, "PARTIAL_TOP", 10)
    got = top_n_by_value(scores, ["g"], "v", "id", n)
    assert {r.id: r.position for r in got.collect()} == {i: p for i, p in want_of(scores).items() if p <= n}
    if n > 10:
        assert "WindowGroupLimit" not in plan_of(got)


def test_rows_that_cannot_qualify_go(spark):
    df = spark.range(100_000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"), "id")
    left = can_qualify(df, ["g"], "v", 500)
    assert left.count() < 700 and left.agg(F.min("v")).first()[0] <= 99_500


def test_dense_grid_beyond_the_calendar_limit(spark, monkeypatch):
    entities = spark.range(5).withColumnRenamed("id", "k")
    periods = spark.createDataFrame([(y, 2) for y in range(1990, 2000)] + [(None, 0)], "year int, n_races long")
    sums = spark.createDataFrame([(1, 1995, 4.0, 1, 1, 1, 1)], "k long, year int, points double, race_wins int, podiums int, n_present long, n_rows long")
    near = sorted(map(str, dense_period_metrics(entities, "k", periods, sums).collect()))
    monkeypatch.setattr(grid, "MAX_CALENDAR", 3)
    far = sorted(map(str, dense_period_metrics(entities, "k", periods, sums).select(
        *dense_period_metrics(entities, "k", periods, sums).columns).collect()))
    key = lambda rows: sorted(r.split("Row(")[1] for r in rows)
    assert MAX_CALENDAR > 3 and len(near) == len(far) == 55
    assert {tuple(sorted(x.rstrip(")").split(", "))) for x in key(near)} == {tuple(sorted(x.rstrip(")").split(", "))) for x in key(far)}


@needs_tables
def test_totals_answer_any_start_year_without_a_running_window(spark):
    from raceboard.plans.warehouse import built_warehouse
    wh = built_warehouse(spark, SF)
    report, totals = wh.table("report_seasons_metrics"), wh.table("season_totals")
    for start in (1900, 1994, 1997, 2050):
        got = q.seasons_rank(report, "Points", True, start, 1000, totals)
        want = q.seasons_rank(report, "Points", True, start, 1000)
        assert got.collect() == want.collect()
        assert "sum(" not in plan_of(got) and "sum(" in plan_of(want)


@needs_tables
def test_options_do_not_scan_the_fact(spark):
    from raceboard.plans.warehouse import built_warehouse
    wh = built_warehouse(spark, SF)
    entries, races, drivers = wh.table("race_entries"), wh.table("dim_race"), wh.table("dim_driver")
    for by, fact in ((q.race_options(entries, races, 1997), q.race_options(wh.table("fact_race_result"), races, 1997)),
                     (q.focus_options(entries, races, drivers, 1997, "Race 8"), q.focus_options(wh.table("fact_race_result"), races, drivers, 1997, "Race 8"))):
        assert sorted(map(tuple, by.collect())) == sorted(map(tuple, fact.collect())) and by.count() > 1
        assert "fact_race_result" not in plan_of(by) and "PartitionFilters: [isnotnull(year" in plan_of(by)


@needs_tables
def test_layouts_of_the_reports(spark):
    """Each report's folders and the order within its files (S10-S12, S16)."""
    from raceboard.plans.warehouse import built_warehouse
    wh = built_warehouse(spark, SF)
    for name, filters, order in (("report_seasons_metrics", "metric = 'Points' AND year = 1997", ["type", "position"]),
                                 ("report_season_metrics", "year = 1997 AND metric = 'Points'", ["is_cumulative", "position"]),
                                 ("report_race_metrics", "year = 1997", ["race_name", "driver_name", "lap"])):
        part = wh.table(name).where(filters)
        files = part.inputFiles()
        pruned = plan_of(part)
        for column in store.LAYOUTS[name].partition_by:
            assert f"isnotnull({column}" in pruned.split("PartitionFilters: [")[1].split("]")[0], name
        for f in sorted({r["_f"] for r in part.select(F.col("_metadata.file_path").alias("_f")).collect()}):
            rows = spark.read.parquet(f).select(*order).collect()
            assert rows == sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)), name
        assert files


def test_lookups_skip_row_groups(spark, tmp_path):
    """Values asked for out of sort order: Bloom filters leave out the row groups without them."""
    df = spark.range(200_000).select(F.lit(1999).alias("year"), F.col("id").alias("lap"), F.concat(F.lit("race "), F.xxhash64("id")).alias("race_name"))
    layout = store.Layout(("year",), ("lap",), ("race_name",))
    spark.conf.set("parquet.block.size", str(1 << 18))
    try:
        store.write_layout(df.coalesce(1), str(tmp_path / "t"), layout)
    finally:
        spark.conf.unset("parquet.block.size")
    wanted = df.where("lap = 150000").first()["race_name"]
    found = spark.read.parquet(str(tmp_path / "t")).where(F.col("race_name") == wanted)
    assert [r["lap"] for r in found.collect()] == [150000]
    scanned = [m for m in _scan_metrics(found)]
    assert 0 < scanned[0] < 100_000


def _scan_metrics(df):
    """Rows that the file scan of ``df`` handed on when it last ran."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan parquet"):
        node = node.executedPlan() if "AdaptiveSparkPlan" in node.nodeName() else node.children().head()
    return [node.metrics().apply("numOutputRows").value()]
