"""Invariants of the built warehouse on the smallest test tables."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def wh(spark):
    from raceboard.plans.warehouse import built_warehouse
    return built_warehouse(spark, SF)


def test_positions_are_one_to_n(wh):
    for name, keys in (("report_seasons_metrics", ["year", "type", "metric"]),
                       ("report_season_metrics", ["year", "race", "type", "is_cumulative", "metric"])):
        per = wh.table(name).groupBy(*keys).agg(F.count("*").alias("n"), F.min("position").alias("lo"),
                                                F.max("position").alias("hi"),
                                                F.countDistinct("position").alias("d"))
        assert per.where("lo <> 1 OR hi <> n OR d <> n").count() == 0, name


def test_one_final_lap_per_race_driver(wh):
    laps = wh.table("fact_lap")
    per = laps.groupBy("race_k", "driver_k").agg(F.sum(F.col("is_final").cast("int")).alias("f"))
    assert per.where("f <> 1").count() == 0
    assert laps.where("is_final").count() == wh.table("fact_race_result").where("NOT is_sprint").count()


def test_cumulative_ends_at_season_total(wh):
    rep = wh.table("report_season_metrics")
    last = rep.groupBy("year", "type", "id", "metric").agg(F.max("race_date").alias("race_date"))
    cum = rep.where("is_cumulative").join(last, ["year", "type", "id", "metric", "race_date"]) \
        .select("year", "type", "id", "metric", F.col("metric_value").alias("cum"))
    tot = rep.where("NOT is_cumulative").groupBy("year", "type", "id", "metric") \
        .agg(F.sum(F.coalesce("metric_value", F.lit(0.0))).alias("tot"))
    assert cum.join(tot, ["year", "type", "id", "metric"]).where("cum <> tot").count() == 0


def test_one_champion_per_season_and_type(wh):
    ch = wh.table("report_seasons_metrics").where("metric = 'Championships'")
    per = ch.groupBy("year", "type").agg(F.sum("metric_value").alias("c"))
    assert per.where("c <> 1").count() == 0


def test_dense_grid(wh):
    rep = wh.table("report_seasons_metrics").where("type = 'Driver'")
    n_drivers = wh.table("dim_driver").count()
    per = rep.groupBy("year", "metric").count()
    assert per.where(F.col("count") != n_drivers).count() == 0
    years_with_races = wh.table("dim_race").select("year").distinct().count()
    assert per.select("year").distinct().count() == years_with_races + 1  # + the raceless-season group


def test_stints_start_at_one_or_two_and_never_fall(wh):
    from pyspark.sql import Window
    rm = wh.table("report_race_metrics")
    w = Window.partitionBy("year", "race_name", "driver_name").orderBy("lap", "pit_stop_time")
    prev = rm.withColumn("prev", F.lag("stint_number").over(w))
    assert prev.where("prev > stint_number").count() == 0
    first = rm.groupBy("year", "race_name", "driver_name").agg(F.min("stint_number").alias("s"))
    assert first.where("s NOT IN (1, 2)").count() == 0


def test_unpivot_row_counts(wh):
    conformed = wh.conformed
    from raceboard.plans import reports
    wide = reports.driver_race_metrics(conformed).count() + reports.constructor_race_metrics(conformed).count()
    assert reports.unpivot_season(conformed).count() == 3 * wide
    assert wh.table("report_season_metrics").count() == 6 * wide
