"""Parameterised queries over the reports (the dashboard's data requests).

Parameters are bound as literals/columns, never pasted into SQL text, so a race
name with a quote works.  Every function returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.functions.columns import NO_FOCUS
from raceboard.operators.cumulative import running_total
from raceboard.operators.ranking import top_n_by_value

LEADERBOARD_COLUMNS = ("year", "type", "id", "name", "constructor_name", "constructor_color", "wiki_url",
                       "season_wiki_url", "metric_value", "position")
# So many rows of each season or race and type are few enough for one task to put in order.
FEW = 1000


def _check_top_n(top: int) -> int:
    top = int(top)
    if top < 1:
        raise ValueError("top_n must be 1 or more")
    return top


def seasons_rank(report: DataFrame, metric: str, cumulative: bool, start_year: int, top: int,
                 totals: DataFrame | None = None) -> DataFrame:
    """Top ``top`` per season and type for ``metric`` from ``start_year`` on.

    Cumulative: totals run from ``start_year`` (per entity, seasons in order) and are
    re-ranked per season.  With the stored ``totals`` (``reports.season_totals``) each is the
    difference of the totals through its season and through the last season before
    ``start_year``, where every entity has a row; without them a running window sums.  Only
    narrow columns are shuffled for the rank; the winners then pick up names, colours and
    links from a pruned scan, in whichever join their size calls for.
    Rows come by year, type and falling position.
    """
    top = _check_top_n(top)
    m = report.where((F.col("year") >= F.lit(int(start_year))) & (F.col("metric") == F.lit(metric)))
    if not cumulative:
        return _shown(m.where(F.col("position") <= top).select(*LEADERBOARD_COLUMNS), top, "year", "type", F.col("position").desc())
    if totals is None:
        narrow = running_total(m.select("year", "type", "id", "metric_value"), ["id", "type"], [F.col("year").asc()],
                               "metric_value", "cumulative_metric_value").drop("metric_value")
    else:
        of_metric = totals.where(F.col("metric") == F.lit(metric))
        earlier = of_metric.where(F.col("year") < F.lit(int(start_year)))
        before = earlier.where(F.col("year") == earlier.agg(F.max("year")).scalar()).select("type", "id", F.col("total").alias("before"))
        since = F.col("total") - F.coalesce("before", F.lit(0))
        narrow = (of_metric.where(F.col("year") >= F.lit(int(start_year))).join(before, ["type", "id"], "left")
                  .select("year", "type", "id", since.cast("double").alias("cumulative_metric_value")))
    winners = top_n_by_value(narrow, ["year", "type"], "cumulative_metric_value", "id", top).select(
        "year", "type", "id", "cumulative_metric_value", "position")
    attrs = m.select("year", "type", "id", "name", "constructor_name", "constructor_color", "wiki_url",
                     "season_wiki_url")
    return _shown(attrs.join(winners, ["year", "type", "id"], "inner").withColumnRenamed("cumulative_metric_value", "metric_value")
                  .select(*LEADERBOARD_COLUMNS), top, "year", "type", F.col("position").desc())


def _shown(rows: DataFrame, top: int, *order: str | Column) -> DataFrame:
    """Rows in order. The first few of each frame fit one task, which sorts them; more are
    sorted by ranges, which costs a sampling job and an exchange."""
    return rows.repartition(1).sortWithinPartitions(*order) if top <= FEW else rows.orderBy(*order)


def season_rank(report: DataFrame, metric: str, cumulative: bool, season: int, top: int) -> DataFrame:
    """Top ``top`` per race of ``season`` for ``metric`` (per race or running through the season),
    by race date, type and falling position."""
    top = _check_top_n(top)
    return _shown(report.where((F.col("year") == F.lit(int(season))) & (F.col("metric") == F.lit(metric))
                               & (F.col("is_cumulative") == F.lit(bool(cumulative))) & (F.col("position") <= top)),
                  top, "race_date", "type", F.col("position").desc())


def race_bump(report: DataFrame, season: int, race: str) -> DataFrame:
    """Lap-by-lap rows of one race, by constructor, driver and lap."""
    return (report.where((F.col("year") == F.lit(int(season))) & (F.col("race_name") == F.lit(race)))
            .orderBy("year", "race_date", "constructor_name", "driver_name", "lap"))


def _of_season(results: DataFrame, season: int) -> DataFrame:
    """Entries (``reports.race_entries``) have their season's folder; result rows are joined to its races."""
    return results.where(F.col("year") == F.lit(int(season))) if "year" in results.columns else results


def race_options(results: DataFrame, races: DataFrame, season: int) -> DataFrame:
    """Names of the season's races that have results, with their (latest) date for ordering.

    ``results``: the race entries, of which only the season's folder is read, or the whole fact.
    """
    r = races.where(F.col("year") == F.lit(int(season))).select("race_k", "name", "date")
    named = _of_season(results, season).select("race_k").distinct().join(r, "race_k", "inner")
    return named.groupBy("name").agg(F.max("date").alias("race_date")).orderBy("race_date", "name")


def focus_options(results: DataFrame, races: DataFrame, drivers: DataFrame, season: int, race: str) -> DataFrame:
    """Driver names of one race's main results, plus the leading 'None' option (sort_key 0).

    ``results`` as in ``race_options``.
    """
    r = races.where((F.col("year") == F.lit(int(season))) & (F.col("name") == F.lit(race))).select("race_k")
    rr = _of_season(results, season).where(~F.col("is_sprint")).select("race_k", "driver_k")
    names = (rr.join(r, "race_k", "inner").join(drivers.select("driver_k", "full_name"), "driver_k", "left")
             .select("full_name").distinct())
    listed = names.select(F.col("full_name"), F.lit(1).alias("sort_key"))
    none_row = results.sparkSession.range(1).select(F.lit(NO_FOCUS).alias("full_name"), F.lit(0).alias("sort_key"))
    return none_row.unionByName(listed)


def metric_domain(report: DataFrame) -> DataFrame:
    return report.select("metric").distinct()


def year_domain(races: DataFrame, race_report: DataFrame) -> DataFrame:
    """Season range offered for leaderboards and the range that has lap data."""
    lap_years = race_report.agg(F.min("year").alias("min_lap_year"), F.max("year").alias("max_lap_year"))
    return lap_years.select(races.agg(F.min("year")).scalar().alias("min_year"),
                            races.agg(F.max("year")).scalar().alias("max_year"), "min_lap_year", "max_lap_year")


def adhoc_sql(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str,
              args: Mapping[str, object] | None = None) -> DataFrame:
    """Run user SQL against the warehouse tables registered as temp views (named params)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args or {}))
