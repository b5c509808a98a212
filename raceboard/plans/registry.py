"""Named queries over one input folder: ``name -> (spark, sf_dir) -> DataFrame``.

Every entry reads the star-schema tables in ``sf_dir`` (through the adapter) and
runs the warehouse on all of them; parameter sets are the dashboard's defaults
moved to the adapter's seasons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.functions.columns import NULL_TOKENS
from raceboard.operators.palette import cycle_palette
from raceboard.operators.sequence import dnf_laps, lap_zero
from raceboard.plans import display, queries, reports
from raceboard.plans.warehouse import Warehouse, built_warehouse
from raceboard.session import scratch_path
from raceboard.sources import csv_files
from raceboard.sources.schemas import STAGING

Query = Callable[[SparkSession, str], DataFrame]

# --- parameter sets ----------------------------------------------------------------
SEASONS_PODIUMS = ("Podiums", True, 1995, 10)
SEASONS_EVERYONE = ("Points", True, 1992, 1_000_000)  # more than there are entities
SEASONS_POINTS = ("Points", True, 1998, 3)
SEASONS_CHAMPIONS = ("Championships", False, 1995, 1)
SEASON_POINTS = ("Points", False, 1999, 10)
SEASON_POINTS_CUM = ("Points", True, 1999, 10)
SEASON_WINS = ("Race Wins", False, 1999, 5)
BUMP_SEASON, BUMP_RACE, BUMP_FOCUS = 1999, "Race 8", "Supplier 10"
ADHOC_SQL = ("SELECT metric, type, COUNT(*) AS n_rows, SUM(metric_value) AS total "
             "FROM report_seasons_metrics WHERE year >= :start GROUP BY metric, type")
ADHOC_ARGS = {"start": 1995}
# ------------------------------------------------------------------------------------


def _wh(spark: SparkSession, sf_dir: str) -> Warehouse:
    return built_warehouse(spark, sf_dir)


def _table(name: str) -> Query:
    return lambda spark, sf: _wh(spark, sf).table(name)


def _step(fn: Callable[[dict], DataFrame], cols: tuple[str, ...] | None = None) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(_wh(spark, sf).conformed)
        return df.select(*cols) if cols else df
    return run


def _seasons_rank(params) -> Query:
    return lambda spark, sf: queries.seasons_rank(_wh(spark, sf).table("report_seasons_metrics"), *params, _wh(spark, sf).table("season_totals"))


def _season_rank(params) -> Query:
    return lambda spark, sf: queries.season_rank(_wh(spark, sf).table("report_season_metrics"), *params)


def _race(spark: SparkSession, sf: str) -> DataFrame:
    return queries.race_bump(_wh(spark, sf).table("report_race_metrics"), BUMP_SEASON, BUMP_RACE)


def stg_results_via_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Main results written as staging CSV (``\\N`` nulls) and read back by name."""
    folder = scratch_path(spark, "staging-csv")
    csv_files.write_staging({"results": _wh(spark, sf).staging["results"]}, folder)
    return csv_files.read_staging(spark, folder, ["results"])["results"]


def stg_drivers_null_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Drivers written with assorted NULL spellings, reversed column order and an extra
    column, then read back: NULLs come back as NULL, columns bind by name."""
    drivers = _wh(spark, sf).staging["drivers"]
    tokens = [t for t in NULL_TOKENS if t != "\\N"]
    pick = F.element_at(F.array(*[F.lit(t) for t in tokens]), (F.col("driverId") % len(tokens) + 1).cast("int"))
    texts = [F.coalesce(F.col(c).cast("string"), pick).alias(c) for c in reversed(drivers.columns)]
    mangled = drivers.select(F.lit("unused").alias("extra"), *texts)
    folder = scratch_path(spark, "staging-null-markers")
    csv_files.write_staging({"drivers": mangled}, folder)
    return csv_files.read_staging_file(spark, f"{folder}/drivers.csv", STAGING["drivers"])


def palette_assign(spark: SparkSession, sf: str) -> DataFrame:
    """The colour file, written as CSV and read back by name, with the palette dealt by key order."""
    folder = scratch_path(spark, "staging-colors")
    csv_files.write_staging({"constructor_color": _wh(spark, sf).staging["constructor_color"]}, folder)
    colors = csv_files.read_staging(spark, folder, ["constructor_color"])["constructor_color"]
    return cycle_palette(colors.drop("auto_color"), "constructorId", "auto_color") \
        .select("constructorId", "name", "auto_color", "custom_color")


def _staged(fn: Callable[[dict], DataFrame]) -> Query:
    return lambda spark, sf: fn(_wh(spark, sf).staging)


def _zero_and_real(st: dict) -> DataFrame:
    real = st["lap_times"].select(F.col("raceId").alias("race_k"), F.col("driverId").alias("driver_k"), "lap",
                                  "position", "time", "milliseconds")
    return lap_zero(st["results"]).unionByName(real)


def _dnf(st: dict) -> DataFrame:
    return dnf_laps(_zero_and_real(st), st["results"], st["status"])


def _max_lap(st: dict) -> DataFrame:
    return _zero_and_real(st).groupBy("race_k").agg(F.max("lap").alias("max_lap"))


def _champions(t: dict) -> DataFrame:
    both = reports.driver_year_metrics(t).unionByName(reports.constructor_year_metrics(t))
    return both.where(F.col("championships") == 1.0).select("year", "type", "id")


def _seasons_frames(spark, sf):
    return display.frames_seasons(_seasons_rank(SEASONS_PODIUMS)(spark, sf))


def _season_frames(spark, sf):
    return display.frames_season(_season_rank(SEASON_POINTS_CUM)(spark, sf))


def _adhoc(spark: SparkSession, sf: str) -> DataFrame:
    wh = _wh(spark, sf)
    return queries.adhoc_sql(spark, {"report_seasons_metrics": wh.table("report_seasons_metrics")},
                             ADHOC_SQL, ADHOC_ARGS)


def registry() -> dict[str, Query]:
    q: dict[str, Query] = {
        # sources
        "stg_results": stg_results_via_csv,
        "stg_null_markers": stg_drivers_null_markers,
        "palette_assign": palette_assign,
        # conformed tables
        **{name: _table(name) for name in (
            "dim_circuit", "dim_constructor", "dim_driver", "dim_race", "dim_season", "dim_driver_constructor",
            "fact_lap", "fact_pit_stop", "fact_qualifying", "fact_race_result")},
        # lap chain steps
        "lap_zero": _staged(lambda st: lap_zero(st["results"])),
        "zero_and_real_laps": _staged(_zero_and_real),
        "max_lap_per_race": _staged(_max_lap),
        "dnf_laps": _staged(_dnf),
        # season-grain report steps
        "driver_year_metrics": _step(reports.driver_year_metrics),
        "constructor_year_metrics": _step(reports.constructor_year_metrics),
        "champion_flag": _step(_champions),
        "unpivot_seasons": _step(reports.unpivot_seasons),
        "report_seasons_metrics": _table("report_seasons_metrics"),
        # race-grain report steps
        "season_drivers": _step(reports.season_drivers, ("year", "driver_k", "full_name", "wiki_url")),
        "season_constructors": _step(reports.season_constructors,
                                     ("year", "constructor_k", "name", "color", "wiki_url")),
        "season_races": _step(reports.season_races),
        "driver_race_metrics": _step(reports.driver_race_metrics),
        "constructor_race_metrics": _step(reports.constructor_race_metrics),
        "unpivot_season": _step(reports.unpivot_season),
        "running_total": _step(reports.season_running_totals),
        "report_season_metrics": _table("report_season_metrics"),
        # lap-grain report steps
        "pit_shift_join": _step(reports.pit_shift_join),
        "pit_stint": _step(reports.race_lap_data),
        "tire_age": lambda spark, sf: _wh(spark, sf).table("report_race_metrics").select(
            "year", "race_name", "driver_name", "lap", "stint_number", "pit_stop_time", "tire_age"),
        "report_race_metrics": _table("report_race_metrics"),
        # dashboard queries
        "seasons_rank_cumulative": _seasons_rank(SEASONS_PODIUMS),
        "seasons_rank_cumulative_points": _seasons_rank(SEASONS_POINTS),
        "seasons_rank": _seasons_rank(SEASONS_CHAMPIONS),
        "seasons_rank_everyone": _seasons_rank(SEASONS_EVERYONE),
        "season_rank": _season_rank(SEASON_POINTS),
        "season_rank_cumulative": _season_rank(SEASON_POINTS_CUM),
        "season_rank_wins": _season_rank(SEASON_WINS),
        "race_bump": _race,
        "race_options": lambda spark, sf: queries.race_options(
            _wh(spark, sf).table("race_entries"), _wh(spark, sf).table("dim_race"), BUMP_SEASON),
        "focus_options": lambda spark, sf: _focus(spark, sf),
        "metric_domain": lambda spark, sf: queries.metric_domain(_wh(spark, sf).table("report_seasons_metrics")),
        "year_domain": lambda spark, sf: _year_domain(spark, sf),
        "adhoc_sql": _adhoc,
        # chart data
        "frames_seasons": _seasons_frames,
        "frame_links": lambda spark, sf: display.frame_links(
            _seasons_rank(SEASONS_PODIUMS)(spark, sf), "year", ["season_wiki_url"],
            display.chart_title(SEASONS_PODIUMS[0], SEASONS_PODIUMS[1])),
        "axis_ranges": lambda spark, sf: display.axis_ranges(_seasons_rank(SEASONS_PODIUMS)(spark, sf)),
        "frames_season": _season_frames,
        "frame_links_season": lambda spark, sf: display.frame_links(
            _season_rank(SEASON_POINTS_CUM)(spark, sf), "race",
            ["race_wiki_url", "circuit_wiki_url", "season_wiki_url"],
            display.chart_title(SEASON_POINTS_CUM[0], SEASON_POINTS_CUM[1], SEASON_POINTS_CUM[2])),
        "driver_series": lambda spark, sf: display.driver_series(_race(spark, sf), BUMP_FOCUS),
        "end_labels": lambda spark, sf: display.end_labels(_race(spark, sf)),
        "start_labels": lambda spark, sf: display.start_labels(_race(spark, sf)),
        "bump_axis": lambda spark, sf: display.bump_axis(_race(spark, sf), display.bump_title(BUMP_SEASON, BUMP_RACE)),
        "text_contrast": lambda spark, sf: display.constructor_text_colors(_wh(spark, sf).table("dim_constructor")),
    }
    return q


def _focus(spark: SparkSession, sf: str) -> DataFrame:
    wh = _wh(spark, sf)
    return queries.focus_options(wh.table("race_entries"), wh.table("dim_race"), wh.table("dim_driver"),
                                 BUMP_SEASON, BUMP_RACE)


def _year_domain(spark: SparkSession, sf: str) -> DataFrame:
    wh = _wh(spark, sf)
    return queries.year_domain(wh.table("dim_race"), wh.table("report_race_metrics"))
