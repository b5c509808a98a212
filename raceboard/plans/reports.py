"""The three report tables and their named intermediate steps.

* ``report_seasons_metrics``: per season, every driver and constructor with points,
  race wins, podiums and championships, ranked (``position``) per metric.
* ``report_season_metrics``: per race of a season, the same metrics per race and as
  running totals through the season, ranked per race.
* ``report_race_metrics``: lap-by-lap positions with pit stops, stints and tyre age.

Inputs are the conformed tables (``conform.conform_all``) as a dict.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceboard.functions.columns import (
    DEFAULT_CONSTRUCTOR_COLOR,
    MISSING_DRIVER_CODE,
    NO_CONSTRUCTOR,
)
from raceboard.operators.cumulative import episode_number, running_total
from raceboard.operators.grid import calendar_lookup, dense_period_metrics, result_sums, within_calendar
from raceboard.operators.ranking import AUTO, best_of_group, id_cell, leaderboard_position, ordinal, tuning
from raceboard.operators.sequence import LAP_CELL
from raceboard.operators.reshape import unpivot_metrics, with_running_variant

Tables = Mapping[str, DataFrame]
Persist = Callable[[str, DataFrame], DataFrame]


def _identity(_name: str, df: DataFrame) -> DataFrame:
    return df


def _named(prefix: str, persist: Persist | None) -> Persist | None:
    """``persist`` under names of its own; without one, operators write to a scratch folder."""
    return persist and (lambda name, df: persist(f"{prefix}_{name}", df))


# --- fixed values: metric labels, in report order ---------------------------------
SEASON_METRICS = {"points": "Points", "race_wins": "Race Wins", "podiums": "Podiums",
                  "championships": "Championships"}
RACE_METRICS = {"points": "Points", "race_wins": "Race Wins", "podiums": "Podiums"}
DRIVER, CONSTRUCTOR = "Driver", "Constructor"
# ----------------------------------------------------------------------------------

SEASONS_COLUMNS = ("year", "type", "id", "name", "constructor_name", "constructor_color", "wiki_url",
                   "season_wiki_url", "metric", "metric_value", "position")
SEASON_COLUMNS = ("year", "race", "race_date", "type", "id", "name", "constructor_name", "constructor_color",
                  "wiki_url", "race_wiki_url", "circuit_wiki_url", "season_wiki_url", "metric", "metric_value",
                  "is_cumulative", "position")
RACE_COLUMNS = ("year", "race_name", "race_date", "constructor_name", "constructor_color", "driver_name",
                "driver_code", "ending_status", "lap", "position", "lap_time", "lap_milliseconds",
                "pit_stop_time", "pit_stop_milliseconds", "net_lap_milliseconds", "is_pit_lap", "stint_number",
                "tire_age")
SEASON_WIDE = ("year", "type", "id", "name", "constructor_name", "constructor_color", "wiki_url", "season_wiki_url",
               "points", "race_wins", "podiums", "championships")
UNPIVOTED = ("year", "race", "race_date", "type", "id", "name", "constructor_name", "constructor_color", "wiki_url",
             "race_wiki_url", "circuit_wiki_url", "season_wiki_url", "metric", "metric_value")
RACE_WIDE = ("race_k", *UNPIVOTED[:-2], "points", "race_wins", "podiums")
TOTAL = "decimal(28,9)"


# ---------------------------------------------------------------- season grain ---

def season_periods(t: Tables) -> DataFrame:
    """One row per season year that has races, plus one NULL-year row for all raceless
    seasons: ``year, n_races, season_wiki_url``."""
    s = t["dim_season"].alias("s")
    r = t["dim_race"].alias("r")
    return (s.join(r, F.col("s.year") == F.col("r.year"), "left")
            .groupBy(F.col("r.year").alias("year"))
            .agg(F.count(F.col("r.race_k")).alias("n_races"), F.min(F.col("s.wiki_url")).alias("season_wiki_url")))


def _results_with_year(t: Tables) -> DataFrame:
    rr = t["fact_race_result"]
    race_year = t["dim_race"].select("race_k", "year").where(F.col("year").isNotNull())
    return rr.join(race_year, "race_k", "inner")


def champion_flag(metrics: DataFrame, sums: DataFrame, entities: DataFrame, entity_key: str,
                  periods: DataFrame) -> DataFrame:
    """``championships`` = 1.0 for the season's top points row (ties -> lowest id), else 0.0.

    Found without re-running the dense grid or ranking a whole season: among entities
    with results the best (points desc, NULLs last, id) is an aggregation of the
    per-(year, entity) sums; a season where nobody has points (a NULL-year group, or no
    result rows at all) goes to the lowest entity id of the grid.  The winners (one per
    season) are looked up in a map.
    """
    pts = F.col("points")
    scored = sums.where(F.col("year").isNotNull()).join(entities.select(entity_key), entity_key, "left_semi")
    best = best_of_group(scored, ["year"], [pts.isNull(), -pts, F.col(entity_key)],
                         {"best_points": "points", "best_id": entity_key})
    lowest = entities.agg(F.min(entity_key)).scalar()
    champs = (periods.select("year").join(best, "year", "left")
              .select("year", F.when(F.col("best_points").isNotNull(), F.col("best_id"))
                      .otherwise(lowest).cast("bigint").alias("champion_id")))
    winner = calendar_lookup(champs, "year", "champion_id")(F.col("year"))
    return metrics.withColumn("championships", F.when(F.col("id") == winner, F.lit(1.0)).otherwise(F.lit(0.0)))


def _driver_year_values(t: Tables) -> DataFrame:
    """``year, type, id`` and the four metrics of every driver in every season: keys and values only."""
    periods = season_periods(t)
    sums = result_sums(_results_with_year(t), ["year", "driver_k"])
    drivers = t["dim_driver"].select("driver_k")
    grid = dense_period_metrics(drivers, "driver_k", periods.select("year", "n_races"), sums)
    metrics = grid.select("year", F.lit(DRIVER).alias("type"), F.col("driver_k").cast("bigint").alias("id"), "points", "race_wins", "podiums")
    return champion_flag(metrics, sums, drivers, "driver_k", periods)


def _constructor_year_values(t: Tables) -> DataFrame:
    periods = season_periods(t)
    sums = result_sums(_results_with_year(t), ["year", "constructor_k"])
    cons = t["dim_constructor"].select("constructor_k")
    grid = dense_period_metrics(cons, "constructor_k", periods.select("year", "n_races"), sums)
    metrics = grid.select("year", F.lit(CONSTRUCTOR).alias("type"), F.col("constructor_k").cast("bigint").alias("id"), "points", "race_wins", "podiums")
    return champion_flag(metrics, sums, cons, "constructor_k", periods)


def _entities(t: Tables) -> DataFrame:
    """``type, id, name, wiki_url`` of every driver and constructor."""
    drivers = t["dim_driver"].select(F.lit(DRIVER).alias("type"), F.col("driver_k").cast("bigint").alias("id"), F.col("full_name").alias("name"), "wiki_url")
    cons = t["dim_constructor"].select(F.lit(CONSTRUCTOR).alias("type"), F.col("constructor_k").cast("bigint").alias("id"), "name", "wiki_url")
    return drivers.unionByName(cons)


def _with_names(t: Tables, rows: DataFrame) -> DataFrame:
    """Names, links and colours for rows with ``type, id, team_k`` (a constructor is its own team)."""
    c = t["dim_constructor"].select(F.col("constructor_k").cast("bigint").alias("team_k"), F.col("name").alias("c_name"), F.col("color").alias("c_color"))
    is_driver = F.col("type") == DRIVER
    named = rows.join(_entities(t), ["type", "id"], "left").join(c, "team_k", "left").drop("team_k")
    return (named.withColumn("constructor_name", F.when(is_driver, F.coalesce("c_name", F.lit(NO_CONSTRUCTOR))).otherwise(F.col("c_name")))
            .withColumn("constructor_color", F.when(is_driver, F.coalesce("c_color", F.lit(DEFAULT_CONSTRUCTOR_COLOR))).otherwise(F.col("c_color")))
            .drop("c_name", "c_color"))


def _with_season_attributes(t: Tables, rows: DataFrame) -> DataFrame:
    """What a row of (year, type, id) shows: attached last, so that grids, ranks and their
    exchanges carry keys and values only."""
    teams = t["dim_driver_constructor"].select("year", F.lit(DRIVER).alias("type"), F.col("driver_k").cast("bigint").alias("id"),
                                               F.col("constructor_k").cast("bigint").alias("dc_k"))
    teamed = rows.join(teams, ["year", "type", "id"], "left")
    teamed = teamed.withColumn("team_k", F.when(F.col("type") == CONSTRUCTOR, F.col("id")).otherwise(F.col("dc_k"))).drop("dc_k")
    links = calendar_lookup(season_periods(t), "year", "season_wiki_url")
    return _with_names(t, teamed).withColumn("season_wiki_url", links(F.col("year")))


def driver_year_metrics(t: Tables) -> DataFrame:
    return _with_season_attributes(t, _driver_year_values(t)).select(*SEASON_WIDE)


def constructor_year_metrics(t: Tables) -> DataFrame:
    return _with_season_attributes(t, _constructor_year_values(t)).select(*SEASON_WIDE)


def _season_values(t: Tables) -> DataFrame:
    """``year, type, id, metric, metric_value`` of every driver and constructor in every season."""
    combined = _driver_year_values(t).unionByName(_constructor_year_values(t))
    return unpivot_metrics(combined, ["year", "type", "id"], SEASON_METRICS)


def unpivot_seasons(t: Tables) -> DataFrame:
    return _with_season_attributes(t, _season_values(t)).select(*[c for c in SEASONS_COLUMNS if c != "position"])


def report_seasons_metrics(t: Tables, persist: Persist | None = None) -> DataFrame:
    ranked = leaderboard_position(_season_values(t), ["year", "type", "metric"], "metric_value", "id", stage=_named("seasons", persist))
    return _with_season_attributes(t, ranked).select(*SEASONS_COLUMNS)


def season_totals(report: DataFrame) -> DataFrame:
    """``metric, year, type, id, total``: each metric summed from the first season through each.

    A total from any season on is the difference of two of them, exact in decimals.
    """
    rows = report.where(F.col("year").isNotNull()).select("metric", "year", "type", "id", F.col("metric_value").cast(TOTAL).alias("value"))
    return running_total(rows, ["metric", "type", "id"], [F.col("year").asc()], "value", "total").select(
        "metric", "year", "type", "id", F.col("total").cast(TOTAL).alias("total"))


# ------------------------------------------------------------------ race grain ---

def season_races(t: Tables) -> DataFrame:
    """Races that have at least one result; the results are reduced to their race keys, task
    by task, before anything is shuffled."""
    rr = t["fact_race_result"].select("race_k").distinct()
    return t["dim_race"].join(rr, "race_k", "left_semi")


def _season_members(t: Tables, key: str) -> DataFrame:
    """Distinct (year, member key) of everyone with a result in a season."""
    rr = t["fact_race_result"].select("race_k", key)
    years = t["dim_race"].select("race_k", "year")
    return rr.join(years, "race_k", "inner").select("year", key).distinct()


def _known_members(t: Tables, key: str, dim: DataFrame) -> DataFrame:
    """``year, key`` under the dimension's key: all that the dimension lacks are one row per
    season with a NULL key, which no result joins."""
    known = dim.select(F.col(key).alias("__known"))
    found = _season_members(t, key).join(known, F.col(key) == F.col("__known"), "left")
    return found.select("year", F.col("__known").alias(key)).distinct()


def season_drivers(t: Tables) -> DataFrame:
    return _known_members(t, "driver_k", t["dim_driver"]).join(t["dim_driver"], "driver_k", "left")


def season_constructors(t: Tables) -> DataFrame:
    return _known_members(t, "constructor_k", t["dim_constructor"]).join(t["dim_constructor"], "constructor_k", "left")


def _race_context(t: Tables) -> DataFrame:
    """Season races with their circuit and season links (one row per race)."""
    r = season_races(t).select("race_k", "year", F.col("name").alias("race"), F.col("date").alias("race_date"),
                               F.col("wiki_url").alias("race_wiki_url"), "circuit_k")
    cir = t["dim_circuit"].select("circuit_k", F.col("wiki_url").alias("circuit_wiki_url"))
    s = t["dim_season"].groupBy("year").agg(F.min("wiki_url").alias("season_wiki_url"))
    return r.join(cir, "circuit_k", "left").join(s, "year", "left").drop("circuit_k")


def _race_grid(members: DataFrame, key: str, races: DataFrame, sums: DataFrame) -> DataFrame:
    """members-of-season × races-of-season (keys only), with the member's result sums for that race.

    No result rows: points NULL, wins/podiums 0.  The races of each season are one
    map value (season -> its races), read once as a scalar subquery; each member row looks up
    its season and explodes that season's races.  No join on ``year`` alone, which would send
    a whole season to one task.  A calendar beyond its limit (see ``within_calendar``) is
    joined in parts instead.
    """
    listed = races.where(F.col("year").isNotNull()).select("year", "race_k")
    if within_calendar(listed):
        per_season = listed.groupBy("year").agg(F.collect_list("race_k").alias("races"))
        calendar = per_season.agg(F.map_from_entries(F.collect_list(F.struct("year", "races")))).scalar()
        dealt = members.select("year", key, F.explode(F.try_element_at(calendar, F.col("year"))).alias("race_k"))
    else:
        parts = 64  # a member meets its season's races in so many tasks
        dealt = (members.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                 .join(listed.withColumn("__part", F.pmod(F.xxhash64("race_k"), F.lit(parts)).cast("int")), ["year", "__part"]).drop("__part"))
    grid = dealt.join(sums, ["race_k", key], "left")
    absent = F.col("n_rows").isNull()
    return (grid
            .withColumn("race_wins", F.when(absent, F.lit(0)).otherwise(F.col("race_wins")))
            .withColumn("podiums", F.when(absent, F.lit(0)).otherwise(F.col("podiums"))))


def _driver_race_values(t: Tables) -> DataFrame:
    """``year, race_k, type, id, team_k`` and the metrics of every driver in every race of their seasons."""
    # The constructor shown for a driver in a race: main result first, then lowest key;
    # picked inside the same aggregation that sums the race's results.
    team = F.min(F.struct(F.col("is_sprint"), F.col("constructor_k")))["constructor_k"].alias("team_k")
    sums = result_sums(t["fact_race_result"], ["race_k", "driver_k"], team)
    grid = _race_grid(_known_members(t, "driver_k", t["dim_driver"]), "driver_k", season_races(t), sums)
    return grid.select("year", "race_k", F.lit(DRIVER).alias("type"), F.col("driver_k").cast("bigint").alias("id"), F.col("team_k").cast("bigint").alias("team_k"),
                       "points", "race_wins", "podiums")


def _constructor_race_values(t: Tables) -> DataFrame:
    sums = result_sums(t["fact_race_result"], ["race_k", "constructor_k"])
    grid = _race_grid(_known_members(t, "constructor_k", t["dim_constructor"]), "constructor_k", season_races(t), sums)
    own = F.col("constructor_k").cast("bigint")
    return grid.select("year", "race_k", F.lit(CONSTRUCTOR).alias("type"), own.alias("id"), own.alias("team_k"), "points", "race_wins", "podiums")


def _with_race_attributes(t: Tables, rows: DataFrame, persist: Persist | None = None) -> DataFrame:
    """What a row of (race_k, type, id, team_k) shows, attached last."""
    context = (persist or _identity)("race_context", _race_context(t)).drop("year")
    return _with_names(t, rows).join(context, "race_k", "left")


def driver_race_metrics(t: Tables) -> DataFrame:
    return _with_race_attributes(t, _driver_race_values(t)).select(*RACE_WIDE)


def constructor_race_metrics(t: Tables) -> DataFrame:
    return _with_race_attributes(t, _constructor_race_values(t)).select(*RACE_WIDE)


def _race_values(t: Tables) -> DataFrame:
    combined = _driver_race_values(t).unionByName(_constructor_race_values(t))
    return unpivot_metrics(combined, ["year", "race_k", "type", "id", "team_k"], RACE_METRICS)


def unpivot_season(t: Tables) -> DataFrame:
    return _with_race_attributes(t, _race_values(t)).select("race_k", *UNPIVOTED)


def _race_order(t: Tables) -> DataFrame:
    """``race_k, race_no, board``: a race's place in its season, and the lowest key among the
    season's races of its name (they share a leaderboard). The table of races is the calendar's size."""
    r = season_races(t).select("race_k", "year", "name", "date")
    in_order = Window.partitionBy("year").orderBy(F.col("date").asc_nulls_first(), F.col("race_k").asc_nulls_first())
    return r.select("race_k", F.row_number().over(in_order).alias("race_no"), F.min("race_k").over(Window.partitionBy("year", "name")).alias("board"))


def _running_values(t: Tables, persist: Persist | None = None) -> DataFrame:
    """Per-race values and their running totals through the season (race date order): keys and values only."""
    order = (persist or _identity)("race_order", _race_order(t))
    return running_total(_race_values(t).join(order, "race_k", "left"), ["year", "id", "type", "metric"], [F.col("race_no").asc_nulls_first()],
                         "metric_value", "cumulative_value")


def season_running_totals(t: Tables) -> DataFrame:
    """Per-race metric plus its running total through the season (race date order)."""
    return _with_race_attributes(t, _running_values(t)).select("race_k", *UNPIVOTED, "cumulative_value")


def report_season_metrics(t: Tables, persist: Persist | None = None) -> DataFrame:
    both = with_running_variant(_running_values(t, persist).drop("race_no"), "metric_value", "cumulative_value", "is_cumulative")
    ranked = leaderboard_position(both, ["year", "board", "type", "is_cumulative", "metric"], "metric_value", "id", stage=_named("season", persist))
    return _with_race_attributes(t, ranked, persist).select(*SEASON_COLUMNS)


def race_entries(t: Tables) -> DataFrame:
    """``year, race_k, driver_k, is_sprint``: who has a result where (``is_sprint``: only a sprint
    one). What the race and focus options need of the results, in the folders of the seasons."""
    years = t["dim_race"].select("race_k", "year")
    entries = t["fact_race_result"].groupBy("race_k", "driver_k").agg(F.min("is_sprint").alias("is_sprint"))
    return entries.join(years, "race_k", "left").select("year", "race_k", "driver_k", "is_sprint")


# ------------------------------------------------------------------- lap grain ---

def pit_shift_join(t: Tables) -> DataFrame:
    """Laps with the pit stop made on the *previous* lap (its time lands on the out-lap)."""
    l = t["fact_lap"]
    ps = t["fact_pit_stop"].select(
        "race_k", "driver_k", (F.col("lap") + 1).alias("lap"), F.col("race_k").alias("ps_race_k"),
        F.col("time").alias("pit_stop_time"), F.col("milliseconds").alias("pit_stop_milliseconds"))
    return l.join(ps, ["race_k", "driver_k", "lap"], "left")


def race_lap_data(t: Tables, persist: Persist | None = None) -> DataFrame:
    laps = pit_shift_join(t)
    rr = t["fact_race_result"].where(~F.col("is_sprint")).select(
        "race_k", "driver_k", "constructor_k", F.col("status").alias("rr_status"))
    r = t["dim_race"].select("race_k", "year", F.col("name").alias("race_name"), F.col("date").alias("race_date"))
    d = t["dim_driver"].select("driver_k", F.col("full_name").alias("driver_name"), "code")
    c = t["dim_constructor"].select("constructor_k", F.col("name").alias("constructor_name"),
                                    F.col("color").alias("constructor_color"))
    joined = (laps.join(rr, ["race_k", "driver_k"], "inner")
              .join(r, "race_k", "left").join(d, "driver_k", "left").join(c, "constructor_k", "left"))
    is_pit = F.col("ps_race_k").isNotNull()
    data = joined.select(
        "race_k", "driver_k", "year", "race_name", "race_date", "constructor_name", "constructor_color",
        "driver_name", F.coalesce("code", F.lit(MISSING_DRIVER_CODE)).alias("driver_code"),
        F.when(F.col("is_final"), F.col("rr_status")).alias("ending_status"),
        "lap", "position", F.col("time").alias("lap_time"), F.col("milliseconds").alias("lap_milliseconds"),
        "pit_stop_time", "pit_stop_milliseconds",
        (F.col("milliseconds") - F.coalesce("pit_stop_milliseconds", F.lit(0))).alias("net_lap_milliseconds"),
        is_pit.alias("is_pit_lap"))
    data = (persist or _identity)("race_lap_rows", data)
    return episode_number(data, ["race_k", "driver_k"], "lap", F.col("is_pit_lap"), "stint_number")


def report_race_metrics(t: Tables, persist: Persist | None = None) -> DataFrame:
    """Lap rows with stint and tyre age.  ``persist`` may write the lap data (with
    stints) first, so the tyre-age numbering starts from a table, not the whole join."""
    data = (persist or _identity)("race_lap_data", race_lap_data(t, persist))
    aged = ordinal(data, ["year", "race_name", "driver_name", "stint_number"],
                   [F.col("lap").asc(), F.col("driver_code").asc_nulls_first(),
                    F.col("pit_stop_time").asc_nulls_first(), F.col("pit_stop_milliseconds").asc_nulls_first()],
                   "tire_age", cells=[(id_cell("lap", tuning(data, "lapCell", LAP_CELL)), True)], hot_rows=AUTO)
    return aged.select(*RACE_COLUMNS)


def builders(t: Tables, persist: Persist | None = None) -> dict[str, Callable[[], DataFrame]]:
    """One thunk per report (so a caller can plan and write them concurrently)."""
    return {
        "report_seasons_metrics": lambda: report_seasons_metrics(t, persist),
        "report_season_metrics": lambda: report_season_metrics(t, persist),
        "report_race_metrics": lambda: report_race_metrics(t, persist),
        "race_entries": lambda: race_entries(t),
    }


def build_reports(t: Tables, persist: Persist | None = None) -> dict[str, DataFrame]:
    return {name: build() for name, build in builders(t, persist).items()}
