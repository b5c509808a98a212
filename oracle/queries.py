"""Final SELECT per query key (appended to the shared CTE chain in ``duckdb_sql``)."""

from __future__ import annotations

# The questions asked, stated here again so that a changed parameter in the library shows.
ADHOC_ARGS = {'start': 1995}
BUMP_FOCUS = 'Supplier 10'
BUMP_RACE = 'Race 8'
BUMP_SEASON = 1999
SEASON_POINTS = ('Points', False, 1999, 10)
SEASON_POINTS_CUM = ('Points', True, 1999, 10)
SEASON_WINS = ('Race Wins', False, 1999, 5)
SEASONS_CHAMPIONS = ('Championships', False, 1995, 1)
SEASONS_PODIUMS = ('Podiums', True, 1995, 10)
SEASONS_EVERYONE = ("Points", True, 1992, 1_000_000)
SEASONS_POINTS = ('Points', True, 1998, 3)

LB = "year, type, id, name, constructor_name, constructor_color, wiki_url, season_wiki_url"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def seasons_rank(metric, cumulative, start, top) -> str:
    chosen = f"SELECT {LB}, metric_value, position FROM report_seasons_metrics WHERE metric = {q(metric)} AND year >= {start}"
    if not cumulative:
        return f"{chosen} AND position <= {top}"
    return f"""
    SELECT * REPLACE ((row_number() OVER standing)::INTEGER AS position)
    FROM (SELECT * REPLACE (sum(ifnull(metric_value, 0)) OVER career AS metric_value) FROM ({chosen})
          WINDOW career AS (PARTITION BY type, id ORDER BY year ROWS UNBOUNDED PRECEDING))
    WINDOW standing AS (PARTITION BY type, year ORDER BY metric_value DESC NULLS LAST, id)
    QUALIFY row_number() OVER standing <= {top}"""


def season_rank(metric, cumulative, season, top) -> str:
    return (f"FROM report_season_metrics WHERE position <= {top} AND is_cumulative = {bool(cumulative)} "
            f"AND metric = {q(metric)} AND year = {season}")


RACE = f"SELECT * FROM report_race_metrics WHERE year = {BUMP_SEASON} AND race_name = {q(BUMP_RACE)}"


def hexbyte(col: str, pos: int) -> str:
    digits = "'0123456789ABCDEF'"
    hi = f"(instr({digits}, upper(substr({col}, {pos}, 1))) - 1)"
    lo = f"(instr({digits}, upper(substr({col}, {pos + 1}, 1))) - 1)"
    return f"({hi} * 16 + {lo})"


def contrast(col: str) -> str:
    c = f"COALESCE({col}, '#BAB0AC')"
    w = f"({hexbyte(c, 2)} * 299 + {hexbyte(c, 4)} * 587 + {hexbyte(c, 6)} * 114)"
    return f"CASE WHEN {w} < 125000 THEN '#FFFFFF' ELSE '#000000' END"


SEASONS_Q = seasons_rank(*SEASONS_PODIUMS)
SEASON_Q = season_rank(*SEASON_POINTS_CUM)
STG_RESULT_COLS = ("raceId, driverId, constructorId, number, grid, position, positionText, positionOrder, points, "
                   "laps, time, milliseconds, fastestLap, rank, fastestLapTime, fastestLapSpeed, statusId")
YEAR_METRIC_CASTS = ("CAST(race_wins AS BIGINT) AS race_wins, CAST(podiums AS BIGINT) AS podiums")

FINAL_SELECTS: dict[str, str] = {
    "stg_results": f"SELECT {STG_RESULT_COLS} FROM stg_results",
    "stg_null_markers": "SELECT * FROM stg_drivers",
    "palette_assign": "SELECT * FROM stg_constructor_color",
    **{name: f"SELECT * FROM {name}" for name in (
        "dim_circuit", "dim_constructor", "dim_driver", "dim_race", "dim_season", "dim_driver_constructor",
        "fact_lap", "fact_pit_stop", "fact_qualifying", "fact_race_result", "lap_zero", "zero_and_real_laps",
        "dnf_laps", "unpivot_seasons", "report_seasons_metrics", "season_drivers", "season_constructors",
        "season_races", "report_season_metrics", "pit_shift_join", "report_race_metrics")},
    "max_lap_per_race": "SELECT race_k, max_lap FROM max_laps",
    "driver_year_metrics": f"SELECT * EXCLUDE (race_wins, podiums, championships), {YEAR_METRIC_CASTS}, "
                           "CAST(championships AS DOUBLE) AS championships FROM driver_year_metrics",
    "constructor_year_metrics": f"SELECT * EXCLUDE (race_wins, podiums, championships), {YEAR_METRIC_CASTS}, "
                                "CAST(championships AS DOUBLE) AS championships FROM constructor_year_metrics",
    "champion_flag": "SELECT year, type, id FROM driver_year_metrics WHERE championships = 1 "
                     "UNION ALL SELECT year, type, id FROM constructor_year_metrics WHERE championships = 1",
    "driver_race_metrics": f"SELECT * EXCLUDE (race_wins, podiums), {YEAR_METRIC_CASTS} FROM driver_race_metrics",
    "constructor_race_metrics": f"SELECT * EXCLUDE (race_wins, podiums), {YEAR_METRIC_CASTS} "
                                "FROM constructor_race_metrics",
    "unpivot_season": "FROM unpivot_season",
    "running_total": """
        SELECT *, sum(ifnull(metric_value, 0)) OVER (PARTITION BY metric, type, id, year
                   ORDER BY race_date NULLS FIRST, race_k NULLS FIRST ROWS UNBOUNDED PRECEDING) AS cumulative_value
        FROM unpivot_season""",
    "pit_stint": "SELECT * FROM race_lap_data",
    "tire_age": "SELECT year, race_name, driver_name, lap, stint_number, pit_stop_time, tire_age "
                "FROM report_race_metrics",
    "seasons_rank_cumulative": SEASONS_Q,
    "seasons_rank_cumulative_points": seasons_rank(*SEASONS_POINTS),
    "seasons_rank": seasons_rank(*SEASONS_CHAMPIONS),
    "seasons_rank_everyone": seasons_rank(*SEASONS_EVERYONE),
    "season_rank": season_rank(*SEASON_POINTS),
    "season_rank_cumulative": SEASON_Q,
    "season_rank_wins": season_rank(*SEASON_WINS),
    "race_bump": RACE,
    "race_options": f"""
        SELECT name, max(date) AS race_date FROM dim_race
        WHERE year = {BUMP_SEASON} AND race_k IN (SELECT race_k FROM fact_race_result) GROUP BY ALL""",
    "focus_options": f"""
        SELECT DISTINCT who.full_name, 1 AS sort_key
        FROM fact_race_result res LEFT JOIN dim_driver who USING (driver_k)
        WHERE NOT is_sprint AND race_k IN (SELECT race_k FROM dim_race WHERE name = {q(BUMP_RACE)} AND year = {BUMP_SEASON})
        UNION ALL SELECT 'None', 0""",
    "metric_domain": "SELECT DISTINCT metric FROM report_seasons_metrics",
    "year_domain": """
        SELECT * FROM (SELECT MIN(year) AS min_year, MAX(year) AS max_year FROM dim_race)
        CROSS JOIN (SELECT MIN(year) AS min_lap_year, MAX(year) AS max_lap_year FROM report_race_metrics)""",
    "adhoc_sql": f"""
        SELECT metric, type, COUNT(*) AS n_rows, SUM(metric_value) AS total
        FROM report_seasons_metrics WHERE year >= {ADHOC_ARGS['start']} GROUP BY metric, type""",
    "frames_seasons": f"""
        SELECT CAST(DENSE_RANK() OVER (ORDER BY year) AS INTEGER) AS frame_index, year AS frame_label, type,
               position, id, name, metric_value, constructor_name, constructor_color, wiki_url
        FROM ({SEASONS_Q})""",
    "frame_links": f"""
        SELECT year, season_wiki_url, 'Cumulative Podiums by Season and Driver/Constructor' AS title FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY type, position DESC) AS rn FROM ({SEASONS_Q}))
        WHERE rn = 1""",
    "axis_ranges": f"SELECT type, MAX(metric_value) AS axis_max FROM ({SEASONS_Q}) GROUP BY type",
    "frames_season": f"""
        SELECT CAST(DENSE_RANK() OVER (ORDER BY race_date, race) AS INTEGER) AS frame_index, race AS frame_label,
               type, position, id, name, metric_value, constructor_name, constructor_color, wiki_url
        FROM ({SEASON_Q})""",
    "frame_links_season": f"""
        SELECT race, race_wiki_url, circuit_wiki_url, season_wiki_url,
               'Cumulative Points by Race and Driver/Constructor in 1999' AS title FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY race ORDER BY race_date, type, position DESC) AS rn
            FROM ({SEASON_Q}))
        WHERE rn = 1""",
    "driver_series": f"""
        SELECT b.driver_name, b.constructor_name, b.lap, b.position, b.ending_status, f.series_color,
               CAST(CASE WHEN {q(BUMP_FOCUS)} = 'None' OR b.driver_name = {q(BUMP_FOCUS)} THEN 0.75 ELSE 0.25 END
                    AS DOUBLE) AS opacity
        FROM ({RACE}) AS b
        LEFT JOIN (SELECT driver_name, constructor_color AS series_color FROM (
                       SELECT *, ROW_NUMBER() OVER (PARTITION BY driver_name ORDER BY constructor_name, lap) AS rn
                       FROM ({RACE})) WHERE rn = 1) AS f ON b.driver_name = f.driver_name""",
    "end_labels": f"""
        SELECT driver_code, position, COALESCE(constructor_color, '#BAB0AC') AS bg_color,
               {contrast('constructor_color')} AS text_color, CAST(max_lap AS DOUBLE) * CAST(1.071 AS DOUBLE) AS x
        FROM ({RACE}) CROSS JOIN (SELECT MAX(lap) AS max_lap FROM ({RACE}))
        WHERE ending_status IS NOT NULL""",
    "start_labels": f"""
        SELECT driver_code, position, COALESCE(constructor_color, '#BAB0AC') AS bg_color,
               {contrast('constructor_color')} AS text_color, CAST(0 AS DOUBLE) AS x
        FROM ({RACE}) WHERE lap = 0""",
    "bump_axis": f"""
        SELECT CAST(MAX(lap) AS DOUBLE) * CAST(1.071 AS DOUBLE) AS x_max,
               CAST(MAX(position) AS DOUBLE) + CAST(0.2 AS DOUBLE) AS y_max,
               '{BUMP_SEASON} {BUMP_RACE} Bump Chart' AS title
        FROM ({RACE})""",
    "text_contrast": f"SELECT constructor_k, color, {contrast('color')} AS text_color FROM dim_constructor",
}
