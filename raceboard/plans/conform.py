"""Conformed warehouse: 6 dimensions and 4 facts built from the staging inputs.

Each builder takes the staging dict (``{name: DataFrame}``) and returns a lazy
DataFrame.  Joins against dimensions are plain equi-joins: Spark broadcasts a side
when its measured size (static statistics or AQE runtime size) is under the
broadcast threshold, and shuffles otherwise, so no dimension is assumed small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceboard.functions.columns import full_name, normalise_race_date
from raceboard.operators.ranking import best_of_group
from raceboard.operators.sequence import dnf_laps, final_lap_flag, lap_zero

Staging = Mapping[str, DataFrame]
Persist = Callable[[str, DataFrame], DataFrame]


def _identity(_name: str, df: DataFrame) -> DataFrame:
    return df


def dim_circuit(st: Staging) -> DataFrame:
    return st["circuits"].select(
        F.col("circuitId").alias("circuit_k"), F.col("circuitRef").alias("ref"), "name", "location", "country",
        F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), F.col("alt").alias("altitude"),
        F.col("url").alias("wiki_url"))


def dim_constructor(st: Staging) -> DataFrame:
    c = st["constructors"].alias("c")
    cs = st["constructor_color"].alias("cs")
    return c.join(cs, F.col("c.constructorId") == F.col("cs.constructorId"), "left").select(
        F.col("c.constructorId").alias("constructor_k"), F.col("c.constructorRef").alias("ref"),
        F.col("c.name").alias("name"), F.col("c.nationality").alias("nationality"),
        F.col("c.url").alias("wiki_url"),
        F.coalesce(F.col("cs.custom_color"), F.col("cs.auto_color")).alias("color"))


def dim_driver(st: Staging) -> DataFrame:
    return st["drivers"].select(
        F.col("driverId").alias("driver_k"), F.col("driverRef").alias("ref"), "number", "code",
        F.col("forename").alias("first_name"), F.col("surname").alias("last_name"),
        full_name("forename", "surname").alias("full_name"), "dob", "nationality",
        F.col("url").alias("wiki_url"))


def dim_race(st: Staging) -> DataFrame:
    return st["races"].select(
        F.col("raceId").alias("race_k"), F.col("circuitId").alias("circuit_k"), "year", "round", "name",
        normalise_race_date("date").alias("date"), "time", F.col("url").alias("wiki_url"))


def dim_season(st: Staging) -> DataFrame:
    return st["seasons"].select("year", F.col("url").alias("wiki_url"))


def fact_pit_stop(st: Staging) -> DataFrame:
    return st["pit_stops"].select(
        F.col("raceId").alias("race_k"), F.col("driverId").alias("driver_k"), "lap", "stop", "time",
        "duration", "milliseconds")


def fact_qualifying(st: Staging) -> DataFrame:
    return st["qualifying"].select(
        F.col("raceId").alias("race_k"), F.col("driverId").alias("driver_k"),
        F.col("constructorId").alias("constructor_k"), "number", "position", "q1", "q2", "q3")


def _result_rows(results: DataFrame, status: DataFrame, sprint: bool) -> DataFrame:
    r = results.alias("r")
    s = status.alias("s")
    has = set(results.columns)
    joined = r.join(s, F.col("r.statusId") == F.col("s.statusId"), "left")
    return joined.select(
        F.col("r.raceId").alias("race_k"), F.col("r.driverId").alias("driver_k"),
        F.col("r.constructorId").alias("constructor_k"), F.lit(sprint).alias("is_sprint"),
        F.col("r.number").alias("number"), F.col("r.grid").alias("grid"),
        F.col("r.position").cast("int").alias("position"), F.col("r.positionText").alias("position_text"),
        F.col("r.positionOrder").cast("int").alias("position_order"), F.col("r.points").alias("points"),
        F.col("r.laps").alias("laps"), F.col("r.time").alias("time"),
        F.col("r.milliseconds").alias("milliseconds"), F.col("r.fastestLap").alias("fastest_lap"),
        (F.col("r.rank") if "rank" in has else F.lit(None)).cast("int").alias("rank"),
        F.col("r.fastestLapTime").alias("fastest_lap_time"),
        (F.col("r.fastestLapSpeed") if "fastestLapSpeed" in has else F.lit(None)).cast("double")
        .alias("fastest_lap_speed"),
        F.col("s.status").alias("status"))


def fact_race_result(st: Staging) -> DataFrame:
    """Main and sprint results in one table, flagged by ``is_sprint``.

    Not unique per (race, driver): a driver may have a main and a sprint row, and a
    shared drive gives two main rows.
    """
    main = _result_rows(st["results"], st["status"], sprint=False)
    sprint = _result_rows(st["sprint_results"], st["status"], sprint=True)
    return main.unionByName(sprint)


def dim_driver_constructor(st: Staging) -> DataFrame:
    """Each driver's constructor per season: the one with most distinct main races.

    Ties go to the lowest constructor key.  Two aggregations (count per pair, then
    the best pair per driver-season), no window, so a prolific driver never needs
    one task.
    """
    re = st["results"].alias("re")
    ra = st["races"].alias("ra")
    pairs = (re.join(ra, F.col("re.raceId") == F.col("ra.raceId"), "left")
             .groupBy(F.col("ra.year").alias("year"), F.col("re.constructorId").alias("constructor_k"),
                      F.col("re.driverId").alias("driver_k"))
             .agg(F.countDistinct(F.col("re.raceId")).alias("n_races")))
    best = best_of_group(pairs, ["year", "driver_k"],
                         [-F.col("n_races"), F.col("constructor_k")],
                         {"constructor_k": "constructor_k"})
    return best.select("year", "constructor_k", "driver_k")


def fact_lap(st: Staging, persist: Persist | None = None) -> DataFrame:
    """Laps per (race, driver): grid lap 0, the timed laps and a synthetic retirement lap,
    with ``is_final`` on the last one.  ``persist`` may write the unflagged laps first."""
    zero = lap_zero(st["results"])
    real = st["lap_times"].select(
        F.col("raceId").alias("race_k"), F.col("driverId").alias("driver_k"), "lap", "position", "time",
        "milliseconds")
    zero_and_real = zero.unionByName(real)
    dnf = dnf_laps(zero_and_real, st["results"], st["status"])
    combined = (persist or _identity)("lap_rows", zero_and_real.unionByName(dnf))
    return final_lap_flag(combined)


def builders(st: Staging, persist: Persist | None = None) -> dict[str, Callable[[], DataFrame]]:
    """One thunk per conformed table (so a caller can plan and write them concurrently)."""
    return {
        "dim_circuit": lambda: dim_circuit(st),
        "dim_constructor": lambda: dim_constructor(st),
        "dim_driver": lambda: dim_driver(st),
        "dim_race": lambda: dim_race(st),
        "dim_season": lambda: dim_season(st),
        "dim_driver_constructor": lambda: dim_driver_constructor(st),
        "fact_lap": lambda: fact_lap(st, persist),
        "fact_pit_stop": lambda: fact_pit_stop(st),
        "fact_qualifying": lambda: fact_qualifying(st),
        "fact_race_result": lambda: fact_race_result(st),
    }


def conform_all(st: Staging, persist: Persist | None = None) -> dict[str, DataFrame]:
    return {name: build() for name, build in builders(st, persist).items()}
