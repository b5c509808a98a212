"""Hand-written edge cases for the conformed tables and reports (literal expected rows)."""

import pytest
from pyspark.sql import functions as F

from raceboard.plans import conform, reports
from raceboard.plans import queries as q


def res(race, driver, cons=1, pos=None, order=1, points=0.0, grid=1, status=4):
    return {"raceId": race, "driverId": driver, "constructorId": cons, "position": pos, "positionOrder": order,
            "points": points, "grid": grid, "statusId": status}


STATUS = [{"statusId": 0, "status": "Engine"}, {"statusId": 1, "status": "+1 Lap"},
          {"statusId": 2, "status": "+2 laps"}, {"statusId": 4, "status": "Finished"}]


def race(rid, year, name=None, date=None):
    return {"raceId": rid, "circuitId": 1, "year": year, "name": name or f"R{rid}", "date": date or f"{year}-01-01",
            "url": f"race/{rid}"}


@pytest.fixture
def season_tables(make_staging, materialize):
    st = make_staging(
        seasons=[{"year": y, "url": f"season/{y}"} for y in (2010, 2011, 2012)],
        races=[race(1001, 2010, date="2010-03-01"), race(1002, 2010, date="2010-04-01"), race(1101, 2011)],
        drivers=[{"driverId": d, "forename": "D", "surname": str(d), "url": f"d/{d}"} for d in range(1, 6)],
        constructors=[{"constructorId": c, "name": f"C{c}", "url": f"c/{c}"} for c in (1, 2)],
        constructor_color=[{"constructorId": 1, "auto_color": "#111111", "custom_color": "#222222"},
                           {"constructorId": 2, "auto_color": "#333333"}],
        status=STATUS,
        circuits=[{"circuitId": 1, "url": "circuit/1"}],
        results=[res(1001, 1, pos=1, points=25.0), res(1101, 2, pos=None, order=3, status=0),
                 res(1001, 3, pos=None, order=4, status=0),
                 res(1101, 5, pos=None, order=5, points=0.0, status=0), res(1101, 5, cons=2, pos=2, points=18.0),
                 res(1002, 5, pos=3, order=3, points=15.0)],
        sprint_results=[res(1001, 1, pos=1, points=8.0)],
    )
    return materialize(conform.conform_all(st))


def test_wins_three_valued(season_tables):
    rows = {(r.year, r.id): r for r in reports.driver_year_metrics(season_tables).collect()}
    assert (rows[(2010, 1)].points, rows[(2010, 1)].race_wins) == (33.0, 1)          # (a) sprint counted in points only
    assert (rows[(2011, 2)].points, rows[(2011, 2)].race_wins, rows[(2011, 2)].podiums) == (0.0, None, None)  # (b)
    assert rows[(2010, 3)].race_wins == 0                                            # (c) DNF + absent
    assert (rows[(2010, 4)].points, rows[(2010, 4)].race_wins) == (None, 0)          # (d) never entered
    assert (rows[(2011, 5)].race_wins, rows[(2011, 5)].podiums, rows[(2011, 5)].points) == (0, 1, 18.0)  # (e)
    null_year = [r for (y, _), r in rows.items() if y is None]                       # (f) raceless season
    assert len(null_year) == 5 and all(r.points is None and r.race_wins == 0 for r in null_year)
    assert {r.season_wiki_url for r in null_year} == {"season/2012"}
    champs = {(r.year, r.id) for r in rows.values() if r.championships == 1.0}
    assert champs == {(2010, 1), (2011, 5), (None, 1)}


def test_constructor_colours_and_no_constructor(season_tables):
    colours = {r.constructor_k: r.color for r in season_tables["dim_constructor"].collect()}
    assert colours == {1: "#222222", 2: "#333333"}
    rows = {(r.year, r.id): r for r in reports.driver_year_metrics(season_tables).collect()}
    assert rows[(2010, 4)].constructor_name == "No Constructor"
    assert rows[(2010, 4)].constructor_color == "#BAB0AC"


def test_report_positions_are_gapless(season_tables):
    rep = reports.report_seasons_metrics(season_tables)
    per = rep.groupBy("year", "type", "metric").agg(F.count("*").alias("n"), F.max("position").alias("m"),
                                                     F.countDistinct("position").alias("d"))
    assert all(r.n == r.m == r.d for r in per.collect())


def test_race_grain_metrics(season_tables):
    rows = {(r.race_k, r.id): r for r in reports.driver_race_metrics(season_tables).collect()}
    assert (rows[(1002, 1)].points, rows[(1002, 1)].race_wins) == (None, 0)   # no result rows in that race
    assert (rows[(1101, 2)].points, rows[(1101, 2)].race_wins) == (0.0, None)  # DNF only
    assert rows[(1101, 5)].constructor_name == "C1"  # main rows first, then lowest constructor key
    rep = reports.report_season_metrics(season_tables)
    cum = {(r.race, r.metric): r.metric_value for r in rep.where("id = 1 AND type = 'Driver' AND is_cumulative")
           .collect()}
    assert cum[("R1001", "Points")] == 33.0 and cum[("R1002", "Points")] == 33.0


def test_primary_constructor(make_staging):
    results = [res(r, 6, cons=10) for r in (1, 2, 3)] + [res(r, 6, cons=11) for r in (4, 5)]
    results += [res(r, 7, cons=13) for r in (1, 2)] + [res(r, 7, cons=12) for r in (3, 4)]
    st = make_staging(races=[race(r, 2020) for r in range(1, 6)], results=results,
                      sprint_results=[res(r, 7, cons=13) for r in (3, 4, 5)])
    dc = {r.driver_k: r.constructor_k for r in conform.dim_driver_constructor(st).collect()}
    assert dc == {6: 10, 7: 12}


@pytest.fixture
def lap_tables(make_staging, materialize):
    results = [res(9, 1, pos=1, order=1, grid=0), res(9, 2, pos=None, order=5, grid=2, status=0),
               res(9, 3, pos=3, order=3, grid=3, status=1), res(9, 4, pos=4, order=4, grid=4, status=2),
               res(9, 5, pos=None, order=6, grid=5, status=99)]
    laps = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1), (6, 1)]
    lap_times = [{"raceId": 9, "driverId": d, "lap": l, "position": d, "milliseconds": 1000 * l + d} for d, l in laps]
    pits = [{"raceId": 9, "driverId": 1, "lap": 1, "stop": 1, "time": "a", "milliseconds": 20},
            {"raceId": 9, "driverId": 1, "lap": 1, "stop": 2, "time": "b", "milliseconds": 30},
            {"raceId": 9, "driverId": 1, "lap": 3, "stop": 3, "time": "c", "milliseconds": 40},
            {"raceId": 9, "driverId": 2, "lap": 2, "stop": 1, "time": "d", "milliseconds": 50}]
    st = make_staging(results=results, lap_times=lap_times, pit_stops=pits, status=STATUS,
                      races=[race(9, 2000, name="O'Race")],
                      drivers=[{"driverId": d, "forename": "D", "surname": "x" if d in (1, 2) else str(d),
                                "code": None if d == 3 else f"C{d}"} for d in range(1, 7)],
                      constructors=[{"constructorId": 1, "name": "C1"}])
    return materialize(conform.conform_all(st))


def test_fact_lap_zero_and_dnf(lap_tables):
    laps = {(r.driver_k, r.lap): r for r in lap_tables["fact_lap"].collect()}
    assert (1, 0) not in laps                                    # grid 0: pit-lane start
    assert (2, 0) in laps and laps[(2, 0)].position == 2
    assert (2, 3) in laps and laps[(2, 3)].position == 5 and laps[(2, 3)].milliseconds is None  # retirement row
    assert (3, 2) not in laps and (4, 2) not in laps            # lapped finishers, any case
    assert (5, 2) not in laps                                   # unknown status
    assert (6, 0) not in laps and (6, 2) not in laps            # laps without a result
    assert (1, 4) not in laps                                   # finisher on the last lap
    finals = {d for (d, _), r in laps.items() if r.is_final}
    assert finals == {1, 2, 3, 4, 5, 6}
    assert laps[(2, 3)].is_final and not laps[(2, 2)].is_final


def test_pit_stints_and_tire_age(lap_tables):
    rows = reports.report_race_metrics(lap_tables).collect()
    d1 = sorted(((r.lap, r.pit_stop_time, r.stint_number, r.tire_age) for r in rows if r.driver_code == "C1"),
                key=lambda t: (t[0], t[1] or ""))
    # two stops on lap 1 -> lap 2 appears twice, both in stint 3; the stop on the last lap vanishes.
    # Drivers 1 and 2 share the full name 'D x', so tyre age counts both drivers' rows of a stint
    # (stint 1 holds d2 lap 0, d1 lap 1, d2 lap 1, d2 lap 2).
    assert d1 == [(1, None, 1, 2), (2, "a", 3, 1), (2, "b", 3, 2), (3, None, 3, 3)]
    d2 = sorted((r.lap, r.is_pit_lap, r.stint_number, r.tire_age, r.ending_status) for r in rows
                if r.driver_code == "C2")
    # the stop on lap 2 lands on the retirement row (lap 3)
    assert [t[:4] for t in d2] == [(0, False, 1, 1), (1, False, 1, 3), (2, False, 1, 4), (3, True, 2, 1)]
    assert d2[-1][4] == "Engine"
    assert {r.driver_code for r in rows} >= {"#NA"}


def test_queries_bind_quoted_names(lap_tables):
    rep = reports.report_race_metrics(lap_tables)
    assert q.race_bump(rep, 2000, "O'Race").count() > 0
    fo = q.focus_options(lap_tables["fact_race_result"], lap_tables["dim_race"], lap_tables["dim_driver"],
                         2000, "O'Race")
    names = {r.full_name: r.sort_key for r in fo.collect()}
    assert names["None"] == 0 and names["D x"] == 1


def test_unknown_season_is_empty_with_schema(lap_tables):
    rep = reports.report_race_metrics(lap_tables)
    out = q.race_bump(rep, 1900, "nothing")
    assert out.count() == 0 and "tire_age" in out.columns
