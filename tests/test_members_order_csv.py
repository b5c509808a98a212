"""Orphan keys, result order, unbounded N, CSV text, the command line and the checkpoint folder."""

import json

import pytest
from pyspark.sql import functions as F

from raceboard.functions.columns import clock_text
from raceboard.plans import conform, reports
from raceboard.plans import queries as q
from raceboard.session import ensure_checkpoint_dir
from raceboard.sources import csv_files
from raceboard.sources.schemas import STAGING


@pytest.fixture
def orphans(make_staging, materialize):
    """One known and two unknown drivers and constructors in one race."""
    res = lambda d, c, p: {"raceId": 1, "driverId": d, "constructorId": c, "position": 1, "positionOrder": 1, "points": p, "grid": 1, "statusId": 4}
    st = make_staging(
        seasons=[{"year": 2000, "url": "s"}], races=[{"raceId": 1, "circuitId": 1, "year": 2000, "name": "R", "date": "2000-01-01", "url": "r"}],
        drivers=[{"driverId": 10, "forename": "D", "surname": "x", "url": "d"}], constructors=[{"constructorId": 1, "name": "C", "url": "c"}],
        constructor_color=[{"constructorId": 1, "auto_color": "#111111"}], circuits=[{"circuitId": 1, "url": "u"}],
        status=[{"statusId": 4, "status": "Finished"}],
        results=[res(10, 1, 25.0), res(98, 7, 15.0), res(99, 8, 18.0)])
    return materialize(conform.conform_all(st))


def test_unknown_members_are_one_row_without_points(orphans):
    assert {(r.year, r.driver_k) for r in reports.season_drivers(orphans).collect()} == {(2000, 10), (2000, None)}
    assert {(r.year, r.constructor_k) for r in reports.season_constructors(orphans).collect()} == {(2000, 1), (2000, None)}
    rows = sorted(((r.id, r.points, r.race_wins, r.podiums) for r in reports.driver_race_metrics(orphans).collect()), key=str)
    assert rows == [(10, 25.0, 1, 1), (None, None, 0, 0)]
    rows = sorted(((r.id, r.points, r.race_wins) for r in reports.constructor_race_metrics(orphans).collect()), key=str)
    assert rows == [(1, 25.0, 1), (None, None, 0)]


@pytest.fixture
def ranking(spark):
    rows = [(2000 + y, t, i, f"n{i}", "c", "#1", "w", "s", "Points", float(i), 5 - i) for y in range(2) for t in ("Driver", "Constructor") for i in range(5)]
    return spark.createDataFrame(rows, "year int, type string, id long, name string, constructor_name string, constructor_color string, "
                                       "wiki_url string, season_wiki_url string, metric string, metric_value double, position int")


def test_leaderboards_fall_in_position_and_n_has_no_bound(ranking):
    for cumulative in (False, True):
        rows = [(r.year, r.type, r.position) for r in q.seasons_rank(ranking, "Points", cumulative, 2000, 5000).collect()]
        assert rows == [(y, t, p) for y in (2000, 2001) for t in ("Constructor", "Driver") for p in (5, 4, 3, 2, 1)]
    with pytest.raises(ValueError):
        q.seasons_rank(ranking, "Points", False, 2000, 0)


def test_season_rank_and_bump_order(spark):
    rows = [(2000, f"2000-0{m}-01", "Driver", p, "Points", False) for m in (2, 1) for p in (1, 3, 2)]
    report = spark.createDataFrame(rows, "year int, race_date string, type string, position int, metric string, is_cumulative boolean")
    assert [(r.race_date, r.position) for r in q.season_rank(report, "Points", False, 2000, 9).collect()] == [
        (d, p) for d in ("2000-01-01", "2000-02-01") for p in (3, 2, 1)]
    laps = spark.createDataFrame([(2000, "2000-01-01", "R", c, d, n) for n in (2, 1) for c in "ba" for d in "yx"],
                                 "year int, race_date string, race_name string, constructor_name string, driver_name string, lap int")
    got = [(r.constructor_name, r.driver_name, r.lap) for r in q.race_bump(laps, 2000, "R").collect()]
    assert got == sorted(got) and len(got) == 8


def test_csv_quotes_newlines_and_none(spark, tmp_path):
    path = tmp_path / "status.csv"
    path.write_text('statusId,status\n1,"a ""q"", b"\n2,"two\nlines"\n3,None\n4,\\N\n5,NA\n')
    rows = {r.statusId: r.status for r in csv_files.read_staging_file(spark, str(path), STAGING["status"]).collect()}
    assert rows == {1: 'a "q", b', 2: "two\nlines", 3: "None", 4: None, 5: None}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y'), (2, "line\nbreak"), (3, None)], STAGING["status"])
    csv_files.write_staging({"status": df}, str(tmp_path))
    back = csv_files.read_staging_file(spark, f"{tmp_path}/status.csv", STAGING["status"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_integer_clock_beyond_double(spark):
    minutes = 150_000_000_000_001
    assert spark.range(1).select(clock_text(F.lit(60_000 * minutes + 1_001))).first()[0] == f"{minutes}:01.001"


class _Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf(**values)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="checkpoint"):
        ensure_checkpoint_dir(_Session(**{"spark.master": "spark://x:7077"}))
    assert ensure_checkpoint_dir(_Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///c"})) == "hdfs:///c"


def test_cli_prints_or_writes_every_row(spark, tmp_path, capsys, monkeypatch, ranking):
    from raceboard import __main__ as cli
    many = ranking.select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k")).drop("k")

    class Built:
        def table(self, name):
            return many

    monkeypatch.setattr(cli.Warehouse, "open", classmethod(lambda cls, s, d: Built()))
    args = ["seasons-rank", "--warehouse", "x", "--start-year", "2000", "--top", "5"]
    cli.main(args)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(lines) == 20 * 20
    cli.main([*args, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 400
