"""Versioned replace and append load: a failed build changes nothing, an append equals a full rebuild."""

import os

import pytest
from pyspark.sql import functions as F

from raceboard.plans import append as ap
from raceboard.plans import conform, reports
from raceboard.plans.warehouse import Warehouse, built_warehouse
from raceboard.sources import store
from raceboard.sources.versions import VersionedStore, segment_of

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test tables")
LAYOUT = store.Layout(("year", "kind"), ("n",), ("n",), "year")


def rows(spark, years, tag, n=6):
    return spark.createDataFrame([(y, f"kind {k}/%", i, f"{tag}{i}") for y in years for k in range(2) for i in range(n)], "year int, kind string, n int, tag string")


def test_a_version_counts_only_once_committed(spark, tmp_path):
    vs = VersionedStore(spark, str(tmp_path / "s"))
    assert vs.current() == {} and vs.versions() == []
    first = vs.begin()
    first.write("t", rows(spark, [1, 2], "a"), LAYOUT)
    first.write("staging/u", spark.range(3))
    assert vs.current() == {}
    first.commit()
    assert vs.read("t").count() == 24 and vs.read("staging/u").count() == 3
    dead = vs.begin()  # never committed
    dead.write("t", rows(spark, [9], "dead"), LAYOUT)
    assert {r["tag"][0] for r in vs.read("t").collect()} == {"a"}
    second = vs.begin()
    second.write("t", rows(spark, [3], "b"), LAYOUT)
    second.carry("staging/u")
    old = vs.read("t")
    second.commit()
    assert sorted(r["year"] for r in vs.read("t").select("year").distinct().collect()) == [3]
    assert old.count() == 24  # a reader of the version before keeps its files
    assert vs.read("t").schema == rows(spark, [], "").schema
    gone = vs.prune(keep=1)
    assert gone == sorted([f"t/build={first.id}", f"t/build={dead.id}"])
    assert vs.read("t").count() == 12 and vs.read("staging/u").count() == 3


def test_segments_are_replaced_one_by_one(spark, tmp_path):
    vs = VersionedStore(spark, str(tmp_path / "s"))
    b = vs.begin()
    b.write("t", rows(spark, [1, 2, None], "a").withColumn("season", F.col("year")).drop("year"), store.Layout(("season", "kind"), ("n",), (), "season"), ["season"])
    b.commit()
    assert vs.read("t").columns == ["kind", "n", "tag"] and vs.read("t").count() == 36
    c = vs.begin()
    c.write("t", rows(spark, [2, 5], "b").withColumnRenamed("year", "season").select("kind", "n", "tag", "season"),
            store.Layout(("season", "kind"), ("n",), (), "season"), ["season"], replacing=[2, 5])
    c.commit()
    got = {(r["season"], r["tag"][0]): r["c"] for r in vs.read("t", with_hidden=True).groupBy("season", "tag").count().groupBy("season", F.substring("tag", 1, 1).alias("tag")).agg(F.sum("count").alias("c")).collect()}
    assert got == {(1, "a"): 12, (2, "b"): 12, (5, "b"): 12, (None, "a"): 12}
    d = vs.begin()
    d.write("t", rows(spark, [], "x").withColumnRenamed("year", "season").select("kind", "n", "tag", "season"),
            store.Layout(("season", "kind"), ("n",), (), "season"), ["season"], replacing=[None, 1])
    d.commit()
    assert {r["season"] for r in vs.read("t", with_hidden=True).collect()} == {2, 5}
    plan = vs.read("t", with_hidden=True).where("season = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


def test_extend_copies_no_row(spark, tmp_path):
    vs = VersionedStore(spark, str(tmp_path / "s"))
    b = vs.begin()
    b.write("staging/u", spark.range(3))
    b.commit()
    c = vs.begin()
    assert c.extend("staging/u", spark.range(10, 12)).count() == 5
    assert sorted(r["id"] for r in c.written("staging/u").collect()) == [10, 11]
    assert vs.read("staging/u").count() == 3
    c.commit()
    assert vs.read("staging/u").count() == 5


def same(a, b, name):
    b = b.select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


@pytest.fixture(scope="module")
def parts(spark):
    """All staging rows of the smallest tables, dealt into a base and what is appended to it:
    one race of 1997 with all its rows, one driver and one constructor's colour."""
    full = {n: df for n, df in built_warehouse(spark, SF).staging.items()}
    race = full["races"].where("year = 1997").agg(F.max("raceId")).first()[0]
    return full, race


@needs_tables
def test_append_of_a_race_equals_a_rebuild(spark, parts, tmp_path):
    full, race = parts
    out = str(tmp_path / "wh")
    in_race = [n for n, df in full.items() if "raceId" in df.columns]
    base = {n: df.where(F.col("raceId") != race) if n in in_race else df for n, df in full.items()}
    Warehouse(spark, base).write(out)
    vs = VersionedStore(spark, out)
    before = vs.current()
    wh = ap.append(spark, out, {n: full[n].where(F.col("raceId") == race) for n in in_race})
    want = built_warehouse(spark, SF)
    for name in [*conform.builders({}), *reports.builders({})]:
        same(wh.table(name), want.table(name), name)
    after = vs.current()
    new = ap.rewritten(before, after)
    # only 1997 (and the raceless group of the cross-season report) was written anew
    for name in ("fact_lap", "fact_race_result", "report_season_metrics", "report_race_metrics", "report_seasons_metrics"):
        segment = store.LAYOUTS[name].segment
        own = [f for folder in new[name] if "build=v2" in folder for f in (vs.leaf_folders(folder) if segment_of(folder, segment) is None else [folder])]
        assert {segment_of(f, segment) for f in own} <= {"1997", "__HIVE_DEFAULT_PARTITION__"} and own, name
        kept = [f for f in after[name].folders if "build=v1" in f]
        assert kept and "1997" not in {segment_of(f, segment) for f in kept}, name
    assert not new["dim_driver"] and not new["dim_constructor"] and not new["dim_season"]


@needs_tables
def test_append_of_late_dimension_rows_equals_a_rebuild(spark, parts, tmp_path):
    """A driver, a colour and a status that results already refer to arrive later."""
    full, _ = parts
    out = str(tmp_path / "wh")
    late = {"drivers": F.col("driverId") == 3, "constructor_color": F.col("constructorId") <= 2, "status": F.col("statusId") == 1}
    Warehouse(spark, {n: df.where(~late[n]) if n in late else df for n, df in full.items()}).write(out)
    wh = ap.append(spark, out, {n: full[n].where(c) for n, c in late.items()})
    want = built_warehouse(spark, SF)
    for name in [*conform.builders({}), *reports.builders({})]:
        same(wh.table(name), want.table(name), name)


@needs_tables
def test_a_build_killed_half_way_leaves_the_old_tables(spark, parts, tmp_path, monkeypatch):
    full, _ = parts
    out = str(tmp_path / "wh")
    small = {n: df.where("year = 1997") if n == "races" else df for n, df in full.items()}
    with pytest.raises(FileNotFoundError):
        Warehouse.open(spark, out)
    Warehouse(spark, small).write(out)
    want = {n: Warehouse.open(spark, out).table(n).collect() for n in ("dim_race", "report_seasons_metrics")}
    monkeypatch.setattr(reports, "report_season_metrics", lambda t, persist=None: t["fact_lap"].select(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        Warehouse(spark, full).write(out)
    opened = Warehouse.open(spark, out)
    for name, rows_ in want.items():
        assert sorted(map(str, opened.table(name).collect())) == sorted(map(str, rows_)), name
    monkeypatch.undo()
    assert any(g.startswith("dim_race/") for g in VersionedStore(spark, out).prune())  # the dead build's folders go
    assert Warehouse.open(spark, out).table("dim_race").count() == len(want["dim_race"])


@needs_tables
def test_append_needs_the_staging_rows(spark, tmp_path):
    vs = VersionedStore(spark, str(tmp_path / "s"))
    b = vs.begin()
    b.write("dim_race", spark.range(1))
    b.commit()
    with pytest.raises(ValueError, match="no staging rows"):
        ap.append(spark, str(tmp_path / "s"), {})
