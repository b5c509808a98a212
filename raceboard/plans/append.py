"""Append load: add staging rows to a built warehouse and rewrite only what they touch.

The added rows are closed over seasons: the seasons of every race they belong to or change
the meaning of (a late driver row gives earlier results a name). Positions, running totals,
stints and tyre ages never reach beyond a season, so the facts and the race-grain reports of
those seasons are computed from those seasons' staging rows alone and replace the seasons'
folders; all other folders are carried over. The report across seasons is replaced season by
season too, unless a driver or constructor is new, who then gets rows in every season.

The new version becomes current with one manifest write at the end (``sources.versions``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.plans import conform, reports
from raceboard.plans.warehouse import Warehouse, _opened, _wave, keeper, seasons_of
from raceboard.sources.schemas import STAGING, conform_columns
from raceboard.sources.versions import Table, VersionedStore

FACT_INPUTS = ("results", "sprint_results", "lap_times", "pit_stops", "qualifying")
#: Rows of these inputs give a meaning to a key that the named inputs may hold already.
REFERENCES: dict[str, tuple[str, tuple[str, ...]]] = {
    "drivers": ("driverId", FACT_INPUTS),
    "constructors": ("constructorId", ("results", "sprint_results", "qualifying")),
    "constructor_color": ("constructorId", ("results", "sprint_results", "qualifying")),
    "status": ("statusId", ("results", "sprint_results")),
    "circuits": ("circuitId", ("races",)),
}
#: Rows of these inputs change the cross-season report in every season.
IN_EVERY_SEASON = ("drivers", "constructors", "constructor_color")
DIMENSIONS = {"dim_circuit": ("circuits",), "dim_constructor": ("constructors", "constructor_color"), "dim_driver": ("drivers",),
              "dim_race": ("races",), "dim_season": ("seasons",)}
#: Seasons listed on the driver. More distinct years than this are not a calendar.
MAX_SEASONS = 10_000


def within(year: Column, seasons: set[int | None]) -> Column:
    """``year`` is one of ``seasons``, of which NULL may be one."""
    listed = year.isin([y for y in seasons if y is not None])
    return F.coalesce(listed, F.lit(False)) | year.isNull() if None in seasons else F.coalesce(listed, F.lit(False))


def touched_seasons(staging: Mapping[str, DataFrame], added: Mapping[str, DataFrame]) -> set[int | None]:
    """Seasons (NULL: races without one) whose rows differ once ``added`` is part of ``staging``."""
    races = [added[n].select("raceId") for n in (*FACT_INPUTS, "races") if n in added]
    for name, (key, users) in REFERENCES.items():
        if name in added:
            keys = added[name].select(key).distinct()
            races += [staging[u].join(keys, key, "left_semi").select("raceId") for u in users]
    years: list[DataFrame] = []
    if races:
        known = staging["races"].groupBy("raceId").agg(F.min("year").alias("year"))
        years.append(reduce(DataFrame.unionByName, [r.distinct() for r in races]).distinct().join(known, "raceId", "left").select("year"))
    if "seasons" in added:
        years.append(added["seasons"].select("year"))
    found = {r["year"] for y in years for r in y.distinct().limit(MAX_SEASONS + 1).collect()}
    if len(found) > MAX_SEASONS:
        raise ValueError(f"the added rows name more than {MAX_SEASONS} seasons")
    return found | {None} if "races" in added else found  # rows that waited for their race leave the NULL season


def season_rows(staging: Mapping[str, DataFrame], seasons: set[int | None]) -> dict[str, DataFrame]:
    """Staging with only the races of ``seasons``, and the fact rows that belong to them."""
    of = seasons_of(staging["races"]).withColumnRenamed("race_k", "raceId")
    out = dict(staging)
    out["races"] = staging["races"].where(within(F.col("year"), seasons))
    for name in FACT_INPUTS:
        rows = staging[name].join(of, "raceId", "left").where(within(F.col("season"), seasons))
        out[name] = rows.select(*staging[name].columns)
    return out


def append(spark: SparkSession, out_dir: str, added: Mapping[str, DataFrame], timer: Callable[[str, float], None] | None = None,
           parallel: int = 4) -> Warehouse:
    """Add ``{staging input: rows}`` to the warehouse in ``out_dir`` and return its new version.

    The warehouse must have been built by ``Warehouse.write``, which keeps the staging rows.
    Equal to a full rebuild from all rows; a failure half-way leaves the version before.
    """
    versions = VersionedStore(spark, out_dir)
    before = versions.current()
    missing = [n for n in STAGING if f"staging/{n}" not in before]
    if missing:
        raise ValueError(f"{out_dir} holds no staging rows of {', '.join(missing)}; build it with Warehouse.write")
    build = versions.begin()
    staging = {n: build.extend(f"staging/{n}", conform_columns(added[n], STAGING[n])) if n in added else build.carry(f"staging/{n}")
               for n in STAGING}
    new = {n: build.written(f"staging/{n}") for n in added}
    seasons = touched_seasons(staging, new)
    keep, keep_seasons = (keeper(build, lambda: staging["races"], timer, r) for r in (None, seasons))

    def work_table(name: str, df: DataFrame) -> DataFrame:
        return keep(f"work/{name}", df)

    # conformed tables: a dimension whose inputs changed, and the touched seasons of the facts
    changed = {n for n, inputs in DIMENSIONS.items() if set(inputs) & set(added)}
    whole = conform.builders(staging)
    conformed = {n: build.carry(n) for n in DIMENSIONS if n not in changed} | _wave(keep, {n: whole[n] for n in changed}, parallel)
    segmented = [n for n in whole if n not in DIMENSIONS]
    if seasons:
        closed = conform.builders(season_rows(staging, seasons), persist=work_table)
        _wave(keep_seasons, {n: closed[n] for n in segmented}, parallel)
    else:
        for n in segmented:
            build.carry(n)
    full = conformed | {n: versions.frame(n, build.tables[n]) for n in segmented}
    part = conformed | {n: build.written(n) for n in segmented}

    # reports
    thunks = reports.builders(part, persist=work_table)
    by_season = {n: t for n, t in thunks.items() if seasons and n != "report_seasons_metrics"}
    if not set(IN_EVERY_SEASON) & set(added) and seasons:
        years = part["dim_race"].where(within(F.col("year"), seasons))
        raceless = part["dim_season"].join(part["dim_race"].select("year"), "year", "left_anti")
        part_years = part | {"dim_race": years, "dim_season": part["dim_season"].where(within(F.col("year"), seasons)).unionByName(
            raceless.where(~within(F.col("year"), seasons)).select(*part["dim_season"].columns))}
        by_null = keeper(build, lambda: staging["races"], timer, seasons | {None})
        _wave(by_null, {"report_seasons_metrics": lambda: reports.report_seasons_metrics(part_years)}, 1)
    elif set(IN_EVERY_SEASON) & set(added):
        _wave(keep, {"report_seasons_metrics": lambda: reports.report_seasons_metrics(full)}, 1)
    _wave(keep_seasons, by_season, parallel)
    for n in thunks:
        if n not in build.tables:
            build.carry(n)
    seasons_report = versions.frame("report_seasons_metrics", build.tables["report_seasons_metrics"])
    keep("season_totals", reports.season_totals(seasons_report))  # totals run through all later seasons
    build.commit()
    return _opened(versions)


def rewritten(before: Mapping[str, Table], after: Mapping[str, Table]) -> dict[str, list[str]]:
    """Folders of each table that the later version does not share with the earlier one."""
    return {n: sorted(set(t.folders) - set(before[n].folders if n in before else ())) for n, t in after.items()}
