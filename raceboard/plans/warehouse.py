"""One warehouse per input: staging -> conformed -> reports.

``Warehouse.from_tables`` derives staging lazily from the star-schema test tables;
``Warehouse.from_csv`` reads a folder of staging CSV files.  ``materialize`` runs
the whole build once, writing every table as Parquet under a folder in the shared
checkpoint dir and returning a warehouse whose tables read those files (the
source's "rebuild every table, then serve queries from them").  Written tables
also cut the lineage, so a lost executor costs one stage, not the whole build.
``on_demand`` builds the same tables in the same way, each when it is first asked for, so
that one query costs the tables it reads and not the whole warehouse.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Collection, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.plans import conform, reports
from raceboard.session import application_id, scratch_path
from raceboard.sources import adapter, csv_files, store
from raceboard.sources.schemas import STAGING, conform_columns
from raceboard.sources.versions import Build, VersionedStore


class Tables(Mapping[str, DataFrame]):
    """Named tables, each built once, when it is first asked for. Threads may ask for any."""

    def __init__(self, names: Collection[str], build: Callable[[str], DataFrame]) -> None:
        self._build, self._done = build, {}
        self._locks = {n: threading.Lock() for n in names}

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._done:
                self._done[name] = self._build(name)
            return self._done[name]

    def __contains__(self, name: object) -> bool:
        return name in self._locks

    def __iter__(self) -> Iterator[str]:
        return iter(self._locks)

    def __len__(self) -> int:
        return len(self._locks)


class Warehouse:
    def __init__(self, spark: SparkSession, staging: Mapping[str, DataFrame],
                 conformed: Mapping[str, DataFrame] | None = None, built_reports: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self.staging = staging
        if conformed is not None:
            self.__dict__["conformed"] = conformed
        if built_reports is not None:
            self.__dict__["reports"] = built_reports

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        """Fully lazy warehouse over the test tables: one plan from line items to reports.

        Fine for inspecting plans of single steps; real runs use ``materialize``, whose
        written stage boundaries keep each plan small (the hot-group splits read their
        input three times, which a lazy chain would multiply).
        """
        return cls(spark, adapter.staging_from_tables(spark, sf_dir))

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str, multi_line: bool | None = None) -> "Warehouse":
        """A lazy warehouse over ``<name>.csv`` files; files without newlines in cells are split."""
        return cls(spark, csv_files.read_staging(spark, folder, multi_line=multi_line))

    @cached_property
    def conformed(self) -> Mapping[str, DataFrame]:
        return conform.conform_all(self.staging)

    @cached_property
    def reports(self) -> Mapping[str, DataFrame]:
        built = reports.build_reports(self.conformed)
        return built | {"season_totals": reports.season_totals(built["report_seasons_metrics"])}

    def table(self, name: str) -> DataFrame:
        if name in self.conformed:
            return self.conformed[name]
        return self.reports[name]

    def write(self, out_dir: str, timer: Callable[[str, float], None] | None = None,
              parallel: int = 4, database: str | None = None) -> "Warehouse":
        """Write this warehouse's staging, conformed tables and reports (e.g. one read from CSV).

        The typed staging tables are written first, so every staging file is parsed once
        however many tables are built from it; ``append`` adds to them later. With
        ``database`` the tables are registered there with their statistics (``register``).
        """
        def staging(keep: Keep) -> dict[str, DataFrame]:
            written = _wave(keep, {f"staging/{n}": (lambda df=df: df) for n, df in self.staging.items()}, parallel)
            return {n: written[f"staging/{n}"] for n in self.staging}

        built = _build(self.spark, staging, out_dir, timer, parallel)
        if database:
            register(self.spark, out_dir, database)
        return built

    @classmethod
    def open(cls, spark: SparkSession, out_dir: str) -> "Warehouse":
        """A warehouse over the newest complete build in ``out_dir``."""
        return _opened(VersionedStore(spark, out_dir))

    @classmethod
    def materialize(cls, spark: SparkSession, sf_dir: str, out_dir: str,
                    timer: Callable[[str, float], None] | None = None, parallel: int = 4,
                    database: str | None = None) -> "Warehouse":
        """Build every table from the star-schema tables in ``sf_dir`` into ``out_dir``.

        First the adapter's two shared intermediates, one after the other, then two waves: the
        ten conformed tables and the reports.  Tables of one wave do not depend on each other, so each is
        planned and written by its own worker as a concurrent Spark job (``parallel`` at
        a time), which keeps the cluster busy while a small table's job finishes.  Ranked
        staging inputs and the lap work tables are written where several readers or a
        hot-group split would otherwise recompute them.
        ``timer(table, seconds)`` is told how long each table took to write.
        """
        def staging(keep: Keep) -> dict[str, DataFrame]:
            work = adapter.adapter_work(spark, sf_dir, persist=lambda n, df: keep(f"work/{n}", df))
            return adapter.staging_from_work(spark, sf_dir, work, persist=lambda n, df: keep(f"staging/{n}", df))

        built = _build(spark, staging, out_dir, timer, parallel)
        if database:
            register(spark, out_dir, database)
        return built


    @classmethod
    def on_demand(cls, spark: SparkSession, sf_dir: str, out_dir: str) -> "Warehouse":
        """The warehouse of ``materialize``, of which each table (staging, work, conformed or
        report) is built and written when it or a table made from it is first asked for.

        Tables of no use to the queries of a session are not built in it, and no version is
        committed to ``out_dir``.
        """
        build = VersionedStore(spark, out_dir).begin()
        keep = keeper(build, lambda: staging["races"])

        def work_table(name: str, df: DataFrame) -> DataFrame:
            return keep(f"work/{name}", df)

        def staged(name: str) -> DataFrame:
            df = make_staging[name]()
            return keep(f"staging/{name}", df) if name in adapter.KEPT else df

        work = Tables(adapter.WORK, lambda n: work_table(n, make_work[n]()))
        make_work = adapter.work_builders(spark, sf_dir, work)
        raw = Tables(STAGING, staged)
        make_staging = adapter.staging_builders(spark, sf_dir, work, raw)
        staging = Tables(STAGING, lambda n: conform_columns(raw[n], STAGING[n]))
        make_conformed = conform.builders(staging, persist=work_table)
        conformed = Tables(make_conformed, lambda n: keep(n, make_conformed[n]()))
        make_reports = reports.builders(conformed, persist=work_table) | {"season_totals": lambda: reports.season_totals(built["report_seasons_metrics"])}
        built = Tables(make_reports, lambda n: keep(n, make_reports[n]()))
        return cls(spark, staging, conformed, built)


Keep = Callable[..., DataFrame]


def _wave(keep: Keep, thunks: dict[str, Callable[[], DataFrame]], parallel: int) -> dict[str, DataFrame]:
    """Plan and write independent tables concurrently; each worker plans its own table
    (writing any work table it persists) and then writes it."""
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        futures = {n: pool.submit(lambda n=n, b=b: keep(n, b())) for n, b in thunks.items()}
        return {n: f.result() for n, f in futures.items()}


def keeper(build: Build, races: Callable[[], DataFrame], timer: Callable[[str, float], None] | None = None,
           replacing: Collection | None = None) -> Keep:
    """Writes a table into ``build`` in its layout: facts in the folders of their seasons.

    With ``replacing`` only those seasons of the segmented tables are written anew.
    """
    def keep(name: str, df: DataFrame) -> DataFrame:
        layout = store.LAYOUTS.get(name, store.Layout())
        started = time.perf_counter()
        hidden = ()
        if layout.segment and layout.segment not in df.columns:
            df, hidden = df.join(seasons_of(races()), "race_k", "left"), (layout.segment,)
        out = build.write(name, df, layout, hidden, replacing if layout.segment else None)
        if timer:
            timer(name, time.perf_counter() - started)
        return out

    return keep


def seasons_of(races: DataFrame) -> DataFrame:
    """``race_k, season`` of staging races."""
    return races.groupBy(F.col("raceId").alias("race_k")).agg(F.min("year").alias("season"))


def _build(spark: SparkSession, make_staging: Callable[[Keep], dict[str, DataFrame]],
           out_dir: str, timer: Callable[[str, float], None] | None, parallel: int) -> Warehouse:
    versions = VersionedStore(spark, out_dir)
    build = versions.begin()
    staging: dict[str, DataFrame] = {}
    keep = keeper(build, lambda: staging["races"], timer)

    def work_table(name: str, df: DataFrame) -> DataFrame:
        return keep(f"work/{name}", df)

    staging |= make_staging(keep)
    conformed = _wave(keep, conform.builders(staging, persist=work_table), parallel)
    built = _wave(keep, reports.builders(conformed, persist=work_table), parallel)
    built["season_totals"] = keep("season_totals", reports.season_totals(built["report_seasons_metrics"]))
    build.commit()
    return Warehouse(spark, staging, conformed, built)


def register(spark: SparkSession, out_dir: str, database: str, parallel: int = 4) -> list[str]:
    """Register the newest build's tables in ``database`` with statistics and return their names.

    A table that an append has put together from folders of several builds has no one
    location; it is not registered until the next full build.
    """
    versions = VersionedStore(spark, out_dir)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    single = {n: t.folders[0] for n, t in versions.current().items() if "/" not in n and len(t.folders) == 1}
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        list(pool.map(lambda n: store.register_analyzed(spark, f"{database}.{n}", f"{versions.root}/{single[n]}"), sorted(single)))
    return sorted(single)


def _opened(versions: VersionedStore) -> Warehouse:
    tables = versions.current()
    if not tables:
        raise FileNotFoundError(f"no complete build in {versions.root}")
    read = lambda names, prefix="": {n: versions.frame(prefix + n, tables[prefix + n]) for n in names if prefix + n in tables}
    return Warehouse(versions.spark, read(STAGING, "staging/"), read(conform.builders({})), read([*reports.builders({}), "season_totals"]))


_BUILT: dict[tuple, Warehouse] = {}
_LOCK = threading.Lock()


def _input_signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the input files, by whatever file system they are on."""
    sig = []
    for name in adapter.TABLES:
        files = spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{name}.parquet").select("path", "length", "modificationTime")
        sig.append((name, *sorted(map(tuple, files.collect()))))  # the files' metadata; their content is not read
    return tuple(sig)


def built_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse for ``sf_dir``: each table is built at most once per Spark application, on demand."""
    key = (application_id(spark), sf_dir.rstrip("/"), _input_signature(spark, sf_dir))
    with _LOCK:
        wh = _BUILT.get(key)
        if wh is None:
            wh = Warehouse.on_demand(spark, sf_dir, scratch_path(spark, "warehouse"))
            _BUILT[key] = wh
        return wh
