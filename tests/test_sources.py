import os
import tempfile

import pytest

from raceboard.sources import csv_files, store
from raceboard.sources.schemas import STAGING


def test_csv_binds_by_name_and_clears_null_tokens(spark):
    folder = tempfile.mkdtemp(prefix="rb-csv-")
    with open(os.path.join(folder, "status.csv"), "w") as fh:
        fh.write("extra,status,statusId\n9,Engine,0\n9,\\N,1\n9,NA,2\n9,Finished,3.0\n9,nan,x\n")
    df = csv_files.read_staging(spark, folder, ["status"])["status"]
    got = sorted(((r.statusId, r.status) for r in df.collect()), key=lambda t: (t[0] is None, t[0] or 0))
    assert got == [(0, "Engine"), (1, None), (2, None), (3, "Finished"), (None, None)]
    assert df.schema == STAGING["status"]


def test_missing_file_column_reads_null(spark):
    folder = tempfile.mkdtemp(prefix="rb-csv-")
    with open(os.path.join(folder, "seasons.csv"), "w") as fh:
        fh.write("year\n2001\n")
    df = csv_files.read_staging(spark, folder, ["seasons"])["seasons"]
    assert [tuple(r) for r in df.collect()] == [(2001, None)]


def test_staging_csv_round_trip(spark, make_staging):
    st = make_staging(status=[{"statusId": 1, "status": "+1 Lap"}, {"statusId": 2, "status": None}])
    folder = tempfile.mkdtemp(prefix="rb-csv-")
    csv_files.write_staging({"status": st["status"]}, folder)
    back = csv_files.read_staging(spark, folder, ["status"])["status"]
    assert sorted(back.collect(), key=lambda r: r.statusId) == sorted(st["status"].collect(), key=lambda r: r.statusId)


def test_table_layout_round_trip_and_pruning(spark):
    df = spark.createDataFrame([(y, m, p, float(p)) for y in (2000, 2001) for m in ("A", "B") for p in range(1, 4)],
                               "year int, metric string, position int, metric_value double")
    path = tempfile.mkdtemp(prefix="rb-store-") + "/t"
    store.write_table(df, path, store.Layout(("year", "metric"), ("position",)))
    back = store.read_table(spark, path)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    plan = back.where("year = 2001 AND metric = 'A' AND position <= 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters" in plan


def test_staging_views_catalog(spark, make_staging):
    st = make_staging()
    store.register_views({"status": st["status"], "races": st["races"]}, prefix="stg_")
    store.register_views({"keep": st["status"]}, prefix="stgx")
    assert {"stg_status", "stg_races"} <= set(store.staging_views(spark))
    dropped = store.drop_staging_views(spark)
    assert "stg_status" in dropped and "stgxkeep" not in dropped
    assert store.staging_views(spark) == []


def test_catalog_table_with_statistics(spark):
    df = spark.createDataFrame([(2000, "A", 1), (2001, "B", 2)], "year int, metric string, position int")
    store.save_catalog_table(spark, df, "rb_stats_t", store.Layout(("metric",), ("year",)))
    stats = spark.sql("DESCRIBE TABLE EXTENDED rb_stats_t").where("col_name = 'Statistics'").collect()
    assert stats and "rows" in stats[0].data_type
    assert spark.table("rb_stats_t").where("metric = 'B'").count() == 1
    store.drop_table(spark, "rb_stats_t")
    assert not spark.catalog.tableExists("rb_stats_t")


def test_warehouse_from_staging_csv_matches_table_build(spark, materialize):
    """All twelve staging inputs through CSV files give the same conformed tables and reports."""
    from raceboard.plans.warehouse import Warehouse, built_warehouse
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/lineitem.parquet"):
        pytest.skip("no test tables")
    built = built_warehouse(spark, sf)
    folder = tempfile.mkdtemp(prefix="rb-staging-")
    csv_files.write_staging(built.staging, folder)
    from_csv = Warehouse.from_csv(spark, folder)
    for name in STAGING:
        assert from_csv.staging[name].schema == STAGING[name]
    conformed = materialize(from_csv.conformed)
    from raceboard.plans import reports
    for name in ("fact_lap", "fact_race_result", "dim_race", "dim_driver"):
        a, b = conformed[name], built.table(name)
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count(), name
    rep = reports.report_seasons_metrics(conformed)
    ref = built.table("report_seasons_metrics").select(*rep.columns)
    assert rep.exceptAll(ref).count() == 0 and rep.count() == ref.count()


def test_write_stages_csv_once_and_open_reads_the_build(spark, tmp_path):
    """``write`` from CSV lands typed staging tables, builds on those alone, and ``open`` finds every table."""
    from raceboard.plans.warehouse import Warehouse, built_warehouse
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/lineitem.parquet"):
        pytest.skip("no test tables")
    built = built_warehouse(spark, sf)
    folder, out = str(tmp_path / "csv"), str(tmp_path / "built")
    csv_files.write_staging(built.staging, folder)
    written = []
    wh = Warehouse.from_csv(spark, folder).write(out, timer=lambda name, seconds: written.append(name))
    assert sorted(n for n in written if n.startswith("staging/")) == sorted(f"staging/{n}" for n in STAGING)
    for name in STAGING:
        assert wh.staging[name].schema == STAGING[name]
        assert wh.staging[name].inputFiles() and all(".csv" not in f for f in wh.staging[name].inputFiles()), name
    opened = Warehouse.open(spark, out)
    for name in ("fact_lap", "fact_race_result", "report_seasons_metrics", "report_season_metrics", "report_race_metrics"):
        a, b = opened.table(name), built.table(name)
        b = b.select(*a.columns)
        assert a.exceptAll(b).count() == 0 and a.count() == b.count(), name


def test_catalog_table_has_few_files_per_partition(spark):
    df = spark.range(4000).selectExpr("cast(id % 4 as string) AS metric", "cast(id % 50 as int) AS year").repartition(32)
    store.save_catalog_table(spark, df, "rb_files_t", store.Layout(("metric",), ("year",)), analyze=False)
    n = len(spark.table("rb_files_t").inputFiles())
    assert spark.table("rb_files_t").count() == 4000
    store.drop_table(spark, "rb_files_t")
    assert n <= 4 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_staging_loads_in_parts(spark, tmp_path):
    rows = [(i, f"s{i}" if i % 3 else None) for i in range(20)]
    parts = [spark.createDataFrame(p, STAGING["status"]) for p in (rows[:8], rows[8:])]
    csv_files.write_staging({"status": parts[1]}, str(tmp_path))
    csv_files.write_staging({"status": parts[0]}, str(tmp_path))  # replaces
    csv_files.write_staging({"status": parts[1]}, str(tmp_path), append=True)
    back = csv_files.read_staging(spark, str(tmp_path), ["status"])["status"]
    assert sorted(map(tuple, back.collect())) == rows
