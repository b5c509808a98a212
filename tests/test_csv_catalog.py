"""Large staging files in splits, and build tables registered with statistics."""

import os

import pytest
from pyspark.sql import functions as F

from raceboard.plans.warehouse import Warehouse, register
from raceboard.sources import csv_files
from raceboard.sources.schemas import STAGING
from raceboard.sources.versions import VersionedStore

SF = "/root/testdata/sf0.001"


def big_file(path, n, note):
    with open(path, "w") as f:
        f.write("statusId,status\n")
        for i in range(n):
            f.write(f'{i},"{note}, and ""quoted"" {i}"\n')


def test_a_large_file_without_newlines_in_cells_is_read_by_many_tasks(spark, tmp_path):
    big_file(tmp_path / "status.csv", 60_000, "a plain status text")
    size = os.path.getsize(tmp_path / "status.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 10))
    try:
        read = Warehouse.from_csv  # the public entry reads through read_staging
        assert read.__func__.__name__ == "from_csv"
        df = csv_files.read_staging(spark, str(tmp_path), ["status"])["status"]
        assert df.rdd.getNumPartitions() >= 8
        assert csv_files.read_staging(spark, str(tmp_path), ["status"], multi_line=True)["status"].rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert df.count() == 60_000 and df.agg(F.sum("statusId")).first()[0] == 60_000 * 59_999 // 2
    assert df.where("statusId = 7").first()["status"] == 'a plain status text, and "quoted" 7'


def test_only_files_with_newlines_in_cells_are_read_whole(spark, tmp_path):
    folder = tmp_path / "status.csv"
    folder.mkdir()
    big_file(folder / "part one.csv", 50, "plain")
    with open(folder / "b.csv", "w") as f:
        f.write('statusId,status\n100,"two\nlines"\n101,"x ""y""\n\nz"\n102,\\N\n')
    whole, split = csv_files.files_with_quoted_newlines(spark, str(folder))
    assert [os.path.basename(f) for f in whole] == ["b.csv"] and [os.path.basename(f) for f in split] == ["part one.csv"]
    got = {r.statusId: r.status for r in csv_files.read_staging_file(spark, str(folder), STAGING["status"]).collect()}
    assert len(got) == 53 and got[100] == "two\nlines" and got[101] == 'x "y"\n\nz' and got[102] is None and got[3] == 'plain, and "quoted" 3'


def test_read_present_finds_some_inputs(spark, tmp_path):
    big_file(tmp_path / "status.csv", 3, "s")
    assert list(csv_files.read_present(spark, str(tmp_path))) == ["status"]


@pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test tables")
def test_registered_tables_estimate_from_their_statistics(spark, tmp_path):
    vs = VersionedStore(spark, str(tmp_path / "wh"))
    b = vs.begin()
    from raceboard.sources import store
    df = spark.range(4000).selectExpr("cast(id % 4 as string) AS metric", "cast(id % 50 as int) AS year", "string(id % 2) AS type", "id", "int(id) AS position")
    b.write("report_seasons_metrics", df, store.LAYOUTS["report_seasons_metrics"])
    b.write("dim_race", spark.range(84).withColumnRenamed("id", "race_k"))
    b.write("staging/x", spark.range(2))
    b.commit()
    spark.conf.set("spark.sql.cbo.enabled", "true")
    try:
        assert register(spark, str(tmp_path / "wh"), "rb_built") == ["dim_race", "report_seasons_metrics"]
        rows = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().rowCount().get())
        assert rows(spark.table("rb_built.dim_race")) == 84 and rows(spark.table("rb_built.report_seasons_metrics")) == 4000
        third = rows(spark.table("rb_built.report_seasons_metrics").where("position < 1000"))
        assert 900 <= third <= 1100  # from the column's histogram
        assert spark.table("rb_built.report_seasons_metrics").where("metric = '1' AND year = 5").count() == 40
        assert register(spark, str(tmp_path / "wh"), "rb_built")  # again, over what is there
    finally:
        spark.conf.unset("spark.sql.cbo.enabled")
        spark.sql("DROP DATABASE IF EXISTS rb_built CASCADE")
    assert VersionedStore(spark, str(tmp_path / "wh")).read("dim_race").count() == 84  # files stay
