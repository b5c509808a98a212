"""A warehouse on demand builds what is asked for, once, with the rows of a full build."""

import datetime
import os

from raceboard.plans import warehouse
from raceboard.plans.registry import registry
from raceboard.plans.warehouse import Warehouse


def star_tables(spark, folder):
    """Three suppliers, two nations, orders of four months in two years."""
    orders = [(o, datetime.date(1998 + o % 2, 3 + 4 * (o // 2 % 2), 1)) for o in range(40)]
    lines = [(o, 1, o * 7 % 3 + 1, n, 41.0 + o % 9, 1000.0 + 3 * o, 0.01 * n, "RA"[o % 5 == 0]) for o in range(40) for n in range(1, 4)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_tax double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, k % 2) for k in (1, 2, 3)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_query_builds_the_tables_it_reads(spark, tmp_path, monkeypatch):
    sf = star_tables(spark, tmp_path / "in")
    out = tmp_path / "out"
    monkeypatch.setattr(warehouse, "scratch_path", lambda _spark, _name: str(out))
    found = registry()["dim_driver_constructor"](spark, sf)
    assert found.count() > 0
    built = {p for p in os.listdir(out)} | {f"work/{p}" for p in os.listdir(out / "work")} | {f"staging/{p}" for p in os.listdir(out / "staging")}
    assert built == {"dim_driver_constructor", "work", "staging", "work/race_driver_totals", "staging/results", "staging/races"}
    registry()["running_total"](spark, sf).count()
    assert not {"report_season_metrics", "report_race_metrics", "fact_lap"} & set(os.listdir(out))
    assert len(os.listdir(out / "staging" / "results")) == 1  # built once


def test_every_table_equals_a_full_build(spark, tmp_path):
    sf = star_tables(spark, tmp_path / "in")
    full = Warehouse.materialize(spark, sf, str(tmp_path / "full"))
    lazy = Warehouse.on_demand(spark, sf, str(tmp_path / "lazy"))
    assert set(lazy.conformed) == set(full.conformed) and set(lazy.reports) == set(full.reports) and set(lazy.staging) == set(full.staging)
    for name in [*full.reports, *full.conformed]:
        assert lazy.table(name).schema == full.table(name).schema, name
        assert rows(lazy.table(name)) == rows(full.table(name)), name
    for name in full.staging:
        assert rows(lazy.staging[name]) == rows(full.staging[name]), name
    assert full.table("fact_lap").count() and full.table("report_season_metrics").count()
