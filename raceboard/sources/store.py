"""Sinks and storage layout for the warehouse tables.

The source workload rebuilds each table with DROP + CREATE TABLE AS, adds a few
secondary indexes, then runs ANALYZE and VACUUM.  On a lake those become:

* replace:     a new folder that a manifest makes current (``versions``), or ``mode('overwrite')``
               of a plain folder or catalog table;
* index:       ``partitionBy`` on the equality-filtered prefix plus sorted files and Bloom
               filters, so readers prune folders and Parquet row groups;
* statistics:  ``ANALYZE TABLE ... COMPUTE STATISTICS`` for catalog tables;
* compaction:  a bounded number of files per partition at write time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """``partition_by``: equality filters. ``sort_by``: range filters. ``lookup``: columns asked
    for single values whatever the sort order (Parquet Bloom filters, so readers skip row
    groups). ``segment``: the partition column whose values are replaced one by one.
    ``together``: columns whose equal rows go to one file (the partition columns, unless given)."""

    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    lookup: tuple[str, ...] = ()
    segment: str | None = None
    together: tuple[str, ...] = ()


# Layout per table: partition on the columns every query filters by equality, sort files on
# the range-filtered columns that follow in the source's index. Facts have no year column;
# theirs is kept in the folder names.
FACT = Layout(("season",), ("race_k", "driver_k"), ("race_k", "driver_k"), "season", ("season", "race_k"))
LAYOUTS: dict[str, Layout] = {
    "fact_lap": FACT,
    "fact_pit_stop": FACT,
    "fact_qualifying": FACT,
    "fact_race_result": FACT,
    "dim_driver_constructor": Layout(("year",), ("driver_k",), (), "year"),
    "race_entries": Layout(("year",), ("race_k", "driver_k"), (), "year"),
    "season_totals": Layout(("metric", "year"), ("type", "id"), (), "year"),
    "report_seasons_metrics": Layout(("metric", "year"), ("type", "position"), ("id",), "year"),
    "report_season_metrics": Layout(("year", "metric"), ("is_cumulative", "position"), ("id",), "year"),
    "report_race_metrics": Layout(("year",), ("race_name", "driver_name", "lap"), ("race_name", "driver_name"), "year", ("year", "race_name")),
}


def laid_out(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows brought together by a rebalance: small groups share a task and a large one is split
    over several, by the sizes that the shuffle has measured, so nothing is computed twice for
    a sample and no task holds a whole season. Each task's rows are sorted."""
    keys = [*layout.partition_by, *layout.sort_by]
    if not keys:
        return df
    together = layout.together or layout.partition_by or layout.sort_by
    return df.hint("rebalance", *together).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])


def _writer(df: DataFrame, layout: Layout) -> DataFrameWriter:
    """A table partition gets a few large sorted files, with min/max statistics and Bloom filters."""
    writer = laid_out(df, layout).write
    for column in layout.lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer.partitionBy(*layout.partition_by) if layout.partition_by else writer


def write_layout(df: DataFrame, path: str, layout: Layout) -> None:
    """Write ``df`` to the new folder ``path`` in the given layout."""
    _writer(df, layout).parquet(path)


def write_table(df: DataFrame, path: str, layout: Layout | None = None) -> None:
    """Replace the table at ``path`` with ``df`` in the given layout (a plain folder: the old
    rows go first; ``versions.VersionedStore`` keeps them until the new ones are complete)."""
    _writer(df, layout or Layout()).mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_catalog_table(spark: SparkSession, df: DataFrame, name: str, layout: Layout | None = None,
                       analyze: bool = True) -> None:
    """Create-or-replace a managed catalog table, laid out as by ``write_table``, and collect its statistics."""
    _writer(df, layout or Layout()).mode("overwrite").format("parquet").saveAsTable(name)
    if analyze:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def register_analyzed(spark: SparkSession, name: str, path: str) -> None:
    """Make the table folder ``path`` the catalog table ``name`` (replacing an earlier entry, not
    its files) and collect row counts, column statistics and histograms, from which the
    optimizer estimates filters and orders joins (``spark.sql.cbo.enabled``)."""
    drop_table(spark, name)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    before = spark.conf.get("spark.sql.statistics.histogram.enabled")
    spark.conf.set("spark.sql.statistics.histogram.enabled", "true")
    try:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    finally:
        spark.conf.set("spark.sql.statistics.histogram.enabled", before)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Expose DataFrames as temp views (the session's catalog) and return their names."""
    names = []
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def staging_views(spark: SparkSession, prefix: str = "stg_") -> list[str]:
    """Temp views whose name starts with ``prefix`` (``LIKE 'stg_%'`` without the wildcard)."""
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(prefix))


def drop_staging_views(spark: SparkSession, prefix: str = "stg_") -> list[str]:
    dropped = staging_views(spark, prefix)
    for name in dropped:
        spark.catalog.dropTempView(name)
    return dropped
