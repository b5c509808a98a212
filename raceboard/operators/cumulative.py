"""Running totals and episode numbering (ordered, per-entity sequences)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceboard.operators.ranking import AUTO, id_cell, running_count, tuning


def running_total(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column],
                  value: str, name: str) -> DataFrame:
    """``SUM(COALESCE(value, 0))`` from the first row to the current one (ROWS frame).

    A NULL value counts as 0 in the total but is left NULL in ``value`` itself.
    Partitions are per entity (a driver's races or seasons), i.e. many and short.
    """
    w = (Window.partitionBy(*partition_by).orderBy(*order_by)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.sum(F.coalesce(F.col(value), F.lit(0))).over(w))


def episode_number(df: DataFrame, partition_by: Sequence[str], order_col: str, flag: Column,
                   name: str, cell_width: int | None = None) -> DataFrame:
    """1 + number of flagged rows up to and including the current order value.

    Default RANGE frame on purpose: rows sharing ``order_col`` (two stops on one lap)
    see each other's flags, so they land in the same episode.  A hot partition is
    counted in ``order_col`` cells (see ``ranking.running_count``).
    """
    width = cell_width or tuning(df, "lapCell", 1 << 16)
    out = running_count(df, partition_by, order_col, flag, "__flags",
                        cells=[(id_cell(order_col, width), True)], hot_rows=AUTO)
    return out.withColumn(name, (F.col("__flags") + F.lit(1)).cast("int")).drop("__flags")
