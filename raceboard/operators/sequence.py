"""Lap-sequence operators: synthetic grid and retirement rows, final-row flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceboard.functions.columns import is_lapped_status
from raceboard.operators.ranking import AUTO, id_cell, ordinal, tuning

# Laps per cell when a hot (race, driver) is numbered in pieces.
LAP_CELL = 1 << 16

LAP_COLUMNS = ("race_k", "driver_k", "lap", "position", "time", "milliseconds")


def lap_zero(results: DataFrame) -> DataFrame:
    """A lap-0 row at the grid position for every starter (grid 0 = pit lane: none)."""
    return results.where(F.col("grid") != 0).select(
        F.col("raceId").alias("race_k"), F.col("driverId").alias("driver_k"),
        F.lit(0).cast("int").alias("lap"), F.col("grid").cast("int").alias("position"),
        F.lit(None).cast("string").alias("time"), F.lit(None).cast("bigint").alias("milliseconds"))


def dnf_laps(laps: DataFrame, results: DataFrame, status: DataFrame) -> DataFrame:
    """A retirement row one lap after a driver's last lap, at the classified position.

    Emitted when the driver stopped before the race's last lap and the result status
    is not a lapped finish ('+N Lap(s)', any case).  A NULL status emits nothing.
    One row per matching result row (a shared drive gives two).

    Both maxima are aggregations: last lap per (race, driver), then race length from
    that much smaller table.
    """
    last = laps.groupBy("race_k", "driver_k").agg(F.max("lap").alias("last_lap"))
    race_len = last.groupBy("race_k").agg(F.max("last_lap").alias("max_lap"))
    rr = results.select(F.col("raceId").alias("race_k"), F.col("driverId").alias("driver_k"),
                        "positionOrder", "statusId")
    st = status.select("statusId", "status")
    out = (last.join(race_len, "race_k", "inner")
           .where(F.col("last_lap") < F.col("max_lap"))
           .join(rr, ["race_k", "driver_k"], "inner")
           .join(st, "statusId", "inner")
           .where(~is_lapped_status("status")))
    return out.select(
        "race_k", "driver_k", (F.col("last_lap") + 1).cast("int").alias("lap"),
        F.col("positionOrder").cast("int").alias("position"),
        F.lit(None).cast("string").alias("time"), F.lit(None).cast("bigint").alias("milliseconds"))


def final_lap_flag(laps: DataFrame, name: str = "is_final") -> DataFrame:
    """Flag the highest lap of each (race, driver); equal laps broken by position, then time.

    A row number per (race, driver); a hot (race, driver) is numbered through lap cells.
    """
    order = [F.col("lap").desc(), F.col("position").asc_nulls_last(), F.col("milliseconds").asc_nulls_last()]
    ranked = ordinal(laps, ["race_k", "driver_k"], order, "__final_rank",
                     cells=[(id_cell("lap", tuning(laps, "lapCell", LAP_CELL)), False)], hot_rows=AUTO)
    return ranked.withColumn(name, F.col("__final_rank") == 1).drop("__final_rank")
