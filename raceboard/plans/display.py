"""Chart-ready tables: frames, links, axis ranges, per-driver series and labels.

Rendering is the caller's; these are tidy DataFrames (one row per bar, point or
label) keyed by frame or series, computed with grouping instead of per-value loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceboard.functions.columns import DEFAULT_CONSTRUCTOR_COLOR, focus_opacity, text_contrast
from raceboard.operators.ranking import best_of_group, ordinal

# --- fixed values: axis padding of the bump chart ---------------------------------
LAP_AXIS_PAD = 1.071      # x range ends at max lap * 1.071 (room for end labels)
POSITION_AXIS_PAD = 0.2   # y range starts at max position + 0.2
# ----------------------------------------------------------------------------------


def _frame_index(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """1-based index of each distinct frame label in ``order`` (a frame = a season or race)."""
    frames = df.groupBy(label).agg(*[F.min(c).alias(f"__o{i}") for i, c in enumerate(order)])
    keys = [F.col(f"__o{i}").asc_nulls_first() for i in range(len(order))] + [F.col(label).asc_nulls_first()]
    indexed = ordinal(frames, [], keys, "frame_index", cells=[(F.col("__o0"), True)])
    return df.join(indexed.select(label, "frame_index"), label, "inner")


def frames_seasons(leaderboard: DataFrame) -> DataFrame:
    """Bars per season frame; ``frame_index`` orders the animation."""
    out = _frame_index(leaderboard, "year", ["year"])
    return out.select("frame_index", F.col("year").alias("frame_label"), "type", "position", "id", "name",
                      "metric_value", "constructor_name", "constructor_color", "wiki_url")


def frames_season(leaderboard: DataFrame) -> DataFrame:
    """Bars per race frame of one season, races in date order."""
    out = _frame_index(leaderboard, "race", ["race_date"])
    return out.select("frame_index", F.col("race").alias("frame_label"), "type", "position", "id", "name",
                      "metric_value", "constructor_name", "constructor_color", "wiki_url")


def chart_title(metric: str, cumulative: bool, season: int | None = None) -> str:
    """Leaderboard chart title: across seasons, or across the races of ``season``."""
    prefix = "Cumulative " if cumulative else ""
    if season is None:
        return f"{prefix}{metric} by Season and Driver/Constructor"
    return f"{prefix}{metric} by Race and Driver/Constructor in {season}"


def bump_title(season: int, race: str) -> str:
    return f"{season} {race} Bump Chart"


def frame_links(leaderboard: DataFrame, frame: str, links: list[str], title: str | None = None) -> DataFrame:
    """Per frame, the link columns of its first row (type ascending, position descending),
    plus the chart title when given."""
    out = best_of_group(leaderboard, [frame], [F.col("type"), -F.col("position")], {c: c for c in links})
    return out if title is None else out.withColumn("title", F.lit(title))


def axis_ranges(leaderboard: DataFrame) -> DataFrame:
    """Bar axis maximum per entity type over all frames."""
    return leaderboard.groupBy("type").agg(F.max("metric_value").alias("axis_max"))


def bump_axis(race: DataFrame, title: str | None = None) -> DataFrame:
    """Axis ranges of the bump chart (and its title when given)."""
    out = race.agg((F.max("lap") * F.lit(LAP_AXIS_PAD)).alias("x_max"),
                   (F.max("position").cast("double") + F.lit(POSITION_AXIS_PAD)).alias("y_max"))
    return out if title is None else out.withColumn("title", F.lit(title))


def driver_series(race: DataFrame, focus: str) -> DataFrame:
    """Points of every driver's line (lap, position, end status) with the line's colour
    (its first row's constructor colour) and opacity (focus)."""
    first = best_of_group(race, ["driver_name"], [F.col("constructor_name"), F.col("lap")],
                          {"series_color": "constructor_color"})
    out = race.join(first, "driver_name", "left")
    return out.select("driver_name", "constructor_name", "lap", "position", "ending_status", "series_color",
                      focus_opacity(F.col("driver_name"), focus).alias("opacity"))


def _labels(rows: DataFrame, x: F.Column) -> DataFrame:
    color = F.coalesce(F.col("constructor_color"), F.lit(DEFAULT_CONSTRUCTOR_COLOR))
    return rows.select("driver_code", "position", color.alias("bg_color"),
                       text_contrast(F.col("constructor_color")).alias("text_color"), x.alias("x"))


def end_labels(race: DataFrame) -> DataFrame:
    """Driver-code labels at the end of each line, ordered by final position."""
    x_max = race.agg(F.max("lap") * F.lit(LAP_AXIS_PAD)).scalar()
    rows = race.where(F.col("ending_status").isNotNull())
    return _labels(rows, x_max).orderBy("position", "driver_code")


def start_labels(race: DataFrame) -> DataFrame:
    """Driver-code labels at the grid (lap 0), ordered by grid position."""
    rows = race.where(F.col("lap") == 0)
    return _labels(rows, F.lit(0.0)).orderBy("position", "driver_code")


def constructor_text_colors(constructors: DataFrame) -> DataFrame:
    return constructors.select("constructor_k", "color", text_contrast(F.col("color")).alias("text_color"))
