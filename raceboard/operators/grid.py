"""Dense metric grids: every entity gets a row for every period, with facts
aggregated *before* the grid is formed.

The literal form (entity × season ⋈ every race ⋈ results, then group) builds
|entities| × |races| rows before aggregating.  Here results are first summed to
(period, entity); the grid is (entity × period) only, which is the output grain.
A count of the races an entity appeared in restores the three-valued sums: a
period where the entity missed a race sums its win/podium flags with a 0 for the
missed race, while a period made only of retirements (NULL flags) stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_sum(flag: Column, is_sprint: Column) -> Column:
    """``SUM(CASE WHEN NOT is_sprint THEN flag ELSE 0 END)`` with flag NULL-propagating."""
    return F.sum(F.when(~is_sprint, flag.cast("int")).otherwise(F.lit(0)))


def result_sums(results: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """points / race_wins / podiums sums and distinct races per ``keys`` of a result table
    (plus any ``extra`` aggregate columns, computed in the same pass)."""
    pos = F.col("position")
    sprint = F.col("is_sprint")
    return results.groupBy(*keys).agg(
        *extra,
        F.sum("points").alias("points"),
        flag_sum(pos == 1, sprint).alias("race_wins"),
        flag_sum(pos.between(1, 3), sprint).alias("podiums"),
        F.countDistinct("race_k").alias("n_present"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def fill_absent(n_present: Column, n_periods: Column, value: Column) -> Column:
    """A flag sum over a grid that also held rows for missed races (each a 0)."""
    missed = (n_periods == 0) | (F.coalesce(n_present, F.lit(0)) < n_periods)
    return F.when(missed, F.coalesce(value, F.lit(0))).otherwise(value)


# More periods than this are no calendar: they are not gathered in one value.
MAX_CALENDAR = 100_000


def within_calendar(periods: DataFrame) -> bool:
    """The period table has at most ``MAX_CALENDAR`` rows (it is counted, up to one more)."""
    return periods.limit(MAX_CALENDAR + 1).count() <= MAX_CALENDAR


def calendar_scalar(periods: DataFrame, fields: Sequence[str]) -> Column:
    """The whole (small) period table as one array value: a scalar subquery, run once.

    Periods are seasons, bounded by the calendar rather than by the data volume.
    """
    return periods.agg(F.collect_list(F.struct(*fields)).alias("__calendar")).scalar()


def calendar_lookup(periods: DataFrame, key: str, value: str) -> Callable[[Column], Column]:
    """``value`` of the period with a given ``key`` (NULL is a key too), without a join.

    One row per season is aggregated to a map and read as a scalar subquery. The period key
    itself, as text, is the map's key: a NULL map key is not allowed.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    entries = periods.select(F.struct(name(F.col(key)).alias("k"), F.col(value).alias("v")).alias("e"))
    found = entries.agg(F.map_from_entries(F.collect_list("e"))).scalar()
    return lambda c: F.try_element_at(found, name(c))


def dense_period_metrics(entities: DataFrame, entity_key: str, periods: DataFrame,
                         sums: DataFrame) -> DataFrame:
    """Every entity × every period, left-joined to per-(year, entity) ``sums``.

    ``periods``: one row per period ``year`` (NULL = the seasons without races) with
    ``n_races``.  Each entity row explodes the period list (a scalar subquery), so the
    grid is a generator over the entity table: no join is needed to form it, and its
    size is |entities| × |seasons|, the report's own grain.  ``entities`` should hold keys
    only; names are cheaper to attach to the result.
    """
    cols = entities.columns
    if within_calendar(periods):
        grid = (entities.select(*cols, F.explode(calendar_scalar(periods, periods.columns)).alias("__p"))
                .select(*cols, "__p.*"))
    else:  # every entity meets the periods in parts, by an equality join
        parts = 64
        grid = (entities.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                .join(periods.withColumn("__part", F.pmod(F.xxhash64("year"), F.lit(parts)).cast("int")), "__part").drop("__part"))
    s = sums.where(F.col("year").isNotNull())
    out = grid.join(s, ["year", entity_key], "left")
    return (out
            .withColumn("race_wins", fill_absent(F.col("n_present"), F.col("n_races"), F.col("race_wins")))
            .withColumn("podiums", fill_absent(F.col("n_present"), F.col("n_races"), F.col("podiums")))
            .drop("n_present", "n_rows"))
