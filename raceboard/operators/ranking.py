"""Ranking and ordered-scan operators that survive few, huge or skewed groups.

A window ``row_number() over (partition by P order by O)`` sorts each partition
group in one task.  That is fine for many small groups and fatal for a few huge
ones (a race, a season leaderboard, a whole table) or for one hot key.

``ordinal`` / ``running_count`` therefore take *cells*: coarse keys whose order
agrees with ``O`` (e.g. an id bucket, a lap bucket).  Each cell is measured with a
partial aggregation, the measures are prefix-summed per group over the (small)
table of cells, and rows are scanned locally inside their cell.  The only window
over full rows is partitioned by (P, cell), whose size the cell width bounds.
Where no such cells are known (a leaderboard of continuous values) ``range_ordinal`` splits
the rows at sampled values instead.

With ``hot_rows`` the cell path is used only for groups larger than ``hot_rows``:
group sizes come from one partial aggregation over the keys, the hot groups (if there are
any) are split off, and every other group keeps the plain single-shuffle window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from raceboard.session import scratch_path

# A cell key: (expression, ascending).  Ascending keys sort NULLs first and
# descending keys sort NULLs last, which is Spark's default for each direction.
Cell = tuple[Column, bool]

# Writes a table under a name and returns its read-back.
Stage = Callable[[str, DataFrame], DataFrame]

# Up to so many rows a partition, a task's own first rows are few enough to hand on.
PARTIAL_TOP = 1000
# A group with more rows than this is numbered through cells instead of one task.
HOT_GROUP_ROWS = 1 << 22
# So many keys are broadcast at most.
MAX_HOT = 100_000
# Marker for "read the hot-group threshold from the session" (see ``tuning``).
AUTO = -1


def tuning(df: DataFrame, name: str, default: int) -> int:
    """An integer knob from the session conf ``spark.raceboard.<name>`` (else ``default``).

    Knobs: ``hotGroupRows`` (hot-group threshold), ``lapCell``, ``orderKeyCell``,
    ``priceCell`` (cell widths).  Cluster jobs size them to executor memory; tests shrink
    them to push every code path through the cell-numbering branch.
    """
    value = df.sparkSession.conf.get(f"spark.raceboard.{name}", None)
    return int(value) if value else default


def _scratch(name: str, df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sort(c: Column, ascending: bool) -> Column:
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    cond = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys]
    return left.alias("__l").join(right.alias("__r"), cond, how)


def split_hot(df: DataFrame, partition_by: Sequence[str], hot_rows: int,
              sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of groups with more than ``hot_rows`` rows or None).

    ``sizes`` (partition columns + ``__size``) may be supplied when an upstream
    aggregation already counted the groups; otherwise one partial aggregation does. It runs
    at once: mostly no group is hot, and then the rows need no split at all. The hot keys are
    broadcast if they are at most ``MAX_HOT``; beyond that Spark picks the join.
    """
    if sizes is None:
        sizes = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("__size"))
    hot = sizes.where(F.col("__size") > F.lit(int(hot_rows))).select(*partition_by)
    found = hot.limit(MAX_HOT + 1).count()
    if not found:
        return df, None
    if found <= MAX_HOT:
        hot = F.broadcast(hot)
    cold = _null_safe_join(df, hot, partition_by, "left_anti").select("__l.*")
    warm = _null_safe_join(df, hot, partition_by, "left_semi").select("__l.*")
    return cold, warm


def _cell_scan(df: DataFrame, partition_by: list[str], cells: Sequence[Cell], measure: Column,
               local: Callable[[WindowSpec], Column], name: str) -> DataFrame:
    cell_names = [f"__cell{i}" for i in range(len(cells))]
    keys = partition_by + cell_names
    keyed = df.withColumns({n: c for n, (c, _) in zip(cell_names, cells)})
    counts = keyed.groupBy(*keys).agg(measure.alias("__n"))
    before = (Window.partitionBy(*partition_by)
              .orderBy(*[_sort(F.col(n), asc) for n, (_, asc) in zip(cell_names, cells)])
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    scanned = keyed.withColumn("__local", local(Window.partitionBy(*keys)))
    joined = _null_safe_join(scanned, offsets, keys, "inner").select("__l.*", F.col("__r.__offset"))
    return (joined.withColumn(name, F.col("__offset") + F.col("__local"))
            .drop("__offset", "__local", *cell_names))


def _scan(df: DataFrame, partition_by: Sequence[str], cells: Sequence[Cell] | None, hot_rows: int | None,
          measure: Column, local: Callable[[WindowSpec], Column], name: str,
          sizes: DataFrame | None = None) -> DataFrame:
    partition_by = list(partition_by)
    if not cells:
        return df.withColumn(name, local(Window.partitionBy(*partition_by)))
    if hot_rows == AUTO:
        hot_rows = tuning(df, "hotGroupRows", HOT_GROUP_ROWS)
    if hot_rows is None or not partition_by:  # one group: the whole table goes through cells
        return _cell_scan(df, partition_by, cells, measure, local, name)
    cold, warm = split_hot(df, partition_by, hot_rows, sizes)
    plain = cold.withColumn(name, local(Window.partitionBy(*partition_by)))
    if warm is None:
        return plain
    return plain.unionByName(_cell_scan(warm, partition_by, cells, measure, local, name))


def ordinal(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], name: str,
            cells: Sequence[Cell] | None = None, hot_rows: int | None = None,
            sizes: DataFrame | None = None) -> DataFrame:
    """Add ``name`` = row_number() over (partition_by order by order_by), as an int.

    ``cells``: coarse keys such that sorting rows by ``order_by`` also sorts them by the
    cells (in the given directions).  Without cells this is a plain window, right for
    partitions that are many and small.  ``hot_rows``: use cells only for larger groups
    (``sizes``: optional precomputed group sizes, see ``split_hot``).
    """
    out = _scan(df, partition_by, cells, hot_rows, F.count(F.lit(1)),
                lambda w: F.row_number().over(w.orderBy(*order_by)), name, sizes)
    return out.withColumn(name, F.col(name).cast("int"))


def running_count(df: DataFrame, partition_by: Sequence[str], order_col: str, flag: Column, name: str,
                  cells: Sequence[Cell] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Flags counted from the first row through all rows sharing the current ``order_col``
    (the default RANGE frame: peers see each other's flags).  Cells must be functions of
    ``order_col`` so peers share a cell."""
    value = flag.cast("int")
    return _scan(df, partition_by, cells, hot_rows, F.sum(value),
                 lambda w: F.sum(value).over(w.orderBy(F.col(order_col))), name)


def id_cell(id_col: str | Column, width: int) -> Column:
    """Bucket of an integer id: ids ``width`` apart fall in different cells."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.floor(c.cast("double") / F.lit(float(width))).cast("bigint")


def range_ordinal(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], name: str,
                  stage: Stage | None = None, tasks: int | None = None) -> DataFrame:
    """``row_number() over (partition_by order by order_by)`` in one exchange, whatever the groups' sizes.

    Rows are range-partitioned on (partition_by, order_by) at splitters that Spark samples, so
    a large group spans as many tasks as its share of the rows, and are sorted there. A row's
    place among its task's rows plus the number of its group's rows in the tasks before (one
    count per task and group) is its rank. The placed rows are written first (``stage``):
    counts and ranks must come from the same split.
    """
    stage = stage or _scratch
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c).asc_nulls_first() for c in partition_by], *order_by]
    placed = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = stage("placed", placed).withColumn("__slice", F.shiftright("__at", 33))  # the task; its rows count on from there
    slices = rows.groupBy(*partition_by, "__slice").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*partition_by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("__n").over(before), F.lit(0))
    shifts = stage("shifts", slices.select(*partition_by, "__slice", (ahead - F.col("__first") + 1).alias("__shift")))
    ranked = _null_safe_join(rows, shifts, [*partition_by, "__slice"], "inner").select("__l.*", "__r.__shift")
    return ranked.withColumn(name, (F.col("__at") + F.col("__shift")).cast("int")).drop("__at", "__slice", "__shift")


def leaderboard_position(df: DataFrame, partition_by: Sequence[str], value: str, id_col: str,
                         name: str = "position", stage: Stage | None = None) -> DataFrame:
    """Position by ``value`` DESC (NULLs last), ties by ``id_col`` ASC, within ``partition_by``."""
    return range_ordinal(df, partition_by, [F.col(value).desc_nulls_last(), F.col(id_col).asc_nulls_last()], name, stage)


def top_n(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], n: int,
          name: str = "position") -> DataFrame:
    """Keep the first ``n`` rows per partition with their rank.

    Written as row_number + filter so Catalyst plans a partial WindowGroupLimit before
    the shuffle: each map task forwards at most ``n`` rows per partition key.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= F.lit(int(n)))


def top_n_by_value(df: DataFrame, partition_by: Sequence[str], value: str, id_col: str, n: int,
                   name: str = "position", stage: Stage | None = None) -> DataFrame:
    """The first ``n`` rows per partition by ``value`` DESC (NULLs last), then ``id_col``.

    Up to ``PARTIAL_TOP`` every task forwards ``n`` rows of a partition at most (``top_n``).
    Beyond it that limit keeps nothing back and one task would sort a whole partition, so rows
    that cannot be among the first ``n`` go by a value histogram and the rest is ranked by
    ranges. Both give the same rows.
    """
    if n <= PARTIAL_TOP:
        return top_n(df, partition_by, [F.col(value).desc_nulls_last(), F.col(id_col).asc_nulls_last()], n, name)
    return leaderboard_position(can_qualify(df, partition_by, value, n), partition_by, value, id_col, name, stage).where(F.col(name) <= F.lit(int(n)))


def can_qualify(df: DataFrame, partition_by: Sequence[str], value: str, n: int, bins: int = 1024) -> DataFrame:
    """Rows whose value is in one of the highest ``bins`` that together hold ``n`` rows of the partition.

    Bins are of equal width between the partition's extremes; rows without a value are below
    all others. Two partial aggregations, whose results have at most ``bins`` rows a partition.
    """
    parts = list(partition_by)
    ends = df.groupBy(*parts).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    share = (F.col(value) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    bin_ = F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins).cast("int")))
    binned = _null_safe_join(df, ends, parts, "inner").select("__l.*", "__r.__low", "__r.__high").withColumn("__bin", bin_)
    above = Window.partitionBy(*parts).orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lowest = (binned.groupBy(*parts, "__bin").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__ahead", F.coalesce(F.sum("__n").over(above), F.lit(0))).where(F.col("__ahead") < n)
              .groupBy(*parts).agg(F.min("__bin").alias("__least")))
    kept = _null_safe_join(binned, lowest, parts, "inner").select("__l.*", "__r.__least").where(F.col("__bin") >= F.col("__least"))
    return kept.select(*df.columns)


def best_of_group(df: DataFrame, group_by: Sequence[str], sort_key: Sequence[Column],
                  out: dict[str, str]) -> DataFrame:
    """One row per group: the row with the smallest ``sort_key`` (a tuple compared left to right).

    An aggregation (``min`` over a struct), so Spark combines map-side and a hot group
    never reaches one task whole.  ``out`` maps output name -> source column to carry.
    """
    fields = [k.alias(f"__k{i}") for i, k in enumerate(sort_key)]
    fields += [F.col(src).alias(dst) for dst, src in out.items()]
    best = F.min(F.struct(*fields)).alias("__best")
    return df.groupBy(*group_by).agg(best).select(*group_by, *[F.col(f"__best.{dst}").alias(dst) for dst in out])
