"""Adapter: derive the twelve staging inputs from the star-schema test tables.

The results workload needs race results, laps, pit stops, qualifying and the
dimensions around them; the test tables are an order/line-item star.  The mapping
(documented in FIXTURES.md section C) is deterministic and scales with the line items:

* a *race* is a calendar month of order dates (``race_k = year * 100 + month``),
* a *driver* is a supplier, a *constructor* is a nation,
* a driver's laps in a race are its line items of that month, in key order,
* results rank the drivers of a race by their returned (main) or accepted (sprint)
  large-quantity lines.

Everything is one scan of line items joined to orders, one aggregation per
(race, driver) and windows partitioned by (race, driver); race-wide rankings use
the cell-bucketed ``ordinal`` so a race never has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.functions.columns import clock_text
from raceboard.operators.palette import PALETTE, cycle_palette
from raceboard.operators.ranking import AUTO, id_cell, ordinal, tuning
from raceboard.sources.schemas import STAGING, conform_columns

# --- fixed values of the adapter mapping -----------------------------------------
MAIN_POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)        # by finishing order 1..10
SPRINT_POINTS = (8, 7, 6, 5, 4, 3, 2, 1)                   # by finishing order 1..8
STATUS = ((0, "Engine"), (1, "+1 Lap"), (2, "+2 laps"), (4, "Finished"), (5, "Finished"),
          (6, "Finished"), (7, "Finished"), (8, "Finished"), (9, "Finished"))   # id 3 is absent on purpose
MOVED_RACE, MOVED_TO_YEAR = 200107, 2003    # a one-race season
RACELESS_SEASONS = (2002, 2003)            # seasons listed even without races of their own
N_CONSTRUCTORS = 25
# ----------------------------------------------------------------------------------

# Cell widths for race-wide rankings (rows of one cell are numbered by one task).
ORDERKEY_CELL = 1 << 24
PRICE_CELL = 100
LAP_CELL = 1 << 16

TABLES = ("lineitem", "orders", "supplier", "nation")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def race_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their race key: lineitem ⋈ orders on the order key (pruned to 9 columns)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_tax", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    year, mon = F.year("o_orderdate"), F.month("o_orderdate")
    return lines.select(
        (year * 100 + mon).cast("int").alias("race_k"),
        year.cast("int").alias("o_year"),
        mon.cast("int").alias("mon"),
        F.col("l_suppkey").alias("driver_k"),
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax",
        "l_returnflag",
    )


def _is_main() -> Column:
    return (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)


def _is_sprint() -> Column:
    return (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45) & (F.col("mon") % 4 == 0)


def race_driver_totals(lines: DataFrame) -> DataFrame:
    """One row per (race, driver) with everything results need, in one aggregation."""
    qty = F.floor("l_quantity").cast("bigint")
    ms = F.floor("l_extendedprice").cast("bigint")
    main, sprint = _is_main(), _is_sprint()
    totals = lines.groupBy("race_k", "driver_k").agg(
        F.min(F.when(main, F.col("l_orderkey"))).alias("main_mo"),
        F.sum(F.when(main, qty)).alias("main_score"),
        F.count(F.when(main, F.lit(1))).alias("main_n"),
        F.min(F.when(sprint, F.col("l_orderkey"))).alias("sprint_mo"),
        F.sum(F.when(sprint, qty)).alias("sprint_score"),
        F.count(F.when(sprint, F.lit(1))).alias("sprint_n"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(ms).alias("total_ms"),
        F.min(ms).alias("best_ms"),
    )
    # race_k = year * 100 + month
    return totals.withColumns({"o_year": ((F.col("race_k") - F.col("race_k") % 100) / 100).cast("int"),
                               "mon": (F.col("race_k") % 100).cast("int")})


def _points(order: Column, position: Column, table: tuple[int, ...]) -> Column:
    scored = F.element_at(F.array(*[F.lit(float(p)) for p in table]), order)
    return (F.when(position.isNull(), F.lit(0.0))
            .when(order <= len(table), scored)
            .otherwise(F.lit(0.0)))


def _results(totals: DataFrame, kind: str) -> DataFrame:
    """Rank one kind of result ('main' or 'sprint') within each race."""
    mo, score, n = f"{kind}_mo", f"{kind}_score", f"{kind}_n"
    base = totals.where(F.col(n) > 0).select(
        "race_k", "driver_k", "n_lines", "total_ms", "best_ms",
        F.col(mo).alias("mo"), F.col(score).alias("score"), F.col(n).alias("n"))
    key_cell = tuning(totals, "orderKeyCell", ORDERKEY_CELL)
    ranked = ordinal(base, ["race_k"], [F.col("mo").asc(), F.col("driver_k").asc()], "start_order",
                     cells=[(id_cell("mo", key_cell), True)])
    ranked = ordinal(ranked, ["race_k"], [F.col("score").desc(), F.col("driver_k").asc()], "finish_order",
                     cells=[(F.col("score"), False), (id_cell("driver_k", key_cell), True)])
    status_id = ((F.col("finish_order") + F.col("race_k")) % 10).cast("int")
    position = F.when(status_id.isin(0, 3), F.lit(None).cast("int")).otherwise(F.col("finish_order"))
    finished = position.isNotNull()
    table = MAIN_POINTS if kind == "main" else SPRINT_POINTS
    return ranked.select(
        F.col("race_k").alias("raceId"),
        F.col("driver_k").alias("driverId"),
        ((F.col("driver_k") + F.col("mo") % 3) % N_CONSTRUCTORS).cast("int").alias("constructorId"),
        F.when(F.col("driver_k") % 7 == 0, F.lit(None)).otherwise(F.col("driver_k") % 100).cast("int").alias("number"),
        F.when(F.col("driver_k") % 17 == 0, F.lit(0)).otherwise(F.col("start_order")).cast("int").alias("grid"),
        position.alias("position"),
        F.coalesce(position.cast("string"), F.lit("R")).alias("positionText"),
        F.col("finish_order").cast("int").alias("positionOrder"),
        _points(F.col("finish_order"), position, table).alias("points"),
        (F.col("n_lines") if kind == "main" else F.col("n")).cast("int").alias("laps"),
        F.when(finished, clock_text("total_ms")).alias("time"),
        F.when(finished, F.col("total_ms")).alias("milliseconds"),
        F.lit(None).cast("int").alias("fastestLap"),
        F.lit(None).cast("int").alias("rank"),
        clock_text("best_ms").alias("fastestLapTime"),
        (F.lit(3600000.0) / F.col("best_ms").cast("double")).alias("fastestLapSpeed"),
        status_id.alias("statusId"),
        F.col("start_order").cast("int").alias("_start_order"),
        F.col("mo").alias("_mo"),
    )


def laps_of_results(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Numbered laps of every (race, driver) that has a main result.

    Lines are kept by a semi-join on the (race, driver) totals; the lap number is a
    per-(race, driver) row number whose hot groups are numbered through order-key cells.
    """
    with_result = totals.where(F.col("main_n") > 0).select("race_k", "driver_k")
    laps = lines.join(with_result, ["race_k", "driver_k"], "left_semi")
    order = [F.col("l_orderkey").asc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc(),
             F.col("l_extendedprice").asc()]
    sizes = totals.where(F.col("main_n") > 0).select("race_k", "driver_k", F.col("n_lines").alias("__size"))
    return ordinal(laps, ["race_k", "driver_k"], order, "lap",
                   cells=[(id_cell("l_orderkey", tuning(lines, "orderKeyCell", ORDERKEY_CELL)), True)],
                   hot_rows=AUTO, sizes=sizes)


def lap_times(laps: DataFrame) -> DataFrame:
    ranked = ordinal(laps, ["race_k", "lap"],
                     [F.col("l_extendedprice").desc(), F.col("driver_k").asc()], "lap_position",
                     cells=[(id_cell("l_extendedprice", tuning(laps, "priceCell", PRICE_CELL)), False)])
    ms = F.floor("l_extendedprice").cast("bigint")
    return ranked.select(
        F.col("race_k").alias("raceId"), F.col("driver_k").alias("driverId"),
        F.col("lap").cast("int").alias("lap"), F.col("lap_position").cast("int").alias("position"),
        clock_text(ms).alias("time"), ms.alias("milliseconds"))


def pit_stops(laps: DataFrame) -> DataFrame:
    stops = ordinal(laps.where(F.col("l_quantity") >= 45), ["race_k", "driver_k"], [F.col("lap").asc()], "stop",
                    cells=[(id_cell("lap", tuning(laps, "lapCell", LAP_CELL)), True)], hot_rows=AUTO)
    ms = F.floor(F.col("l_tax") * 100000).cast("bigint")
    secs = F.concat(((ms - ms % 1000) / 1000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((ms % 1000).cast("string"), 3, "0"))
    return stops.select(
        F.col("race_k").alias("raceId"), F.col("driver_k").alias("driverId"),
        F.col("lap").cast("int").alias("lap"), F.col("stop").cast("int").alias("stop"),
        clock_text(F.col("l_orderkey") % 3600000).alias("time"), secs.alias("duration"),
        ms.alias("milliseconds"))


def qualifying(main_results: DataFrame) -> DataFrame:
    pos = F.col("_start_order")
    base = F.col("_mo") % 40000
    return main_results.select(
        "raceId", "driverId", "constructorId", "number", pos.alias("position"),
        clock_text(base + 60000).alias("q1"),
        F.when(pos <= 15, clock_text(base + 59000)).alias("q2"),
        F.when(pos <= 10, clock_text(base + 58000)).alias("q3"))


def races(totals: DataFrame) -> DataFrame:
    months = totals.select("race_k", "o_year", "mon").distinct()
    year = F.when(F.col("race_k") == MOVED_RACE, F.lit(MOVED_TO_YEAR)).otherwise(F.col("o_year")).cast("int")
    mm = F.lpad(F.col("mon").cast("string"), 2, "0")
    dd = (F.col("mon") + 10).cast("string")
    iso = F.concat(year.cast("string"), F.lit("-"), mm, F.lit("-"), dd)
    short = F.concat(dd, F.lit("/"), mm, F.lit("/"), F.substring(year.cast("string"), 3, 2))
    return months.select(
        F.col("race_k").alias("raceId"), F.col("mon").alias("circuitId"), year.alias("year"),
        F.col("mon").alias("round"), F.concat(F.lit("Race "), F.col("mon").cast("string")).alias("name"),
        F.when(F.col("mon") % 2 == 0, iso).otherwise(short).alias("date"),
        F.lit("14:00:00").alias("time"),
        F.concat(F.lit("wiki/race/"), F.col("race_k").cast("string")).alias("url"))


def seasons(race_df: DataFrame, spark: SparkSession) -> DataFrame:
    listed = spark.createDataFrame([(y,) for y in RACELESS_SEASONS], "year int")
    years = race_df.select("year").union(listed).distinct()
    return years.select("year", F.concat(F.lit("wiki/season/"), F.col("year").cast("string")).alias("url"))


def circuits(race_df: DataFrame) -> DataFrame:
    m = F.col("circuitId")
    return race_df.select("circuitId").distinct().select(
        m.alias("circuitId"), F.concat(F.lit("circuit_"), m.cast("string")).alias("circuitRef"),
        F.concat(F.lit("Circuit "), m.cast("string")).alias("name"),
        F.concat(F.lit("City "), m.cast("string")).alias("location"),
        F.concat(F.lit("Country "), m.cast("string")).alias("country"),
        (m * 1.5).cast("double").alias("lat"), (m * -2.25).cast("double").alias("lng"),
        (m * 10).cast("double").alias("alt"),
        F.concat(F.lit("wiki/circuit/"), m.cast("string")).alias("url"))


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").select(
        k.alias("driverId"), F.concat(F.lit("supplier_"), k.cast("string")).alias("driverRef"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(k % 100).cast("int").alias("number"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("S"), F.lpad((k % 1000).cast("string"), 3, "0"))).alias("code"),
        F.lit("Supplier").alias("forename"), k.cast("string").alias("surname"),
        F.concat(F.lit("19"), (k % 40 + 60).cast("string"), F.lit("-01-01")).alias("dob"),
        F.col("s_nationkey").cast("string").alias("nationality"),
        F.concat(F.lit("wiki/driver/"), k.cast("string")).alias("url"))


def constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read_table(spark, sf_dir, "nation").select(
        k.cast("int").alias("constructorId"), F.lower("n_name").alias("constructorRef"),
        F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("nationality"),
        F.concat(F.lit("wiki/constructor/"), k.cast("string")).alias("url"))


def constructor_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read_table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 5 != 0)
    base = nations.select(F.col("n_nationkey").cast("int").alias("constructorId"), F.col("n_name").alias("name"))
    colored = cycle_palette(base, "constructorId", "auto_color")
    custom = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.col("constructorId") * 7) % len(PALETTE) + 1)
    return colored.select("constructorId", "name", "auto_color",
                          F.when(F.col("constructorId") % 4 == 1, custom).alias("custom_color"))


def status(spark: SparkSession) -> DataFrame:
    """The status code table (a fixed lookup, like the source's status file)."""
    values = ", ".join(f"({k}, '{v}')" for k, v in STATUS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(statusId, status)")  # Spark knows its size, so it is broadcast


#: Staging inputs that several tables read, and the intermediates that all come from.
KEPT, WORK = ("results", "sprint_results", "races", "lap_times"), ("race_driver_totals", "result_laps")


def work_builders(spark: SparkSession, sf_dir: str, work: Mapping[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """One thunk per shared intermediate: per-(race, driver) totals, and the numbered laps, which
    read the totals from ``work`` (the written ones, where they are written)."""
    lines = race_lines(spark, sf_dir)
    return {
        "race_driver_totals": lambda: race_driver_totals(lines),
        "result_laps": lambda: laps_of_results(lines, work["race_driver_totals"]).drop("l_returnflag", "o_year", "mon"),
    }


def adapter_work(spark: SparkSession, sf_dir: str, persist: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The two shared intermediates; ``persist(name, df)`` may write each before the next reads it."""
    work: dict[str, DataFrame] = {}
    for name, build in work_builders(spark, sf_dir, work).items():
        work[name] = persist(name, build()) if persist else build()
    return work


def staging_builders(spark: SparkSession, sf_dir: str, work: Mapping[str, DataFrame], raw: Mapping[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """One thunk per staging input, before ``conform_columns``; ``raw`` has those that others read."""
    return {
        "results": lambda: _results(work["race_driver_totals"], "main"),
        "sprint_results": lambda: _results(work["race_driver_totals"], "sprint"),
        "races": lambda: races(work["race_driver_totals"]),
        "lap_times": lambda: lap_times(work["result_laps"]),
        "pit_stops": lambda: pit_stops(work["result_laps"]),
        "qualifying": lambda: qualifying(raw["results"]),
        "seasons": lambda: seasons(raw["races"], spark),
        "circuits": lambda: circuits(raw["races"]),
        "drivers": lambda: drivers(spark, sf_dir),
        "constructors": lambda: constructors(spark, sf_dir),
        "constructor_color": lambda: constructor_color(spark, sf_dir),
        "status": lambda: status(spark),
    }


def staging_from_work(spark: SparkSession, sf_dir: str, work: Mapping[str, DataFrame],
                      persist: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All twelve staging inputs, with the declared staging schemas, from the intermediates.

    ``persist(name, df)`` may write the inputs that several tables read (``KEPT``) and return
    their read-back.
    """
    raw: dict[str, DataFrame] = {}
    for name, build in staging_builders(spark, sf_dir, work, raw).items():
        raw[name] = persist(name, build()) if persist and name in KEPT else build()
    return {name: conform_columns(raw[name], STAGING[name]) for name in STAGING}


def staging_from_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All twelve staging inputs as one lazy plan over the star-schema tables."""
    return staging_from_work(spark, sf_dir, adapter_work(spark, sf_dir))
