from pyspark.sql import functions as F

from raceboard.functions.columns import (
    clock_text,
    focus_opacity,
    full_name,
    is_lapped_status,
    normalise_race_date,
    text_contrast,
)


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_race_date_normaliser(spark):
    got = one_col(spark, ["28/02/98", "05/06/21", "2020-01-05", None, "01/01/1998"], normalise_race_date)
    assert got == ["1998-02-28", "2021-06-05", "2020-01-05", None, "2019-01-01"]


def test_text_contrast(spark):
    # #7D7D7D: brightness exactly 125 -> dark text; NULL -> default colour (light) -> dark text
    got = one_col(spark, ["#2B4562", "#FFF500", "#7D7D7D", None, "#000000"], text_contrast)
    assert got == ["#FFFFFF", "#000000", "#000000", "#000000", "#FFFFFF"]


def test_full_name_is_null_propagating(spark):
    df = spark.createDataFrame([("Ann", "Lee"), (None, "Lee"), ("Ann", None)], "a string, b string")
    assert [r[0] for r in df.select(full_name("a", "b")).collect()] == ["Ann Lee", None, None]


def test_lapped_status_case_insensitive(spark):
    got = one_col(spark, ["+1 Lap", "+2 laps", "+12 Laps", "Engine", "Finished", None], is_lapped_status)
    assert got == [True, True, True, False, False, None]


def test_focus_opacity(spark):
    df = spark.createDataFrame([("A",), ("B",)], "d string")
    assert [r[0] for r in df.select(focus_opacity(F.col("d"), "A")).collect()] == [0.75, 0.25]
    assert [r[0] for r in df.select(focus_opacity(F.col("d"), "None")).collect()] == [0.75, 0.75]


def test_clock_text(spark):
    got = one_col(spark, [0, 61005, 3599999, None], clock_text, "bigint")
    assert got == ["0:00.000", "1:01.005", "59:59.999", None]
