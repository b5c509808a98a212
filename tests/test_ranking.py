import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from raceboard.operators.cumulative import episode_number, running_total
from raceboard.operators.ranking import best_of_group, id_cell, leaderboard_position, ordinal, top_n
from raceboard.operators.palette import PALETTE, cycle_palette


def test_ordinal_matches_row_number(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 50) if rnd.random() > 0.1 else None, i) for i in range(800)]
    df = spark.createDataFrame(rows, "g int, v int, id long")
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = ordinal(df, ["g"], order, "rn", cells=[(F.col("v"), False), (id_cell("id", 64), True)])
    assert {(r.id, r.rn) for r in got.collect()} == {(r.id, r.rn) for r in want.collect()}


def test_ordinal_null_partition_and_no_partition(spark):
    df = spark.createDataFrame([(None, 5), (None, 3), (1, 4), (1, 9)], "g int, k int")
    got = {(r.g, r.k): r.n for r in ordinal(df, ["g"], [F.col("k").asc()], "n", cells=[(F.col("k"), True)]).collect()}
    assert got == {(None, 3): 1, (None, 5): 2, (1, 4): 1, (1, 9): 2}
    whole = ordinal(df, [], [F.col("k").asc()], "n", cells=[(id_cell("k", 4), True)])
    assert sorted((r.k, r.n) for r in whole.collect()) == [(3, 1), (4, 2), (5, 3), (9, 4)]


def test_leaderboard_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 10.0), (4, 12.0)], "id long, v double")
    got = {r.id: r.position for r in leaderboard_position(df, [], "v", "id").collect()}
    assert got == {4: 1, 1: 2, 3: 3, 2: 4}


def test_top_n_larger_than_group(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0)], "g int, id long, v double")
    out = top_n(df, ["g"], [F.col("v").desc(), F.col("id")], 10)
    assert sorted((r.id, r.position) for r in out.collect()) == [(1, 2), (2, 1)]


def test_best_of_group(spark):
    df = spark.createDataFrame([(1, 3, 1), (1, 3, 0), (1, 2, 5), (2, None, 9)], "g int, n int, k int")
    out = best_of_group(df, ["g"], [-F.col("n"), F.col("k")], {"k": "k"})
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0), (2, 9)]


def test_running_total_keeps_value_null(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, None), (1, 3, 5.0)], "id int, t int, v double")
    out = running_total(df, ["id"], [F.col("t")], "v", "cum").orderBy("t").collect()
    assert [(r.v, r.cum) for r in out] == [(3.0, 3.0), (None, 3.0), (5.0, 8.0)]


def test_episode_number_counts_peers(spark):
    df = spark.createDataFrame([(0, False), (1, False), (2, True), (2, True), (3, False)], "lap int, pit boolean")
    out = episode_number(df, [], "lap", F.col("pit"), "stint").orderBy("lap").collect()
    assert [r.stint for r in out] == [1, 1, 3, 3, 3]


def test_cycle_palette(spark):
    df = spark.createDataFrame([(k,) for k in (30, 2, 7, *range(100, 125))], "k int")
    got = {r.k: r.c for r in cycle_palette(df, "k", "c").collect()}
    assert got[2] == PALETTE[0] and got[7] == PALETTE[1] and got[30] == PALETTE[2]
    assert got[121] == PALETTE[0]  # 25th key wraps around


def test_hot_group_split_matches_plain_window(spark):
    from raceboard.operators.ranking import running_count
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 30), rnd.randint(0, 40), rnd.random() < 0.3, i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "g int, lap int, pit boolean, id long")
    order = [F.col("lap").asc(), F.col("id").asc()]
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
            .collect()}
    got = ordinal(df, ["g"], order, "rn", cells=[(id_cell("lap", 8), True)], hot_rows=50)
    assert {r.id: r.rn for r in got.collect()} == want
    want_c = {r.id: r.c for r in df.withColumn("c", F.sum(F.col("pit").cast("int")).over(
        Window.partitionBy("g").orderBy("lap"))).collect()}
    got_c = running_count(df, ["g"], "lap", F.col("pit"), "c", cells=[(id_cell("lap", 8), True)], hot_rows=50)
    assert {r.id: r.c for r in got_c.collect()} == want_c
