"""Distributed rank equals window rank, including ties and a hot group."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from reitlens.operators.ranking import rank_collapsing_ties, rank_within


def test_rank_matches_window_rank_with_hot_group(spark):
    rnd = random.Random(5)
    rows = [("HOT" if rnd.random() < 0.6 else f"g{rnd.randint(0, 6)}", rnd.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    ours = rank_within(df, ["g"], [F.col("v").desc()], "r", partitions=16)
    ref = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc())))
    assert sorted(map(tuple, ours.select("id", "r").collect())) == sorted(map(tuple, ref.select("id", "r").collect()))


def test_global_row_number(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "v long, id long")
    ours = rank_within(df, [], [F.col("v").desc(), F.col("id").asc()], "r", method="row_number", partitions=8)
    got = sorted((r["r"], r["v"], r["id"]) for r in ours.collect())
    exp = sorted(((-v, i) for v, i in [(r[0], r[1]) for r in df.collect()]))
    assert [(v, i) for _, v, i in got] == [(-nv, i) for nv, i in exp]
    assert [r for r, _, _ in got] == list(range(1, 501))


def test_rank_collapsing_ties_matches_window_rank(spark):
    from reitlens.operators.ranking import rank_collapsing_ties
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        g = "HOT" if rnd.random() < 0.5 else f"g{rnd.randint(0, 4)}"
        v = 0.0 if rnd.random() < 0.4 else (None if rnd.random() < 0.05 else float(rnd.randint(-20, 20)))
        rows.append((g, v, i))
    df = spark.createDataFrame(rows, "g string, v double, id long")
    for asc in (False, True):
        ours = rank_collapsing_ties(df, ["g"], [("v", asc)], "r", partitions=16)
        o = F.col("v").asc() if asc else F.col("v").desc()
        ref = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(o)))
        assert sorted(map(tuple, ours.select("id", "r").collect())) == \
            sorted(map(tuple, ref.select("id", "r").collect()))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_hold_on_many_partitions(spark, reuse):

    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(0, 500_000, 1, 64).select((F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), F.lit(900_000)).alias("v"), F.col("id").alias("k"))
        order = [F.col("v").desc(), F.col("k").asc()]
        got = rank_within(df, ["g"], order, "r", "row_number", 16)
        want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
        assert got.join(want.select("k", "w"), "k").where("r = w").count() == 500_000
        ties = rank_collapsing_ties(df, ["g"], [("v", False)], "r", 16)
        want = df.withColumn("w", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc())))
        assert ties.join(want.select("k", "w"), "k").where("r = w").count() == 500_000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
