import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from plexora.operators import flow, quality
from plexora.scale import numbered


def test_numbers_are_those_of_a_window(spark, rows):
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 40), i) for i in range(500)], "k string, x int, id int").repartition(7)
    order = [F.col("x"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = df.withColumn("n", F.row_number().over(w)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert rows(numbered(df, ["k"], order, "n", "all").select("k", "x", "id", "n", "all")) == rows(want)
    assert numbered(df.limit(0), ["k"], order, "n").count() == 0


def test_gaps_cross_pieces(spark, rows):
    rnd = random.Random(3)
    ms = [("a" if i % 5 else "b", rnd.random() * 1000) for i in range(400)] + [("c", 5.0), ("d", 1.0), ("d", 1.0)]
    got = {r["k"]: r for r in flow.gaps(spark.createDataFrame(ms, "k string, ts double").repartition(5)).collect()}
    for k in "abcd":
        ts = sorted(t for x, t in ms if x == k)
        gap = [b - a for a, b in zip(ts, ts[1:])]
        assert got[k]["gaps"] == len(gap)
        if gap:
            mean = sum(gap) / len(gap)
            assert abs(got[k]["mean"] - mean) < 1e-9 and abs(got[k]["sd"] - (sum((g - mean) ** 2 for g in gap) / len(gap)) ** 0.5) < 1e-9


def test_roll(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "g string, i int")
    assert rows(quality.roll(df, "g", ["i"], 2)) == [("a", 0, 0, 0), ("a", 1, 1, 0), ("a", 2, 2, 1), ("a", 3, 3, 1), ("a", 4, 4, 2), ("b", 9, 0, 0)]
