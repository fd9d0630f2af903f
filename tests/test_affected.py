import random

from pyspark.sql import functions as F

from plexora.streaming import changes as C


def batch(spark, edges):
    return spark.createDataFrame([("n", "o", "c", 1, None, [(a, "r", b) for a, b in edges], None, None)], C.CHANGE)


def test_affected_beyond_a_million(spark):
    n = 1_000_005
    hub = spark.range(n).select(F.lit("hub").alias("src"), F.lit("r").alias("rel"), F.concat(F.lit("s"), "id").alias("dst"), F.col("id").alias("seq"))
    got = C.affected_roots(batch(spark, [("hub", "new")]), hub, hub.limit(0), 1)
    assert got.agg(F.count("id"), F.count_distinct("id")).first() == (n + 2, n + 2)


def test_affected_is_the_search_by_levels(spark):
    rnd = random.Random(6)
    old, new = ([(f"n{rnd.randint(0, 40)}", "r", f"n{rnd.randint(0, 40)}", i) for i in range(30)] for _ in range(2))
    for depth in (0, 1, 2, 3):
        want = {"n1", "x"}
        for _ in range(depth):
            want |= {b for a, _, b, _ in old + new if a in want} | {a for a, _, b, _ in old + new if b in want}
        frames = [spark.createDataFrame(e, C.EDGE) for e in (old, new)]
        got = [r["id"] for r in C.affected_roots(batch(spark, [("n1", "x")]), *frames, depth).collect()]
        assert sorted(got) == sorted(want)
