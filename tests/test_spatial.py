import math
import random

from plexora.functions.geo import latlon
from plexora.operators import spatial as S
from pyspark.sql import functions as F


def metres(a, b):
    p = math.radians
    h = math.sin(p(b[0] - a[0]) / 2) ** 2 + math.cos(p(a[0])) * math.cos(p(b[0])) * math.sin(p(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_coordinates(spark):
    texts = ["31.5,-115.2", "(53.3,-5.9)", " 47.7 -97.0 ", "34.6;-114.9", "44.79N, 95.83W", "45°48'25.0\"N 97°07'41.8\"W", "0,0", "0.0, 0.0", "NaN,NaN", "91,10", "10,181", "", None, "unknown", ",", "-41.3, -179.7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", latlon(F.col("t")).alias("p"))
    got = {r["i"]: (None if r["p"] is None else (round(r["p"]["lat"], 4), round(r["p"]["lon"], 4))) for r in df.collect()}
    assert got == {0: (31.5, -115.2), 1: (53.3, -5.9), 2: (47.7, -97.0), 3: (34.6, -114.9), 4: (44.79, -95.83), 5: (45.8069, -97.1283), **{i: None for i in range(6, 15)}, 15: (-41.3, -179.7)}


def test_near_against_brute_force(spark, rows):
    rnd = random.Random(5)
    spots = [(0.0, 179.9999), (0.0, -179.9999), (89.999, 10.0), (70.0, 6.0), (-41.3, 174.0)]
    mk = lambda n, c: [(f"{c}{i}", a + rnd.uniform(-2e-3, 2e-3), max(-180.0, min(180.0, o + rnd.uniform(-2e-3, 2e-3)))) for i in range(n) for a, o in [rnd.choice(spots)]]
    a, b = mk(150, "a"), mk(80, "b")
    want = sorted((x[0], y[0]) for x in a for y in b if metres(x[1:], y[1:]) <= 150)
    s = "id string, lat double, lon double"
    got = rows(S.near_pairs(spark.createDataFrame(a, s), spark.createDataFrame(b, s), 150.0).select("id_l", "id_r"))
    assert got == want and len(want) > 20
    assert S.near_pairs(spark.createDataFrame([], s), spark.createDataFrame(b, s), 150.0).count() == 0


def test_regions_against_ray_casting(spark, rows):
    square = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"
    star = "POLYGON((5 0, 6 2, 8 2.5, 6.2 3, 6.5 6, 5 4, 3 5, 4 3, 2.5 1.5, 4.5 1.8))"
    multi = "MULTIPOLYGON(((10 0, 11 0, 10.5 1)), ((12 0, 13 0, 12.5 1, 12 0)))"
    regions = [("sq", square), ("st", star), ("mu", multi), ("none", None), ("bad", "POINT(1 2)"), (None, square)]
    rnd = random.Random(9)
    pts = [(f"p{i}", rnd.uniform(-1, 7), rnd.uniform(-1, 14)) for i in range(600)]
    r = S.containing_regions(spark.createDataFrame(pts, "id string, lat double, lon double"), spark.createDataFrame(regions, "localityid string, boundary string"), "localityid", "boundary")
    got = rows(r)

    def inside(x, y, wkt):
        import re

        n = 0
        for ring in re.findall(r"\(([^()]+)\)", wkt):
            p = [tuple(map(float, c.split())) for c in ring.split(",")]
            p += [p[0]] if p[0] != p[-1] else []
            n += sum((a[0] <= x) != (b[0] <= x) and a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) < y for a, b in zip(p, p[1:]))
        return n % 2 == 1

    want = sorted((i, k) for i, lat, lon in pts for k, w in regions[:3] if inside(lon, lat, w))
    assert got == want and len(want) > 50
