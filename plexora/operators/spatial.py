"""Points near other points, and the region that contains a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.functions.geo import cube_cell, cube_cells_near, haversine_m, latlon
from plexora.scale import HEAVY_ROWS, _lookup, _salts, broadcast_if_small, heavy_keys, stage


def located(df: DataFrame, key: str, coordinates: str = "coordinates") -> DataFrame:
    """id, lat, lon of the rows with a key and usable coordinates; equal rows once."""
    p = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), latlon(F.col(coordinates)).alias("p"))
    return p.where(F.col("p").isNotNull()).select("id", "p.lat", "p.lon").distinct()


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, cell_m: float | None = None) -> DataFrame:
    """id_l, id_r, metres of all pairs of two sets of (id, lat, lon) at most radius_m apart on the great circle.

    An equi-join on cubes of a grid in space: a left point lies in one cube, a right point (give the smaller set on the
    right) is repeated into the cubes that its surroundings touch, so each pair meets exactly once. A cube that holds a
    large share of the left points is split by salt, its right points repeated per salt. Rows without an id or a place are
    left out; an empty side gives no rows. Further columns of either side (with names of their own) come along.
    """
    size = cell_m or 3 * radius_m
    own = ("id", "lat", "lon")
    extra = [c for d in (left, right) for c in d.columns if c not in own]
    a = left.dropna(subset=list(own)).withColumnsRenamed({"id": "id_l", "lat": "la", "lon": "lo"})
    a = a.withColumn("cell", cube_cell(F.col("la"), F.col("lo"), size))
    b = right.dropna(subset=list(own)).withColumnsRenamed({"id": "id_r", "lat": "lb", "lon": "lp"})
    b = b.withColumn("cell", F.explode(cube_cells_near(F.col("lb"), F.col("lp"), size, radius_m)))
    heavy = heavy_keys(a, "cell")
    keys = ["cell"]
    if heavy:
        n = F.coalesce(_lookup(_salts(heavy, HEAVY_ROWS), F.col("cell")), F.lit(1))
        a = a.withColumn("salt", F.pmod(F.xxhash64("id_l"), n.cast("bigint")).cast("int"))
        b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)))
        keys.append("salt")
    d = haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    return a.join(b, keys).select("id_l", "id_r", d.alias("metres"), *extra).where(F.col("metres") <= radius_m)


def region_slabs(regions: DataFrame, key: str, boundary: str) -> DataFrame:
    """Trapezoidal decomposition of WKT polygons: id, x0, x1, lower and upper bound, and the edges of each slab in order.

    The longitudes of a region's own corners cut it into slabs [x0, x1). No edge of a simple polygon ends or crosses
    another inside a slab, so the edges that span it have one order from south to north; holes are just more edges. Edges
    are straight in degrees. Regions without a readable boundary are left out.
    """
    number = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    r = regions.where(F.col(key).isNotNull() & F.upper(F.trim(F.col(boundary))).rlike(r"^(MULTI)?POLYGON")).select(
        F.col(key).alias("id"), F.explode(F.expr(f"regexp_extract_all(`{boundary}`, '\\\\([^()]+\\\\)', 0)")).alias("ring")
    )
    nums = F.transform(F.expr(f"regexp_extract_all(ring, '{number.replace(chr(92), chr(92) * 2)}', 0)"), lambda s: s.try_cast("double"))
    r = r.select("id", nums.alias("n")).where(F.size("n") >= 6)
    corner = lambda i: F.struct(F.get("n", 2 * i).alias("x"), F.get("n", 2 * i + 1).alias("y"))
    pts = r.select("id", F.transform(F.sequence(F.lit(0), F.expr("size(n) div 2") - 1), corner).alias("p"))
    last = F.element_at("p", -1)
    pts = pts.select("id", F.when(last == F.get("p", F.lit(0)), F.col("p")).otherwise(F.concat("p", F.slice("p", 1, 1))).alias("p"))
    edge = F.transform(
        F.sequence(F.lit(0), F.size("p") - 2),
        lambda i: F.when(
            F.get("p", i)["x"] < F.get("p", i + 1)["x"],
            F.struct(F.get("p", i)["x"].alias("xa"), F.get("p", i)["y"].alias("ya"), F.get("p", i + 1)["x"].alias("xb"), F.get("p", i + 1)["y"].alias("yb")),
        ).otherwise(
            F.struct(F.get("p", i + 1)["x"].alias("xa"), F.get("p", i + 1)["y"].alias("ya"), F.get("p", i)["x"].alias("xb"), F.get("p", i)["y"].alias("yb")),
        ),
    )
    edges = pts.select("id", F.explode(edge).alias("e")).select("id", "e.*")
    cuts = edges.select("id", F.explode(F.array("xa", "xb")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    spans = edges.where(F.col("xa") < F.col("xb")).join(cuts, "id")
    i0, i1 = F.array_position("xs", F.col("xa")), F.array_position("xs", F.col("xb"))
    spans = spans.select("id", "xa", "ya", "xb", "yb", F.explode(F.slice(F.arrays_zip(F.col("xs").alias("x0"), F.slice("xs", F.lit(2), F.size("xs")).alias("x1")), i0.cast("int"), (i1 - i0).cast("int"))).alias("s"))
    at = lambda x: F.col("ya") + (F.col("yb") - F.col("ya")) * (x - F.col("xa")) / (F.col("xb") - F.col("xa"))
    spans = spans.select("id", "s.x0", "s.x1", at(F.col("s.x0")).alias("y0"), at(F.col("s.x1")).alias("y1"))
    ordered = F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("mid"), "y0", "y1")))
    return spans.groupBy("id", "x0", "x1").agg(
        F.min(F.least("y0", "y1")).alias("ylo"), F.max(F.greatest("y0", "y1")).alias("yhi"), ordered.alias("edges")
    )


def edges_below(edges: Column, x0: Column, x1: Column, x: Column, y: Column) -> Column:
    """How many of a slab's ordered edges lie below the point, by binary search."""
    share = (x - x0) / (x1 - x0)
    steps = F.ceil(F.log2(F.size(edges) + F.lit(1))).cast("int")

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        e = F.get(edges, mid)
        below = e["y0"] + (e["y1"] - e["y0"]) * share < y
        go = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(go & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(go & ~F.coalesce(below, F.lit(False)), mid).otherwise(acc["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda a: a["lo"])


def containing_regions(points: DataFrame, regions: DataFrame, key: str, boundary: str, cell_deg: float = 0.25) -> DataFrame:
    """id, region of each point (id, lat, lon) and each region whose boundary contains it.

    Slabs and points meet by cells of a grid in degrees; within its slab a point is placed among the ordered edges by
    binary search, and lies inside if an odd number of them is below it. Few slabs are broadcast after a check of their
    number, else joined by shuffle with heavy cells split by salt. Points with a null are left out.
    """
    c = lambda x: F.floor(x / cell_deg)
    slabs = region_slabs(regions, key, boundary)
    cells = F.flatten(
        F.transform(
            F.sequence(c(F.col("x0")), c(F.col("x1"))),
            lambda i: F.transform(F.sequence(c(F.col("ylo")), c(F.col("yhi"))), lambda j: F.xxhash64(i, j)),
        )
    )
    slabs = slabs.select(F.col("id").alias("region"), "x0", "x1", "edges", F.explode(cells).alias("cell"))
    pts = points.dropna().withColumn("cell", F.xxhash64(c(F.col("lon")), c(F.col("lat"))))
    keys = ["cell"]
    hinted = broadcast_if_small(slabs)
    if hinted is slabs and (heavy := heavy_keys(pts, "cell")):
        n = F.coalesce(_lookup(_salts(heavy, HEAVY_ROWS), F.col("cell")), F.lit(1))
        pts = pts.withColumn("salt", F.pmod(F.xxhash64("id"), n.cast("bigint")).cast("int"))
        hinted = slabs.withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1)))
        keys.append("salt")
    hit = pts.join(hinted, keys).where((F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1")))
    inside = edges_below(F.col("edges"), F.col("x0"), F.col("x1"), F.col("lon"), F.col("lat")) % 2 == 1
    return hit.where(inside).select("id", "region")


def near_and_inside(events: DataFrame, music: DataFrame, localities: DataFrame, radius_m: float = 150.0) -> DataFrame:
    """kind, id_a, id_b: events near music places, and the locality that contains a music place; each row once."""
    ev, mb = stage(located(events, "eventid"), "points"), stage(located(music, "mbid"), "points")  # each is read twice
    near = near_pairs(ev, mb, radius_m).select(
        F.lit("near").alias("kind"), F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b")
    )
    inside = containing_regions(mb, localities, "localityid", "boundary").select(
        F.lit("inside").alias("kind"), F.col("id").alias("id_a"), F.col("region").alias("id_b")
    )
    return near.unionByName(inside).distinct()
