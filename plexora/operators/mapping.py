"""Two-dimensional maps of vectors, centroids of labels, and placing a query on the map."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.functions import vectors as V


def moments(points: DataFrame, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance of all vectors in one pass: each partition sends one dim x dim matrix."""
    dim_row = points.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if dim_row is None:
        return np.zeros(0), np.zeros((0, 0)), 0
    d = dim_row[0]

    def work(it):
        import pandas as pd

        n, s, c = 0, np.zeros(d), np.zeros((d, d))
        for pdf in it:
            rows = [v for v in pdf[vector] if v is not None and len(v) == d]
            if rows:
                x = np.array(rows, float)
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    part = points.select(vector).mapInPandas(work, "n bigint, s array<double>, c array<double>").where("n > 0")
    # sums over partitions, element by element, before anything reaches the driver
    tot = part.agg(F.sum("n")).first()[0] or 0
    if not tot:
        return np.zeros(d), np.zeros((d, d)), 0
    add = lambda c: {r[0]: r[1] for r in part.select(F.posexplode(c)).groupBy("pos").agg(F.sum("col")).collect()}
    s = np.array([v for _, v in sorted(add("s").items())]) / tot
    c = np.array([v for _, v in sorted(add("c").items())]).reshape(d, d) / tot - np.outer(s, s)
    return s, c, tot


def pca_axes(points: DataFrame, k: int = 2, vector: str = "embedding") -> tuple[list[float], list[list[float]]]:
    """Mean and the first k principal axes; an axis's largest component is positive, so that signs are settled."""
    mean, cov, n = moments(points, vector)
    if not n:
        return [], []
    w, v = np.linalg.eigh(cov)
    axes = []
    for i in np.argsort(-w, kind="stable")[:k]:
        a = v[:, i]
        axes.append((a * np.sign(a[np.abs(a).argmax()]) if a.any() else a).tolist())
    return mean.tolist(), axes


def map_points(points: DataFrame, id_col: str = "id", vector: str = "embedding", box: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """id, x, y: vectors on their first two principal axes, each axis scaled to the box; a constant axis gives its middle."""
    mean, axes = pca_axes(points, 2, vector)
    if len(axes) < 2:
        return points.sparkSession.createDataFrame([], f"{id_col} {points.schema[id_col].dataType.simpleString()}, x double, y double")
    c = F.zip_with(F.col(vector).cast("array<double>"), V.literal(mean), lambda a, b: a - b)
    p = points.where(F.col(vector).isNotNull()).select(id_col, V.dot(c, V.literal(axes[0])).alias("x"), V.dot(c, V.literal(axes[1])).alias("y"))
    b = p.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, hi = box

    def scaled(c: str):
        a, z = b[f"lo{c}"], b[f"hi{c}"]
        if a is None or z is None or z - a < 1e-12:
            return F.lit((lo + hi) / 2)
        return F.lit(lo) + (F.col(c) - a) / (z - a) * (hi - lo)

    return p.select(id_col, F.round(scaled("x"), 5).alias("x"), F.round(scaled("y"), 5).alias("y"))


def mean_vectors(points: DataFrame, key: str, vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """key, pos, mean: the mean vector of each key, weighted or not, position by position; pre-aggregated in the tasks."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    e = points.where(F.col(vector).isNotNull()).select(key, w.alias("__w"), F.posexplode(vector).alias("pos", "x"))
    return e.groupBy(key, "pos").agg((F.sum(F.col("x").cast("double") * F.col("__w")) / F.sum("__w")).alias("mean"))


def label_centroids(points: DataFrame, label: str, least: int = 5, most: int = 40) -> DataFrame:
    """label, x, y, n: mean places of labels with at least `least` points; the `most` largest."""
    g = points.where(F.col(label).isNotNull() & F.col("x").isNotNull()).groupBy(label).agg(
        F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.count(F.lit(1)).alias("n")
    )
    return g.where(F.col("n") >= least).orderBy(F.desc("n"), label).limit(most)


def place_query(points: DataFrame, query: Sequence[float], k: int = 12, vector: str = "embedding") -> DataFrame:
    """x, y: the query's place among its k nearest points, each weighing the square of its similarity."""
    s = points.where(F.col(vector).isNotNull() & F.col("x").isNotNull()).select("id", "x", "y", V.cosine(F.col(vector), V.literal(query)).alias("s"))
    top = s.orderBy(F.desc("s"), "id").limit(k)
    w = F.pow(F.greatest(F.lit(0.0), F.col("s")), 2) + 1e-3
    return top.agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"))
