"""Vector arithmetic on array columns, JVM-side, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    z = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(z, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector counts as one of length one, so that it gives 0."""
    one = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def euclidean(a: Column, b: Column) -> Column:
    z = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, x: s + x))


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row; inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    d = a.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    s = F.struct(d.alias("d"), F.when(n == 0, F.lit(1.0)).otherwise(n).alias("n"))
    return let(s, lambda v: F.transform(v["d"], lambda x: x / v["n"]))


def layer_norm(a: Column) -> Column:
    """The vector less its mean, over the root of its population variance + 1e-5."""
    d = a.cast("array<double>")
    sums = F.aggregate(d, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda t, x: F.struct((t["s"] + x).alias("s"), (t["q"] + x * x).alias("q")))
    n = F.size(d).cast("double")
    stat = let(sums, lambda t: F.struct((t["s"] / n).alias("m"), F.sqrt(F.greatest(F.lit(0.0), t["q"] / n - (t["s"] / n) * (t["s"] / n)) + 1e-5).alias("sd")))
    return let(F.struct(d.alias("d"), stat.alias("t")), lambda v: F.transform(v["d"], lambda x: (x - v["t"]["m"]) / v["t"]["sd"]))


def matryoshka(a: Column, dim: int) -> Column:
    """Layer norm over the full width, the first `dim` numbers, at length one."""
    return unit(F.slice(layer_norm(a), 1, dim))


def literal(v: Sequence[float]) -> Column:
    """A query vector as a constant of the plan."""
    return F.array(*[F.lit(float(x)) for x in v])


METRICS = {"cosine": cosine, "dot": dot, "euclid": lambda a, b: -euclidean(a, b)}


def metric(name: str | None):
    """The similarity that a collection's distance name stands for: dot..., eucl... or else cosine; more is nearer."""
    n = (name or "").lower()
    return METRICS["dot" if n.startswith("dot") else "euclid" if n.startswith("eucl") else "cosine"]
