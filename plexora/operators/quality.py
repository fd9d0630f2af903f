"""Scores and tiers: ratings against attention, track quality, votes, tiered assembly, tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.scale import numbered

#: Prior mean of a rating and its weight in reviews, and the number of reviews at which a place is known.
PRIOR, PRIOR_REVIEWS, KNOWN = 3.8, 12, 1500


def rating_signal(rating: Column, reviews: Column) -> Column:
    """struct<score, tier> of a rating and its number of reviews; null if either is missing or 0.

    The rating is shrunk to the prior; quality is what it exceeds 4 by, obscurity falls with the logarithm of the
    reviews; the score is their product.
    """
    n, r = reviews.cast("double"), rating.cast("double")
    shrunk = (n * r + PRIOR_REVIEWS * PRIOR) / (n + PRIOR_REVIEWS)
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), shrunk - 4))
    obscure = F.greatest(F.lit(0.0), 1 - F.log10(F.greatest(n, F.lit(1.0))) / math.log10(KNOWN))
    score = F.round(quality * obscure, 3)
    tier = F.when((shrunk >= 4.5) & (obscure >= 0.30) & (score >= 0.20), "hidden-gem").when((shrunk >= 4.3) & (obscure <= 0.18), "crowd-favorite")
    return F.when((n != 0) & (r != 0), F.struct(score.alias("score"), tier.alias("tier")))


#: Weights of the parts of a track's score, and genres that speak against it.
TRACK_WEIGHTS = {"popularity": 3.0, "votes": 1.0, "releases": 1.2, "code": 1.5, "official": 1.0, "kind": 0.5}
NOISE = ("audiobook", "spoken word", "field recording", "test tone")


def track_score(popularity: Column, votes: Column, code: Column, status: Column, kind: Column, genres: Column, releases: Column | None = None) -> Column:
    """Weighted logarithms of listens and votes, marks for a code, an official status and a kind, less 2 for noise."""
    w = TRACK_WEIGHTS
    zero = F.lit(0.0)
    log = lambda c: F.log10(1 + F.greatest(zero, F.coalesce(c.cast("double"), zero)))
    mark = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    s = w["popularity"] * log(popularity) + w["votes"] * log(votes)
    s = s + mark(F.coalesce(code, F.lit("")) != "", w["code"]) + mark(status == "official", w["official"]) + mark(kind.isin("Album", "Single", "EP"), w["kind"])
    if releases is not None:
        s = s + w["releases"] * F.log10(F.coalesce(releases.cast("double"), F.lit(1.0)))
    return s - mark(F.lower(F.array_join(genres, " ")).rlike("|".join(NOISE)), 2.0)


def track_tier(popularity: Column, votes: Column, code: Column, status: Column, floor: int = 1, marquee: int = 50_000) -> Column:
    """high (many listens), mid (a code or an official status), low (some listens or votes), else reject."""
    p, v = F.coalesce(popularity, F.lit(0)), F.coalesce(votes, F.lit(0))
    mid = (F.coalesce(code, F.lit("")) != "") | F.coalesce(status == "official", F.lit(False))
    return F.when(p >= marquee, "high").when(mid, "mid").when((p > 0) | (v >= floor), "low").otherwise("reject")


def seed_score(rating: Column | None, votes: Column | None, w_rating: float = 1.0, w_votes: float = 1.0) -> Column:
    """Weighted rating plus weighted logarithm of the votes, of the signals that there are; 0 without any."""
    zero = F.lit(0.0)
    parts = [w_rating * F.coalesce(rating.cast("double"), zero)] if rating is not None else []
    parts += [w_votes * F.log(1 + F.coalesce(votes.cast("double"), zero))] if votes is not None else []
    return sum(parts, zero)


def labels_and_year(rows: DataFrame, key: str, label: str, year: str) -> DataFrame:
    """key, labels (different names, in order, joined by commas), year (the earliest)."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("labels"), F.min(year).alias("year"))


TIERS = ("high", "mid", "low", "reject")


def assemble(tracks: DataFrame, target: int, volume: int, cap: int, marquee: int = 50_000) -> DataFrame:
    """The volume-th part of `target` tracks: tier by tier in order, each id once, at most `cap` tracks of an artist who
    isn't known to many; rejects only fill up what is missing.

    tracks: id, artist, popularity, tier, ordinal. Done as deduplication, then cap, then place; this differs from a
    sequential pass only if one id is there under two artists and the first is beyond its cap.
    """
    t = tracks.withColumn("__t", F.array_position(F.array(*[F.lit(x) for x in TIERS]), F.col("tier")))
    one = t.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("__t", "ordinal"))).where(F.col("rn") == 1)
    a = one.withColumn("rn", F.row_number().over(Window.partitionBy("artist").orderBy("__t", "ordinal")))
    a = a.where((F.col("popularity") >= marquee) | (F.col("rn") <= cap)).drop("rn")
    best = a.orderBy("__t", "ordinal", "id").limit(target * volume)  # a top-k: no task holds more than that
    placed = best.withColumn("place", F.row_number().over(Window.orderBy("__t", "ordinal", "id")))
    return placed.where(F.col("place") > target * (volume - 1)).drop("__t")


def tag_votes(rows: DataFrame, key: str, name: str, votes: str, least: int = 1) -> DataFrame:
    """key, tags: names with their votes summed, at least `least`, most first, in title case."""
    g = rows.where(F.col(name).isNotNull()).groupBy(key, F.lower(name).alias("n")).agg(F.sum(votes).alias("v")).where(F.col("v") >= least)
    order = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "n")))
    return g.groupBy(key).agg(F.transform(order, lambda s: F.initcap(s["n"])).alias("tags"))


def weight(kind: Column, rating: Column, reviews: Column, past: Column, image: Column) -> Column:
    """Prominence: events by being to come and by a picture; else the rating times the logarithm of its reviews."""
    event = F.when(F.coalesce(past, F.lit(False)), 0.2).otherwise(1.0) + F.when(F.coalesce(image, F.lit("")) != "", 0.5).otherwise(0.0)
    return F.when(kind == "Event", event).otherwise(F.coalesce(rating, F.lit(0.0)) * F.log10(F.coalesce(reviews, F.lit(0)) + F.lit(10.0)))


def tile_sizes(points: DataFrame, shelf: str, weight_col: str, x: str) -> DataFrame:
    """shelf, id, size, place: the first by weight is a hero, the next two large, the last 35 per cent small; in order of x."""
    t = points.select(shelf, "id", weight_col, F.col(x).alias("__x"))
    t = numbered(t, [shelf], [F.desc(weight_col), F.col("id")], "__i", "__n")
    i, n = F.col("__i") - 1, F.col("__n")
    size = F.when(i == 0, "hero").when(i <= 2, "lg").when(i >= n * 0.65, "sm").otherwise("md")
    t = t.select(shelf, "id", size.alias("size"), "__x")
    return numbered(t, [shelf], [F.col("__x").asc_nulls_first(), F.col("id")], "place").select(shelf, "id", "size", "place")


def roll(rows: DataFrame, group: str, order: Sequence[str], size: int) -> DataFrame:
    """rows with place and shard: rows rolled into parts of `size` within each group, in a total order."""
    n = numbered(rows, [group], [F.col(c) for c in order], "__n")
    return n.withColumn("place", (F.col("__n") - 1).cast("bigint")).withColumn("shard", F.floor((F.col("__n") - 1) / size)).drop("__n")


def geo_rows(points: DataFrame, shelf: str, cols: int) -> DataFrame:
    """shelf, id, place: bands of `cols` points from north to south, each from west to east; no position comes last."""
    t = numbered(points.select(shelf, "id", "lat", "lon"), [shelf], [F.col("lat").desc_nulls_last(), F.col("id")], "__i")
    b = t.select(shelf, "id", "lon", F.when(F.col("lat").isNull(), 1).otherwise(0).alias("__none"), F.floor((F.col("__i") - 1) / cols).alias("band"))
    return numbered(b, [shelf], [F.col("__none"), F.col("band"), F.col("lon"), F.col("id")], "place").select(shelf, "id", "place")


def shelves(points: DataFrame, group: str, least: int = 3, sinks: Sequence[str] = ("Other", "No location")) -> DataFrame:
    """shelf, n: groups of fewer than `least` points fold into Other; the largest first, sinks last."""
    n = points.groupBy(F.coalesce(group, F.lit("Other")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    named = F.when((F.col("n") < least) & ~F.col("g").isin(*sinks), F.lit(sinks[0])).otherwise(F.col("g"))
    s = n.groupBy(named.alias("shelf")).agg(F.sum("n").alias("n"))
    return s.orderBy(F.col("shelf").isin(*sinks), F.desc("n"), "shelf")
