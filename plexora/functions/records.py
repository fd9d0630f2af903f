"""Shapes of nested catalogue records: credits, contributors, best releases, lookups, shared lists."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def artist_credit(credit: Column) -> Column:
    """The names of array<struct<name, joinphrase, ...>> joined by their own phrases."""
    one = lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.coalesce(c["joinphrase"], F.lit("")))
    return F.trim(F.array_join(F.transform(credit, one), ""))


def credited(recording: Column, release: Column) -> Column:
    """The recording's credit, else the release's."""
    return F.coalesce(F.when(F.size(recording) > 0, recording), release)


def artist_ids(credit: Column) -> Column:
    """Distinct artist ids of a credit, in order."""
    return F.array_distinct(F.filter(F.transform(credit, lambda c: c["id"]), lambda x: x.isNotNull() & (x != "")))


def contributors(*sources: Column) -> Column:
    """array<struct<role, name, id>> of several sources, the first of each id."""
    every = F.concat(*[F.coalesce(s, F.filter(s, lambda x: F.lit(False))) for s in sources])
    return F.filter(every, lambda c: c["id"].isNotNull()) if len(sources) == 1 else F.aggregate(
        F.filter(every, lambda c: c["id"].isNotNull()),
        F.filter(every, lambda c: F.lit(False)),
        lambda acc, c: F.when(F.exists(acc, lambda a: a["id"] == c["id"]), acc).otherwise(F.array_append(acc, c)),
    )


def best_release(releases: DataFrame, key: str, kinds: Sequence[str] = ("Album", "Single", "EP")) -> DataFrame:
    """Of each key the release of the best kind, then the earliest; releases without a date come last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0)), F.lit(len(kinds) + 1))
    w = Window.partitionBy(key).orderBy(rank, F.col("date").asc_nulls_last(), "id")
    return releases.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")


def with_listens(rows: DataFrame, listens: DataFrame, key: str, column: str = "listens") -> DataFrame:
    """Rows with a looked-up count; misses count 0."""
    return rows.join(listens.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(0)))


def track_nodes(tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Track nodes, taxonomy nodes and the edges between them: id and tags of one row become two nodes and an edge.

    Taxonomy nodes carry the name that the edge points to, so that no edge dangles.
    """
    tax = F.concat(F.lit("taxonomy:"), F.col("id"))
    return tracks.drop("tags"), tracks.select(tax.alias("id"), "tags"), tracks.select(F.col("id").alias("src"), F.lit("hasTaxonomy").alias("rel"), tax.alias("dst"))


def drop_empty(row: dict[str, Any]) -> dict[str, Any]:
    """Without nulls, empty texts, lists and objects; False and 0 stay."""
    return {k: v for k, v in row.items() if v is not None and v != "" and v != [] and v != {}}


def encode_share(items: Sequence[Sequence[Any]]) -> str:
    """A list of tuples as base64url without padding."""
    return base64.urlsafe_b64encode(json.dumps([list(i) for i in items], separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")


def decode_share(text: str) -> list[list[Any]]:
    """The reverse; [] for anything that isn't such a list."""
    try:
        v = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        return []
    return [list(i) for i in v if isinstance(i, list)] if isinstance(v, list) else []


def heading_rail(candidates: DataFrame, rated: DataFrame, pool: int, rail: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The best `rail` of the best `pool` candidates that haven't been rated."""
    left = candidates.join(rated.select(id_col).distinct(), id_col, "left_anti")
    return left.orderBy(F.desc(score), id_col).limit(pool).orderBy(F.desc(score), id_col).limit(rail)
