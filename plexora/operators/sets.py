"""Set operations on keyed rows: last wins, keep order, deltas and tree differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the order given. The rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def merge_keep_order(old: DataFrame, new: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Old rows, then new rows whose key isn't there; of equal new keys the first. Keys compare nulls as equal."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    fresh = new.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
    o = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return old.unionByName(fresh.join(o, on, "left_anti"))


def delta(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: `new` ids that weren't there, `updated` ids whose digest differs; unchanged ids give no row."""
    j = new.select(F.col(key), F.col(digest).alias("__n")).join(old.select(F.col(key), F.col(digest).alias("__o"), F.lit(True).alias("__had")), key, "left")
    change = F.when(F.col("__had").isNull(), "new").when(~F.col("__n").eqNullSafe(F.col("__o")), "updated")
    return j.select(key, change.alias("change")).where(F.col("change").isNotNull())


def dropped(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that were there and are no more."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def tree_diff(parent: DataFrame, child: DataFrame) -> DataFrame:
    """content_id, uri, ordinal, change of two trees: `added` ids with the child's uri, `removed` ids with the parent's.

    Trees: content_id, uri, ordinal. Of an id that occurs more than once the first counts. Equal ids at other uris are
    no change. An empty parent makes everything added.
    """
    first = lambda t: last_wins(t.withColumn("__o", -F.col("ordinal")), ["content_id"], ["__o"]).drop("__o")
    p, c = first(parent), first(child)
    added = c.join(p.select("content_id"), "content_id", "left_anti").withColumn("change", F.lit("added"))
    removed = p.join(c.select("content_id"), "content_id", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select("content_id", "uri", "ordinal", "change")


def blob_refs(manifests: DataFrame) -> DataFrame:
    """tree, content_id, uri, ordinal of the leaves of manifests (a VARIANT column `manifest`), of whatever kind.

    Record sets, bundles (old ones may have a single edge chunk), views and linksets; the uri stands for a missing content
    id, leaves without a uri are left out.
    """
    m = F.col("manifest")
    get = lambda path, kind: F.try_variant_get(m, path, kind)
    chunk = "array<struct<dataCid: string, contentId: string>>"
    entries = F.transform(get("$.entries", "array<struct<fields: struct<dataCid: string, contentId: string>>>"), lambda e: e["fields"])
    none = F.array().cast(chunk)
    edge = F.coalesce(F.when(F.size(get("$.edgeChunks", chunk)) > 0, get("$.edgeChunks", chunk)), F.array(get("$.edgeChunk", "struct<dataCid: string, contentId: string>")), none)
    kind = get("$.kind", "string")
    bundle = (kind == "bundle") | (get("$.version", "int") == 3)
    refs = (
        F.when(kind == "record-set", F.coalesce(entries, none))
        .when(bundle, F.concat(F.coalesce(get("$.nodeChunks", chunk), none), edge))
        .when(kind == "view", F.array(get("$.viewChunk", "struct<dataCid: string, contentId: string>")))
        .when(kind == "linkset", F.coalesce(get("$.linkChunks", chunk), none))
        .otherwise(none)
    )
    out = manifests.select("tree", F.posexplode(refs).alias("ordinal", "r")).where(F.col("r.dataCid").isNotNull())
    return out.select("tree", F.coalesce("r.contentId", "r.dataCid").alias("content_id"), F.col("r.dataCid").alias("uri"), "ordinal")


def sticky_upsert(old: DataFrame, new: DataFrame, key: str, keep_old: Sequence[str] = (), keep_true: Sequence[str] = ()) -> DataFrame:
    """Old and new rows merged by key: the new value wins, but for keep_old columns the old one (if there is one), and
    keep_true columns stay true once they are."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick: list[Column] = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    had = F.col(f"n.{key}").isNotNull()
    for c in old.columns:
        if c == key:
            continue
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_true:
            pick.append((F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))).alias(c))
        elif c in keep_old:
            pick.append(F.coalesce(a, b).alias(c))
        else:
            pick.append(F.when(had, b).otherwise(a).alias(c))
    return j.select(*pick)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: every key of two sets, in `both`, only `left` or only `right`. Null keys are in no set."""
    one = lambda d, c: d.where(F.col(key).isNotNull()).select(key).distinct().withColumn(c, F.lit(True))
    j = one(left, "l").join(one(right, "r"), key, "full_outer")
    return j.select(key, F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right").alias("side"))


def removed_points(removed: DataFrame, blobs: DataFrame, point_id: Column) -> DataFrame:
    """point_id, each once: the points of the records (in blobs, by uri) whose blobs are removed (uri)."""
    hit = blobs.join(removed.select("uri").distinct(), "uri", "left_semi")
    return hit.select(point_id.alias("point_id")).where(F.col("point_id").isNotNull()).distinct()
