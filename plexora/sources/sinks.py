"""Sinks: volumes of staged nodes, publish batches, upserts of embedded points, copies of collections, full snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.functions.embedding import Embedder, embed_column
from plexora.functions.identity import uuid5
from plexora.operators.sets import last_wins, merge_keep_order
from plexora.scale import stage
from plexora.sources.shards import remove_folder

NODE = "name string, fields string"


def _volume(folder: str, volume: int, stem: str) -> str:
    return f"{folder}/volume_{volume}_{stem}"


def read_volume(spark: SparkSession, folder: str, volume: int, stem: str, schema: str) -> DataFrame:
    """The rows of a volume; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_volume(folder, volume, stem))
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).json(_volume(folder, volume, stem)) if there else spark.createDataFrame([], schema)


def emit_volumes(nodes: Mapping[str, DataFrame], edges: DataFrame, folder: str, volume: int = 1, snapshot: Sequence[str] = (), accumulate: bool = False, known: Sequence[str] = ()) -> dict[str, int]:
    """Writes nodes (name, fields) by stem and edges (rel, src, dst, src_type, dst_type) as volumes of line JSON; returns
    counts by stem.

    Accumulating, a stem that is no snapshot is a ledger: new rows join the old ones, of equal names (edges: relation and
    ends) the old one stays. Snapshots are written anew. Known stems that this run doesn't write are removed: all of them,
    or when accumulating the snapshots. Old rows are staged before their files are written over.
    """
    spark = edges.sparkSession
    keys = {**{s: ["name"] for s in nodes}, "edges": ["rel", "src", "dst"]}
    counts = {}
    for stem, rows in {**nodes, "edges": edges}.items():
        if accumulate and stem not in snapshot:
            old = read_volume(spark, folder, volume, stem, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))
            numbered = stage(rows.withColumn("__o", F.monotonically_increasing_id()), "volume-new")
            rows = stage(merge_keep_order(old.withColumn("__o", F.lit(-1).cast("bigint")), numbered, keys[stem], "__o").drop("__o"), "volume")
        rows.write.mode("overwrite").json(_volume(folder, volume, stem))
        counts[stem] = spark.read.schema(rows.schema).json(_volume(folder, volume, stem)).count()
    for stem in known:
        if stem not in counts and (stem in snapshot or not accumulate):
            remove_folder(_volume(folder, volume, stem))
    return counts


def publish_batch(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes {vertices: [{id, tag, payload}]} and {edges: [{rel, from, to}]} as line JSON, one member per line, in two
    folders. nodes: name, entity_type, fields. Nodes without a name and edges without an end are left out. A cursor may
    move only after this has returned."""
    nodes.where(F.coalesce("name", F.lit("")) != "").select(F.col("name").alias("id"), F.col("entity_type").alias("tag"), F.col("fields").alias("payload")).write.mode("overwrite").json(f"{path}/vertices")
    whole = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    whole.select("rel", F.col("src").alias("from"), F.col("dst").alias("to")).write.mode("overwrite").json(f"{path}/edges")


def points_of(records: DataFrame, model: Embedder, text: str = "text") -> DataFrame:
    """Points of records (track_id, entity_type, owner, fields, text): deterministic ids, so that loading again changes
    nothing; texts embedded in Arrow batches. Records without an id or a text are left out."""
    r = records.where(F.col("track_id").isNotNull() & F.col(text).isNotNull())
    e = embed_column(r.select("track_id", "entity_type", "owner", "fields", text), text, model)
    return e.select(uuid5(F.col("track_id")).alias("point_id"), "track_id", "entity_type", "owner", "fields", "embedding")


def upsert_points(old: DataFrame, new: DataFrame, key: str = "point_id", order: str | None = None) -> DataFrame:
    """The collection after an upsert: new points in the place of old ones of the same id. Of several new points of an id
    the last by `order` counts, else any one that is the same in each run."""
    one = last_wins(new, [key], [order] if order else [c for c in new.columns if c != key and new.schema[c].dataType.typeName() in ("string", "long", "integer", "double")])
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def attach_embeddings(hits: DataFrame, points: DataFrame, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Hits with their points' vectors; null where there is none."""
    return hits.join(points.select(id_col, vector), id_col, "left")


def copy_collection(spark: SparkSession, source: str, target: str) -> int:
    """Copies a collection of Parquet files point by point; returns the number of points that are there afterwards."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def full_snapshot(before: DataFrame, added: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A commit that is a full snapshot: what was there and what is added (added wins), and one edge per node to itself."""
    nodes = upsert_points(before, added, key)
    return nodes, nodes.select(F.lit("self").alias("rel"), F.col(key).alias("src"), F.col(key).alias("dst"))
