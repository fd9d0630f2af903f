"""Keeping a graph current from a stream of changes with Structured Streaming.

State is a set of Parquet tables in a shared folder, a base and the operations of the batches since, and a pointer that
names those in force. A batch writes its operations and then moves the pointer, so that a batch which is replayed after a
failure finds its work done and does nothing; state is committed after the write, never before.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plexora.operators.graph import adjacency
from plexora.scale import stage
from plexora.sources.shards import read_json, remove_folder, write_json

#: One change per line.
CHANGE = (
    "namespace string, owner string, commitCid string, blockNumber bigint, "
    "addedVertices array<struct<cid: string, schemaId: string, payload: string>>, "
    "addedEdges array<struct<sourceCid: string, relation: string, targetCid: string>>, "
    "removedVertexCids array<string>, removedEdges array<struct<sourceCid: string, relation: string, targetCid: string>>"
)
VERTEX, EDGE = "cid string, schema_id string, payload string", "src string, rel string, dst string, seq bigint"


def change_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Changes of line-JSON files as they arrive; lines that aren't JSON become rows of nulls and change nothing."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", per_trigger).json(folder)


def _operations(changes: DataFrame, added: str, removed: str, key: list[str], fields: list[tuple[str, str]]) -> DataFrame:
    """key, other fields, op of the last operation on each key: changes in the order of their block, of one change first
    its removals and then its additions."""
    order = [F.col("blockNumber").alias("__b"), F.col("__i")]
    c = changes.withColumn("__i", F.monotonically_increasing_id())
    a = c.select(*order, F.posexplode(added).alias("__p", "e")).select("__b", "__i", F.lit(1).alias("__s"), "__p", F.lit("add").alias("op"), *[F.col(f"e.{x}").alias(y) for x, y in fields])
    r = c.select(*order, F.posexplode(removed).alias("__p", "e"))
    whole = isinstance(changes.schema[removed].dataType.elementType.typeName(), str) and changes.schema[removed].dataType.elementType.typeName() == "struct"
    gone = [F.col(f"e.{x}").alias(y) if whole else F.col("e").alias(y) for x, y in fields if y in key]
    r = r.select("__b", "__i", F.lit(0).alias("__s"), "__p", F.lit("remove").alias("op"), *gone)
    both = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col("__b").desc_nulls_last(), F.desc("__i"), F.desc("__s"), F.desc("__p"))
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn", "__b", "__i", "__s", "__p")


def operations(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last operation of a batch on each vertex (cid, schema_id, payload, op) and each edge (src, rel, dst, op)."""
    v = _operations(changes, "addedVertices", "removedVertexCids", ["cid"], [("cid", "cid"), ("schemaId", "schema_id"), ("payload", "payload")])
    e = _operations(changes, "addedEdges", "removedEdges", ["src", "rel", "dst"], [("sourceCid", "src"), ("relation", "rel"), ("targetCid", "dst")])
    return v.where(F.col("cid").isNotNull()).select("cid", "schema_id", "payload", "op"), e.select("src", "rel", "dst", "op")


def apply_changes(vertices: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after a batch of changes: per key only the last operation counts; vertices by id, edges by their ends and
    relation. Removing what isn't there does nothing. New edges come after the old ones."""
    v, e = operations(changes)
    vs = vertices.join(v.select("cid"), "cid", "left_anti").unionByName(v.where("op = 'add'").select("cid", "schema_id", "payload"))
    base = edges.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__m"))
    fresh = e.where("op = 'add'").select("src", "rel", "dst").join(edges, ["src", "rel", "dst"], "left_anti")
    fresh = fresh.crossJoin(F.broadcast(base)).select("src", "rel", "dst", (F.col("__m") + 1 + F.monotonically_increasing_id()).alias("seq"))
    touched = e.where("op = 'remove'").select("src", "rel", "dst")
    es = edges.join(touched, ["src", "rel", "dst"], "left_anti").unionByName(fresh)
    return vs, es


class GraphState:
    """Vertices and edges in a folder: a base, the operations of the batches since, and a pointer that names both.

    A batch costs what it changes: its operations are written, and merged with the base when the graph is read. After
    COMPACT_AFTER batches a new base is written and what it replaces, but for the base before it, is removed.
    """

    COMPACT_AFTER = 10

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> dict:
        return read_json(f"{self.folder}/current.json", {"batch": -1, "base": None, "deltas": []})

    def version(self) -> int:
        """The batch that was applied last; -1 before the first."""
        return int(self._pointer()["batch"])

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The graph as it is now."""
        at = self._pointer()
        return self._merged(at["base"], at["deltas"])

    def _merged(self, base: int | None, deltas: list[int]) -> tuple[DataFrame, DataFrame]:
        read = lambda part, kind, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/{part}/{kind}")
        v = self.spark.createDataFrame([], VERTEX) if base is None else read(f"v{base}", "vertices", VERTEX)
        e = self.spark.createDataFrame([], EDGE) if base is None else read(f"v{base}", "edges", EDGE)
        if not deltas:
            return v, e
        v, e = (d.withColumn("op", F.lit("add")).withColumn("batch", F.lit(-1)) for d in (v, e))
        for n in deltas:
            v = v.unionByName(read(f"d{n}", "vertices", VERTEX + ", op string").withColumn("batch", F.lit(n)))
            e = e.unionByName(read(f"d{n}", "edges", EDGE + ", op string").withColumn("batch", F.lit(n)))
        last = F.max(F.struct("batch", "op", "schema_id", "payload")).alias("s")
        vs = v.groupBy("cid").agg(last).where("s.op = 'add'").select("cid", "s.schema_id", "s.payload")
        # an edge keeps the place that it got when it was added first after its last removal; a key has at most one
        # operation per batch, so at most COMPACT_AFTER + 1
        ops = F.array_sort(F.collect_list(F.struct("batch", "op", "seq")))
        es = e.groupBy("src", "rel", "dst").agg(ops.alias("o")).where(F.element_at("o", -1)["op"] == "add")
        cut = F.aggregate("o", F.lit(-2), lambda a, x: F.when(x["op"] == "remove", x["batch"]).otherwise(a))
        es = es.select("src", "rel", "dst", F.get(F.filter("o", lambda x: x["batch"] > cut), F.lit(0))["seq"].alias("seq"))
        return vs, es

    def prepare(self, batch: int, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Writes a batch's operations aside and returns the graph with them; the pointer stays where it is."""
        v, e = operations(changes)
        i = F.monotonically_increasing_id()
        # batch, task and row in one number, so that later edges come later
        place = F.lit(batch).cast("bigint") * (1 << 40) + F.shiftright(i, 33) * (1 << 24) + i.bitwiseAND(F.lit((1 << 33) - 1))
        v.write.mode("overwrite").parquet(f"{self.folder}/d{batch}/vertices")
        e.withColumn("seq", place).write.mode("overwrite").parquet(f"{self.folder}/d{batch}/edges")
        at = self._pointer()
        return self._merged(at["base"], [*at["deltas"], batch])

    def commit(self, batch: int) -> None:
        """Moves the pointer past a prepared batch."""
        at = self._pointer()
        base, deltas = at["base"], [*at["deltas"], batch]
        gone: list[str] = []
        if len(deltas) >= self.COMPACT_AFTER:
            v, e = self._merged(base, deltas)
            v.write.mode("overwrite").parquet(f"{self.folder}/v{batch}/vertices")
            e.write.mode("overwrite").parquet(f"{self.folder}/v{batch}/edges")
            gone = [f"d{n}" for n in at.get("merged", [])] + ([f"v{at['before']}"] if at.get("before") is not None else [])
            at = {"batch": batch, "base": batch, "deltas": [], "before": base, "merged": deltas}
        else:
            at = {**at, "batch": batch, "deltas": deltas}
        write_json(f"{self.folder}/current.json", at)
        for part in gone:
            remove_folder(f"{self.folder}/{part}")

    def reset(self, vertices: DataFrame, edges: DataFrame) -> None:
        """Full reingest: the state becomes this graph (VERTEX, EDGE), whatever was there. A snapshot without vertices is
        taken for a failed read and refused."""
        if vertices.isEmpty():
            raise ValueError("a snapshot without vertices can't replace the state")
        n = self.version() + 1
        vertices.write.mode("overwrite").parquet(f"{self.folder}/v{n}/vertices")
        edges.write.mode("overwrite").parquet(f"{self.folder}/v{n}/edges")
        write_json(f"{self.folder}/current.json", {"batch": n, "base": n, "deltas": []})


def affected_roots(changes: DataFrame, old_edges: DataFrame, new_edges: DataFrame, max_depth: int) -> DataFrame:
    """id of every vertex whose neighbourhood a batch may have changed: what it touched, and what lies around that in the
    old or the new graph, however many. A level is the distinct set of what the one before it touches, without its roots."""
    e = lambda c: F.transform(c, lambda x: F.array(x["sourceCid"], x["targetCid"]))
    ids = F.flatten(F.array(F.transform("addedVertices", lambda v: v["cid"]), F.col("removedVertexCids"), F.flatten(e(F.col("addedEdges"))), F.flatten(e(F.col("removedEdges")))))
    filled = changes.select(
        *[F.coalesce(F.col(c), F.array().cast(changes.schema[c].dataType)).alias(c) for c in ("addedVertices", "removedVertexCids", "addedEdges", "removedEdges")]
    )
    touched = filled.select(F.explode(ids).alias("id")).where(F.col("id").isNotNull()).distinct()
    both = adjacency(old_edges.unionByName(new_edges)).select(F.col("node").alias("id"), "nbr")
    seen = frontier = touched
    for depth in range(1, max_depth + 1):
        level = frontier.join(both, "id").select(F.col("nbr").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = stage(level, f"affected-{depth}") if depth < max_depth else level
        seen = seen.unionByName(frontier)
    return seen


def watch(
    stream: DataFrame,
    state: GraphState,
    checkpoint: str,
    deliver: Callable[[int, DataFrame, DataFrame, DataFrame], None] | None = None,
    max_depth: int = 2,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Applies the stream to the state, batch by batch; deliver(batch, vertices, edges, affected) gets the new graph and
    the ids whose documents may have changed, and must be idempotent as well, for it is called before the commit."""

    def batch(changes: DataFrame, n: int) -> None:
        if n <= state.version():
            return
        spark_changes = changes.where(F.col("namespace").isNotNull() | F.col("addedVertices").isNotNull() | F.col("removedVertexCids").isNotNull() | F.col("addedEdges").isNotNull() | F.col("removedEdges").isNotNull()).persist()
        try:
            _, e0 = state.tables()
            v1, e1 = state.prepare(n, spark_changes)
            if deliver is not None:
                deliver(n, v1, e1, affected_roots(spark_changes, e0, e1, max_depth))
            state.commit(n)
        finally:
            spark_changes.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def supervise(start: Callable[[], StreamingQuery], retries: int = 5, wait: float = 1.0) -> int:
    """Runs a stream to its end, starting it again from its checkpoint when it fails; returns how often that was needed.

    The state isn't touched in between. The failure is raised after `retries` starts in a row without progress.
    """
    failures, last, restarts = 0, -2, 0
    while True:
        q = start()
        try:
            q.awaitTermination()
            return restarts
        except StreamingQueryException:
            batch = (q.lastProgress or {}).get("batchId", -1)
            failures = 1 if batch > last else failures + 1
            last, restarts = max(last, batch), restarts + 1
            if failures > retries:
                raise
            time.sleep(wait)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and key with a watermark: the native operators, for streams and tables alike."""
    d = stream.withWatermark(at, late) if stream.isStreaming else stream
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return d.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
