"""Readers of staged nodes, imports, raw caches and namespaces, plug-in sources, and the adaptive tile sweep."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from importlib.metadata import entry_points
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.sources.shards import ROW, parse_row


def parse_sources(specs: Iterable[str]) -> list[tuple[str, str]]:
    """OWNER:NAMESPACE pairs, split at the first colon; a blank half raises."""
    out = []
    for s in specs:
        owner, _, space = s.partition(":")
        if not owner.strip() or not space.strip():
            raise ValueError(f"source {s!r} must be OWNER:NAMESPACE")
        out.append((owner.strip(), space.strip()))
    return out


def node_list(spark: SparkSession, path: str) -> DataFrame:
    """name, fields (JSON), file of staged node files: JSON arrays of {name, fields}; unreadable files give no rows."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("value"), F.input_file_name().alias("file"))
    nodes = F.from_json("value", "array<struct<name: string, fields: string>>", {"mode": "PERMISSIVE"})
    return raw.select("file", F.explode(nodes).alias("n")).select("n.name", "n.fields", "file").where(F.col("name").isNotNull() | F.col("fields").isNotNull())


def staged_volume(spark: SparkSession, folder: str, volume: int, stems: Mapping[str, str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Nodes of volume_<n>_<stem>.json with their entity type: that of the stem, or the stem in title case; edge files are
    left out, and nodes without a name."""
    n = node_list(spark, f"{folder}/volume_{volume}_*.json")
    stem = F.regexp_extract("file", r"volume_\d+_([^/]+)\.json$", 1)
    known = F.create_map(*[F.lit(x) for kv in (stems or {"": ""}).items() for x in kv])
    own = F.get_json_object("fields", "$.entityType")
    n = n.withColumn("stem", stem).where(~F.col("stem").contains("edges") & F.col("name").isNotNull())
    n = n.withColumn("entity_type", F.coalesce(own, known[F.col("stem")], F.initcap(F.regexp_replace("stem", "_", " ")))).drop("file")
    return n.where(F.col("entity_type").isin(*types)) if types else n


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of line-JSON imports that have an id and a vector; bad lines are skipped, lines are framed by the reader."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for r in map(parse_row, pdf["value"]) if r is not None and r[2]]
            yield pd.DataFrame(rows, columns=["track_id", "fields", "embedding", "owner", "meta"])

    return spark.read.text(path).mapInPandas(work, ROW)


def namespace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (cid, schema_id, payload) and edges (src, rel, dst, seq) of a snapshot document {vertices, edges}."""
    schema = "vertices array<struct<cid: string, schemaId: string, payload: string>>, edges array<struct<sourceCid: string, relation: string, targetCid: string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    v = doc.select(F.explode("vertices").alias("v")).select("v.cid", F.col("v.schemaId").alias("schema_id"), "v.payload")
    e = doc.select(F.posexplode("edges").alias("seq", "e"))
    return v, e.select(F.col("e.sourceCid").alias("src"), F.col("e.relation").alias("rel"), F.col("e.targetCid").alias("dst"), F.col("seq").cast("bigint").alias("seq"))


def seedable(vertices: int, head: str | None) -> bool:
    """Whether a snapshot may seed a watcher: one without a head and without vertices is a failed read, not an empty world."""
    return not (head is None and vertices == 0)


def jdbc(spark: SparkSession, url: str, query: str, fetch: int = 5000, **options: str) -> DataFrame:
    """A query over JDBC with a server-side cursor; credentials come from the options only."""
    return spark.read.format("jdbc").option("url", url).option("query", query).option("fetchsize", fetch).options(**options).load()


def with_companions(base: DataFrame, companions: Mapping[str, DataFrame | None], key: str) -> DataFrame:
    """The base table with the companion tables that exist, each joined on the key."""
    for t in companions.values():
        if t is not None:
            base = base.join(t, key, "left")
    return base


def link_tables(exists: Callable[[str], bool], entities: Sequence[str]) -> list[str]:
    """Names l_<a>_<b> of the relationship tables that exist, of each ordered pair of entities."""
    return [t for a in entities for b in entities if exists(t := f"l_{a}_{b}")]


def releases(raw: DataFrame) -> DataFrame:
    """release, medium, track, recording and tags of nested release documents (`value`: one JSON text per row).

    Tags fall back from the recording to the release to the release group.
    """
    tag = "array<struct<name: string, count: int>>"
    schema = f"id string, title string, genres {tag}, `release-group` struct<genres: {tag}>, media array<struct<position: int, tracks: array<struct<id: string, title: string, recording: struct<id: string, genres: {tag}>>>>>"
    j = raw.select(F.from_json("value", schema).alias("r")).select("r.*").where(F.col("id").isNotNull())
    m = j.select(F.col("id").alias("release"), F.col("genres").alias("g"), F.col("`release-group`.genres").alias("gg"), F.explode_outer("media").alias("m"))
    t = m.select("release", "g", "gg", F.col("m.position").alias("medium"), F.explode_outer("m.tracks").alias("t"))
    some = lambda c: F.when(F.size(c) > 0, c)
    return t.select("release", "medium", F.col("t.id").alias("track"), F.col("t.title").alias("title"), F.col("t.recording.id").alias("recording"), F.coalesce(some(F.col("t.recording.genres")), some(F.col("g")), some(F.col("gg"))).alias("tags"))


def classify_tags(tags, vocabularies: Mapping[str, Sequence[str]]):
    """struct of one array per vocabulary: the tags that it holds, in their order, each once."""
    low = F.array_distinct(F.transform(tags, lambda t: F.lower(F.trim(t))))
    return F.struct(*[F.array_intersect(low, F.array(*[F.lit(w) for w in v])).alias(k) for k, v in vocabularies.items()])


# -- plug-in sources --------------------------------------------------------------------------------------------------


@runtime_checkable
class Source(Protocol):
    """A source of events: read them past a cursor, shape them, and tell the next cursor."""

    name: str

    def read(self, spark: SparkSession, cursor: int, **options: Any) -> DataFrame: ...

    def build_graph(self, records: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    def next_cursor(self, records: DataFrame, cursor: int) -> int: ...


_BUILT_IN: dict[str, Source] = {}


def register(source: Source) -> None:
    _BUILT_IN[source.name] = source


def discover(group: str = "plexora.sources") -> dict[str, Source]:
    """Built-in sources and those of installed packages, which take precedence; one that can't be loaded is skipped."""
    out = dict(_BUILT_IN)
    for e in entry_points(group=group):
        try:
            out[e.name] = e.load()()
        except Exception:  # noqa: BLE001 - a broken plug-in must not take the others down
            continue
    return out


def past_cursor(records: DataFrame, cursor: int, block: str = "block", kind: str = "type", always: Sequence[str] = ("asset",)) -> DataFrame:
    """Records above the cursor, and those of kinds that are always read."""
    return records.where(F.col(kind).isin(*always) | (F.col(block) > cursor))


def next_cursor(records: DataFrame, cursor: int, block: str = "block") -> int:
    """The highest block, never below the cursor."""
    r = records.agg(F.max(block)).first()
    return max(cursor, int(r[0] or 0))


def load_state(path: str) -> dict[str, Any]:
    """A checkpoint's JSON object; {} if it is missing or can't be read."""
    try:
        with open(path) as f:
            v = json.load(f)
    except (OSError, ValueError):
        return {}
    return v if isinstance(v, dict) else {}


def save_state(path: str, **values: Any) -> None:
    """Merges values into a checkpoint, written aside and moved into place."""
    v = {**load_state(path), **values}
    with open(path + ".tmp", "w") as f:
        json.dump(v, f)
    os.replace(path + ".tmp", path)


# -- adaptive sweep ---------------------------------------------------------------------------------------------------


def offset(lat: float, lon: float, north_m: float, east_m: float) -> tuple[float, float]:
    """A place some metres to the north and east of another."""
    return lat + north_m / 111_320, lon + east_m / (111_320 * max(1e-6, math.cos(math.radians(lat))))


def sweep(fetch: Callable[[float, float, float], Sequence[Mapping[str, Any]]], lat: float, lon: float, radius: float, least: float = 200.0, full: int = 20, most_tiles: int = 200) -> dict[str, Mapping[str, Any]]:
    """Everything that a capped nearby search can find, by id: a tile that comes back full is cut into four circles of
    three quarters of the radius, half a radius off; it ends at the least radius or the most tiles."""
    found: dict[str, Mapping[str, Any]] = {}
    queue, tiles = [(lat, lon, radius)], 0
    while queue and tiles < most_tiles:
        a, o, r = queue.pop(0)
        hits = fetch(a, o, r)
        tiles += 1
        for h in hits:
            found.setdefault(str(h["id"]), h)
        if len(hits) >= full and r * 0.75 >= least:
            queue += [(*offset(a, o, i * r / 2, j * r / 2), r * 0.75) for i in (-1, 1) for j in (-1, 1)]
    return found
