"""The relational axis: typed edges, neighbours, bounded projection of roots, folds and connected components."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.scale import stage

# -- edges ------------------------------------------------------------------------------------------------------------


def adjacency(edges: DataFrame) -> DataFrame:
    """node, nbr, seq: both directions of each edge (src, dst, seq); duplicates stay, and the order of the list is kept."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), (2 * F.col("seq")).alias("seq")).unionByName(
        e.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), (2 * F.col("seq") + 1).alias("seq"))
    )


def neighbors(edges: DataFrame, records: DataFrame, node: object, rel: str | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
    """rel, direction, other, in_corpus and the record's columns of one node's edges, in the order of the edge list.

    A self-loop is given once, as an out-edge where these are asked for. Endpoints without a record have only their id.
    A limit of 0 or less gives no rows. records: id and any other columns.
    """
    out = (F.col("src") == F.lit(node)) if direction in ("out", "both") else F.lit(False)
    into = (F.col("dst") == F.lit(node)) if direction in ("in", "both") else F.lit(False)
    e = edges.where(out | into)
    if rel is not None:
        e = e.where(F.col("rel") == rel)
    e = e.select(
        "seq", "rel", F.when(out, "out").otherwise("in").alias("direction"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other")
    )
    e = e.orderBy("seq").limit(max(0, limit))
    r = records.withColumnRenamed("id", "other").withColumn("in_corpus", F.lit(True))
    return e.join(r, "other", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False))).orderBy("seq")


def get(records: DataFrame, node: object, id_col: str = "id") -> DataFrame:
    """One record by its id; no row if it isn't there."""
    return records.where(F.col(id_col) == F.lit(node))


def key_links(rows: DataFrame, src: Column, rel: str, foreign_key: Column, namespace: str) -> DataFrame:
    """Edges from a foreign key: src, rel, dst = namespace:key. Rows whose key is null or empty give none."""
    if rel == "sameAs":
        raise ValueError("sameAs fuses entities; a foreign key relates them")
    fk = foreign_key.cast("string")
    e = rows.select(src.cast("string").alias("src"), F.lit(rel).alias("rel"), F.concat(F.lit(namespace + ":"), fk).alias("dst"), fk.alias("__fk"))
    return e.where(F.col("src").isNotNull() & F.col("__fk").isNotNull() & (F.col("__fk") != "")).drop("__fk")


def with_kept_ends(edges: DataFrame, kept: DataFrame, columns: Sequence[str] = ("src", "dst"), key: str = "id") -> DataFrame:
    """Rows all of whose end columns are kept ids: a semi-join per column."""
    k = kept.select(F.col(key)).distinct()
    for c in columns:
        edges = edges.join(k.select(F.col(key).alias(c)), c, "left_semi")
    return edges


def without(rows: DataFrame, gone: DataFrame, columns: Sequence[str] = ("id",), key: str = "id") -> DataFrame:
    """Rows none of whose columns is a gone id: an anti-join per column (tombstones, dropped ids)."""
    g = gone.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    for c in columns:
        rows = rows.join(g.select(F.col(key).alias(c)), c, "left_anti")
    return rows


# -- projection -------------------------------------------------------------------------------------------------------


def walk(roots: DataFrame, adj: DataFrame, max_depth: int = 2, node_cap: int = 1000) -> DataFrame:
    """root, node, depth, rank: the nodes around each root by breadth-first search, the root left out.

    The order is that of a queue: by depth, then by the parent's place, then by edge order, each node at its first visit.
    The walk of a root ends when node_cap nodes are collected (at least one). Every level is one join of the frontier with
    the adjacency; the cap cuts frontiers before they grow, so a hub can't blow a level up beyond node_cap * degree.
    """
    cap = max(1, node_cap)
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("rank"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = (
            frontier.select("root", F.col("node"), F.col("rank").alias("prank"))
            .join(adj, "node")
            .groupBy("root", F.col("nbr").alias("node"))
            .agg(F.min(F.struct("prank", "seq")).alias("first"))
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
        )
        base = seen.groupBy("root").agg(F.max("rank").alias("base"))
        w = Window.partitionBy("root").orderBy("first", "node")
        level = (
            step.withColumn("rn", F.row_number().over(w))
            .join(base, "root")
            .select("root", "node", F.lit(depth).alias("depth"), (F.col("base") + F.col("rn")).alias("rank"))
            .where(F.col("rank") <= cap)
        )
        frontier = stage(level, f"walk-{depth}") if depth < max_depth else level
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0)


def group_key(entity_type: Column) -> Column:
    """Name of the list that a type folds into: first letter lower, English plural."""
    low = F.concat(F.lower(F.substring(entity_type, 1, 1)), F.regexp_replace(entity_type, "^.", ""))
    return (
        F.when(low.rlike("y$"), F.regexp_replace(low, "y$", "ies"))
        .when(low.rlike("(s|x|z|ch|sh)$"), F.concat(low, F.lit("es")))
        .otherwise(F.concat(low, F.lit("s")))
    )


@dataclass
class Profile:
    """What to project: roots of a type, the types that fold in, and which fields give a neighbour's content."""

    root: str
    include: Sequence[str] = ()
    content_fields: Sequence[str] = field(default_factory=tuple)
    max_depth: int = 2
    label_cap: int = 50
    node_cap: int = 1000


def load_profiles(text: str) -> dict[str, Profile]:
    """Profiles by name of a JSON object {name: {root, include, content_fields, max_depth, label_cap, node_cap}}; the name
    is the root's type where none is given. Unknown keys raise."""
    return {name: Profile(**{"root": name, **spec}) for name, spec in json.loads(text).items()}


#: Most types that get a profile each.
MAX_TYPES = 10_000
#: Fields that give a node's text, after a profile's own, and then those that give its label.
CONTENT_FIELDS = ("body", "summary", "description")
LABEL_FIELDS = ("title", "name", "label")


def node_content(df: DataFrame, first: Sequence[str] = ()) -> Column:
    """The first non-blank text among the content fields, else the label fields; null if there is none."""
    cols = [c for c in (*first, *CONTENT_FIELDS, *LABEL_FIELDS) if c in df.columns and df.schema[c].dataType.typeName() == "string"]
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in cols], F.lit(None).cast("string"))


def profiles_of(nodes: DataFrame, named: Mapping[str, Profile] | None = None, wanted: Sequence[str] = ()) -> list[Profile]:
    """Profiles by name (whatever the case) or by literal type; none wanted: one for each type there is, in order."""
    named = {k.casefold(): v for k, v in (named or {}).items()}
    if not wanted:
        types = nodes.where(F.col("entity_type").isNotNull()).select("entity_type").distinct().limit(MAX_TYPES + 1).collect()
        if len(types) > MAX_TYPES:
            raise ValueError(f"more than {MAX_TYPES} types: name the profiles that are wanted")
        wanted = sorted(r[0] for r in types)
    return [named.get(w.casefold(), Profile(w)) for w in wanted]


def project(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """root, folds: for each root of the profile's type a map from group key to the contents of its neighbourhood.

    Contents of a group are deduplicated in the order of the walk and then cut to label_cap. nodes: id, entity_type and
    text fields; edges: src, dst, seq. The list of included types filters what is folded, not what is walked through.
    """
    roots = nodes.where(F.col("entity_type") == profile.root).select("id")
    visited = walk(roots, adjacency(edges), profile.max_depth, profile.node_cap)
    info = nodes.select(F.col("id").alias("node"), F.col("entity_type").alias("__t"), node_content(nodes, profile.content_fields).alias("content"))
    seen = visited.join(info, "node").where(F.col("content").isNotNull())
    if profile.include:
        seen = seen.where(F.col("__t").isin(*profile.include))
    one = seen.withColumn("grp", group_key(F.col("__t"))).groupBy("root", "grp", "content").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("root", "grp").orderBy("rank", "content")
    one = one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= profile.label_cap)
    lists = one.groupBy("root", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "content"))), lambda s: s["content"]).alias("labels"))
    folds = lists.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "labels")))).alias("folds"))
    empty = F.create_map().cast("map<string,array<string>>")
    return roots.select(F.col("id").alias("root")).join(folds, "root", "left").withColumn("folds", F.coalesce("folds", empty))


def two_hop_fold(edges: DataFrame, labels: DataFrame, cap: int) -> DataFrame:
    """root, labels: distinct labels two edges away, in order, at most cap of each root."""
    hop = edges.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("root"), F.col("b.dst").alias("id"))
    one = hop.distinct().join(labels, "id").select("root", "label").distinct()
    w = Window.partitionBy("root").orderBy("label")
    one = one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    return one.groupBy("root").agg(F.array_sort(F.collect_list("label")).alias("labels"))


# -- folds and lookups over one edge kind -----------------------------------------------------------------------------


def roll_up(hits: DataFrame, child_to_parent: DataFrame, parents: DataFrame, limit: int) -> DataFrame:
    """parent, score, via: ranked hits of parents and children as parents, each with its best hit.

    hits: id, score; child_to_parent: id, parent; parents: id. Children without a parent, or whose parent isn't there,
    are dropped. Of equal scores the smaller id counts.
    """
    up = hits.join(child_to_parent, "id", "left").select(F.coalesce("parent", "id").alias("parent"), "score", F.col("id").alias("via"))
    up = up.join(parents.select(F.col("id").alias("parent")), "parent", "left_semi")
    w = Window.partitionBy("parent").orderBy(F.desc("score"), "via")
    best = up.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")
    return best.orderBy(F.desc("score"), "parent").limit(limit)


def fold_titles(parents: DataFrame, edges: DataFrame, titles: DataFrame, rel: str) -> DataFrame:
    """id, titles: sorted distinct titles of what each parent points to by a relation; only parents that are there."""
    e = edges.where(F.col("rel") == rel).join(titles.select(F.col("id").alias("dst"), "title"), "dst").where(F.col("title").isNotNull())
    g = e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("title")).alias("titles"))
    return parents.select("id").join(g, "id")


def capped_neighbors(edges: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """src, dst of each seed's first `cap` neighbours by id; the cap is a window limit, applied before the shuffle too."""
    e = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    w = Window.partitionBy("src").orderBy("dst")
    return e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)


def degrees(edges: DataFrame, node: str = "src", other: str = "dst") -> DataFrame:
    """node, n: how many different others each node has an edge to."""
    return edges.where(F.col(node).isNotNull()).groupBy(node).agg(F.count_distinct(other).alias("n"))


def seed_counts(nodes: DataFrame, score: Column, least: float, targets: Mapping[str, int]) -> DataFrame:
    """entity_type, passing, seeds: how many nodes of each type score at least `least`, and how many of them would be
    seeds, at most the type's target (0 or none: all)."""
    passing = nodes.groupBy("entity_type").agg(F.sum(F.when(score >= least, 1).otherwise(0)).alias("passing"))
    target = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("entity_type")] if targets else F.lit(None).cast("int")
    return passing.select("entity_type", "passing", F.when(target > 0, F.least("passing", target)).otherwise(F.col("passing")).alias("seeds"))


def subgraph(nodes: DataFrame, edges: DataFrame, score: Column, per_type: int, cap: int) -> DataFrame:
    """id, is_seed: the best nodes of each type by score, and their first neighbours."""
    w = Window.partitionBy("entity_type").orderBy(F.desc("__s"), "id")
    seeds = nodes.withColumn("__s", score).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_type).select("id")
    near = capped_neighbors(edges, seeds, cap).select(F.col("dst").alias("id"))
    both = seeds.withColumn("is_seed", F.lit(True)).unionByName(near.withColumn("is_seed", F.lit(False)))
    return both.groupBy("id").agg(F.max("is_seed").alias("is_seed"))


def components(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """id, component: connected components of undirected edges (src, dst), named by their smallest id.

    Alternates between linking every node's larger neighbours to its smallest one and the other way round (large star and
    small star), which needs a number of rounds that grows with the logarithm of the size. All data stays in DataFrames;
    each round's edges are written to the shared folder. A node in no edge has no row.
    """
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    loops = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    e = stage(e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        e = stage(small.where(F.col("u") != F.col("v")).distinct(), "components")
        sign = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    named = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return loops.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
