"""Queries of the engine's own operators over the driver's tables, each with the same query as SQL.

A query is registered with @q(sql); sql None marks what SQL cannot express, which is tested against brute force instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.functions import embedding, identity, text
from plexora.functions import vectors as V
from plexora.functions.geo import latlon
from plexora.operators import analytics as A
from plexora.operators import discover, flow, graph, mapping, matching, quality, search, sets, spatial  # noqa: F401
from plexora.scale import shared_dir
from plexora.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- analytical axis --------------------------------------------------------------------------------------------------


@q("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def agg_group_measures(spark: SparkSession, d: str) -> DataFrame:
    """All measures at once."""
    m = {"n": "count", "total": "sum:o_totalprice", "mean": "avg:o_totalprice", "lo": "min:o_totalprice", "hi": "max:o_totalprice", "customers": "distinct:o_custkey"}
    out = A.aggregate(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], m)
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@q("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_discount <> 0.05 AND l_linestatus IN ('O', 'F') AND contains(l_returnflag, 'A') IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY l_returnflag")
def agg_where_ops(spark: SparkSession, d: str) -> DataFrame:
    """range, inequality, membership and presence, pushed to the scan."""
    c = {"l_quantity": {"gte": 10, "lt": "30"}, "l_discount": {"ne": 0.05}, "l_linestatus": {"in": ["O", "F"]}, "l_shipdate": {"exists": True}}
    return A.aggregate(table(spark, d, "lineitem"), "l_returnflag", {"n": "count", "qty": "sum:l_quantity"}, c)


@q("SELECT lang, count(*) AS n, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS sources, coalesce(sum(TRY_CAST(source AS DOUBLE)), 0) AS none_sum, avg(TRY_CAST(source AS DOUBLE)) AS none_avg FROM documents GROUP BY lang")
def agg_distinct_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Null keys are groups, sums of no number 0, averages of none null."""
    m = {"n": "count", "sources": "distinct:source", "none_sum": "sum:source", "none_avg": "avg:source"}
    return A.aggregate(table(spark, d, "documents"), "lang", m)


@q("SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY spent DESC, o_custkey LIMIT 20")
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    """Descending order by a measure, with a limit."""
    out = A.aggregate(table(spark, d, "orders"), "o_custkey", {"spent": "sum:o_totalprice", "n": "count"}, order_by="-spent", limit=20)
    return out.withColumn("spent", F.round("spent", 2))


@q("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND CAST(json_extract(props, '$.k') AS BIGINT) <> 60 GROUP BY ALL")
def json_props_filter(spark: SparkSession, d: str) -> DataFrame:
    """F1, F3 over a VARIANT of heterogeneous fields."""
    e = table(spark, d, "events").withColumn("fields", F.try_parse_json("props"))
    out = A.aggregate(e, ["event_type", "k"], {"n": "count", "total": "sum:value"}, {"k": {"gte": 50, "ne": 60}}, variant="fields")
    return out.select("event_type", F.col("k").cast("bigint").alias("k"), "n", F.round("total", 4).alias("total"))


@q("SELECT DISTINCT unnest(json_keys(fields)) AS field FROM bundle_points WHERE fields IS NOT NULL")
def describe_fields(spark: SparkSession, d: str) -> DataFrame:
    """A10: the vocabulary of field names."""
    return A.field_vocabulary(table(spark, d, "bundle_points").withColumn("v", F.try_parse_json("fields")), "v")


@q("SELECT source AS entity_type, count(*) AS count FROM documents GROUP BY source")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return A.type_counts(table(spark, d, "documents").withColumnRenamed("source", "entity_type"))


@q("SELECT DISTINCT 'types' AS facet, unnest(CAST(json_extract(payload, '$.types') AS VARCHAR[])) AS value FROM places_raw WHERE json_valid(payload)")
def facet_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Members of list-valued facets."""
    p = table(spark, d, "places_raw").where(F.try_parse_json("payload").isNotNull())
    return A.facet_vocabulary(p.select(F.from_json(F.get_json_object("payload", "$.types"), "array<string>").alias("types")), ["types"])


@q("SELECT rel, fromtype AS src_type, totype AS dst_type, count(*) AS count FROM localcore_links WHERE coalesce(rel, '') <> '' AND coalesce(fromtype, '') <> '' AND coalesce(totype, '') <> '' GROUP BY ALL")
def edge_shapes(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    e = table(spark, d, "localcore_links").select("rel", F.col("fromtype").alias("src_type"), F.col("totype").alias("dst_type"))
    return A.edge_shapes(e)


@q("SELECT DISTINCT rel FROM localcore_links WHERE rel IS NOT NULL")
def relation_vocab(spark: SparkSession, d: str) -> DataFrame:
    """G29, A10."""
    return A.relation_vocabulary(table(spark, d, "localcore_links"))


@q("SELECT c_custkey AS id, c_mktsegment AS entity_type, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def export_flat(spark: SparkSession, d: str) -> DataFrame:
    """Flat records of chosen fields."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id").withColumnRenamed("c_mktsegment", "entity_type")
    return A.export_rows(c, ["c_name", "c_acctbal"], {"c_acctbal": {"gt": 5000}}, "BUILDING")


@q("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Native event-time windows over a table."""
    from plexora.streaming.changes import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour", "10 minutes")


@q("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream that runs until its input is used up."""
    import uuid

    from plexora.streaming.changes import windowed_counts

    src = table(spark, d, "events")
    at = f"{shared_dir(spark)}/plexora-stream/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(stream, "ts", "event_type", "1 hour", "10 minutes")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")
    run = out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


# -- semantic axis ----------------------------------------------------------------------------------------------------

_QV = [math.sin(i + 1) for i in range(64)]
_QL = "[" + ",".join(repr(x) for x in _QV) + "]"
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({} AS DOUBLE[]))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


@q(f"SELECT vec_id AS id, round({_COS.format(_QL)}, 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    """W1, R18."""
    return search.top_k(_points(spark, d), _QV, 10)


@q(f"SELECT vec_id AS id, label, round({_COS.format(_QL)}, 6) AS score FROM embeddings WHERE label IN (1, 3) ORDER BY score DESC, id LIMIT 10")
def vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """the filter comes before the ranking."""
    return search.top_k(_points(spark, d).where(F.col("label").isin(1, 3)), _QV, 10, keep=["label"])


@q("WITH me AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, me WHERE vec_id <> 7 ORDER BY score DESC, id LIMIT 12")
def vec_recommend(spark: SparkSession, d: str) -> DataFrame:
    """W3, R2."""
    return search.recommend(_points(spark, d), 7, 12)


@q(f"SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QL} AS DOUBLE[])), 6) AS score FROM embeddings WHERE vec_id NOT IN (1, 2, 3) ORDER BY score DESC, id LIMIT 10")
def vec_dot_excluding(spark: SparkSession, d: str) -> DataFrame:
    """Another metric, and an exclusion set."""
    gone = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    return search.top_k(_points(spark, d), _QV, 10, distance="Dot", exclude=gone)


@q("SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0)) WHERE rank <= 5")
def vec_many_queries(spark: SparkSession, d: str) -> DataFrame:
    """W1 for a bounded set of queries: every id divisible by 100 against all vectors."""
    p = _points(spark, d)
    qs = p.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")
    return search.top_k_many(p, qs, 5)


@q("SELECT label, i - 1 AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def centroid_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors, position by position."""
    return mapping.mean_vectors(_points(spark, d), "label").withColumn("mean", F.round("mean", 6))


@q("SELECT vec_id AS id, round(list_dot_product(v[1:16], v[1:16]), 4) AS sq, round(v[1] / sqrt(list_dot_product(v[1:16], v[1:16])), 5) AS first FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x - list_avg(CAST(embedding AS DOUBLE[]))) / sqrt(list_var_pop(CAST(embedding AS DOUBLE[])) + 1e-5)) AS v FROM embeddings)")
def matryoshka_rows(spark: SparkSession, d: str) -> DataFrame:
    """Layer norm, cut, length one; shown by its first number, and the length before it."""
    e = _points(spark, d).withColumn("raw", F.slice(V.layer_norm(F.col("embedding")), 1, 16))
    raw = F.col("raw")
    return e.select("id", F.round(V.dot(raw, raw), 4).alias("sq"), F.round(F.get(V.matryoshka(F.col("embedding"), 16), F.lit(0)), 5).alias("first"))


@q("SELECT p_partkey AS id, p_name AS title, p_brand AS subtitle, CAST(CASE WHEN lower(p_brand) = 'brand#2' THEN 1000 WHEN starts_with(lower(p_brand), 'brand#2') THEN 400 WHEN contains(lower(p_brand), 'brand#2') THEN 220 ELSE 0 END + CASE WHEN lower(p_name) = 'brand#2' THEN 350 WHEN starts_with(lower(p_name), 'brand#2') THEN 160 WHEN contains(lower(p_name), 'brand#2') THEN 120 ELSE 0 END + 60.0 * (CASE WHEN contains(lower(p_brand) || ' ' || lower(p_name), 'brand#2') THEN 1 ELSE 0 END) + 12.0 * (CASE WHEN contains(lower(p_type), 'brand#2') THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM part WHERE contains(lower(p_brand || ' ' || p_name || p_type), 'brand#2') ORDER BY score DESC, lower(p_brand), lower(p_name), p_partkey LIMIT 25")
def lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    """W6, D5."""
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return search.lexical_rank(p, "Brand#2", 25, "p_name", "p_brand", "p_type")


@q("SELECT p_partkey AS id, (CASE WHEN lower(p_name) = 'small ring' THEN 100 WHEN starts_with(lower(p_name), 'small ring') THEN 50 WHEN contains(lower(p_name), 'small ring') THEN 25 ELSE 0 END + CASE WHEN contains(lower(p_type), 'small ring') THEN 10 ELSE 0 END) / CAST(100 AS DOUBLE) AS score FROM part WHERE contains(lower(p_name), 'small ring') OR contains(lower(p_type), 'small ring')")
def title_rank(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), search.title_score("Small Ring", F.col("p_name"), [F.col("p_type")]).alias("score"))
    return p.where(F.col("score") > 0)


@q("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 15 OFFSET 30")
def paged(spark: SparkSession, d: str) -> DataFrame:
    """A page in a total order."""
    return search.page(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 30, 15)


@q()
def session_rank(spark: SparkSession, d: str) -> DataFrame:
    """Likes and dislikes, the heading, and re-ranking with taste and avoidance."""
    p = _points(spark, d)
    pick = {i: search.vector_of(p, i) for i in (1, 2, 3, 4)}
    s = search.build_session([(pick[1], ["label 1"]), (pick[2], ["label 2"]), (pick[3], ["label 1"])], [(pick[4], ["label 4"])])
    c = p.withColumn("tags", F.array(F.concat(F.lit("label "), F.col("label").cast("string"))))
    c = c.withColumn("base_score", V.cosine(F.col("embedding"), V.literal(search.session_query(s) or [])))
    return search.rank_by_session(c.where(~F.col("id").isin(1, 2, 3, 4)), s, 8)


@q()
def map_points(spark: SparkSession, d: str) -> DataFrame:
    """Principal axes in one pass, scaled to a box."""
    return mapping.map_points(_points(spark, d))


@q()
def map_query_place(spark: SparkSession, d: str) -> DataFrame:
    """The place of a query on the map."""
    p = _points(spark, d)
    return mapping.place_query(p.join(mapping.map_points(p), "id"), _QV)


@q()
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document embedded in Arrow batches; shown by its length and first number."""
    e = embedding.embed_column(table(spark, d, "documents").select("doc_id", "text"), "text", embedding.HashEmbedder(64))
    return e.select("doc_id", F.round(V.norm(F.col("embedding")), 4).alias("length"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


# -- relational axis --------------------------------------------------------------------------------------------------


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    e = graph.key_links(o, F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), "placedBy", F.col("o_custkey"), "customer")
    c = table(spark, d, "customer")
    n = graph.key_links(c, F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), "locatedIn", F.col("c_nationkey"), "nation")
    return e.unionByName(n)


_EDGES = "SELECT 'order:' || o_orderkey AS src, 'placedBy' AS rel, 'customer:' || o_custkey AS dst FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'locatedIn', 'nation:' || c_nationkey FROM customer"


@q(_EDGES)
def keylink_edges(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys as typed edges."""
    return _order_edges(spark, d)


@q(f"WITH e AS ({_EDGES}) SELECT CASE WHEN src = 'customer:7' THEN 'out' ELSE 'in' END AS direction, rel, CASE WHEN src = 'customer:7' THEN dst ELSE src END AS other, n.n_name IS NOT NULL AS in_corpus, n.n_name AS title FROM e LEFT JOIN nation n ON 'nation:' || n.n_nationkey = CASE WHEN src = 'customer:7' THEN dst ELSE src END WHERE src = 'customer:7' OR dst = 'customer:7'")
def neighbors_out_in(spark: SparkSession, d: str) -> DataFrame:
    """Both directions, with the record where there is one."""
    e = _order_edges(spark, d).withColumn("seq", F.xxhash64("src", "rel", "dst"))
    r = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"))
    return graph.neighbors(e, r, "customer:7", limit=10_000).select("direction", "rel", "other", "in_corpus", "title")


@q("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def get_record(spark: SparkSession, d: str) -> DataFrame:
    """G11."""
    return graph.get(table(spark, d, "customer"), 42, "c_custkey").select("c_custkey", "c_name", "c_nationkey")


@q("SELECT root, list(label ORDER BY label)[1:3] AS labels FROM (SELECT DISTINCT 'supplier:' || s_suppkey AS root, r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY root")
def two_hop_fold(spark: SparkSession, d: str) -> DataFrame:
    """Labels two edges away, deduplicated and capped."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("dst"))
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("dst"))
    r = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label"))
    return graph.two_hop_fold(s.unionByName(n), r, 3)


@q("WITH RECURSIVE e AS (SELECT n_nationkey AS a, 100 + n_regionkey AS b FROM nation), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w AS (SELECT 1000 AS root, 1000 AS node, 0 AS depth WHERE false UNION ALL SELECT a, a, 0 FROM e UNION ALL SELECT w.root, u.b, w.depth + 1 FROM w JOIN u ON w.node = u.a WHERE w.depth < 2) SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node HAVING min(depth) > 0")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two steps of each nation, at their first visit."""
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"), F.col("n_nationkey").cast("bigint").alias("seq"))
    return graph.walk(e.select(F.col("src").alias("id")), graph.adjacency(e), 2, 1000).select("root", "node", "depth")


@q()
def project_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Regions with the names of what lies around them folded in."""
    node = lambda t, k, n, kind: table(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("entity_type"), F.col(n).alias("name"))
    nodes = node("region", "r_regionkey", "r_name", "Region").unionByName(node("nation", "n_nationkey", "n_name", "Nation")).unionByName(node("supplier", "s_suppkey", "s_name", "Supplier"))
    e1 = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("dst"), F.col("n_nationkey").cast("bigint").alias("seq"))
    e2 = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("dst"), (F.col("s_suppkey") + 1000).alias("seq"))
    out = graph.project(nodes, e1.unionByName(e2), graph.Profile("Region", label_cap=10))
    return out.select("root", F.to_json("folds").alias("folds"))


@q("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) AND l.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose every end is kept."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    p = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("id"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return graph.with_kept_ends(graph.with_kept_ends(li, p, ["src"]), s, ["dst"]).select("l_orderkey", "l_linenumber")


@q("SELECT linkid, from_id, to_id FROM localcore_links WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id NOT IN (SELECT record_id FROM tombstones) AND to_id NOT IN (SELECT record_id FROM tombstones)")
def anti_tombstone(spark: SparkSession, d: str) -> DataFrame:
    """Edges that touch nothing deleted."""
    e = table(spark, d, "localcore_links").where("from_id IS NOT NULL AND to_id IS NOT NULL").select("linkid", "from_id", "to_id")
    return graph.without(e, table(spark, d, "tombstones").select(F.col("record_id").alias("id")), ["from_id", "to_id"])


@q("SELECT src, dst, rn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <= 20)) WHERE rn <= 5")
def rownum_neighbor_cap(spark: SparkSession, d: str) -> DataFrame:
    """W10, G23."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.capped_neighbors(e, table(spark, d, "supplier").where("s_suppkey <= 20").select(F.col("s_suppkey").alias("id")), 5)


@q("SELECT src, dst, rn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier))) WHERE rn <= 5")
def neighbor_cap_all(spark: SparkSession, d: str) -> DataFrame:
    """rownum_neighbor_cap with every supplier as a seed."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.capped_neighbors(e, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), 5)


@q("WITH seeds AS (SELECT id FROM (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 4), near AS (SELECT dst AS id FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM (SELECT DISTINCT o_custkey AS src, 1000000 + o_orderkey AS dst FROM orders WHERE o_custkey IN (SELECT id FROM seeds))) WHERE rn <= 3) SELECT id, bool_or(s) AS is_seed FROM (SELECT id, true AS s FROM seeds UNION ALL SELECT id, false FROM near) GROUP BY id")
def subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Seeds by score and their first neighbours."""
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("entity_type"), "c_acctbal")
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000).alias("dst"))
    return graph.subgraph(n, e, F.col("c_acctbal"), 4, 3)


@q("SELECT parent, score, via FROM (SELECT parent, score, via, row_number() OVER (PARTITION BY parent ORDER BY score DESC, via) AS rn FROM (SELECT o_custkey AS parent, o_totalprice AS score, o_orderkey AS via FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))) WHERE rn = 1 ORDER BY score DESC, parent LIMIT 30")
def rollup_best_child(spark: SparkSession, d: str) -> DataFrame:
    """Hits of children as their parents, each with its best."""
    o = table(spark, d, "orders")
    hits = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return graph.roll_up(hits, o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent")), table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 30)


@q("SELECT 'nation:' || s_nationkey AS id, list(DISTINCT s_name ORDER BY s_name) AS titles FROM supplier GROUP BY s_nationkey")
def fold_titles(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct titles of what a parent points to."""
    s = table(spark, d, "supplier")
    e = s.select(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("src"), F.lit("hosts").alias("rel"), F.col("s_suppkey").alias("dst"))
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.fold_titles(n, e, s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")), "hosts")


@q()
def fused_entities(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the links between businesses."""
    e = table(spark, d, "localcore_links").where("rel = 'near'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return graph.components(e)


# -- sets -------------------------------------------------------------------------------------------------------------


@q("SELECT id, shard, entitytype FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shard DESC, entitytype DESC NULLS LAST) AS rn FROM (SELECT DISTINCT id, shard, entitytype FROM cdn_points)) WHERE rn = 1 AND id IS NOT NULL")
def last_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of each id the row of the latest shard."""
    p = table(spark, d, "cdn_points").where("id IS NOT NULL").select("id", "shard", "entitytype")
    return sets.last_wins(p, ["id"], ["shard", "entitytype"])


_SNAP = "SELECT track_id, max_by(sha256(fields), meta.version) AS h FROM bundle_points WHERE snapshot_no = {} GROUP BY track_id"


@q(f"WITH a AS ({_SNAP.format(4)}), b AS ({_SNAP.format(5)}) SELECT b.track_id, CASE WHEN a.track_id IS NULL THEN 'new' ELSE 'updated' END AS change FROM b LEFT JOIN a USING (track_id) WHERE a.track_id IS NULL OR a.h <> b.h")
def delta_new_updated(spark: SparkSession, d: str) -> DataFrame:
    """K6, K7: what a delta has to deliver, by digest."""
    b = table(spark, d, "bundle_points")
    snap = lambda n: b.where(F.col("snapshot_no") == n).groupBy("track_id").agg(F.max_by(F.sha2("fields", 256), "meta.version").alias("h"))
    return sets.delta(snap(4), snap(5), "track_id", "h")


@q("SELECT DISTINCT track_id FROM bundle_points WHERE snapshot_no = 4 AND track_id NOT IN (SELECT track_id FROM bundle_points WHERE snapshot_no = 5)")
def dropped_ids(spark: SparkSession, d: str) -> DataFrame:
    """U2, G25."""
    b = table(spark, d, "bundle_points")
    return sets.dropped(b.where("snapshot_no = 4"), b.where("snapshot_no = 5"), "track_id")


@q("SELECT id, shard FROM (SELECT DISTINCT id, shard FROM cdn_points WHERE shard <= 2) UNION ALL SELECT id, min(shard) FROM cdn_points WHERE shard > 2 AND id NOT IN (SELECT id FROM cdn_points WHERE shard <= 2) GROUP BY id")
def merge_keep_order(spark: SparkSession, d: str) -> DataFrame:
    """Old rows stay, the first of each new key is added."""
    p = table(spark, d, "cdn_points").select("id", "shard").distinct()
    return sets.merge_keep_order(p.where("shard <= 2"), p.where("shard > 2"), ["id"], "shard")


@q("WITH p AS (SELECT track_id AS content_id, min('v4/' || track_id) AS uri, min(meta.version) AS ordinal FROM bundle_points WHERE snapshot_no = 4 GROUP BY 1), c AS (SELECT track_id AS content_id, min('v5/' || track_id) AS uri, min(meta.version) AS ordinal FROM bundle_points WHERE snapshot_no = 5 GROUP BY 1) SELECT c.*, 'added' AS change FROM c ANTI JOIN p USING (content_id) UNION ALL SELECT p.*, 'removed' FROM p ANTI JOIN c USING (content_id)")
def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    """U4: what differs between two trees, by content."""
    b = table(spark, d, "bundle_points")
    tree = lambda n: b.where(F.col("snapshot_no") == n).select(F.col("track_id").alias("content_id"), F.concat(F.lit(f"v{n}/"), F.col("track_id")).alias("uri"), F.col("meta.version").alias("ordinal"))
    return sets.tree_diff(tree(4), tree(5))


@q("WITH o AS (SELECT place_id, min_by(query, fetched_at) AS query, bool_or(is_anchor) AS is_anchor, max(fetched_at) AS fetched_at FROM places_raw GROUP BY place_id) SELECT place_id, query, coalesce(is_anchor, false) AS is_anchor FROM o WHERE place_id IS NOT NULL")
def sticky_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first query stays, an anchor stays an anchor."""
    p = table(spark, d, "places_raw").where("place_id IS NOT NULL")
    first = p.groupBy("place_id").agg(F.min_by("query", "fetched_at").alias("query"), F.min_by("is_anchor", "fetched_at").alias("is_anchor"))
    rest = p.groupBy("place_id").agg(F.max_by("query", "fetched_at").alias("query"), F.max("is_anchor").alias("is_anchor"))
    return sets.sticky_upsert(first, rest, "place_id", keep_old=["query"], keep_true=["is_anchor"])


@q("SELECT vec_id AS track_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def shard_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Bake, append (which changes nothing), load; the same records come back."""
    import uuid

    from plexora.sources import shards

    root = f"{shared_dir(spark)}/plexora-bake/{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings")
    pts = e.select(F.col("vec_id").cast("string").alias("track_id"), F.to_json(F.struct(F.lit("Vector").alias("entityType"), "label")).alias("fields"), "embedding", F.lit("me").alias("owner"), F.lit(None).cast("string").alias("meta"), F.lit("Vector").alias("entity_type"))
    shards.bake(pts, root, "vectors", shard_size=200, dim=64, now=0)
    assert shards.append(pts, root, "vectors", now=0) is None
    back = shards.load(spark, root, "vectors")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return back.select(F.col("track_id").cast("bigint").alias("track_id"), F.get_json_object("fields", "$.label").cast("int").alias("label"), F.round(total, 4).alias("total"))


# -- places -----------------------------------------------------------------------------------------------------------

_LAT, _LON = 43.8, -97.2
_PLACE = "SELECT place_id AS id, arg_max(payload, fetched_at) AS payload FROM places_raw WHERE json_valid(payload) GROUP BY place_id"


def _places(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "places_raw").where(F.try_parse_json("payload").isNotNull()).groupBy(F.col("place_id").alias("id")).agg(F.max_by("payload", "fetched_at").alias("payload"))
    schema = "displayName struct<text: string>, location struct<latitude: double, longitude: double>, rating double, userRatingCount int, types array<string>, primaryType string"
    return p.select("id", F.from_json("payload", schema).alias("j")).select(
        "id", F.col("j.displayName.text").alias("title"), F.col("j.location.latitude").alias("lat"), F.col("j.location.longitude").alias("lon"),
        F.col("j.rating").alias("rating"), F.col("j.userRatingCount").alias("reviews"), F.col("j.types").alias("categories"), F.col("j.primaryType").alias("kind"),
    )


@q(f"WITH p AS ({_PLACE}), l AS (SELECT id, CAST(json_extract(payload, '$.location.latitude') AS DOUBLE) AS lat, CAST(json_extract(payload, '$.location.longitude') AS DOUBLE) AS lon FROM p) SELECT id, round(2 * 6371 * asin(sqrt(pow(sin(radians({_LAT} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({_LAT})) * pow(sin(radians({_LON} - lon) / 2), 2))), 6) AS km FROM l WHERE lat IS NOT NULL AND lon IS NOT NULL ORDER BY km, id LIMIT 25")
def geo_knn(spark: SparkSession, d: str) -> DataFrame:
    """W8, D18."""
    return search.near(_places(spark, d), _LAT, _LON, 25)


_RATE = f"WITH p AS ({_PLACE}), r AS (SELECT id, CAST(json_extract(payload, '$.rating') AS DOUBLE) AS r, CAST(json_extract(payload, '$.userRatingCount') AS DOUBLE) AS n FROM p), s AS (SELECT id, (n * r + 12 * 3.8) / (n + 12) AS shrunk, greatest(0, 1 - log10(greatest(n, 1)) / log10(1500)) AS o FROM r WHERE r <> 0 AND n <> 0), g AS (SELECT id, shrunk, o, round(greatest(0, least(1, shrunk - 4)) * o, 3) AS score FROM s)"


@q(_RATE + " SELECT id, score, CASE WHEN shrunk >= 4.5 AND o >= 0.3 AND score >= 0.2 THEN 'hidden-gem' WHEN shrunk >= 4.3 AND o <= 0.18 THEN 'crowd-favorite' END AS tier FROM g")
def gem_score(spark: SparkSession, d: str) -> DataFrame:
    """D20, D21."""
    return _places(spark, d).select("id", quality.rating_signal(F.col("rating"), F.col("reviews")).alias("s")).where("s IS NOT NULL").select("id", "s.score", "s.tier")


@q(f"WITH p AS ({_PLACE}) SELECT id FROM p WHERE CAST(json_extract(payload, '$.rating') AS DOUBLE) >= 4.3 AND list_has_any(CAST(json_extract(payload, '$.types') AS VARCHAR[]), ['bar', 'bakery'])")
def filtered_places(spark: SparkSession, d: str) -> DataFrame:
    """Structured filters; those without the field fail or pass as each filter says."""
    f = discover.Filters(rating_gte=4.3, categories=["bar", "bakery"], upcoming_only=True, free_only=True)
    p = _places(spark, d)
    return p.where(discover.matches(p, f, datetime(2025, 6, 1, 12))).select("id")


@q("SELECT mbid AS id, lat, lon FROM (SELECT mbid, TRY_CAST(split_part(coordinates, ',', 1) AS DOUBLE) AS lat, TRY_CAST(split_part(coordinates, ',', 2) AS DOUBLE) AS lon FROM (SELECT DISTINCT mbid, coordinates FROM mb_places) WHERE regexp_full_match(coordinates, '-?[0-9.]+,-?[0-9.]+')) WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)")
def parsed_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """D19 on the plain notation."""
    m = table(spark, d, "mb_places").select("mbid", "coordinates").distinct().where(F.col("coordinates").rlike(r"^-?[0-9.]+,-?[0-9.]+$"))
    return m.select(F.col("mbid").alias("id"), latlon(F.col("coordinates")).alias("p")).where("p IS NOT NULL").select("id", "p.lat", "p.lon")


@q()
def parsed_coordinates_all(spark: SparkSession, d: str) -> DataFrame:
    """D19 on every notation."""
    m = table(spark, d, "mb_places").select("mbid", "coordinates").distinct()
    return m.select(F.col("mbid").alias("id"), latlon(F.col("coordinates")).alias("p")).where("p IS NOT NULL").select("id", "p.lat", "p.lon")


@q()
def sameas_links(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy one-to-one links between businesses and music places."""
    m = spatial.located(table(spark, d, "mb_places"), "mbid").groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.*")
    m = m.join(table(spark, d, "mb_places").groupBy(F.col("mbid").alias("id")).agg(F.min("title").alias("name")), "id")
    p = _places(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", F.col("title").alias("name"))
    return matching.same_as_links(p, m, "gplace", "mb")


@q()
def place_shelves(spark: SparkSession, d: str) -> DataFrame:
    """Places snapped to city centroids, shelved by city."""
    p = _places(spark, d)
    t = p.select("id", F.when(F.col("rating") > 4.5, text.city(F.split("title", " ")[0])).alias("city"), "lat", "lon")
    return quality.shelves(matching.snap_to_centroids(t), "city")


@q(f"WITH p AS ({_PLACE}), w AS (SELECT id, json_extract_string(payload, '$.primaryType') AS kind, coalesce(CAST(json_extract(payload, '$.rating') AS DOUBLE), 0) * log10(coalesce(CAST(json_extract(payload, '$.userRatingCount') AS DOUBLE), 0) + 10) AS weight, CAST(json_extract(payload, '$.location.longitude') AS DOUBLE) AS x FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, id) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY x NULLS FIRST, id) AS place FROM w) SELECT kind, id, CASE WHEN i = 0 THEN 'hero' WHEN i <= 2 THEN 'lg' WHEN i >= n * 0.65 THEN 'sm' ELSE 'md' END AS size, place FROM n")
def tile_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes by rank of weight, places by x."""
    p = _places(spark, d)
    p = p.withColumn("weight", quality.weight(F.lit("Business"), F.col("rating"), F.col("reviews"), F.lit(False), F.lit(None).cast("string")))
    return quality.tile_sizes(p, "kind", "weight", "lon")


# -- quality and flow -------------------------------------------------------------------------------------------------

_TIER = "CASE WHEN o_totalprice >= 250000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'mid' WHEN o_totalprice >= 100000 THEN 'low' ELSE 'reject' END"


@q(f"SELECT tier, count(*) AS n FROM (SELECT {_TIER} AS tier FROM orders) GROUP BY tier")
def tier_classify(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by listens, status and votes; orders stand in for tracks."""
    o = table(spark, d, "orders")
    t = quality.track_tier(F.when(F.col("o_totalprice") >= 250000, F.col("o_totalprice")), F.when(F.col("o_totalprice") >= 100000, 1), F.lit(None).cast("string"), F.when(F.col("o_orderstatus") == "F", "official"))
    return o.select(t.alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@q(f"WITH t AS (SELECT o_orderkey AS id, o_custkey AS artist, CAST(o_totalprice AS BIGINT) AS popularity, {_TIER} AS tier, o_orderkey AS ordinal FROM orders), k AS (SELECT *, CASE tier WHEN 'high' THEN 1 WHEN 'mid' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM t), a AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY r, ordinal) AS rn FROM k), b AS (SELECT *, row_number() OVER (ORDER BY r, ordinal, id) AS place FROM a WHERE popularity >= 400000 OR rn <= 2) SELECT id, tier, place FROM b WHERE place > 100 AND place <= 200")
def tiered_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The second part of a hundred, tier by tier, with a cap per artist."""
    o = table(spark, d, "orders")
    tier = F.when(F.col("o_totalprice") >= 250000, "high").when(F.col("o_orderstatus") == "F", "mid").when(F.col("o_totalprice") >= 100000, "low").otherwise("reject")
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("artist"), F.round("o_totalprice").cast("bigint").alias("popularity"), tier.alias("tier"), F.col("o_orderkey").alias("ordinal"))
    return quality.assemble(t, 100, 2, 2, marquee=400_000).select("id", "tier", "place")


_FLOW = """
WITH t AS (SELECT event_type AS k, abs(value) AS v, 'u' || user_id AS s, 'u' || (event_id % 50) AS d, epoch_ms(ts) / 1000.0 AS ts FROM events),
legs AS (SELECT k, s AS w, -v AS x, 1 AS o FROM t UNION ALL SELECT k, d, v, 0 FROM t),
w AS (SELECT k, w, sum(x) AS c, sum(CASE WHEN o = 1 THEN -x END) AS sent, max(o) AS sends, max(1 - o) AS gets FROM legs GROUP BY k, w),
b AS (SELECT k, sum(abs(c)) / 2 AS net, sum(sends) AS senders, sum(gets) AS receivers, count(*) AS counterparties, sum(sent) AS alls, sum(sent * sent) AS sq FROM w GROUP BY k),
g AS (SELECT k, count(*) AS n, sum(v) AS gross FROM t GROUP BY k)
SELECT k AS symbol, n AS sample_size, round(greatest(0, least(1, 1 - net / gross)), 4) AS circularity, senders, receivers, counterparties, round(sq / (alls * alls), 4) AS sender_hhi FROM g JOIN b USING (k)
"""


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), "value", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")).alias("dst"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("ts"), F.col("event_id").alias("id"),
    )


@q(_FLOW)
def flow_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Circularity and concentration; events stand in for transfers."""
    m = flow.flow_metrics(_transfers(spark, d))
    return m.select("symbol", "sample_size", "circularity", "senders", "receivers", "counterparties", "sender_hhi")


@q("WITH t AS (SELECT event_type AS symbol, epoch_ms(ts) / 1000.0 AS ts FROM events), g AS (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM t) SELECT symbol, round(stddev_pop(gap) / avg(gap), 4) AS interarrival_cv FROM g GROUP BY symbol")
def interarrival_cv(spark: SparkSession, d: str) -> DataFrame:
    """W14, A14."""
    return flow.flow_metrics(_transfers(spark, d)).select("symbol", "interarrival_cv")


@q("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN a < 3600 THEN '<1h' WHEN a < 86400 THEN '1-24h' WHEN a < 604800 THEN '1-7d' ELSE '>7d' END AS bucket FROM (SELECT 1706745600 - CAST(floor(epoch_ms(ts) / 1000.0) AS BIGINT) AS a FROM events)) GROUP BY bucket")
def age_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Ages against a given clock."""
    e = table(spark, d, "events").select(flow.age_bucket(1706745600, F.unix_seconds(F.col("ts").cast("timestamp"))).alias("bucket"))
    return e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT symbol, id, value, rank FROM (SELECT event_type AS symbol, event_id AS id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def largest_transfers(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    return flow.largest(_transfers(spark, d), "symbol", 10).select("symbol", "id", "value", "rank")


@q("SELECT c_nationkey AS k, count(*) AS active_holders, false AS lower_bound, round(greatest(0, 1 - count(*) / 100.0), 4) AS dust_share, round(max(b) / sum(b), 4) AS top_share FROM (SELECT c_nationkey, c_acctbal AS b FROM customer WHERE c_acctbal > 0) GROUP BY c_nationkey")
def holder_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b"), F.lit(100).alias("h"), F.lit(True).alias("c"))
    return flow.holder_metrics(c, "k", "b", "h", "c")


@q("SELECT p_brand AS k, list(t ORDER BY v DESC, t) AS tags FROM (SELECT p_brand, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS t, sum(p_size) AS v FROM part GROUP BY ALL HAVING sum(p_size) >= 100) GROUP BY p_brand")
def tag_votes(spark: SparkSession, d: str) -> DataFrame:
    """A18, A20."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_type").alias("n"), F.col("p_size").alias("v"))
    return quality.tag_votes(p, "k", "n", "v", 100)


# -- texts and ids ----------------------------------------------------------------------------------------------------


@q("SELECT p_partkey AS id, 'search_document: ' || substr('Title: ' || p_name || '. Tags: ' || p_type || '. Subtitle: ' || p_brand || '. size ' || p_size, 1, 1000) AS doc FROM part")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """D1-D4, D14."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), text.document_text(F.col("p_name"), F.col("p_type"), F.col("p_brand"), [F.concat(F.lit("size "), F.col("p_size").cast("string"))]).alias("doc"))


@q("SELECT p_partkey AS id, p_name || ' — ' || coalesce(p_type, 'part') || ' by ' || p_brand || '. Tags: ' || p_type AS doc FROM part")
def node_texts(spark: SparkSession, d: str) -> DataFrame:
    """D24."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), text.node_text(F.col("p_name"), " — ", F.col("p_type"), "part", text.part(" by ", F.col("p_brand")), tags=F.array("p_type")).alias("doc"))


@q("SELECT c_custkey AS id, substr(sha256(lower(c_mktsegment || ':' || c_name)), 1, 24) AS tid FROM customer")
def artist_title_ids(spark: SparkSession, d: str) -> DataFrame:
    """D16, D17."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), identity.artist_title_id(F.col("c_mktsegment"), F.col("c_name")).alias("tid"))


@q()
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based UUIDs."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), identity.uuid5(F.col("c_name")).alias("point_id"))


@q("SELECT s_suppkey AS id, CASE WHEN s_acctbal = 0 THEN '$0' WHEN abs(s_acctbal) < 0.01 THEN '<$0.01' WHEN abs(s_acctbal) >= 1000 THEN '$' || format('{:,.0f}', s_acctbal) ELSE '$' || format('{:,.2f}', s_acctbal) END AS usd FROM supplier")
def formatted_usd(spark: SparkSession, d: str) -> DataFrame:
    """D26, R14."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.usd(F.col("s_acctbal")).alias("usd"))


@q("SELECT n_nationkey AS id, n_name AS name, r_name AS area FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def companion_joins(spark: SparkSession, d: str) -> DataFrame:
    """Base tables with their companions; those that don't exist are left out."""
    from plexora.sources.readers import with_companions

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("area"))
    return with_companions(n, {"area": r, "rating": None}, "k").drop("k")


@q("SELECT l_suppkey AS seed, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def degree(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids and their frequency."""
    return graph.degrees(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seed"), "l_partkey"), "seed", "l_partkey")


@q("SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS place, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 500) AS BIGINT) AS shard FROM orders")
def rolled_shards(spark: SparkSession, d: str) -> DataFrame:
    """Rows rolled into parts of a fixed size within each group."""
    return quality.roll(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", ["o_orderkey"], 500)
