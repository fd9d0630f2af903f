"""Further queries of the engine's own operators, each with the same query as SQL: results' shapes, texts, sources and
sinks, deltas of stores and streams, sets and lists."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.functions import identity, records, text, values
from plexora.functions import vectors as V
from plexora.operators import discover, flow, graph, mapping, matching, quality, roles, search, sets, shaping, spatial
from plexora.plans.catalog import _PLACE, _places, _points, q
from plexora.scale import shared_dir
from plexora.sources import readers, shards, sinks
from plexora.streaming import changes
from plexora.tables import table

_ROLES = {"title": "title", "subtitle": "locality", "tags": ["categories", "priceLevel"], "temporal": None, "text": ["website"]}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plexora-{name}/{uuid.uuid4().hex}"


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records of the last snapshot, one per track id."""
    b = table(spark, d, "bundle_points").where("snapshot_no = 5 AND track_id IS NOT NULL AND fields IS NOT NULL")
    one = b.groupBy(F.col("track_id").alias("id")).agg(F.max(F.struct("fields", "meta", "owner")).alias("s")).select("id", "s.*")
    f = F.try_parse_json("fields")
    return one.select("id", f.alias("fields"), F.try_variant_get(f, "$.entityType", "string").alias("entity_type"), "meta", "owner", F.col("fields").alias("raw"))


_BUNDLE = "SELECT track_id AS id, arg_max(f, f).fields AS raw, json_extract_string(arg_max(f, f).fields, '$.entityType') AS entity_type, arg_max(f, f).meta AS meta, arg_max(f, f).owner AS owner FROM (SELECT track_id, struct_pack(fields := fields, meta := meta, owner := owner) AS f FROM bundle_points WHERE snapshot_no = 5 AND track_id IS NOT NULL AND fields IS NOT NULL) GROUP BY track_id"
_META = {"manifest_cid": "manifestcid", "seconds": "blocktimestamp", "version": "version", "owner": "owner"}


def _meta() -> dict:
    return {"source_cid": F.lit(None).cast("string"), **{k: F.col(f"meta.{v}") for k, v in _META.items()}}


# -- shapes of results ------------------------------------------------------------------------------------------------


@q(f"WITH b AS ({_BUNDLE}) SELECT id, entity_type, nullif(trim(meta.manifestcid), '') AS source_cid, CASE WHEN meta.blocktimestamp <> 0 THEN strftime(make_timestamp(meta.blocktimestamp * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published, meta.version AS version, coalesce(nullif(trim(meta.owner), ''), nullif(trim(owner), '')) AS publisher FROM b")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """where each record comes from."""
    return shaping.results(_bundle(spark, d), _meta()).select("id", "entity_type", "provenance.*")


@q("SELECT vec_id AS id, 'Vector' AS entity_type, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_transform(range(64), lambda i: sin(i + 1)) AS DOUBLE[])), 4) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_transform(range(64), lambda i: sin(i + 1)) AS DOUBLE[])) DESC, id LIMIT 10")
def shaped_hits(spark: SparkSession, d: str) -> DataFrame:
    """hits of a vector search in the service's shape, scores with 4 places."""
    import math

    hits = search.top_k(_points(spark, d), [math.sin(i + 1) for i in range(64)], 10).withColumns({"entity_type": F.lit("Vector"), "fields": F.parse_json(F.lit("{}")), "owner": F.lit("me")})
    none = {k: F.lit(None).cast("string") for k in ("source_cid", "manifest_cid", "owner")} | {"seconds": F.lit(0), "version": F.lit(1)}
    return shaping.results(hits, none, 4).select("id", "entity_type", "score")


@q(f"WITH b AS ({_BUNDLE}) SELECT id, coalesce(entity_type, 'Unknown') AS entity_type, coalesce(nullif(trim(json_extract_string(raw, '$.title')), ''), id) AS title, list_aggregate([x FOR x IN [nullif(trim(json_extract_string(raw, '$.locality')), ''), json_extract_string(raw, '$.categories[0]')] IF x IS NOT NULL], 'string_agg', ' · ') AS line, coalesce(CAST(json_extract(raw, '$.categories') AS VARCHAR[]), []) AS tags FROM b WHERE coalesce(entity_type, '') <> 'Event' AND json_extract_string(raw, '$.locality') IS NOT NULL")
def record_summaries(spark: SparkSession, d: str) -> DataFrame:
    """title, line and tags over a role map."""
    b = _bundle(spark, d).where(F.coalesce("entity_type", F.lit("")) != "Event").where(F.try_variant_get("fields", "$.locality", "string").isNotNull())
    return shaping.summaries(b, _ROLES)


@q(f"WITH b AS ({_BUNDLE}) SELECT id, nullif(trim(json_extract_string(raw, '$.locality')), '') AS line FROM b WHERE entity_type = 'Event' AND nullif(trim(json_extract_string(raw, '$.locality')), '') IS NOT NULL")
def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """of events the day and the place."""
    b = _bundle(spark, d).where("entity_type = 'Event'")
    return b.select("id", F.nullif(shaping.secondary_line(F.col("entity_type"), F.col("fields"), _ROLES), F.lit("")).alias("line")).where("line IS NOT NULL")


@q(f"WITH b AS ({_BUNDLE}), t AS (SELECT id, list_concat(coalesce(CAST(json_extract(raw, '$.categories') AS VARCHAR[]), []), CASE WHEN nullif(json_extract_string(raw, '$.priceLevel'), '') IS NULL THEN [] ELSE [json_extract_string(raw, '$.priceLevel')] END) AS tags, coalesce(nullif(trim(json_extract_string(raw, '$.title')), ''), '') AS title, coalesce(nullif(trim(json_extract_string(raw, '$.locality')), ''), '') AS sub, nullif(trim(json_extract_string(raw, '$.website')), '') AS txt FROM b) SELECT id, 'search_document: ' || substr('Title: ' || title || '. Tags: ' || coalesce(array_to_string(tags, ', '), '') || CASE WHEN sub <> '' THEN '. Subtitle: ' || sub ELSE '' END || CASE WHEN txt IS NOT NULL THEN '. ' || txt ELSE '' END, 1, 1000) AS doc FROM t")
def role_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents composed over a role map."""
    return _bundle(spark, d).select("id", shaping.document(F.col("fields"), _ROLES).alias("doc"))


@q(f"WITH b AS ({_BUNDLE}) SELECT id, coalesce(nullif(trim(json_extract_string(raw, '$.title')), ''), id) AS title, coalesce(CAST(json_extract(raw, '$.categories') AS VARCHAR[]), [])[1:3] AS genres FROM b")
def map_tracks(spark: SparkSession, d: str) -> DataFrame:
    """What the map shows of a record."""
    b = _bundle(spark, d).withColumns({"px": F.lit(0.5), "py": F.lit(0.5)})
    return shaping.map_track(b, _ROLES).select("id", "title", "genres")


@q(f"WITH b AS ({_BUNDLE}) SELECT lower(replace(coalesce(json_extract_string(raw, '$.categories[0]'), CASE WHEN entity_type = 'Event' THEN 'event' ELSE 'place' END), '_', ' ')) AS vibe, count(*) AS n FROM b GROUP BY 1")
def vibe_groups(spark: SparkSession, d: str) -> DataFrame:
    """Records by what they are."""
    b = _bundle(spark, d)
    return b.groupBy(F.lower(shaping.category(F.col("entity_type"), F.col("fields"))).alias("vibe")).agg(F.count(F.lit(1)).alias("n"))


@q(f"WITH b AS ({_BUNDLE}), k AS (SELECT DISTINCT id, unnest(json_keys(raw)) AS key, raw FROM b) SELECT id, list(key ORDER BY key) AS fields FROM k WHERE json_type(raw, '$.' || key) = 'ARRAY' AND json_array_length(raw, '$.' || key) > 0 AND key NOT IN ('priceLevel') GROUP BY id")
def connection_lists(spark: SparkSession, d: str) -> DataFrame:
    """which fields of a record are lists of others."""
    b = _bundle(spark, d).select("id", shaping.connection_fields(F.col("fields"), {"tags": ["priceLevel"]}).alias("fields"))
    return b.where(F.size("fields") > 0)


@q("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'ipfs://' || c_custkey ELSE c_name END AS value FROM customer")
def flattened_handles(spark: SparkSession, d: str) -> DataFrame:
    """F16: declared object handles as their uris."""
    c = table(spark, d, "customer")
    handle = F.to_json(F.struct(F.struct(F.lit("handle").alias("@type"), F.concat(F.lit("ipfs://"), F.col("c_custkey").cast("string")).alias("uri")).alias("v")))
    j = F.when(F.col("c_custkey") % 2 == 0, handle).otherwise(F.to_json(F.struct(F.col("c_name").alias("v"))))
    return c.select(F.col("c_custkey").alias("id"), shaping.flatten_handle(F.parse_json(j), "v").alias("value"))


@q("SELECT s_suppkey AS id, CAST(s_suppkey AS DOUBLE) + CASE WHEN s_suppkey % 3 = 1 THEN 0.5 ELSE 0 END AS lon, CAST(s_nationkey AS DOUBLE) + CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END AS lat FROM supplier WHERE s_suppkey % 3 <> 2")
def role_places(spark: SparkSession, d: str) -> DataFrame:
    """the pair of the spatial field, or the middle of its box."""
    s = table(spark, d, "supplier")
    x, y = F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")
    pair, box = F.struct(x.alias("Lng"), y.alias("latitude")), F.struct(x.alias("min_lon"), (x + 1).alias("max_lon"), y.alias("min_lat"), (y + 2).alias("max_lat"))
    j = F.when(x % 3 == 0, F.to_json(F.struct(pair.alias("geo")))).when(x % 3 == 1, F.to_json(F.struct(box.alias("geo")))).otherwise("{}")
    return s.select(F.col("s_suppkey").alias("id"), shaping.spatial(F.parse_json(j), {"spatial": "geo"}).alias("p")).where("p IS NOT NULL").select("id", "p.lon", "p.lat")


# -- roles and queries, whose results are known beforehand -------------------------------------------------------------


@q("SELECT * FROM (VALUES ('identity', 'trackId'), ('title', 'title'), ('subtitle', 'byArtist'), ('temporal', 'datePublished'), ('media', 'platformId'), ('tags', 'genres'), ('tags', 'moods'), ('measures', 'durationMs'), ('relations', 'albumName'), ('applies', 'true'), ('applies elsewhere', 'false'), ('label of subtitle', 'Artist'), ('label of measures', 'Duration Ms')) AS t(role, field)")
def inferred_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of a music corpus, and whether they fit it and another one."""
    music = [{"trackId": f"t{i}", "title": f"Song {i}", "byArtist": "X", "albumName": "A", "datePublished": "2020-01-02", "durationMs": 1000 + i, "genres": ["rock", f"g{i}"], "moods": ["sad"], "platformId": "p"} for i in range(5)]
    m = roles.infer_roles(music)
    rows = [(r, m[r]) for r in roles.SINGLE if m[r]] + [(r, f) for r in roles.MULTI for f in m[r]]
    rows += [("applies", str(roles.role_map_applies(m, music)).lower()), ("applies elsewhere", str(roles.role_map_applies(m, [{"foo": 1}])).lower())]
    rows += [(f"label of {r}", m["labels"][r]) for r in ("subtitle", "measures")]
    return spark.createDataFrame(rows, "role string, field string")


@q("SELECT * FROM (VALUES ('b', 'boolean'), ('entityType', 'string'), ('l', 'string'), ('mixed', 'string'), ('n', 'number'), ('placeId', 'string'), ('@id', 'placeId')) AS t(field, kind)")
def inferred_schema(spark: SparkSession, d: str) -> DataFrame:
    """Declared types of staged nodes and their identity."""
    nodes = [{"name": f"ChIJ{i:023d}", "fields": {"entityType": "P", "placeId": f"ChIJ{i:023d}", "n": 1.5, "b": True, "l": [1], "mixed": i if i else True}} for i in range(5)]
    s = roles.infer_schema(nodes, {"gplace": r"ChIJ[\w-]{10,}$"}, ["gplace", "osm"])
    return spark.createDataFrame([*s["fields"].items(), ("@id", s["identity"]["@id"])], "field string, kind string")


@q("SELECT * FROM (VALUES ('best cheap tacos with outdoor seating open now', 'tacos with outdoor seating', '$ $$', 4.3, true, false), ('hidden gems', '', '', NULL, false, true), ('cheap open now', 'cheap open now', '$ $$', NULL, true, false), ('fancy wine bar', 'wine bar', '$$$ $$$$', NULL, false, false), ('lake house', 'lake house', '', NULL, false, false)) AS t(query, semantic, prices, rating, open_now, gems)")
def query_readings(spark: SparkSession, d: str) -> DataFrame:
    """what typed queries say."""
    asked = ("best cheap tacos with outdoor seating open now", "hidden gems", "cheap open now", "fancy wine bar", "lake house")
    read = [(x, discover.interpret(x)) for x in asked]
    return spark.createDataFrame([(x, r.semantic, " ".join(r.filters.price_levels), r.filters.rating_gte, r.filters.open_now, r.gems_only) for x, r in read], "query string, semantic string, prices string, rating double, open_now boolean, gems boolean")


@q("SELECT 'patio' AS semantic, '$ $$' AS prices, 'reservable, outdoor seating' AS amenities, true AS gems, 'Outdoor seating; Budget-friendly; Hidden gems; Takes reservations' AS notes")
def merged_readings(spark: SparkSession, d: str) -> DataFrame:
    """A model's answer adds to the rules' reading and never takes from it."""
    answer = discover.reading_of_answer({"price": "upscale", "amenities": ["reservable", "spaceship"], "gems": True, "topRated": "yes"})
    notes = [n for n in answer.notes if n != "Upscale"]
    m = discover.merge_readings(discover.interpret("cheap patio"), discover.Reading("", answer.filters, notes, answer.gems_only))
    return spark.createDataFrame([(m.semantic, " ".join(m.filters.price_levels), ", ".join(m.filters.amenities), m.gems_only, "; ".join(m.notes))], "semantic string, prices string, amenities string, gems boolean, notes string")


@q("WITH d AS (SELECT CAST(DATE '2025-06-02' + INTERVAL (i) DAY AS DATE) AS today FROM range(14) t(i)), w AS (SELECT today, CAST(today + INTERVAL (6 - (isodow(today) - 1)) DAY AS DATE) AS sunday FROM d) SELECT CAST(today AS VARCHAR) AS today, CAST(today AS VARCHAR) AS week_from, CAST(sunday AS VARCHAR) AS week_to, CASE WHEN isodow(today) = 7 THEN CAST(today AS VARCHAR) ELSE CAST(greatest(today, CAST(sunday - INTERVAL 1 DAY AS DATE)) AS VARCHAR) END AS weekend_from, CAST(sunday AS VARCHAR) AS weekend_to FROM w")
def date_windows(spark: SparkSession, d: str) -> DataFrame:
    """bounds of the week and of the weekend, for two weeks of days."""
    days = [date(2025, 6, 2) + timedelta(i) for i in range(14)]
    return spark.createDataFrame([(x.isoformat(), *discover.date_window("week", x), *discover.date_window("weekend", x)) for x in days], "today string, week_from string, week_to string, weekend_from string, weekend_to string")


@q("SELECT eventid FROM (SELECT DISTINCT eventid, startdate, isfree, ispast, locality FROM place_events) WHERE coalesce(isfree, true) AND NOT coalesce(ispast, false) AND (startdate IS NULL OR substr(startdate, 1, 10) BETWEEN '2026-06-10' AND '2026-06-14')")
def filtered_week_events(spark: SparkSession, d: str) -> DataFrame:
    """free and to come, in the rest of a given week."""
    e = table(spark, d, "place_events").select("eventid", F.col("startdate").alias("start_date"), F.col("isfree").alias("is_free"), F.col("ispast").alias("is_past"), "locality").distinct()
    return e.where(discover.matches(e, discover.Filters(free_only=True, upcoming_only=True, date_window="week"), datetime(2026, 6, 10))).select("eventid")


@q("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN (s_nationkey % 12) < 12 AND (s_nationkey % 12) * 60 <= 750 ELSE NULL END AS open FROM supplier WHERE s_suppkey % 4 < 3 OR s_suppkey % 4 = 3")
def open_now(spark: SparkSession, d: str) -> DataFrame:
    """closed, round the clock, a range that begins in the morning, and text that can't be read, on a Wednesday at 12:30."""
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey") % 12
    morning = F.concat(F.lit("Tuesday: Closed; Wednesday: "), F.when(n == 0, "12").otherwise(n.cast("string")), F.lit(":00 AM – 11:30 PM"))
    hours = F.when(k == 0, "Wednesday: Closed").when(k == 1, "Wednesday: Open 24 hours").when(k == 2, morning).otherwise("ask inside")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), discover.open_at(hours, datetime(2025, 6, 4, 12, 30)).alias("open"))


@q("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'")
def host_events(spark: SparkSession, d: str) -> DataFrame:
    """A host's events; orders stand in for events."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("host"), (F.col("o_orderstatus") == "F").alias("is_past"), F.col("o_orderdate").cast("string").alias("start_date"))
    return discover.events_of_host(o, "1-URGENT").select("id")


# -- texts, ids and numbers -------------------------------------------------------------------------------------------


@q("SELECT p_partkey AS id, concat_ws(' ', nullif(trim(p_type), ''), nullif(trim(p_type), ''), p_name, p_brand, nullif(CASE WHEN p_size > 25 THEN 'large' ELSE '' END, '')) AS service, 'search_document: ' || substr(concat_ws(' ', p_name, p_brand, CAST(p_size AS VARCHAR)), 1, 1000) AS chosen FROM part")
def searchable_texts(spark: SparkSession, d: str) -> DataFrame:
    """The service's text, and chosen fields in a row."""
    p = table(spark, d, "part")
    size = F.when(F.col("p_size") > 25, "large").otherwise("")
    return p.select(F.col("p_partkey").alias("id"), text.searchable_text(F.col("p_name"), F.col("p_type"), F.col("p_brand"), size).alias("service"), text.chosen_text([F.col("p_name"), F.col("p_brand"), F.col("p_size")]).alias("chosen"))


@q("SELECT event_id AS id, CASE WHEN value = 0 THEN '0' WHEN abs(value) >= 100 THEN format('{:,.2f}', value) WHEN abs(value) >= 1 THEN format('{:,.4f}', value) ELSE regexp_replace(regexp_replace(format('{:,.6f}', value), '0+$', ''), '\\.$', '') END AS amount, CASE WHEN event_id < 90 THEN event_id || 's' WHEN event_id < 5400 THEN format('{:.0f}', event_id / 60.0) || 'm' WHEN event_id < 172800 THEN format('{:.1f}', event_id / 3600.0) || 'h' ELSE format('{:.1f}', event_id / 86400.0) || 'd' END AS age, CAST(event_id // 60000 AS BIGINT) || ':' || lpad(CAST((event_id // 1000) % 60 AS VARCHAR), 2, '0') AS minutes FROM events WHERE (event_id / 60.0) % 1 <> 0.5 AND event_id % 180 <> 0")
def formatted_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Amounts, ages and durations; ages that lie in the middle between two roundings are left out, as the two
    engines round them to different sides."""
    e = table(spark, d, "events").where("(event_id / 60.0D) % 1 <> 0.5 AND event_id % 180 <> 0")
    return e.select(F.col("event_id").alias("id"), text.amount(F.col("value")).alias("amount"), text.age(F.col("event_id")).alias("age"), text.minutes(F.col("event_id")).alias("minutes"))


@q("WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'track:' || c_custkey END AS prefer, CASE WHEN c_custkey % 3 = 1 THEN 'k' || c_custkey ELSE ' ' END AS key, c_mktsegment AS artist, CASE WHEN c_custkey % 5 <> 2 THEN c_name END AS title FROM customer) SELECT id, coalesce(regexp_replace(prefer, '^track:', ''), nullif(trim(key), ''), CASE WHEN title IS NOT NULL THEN substr(sha256(artist || ':' || title), 1, 24) END, substr(sha256(CAST(id AS VARCHAR)), 1, 12)) AS tid FROM t")
def track_ids(spark: SparkSession, d: str) -> DataFrame:
    """The preferred id, a key, artist and title, the row."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    prefer = F.when(k % 3 == 0, F.concat(F.lit("track:"), k.cast("string")))
    key = F.when(k % 3 == 1, F.concat(F.lit("k"), k.cast("string"))).otherwise(" ")
    return c.select(k.alias("id"), identity.track_id(prefer, [key], F.col("c_mktsegment"), F.when(k % 5 != 2, F.col("c_name")), k).alias("tid"))


_UUID = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name))"


@q(f"WITH h AS (SELECT c_custkey AS id, {_UUID} AS h FROM customer) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id FROM h")
def point_uuids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based UUIDs."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), identity.uuid5(F.col("c_name")).alias("point_id"))


@q("SELECT vec_id AS id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(3 * x))) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 9 * x * x))), 5) AS total FROM embeddings")
def unit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows at length one; shown by the sum of their sizes."""
    u = V.unit(F.transform("embedding", lambda x: x.cast("double") * 3))
    return _points(spark, d).select("id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("total"))


@q("SELECT p_partkey AS id, round(3.0 * log10(1 + p_size) + 1.0 * log10(1 + p_partkey) + CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 0 END + CASE WHEN p_size > 20 THEN 1.0 ELSE 0 END + CASE WHEN p_type IN ('ECONOMY') THEN 0 ELSE 0.5 END - CASE WHEN p_name LIKE '%ring%' THEN 2.0 ELSE 0 END, 5) AS score, round(0.5 * p_size + 2 * ln(1 + p_partkey), 5) AS seed FROM part")
def track_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted signals of a track and of a seed; parts stand in for tracks."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    genre = F.array(F.when(F.col("p_name").contains("ring"), "Field Recording").otherwise("rock"))
    s = quality.track_score(F.col("p_size"), k, F.when(k % 2 == 0, "c"), F.when(F.col("p_size") > 20, "official"), F.when(F.col("p_type") != "ECONOMY", "Album"), genre)
    return p.select(k.alias("id"), F.round(s, 5).alias("score"), F.round(quality.seed_score(F.col("p_size"), k, 0.5, 2.0), 5).alias("seed"))


@q("SELECT p_brand AS k, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS labels, min(p_size) AS year FROM part GROUP BY p_brand")
def labels_years(spark: SparkSession, d: str) -> DataFrame:
    """Different labels in a row, and the earliest year."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("k"), "p_type", F.col("p_size"))
    return quality.labels_and_year(p, "k", "p_type", "p_size")


@q("SELECT c_custkey AS id, CASE WHEN length(c) >= 2 AND lower(c) NOT IN ('wi', 'iowa', 'usa') THEN c END AS city FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Iowa' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'x' ELSE 'New ' || c_mktsegment END AS c FROM customer)")
def canonical_cities(spark: SparkSession, d: str) -> DataFrame:
    """Place names without what follows; states and single letters are none."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "Iowa, USA").when(k % 4 == 1, F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" , WI"))).when(k % 4 == 2, "x").otherwise(F.concat(F.lit("New "), F.col("c_mktsegment")))
    return table(spark, d, "customer").select(k.alias("id"), text.city(raw).alias("city"))


@q("SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' feat. ' || c_mktsegment ELSE '' END AS credit, CASE WHEN c_custkey % 2 = 0 THEN [c_custkey::VARCHAR, 's'] ELSE [c_custkey::VARCHAR] END AS ids FROM customer")
def artist_credits(spark: SparkSession, d: str) -> DataFrame:
    """Names joined by their phrases; the recording's credit before the release's."""
    k = F.col("c_custkey")
    one = lambda n, j, i: F.struct(n.alias("name"), j.alias("joinphrase"), i.alias("id"))
    two = F.array(one(F.col("c_name"), F.lit(" feat. "), k.cast("string")), one(F.col("c_mktsegment"), F.lit(""), F.lit("s")), one(F.lit(""), F.lit(""), F.lit("s")))
    solo = F.array(one(F.col("c_name"), F.lit(None).cast("string"), k.cast("string")))
    c = records.credited(F.when(k % 2 == 0, two), solo)
    return table(spark, d, "customer").select(k.alias("id"), records.artist_credit(c).alias("credit"), records.artist_ids(c).alias("ids"))


# -- ranks, lists and sets --------------------------------------------------------------------------------------------


@q("SELECT o_custkey AS k, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END, o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best_releases(spark: SparkSession, d: str) -> DataFrame:
    """Of each key the best kind, then the earliest."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("date"))
    return records.best_release(o, "k", ("F", "O", "X")).select("k", "id")


@q("WITH n AS (SELECT c_mktsegment AS shelf, c_custkey AS id, c_acctbal AS lat, c_nationkey AS lon, CAST(floor((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1) / 4) AS BIGINT) AS band FROM customer) SELECT shelf, id, row_number() OVER (PARTITION BY shelf ORDER BY band, lon, id) AS place FROM n")
def geo_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of four from north to south, each from west to east."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("shelf"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lat"), F.col("c_nationkey").alias("lon"))
    return quality.geo_rows(c, "shelf", 4)


@q("WITH g AS (SELECT coalesce(locality, 'Other') AS g, count(*) AS n FROM place_events GROUP BY 1) SELECT CASE WHEN n < 3 THEN 'Other' ELSE g END AS shelf, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1")
def event_shelves(spark: SparkSession, d: str) -> DataFrame:
    """Small groups fold into Other."""
    return quality.shelves(table(spark, d, "place_events").select("locality"), "locality")


@q("SELECT s_suppkey AS id, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 7 = 0 THEN -s_suppkey END NULLS LAST, s_suppkey) AS place FROM supplier WHERE s_suppkey < 40")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """The order of an external list first."""
    s = table(spark, d, "supplier").where("s_suppkey < 40").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("rank"))
    order = s.where("id % 7 = 0").select("id", (-F.col("id")).alias("pos"))
    ids = [r["id"] for r in search.rerank_by_list(s, order).collect()]  # 40 rows: their order is what is looked at
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id bigint, place int")


_S = search.build_session([([1.0] * 64, ["label 1"]), ([0.5] * 63 + [2.0], ["label 2"]), ([1.0] * 63 + [0.0], ["label 1"])], [([-1.0] * 64, ["label 4"]), ([0.0] * 64, ["label 3"])])
_SQ = "CAST([" + ",".join(map(repr, search.session_query(_S) or [])) + "] AS DOUBLE[])"
_SKIP = "CAST([" + ",".join(map(repr, _S.skip or [])) + "] AS DOUBLE[])"
_TASTE = " ".join(f"WHEN '{t}' THEN {v!r}" for t, v in _S.taste.items())


@q(f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_SQ}) + 0.15 * CASE 'label ' || label {_TASTE} ELSE 0 END - 0.5 * exp(-pow(list_distance(CAST(embedding AS DOUBLE[]), {_SKIP}), 2) / (2 * pow({_S.skip_radius!r}, 2))), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20")
def taste_rank(spark: SparkSession, d: str) -> DataFrame:
    """A session's heading, taste and avoidance over all vectors."""
    c = _points(spark, d).withColumn("tags", F.array(F.concat(F.lit("label "), F.col("label").cast("string"))))
    c = c.withColumn("base_score", V.cosine(F.col("embedding"), V.literal(search.session_query(_S) or [])))
    return search.rank_by_session(c, _S, 20)


@q("SELECT c_custkey AS id, c_acctbal AS score FROM customer WHERE c_custkey % 3 <> 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 8")
def heading_rail(spark: SparkSession, d: str) -> DataFrame:
    """The best that haven't been rated."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return records.heading_rail(c, c.where("id % 3 = 0"), 120, 8).select("id", "score")


@q("SELECT p_partkey AS id FROM part WHERE p_size > 40 AND contains(lower(p_name), 'ring') ORDER BY CASE WHEN lower(p_name) = 'ring' THEN 100 WHEN starts_with(lower(p_name), 'ring') THEN 50 ELSE 25 END DESC, p_partkey LIMIT 12 OFFSET 3")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Text without a vector: filtered lexical ranking, a page of it."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size")
    return search.hybrid(p, None, "ring", F.col("p_size") > 40, 12, 3).select("id")


@q("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 5 ORDER BY n DESC, label LIMIT 40")
def map_labels(spark: SparkSession, d: str) -> DataFrame:
    """Mean places of labels on a map."""
    e = _points(spark, d).select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return mapping.label_centroids(e, "label")


@q("SELECT label, i - 1 AS pos, round(sum(CAST(embedding[i] AS DOUBLE) * (vec_id % 3 + 1)) / sum(vec_id % 3 + 1), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean vectors."""
    m = mapping.mean_vectors(_points(spark, d), "label", weight=F.col("id") % 3 + 1)
    return m.withColumn("mean", F.round("mean", 6))


@q("SELECT c_mktsegment AS entity_type, sum(CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END)::BIGINT AS passing, CASE WHEN c_mktsegment = 'BUILDING' THEN least(25, sum(CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END)) ELSE sum(CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END) END::BIGINT AS seeds FROM customer GROUP BY 1")
def seed_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes would be seeds."""
    return graph.seed_counts(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "entity_type"), F.col("c_acctbal"), 5000.0, {"BUILDING": 25})


@q("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM a FULL OUTER JOIN b USING (k)")
def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    """What two sets of keys share and what they don't."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return sets.overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), "k")


@q("SELECT DISTINCT 'p' || l_partkey AS point_id FROM lineitem WHERE l_orderkey % 10 = 0")
def removed_point_ids(spark: SparkSession, d: str) -> DataFrame:
    """The points of records whose blobs are removed; orders stand in for blobs."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uri"), "l_partkey")
    gone = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("uri"))
    return sets.removed_points(gone, li, F.concat(F.lit("p"), F.col("l_partkey").cast("string")))


@q("SELECT CAST(o_orderkey AS VARCHAR) AS tree, 'c' || l_linenumber AS content_id, 'u' || l_partkey AS uri FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 1 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'u' || l_partkey, 'u' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = 0")
def blob_refs(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of record sets and linksets; the uri stands for a missing content id."""
    li = table(spark, d, "lineitem")
    leaf = F.struct(F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("dataCid"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))).alias("contentId"))
    g = li.groupBy(F.col("l_orderkey").cast("string").alias("tree")).agg(F.collect_list(leaf).alias("l"), F.max(F.col("l_orderkey") % 2).alias("k"))
    rec = F.to_json(F.struct(F.lit("record-set").alias("kind"), F.transform("l", lambda x: F.struct(x.alias("fields"))).alias("entries")))
    link = F.to_json(F.struct(F.lit("linkset").alias("kind"), F.col("l").alias("linkChunks")))
    return sets.blob_refs(g.select("tree", F.parse_json(F.when(F.col("k") == 0, rec).otherwise(link)).alias("manifest"))).select("tree", "content_id", "uri")


@q(f"WITH c AS (SELECT localityid AS id, CAST(split_part(coordinates, ',', 1) AS DOUBLE) AS lat, CAST(split_part(coordinates, ',', 2) AS DOUBLE) AS lon FROM localities WHERE coordinates IS NOT NULL), p AS ({_PLACE}), l AS (SELECT id, CAST(json_extract(payload, '$.location.latitude') AS DOUBLE) AS lat, CAST(json_extract(payload, '$.location.longitude') AS DOUBLE) AS lon FROM p), d AS (SELECT l.id, 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(c.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - l.lon) / 2), 2)))) AS m FROM l, c WHERE l.lat IS NOT NULL AND l.lon IS NOT NULL) SELECT id, round(min(m), 3) AS metres, CASE WHEN min(m) <= 1000 THEN 'on' ELSE 'near' END AS tag FROM d GROUP BY id HAVING min(m) <= 5000")
def nearest_town(spark: SparkSession, d: str) -> DataFrame:
    """The nearest anchor within a distance."""
    p = _places(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    return matching.nearest_anchor(p, spatial.located(table(spark, d, "localities"), "localityid"), 5000.0, 1000.0)


@q(f"WITH p AS ({_PLACE}), t AS (SELECT id, CASE WHEN CAST(json_extract(payload, '$.rating') AS DOUBLE) > 4.5 THEN json_extract_string(payload, '$.primaryType') END AS city, CAST(json_extract(payload, '$.location.latitude') AS DOUBLE) AS lat, CAST(json_extract(payload, '$.location.longitude') AS DOUBLE) AS lon FROM p), c AS (SELECT city, avg(lat) AS clat, avg(lon) AS clon FROM t WHERE city IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY city), d AS (SELECT t.id, c.city, 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(c.clat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(c.clat)) * pow(sin(radians(c.clon - t.lon) / 2), 2)))) AS m FROM t, c WHERE t.city IS NULL AND t.lat IS NOT NULL AND t.lon IS NOT NULL) SELECT id, city FROM t WHERE city IS NOT NULL UNION ALL SELECT id, 'No location' FROM t WHERE city IS NULL AND (lat IS NULL OR lon IS NULL) UNION ALL SELECT t.id, coalesce((SELECT arg_min(city, m) FROM d WHERE d.id = t.id AND m <= 400000), 'Other') FROM t WHERE city IS NULL AND lat IS NOT NULL AND lon IS NOT NULL")
def snapped_cities(spark: SparkSession, d: str) -> DataFrame:
    """Points without a city take the nearest centroid's."""
    t = _places(spark, d).select("id", F.when(F.col("rating") > 4.5, F.col("kind")).alias("city"), "lat", "lon")
    return matching.snap_to_centroids(t, 400.0)


# -- graphs and flows -------------------------------------------------------------------------------------------------


@q("SELECT 'nation:' || n_nationkey AS root, 'customers' AS grp, c_name AS label, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS place FROM nation JOIN customer ON c_nationkey = n_nationkey QUALIFY place <= 10")
def customer_folds(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the customers around them folded in, in the order of the walk, cut to ten; X2: from JSON."""
    c = table(spark, d, "customer")
    nodes = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Nation").alias("entity_type"), F.col("n_name").alias("name"))
    nodes = nodes.unionByName(c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Customer").alias("entity_type"), F.col("c_name").alias("name")))
    edges = c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("dst"), F.col("c_custkey").cast("bigint").alias("seq"))
    profile = graph.load_profiles('{"Nation": {"max_depth": 1, "label_cap": 10, "node_cap": 1000000}}')["Nation"]
    f = graph.project(nodes, edges, profile).select("root", F.explode("folds").alias("grp", "labels"))
    return f.select("root", "grp", F.posexplode("labels").alias("pos", "label")).select("root", "grp", "label", (F.col("pos") + 1).alias("place"))


@q("WITH t AS (SELECT 't' || event_id AS id, event_type AS symbol, 'U' || user_id AS src, CASE WHEN event_id % 4 <> 0 THEN 'u' || (event_id % 50) END AS dst FROM events) SELECT entity_type, count(*) AS n FROM (SELECT DISTINCT 'asset:' || symbol AS id, 'Asset' AS entity_type FROM t UNION ALL SELECT id, 'Transfer' FROM t UNION ALL SELECT DISTINCT lower(w), 'Wallet' FROM (SELECT src AS w FROM t UNION ALL SELECT dst FROM t) WHERE w IS NOT NULL) GROUP BY 1 UNION ALL SELECT 'edges ' || rel, count(*) FROM (SELECT 'ofAsset' AS rel FROM t UNION ALL SELECT 'sent' FROM t UNION ALL SELECT 'receivedBy' FROM t WHERE dst IS NOT NULL) GROUP BY rel")
def flow_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of transfers; events stand in for them."""
    e = table(spark, d, "events")
    t = e.select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("symbol"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string"))).alias("dst"), F.col("event_id").alias("seq"))
    assets = t.where("symbol = 'click'").select("symbol", F.col("seq").alias("block"), "seq")
    nodes, edges = flow.flow_graph(assets, t)
    n = nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.concat(F.lit("edges "), F.col("rel")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n")))


@q("WITH t AS (SELECT event_id AS block, CAST(floor(epoch_ms(ts) / 1000.0) AS BIGINT) AS ts, user_id FROM events), a AS (SELECT max(block) AS activity_block, max(ts) AS activity_at FROM t GROUP BY user_id), e AS (SELECT min_by(ts, block) AS ta, min(block) AS ba, max_by(ts, block) AS tb, max(block) AS bb, max(ts) AS newest FROM t WHERE block > 0), b AS (SELECT count(*) AS assets, sum(CASE WHEN 1706745600 - activity_at < 3600 THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN 1706745600 - activity_at >= 604800 THEN 1 ELSE 0 END) AS older FROM a) SELECT 1000000 AS head, bb AS newest_block, newest AS newest_at, 1706745600 - newest AS newest_age, round((tb - ta) / (bb - ba), 4) AS sec_per_block, 1000000 - bb AS lag_blocks, assets, (SELECT count(*) FROM t) AS transfers, CAST(h1 AS BIGINT) AS age_1h, CAST(older AS BIGINT) AS age_older FROM e, b")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Head, pace, lag and ages against a given clock."""
    t = table(spark, d, "events").select(F.col("event_id").alias("block"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "user_id")
    a = t.groupBy("user_id").agg(F.max("block").alias("activity_block"), F.max("ts").alias("activity_at")).withColumn("observed_head", F.lit(1000000).cast("bigint"))
    out = flow.freshness(a, t.select("block", "ts"), 1706745600)
    return out.select("head", "newest_block", "newest_at", "newest_age", "sec_per_block", "lag_blocks", "assets", "transfers", "age_1h", "age_older")


@q("WITH RECURSIVE e AS (SELECT 'supplier:' || s_suppkey AS a, 'nation:' || s_nationkey AS b FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w AS (SELECT 'nation:3' AS id, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON w.id = u.a WHERE w.depth < 2) SELECT DISTINCT id FROM w")
def affected_roots(spark: SparkSession, d: str) -> DataFrame:
    """Whose documents a change may touch: within two steps of what it touched."""
    node = lambda t, k: F.concat(F.lit(f"{t}:"), F.col(k).cast("string"))
    e = table(spark, d, "supplier").select(node("supplier", "s_suppkey").alias("src"), F.lit("r").alias("rel"), node("nation", "s_nationkey").alias("dst"), F.col("s_suppkey").cast("bigint").alias("seq"))
    e = e.unionByName(table(spark, d, "nation").select(node("nation", "n_nationkey").alias("src"), F.lit("r").alias("rel"), node("region", "n_regionkey").alias("dst"), (F.col("n_nationkey") - 100).cast("bigint").alias("seq")))
    change = spark.createDataFrame([("n", None, None, 1, [("nation:3", "s", "{}")], None, None, None)], changes.CHANGE)
    return changes.affected_roots(change, e.limit(0), e, 2)


@q("SELECT track_id AS cid, arg_max(fields, fields) AS payload FROM bundle_points WHERE snapshot_no = 5 AND track_id IS NOT NULL GROUP BY track_id")
def state_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """A state that is seeded with a snapshot and brought to the last one by two batches of changes."""
    b = table(spark, d, "bundle_points").where("track_id IS NOT NULL").groupBy("snapshot_no", "track_id").agg(F.max("fields").alias("fields"))
    snap = lambda n: b.where(F.col("snapshot_no") == n).select(F.col("track_id").alias("cid"), F.lit("s").alias("schema_id"), F.col("fields").alias("payload"))
    state = changes.GraphState(spark, _folder(spark, "state"))
    state.reset(snap(3), spark.createDataFrame([], changes.EDGE))
    for n in (4, 5):
        add = snap(n).select(F.array(F.struct("cid", F.col("schema_id").alias("schemaId"), "payload")).alias("addedVertices"), F.lit(None).cast("array<string>").alias("removedVertexCids"))
        gone = snap(n - 1).join(snap(n).select("cid"), "cid", "left_anti").select(F.lit(None).cast(add.schema["addedVertices"].dataType).alias("addedVertices"), F.array("cid").alias("removedVertexCids"))
        none = F.lit(None).cast("array<struct<sourceCid: string, relation: string, targetCid: string>>")
        batch = add.unionByName(gone).withColumns({"addedEdges": none, "removedEdges": none, "blockNumber": F.lit(n).cast("bigint")})
        state.prepare(n, batch)
        state.commit(n)
    return state.tables()[0].select("cid", "payload")


@q("SELECT event_type AS type, event_id AS block FROM events WHERE event_type = 'error' OR event_id > 5000")
def past_cursor(spark: SparkSession, d: str) -> DataFrame:
    """What lies past a cursor, and kinds that are always read."""
    e = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("block"))
    return readers.past_cursor(e, 5000, always=("error",))


# -- stores, sources and sinks ----------------------------------------------------------------------------------------


def _baked(spark: SparkSession, d: str, name: str, label: str) -> tuple[str, DataFrame]:
    """A domain of the vectors whose id is no multiple of 5, and all vectors as points."""
    root = _folder(spark, name)
    e = table(spark, d, "embeddings")
    fields = F.to_json(F.struct(F.lit("Vector").alias("entityType"), F.col(label).alias("label")))
    pts = e.select(F.col("vec_id").cast("string").alias("track_id"), fields.alias("fields"), "embedding", F.lit("me").alias("owner"), F.lit(None).cast("string").alias("meta"), F.lit("Vector").alias("entity_type"), "vec_id")
    shards.bake(pts.where("vec_id % 5 <> 0").drop("vec_id"), root, "vectors", shard_size=200, dim=64, now=0)
    return root, pts


@q("SELECT CAST(vec_id AS VARCHAR) AS track_id, CASE WHEN vec_id % 7 = 0 THEN 'new' ELSE CAST(label AS VARCHAR) END AS label FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 2 = 0")
def delta_append_load(spark: SparkSession, d: str) -> DataFrame:
    """New and changed records are delivered as delta shards; loading gives each its last row."""
    root, pts = _baked(spark, d, "delta", "label")
    now = pts.where("vec_id % 5 <> 0 OR vec_id % 2 = 0").withColumn("fields", F.when(F.col("vec_id") % 7 == 0, F.lit('{"entityType": "Vector", "label": "new"}')).otherwise(F.col("fields"))).drop("vec_id")
    shards.append(now, root, "vectors", shard_size=200, now=0)
    return shards.load(spark, root, "vectors").select("track_id", F.get_json_object("fields", "$.label").alias("label"))


@q("SELECT CAST(vec_id AS VARCHAR) AS track_id FROM embeddings WHERE vec_id % 5 <> 0 AND (vec_id NOT IN (1, 2, 3) OR vec_id = 2)")
def tombstone_load(spark: SparkSession, d: str) -> DataFrame:
    """Deleted records are gone; an identical record that is delivered again comes back."""
    root, pts = _baked(spark, d, "tombstones", "label")
    shards.tombstone(spark, root, "vectors", ["1", "2"])
    shards.tombstone(spark, root, "vectors", ["2", "3"])
    shards.append(pts.where("vec_id = 2").drop("vec_id"), root, "vectors", now=0)
    return shards.load(spark, root, "vectors").select("track_id")


_LINKS = "SELECT DISTINCT rel, from_id AS src, to_id AS dst FROM localcore_links WHERE coalesce(rel, '') <> '' AND coalesce(from_id, '') <> '' AND coalesce(to_id, '') <> ''"


@q(f"{_LINKS} AND from_id NOT IN (SELECT min(from_id) FROM localcore_links WHERE from_id <> '') AND to_id NOT IN (SELECT min(from_id) FROM localcore_links WHERE from_id <> '')")
def edges_append_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are appended twice are there once; those of a deleted end are pruned."""
    root, _ = _baked(spark, d, "edges", "label")
    links = table(spark, d, "localcore_links")
    e = links.select("rel", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("fromtype").alias("src_type"), F.col("totype").alias("dst_type"))
    shards.append_edges(e.where("rel <> 'near' OR rel IS NULL"), root, "vectors")
    shards.append_edges(e, root, "vectors")
    first = links.where("from_id <> ''").agg(F.min("from_id")).first()[0]
    shards.tombstone(spark, root, "vectors", [first])
    return shards.read_edges(spark, root, "vectors").select("rel", "src", "dst")


@q("SELECT 'vectors' AS name, count(*) AS count, 64 AS dim FROM embeddings WHERE vec_id % 5 <> 0")
def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    """Domains that hold anything."""
    root, pts = _baked(spark, d, "catalog", "label")
    shards.bake(pts.where("vec_id < 0").drop("vec_id"), root, "nothing", dim=64, now=0)
    listed = shards.catalog(root)
    assert discover.choose_domain(None, listed) == "vectors"
    return spark.createDataFrame([(x["name"], x["count"], x["dim"]) for x in listed], "name string, count bigint, dim int")


@q("SELECT CAST(vec_id AS VARCHAR) AS track_id, 'me' AS owner FROM embeddings WHERE vec_id % 5 <> 0")
def pulled_domain(spark: SparkSession, d: str) -> DataFrame:
    """A domain that is copied shard by shard, and loaded from the copy."""
    root, _ = _baked(spark, d, "pull", "label")
    to = _folder(spark, "pulled")
    shards.pull_domain(spark, root, "vectors", to)
    return shards.load(spark, to, "vectors").select("track_id", "owner")


@q("SELECT n_name AS name, n_regionkey AS region FROM nation")
def volume_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger that grows over two runs, and keeps the first row of each name."""
    at = _folder(spark, "volumes")
    n = table(spark, d, "nation")
    nodes = lambda some, extra: some.select(F.col("n_name").alias("name"), F.to_json(F.struct((F.col("n_regionkey") + extra).alias("region"))).alias("fields"))
    none = spark.createDataFrame([], shards.EDGE)
    sinks.emit_volumes({"nations": nodes(n.where("n_nationkey < 10"), 0)}, none, at, accumulate=True)
    sinks.emit_volumes({"nations": nodes(n.where("n_nationkey >= 10"), 0).unionByName(nodes(n.where("n_nationkey < 10"), 100))}, none, at, accumulate=True)
    out = sinks.read_volume(spark, at, 1, "nations", sinks.NODE)
    return out.select("name", F.get_json_object("fields", "$.region").cast("int").alias("region"))


@q("SELECT c_name AS id, 'Customer' AS tag, c_mktsegment AS segment FROM customer")
def published_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of vertices and edges, read back."""
    at = _folder(spark, "batch")
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("Customer").alias("entity_type"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("fields"), F.col("c_nationkey").cast("string").alias("n"))
    sinks.publish_batch(c.drop("n"), c.select(F.lit("in").alias("rel"), F.col("name").alias("src"), F.col("n").alias("dst")), at)
    return spark.read.schema("id string, tag string, payload string").json(f"{at}/vertices").select("id", "tag", F.get_json_object("payload", "$.segment").alias("segment"))


@q("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey < 500 OR c_custkey % 2 = 0")
def upserted_points(spark: SparkSession, d: str) -> DataFrame:
    """New points in the place of old ones; a full snapshot is what was there and what is added."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sinks.full_snapshot(c.where("id < 500"), c.where("id % 2 = 0").withColumn("name", F.lit("new")), "id")[0]


@q("SELECT vec_id AS id, embedding[1] IS NOT NULL AS has_vector FROM embeddings UNION ALL SELECT -1, false")
def attached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the vectors of a copied collection."""
    to = _folder(spark, "copy")
    sinks.copy_collection(spark, f"{d}/embeddings.parquet", to)
    p = spark.read.parquet(to).withColumnRenamed("vec_id", "id")
    hits = p.select("id").unionByName(spark.createDataFrame([(-1,)], "id bigint"))
    return sinks.attach_embeddings(hits, p).select("id", F.get("embedding", F.lit(0)).isNotNull().alias("has_vector"))


@q("SELECT CAST(vec_id AS VARCHAR) AS track_id, label FROM embeddings")
def imported_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line JSON that is exported and imported again; lines that are none are skipped."""
    at = _folder(spark, "export")
    e = table(spark, d, "embeddings").select(F.to_json(F.struct(F.col("vec_id").cast("string").alias("track_id"), F.struct("label").alias("fields"), "embedding")).alias("value"))
    e.unionByName(spark.createDataFrame([("no json",), ('{"track_id": "x"}',)], "value string")).write.text(at)
    return readers.import_lines(spark, at).select("track_id", F.get_json_object("fields", "$.label").cast("int").alias("label"))


@q("SELECT o_orderkey AS release, l_linenumber AS medium, 't' || l_partkey AS track, CASE WHEN l_linenumber % 2 = 0 THEN 'rec' ELSE 'rel' END AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def nested_releases(spark: SparkSession, d: str) -> DataFrame:
    """Releases with their media and tracks; tags fall back from the recording to the release."""
    li = table(spark, d, "lineitem")
    tag = lambda t: F.array(F.struct(F.lit(t).alias("name"), F.lit(1).alias("count")))
    none = F.array().cast("array<struct<name: string, count: int>>")
    track = F.struct(F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("id"), F.struct(F.lit("r").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, tag("rec")).otherwise(none).alias("genres")).alias("recording"))
    medium = F.struct(F.col("l_linenumber").alias("position"), F.array(track).alias("tracks"))
    g = li.groupBy("l_orderkey").agg(F.collect_list(medium).alias("media"))
    raw = g.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), tag("rel").alias("genres"), "media")).alias("value"))
    out = readers.releases(raw)
    return out.select(F.col("release").cast("bigint").alias("release"), "medium", "track", F.get("tags", F.lit(0))["name"].alias("tag"))


@q("SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN p_size ELSE 0 END AS listens, [lower(p_type)] AS genres FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') UNION ALL SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size ELSE 0 END, [] FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD')")
def enriched_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Looked-up counts, misses 0; tags by vocabulary."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("listens"), F.array("p_type", F.lit("noise"), "p_type").alias("tags"))
    out = records.with_listens(p.drop("listens"), p.where("listens > 10"), "id")
    return out.select("id", "listens", readers.classify_tags(F.col("tags"), {"genres": ["economy", "standard"]})["genres"].alias("genres"))


@q("SELECT 'taxonomy:' || p_partkey AS id, 'taxonomy' AS kind FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'track' FROM part UNION ALL SELECT p_partkey || ' hasTaxonomy taxonomy:' || p_partkey, 'edge' FROM part")
def taxonomy_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A track becomes two nodes and an edge."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array("p_type").alias("tags"))
    tracks, tax, edges = records.track_nodes(p)
    e = edges.select(F.concat_ws(" ", "src", "rel", "dst").alias("id"), F.lit("edge").alias("kind"))
    return tracks.select("id", F.lit("track").alias("kind")).unionByName(tax.select("id", F.lit("taxonomy").alias("kind"))).unionByName(e)


@q("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 4 = 1 THEN 1000.5 END AS number FROM part")
def spelled_numbers(spark: SparkSession, d: str) -> DataFrame:
    """what is a number: texts that spell one, no booleans, no type suffixes."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(k == 1, F.lit("1_000.5")).when(k == 2, F.lit("1d")).otherwise(F.lit("abc"))
    return p.withColumn("v", v).select(F.col("p_partkey").alias("id"), values.field(p.withColumn("v", v), "v").number().alias("number"))

