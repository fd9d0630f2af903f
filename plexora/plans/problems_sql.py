"""The same queries as plain SQL, for the side-by-side check. They compare all rows with all; slow on large tables."""

_FILLERS = "('', '-', '--', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', 'undefined', 'tbd', 'tba', '?', '.')"


def _key(c: str) -> str:
    k = f"regexp_replace(trim({c}, ' \t\r\n'), '^.*[:/]\\s*', '')"
    return f"CASE WHEN lower(trim({c}, ' \t\r\n')) IN {_FILLERS} OR lower({k}) IN {_FILLERS} THEN NULL ELSE {k} END"


_P7 = f"""
WITH refs AS (
  SELECT tablename, recordid, fieldname, ref, min(arrived) OVER (PARTITION BY tablename, recordid, fieldname) AS record_at FROM (
    SELECT 'localcore_links' AS tablename, CAST(linkid AS VARCHAR) AS recordid, 'from_id' AS fieldname, {_key('from_id')} AS ref, observed_at AS arrived FROM localcore_links
    UNION ALL SELECT 'localcore_links', CAST(linkid AS VARCHAR), 'to_id', {_key('to_id')}, observed_at FROM localcore_links
    UNION ALL SELECT 'place_reviews', reviewid, 'businessid', {_key('businessid')}, ingested_at FROM place_reviews
    UNION ALL SELECT 'place_events', eventid, 'hostbusinessid', {_key('hostbusinessid')}, ingested_at FROM place_events)
), arrivals AS (
  SELECT place_id AS ref, fetched_at AS arrived FROM places_raw UNION ALL SELECT eventid, ingested_at FROM place_events
  UNION ALL SELECT reviewid, ingested_at FROM place_reviews UNION ALL SELECT localityid, TIMESTAMPTZ '0001-01-01 00:00:00+00' FROM localities
), held AS (SELECT ref, min(arrived) AS first_at, max(arrived) AS last_at FROM arrivals GROUP BY ref
), gone AS (SELECT record_id AS ref, max(deleted_at) AS del FROM tombstones GROUP BY record_id
), judged AS (
  SELECT r.tablename, r.recordid, r.fieldname, r.record_at,
    CASE WHEN h.ref IS NULL THEN 'missing' WHEN g.del > h.last_at THEN 'deleted' WHEN h.first_at > r.record_at THEN 'late' END AS kind
  FROM (SELECT DISTINCT * FROM refs WHERE ref IS NOT NULL AND recordid IS NOT NULL) r LEFT JOIN held h USING (ref) LEFT JOIN gone g USING (ref))
"""

_NUM = r"([+-]?[0-9]+(?:\.[0-9]+)?)"
_PLAIN = rf"^{_NUM}\s*(?:[,;]\s*|\s+){_NUM}$"
_HEMI = r"^([0-9]+(?:\.[0-9]+)?)\s*°?\s*([NS])\s*[,; ]\s*([0-9]+(?:\.[0-9]+)?)\s*°?\s*([EW])$"
_D1 = r"([0-9]+)\s*°\s*([0-9]+(?:\.[0-9]+)?)\s*''\s*([0-9]+(?:\.[0-9]+)?)\s*\"\s*"
_DMS = rf"^{_D1}([NS])[,;\s]*{_D1}([EW])$"


def _places(table: str, key: str) -> str:
    t = "upper(trim(regexp_replace(regexp_replace(coordinates, '^[\\s(\\[]+|[\\s)\\]]+$', '', 'g'), '\\s+', ' ', 'g')))"
    g = lambda rx, i: f"TRY_CAST(regexp_extract(t, '{rx}', {i}) AS DOUBLE)"
    s = lambda rx, i: f"CASE WHEN regexp_extract(t, '{rx}', {i}) IN ('S', 'W') THEN -1 ELSE 1 END"
    dms = lambda i: f"({g(_DMS, i)} + {g(_DMS, i + 1)} / 60 + {g(_DMS, i + 2)} / 3600)"
    lat = f"CASE WHEN regexp_matches(t, '{_PLAIN}') THEN {g(_PLAIN, 1)} WHEN regexp_matches(t, '{_HEMI}') THEN {g(_HEMI, 1)} * {s(_HEMI, 2)} WHEN regexp_matches(t, '{_DMS}') THEN {dms(1)} * {s(_DMS, 4)} END"
    lon = f"CASE WHEN regexp_matches(t, '{_PLAIN}') THEN {g(_PLAIN, 2)} WHEN regexp_matches(t, '{_HEMI}') THEN {g(_HEMI, 3)} * {s(_HEMI, 4)} WHEN regexp_matches(t, '{_DMS}') THEN {dms(5)} * {s(_DMS, 8)} END"
    return (
        f"SELECT DISTINCT id, lat, lon FROM (SELECT id, {lat} AS lat, {lon} AS lon FROM (SELECT {key} AS id, {t} AS t FROM {table})) "
        "WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) AND id IS NOT NULL"
    )


_P6 = f"""
WITH ev AS MATERIALIZED ({_places('place_events', 'eventid')}), mb AS MATERIALIZED ({_places('mb_places', 'mbid')}),
corners AS (
  SELECT localityid, ring, i, TRY_CAST(split_part(trim(c), ' ', 1) AS DOUBLE) AS x, TRY_CAST(split_part(trim(c), ' ', 2) AS DOUBLE) AS y
  FROM (SELECT localityid, ring, unnest(string_split(ring, ',')) AS c, generate_subscripts(string_split(ring, ','), 1) AS i
        FROM (SELECT localityid, unnest(regexp_extract_all(boundary, '\\(([^()]+)\\)', 1)) AS ring FROM localities WHERE boundary IS NOT NULL))
), edges AS MATERIALIZED (
  SELECT a.localityid, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM corners a JOIN corners b
  ON a.localityid = b.localityid AND a.ring = b.ring AND b.i = a.i + 1
)
SELECT DISTINCT 'near' AS kind, least(ev.id, mb.id) AS id_a, greatest(ev.id, mb.id) AS id_b FROM ev, mb
WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(mb.lat - ev.lat) / 2), 2) + cos(radians(ev.lat)) * cos(radians(mb.lat)) * pow(sin(radians(mb.lon - ev.lon) / 2), 2)))) <= 150
UNION ALL
SELECT 'inside', mb.id, e.localityid FROM (SELECT DISTINCT * FROM mb) mb JOIN edges e
ON (e.xa <= mb.lon) <> (e.xb <= mb.lon) AND e.ya + (e.yb - e.ya) * (mb.lon - e.xa) / (e.xb - e.xa) < mb.lat
GROUP BY mb.id, e.localityid HAVING count(*) % 2 = 1
"""

# a document as the sorted list of its paths and values: numbers by value, texts unescaped, keys without a value left out
_P1 = """
WITH one AS (SELECT snapshot_no AS no, track_id AS id, arg_max(fields, meta.version) AS f FROM bundle_points WHERE track_id IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY ALL
), leaves AS (
  SELECT o.no, o.id, t.fullkey || CASE WHEN t.type = 'VARCHAR' THEN '=s' || json_extract_string(t.atom, '$') WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN '=n' || CAST(CAST(t.atom AS DOUBLE) AS VARCHAR)
    WHEN t.type IN ('OBJECT', 'ARRAY') THEN ':' || t.type ELSE '=' || CAST(t.atom AS VARCHAR) END AS leaf
  FROM one o, json_tree(o.f) t WHERE t.type <> 'NULL'
), flat AS (SELECT no, id, list(leaf ORDER BY leaf) AS c FROM leaves GROUP BY no, id
), nos AS (SELECT no, lead(no) OVER (ORDER BY no) AS next FROM (SELECT DISTINCT no FROM one)
), before AS (SELECT nos.next AS no, id, c FROM flat JOIN nos USING (no) WHERE nos.next IS NOT NULL
), now AS (SELECT * FROM flat WHERE no > (SELECT min(no) FROM one)
), changes AS (
  SELECT coalesce(n.no, b.no) AS snapshot_no, coalesce(n.id, b.id) AS track_id, CASE WHEN b.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM now n FULL JOIN before b ON n.no = b.no AND n.id = b.id WHERE b.id IS NULL OR n.id IS NULL OR n.c <> b.c)
"""

SQL = {
    "p1_found": _P1 + "SELECT * FROM changes",
    "p1_counts": _P1 + "SELECT snapshot_no, change, count(*) AS n FROM changes GROUP BY ALL",
    "p6_found": _P6,
    "p7_found": _P7 + "SELECT DISTINCT tablename, recordid, fieldname, kind FROM judged WHERE kind IS NOT NULL",
    "p7_report": _P7
    + "SELECT tablename, fieldname, kind, strftime(record_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM (SELECT DISTINCT * FROM judged WHERE kind IS NOT NULL) GROUP BY ALL",
}
