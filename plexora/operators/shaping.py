"""Shapes of results: provenance, hits, role accessors, summaries and categories, as expressions over records.

A record is a row with id, entity_type, fields (VARIANT), owner and meta (a struct); a role map names the field of each
role and is part of the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.functions.text import document_text


def _get(fields: Column, name: str, kind: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(fields, f"$['{quoted}']", kind)


def _is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def scalar(fields: Column, name: str | None) -> Column:
    """A field's text, trimmed; null if it is missing, blank or no text."""
    if name is None:
        return F.lit(None).cast("string")
    v = _get(fields, name, "variant")
    return F.when(_is_text(v), _filled(_get(fields, name, "string")))


def members(fields: Column, name: str) -> Column:
    """A field's filled members as texts: those of a list, or a scalar as the only one; none for a missing field."""
    v = _get(fields, name, "variant")
    one = F.try_variant_get(v, "$", "string")
    some = F.when(_is_list(v), F.try_variant_get(v, "$", "array<string>")).when(one.isNotNull(), F.array(one))
    return F.filter(F.coalesce(some, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def flatten_handle(fields: Column, name: str) -> Column:
    """A field as text; of a declared object handle its uri."""
    v = _get(fields, name, "variant")
    return F.when(F.try_variant_get(v, "$['@type']", "string") == "handle", F.try_variant_get(v, "$.uri", "string")).otherwise(F.try_variant_get(v, "$", "string"))


def iso_utc(seconds: Column) -> Column:
    """ISO text of a number of seconds since 1970, in UTC; null for none and for 0."""
    return F.when(seconds != 0, F.concat(F.date_format(F.timestamp_seconds(seconds).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def provenance(meta: Mapping[str, Column], owner: Column) -> Column:
    """struct<source_cid, published, version, publisher>: the source's id before the manifest's, the publisher named by
    the record's meta before its owner; blanks count as missing. meta: source_cid, manifest_cid, seconds, version, owner."""
    return F.struct(
        F.coalesce(_filled(meta["source_cid"]), _filled(meta["manifest_cid"])).alias("source_cid"), iso_utc(meta["seconds"]).alias("published"),
        meta["version"].alias("version"), F.coalesce(_filled(meta["owner"]), _filled(owner)).alias("publisher"),
    )


def results(records: DataFrame, meta: Mapping[str, Column], places: int = 6) -> DataFrame:
    """id, entity_type, fields, provenance and, where there is one, the score rounded to `places` (6; hits of the service
    have 4)."""
    score = [F.round("score", places).alias("score")] if "score" in records.columns else []
    return records.select("id", "entity_type", "fields", provenance(meta, F.col("owner")).alias("provenance"), *score)


# -- role accessors ---------------------------------------------------------------------------------------------------


def title(fields: Column, roles: Mapping[str, Any], fallback: Column) -> Column:
    return F.coalesce(scalar(fields, roles.get("title")), fallback)


def subtitle(fields: Column, roles: Mapping[str, Any]) -> Column:
    return F.coalesce(scalar(fields, roles.get("subtitle")), F.lit(""))


def tags(fields: Column, roles: Mapping[str, Any]) -> Column:
    """The members of all tag fields, one field after the other."""
    lists = [members(fields, f) for f in roles.get("tags") or ()]
    return F.concat(*lists) if lists else F.array().cast("array<string>")


def tags_of_field(fields: Column, roles: Mapping[str, Any], i: int, most: int | None = None) -> Column:
    """The members of the i-th tag field, all or the first `most`."""
    names = roles.get("tags") or ()
    out = members(fields, names[i]) if i < len(names) else F.array().cast("array<string>")
    return out if most is None else F.slice(out, 1, most)


#: Keys that give a coordinate, in the order in which they are looked for, and those of a box.
LON_KEYS, LAT_KEYS = ("lon", "lng", "longitude", "x"), ("lat", "latitude", "y")
BOX_KEYS = (("min_lon", "max_lon"), ("min_lat", "max_lat"))


def spatial(fields: Column, roles: Mapping[str, Any]) -> Column:
    """struct<lon, lat> of the spatial field: its own pair, else the middle of its box; null without either. Keys count
    whatever their case."""
    name = roles.get("spatial")
    if name is None:
        return F.lit(None).cast("struct<lon: double, lat: double>")
    low = F.transform_keys(F.coalesce(_get(fields, name, "map<string, double>"), F.create_map().cast("map<string, double>")), lambda k, _: F.lower(k))
    first = lambda keys: F.coalesce(*[low[k] for k in keys])
    lon, lat = first(LON_KEYS), first(LAT_KEYS)
    mid = [(low[a] + low[b]) / 2 for a, b in BOX_KEYS]
    own = lon.isNotNull() & lat.isNotNull()
    x, y = F.when(own, lon).otherwise(mid[0]), F.when(own, lat).otherwise(mid[1])
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("lon"), y.alias("lat")))


def document(fields: Column, roles: Mapping[str, Any], text_fields: bool = True) -> Column:
    """The document to embed, composed over a role map: title, text tags, subtitle, texts."""
    texts = [scalar(fields, f) for f in roles.get("text") or ()] if text_fields else []
    return document_text(title(fields, roles, F.lit("")), F.array_join(tags(fields, roles), ", "), subtitle(fields, roles), texts)


# -- summaries --------------------------------------------------------------------------------------------------------


def secondary_line(entity_type: Column, fields: Column, roles: Mapping[str, Any]) -> Column:
    """One line below the title: of events the day (marked if past) and the place; else byline, first tag and date."""
    when = F.coalesce(scalar(fields, "dateLabel"), scalar(fields, "startDate"))
    past = F.coalesce(_get(fields, "isPast", "boolean"), F.lit(False))
    event = F.concat_ws(" · ", F.when(past, F.concat(when, F.lit(" (past)"))).otherwise(when), F.coalesce(scalar(fields, "venueName"), scalar(fields, "locality")))
    first = [F.get(tags_of_field(fields, roles, 0), F.lit(0))] if roles.get("tags") else []
    other = F.concat_ws(" · ", scalar(fields, roles.get("subtitle")), *first, scalar(fields, roles.get("temporal")))
    return F.when(entity_type == "Event", event).otherwise(other)


def primary_tags(fields: Column, roles: Mapping[str, Any]) -> Column:
    """The first tag field's members; a text is split at its commas."""
    names = roles.get("tags") or ()
    if not names:
        return F.array().cast("array<string>")
    v = _get(fields, names[0], "variant")
    cut = F.filter(F.transform(F.split(_get(fields, names[0], "string"), ","), F.trim), lambda x: x != "")
    return F.when(_is_text(v), cut).otherwise(members(fields, names[0]))


def summaries(records: DataFrame, roles: Mapping[str, Any]) -> DataFrame:
    """id, entity_type ("Unknown" if missing), title (else the id), line and tags of each record."""
    f = F.col("fields")
    kind = F.coalesce(F.col("entity_type"), F.lit("Unknown"))
    return records.select("id", kind.alias("entity_type"), title(f, roles, F.col("id")).alias("title"), secondary_line(kind, f, roles).alias("line"), primary_tags(f, roles).alias("tags"))


def connection_fields(fields: Column, roles: Mapping[str, Any], hidden: Sequence[str] = ()) -> Column:
    """Names of the fields that are non-empty lists, but for tags and hidden ones, in order."""
    away = [*(roles.get("tags") or ()), *hidden]
    listed = F.filter(F.json_object_keys(F.to_json(fields)), lambda k: ~k.isin(*away) if away else F.lit(True))
    whole = F.from_json(F.to_json(fields), "map<string, string>")
    return F.array_sort(F.filter(listed, lambda k: F.coalesce(whole[k].startswith("[") & (whole[k] != "[]"), F.lit(False))))


def map_track(records: DataFrame, roles: Mapping[str, Any], most: int = 3) -> DataFrame:
    """id, title, artist, genres, moods, px, py: what the map shows of a record; up to `most` of each kind of tag."""
    f = F.col("fields")
    return records.select(
        "id", title(f, roles, F.col("id")).alias("title"), subtitle(f, roles).alias("artist"), tags_of_field(f, roles, 0, most).alias("genres"),
        tags_of_field(f, roles, 1, most).alias("moods"), "px", "py",
    )


def category(entity_type: Column, fields: Column) -> Column:
    """What a point is: its primary type, else its first category, else "event" or "place"; blanks for underscores."""
    first = F.get(members(fields, "categories"), F.lit(0))
    return F.regexp_replace(F.coalesce(scalar(fields, "primaryType"), first, F.when(entity_type == "Event", "event").otherwise("place")), "_", " ")
