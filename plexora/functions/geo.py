"""Coordinates: parsing of many notations, great-circle distances and grid cells, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in metres.
EARTH_M = 6_371_000.0

_NUM = r"([+-]?\d+(?:\.\d+)?)"
_PLAIN = rf"^{_NUM}\s*(?:[,;]\s*|\s+){_NUM}$"
_HEMI = r"^(\d+(?:\.\d+)?)\s*°?\s*([NS])\s*[,; ]\s*(\d+(?:\.\d+)?)\s*°?\s*([EW])$"
_MARK = "['′’]"
_SECS = "(?:\"|″|”|'')"
_DMS1 = rf"(\d+)\s*°\s*(?:(\d+(?:\.\d+)?)\s*{_MARK})?\s*(?:(\d+(?:\.\d+)?)\s*{_SECS})?\s*"
_DMS = rf"^{_DMS1}([NS])[,;\s]*{_DMS1}([EW])$"


def _d(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def latlon(text: Column) -> Column:
    """struct<lat, lon> of a coordinate text, latitude first; null where it isn't usable.

    Read are decimal pairs parted by comma, semicolon or blanks, optionally in brackets; decimals with N/S and E/W; and
    degrees, minutes and seconds. A latitude beyond 90, a longitude beyond 180 and 0,0 aren't usable.
    """
    t = F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, r"^[\s(\[]+|[\s)\]]+$", ""), r"\s+", " ")))

    def read(s: Column) -> Column:
        g = lambda rx, i: F.regexp_extract(s, rx, i)
        part = lambda i, by: F.coalesce(_d(g(_DMS, i)), F.lit(0.0)) / by
        dms = lambda i: _d(g(_DMS, i)) + part(i + 1, 60) + part(i + 2, 3600)
        sign = lambda rx, i: F.when(g(rx, i).isin("S", "W"), -1.0).otherwise(1.0)
        pair = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
        return (
            F.when(s.rlike(_PLAIN), pair(_d(g(_PLAIN, 1)), _d(g(_PLAIN, 2))))
            .when(s.rlike(_HEMI), pair(_d(g(_HEMI, 1)) * sign(_HEMI, 2), _d(g(_HEMI, 3)) * sign(_HEMI, 4)))
            .when(s.rlike(_DMS), pair(dms(1) * sign(_DMS, 4), dms(5) * sign(_DMS, 8)))
        )

    ok = lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180) & ((p["lat"] != 0) | (p["lon"] != 0))
    # the cleaned text is bound once as a lambda's variable; written out, it would be evaluated for every part
    return F.get(F.filter(F.transform(F.array(t), read), ok), F.lit(0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


def sphere_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Place on the sphere in metres: no seam at the date line, no narrowing at the poles."""
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o) * EARTH_M, F.cos(a) * F.sin(o) * EARTH_M, F.sin(a) * EARTH_M


def cube_cell(lat: Column, lon: Column, size_m: float) -> Column:
    """The cube of the grid in space that a point lies in, as one number per cube."""
    ix, iy, iz = (F.floor(c / size_m) for c in sphere_xyz(lat, lon))
    return F.xxhash64(ix, iy, iz)


def cube_cells_near(lat: Column, lon: Column, size_m: float, radius_m: float) -> Column:
    """All cubes that a point's surroundings of radius_m touch; with size_m > 2 * radius_m at most 8, mostly 2 to 4."""
    r = radius_m * (1 + 1e-9) + 1e-3
    axes = [F.sequence(F.floor((c - r) / size_m), F.floor((c + r) / size_m)) for c in sphere_xyz(lat, lon)]
    return F.flatten(
        F.transform(
            axes[0], lambda x: F.flatten(F.transform(axes[1], lambda y: F.transform(axes[2], lambda z: F.xxhash64(x, y, z))))
        )
    )
