"""Versioned transition tables of time zones, and vectorised conversion of local times through them."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from importlib import metadata
from zoneinfo import ZoneInfo

import numpy as np

#: Years that a table spans; moments outside use the first or last offset.
FIRST_YEAR, LAST_YEAR = 1900, 2100


def table_version() -> str:
    """The release of the time-zone data that the tables are made from."""
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "system"


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone: offset[i] seconds hold from the UTC second at[i] on; at[0] is the beginning of time."""

    name: str
    at: np.ndarray
    offset: np.ndarray
    abbreviations: dict[str, int]

    def to_utc(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of local seconds, and whether the local time exists. Of two moments the earlier one is given."""
        # of the candidate offsets (before and after each transition) the earliest moment that maps back is right
        best = np.full(local.shape, np.iinfo(np.int64).max)
        found = np.zeros(local.shape, bool)
        i = np.searchsorted(self.at, local, "right") - 1
        for step in (-2, -1, 0, 1, 2):
            j = np.clip(i + step, 0, len(self.at) - 1)
            utc = local - self.offset[j]
            k = np.searchsorted(self.at, utc, "right") - 1
            ok = (k == j) & (utc < best)
            best[ok] = utc[ok]
            found |= ok
        return best, found


def _offset(z: ZoneInfo, second: int) -> tuple[int, str]:
    t = datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=second)
    t = t.astimezone(z)
    return int(t.utcoffset().total_seconds()), t.tzname() or ""


@functools.lru_cache(maxsize=None)
def zone_table(name: str) -> ZoneTable | None:
    """The table of an IANA zone; None if there is no such zone. Transitions are found by bisection to the second."""
    try:
        z = ZoneInfo(name)
    except Exception:
        return None
    lo = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    hi = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    abbr: dict[str, int] = {}
    modern = int(datetime(1970, 1, 1, tzinfo=timezone.utc).timestamp())
    cur, tag = _offset(z, lo)
    at, off = [np.iinfo(np.int64).min // 2], [cur]
    step = 7 * 86400
    for t in range(lo, hi, step):
        nxt, tag2 = _offset(z, t + step)
        if t + step >= modern and tag2.isalpha():
            abbr[tag2.upper()] = nxt
        if (nxt, tag2) == (cur, tag):
            continue
        a, b = t, t + step
        while b - a > 1:
            m = (a + b) // 2
            if _offset(z, m) == (cur, tag):
                a = m
            else:
                b = m
        if nxt != cur:
            at.append(b)
            off.append(nxt)
        cur, tag = nxt, tag2
    return ZoneTable(name, np.array(at, np.int64), np.array(off, np.int64), abbr)


#: Offsets in hours of zone abbreviations, for records whose own zone doesn't have them.
COMMON_ABBREVIATIONS = {
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8,
    "HST": -10, "BST": 1, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5,
    "JST": 9, "KST": 9, "AEST": 10, "AEDT": 11, "ACST": 9.5, "ACDT": 10.5, "AWST": 8, "NZST": 12, "NZDT": 13,
}


def abbreviation_offset(word: str, zone: str | None) -> int | None:
    """Seconds of a zone abbreviation: of the record's own zone first, else the common meaning."""
    if word in ("UTC", "GMT", "Z", "UT"):
        return 0
    if zone and (t := zone_table(zone)) and word in t.abbreviations:
        return t.abbreviations[word]
    h = COMMON_ABBREVIATIONS.get(word)
    return None if h is None else int(h * 3600)
