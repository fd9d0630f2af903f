from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from plexora.functions.zones import zone_table
from plexora.operators import moments as M


def one(value, zone="America/Chicago", year=2025):
    return M.utc_texts(M.convert([value], [zone], [year]))[0]


@pytest.mark.parametrize(
    "value, utc",
    [
        ("2025-07-25T21:00:59-06:00", "2025-07-26T03:00:59Z"),
        ("2025-02-06T17:45:01.828583217Z", "2025-02-06T17:45:01Z"),
        ("20251005T231500", "2025-10-06T04:15:00Z"),
        ("1742427900", "2025-03-19T23:45:00Z"),
        ("1748354459757", "2025-05-27T14:00:59Z"),
        ("1733236986878746", "2024-12-03T14:43:06Z"),
        ("24.06.2026 21:00", "2026-06-25T02:00:00Z"),
        ("1/26/2026 8:45 PM", "2026-01-27T02:45:00Z"),
        ("Fri, 04 Sep 2026 22:45:00 -0500", "2026-09-05T03:45:00Z"),
        ("28 September 2025, 1:00pm", "2025-09-28T18:00:00Z"),
        ("WED | JUN 24 2026 | 7:30 PM (GMT-05:00)", "2026-06-25T00:30:00Z"),
        ("Saturday, 25 January 2025, 19:15 Uhr", "2025-01-26T01:15:00Z"),
        ("19. February 2026 um 18.15", "2026-02-20T00:15:00Z"),
        ("Doors 12:00 AM, Sun 6 Apr", "2025-04-06T05:00:00Z"),
        ("Tue, Oct 21 · 6:15 PM – 8:15 PM CST", "2025-10-22T00:15:00Z"),
        ("September 16th, 5:30–7:30pm", "2025-09-16T22:30:00Z"),
        ("2026-09-23 19:15:59 UTC+05:30", "2026-09-23T13:45:59Z"),
        ("2025-11-02 01:30", "2025-11-02T06:30:00Z"),  # twice: the earlier
        ("2025-03-09 02:30", None),  # never
        ("2025-10-05", None),
        ("October 2024", None),
        ("yesterday", None),
        ("", None),
        (None, None),
        ("2025-02-30 10:00", None),
        ("2025-02-03 13:00 PM", None),
        ("x" * 10_000 + "2025-01-01 10:00", None),
    ],
)
def test_shapes(value, utc):
    assert one(value) == utc


def test_abbreviations_are_the_zones_own():
    assert one("Starts 6/3/25 11:00 IST", "Asia/Kolkata") == "2025-06-03T05:30:00Z"
    assert one("2025-06-03 11:00", None) is None
    assert one("2025-06-03 11:00", "No/Where") is None
    assert one("2025-06-03 11:00 UTC", None) == "2025-06-03T11:00:00Z"


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Pacific/Auckland", "Asia/Kolkata", "America/Phoenix"])
def test_transition_tables_against_the_library(name):
    z, t = ZoneInfo(name), zone_table(name)
    rng = np.random.default_rng(1)
    local = rng.integers(0, 2**31, 4000)
    utc, ok = t.to_utc(local)
    for s, u, found in zip(local.tolist(), utc.tolist(), ok.tolist()):
        naive = datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
        want = naive.replace(tzinfo=z)
        back = want.astimezone(timezone.utc).astimezone(z).replace(tzinfo=None)
        assert found == (back == naive)
        if found:
            assert u == int(want.timestamp())


def test_events_use_the_locality(spark, rows):
    ev = spark.createDataFrame(
        [("e1", None, "Town", "2025-06-01", "2025-06-01 10:00", None, "x"), ("e1", None, "Town", "2025-06-01", "2025-06-01 10:00", None, "y"), ("e2", None, "Nowhere", None, "2025-06-01 10:00", "2025-06-01 @ 3:00 PM UTC", "x"), (None, "UTC", "Town", None, "2025-06-01 10:00", None, "x")],
        "eventid string, timezone string, locality string, startdate string, enddate string, datelabel string, title string",
    )
    loc = spark.createDataFrame([("Town", "Europe/Berlin"), (None, "UTC")], "title string, timezone string")
    got = rows(M.event_moments(ev, loc))
    assert got == [("place_events", "e1", "enddate", "2025-06-01T08:00:00Z"), ("place_events", "e2", "datelabel", "2025-06-01T15:00:00Z")]
    assert M.event_moments(ev.limit(0), loc).count() == 0
