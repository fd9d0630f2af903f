import pytest

from plexora.operators import moments as M

PROSE = "music with friends in the garden, 3 bands and 12 poets; coffee (free) - doors open early " * 3


def read(values, zone="America/Chicago", year=2025):
    n = len(values)
    return M.utc_texts(M.convert(values, [zone] * n, [year] * n, None))


@pytest.mark.parametrize("around", [(" " * 121, "\n"), ("", " . " + PROSE), (PROSE + "| ", ""), ("é" * 5_000 + "\n", " ." + " x1" * 5_000)])
def test_long_values_read_as_short_ones(around):
    short = [
        "2025-07-25T21:00:59-06:00", "2025-02-06T17:45:01.828583217Z", "24.06.2026 21:00", "1/26/2026 8:45 PM", "1/26/26 8:45 PM",
        "Fri, 04 Sep 2026 22:45:00 -0500", "Saturday, 25 January 2025, 19:15 Uhr", "Doors 12:00 AM, Sun 6 Apr", "2025-01-01T101112 ",
        "Tue, Oct 21 · 6:15 PM – 8:15 PM CST", "2026-09-23 19:15:59 UTC+05:30", "2025-11-02 01:30", "2025-03-09 02:30", "2025-10-05",
        "June 3, 2025 at 9:00pm", "June 4, 2025 at 9:00pm", "2025-01-01T1011 ",
    ]
    want = read(short)
    assert want[0] == "2025-07-26T03:00:59Z" and want.count(None) == 2
    long = [around[0] + v + around[1] for v in short]
    assert min(map(len, long)) > M.MAX_LENGTH
    assert read(long) == want
    assert read(short[:3] + long + short[3:]) == want[:3] + want + want[3:]


def test_long_numbers_and_texts_without_a_moment():
    pad = " " * 200
    assert read([pad + "1742427900", pad + "1748354459757" + pad, pad + "20251005T231500" + pad]) == [
        "2025-03-19T23:45:00Z", "2025-05-27T14:00:59Z", "2025-10-06T04:15:00Z",
    ]
    assert read(["9" * 22, "9" * 10_000, PROSE, pad]) == [None] * 4
    assert read(["0" * 10_000 + "1742427900000000000"]) == ["2025-03-19T23:45:00Z"]


def test_many_clocks_before_the_offset():
    v = "2025-06-03 11:00 UTC+02:00 " + "z+10:00 " * 20_000
    assert read([v]) == ["2025-06-03T09:00:00Z"]


def test_queries_read_values_of_any_length(spark, rows):
    ev = spark.createDataFrame(
        [("e1", None, "Town", "2025-06-01", "2025-06-01 10:00" + " " * 105, "Sat 7 Jun, doors 8:45 PM EDT . " + PROSE)],
        "eventid string, timezone string, locality string, startdate string, enddate string, datelabel string",
    )
    loc = spark.createDataFrame([("Town", "Europe/Berlin")], "title string, timezone string")
    assert rows(M.event_moments(ev, loc)) == [
        ("place_events", "e1", "datelabel", "2025-06-08T00:45:00Z"), ("place_events", "e1", "enddate", "2025-06-01T08:00:00Z"),
    ]
    rv = spark.createDataFrame([("r1", PROSE + "2025-02-06T17:45:01Z")], "reviewid string, publishtime string")
    assert rows(M.review_moments(rv)) == [("place_reviews", "r1", "publishtime", "2025-02-06T17:45:01Z")]
