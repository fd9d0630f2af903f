from datetime import datetime as D
import json

import pytest

from plexora.llm import addresses as A
from plexora.llm import linkage as K
from plexora.llm.names import name_level, normal

TOWNS = [("Nesselleigh", "Hollin", "HQ", "19317"), ("Kelverbury", "Ostrell Plain", "OQ", "52077"), ("Marlindorp", "Norvale", "NQ", "10355")]
G = A.Gazetteer.of(TOWNS)


@pytest.mark.parametrize(
    "text, want",
    [
        ("348 Zinniaings Circle, Suite 51, Nesselleigh, HQ 19317", ("348", "51", "", "zinniaings", "circle", "nesselleigh")),
        ("348 zinniaings cir - #51 - nesselleigh - hq 19317-0001", ("348", "51", "", "zinniaings", "circle", "nesselleigh")),
        ("Apt 51, 348 Zinniaings Cir\n19317", ("348", "51", "", "zinniaings", "circle", "nesselleigh")),
        ("402 Anchorlea Trl South Marlindrop", ("402", "", "s", "anchorlea", "trail", "marlindorp")),
        ("4802 North Norrelfirth Pky, Kelverbury, Ostrell Plain", ("4802", "", "n", "norrelfirth", "parkway", "kelverbury")),
        ("Yulepike-Gasse 128,D-52077 Kelverbury", ("128", "", "", "yulepike", "gasse", "kelverbury")),
        ("52077 Kelverbury - 128 Yulepikegasse", ("128", "", "", "yulepike", "gasse", "kelverbury")),
        ("Yulepikeg. Nr. 128, Kelverbury", ("128", "", "", "yulepike", "gasse", "kelverbury")),
        ("Eldergarthstraße 114 Kelverbury", ("114", "", "", "eldergarth", "street", "kelverbury")),
        ("10355,30 HAZELNOTCH COURT", ("30", "", "", "hazelnotch", "court", "marlindorp")),
        ("7404 Ibexmere, Marlindorp", ("7404", "", "", "ibexmere", "", "marlindorp")),
    ],
)
def test_parse(text, want):
    p = A.parse(text, G)
    assert tuple(getattr(p, c) for c in A.FORM) == want


def test_damerau():
    assert A.damerau("ab", "ba") == 1 and A.damerau("abc", "abc") == 0 and A.damerau("abcd", "badc") == 2 and A.damerau("kitten", "sitting", 3) == 3 and A.damerau("a", "abcdef", 2) == 3


def tables(spark):
    loc = spark.createDataFrame(TOWNS + [(None, None, None, None)], "title string, region string, regioncode string, postcode string")
    pay = lambda a, name=None, lat=None: json.dumps({"formattedAddress": a, "displayName": {"text": name}, "location": {"latitude": lat, "longitude": 10.0} if lat else None})
    pl = spark.createDataFrame(
        [
            ("p1", D(2025, 1, 1), pay("1 Old Road, Marlindorp"), 0), ("p1", D(2025, 2, 1), pay("12 Elm Street, Suite 3, Marlindorp, NQ 10355", "Blue Otter Grill", 45.0), 0),
            ("p2", D(2025, 1, 1), pay("12 Elm St #3 Marlindorp", "Red Fox Bakery", 45.0), 0), ("p3", D(2025, 1, 1), pay("12 Elm Street, Suite 4, Marlindorp"), 0),
            ("p4", D(2025, 1, 1), pay("99 Oakwold Lane, Kelverbury", "Lone Pine Lodge", 46.0), 0), ("p5", D(2025, 1, 1), pay("99 Oakwold Court, Kelverbury", None, 46.01), 0),
            ("p6", D(2025, 1, 1), pay(None, "Silver Oar Tavern", 47.0), 0), ("p7", D(2025, 1, 1), '{"formattedAddress": "12 El', 0), (None, D(2025, 1, 1), pay("12 Elm Street"), 0),
        ],
        "place_id string, fetched_at timestamp, payload string, title int",
    )
    ev = spark.createDataFrame(
        [
            ("e1", None, "Blue Oter Grill", "12 Eml Street Unit 3, 10355", "45.0001,10.0001", "Marlindorp", D(2025, 1, 1)),
            ("e1", None, "Blue Oter Grill", "12 Eml Street Unit 3, 10355", "45.0001,10.0001", "Marlindorp", D(2025, 1, 2)),
            ("e2", "n/a", "Lone Pine", "99 Oakwold, Kelverbury", None, None, D(2025, 1, 1)), ("e3", "-", "Green Crow Cafe", "12 Elm St, Ste 3, Marlindorp", None, None, D(2025, 1, 1)),
            ("e4", "p1", "Blue Otter Grill", "12 Elm St, Ste 3, Marlindorp", None, None, D(2025, 1, 1)), ("e5", None, "Silver Oar", " ", "47.0,10.0", None, D(2025, 1, 1)),
            ("e6", None, "Blue Otter Grill", None, "0,0", "Marlindorp", D(2025, 1, 1)), (None, None, "x", "12 Elm Street", None, None, D(2025, 1, 1)), ("e7", " ", None, "Elm Street, Marlindorp", None, None, D(2025, 1, 1)),
        ],
        "eventid string, hostbusinessid string, hostbusinessname string, address string, coordinates string, locality string, ingested_at timestamp",
    )
    return ev, pl, loc


def test_same_locations(spark, rows):
    ev, pl, loc = tables(spark)
    # e2 has no street type and two places differ only in it, so it isn't known which is meant
    assert rows(A.same_locations(ev, pl, loc)) == [("e1", "p1"), ("e1", "p2"), ("e3", "p1"), ("e3", "p2"), ("e4", "p1"), ("e4", "p2"), ("p1", "p2")]
    assert A.same_locations(ev.limit(0), pl.limit(0), loc).count() == 0


def test_misspelt(spark):
    from pyspark.sql import functions as F

    pairs = [("russetfield", "russtefield"), ("russtefield", "russetfiedl"), ("amberhythe", "amberthorpe"), ("wagongate", "wagonmill"), ("elm", "emu"), ("abmerhythe", "amberhytthe"), ("same", "same")]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(A.misspelt(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False, False, False, True, False]


def test_names():
    n = lambda a, b, t="": name_level(normal(a, t), normal(b, t))
    assert n("Badger  & Loon Roadhouse LLC", "badger and loon roadhouse") == 4
    assert n("Wandering Anchor Outfitters, Corvelhaven", "Wandering Anchor Outfitters", "corvelhaven") == 4
    assert n("Nimble Wagon Bowlnng Alley", "Nimble Wagon Bowling Lanes") == 3 and n("Copper Clover Bar & Grill", "Copper Clover Grill") == 4
    assert n("Wgon &", "Wagon & Otter Cafe") == 2 and n("Merry Mitten", "The Merry Mitten Bowling Lanes") == 2
    assert n("Ostergard’s Taproom", "Ostergard's Bakery") == 1 and n("Blue Fox", "Red Owl") == 0 and n(None, "x") == -1 and n("", "x") == -1


def test_expectation_maximisation_tells_kinds_apart():
    counts = {(4, 4, 3): 500, (3, 4, 3): 80, (2, 4, 3): 50, (0, 4, 3): 300, (0, 1, 1): 4000, (1, 1, 0): 800, (-1, 4, 3): 60, (4, -1, 3): 90, (0, -1, 2): 200}
    m = K.expectation_maximisation(counts)
    assert m.log_odds((4, 4, 3)) > 2 and m.log_odds((2, 4, 3)) > 1 and m.log_odds((0, 4, 3)) < -3 and m.log_odds((4, 1, 0)) < 0 and m.log_odds((0, 1, 1)) < -3
    assert abs(m.shares.sum() - 1) < 1e-9 and K.expectation_maximisation({}).shares.sum() == pytest.approx(1)


def test_hosts(spark, monkeypatch):
    ev, pl, loc = tables(spark)
    # the small fixture can't fit a model, so the one of a larger table's counts is used
    counts = {(4, 4, 3): 500, (3, 4, 3): 80, (2, 4, 3): 50, (0, 4, 3): 300, (0, 1, 1): 4000, (1, 1, 0): 800, (-1, 4, 3): 60, (4, -1, 3): 90, (0, -1, 2): 200, (2, 4, -1): 30, (4, 4, -1): 200, (2, -1, 3): 30}
    fitted = K.expectation_maximisation(counts)
    monkeypatch.setattr(K, "expectation_maximisation", lambda c: fitted)
    got = {r["eventid"]: r["place_id"] for r in K.hosts_of_events(ev, pl, loc).collect()}
    assert got["e1"] == "p1" and got["e2"] == "p4" and got["e5"] == "p6" and not {"e3", "e4", "e6", "e7"} & set(got)
    assert K.hosts_of_events(ev.limit(0), pl, loc).count() == 0
