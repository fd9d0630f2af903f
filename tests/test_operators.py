import json
import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexora.functions import embedding, identity, text
from plexora.functions import vectors as V
from plexora.operators import discover, flow, mapping, matching, quality, roles, search, sets


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, [0.0] * 16)], "id int, embedding array<double>")
    got = {r["id"]: r["m"] for r in df.select("id", V.matryoshka(F.col("embedding"), 4).alias("m")).collect()}
    for i, v in enumerate(x):
        w = ((v - v.mean()) / np.sqrt(v.var() + 1e-5))[:4]
        assert np.allclose(got[i], w / np.linalg.norm(w))
    assert got[9] == [0.0] * 4
    top = search.top_k(df, x[2].tolist(), 2)
    assert top.first()["id"] == 2 and top.count() == 2
    assert search.recommend(df, 2, 10).where("id = 2").count() == 0 and search.recommend(df, 77, 10).count() == 0
    assert search.top_k(df.limit(0), [1.0] * 16, 3).count() == 0


def test_session():
    s = search.build_session([([1.0, 0.0], ["a"]), ([0.0, 1.0], ["b"])], [([5.0, 5.0], ["a"])])
    assert s.top_tags == ["b", "a"] and s.skip == [5.0, 5.0] and s.skip_radius == 0
    assert abs(s.taste["a"] - (1 / math.log(3) - 0.6)) < 1e-12
    assert search.session_query(search.build_session([], [])) is None
    q = search.session_query(s)
    assert q[1] > q[0]


def test_flow_metrics(spark):
    ring = [("R", 1.0, "a" if i % 2 else "b", "b" if i % 2 else "a", 100 + 10 * i, f"t{i}") for i in range(6)]
    organic = [("O", float(i + 1), f"s{i}", f"d{i}", int(i**3 * 7), f"o{i}") for i in range(5)]
    few = [("F", None, None, "x", None, "f0")]
    df = spark.createDataFrame(ring + organic + few, "symbol string, value double, src string, dst string, ts int, id string")
    m = {r["symbol"]: r for r in flow.flow_metrics(df).collect()}
    r, o, f = m["R"], m["O"], m["F"]
    assert (r["circularity"], r["quantization"], r["interarrival_cv"], r["sender_hhi"], r["data_quality"]) == (1.0, 1.0, 0.0, 0.5, "suspect")
    assert (o["circularity"], o["senders"], o["counterparties"]) == (0.0, 5, 10)
    assert f["data_quality"] == "sparse" and f["circularity"] is None and f["manipulation_score"] is None
    assert flow.flow_metrics(df.limit(0)).count() == 0


def test_freshness(spark):
    a = spark.createDataFrame([(100, 95, 1000), (100, 90, 950), (90, None, None)], "observed_head int, activity_block int, activity_at int")
    t = spark.createDataFrame([(95, 1000), (85, 900)], "block int, ts int")
    r = flow.freshness(a, t, 5000).first()
    assert (r["head"], r["newest_block"], r["lag_blocks"], r["sec_per_block"], r["lag_seconds"]) == (100, 95, 5, 10.0, 50.0)
    assert (r["age_1h"], r["age_24h"], r["age_none"]) == (0, 2, 1)


def test_ratings_and_tiers(spark):
    df = spark.createDataFrame([(1, 4.9, 60), (2, 4.6, 3000), (3, 5.0, 2), (4, None, 5), (5, 4.5, 0)], "id int, r double, n int")
    got = {r["id"]: r["s"] for r in df.select("id", quality.rating_signal(F.col("r"), F.col("n")).alias("s")).collect()}
    assert got[1]["tier"] == "hidden-gem" and got[2]["tier"] == "crowd-favorite" and got[3]["tier"] is None and got[4] is None and got[5] is None
    t = spark.createDataFrame([("x", "A", 0, "mid", 1), ("x", "A", 0, "mid", 2), ("y", "A", 0, "mid", 3), ("z", "A", 0, "low", 4), ("w", "B", 99999, "high", 5)], "id string, artist string, popularity int, tier string, ordinal int")
    assert [r["id"] for r in quality.assemble(t, 10, 1, 2).orderBy("place").collect()] == ["w", "x", "y"]


def test_sets(spark, rows):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "z", 5), (3, "c", 6), (3, "d", 4), (None, "n", 7)], "k int, v string, o int")
    assert rows(sets.merge_keep_order(old, new, ["k"], "o").select("k", "v")) == rows(spark.createDataFrame([(1, "a"), (2, "b"), (3, "d"), (None, "n")], "k int, v string"))
    assert rows(sets.merge_keep_order(sets.merge_keep_order(old, new, ["k"], "o"), new, ["k"], "o")) == rows(sets.merge_keep_order(old, new, ["k"], "o"))
    assert rows(sets.delta(old.select("k", "v"), new.where("k IS NOT NULL").where("o <> 4").select("k", "v"), "k", "v")) == [(2, "updated"), (3, "new")]
    tree = "content_id string, uri string, ordinal int"
    d = sets.tree_diff(spark.createDataFrame([("a", "pa", 0), ("b", "pb", 1)], tree), spark.createDataFrame([("b", "cb", 0), ("c", "cc", 1), ("c", "cx", 2)], tree))
    assert rows(d) == [("a", "pa", 0, "removed"), ("c", "cc", 1, "added")]
    m = spark.createDataFrame(
        [("t1", '{"kind":"record-set","entries":[{"fields":{"dataCid":"d1","contentId":"c1"}},{"fields":{"dataCid":"d2"}},{"fields":{}}]}'), ("t2", '{"version":3,"nodeChunks":[{"dataCid":"n"}],"edgeChunk":{"dataCid":"e"}}'), ("t3", '{"kind":"view","viewChunk":{"dataCid":"v"}}'), ("t4", '{"kind":"linkset","linkChunks":[{"dataCid":"l"}]}'), ("t5", "{}")],
        "tree string, j string",
    ).withColumn("manifest", F.parse_json("j"))
    assert rows(sets.blob_refs(m).select("tree", "content_id", "uri")) == [("t1", "c1", "d1"), ("t1", "d2", "d2"), ("t2", "e", "e"), ("t2", "n", "n"), ("t3", "v", "v"), ("t4", "l", "l")]


def test_roles():
    music = [{"trackId": f"t{i}", "title": f"Song {i}", "byArtist": "X", "albumName": "A", "datePublished": "2020-01-02", "durationMs": 1000 + i, "genres": ["rock", f"g{i}"], "moods": ["sad"], "platformId": "p"} for i in range(5)]
    m = roles.infer_roles(music)
    assert (m["identity"], m["title"], m["subtitle"], m["temporal"]) == ("trackId", "title", "byArtist", "datePublished")
    assert m["tags"] == ["genres", "moods"] and m["measures"] == ["durationMs"] and m["relations"] == ["albumName"]
    assert m["labels"]["subtitle"] == "Artist" and m["media"] == "platformId"
    assert roles.role_map_applies(m, music) and not roles.role_map_applies(m, [{"foo": 1}]) and not roles.role_map_applies(None, music)
    assert roles.infer_roles([])["title"] is None
    nodes = [{"name": f"ChIJ{i:023d}", "fields": {"entityType": "P", "placeId": f"ChIJ{i:023d}", "hostId": f"ChIJ{9:023d}", "n": 1, "b": True, "l": [1]}} for i in range(5)]
    s = roles.infer_schema(nodes, {"gplace": r"ChIJ[\w-]{10,}$"}, ["gplace", "osm"])
    # the first field with the form claims the name space; a foreign key must not become an identity
    assert s["fields"] == {"b": "boolean", "entityType": "string", "hostId": "string", "l": "string", "n": "number", "placeId": "string"}
    assert roles.infer_identity({"placeId": [n["name"] for n in nodes]}, ["placeId"], {"gplace": r"ChIJ"}, ["gplace"]) == {"aliases": {"gplace": "placeId"}, "@id": "placeId"}
    assert roles.infer_identity({"hostId": [n["name"] for n in nodes]}, [], {"gplace": r"ChIJ"}, ["gplace"]) is None


def test_identity(spark):
    import uuid

    names = ["a", "rh:asset:NVDA", "ü", ""]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(identity.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert identity.keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert identity.canonical_object({"b": 1, "a": None, "ü": [True, b"x"]}) == '{"b":1,"ü":[true,{"__type":"Uint8Array","data":"eA=="}]}'
    with pytest.raises(ValueError):
        identity.canonical_object(float("nan"))
    c = {"kind": "commit", "parents": ["p"], "tree": "t", "root": "r", "schemaId": "s", "author": "a", "message": "m", "timestamp": 1}
    assert identity.is_commit(c) and not identity.is_commit({**c, "tree": 1}) and identity.first_parent(c) == "p" and identity.first_parent({}) is None
    assert identity.embedding_contract({"embed": {"dim": 5}}, "m", 9) == {"model": "m", "dim": 5, "distance": "Cosine"}


def test_query_reading():
    r = discover.interpret("best cheap tacos with outdoor seating open now")
    assert r.semantic == "tacos with outdoor seating" and r.filters.rating_gte == 4.3 and r.filters.price_levels == ["$", "$$"] and r.filters.open_now and r.filters.amenities == ["outdoor seating"]
    assert discover.interpret("hidden gems").semantic == "" and discover.interpret("hidden gems").gems_only
    assert discover.interpret("cheap open now").semantic == "cheap open now"
    a = discover.reading_of_answer({"price": "upscale", "amenities": ["reservable", "spaceship"], "gems": True})
    m = discover.merge_readings(discover.interpret("cheap patio"), a)
    assert m.filters.price_levels == ["$", "$$"] and m.filters.amenities == ["reservable", "outdoor seating"] and m.gems_only
    assert discover.date_window("weekend", date(2025, 6, 4)) == ("2025-06-07", "2025-06-08")
    assert discover.date_window("weekend", date(2025, 6, 8)) == ("2025-06-08", "2025-06-08")
    assert discover.date_window("week", date(2025, 6, 4)) == ("2025-06-04", "2025-06-08")


def test_opening_hours(spark):
    h = "Monday: 9 AM – 5 PM, 7 PM – 2 AM; Tuesday: Closed; Wednesday: Open 24 hours; Sunday: 11:30 PM - 1 AM"
    at = lambda s, t: spark.range(1).select(discover.open_at(F.lit(s), t)).first()[0]
    assert at(h, datetime(2025, 6, 2, 10)) is True and at(h, datetime(2025, 6, 2, 17)) is False
    assert at(h, datetime(2025, 6, 3, 1)) is True and at(h, datetime(2025, 6, 3, 3)) is False
    assert at(h, datetime(2025, 6, 4, 3)) is True and at(h, datetime(2025, 6, 2, 0, 30)) is True
    assert at("by appointment", datetime(2025, 6, 2)) is None and at(None, datetime(2025, 6, 2)) is None


def test_one_to_one_is_greedy(spark):
    rnd = random.Random(7)
    pairs = [(f"l{rnd.randint(0, 12)}", f"r{rnd.randint(0, 12)}", round(rnd.random(), 1), round(rnd.random(), 1), 0.5) for _ in range(60)]
    pairs = list({(a, b): p for *_, p in [((a, b), (a, b, *x)) for a, b, *x in pairs] for a, b in [p[:2]]}.values())
    ul, ur, want = set(), set(), set()
    for a, b, s, m, sim in sorted(pairs, key=lambda p: (p[2], p[3], p[4], p[0], p[1]), reverse=True):
        if a not in ul and b not in ur:
            ul.add(a)
            ur.add(b)
            want.add((a, b))
    got = matching.one_to_one(spark.createDataFrame(pairs, "id_l string, id_r string, score double, metres double, similarity double"))
    assert {(r["id_l"], r["id_r"]) for r in got.collect()} == want


def test_snap(spark):
    p = spark.createDataFrame([("a", "Town", 45.0, 10.0), ("b", None, 45.1, 10.0), ("c", None, 50.0, 10.0), ("d", None, None, None)], "id string, city string, lat double, lon double")
    assert dict((r["id"], r["city"]) for r in matching.snap_to_centroids(p).collect()) == {"a": "Town", "b": "Town", "c": "Other", "d": "No location"}


def test_map(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5)) * np.array([5, 3, 1, 1, 1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, embedding array<double>")
    out = mapping.map_points(df).toPandas()
    assert len(out) == 60 and out.x.min() == -1 and out.x.max() == 1
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    p = (x - x.mean(0)) @ v[:, -1]
    assert abs(np.corrcoef(p, out.sort_values("id").x)[0, 1]) > 0.999


def test_texts(spark):
    df = spark.createDataFrame([("T", "rock", "", ["a", "", None, "b"]), (None, None, "S", [])], "t string, g string, s string, l array<string>")
    d = [r[0] for r in df.select(text.document_text(F.col("t"), F.col("g"), F.col("s"), [], [("l", F.col("l"))])).collect()]
    assert d == ["search_document: Title: T. Tags: rock. l: a, b", "search_document: Title: . Tags: . Subtitle: S"]
    v = spark.createDataFrame([(0.0, 30.0), (0.004, 100.0), (0.17, 7200.0), (1234567.4, 200000.0), (None, None)], "x double, s double")
    assert [r[0] for r in v.select(text.usd(F.col("x"))).collect()] == ["$0", "<$0.01", "$0.17", "$1,234,567", None]
    assert [r[0] for r in v.select(text.age(F.col("s"))).collect()] == ["30s", "2m", "2.0h", "2.3d", "?"]
    c = spark.createDataFrame([("Town, WI",), ("wi",), (" ",), (None,)], "c string")
    assert [r[0] for r in c.select(text.city(F.col("c"))).collect()] == ["Town", None, None, None]


def test_embedder(spark):
    m = embedding.HashEmbedder(32)
    assert np.allclose(np.linalg.norm(m.embed(["hello world", "again hello"]), axis=1), 1) and not m.embed(["a"]).any()

    class Small(embedding.HashEmbedder):
        def embed(self, texts):
            if len(texts) > 2:
                raise MemoryError
            return super().embed(texts)

    assert np.allclose(embedding.embed_halving(Small(32), ["one two", "three", "four five", "six"]), m.embed(["one two", "three", "four five", "six"]))
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embedding.embed_column(df, "text", m).collect()}
    assert got[2] is None and len(got[1]) == 32
