from datetime import datetime as D

from plexora.operators import references as R


def test_kinds(spark, rows):
    t = lambda n: D(2025, 1, n)
    links = spark.createDataFrame(
        [(1, " gplace:a ", t(5), "x"), (2, "gone", t(5), "x"), (3, "dead", t(5), "x"), (4, "late", t(5), "x"), (4, "late", t(6), "x"), (5, "N/A", t(5), "x"), (6, None, t(5), "x"), (7, "back", t(5), "x"), (None, "gone", t(5), "x"), (8, "places/loc", t(1), "x")],
        "linkid int, ref string, seen timestamp, kind string",
    )
    parents = spark.createDataFrame([("a", t(1)), ("dead", t(2)), ("late", t(9)), ("back", t(1)), ("back", t(8))], "ref string, at timestamp")
    always = spark.createDataFrame([("loc",)], "k string")
    tomb = spark.createDataFrame([("dead", t(3)), ("dead", t(3)), ("back", t(4)), (None, t(1))], "record_id string, deleted_at timestamp")
    bad = R.broken_references([R.Referrer("links", links, "linkid", ("ref",), "seen")], [R.Parent(parents, "ref", "at"), R.Parent(always, "k", None)], tomb)
    assert rows(bad.select("recordid", "kind")) == [("2", "missing"), ("3", "deleted"), ("4", "late")]
    assert rows(R.reference_report(bad).select("kind", "month", "n"))[0] == ("deleted", "2025-01", 1)
    assert R.broken_references([R.Referrer("links", links.limit(0), "linkid", ("ref",), "seen")], [R.Parent(parents, "ref", "at")], tomb).count() == 0


def test_hot_key_is_split_with_the_same_result(spark, rows, monkeypatch):
    from plexora import scale

    big = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS key")
    one = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    plain = rows(big.join(one, "key", "left").select("id", "v"))
    heavy = scale.heavy_keys(big, "key", share=0.1, least=100)
    assert set(heavy) == {"hot"}
    assert rows(scale.salted_join(big, one, "key", spread=("id",), per_task=100, heavy=heavy).select("id", "v")) == plain
