from plexora.functions import records as R
from pyspark.sql import functions as F


def test_credits(spark):
    t = "array<struct<name: string, joinphrase: string, id: string>>"
    df = spark.createDataFrame([([("A", " & ", "1"), ("B", None, "2"), ("A", "", "1")], []), ([], [("C", "", None)]), (None, None)], f"rec {t}, rel {t}")
    out = df.select(R.artist_credit(R.credited(F.col("rec"), F.col("rel"))).alias("c"), R.artist_ids(R.credited(F.col("rec"), F.col("rel"))).alias("i")).collect()
    assert [(r["c"], r["i"]) for r in out] == [("A & BA", ["1", "2"]), ("C", []), (None, None)]


def test_contributors(spark):
    t = "array<struct<role: string, name: string, id: string>>"
    df = spark.createDataFrame([([("artist", "A", "1"), ("x", "N", None)], [("producer", "A", "1"), ("mix", "B", "2")])], f"a {t}, b {t}")
    got = df.select(R.contributors(F.col("a"), F.col("b")).alias("c")).first()["c"]
    assert [(c["role"], c["id"]) for c in got] == [("artist", "1"), ("mix", "2")]


def test_best_release_and_lookup(spark):
    r = spark.createDataFrame([("k", "1", "Single", "2001"), ("k", "2", "Album", None), ("k", "3", "Album", "2005"), ("m", "4", None, None)], "key string, id string, kind string, date string")
    assert sorted(x["id"] for x in R.best_release(r, "key").collect()) == ["3", "4"]
    got = R.with_listens(r, spark.createDataFrame([("1", 9)], "id string, listens int"), "id").collect()
    assert sorted((x["id"], x["listens"]) for x in got) == [("1", 9), ("2", 0), ("3", 0), ("4", 0)]


def test_nodes_and_share(spark):
    a, b, e = R.track_nodes(spark.createDataFrame([("t", ["x"])], "id string, tags array<string>"))
    assert e.first()["dst"] == b.first()["id"] == "taxonomy:t" and a.columns == ["id"]
    assert R.decode_share(R.encode_share([("a", 1), ("ü", None)])) == [["a", 1], ["ü", None]]
    assert R.decode_share("%%%") == [] and R.decode_share("") == []
    assert R.drop_empty({"a": None, "b": "", "c": 0, "d": False, "e": []}) == {"c": 0, "d": False}
