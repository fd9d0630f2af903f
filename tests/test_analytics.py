import pytest

from plexora.operators import analytics as A
from pyspark.sql import functions as F

ROWS = [
    ("t0", "Transfer", '{"symbol":"AAA","from":"0xa","to":"0xb","value":10}'),
    ("t1", "Transfer", '{"symbol":"AAA","from":"0xb","to":"0xa","value":10}'),
    ("t2", "Transfer", '{"symbol":"AAA","from":"0xa","to":"0xc","value":5}'),
    ("t3", "Transfer", '{"symbol":"BBB","from":"0xa","to":"0xb","value":"2"}'),
    ("t4", "Transfer", '{"symbol":"BBB","from":"0xc","to":"0xb","value":null}'),
    ("a0", "Asset", '{"symbol":"AAA","price":1.5,"holders":7,"open":true}'),
]


@pytest.fixture(scope="module")
def recs(spark):
    return spark.createDataFrame(ROWS, "id string, entity_type string, j string").withColumn("fields", F.parse_json("j")).drop("j")


def test_group_measures(recs, rows):
    out = A.aggregate(recs, "from", {"n": "count", "s": "sum:value"}, entity_type="Transfer", order_by="-s", variant="fields")
    assert [(r["from"], r["n"], r["s"]) for r in out.collect()] == [("0xa", 3, 17.0), ("0xb", 1, 10.0), ("0xc", 1, 0.0)]
    w = A.aggregate(recs, "symbol", {"n": "count", "s": "sum:value"}, {"symbol": "AAA", "value": {"gte": 5}}, variant="fields")
    assert rows(w) == [("AAA", 3, 25.0)]
    d = A.aggregate(recs, "symbol", {"d": "distinct:to", "hi": "max:value", "lo": "min:value"}, {"symbol": "AAA"}, "Transfer", variant="fields")
    assert rows(d) == [("AAA", 3, 10.0, 5.0)]
    none = A.aggregate(recs, "nothing", {"d": "distinct:nothing", "a": "avg:nothing", "s": "sum:nothing"}, variant="fields")
    assert rows(none) == [(None, 1, None, 0.0)]
    with pytest.raises(ValueError):
        A.aggregate(recs, "symbol", {"x": "median:value"})


def test_where_grammar(recs):
    n = lambda c: A.where(recs, c, variant="fields").count()
    assert n({}) == 6 and n({"price": {"ne": 1}}) == 6 and n({"price": None}) == 5
    assert n({"open": True}) == 1 and n({"open": 1}) == 0 and n({"value": {"gt": 1}}) == 4
    assert n({"value": {"gt": "x"}}) == 0 and n({"symbol": {"in": ["AAA", "ZZZ"]}}) == 4
    assert n({"symbol": {"contains": "A"}}) == 4 and n({"value": {"exists": False}}) == 2 and n({"value": {"odd": 1}}) == 6
    assert n({"value": "2"}) == 1 and n({"value": 2}) == 0


def test_spelled_numbers(spark):
    from plexora.functions.values import spelled_number

    vals = ["1", " 2.5 ", "1_000", "1d", "nan", "1e3", ".5", "5.", "", "0x1", "+3"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string").select("i", spelled_number(F.col("v")).alias("n")).orderBy("i").select("n").collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, 1000.0, 0.5, 5.0, None, None, 3.0]


def test_order_numbers_before_texts(spark):
    df = spark.createDataFrame([("b", "10"), ("a", "x"), ("c", "9"), ("d", None)], "k string, v string")
    assert [r["k"] for r in df.orderBy(*A.order_columns(df, "v")).collect()] == ["c", "b", "d", "a"]


def test_vocabularies(recs, spark):
    assert [r[0] for r in A.field_vocabulary(recs, "fields").collect()] == ["from", "holders", "open", "price", "symbol", "to", "value"]
    f = spark.createDataFrame([(["a", None, "b"], "x"), (None, "y")], "tags array<string>, s string")
    assert sorted(tuple(r) for r in A.facet_vocabulary(f, ["tags", "s"]).collect()) == [("tags", "a"), ("tags", "b")]


def test_export(recs, tmp_path):
    out = A.export_rows(recs.withColumn("symbol", F.try_variant_get("fields", "$.symbol", "string")), ["symbol"], entity_type="Transfer")
    assert out.columns == ["id", "entity_type", "symbol"] and out.count() == 5
    A.write_export(out, str(tmp_path / "o"), "csv")
    assert recs.sparkSession.read.option("header", True).csv(str(tmp_path / "o")).count() == 5
