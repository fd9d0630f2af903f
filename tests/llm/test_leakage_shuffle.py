from plexora.llm import leakage as L

W = [f"w{i}" for i in range(40)]
DOCS = [
    (1, "x y " + " ".join(W[:13]) + " z"),
    (1, "x y " + " ".join(W[:13]) + " z"),
    (2, "x y " + " ".join(W[:12]) + " z"),
    (3, "noise, " * 50 + ", ".join(w.upper() for w in W[20:35]) + ". Rest é"),
    (3, "noise " * 60 + " ".join(W[:14]) + " mid " + " ".join(W[25:39])),
    (4, None),
    (5, ""),
    (None, "noise " * 60 + " ".join(W[3:17])),
]


def test_spans_are_removed_by_shuffle_too(spark, rows, monkeypatch):
    d = spark.createDataFrame(DOCS, "doc_id int, text string")
    i = spark.createDataFrame([("i1", " ".join(W[:20])), ("i2", " ".join(W[18:40])), ("i3", "short"), ("i4", None)], "item_id string, text string")
    want = rows(L.remove_leaks(d, i))
    assert len(want) == len(DOCS) and sum(r[3] for r in want) == 2 and sum(r[2] > 0 for r in want) == 5
    monkeypatch.setattr(L, "MAX_BROADCAST_GRAMS", 0)
    assert rows(L.remove_leaks(d, i)) == want
