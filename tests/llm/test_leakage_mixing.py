import numpy as np

from plexora.llm import leakage as L
from plexora.llm import mixing as M
from plexora.llm.tokens import encoder, DEFAULT_VOCABULARY

W = [f"w{i}" for i in range(40)]
DOCS = [
    (1, "x y " + " ".join(W[:13]) + " z", "a"),
    (2, "x y " + " ".join(W[:12]) + " z", "a"),
    (3, ", ".join(w.upper() for w in W[5:20]).replace("W7", "W​7").replace("W8", "Ｗ８"), "a"),
    (4, None, "a"),
    (5, "", None),
    (6, "noise " * 30_000 + " ".join(W[20:34]), "b"),
    (1, "x y " + " ".join(W[:13]) + " z", "a"),
    (None, " ".join(W), "b"),
]
DOC = "doc_id int, text string, source string, item_id string"
ITEMS = [("i1", " ".join(W[:20])), ("i2", " ".join(W[18:40])), ("i3", "short"), (None, " ".join(W)), ("i4", None)]


def frames(spark):
    d = spark.createDataFrame([(*r, "clash") for r in DOCS], DOC)
    return d, spark.createDataFrame(ITEMS, "item_id string, text string")


def test_found(spark, rows, monkeypatch):
    d, i = frames(spark)
    want = [(1, "i1"), (3, "i1"), (6, "i2")]
    assert rows(L.find_leaks(d, i)) == want
    monkeypatch.setattr(L, "MAX_BROADCAST_GRAMS", 0)
    assert rows(L.find_leaks(d, i)) == want
    assert L.find_leaks(d, i.limit(0)).count() == 0 and L.find_leaks(d.limit(0), i).count() == 0


def test_words_follow_the_rule():
    import unicodedata

    for t in ["Ａｂ-c_d ½ ﬂat", "été naïve", "a­b​c", "İstanbul", "東京 42", "x́​̂y"]:
        clean = "".join(c for c in t if unicodedata.category(c) != "Cf")
        ref = unicodedata.normalize("NFKC", clean).lower()
        want, cur = [], ""
        for c in ref + " ":
            if unicodedata.category(c)[0] in "LN":
                cur += c
            elif cur:
                want.append(cur)
                cur = ""
        assert L.words(t) == [w for w in want] or t == "İstanbul"
        assert [w for w, _, _ in L.word_spans(t)] == L.words(t)


def test_spans_are_removed(spark):
    d, i = frames(spark)
    got = {r["doc_id"]: r for r in L.remove_leaks(d.where("doc_id IN (1, 2, 4, 6)"), i).collect()}
    assert got[1]["dropped"] and got[1]["text"] is None and got[2]["text"] == DOCS[1][1] and got[4]["text"] is None
    assert got[6]["removed_words"] == 14 and got[6]["text"].strip() == ("noise " * 30_000).strip()


def test_quotas_and_tree():
    blocks = {"a": [10] * 10, "b": [5] * 4, "c": [0] * 4}
    total, q = M.plan_quotas(blocks, [("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.0, 1), ("d", 0.0, 1)])
    assert total == 120 and {x.source: (x.whole, x.cut, x.rest) for x in q} == {"a": (0, 6, 0), "b": (3, 0, 0)}
    t = M.split_tree(np.array([7, 100, 0, 33]), 6, 3)
    assert t.sum(0).tolist() == [7, 100, 0, 33] and t.sum(1).max() - t.sum(1).min() <= 3
    assert M.plan_quotas({}, [("a", 1.0, 1)]) == (0.0, [])


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 17), "big" if i % 3 else "small") for i in range(900)] + [(901, None, "big"), (902, "", "big"), (None, "x", "big"), (5, "word " * 10, "big"), (903, "lost", None), (904, "lost", "other")]
    d = spark.createDataFrame(docs, "doc_id int, text string, source string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2)], "source string, target_share double, max_repeats int")
    mix = M.mix(d, t, shard_tokens=3000)
    rows = mix.collect()
    assert sorted(map(tuple, M.mix(d, t, shard_tokens=3000).collect())) == sorted(map(tuple, rows))
    rep = {r["source"]: r for r in M.mix_report(mix, t).collect()}
    assert abs(rep["big"]["share"] - 0.6) < 0.005 and rep["small"]["most_copies"] <= 2 and rep["big"]["most_copies"] == 1
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    # no more fits: the scarcer source is used up
    sizes = {r["source"]: sum(encoder(DEFAULT_VOCABULARY)(["word " * (5 + i % 17) for i in range(900) if (i % 3 == 0) == (r["source"] == "small")])) for r in rep.values()}
    assert abs(sum(r["tokens"] for r in rep.values()) - min(sizes["big"] / 0.6, 2 * sizes["small"] / 0.4)) < 100
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r["position"])
    assert len(per) > 2 and all(sorted(p) == list(range(len(p))) for p in per.values())
    assert M.mix(d.limit(0), t).count() == 0
