import json

import pytest

from plexora.sources import readers, shards
from plexora.streaming import changes as C

POINTS = shards.ROW + ", entity_type string"


def pts(spark, *items):
    return spark.createDataFrame([(i, json.dumps({"entityType": "A", "v": v}), [1.0, float(v)], "o", None, "A") for i, v in items], POINTS)


def test_bake_append_tombstone_load(spark, tmp_path):
    root = str(tmp_path / "cdn")
    base = pts(spark, ("a", 1), ("b", 2), ("c", 3))
    m1 = shards.bake(base, root, "d", shard_size=2, now=0)
    m2 = shards.bake(base.orderBy("track_id", ascending=False), root, "d", shard_size=2, now=0)
    assert m1 == m2 and m1["count"] == 3 and m1["entity_types"] == [{"type": "A", "count": 3}]
    ids = lambda: sorted((r["track_id"], json.loads(r["fields"])["v"]) for r in shards.load(spark, root, "d").collect())
    assert ids() == [("a", 1), ("b", 2), ("c", 3)]
    assert shards.append(base, root, "d", now=0) is None
    got = shards.append(pts(spark, ("a", 1), ("b", 9), ("z", 4)), root, "d", now=0)
    assert (got["new"], got["updated"]) == (1, 1) and ids() == [("a", 1), ("b", 9), ("c", 3), ("z", 4)]
    edge = "rel string, src string, dst string, src_type string, dst_type string"
    e = spark.createDataFrame([("r", "a", "b", None, None), ("r", "a", "b", None, None), ("r", "b", "c", None, None), (None, "a", "c", None, None)], edge)
    assert shards.append_edges(e, root, "d") == 2 and shards.append_edges(e, root, "d") == 0
    t = shards.tombstone(spark, root, "d", ["a", "a", ""])
    assert (t["added"], t["edges_pruned"]) == (1, 1) and shards.tombstone(spark, root, "d", ["a"]) is None
    assert ids() == [("b", 9), ("c", 3), ("z", 4)]
    assert shards.append(pts(spark, ("a", 1)), root, "d", now=0)["new"] == 1  # an identical record comes back
    assert ("a", 1) in ids() and shards.read_json(f"{root}/d/manifest.json")["tombstones"] == []
    assert [x["name"] for x in shards.catalog(root)] == ["d"]
    shards.bake(base.limit(0), root, "empty", now=0)
    assert shards.load(spark, root, "empty").count() == 0 and [x["name"] for x in shards.catalog(root)] == ["d"]
    assert shards.stage_static(root, str(tmp_path / "site"), ["d"]) > 2
    f = tmp_path / "cdn" / "d" / shards.read_json(f"{root}/d/manifest.json")["shards"][0]["file"]
    f.write_bytes(f.read_bytes() + b"x")
    with pytest.raises(Exception, match="changed"):
        shards.load(spark, root, "d").count()


def test_readers(spark, tmp_path):
    (tmp_path / "volume_1_businesses.json").write_text(json.dumps([{"name": "n1", "fields": {"title": "T"}}, {"name": None, "fields": {}}]))
    (tmp_path / "volume_1_edges.json").write_text("[]")
    (tmp_path / "volume_1_odd_things.json").write_text("{broken")
    v = readers.staged_volume(spark, str(tmp_path), 1, {"businesses": "Business"})
    assert [(r["name"], r["entity_type"]) for r in v.collect()] == [("n1", "Business")]
    (tmp_path / "imp.ndjson").write_text('{"track_id":"a","embedding":[1]}\nnot json\n{"track_id":"b"}\n{"embedding":[1]}\n')
    assert [r["track_id"] for r in readers.import_lines(spark, str(tmp_path / "imp.ndjson")).collect()] == ["a"]
    assert readers.parse_sources(["o:n:x"]) == [("o", "n:x")]
    with pytest.raises(ValueError):
        readers.parse_sources(["o:"])
    assert readers.load_state(str(tmp_path / "none.json")) == {}
    readers.save_state(str(tmp_path / "s.json"), cursor=3)
    readers.save_state(str(tmp_path / "s.json"), other=1)
    assert readers.load_state(str(tmp_path / "s.json")) == {"cursor": 3, "other": 1}
    assert not readers.seedable(0, None) and readers.seedable(0, "h")
    rec = spark.createDataFrame([("asset", 1), ("transfer", 5), ("transfer", 9)], "type string, block int")
    assert readers.past_cursor(rec, 5).count() == 2 and readers.next_cursor(rec, 100) == 100 and readers.next_cursor(rec, 1) == 9
    calls = []

    def fetch(a, o, r):
        calls.append(r)
        return [{"id": f"{len(calls)}-{i}"} for i in range(20 if r > 900 else 3)]

    assert len(readers.sweep(fetch, 45, 9, 1000, least=500)) == 32 and calls == [1000, 750, 750, 750, 750]


def change(**x):
    return json.dumps({"namespace": "n", **x})


def test_changes_are_applied_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    v = lambda c, p="{}": {"cid": c, "schemaId": "s", "payload": p}
    e = lambda a, b: {"sourceCid": a, "relation": "r", "targetCid": b}
    (src / "1.json").write_text("\n".join([change(blockNumber=1, addedVertices=[v("a"), v("b")], addedEdges=[e("a", "b")]), "garbage", change(blockNumber=2, removedVertexCids=["b"], addedVertices=[v("b", "new")])]))
    state = C.GraphState(spark, str(tmp_path / "state"))
    seen = []

    def deliver(n, vertices, edges, affected):
        seen.append((n, sorted(r[0] for r in affected.collect())))

    run = lambda: C.watch(C.change_stream(spark, str(src)), state, str(tmp_path / "ck"), deliver).awaitTermination()
    run()
    vs, es = state.tables()
    assert sorted((r["cid"], r["payload"]) for r in vs.collect()) == [("a", "{}"), ("b", "new")] and es.count() == 1
    assert seen == [(0, ["a", "b"])]
    run()
    assert len(seen) == 1
    (src / "2.json").write_text(change(blockNumber=3, removedVertexCids=["a"], removedEdges=[e("a", "b")], addedVertices=[v("c")], addedEdges=[e("b", "c"), e("b", "c")]))
    run()
    vs, es = state.tables()
    assert sorted(r["cid"] for r in vs.collect()) == ["b", "c"] and [(r["src"], r["dst"]) for r in es.collect()] == [("b", "c")]


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['plexora.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    from conftest import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
