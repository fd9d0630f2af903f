import json

import pytest

from plexora.sources import shards
from plexora.streaming import changes as C

EDGE = shards.EDGE


def test_edges_are_shards(spark, tmp_path, rows):
    root = str(tmp_path)
    pts = spark.createDataFrame([(str(i), "{}", [1.0], "o", None, "A") for i in range(4)], shards.ROW + ", entity_type string")
    edges = lambda *e: spark.createDataFrame([("r", a, b, None, "T") for a, b in e], EDGE).coalesce(1)
    with pytest.raises(FileNotFoundError):
        shards.append_edges(edges(("0", "1")), root, "d")
    shards.bake(pts, root, "d", now=0)
    assert shards.read_edges(spark, root, "d").count() == 0 and shards.append_edges(edges().limit(0), root, "d") == 0
    assert shards.append_edges(edges(("0", "1"), ("1", "2"), ("0", "1")), root, "d") == 2
    assert shards.append_edges(edges(("1", "2"), ("2", "3")), root, "d") == 1
    got = [(r["src"], r["dst"], r["dst_type"]) for r in shards.read_edges(spark, root, "d").orderBy("seq").collect()]
    assert got == [("0", "1", "T"), ("1", "2", "T"), ("2", "3", "T")]
    assert shards.read_json(f"{root}/catalog.json")["domains"][0]["edge_count"] == 3
    assert shards.tombstone(spark, root, "d", ["3"])["edges_pruned"] == 1 and shards.tombstone(spark, root, "d", ["9"])["edges_pruned"] == 0
    assert rows(shards.read_edges(spark, root, "d").select("src", "dst")) == [("0", "1"), ("1", "2")]
    assert shards.sweep(root, "d") > 0 and shards.read_edges(spark, root, "d").count() == 2
    assert shards.write_edges(edges(("0", "2")), root, "d") == 1 and rows(shards.read_edges(spark, root, "d").select("src", "dst")) == [("0", "2")]


def test_pull_resumes(spark, tmp_path):
    root, to = str(tmp_path / "a"), tmp_path / "b"
    pts = spark.createDataFrame([(str(i), "{}", [1.0], "o", None, "A") for i in range(9)], shards.ROW + ", entity_type string")
    n = len(shards.bake(pts, root, "d", shard_size=3, now=0)["shards"])
    first = shards.read_json(f"{root}/d/manifest.json")["shards"][0]["file"]
    whole = (tmp_path / "a" / "d" / first).read_bytes()
    (to / "d").mkdir(parents=True)
    (to / "d" / (first + ".part")).write_bytes(whole[:10])
    assert shards.pull_domain(spark, root, "d", str(to)) == n and shards.pull_domain(spark, root, "d", str(to)) == 0
    assert (to / "d" / first).read_bytes() == whole and shards.load(spark, str(to), "d").count() == 9


def test_state_is_compacted(spark, tmp_path, rows):
    state = C.GraphState(spark, str(tmp_path / "s"))
    state.COMPACT_AFTER = 3
    v = lambda c, p: {"cid": c, "schemaId": "s", "payload": p}
    e = lambda a, b: {"sourceCid": a, "relation": "r", "targetCid": b}
    batches = [
        {"addedVertices": [v("a", "1")], "addedEdges": [e("a", "b")]}, {"addedVertices": [v("b", "1"), v("a", "2")], "removedEdges": [e("a", "b")], "addedEdges": [e("b", "a")]},
        {"removedVertexCids": ["b"], "addedEdges": [e("a", "b"), e("b", "a")]}, {"addedVertices": [v("b", "3")]}, {"removedEdges": [e("b", "a")]}, {"addedVertices": [v("c", "1")]},
    ]
    want_v, want_e = [("a", "2"), ("b", "3"), ("c", "1")], [("a", "b")]
    plain_v, plain_e = spark.createDataFrame([], C.VERTEX), spark.createDataFrame([], C.EDGE)
    for n, b in enumerate(batches):
        (tmp_path / f"{n}.json").write_text(json.dumps({"blockNumber": n, **b}))
        changes = spark.read.schema(C.CHANGE).json(str(tmp_path / f"{n}.json"))
        plain_v, plain_e = C.apply_changes(plain_v, plain_e, changes)
        state.prepare(n, changes)
        state.commit(n)
        vs, es = state.tables()
        assert rows(vs) == rows(plain_v) and rows(es.select("src", "dst")) == rows(plain_e.select("src", "dst"))
    assert rows(vs.select("cid", "payload")) == want_v and rows(es.select("src", "dst")) == want_e
    assert state.version() == 5 and not (tmp_path / "s" / "d0").exists() and (tmp_path / "s" / "v5").exists()
    with pytest.raises(ValueError):
        state.reset(plain_v.limit(0), plain_e)
    state.reset(plain_v.limit(1), plain_e.limit(0))
    assert state.tables()[0].count() == 1 and state.version() == 6


def test_supervise(spark):
    from pyspark.errors import StreamingQueryException

    class Run:
        lastProgress = None

        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise StreamingQueryException("lost")

    runs = iter([Run(True), Run(True), Run(False)])
    assert C.supervise(lambda: next(runs), wait=0) == 2
    with pytest.raises(StreamingQueryException):
        C.supervise(lambda: Run(True), retries=2, wait=0)
