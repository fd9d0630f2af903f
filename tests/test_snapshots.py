import json
import random

from plexora.operators import snapshots as S

SCHEMA = "snapshot_no int, track_id string, fields string, delivered_at timestamp, meta struct<version: int>, id string, no int"


def test_canonical_json():
    same = [
        '{"a": 1, "b": [1, 2], "c": null}',
        '{ "b":[1.0,2e0],"a":1.00 }',
        '{"a":10e-1,"b":[1,2],"\\u0063":null}',
    ]
    assert len({S.canonical_json(x) for x in same}) == 1
    assert S.canonical_json('{"a":[1,2]}') != S.canonical_json('{"a":[2,1]}')
    assert S.canonical_json('{"a":"1"}') != S.canonical_json('{"a":1}')
    assert S.canonical_json('{"a":true}') != S.canonical_json('{"a":1}')
    assert S.canonical_json('{"a":{"b":null}}') == S.canonical_json('{"a":{}}')
    assert S.canonical_json(None) == S.canonical_json("null")
    assert S.canonical_json("{broken") == S.canonical_json(" {broken ")
    assert S.canonical_json("0") == S.canonical_json("-0.0") == S.canonical_json("0e5")
    assert S.canonical_json("1e400") != S.canonical_json("1e401")


def test_changes_against_brute_force(spark, rows):
    rnd = random.Random(3)
    data = []
    for no in (1, 2, 4):
        for i in range(30):
            if rnd.random() < 0.8:
                for v in range(rnd.choice([1, 1, 2])):
                    d = {"k": rnd.randint(0, 2), "z": None}
                    data.append((no, f"t{i}", json.dumps(d, indent=rnd.choice([None, 1])), None, (v,), "x", 9))
    data += [(1, None, "{}", None, (1,), "x", 9), (None, "t1", "{}", None, (1,), "x", 9)] + data[:5]
    best = {}
    for no, t, f, _, (v,), *_ in data:
        if no is not None and t is not None and (no, t) not in best or (no, t) in best and v > best[no, t][0]:
            best[no, t] = (v, json.loads(f)["k"])
    want = set()
    for a, b in ((1, 2), (2, 4)):
        for t in {k[1] for k in best}:
            x, y = best.get((a, t)), best.get((b, t))
            if x and y and x[1] != y[1]:
                want.add((b, t, "changed"))
            elif x and not y:
                want.add((b, t, "removed"))
            elif y and not x:
                want.add((b, t, "added"))
    got = S.snapshot_changes(spark.createDataFrame(data, SCHEMA))
    assert rows(got) == sorted(want, key=repr)


def test_empty_and_single(spark):
    assert S.snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "a", "{}", None, None, "", 0)], SCHEMA)
    assert S.snapshot_changes(one).count() == 0
