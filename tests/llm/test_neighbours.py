import numpy as np

from plexora.llm import neighbours as N


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        o = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in o if s[i, j] >= least}
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    c = rng.standard_normal((120, 64))
    x = (c[rng.integers(0, 120, 1500)] + 0.25 * rng.standard_normal((1500, 64))).astype("float32")
    ids = [f"v{i:04d}" for i in range(1500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<float>")
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(df, entries=300).collect()}
    want = brute(ids, x.astype(float), 5, 0.85)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97 and len(want) > 1000


def test_copies_and_scale(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(64), rng.standard_normal(64)
    rows = [(f"a{i:02d}", (a * (1 + i % 2)).tolist()) for i in range(20)] + [("b1", b.tolist()), ("b2", (b + 0.01).tolist())]
    df = spark.createDataFrame(rows, "id string, vec array<float>")
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(df).collect()}
    first = [f"a{i:02d}" for i in range(6)]
    want = {tuple(sorted((f"a{i:02d}", o))) for i in range(20) for o in [x for x in first if x != f"a{i:02d}"][:5]} | {("b1", "b2")}
    assert got == want
    assert N.similar_pairs(df.limit(0)).count() == 0 and N.similar_pairs(df.limit(1)).count() == 0


def test_latest_and_usable(spark):
    good, zero = [1.0] * 4, [0.0] * 4
    rows = [("a", 1, good), ("a", 2, [2.0] * 4), ("b", 1, good), ("b", 2, zero), ("c", None, good), ("d", 1, None), ("e", 1, [1.0] * 3), ("f", 1, [1.0, None, 1.0, 1.0]), ("g", 1, [float("nan")] + [1.0] * 3), (None, 1, good), ("c", None, good)]
    df = spark.createDataFrame(rows, "k string, o int, v array<float>")
    assert sorted((r["id"], r["vec"][0]) for r in N.latest(df, "k", "v", "o", 4).collect()) == [("a", 2.0), ("c", 1.0)]


def test_walk_is_in_order():
    rng = np.random.default_rng(5)
    a, b = np.sort(rng.random(9)), np.sort(rng.random(9))
    ix = N.MultiIndex((np.zeros((9, 1)),) * 2, np.ones((9, 9), int), None, None)
    cells = ix.walk(a.tolist(), list(range(9)), b.tolist(), list(range(9)), 10**6, 0)
    s = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 81 and s == sorted(s)


def test_packing_splits_large_cells():
    counts = np.array([[3, 25, 2], [4, 4, 4], [0, 0, 9]])
    first, parts = N._pack(counts, 10)
    load = {}
    for i in range(3):
        for j in range(3):
            for s in range(first[i, j], first[i, j] + parts[i, j]):
                load[s] = load.get(s, 0) + counts[i, j] / parts[i, j]
    assert parts[0, 1] == 3 and max(load.values()) <= 10
