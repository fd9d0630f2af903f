import numpy as np

from plexora.llm import mixing as M


def test_tasks_descend_to_the_tree_s_leaves():
    counts, shards = np.array([50, 7, 0, 120]), 9
    tree = M.split_tree(counts, shards, 4)
    source = np.repeat(np.arange(4), counts)
    place = np.concatenate([np.arange(c) for c in counts])
    leaf = M.Descent(counts, shards, 4).lead(source, place)
    got = np.zeros((shards, 4), int)
    np.add.at(got, (leaf, source), 1)
    assert (got == tree).all()
    wide = M.Descent(counts, shards, 4, 3).lead(source, place)
    assert len(set(wide)) < shards and all(w <= x for w, x in zip(wide, leaf))


def test_small_ranges_and_subtrees_change_nothing(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 17), "big" if i % 3 else "small") for i in range(2000)], "doc_id int, text string, source string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2)], "source string, target_share double, max_repeats int")
    plain = sorted(map(tuple, M.mix(docs, t, shard_tokens=1000).collect()))
    assert sorted(map(tuple, M.mix(docs, t, shard_tokens=1000, range_tokens=1, groups=4).collect())) == plain
    per = {r["shard"]: r for r in M.shard_report(M.mix(docs, t, shard_tokens=1000)).collect()}
    tokens = np.array([r["tokens"] for r in per.values()])
    assert len(per) > 15 and tokens.max() < 2 * tokens.mean() and tokens.min() > 0.4 * tokens.mean()
