"""The schedule of classes against the heap over all groups, and the operator against it."""

import collections

import numpy as np
import pytest

from tesserspark.llm import sharding


def loads(sizes, shards):
    """Load of each shard, and how many groups of each size it has, by the heap over all groups."""
    placed = sharding.schedule([(s, k) for k, s in enumerate(sizes)], shards)
    total, of = collections.Counter(), collections.Counter()
    for k, s in enumerate(sizes):
        total[placed[k]] += s
        of[s, placed[k]] += 1
    return total, of


@pytest.mark.parametrize("few", [0, 3, 10**9])
def test_classes_equal_the_heap(few):
    rng = np.random.default_rng(5)
    for trial in range(40):
        shards = int(rng.integers(1, 9))
        sizes = rng.integers(1, [4, 30, 1000][trial % 3], rng.integers(1, 400)).tolist() + ([5000] if trial % 4 == 0 else [])
        got = sharding.schedule_classes(collections.Counter(sizes).items(), shards, few)
        assert {(s, k): n for s, _, ends in got for k, n in ends} == dict(loads(sizes, shards)[1])
    assert sharding.schedule_classes([], 3) == []
    assert [sum(n for _, n in ends) for _, _, ends in sharding.schedule_classes([(108, 10**12), (9, 7)], 24)] == [10**12, 7]


@pytest.mark.parametrize("cell_groups, broadcast_rows", [(100_000, 10**6), (3, 0)])
def test_operator_equals_the_heap(spark, cell_groups, broadcast_rows):
    rng = np.random.default_rng(6)
    texts = [f"text {k} " * int(n) for k, n in enumerate(rng.integers(1, 6, 300))] + ["the same"] * 200 + [None, None, ""] + ["a very long text " * 400]
    rows = [(k % 700, t) for k, t in enumerate(texts)] + [(7, "one row")] * 50 + [(None, "no id")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, law string, slot int")
    groups = collections.Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    want = loads(list(groups.values()), 24)[0]
    for out in (sharding.shard(df, cell_groups=cell_groups, broadcast_rows=broadcast_rows), sharding.sharded_documents(df, cell_groups=cell_groups, broadcast_rows=broadcast_rows)):
        got = out.toPandas()
        assert len(got) == len(rows) and got.groupby("shard")["size"].sum().to_dict() == dict(want)
        assert (got.groupby("text_crc32").shard.nunique() == 1).all()
        for _, part in got.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
    assert sharding.sharded_documents(df.where("false")).count() == 0
