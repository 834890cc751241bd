import random

import numpy as np
from lodestrata.llm import packing as P


def squares(sizes, bins):
    return int((np.bincount(bins, weights=sizes) ** 2).sum())


def test_local_search_never_worsens():
    for seed in range(8):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(0, 100, 120)
        first = np.arange(len(sizes)) // 2  # far from good
        first = np.searchsorted(np.unique(first), first)
        ok = np.bincount(first, weights=sizes) <= 200
        assert ok.all()
        out = P.improve(sizes, first, 200)
        assert np.bincount(out, weights=sizes).max() <= 200
        assert squares(sizes, out) >= squares(sizes, first) and len(np.unique(out)) <= len(np.unique(first))


def test_exchanges_empty_a_container():
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])  # best fit by size needs four of ten, three hold all
    assert len(np.unique(P.pack_shard(sizes, 10))) == 3


def test_shards_are_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(5, 1, 3000).astype(int) + 1, 2047)
    b = P.pack_shard(sizes, 2048)
    assert np.bincount(b, weights=sizes).max() <= 2048
    assert len(np.unique(b)) <= -(-sizes.sum() // 2048) + 1


def test_table(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 3, 40, 99, 100, 101, 250, 1000, None, -4])) for i in range(400)] + [(7, 55)] * 300 + [(None, 20)] * 3
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "item_key long, n_tokens int, container string")
    out = P.pack(df, capacity=100, shard_items=120).toPandas()
    assert out.groupby("container").n_tokens.sum().max() <= 100
    assert (out.groupby("container").n_tokens.sum() == out.groupby("container").fill.first()).all()
    assert out.n_tokens.sum() == sum(max(0, b or 0) for _, b in rows)
    want = sum(max(1, -(-max(0, b or 0) // 100)) for _, b in rows)
    assert len(out) == want
    split = out[out.part > 0].item_key.unique()
    assert {x for x in split} == {a for a, b in rows if b and b > 100}
    assert P.pack(df.where("false")).count() == 0


def test_the_search_does_the_packing():
    """From the arbitrary filling the search comes down to the least number of containers, by moves and exchanges alike."""
    rng = np.random.default_rng(4)
    sizes = np.minimum(rng.lognormal(5, 1, 2500).astype(np.int64) + 1, 2047)
    start = P.in_order(sizes, 2048)
    search = P.Search(sizes, start, 2048)
    out = search.run()
    least = -(-int(sizes.sum()) // 2048)
    assert start.max() + 1 > 1.05 * least and out.max() + 1 <= least + 1
    assert np.bincount(out, weights=sizes).max() <= 2048 and squares(sizes, out) > squares(sizes, start)
    assert search.steps[1, 0] > 50 and search.steps[1, 1] > 50


def test_search_over_ties_and_nothing():
    assert len(P.pack_shard(np.zeros(0, dtype=np.int64), 10)) == 0
    assert len(np.unique(P.pack_shard(np.array([0, 0, 0]), 10))) == 1
    assert len(np.unique(P.pack_shard(np.full(100, 5), 10))) == 50
    assert len(np.unique(P.pack_shard(np.full(1000, 1), 10))) == 100
    assert len(np.unique(P.pack_shard(np.array([6, 0, 6, 0, 4, 4]), 10))) == 2
