import numpy as np
import pytest
from lodestrata.llm import mixing as M


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    out = M.permute(np.arange(n), n, 5)
    assert sorted(out) == list(range(n))
    if n > 100:
        assert (out != np.arange(n)).mean() > 0.9 and (out != M.permute(np.arange(n), n, 6)).mean() > 0.9


def test_shares_and_repeats(spark):
    docs = [("A ", i, 40 + i % 7) for i in range(3000)] + [("b", 10_000 + i, 500) for i in range(60)] + [("a", 20_000, 9000), (None, 1, 50), ("other", 2, 50), ("a", 30_000, 0), ("a", 5, 3), ("C", 7, 10)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "source string, doc_id long, n_tokens int, block string")
    goal = spark.createDataFrame([("a", 0.7, 1), ("B", 0.2, 3), ("none", 0.1, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    out = M.mix(df, goal, block_tokens=64, shard_slots=100, run_docs=500).toPandas()
    assert set(out.source) == {"a", "b"} and not out.duplicated(["source", "doc_id"]).any()
    assert out[out.source == "a"].repeats.max() == 1 and out[out.source == "b"].repeats.max() <= 3
    assert (out.used_tokens <= out.n_tokens * out.repeats).all() and (out.n_tokens > 0).all()
    share = out.groupby("source").used_tokens.sum() / out.used_tokens.sum()
    assert abs(share["a"] - 0.7 / 0.9) < 0.03
    rep = {r.source: r for r in M.shares(M.mix(df, goal, block_tokens=64), goal.where("source is not null")).collect()}
    assert rep["none"].actual_share == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9


def test_same_again_and_empty(spark):
    df = spark.createDataFrame([("a", i, 100) for i in range(200)], "source string, doc_id long, n_tokens int")
    goal = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    run = lambda: sorted(tuple(r) for r in M.mix(df, goal, total_tokens=4096).collect())
    assert run() == run() and sum(r[4] for r in run()) <= 4096
    assert M.mix(df.where("false"), goal).count() == 0 and M.mix(df, goal.where("false")).count() == 0


def test_more_than_a_source_may_give(spark):
    """A source that is asked for more than its repeats gives all of them; null documents keep their tokens."""
    docs = [("a", i, 64) for i in range(40)] + [("a", None, 64)] + [("b", i, 64) for i in range(4000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "source string, doc_id long, n_tokens int, share string")
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 9)], "source string, target_share double, max_repeats int")
    out = M.mix(df, goals, total_tokens=100_000, block_tokens=64, shard_slots=32).toPandas()
    used = out.groupby("source").used_tokens.sum()
    assert used["a"] == 41 * 64 * 2 and abs(used["b"] - 50_000) < 4_000
    assert out[out.source == "a"].doc_id.isna().sum() == 1 and out.repeats.max() <= 9
    assert (out[out.source == "a"].repeats == 2).all()
