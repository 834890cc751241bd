import numpy as np
from lodestrata.operators import graph as G
from lodestrata.plans import index_queries as I


def test_nearest_chunks_answers_every_stated_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64)).round(2).astype(np.float32)
    x[7] = x[40] = x[120]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (320, [1.0])], "chunk_id long, embedding array<float>").write.parquet(f"{tmp_path}/chunks_vec.parquet")
    got = {}
    for r in I.nearest_chunks(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.distance))
    assert sorted(got) == list(range(0, 300, 20))
    for q, rows in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1)).round(6)
        want = sorted(range(300), key=lambda i: (d[i], i))[:10]
        assert [c for _, c, _ in sorted(rows)] == want


def test_closures_are_followed_to_the_reference_depth(spark, monkeypatch):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(9)] + [(f"m{i:02}", f"m{i + 1:02}") for i in range(40)]
    monkeypatch.setattr(I, "_edges", lambda s, root: s.createDataFrame(edges, "src string, dst string"))
    got = I.call_closure(spark, "").toPandas()
    assert set(got[got.root == "n00"].node) == {f"n{i:02}" for i in range(1, 10)}
    assert got[got.root == "m00"].depth.max() == G.MAX_DEPTH
    states = {r.root: r.status for r in I.closure_states(spark, "").collect()}
    assert states["n00"] == "complete" and states["m00"] == states["m08"] == "partial" and states["m09"] == "complete"
