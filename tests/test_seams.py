import pytest
from lodestrata.operators import incremental as I
from lodestrata.sources import files as FS
from lodestrata.sources import seams as S
from lodestrata.sources import tables as T
from pyspark.sql import functions as F


def test_git_states(spark):
    status = b" M a.py\0R  new.py\0old.py\0?? fresh.py\0!! x.pyc\0AM b c.md\0\0"
    assert S.dirty_files(status) == ["a.py", "b c.md", "new.py"] and S.dirty_files(b"") == []
    git = S.StaticGit("h2", None, status, {("h1", "h2"): ["a.py", " a.py", ""]})
    one, dirty = S.git_state(spark, git, "r")
    state = one.withColumn("indexed_head", F.lit("h2")).withColumn("indexed_branch", F.lit("detached-h2")).withColumn("config_hash", F.lit("c")).withColumn("indexed_config_hash", F.lit("c"))
    manifest = spark.createDataFrame([("r", "a.py"), ("r", "z.py"), ("q", "a.py")], "repo string, path string")
    assert [r.reason for r in I.staleness(state, dirty, manifest).collect()] == ["dirty_files"]
    assert [r.reason for r in I.staleness(state, dirty.where("false"), manifest).collect()] == [None]
    assert {r.path for r in S.changed_files(spark, git, "r", "h1", manifest).collect()} == {"a.py"}
    assert {r.path for r in S.changed_files(spark, git, "r", "h0", manifest).collect()} == {"a.py", "z.py"}
    assert S.changed_files(spark, git, "r", "h2", manifest).count() == 0


def test_caches():
    now, asked = [0.0], []
    c = S.Cached(lambda: asked.append(1) or len(asked), 30, lambda: now[0])
    assert [c.get(), c.get()] == [1, 1]
    now[0] = 31
    assert c.get() == 2
    c.invalidate()
    assert c.get() == 3
    r = S.Recent(2)
    assert [r.get(k, lambda k=k: k * 2) for k in (1, 2, 1, 3)] == [2, 4, 2, 6] and len(r) == 2
    assert r.get(1, lambda: "new") == 2 and r.get(2, lambda: "new") == "new"


def test_edges_by_adapter(spark):
    class Words:
        languages = frozenset({"python"})

        def outgoing(self, anchors):
            if (anchors["content_text"] == "bad").any():
                raise ValueError
            return [(i, w, "call") for i, t in zip(anchors["id"], anchors["content_text"]) for w in t.split()]

    a = spark.createDataFrame([("a", "x.py", "b c"), ("g", "x.go", "b")], "id string, path string, content_text string")
    edges, failed = S.edges_of(a, [Words()])
    assert {tuple(r) for r in edges.collect()} == {("a", "b", "call"), ("a", "c", "call")} and failed.count() == 0
    edges, failed = S.edges_of(spark.createDataFrame([("a", "x.py", "bad")], a.schema), [Words()])
    assert edges.count() == 0 and [r.id for r in failed.collect()] == ["a"]


def test_documents_and_cached_index(spark):
    f = spark.createDataFrame([("docs/a.md", 1), ("doc/b.MD", 1), ("src/c.md", 1), ("docs/.git/d.md", 1), ("docs/e.py", 1), ("notes/f.mdx", 1)], "path string, mtime int")
    assert {r.path for r in S.doc_files(f).collect()} == {"docs/a.md", "doc/b.MD"}
    assert {r.path for r in S.doc_files(f, ["notes/f.mdx", "src"]).collect()} == {"src/c.md", "notes/f.mdx"}
    cache = spark.createDataFrame([("docs/a.md", 1, "old"), ("src/c.md", 0, "old"), ("gone", 1, "old")], "path string, mtime int, word string")
    got = {(r.path, r.word) for r in S.cached_index(f, cache, lambda d: d.withColumn("word", F.lit("new"))).collect()}
    assert got == {("docs/a.md", "old")} | {(p, "new") for p in ("doc/b.MD", "src/c.md", "docs/.git/d.md", "docs/e.py", "notes/f.mdx")}


def test_versions_of_several_tables_and_migration(spark, tmp_path):
    root, parents = str(tmp_path / "v"), spark.range(3).toDF("id")
    T.write_versions({"anchors": parents, "chunks": spark.range(7).toDF("id")}, root)
    assert T.read_current(spark, root, "anchors").count() == 3 and T.read_current(spark, root, "chunks").count() == 7
    T.write_versions({"anchors": parents.where("id = 1"), "chunks": parents}, root)
    assert T.read_current(spark, root, "anchors").count() == 1 and T.read_current(spark, root, "chunks").count() == 3
    old = spark.createDataFrame([("a/test_x.py", 1, "z")], "path string, n int, gone string")
    from lodestrata.functions.text import is_test_path

    new = T.migrated(old, "path string, n long, is_test boolean, note string", {"is_test": is_test_path(F.col("path"))})
    assert new.dtypes == [("path", "string"), ("n", "bigint"), ("is_test", "boolean"), ("note", "string")] and tuple(new.first()) == ("a/test_x.py", 1, True, None)
    assert tuple(T.migrated(new, "path string, n long, is_test boolean, note string").first()) == tuple(new.first())


def test_pushed_snapshots(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int").write.parquet(str(tmp_path / "in"))
    told = []
    s = spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in")).groupBy("k").agg(F.sum("v").alias("v"))
    S.push_snapshots(s, str(tmp_path / "out"), str(tmp_path / "cp"), told.append, once=True).awaitTermination()
    assert len(told) == 1 and {tuple(r) for r in T.read_current(spark, str(tmp_path / "out")).collect()} == {("a", 4), ("b", 2)}


def test_pruned_listing(spark, tmp_path):
    for p in ("a.py", "docs/b.md", "node_modules/x/c.js", "src/.git/d", "src/deep/e.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert [x.removeprefix(str(tmp_path)) for x in FS.folders(spark, str(tmp_path))] == ["", "/docs", "/src", "/src/deep"]
    got = {(r.path, r.kind) for r in FS.repository(spark, str(tmp_path)).collect()}
    assert got == {("a.py", "code"), ("docs/b.md", "markdown"), ("src/deep/e.ts", "code")}
    assert FS.repository(spark, str(tmp_path)).where("skip_reason is not null").count() == 0


def test_endless_fixpoint_is_told(spark):
    from lodestrata.operators import graph as G

    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "src string, dst string")
    st = spark.createDataFrame([(f"n{i}", "lsp_error" if i == 5 else "complete") for i in range(6)], "id string, status string")
    with pytest.raises(RuntimeError):
        G.worst_status(e, st, max_rounds=2)
    assert {r.status for r in G.worst_status(e, st).collect()} == {"lsp_error"}
