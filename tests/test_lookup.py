from lodestrata.operators import lookup as K
from lodestrata.sources import tables as T
from pyspark.sql import functions as F


def test_repaired_ids(spark):
    a = spark.createDataFrame([("r/a.md::x::y",), ("r/b.py:F",), ("r/c.md::x",)], "id string")
    asked = spark.createDataFrame([("r/a.md:x:y",), ("r/b.py::F",), ("r/c.md:x",), ("r/a.md::x::y",), ("none",), ("none",)], "asked string")
    assert {tuple(r) for r in K.repaired_ids(asked, a).collect()} == {("r/a.md:x:y", "r/a.md::x::y"), ("r/b.py::F", "r/b.py:F"), ("r/c.md:x", "r/c.md::x"), ("r/a.md::x::y", "r/a.md::x::y"), ("none", None)}


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert T.current_version(spark, root) is None
    first = T.write_version(spark.range(3).toDF("x"), root)
    second = T.write_version(spark.range(5).toDF("x"), root)
    assert T.current_version(spark, root) == second != first and T.read_current(spark, root).count() == 5
    assert T.config_hash({"b": 1, "a": [2]}) == T.config_hash({"a": [2], "b": 1}) != T.config_hash({"a": [2]})


def test_checks_and_diffs(spark):
    rows = [("a", "/abs", "code", None, None), ("b", "p", "section", "h", None), ("c", "p", "code", "h", "complete"), ("c", "p", "code", None, None), (None, "p", "code", None, None)]
    df = spark.createDataFrame(rows, "id string, path string, anchor_type string, closure_hash string, transitive_hash_status string")
    got = sorted((r.id or "", r.problems) for r in K.invalid_anchors(df).collect())
    assert got == [("", ["id"]), ("a", ["path"]), ("b", ["closure on other than code"]), ("c", ["id given twice"]), ("c", ["id given twice"])]
    d = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, "x")], "o string, n string").select(K.unified_diff("o", "n").alias("d"))
    out = [r.d for r in d.collect()]
    assert "-b" in out[0] and "+c" in out[0] and out[1] == "" and out[2] is None


def test_test_calls_and_enums(spark):
    ts = "describe('outer', () => {\n  it(\"adds (one)\", () => { f('it(\"no\")'); });\n  // it('no', x)\n  describe.only(`inner`, () => { test('deep', g); });\n});\nit('alone', h);\nobj.test('no');\n"
    py = "from enum import Enum\nclass Job(Enum):\n    A = 1\n    B = 2\n    _x = 3\nclass Plain:\n    C = 1\n"
    df = spark.createDataFrame([("a.ts", ts), ("b.py", py), ("c.py", "def ("), ("d.ts", None)], "path string, text string")
    assert [r.title for r in K.test_calls(df).orderBy("start").collect()] == ["outer", "outer::adds (one)", "outer::inner", "outer::inner::deep", "alone"]
    assert [(r.name, r.members) for r in K.enums(df).collect()] == [("Job", ["A", "B"])]


def test_get_links(spark):
    e = spark.createDataFrame([("l1", "a", "b", "tests"), ("l2", "b", "a", "mirrors"), ("l3", "a", "a", "tests")], "link_id string, from_id string, to_id string, link_type string")
    got = lambda **kw: sorted((r.link_id, r.direction) for r in K.get_links(e, "a", **kw).collect())
    assert got() == [("l1", "outgoing"), ("l2", "incoming"), ("l3", "incoming"), ("l3", "outgoing")]
    assert got(direction="incoming", types=["mirrors"]) == [("l2", "incoming")]


def test_columns_reach_the_scan(spark):
    """The feed's query reads only what it needs, and nothing of the core is collected by a Cartesian product."""
    from lodestrata.plans import data_queries

    df = data_queries.p4_found(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "from_content_hash" not in plan and "Cartesian" not in plan and "evidence" not in plan
    assert F is not None
