"""Operators of the index against small cases worked out by hand, and edge cases."""

import datetime
import random

from lodestrata.functions import text as X
from lodestrata.functions import vectors as V
from lodestrata.operators import claims as C
from lodestrata.operators import extraction as E
from lodestrata.operators import graph as G
from lodestrata.operators import incremental as I
from lodestrata.operators import links as L
from lodestrata.operators import retrieval as R
from lodestrata.operators import suggest as S
from lodestrata.sources import files as FI
from lodestrata.streaming import maintenance as ST
from pyspark.sql import functions as F


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_text_functions(spark):
    s = "t string"
    assert values(spark, X.canonical(F.col("t")), [("﻿a \r\nb\t\r\n\r\n",), (None,), ("",)], s) == ["a\nb\n", None, ""]
    assert values(spark, X.approx_tokens(F.col("t")), [("a b c",), ("",), ("x " * 10,)], s) == [4, 1, 14]
    assert values(spark, X.snake(F.col("t")), [("parseHTTPBody",), ("a-b_C",), ("_x_",)], s) == ["parse_http_body", "a_b_c", "x"]
    assert values(spark, X.is_test_path(F.col("t")), [("src/tests/a.py",), ("a_test.go",), ("src/a.py",), (None,)], s) == [True, True, False, False]
    assert values(spark, X.matches_globs(F.col("t"), ["src/**/*.py", "docs/*.md", "README"]), [("src/a/b.py",), ("src/b.py",), ("docs/x/y.md",), ("README",), ("xREADME",)], s) == [True, True, True, True, False]
    assert values(spark, X.symbol_similarity(F.col("t"), F.lit("loadFile")), [("LOADFILE",), ("load_file",), ("file",), ("zz",)], s) == [1.0, 0.95, 0.75, 0.0]
    assert values(spark, X.declared_name(F.col("t")), [("x = 1\nexport async function go() {}",), ("nothing",)], s) == ["go", None]
    assert values(spark, X.url_slug(F.col("t")), [("a/b c",)], s) == ["a%2Fb%20c"]
    assert values(spark, X.signed64(F.col("t")), [("ffffffffffffffff",), ("7fffffffffffffff",)], s) == [-1, 2**63 - 1]
    assert values(spark, X.pinned_id(F.col("t")), [("# A <!-- id: one-two -->",), ("# A",)], s) == ["one-two", None]


def test_vectors(spark):
    s = "a array<float>, b array<float>"
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])]
    assert values(spark, V.cosine(F.col("a"), F.col("b")), rows, s) == [0.0, 1.0, 0.0, 0.0, None]
    assert values(spark, V.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long")), [([1.0], [1.0])], s) == [62]


def test_outline_and_slugs(spark):
    text = "# A\n```py\n# no heading\ndef f():\n    pass\n```\n## B\n### C\n## B\n##### deep\n# D\n~~~\nopen"
    heads, blocks = E.outline(text)
    assert [(h[0], h[1], h[2], h[3]) for h in heads] == [(1, "A", 1, 10), (2, "B", 7, 8), (3, "C", 8, 8), (2, "B", 9, 10), (5, "deep", 10, 10), (1, "D", 11, 13)]
    assert [b[4] for b in blocks] == [0, 5]
    assert E.unique(["a", "a", "a-2", "a"]) == ["a", "a-3", "a-2", "a-4"]
    assert E.slug("Über  Straße!") == "uber-strae" and E.slug("日本").startswith("section-")
    df = spark.createDataFrame([("d", text), ("n", None), ("e", "")], "doc string, text string")
    got = {(r.anchor_id, r.anchor_type) for r in E.markdown_anchors(df).collect()}
    assert ("d::a::b-2", "section") in got and ("d::a#f", "code_in_doc") in got and all(a.startswith("d") for a, _ in got)


def log(spark, rows):
    return spark.createDataFrame(rows, "layer int, pos int, op string, link_id string, event_id string, supersedes string, from_id string, to_id string, link_type string, ts int")


def test_links(spark):
    df = log(spark, [(0, 1, "upsert", "l1", "e1", None, "a", "b", "tests", 1), (1, 1, "delete", "l1", "e2", "e1", None, None, None, 2), (0, 2, "upsert", "l2", "e3", None, "a", "c", "tests", 1), (0, 3, "upsert", "l3", "e4", "e3", "x", "y", "tests", 1), (0, 4, "upsert", "l2", "e5", "e3", "a", "c", "tests", 2), (0, 5, "upsert", "l4", "e6", "gone", "q", "q", "tests", 2)])
    assert {r.link_id for r in L.active(df).collect()} == {"l2", "l3", "l4"}
    assert {r.link_id for r in L.conflicts(df).collect()} == {"l2", "l3", "l4"}
    once = L.promote(df, df.where("event_id = 'e2'"))
    assert once.where("layer = 1").count() == 0 and L.promote(once, df.where("event_id = 'e2'")).count() == 6
    new = log(spark, [(1, 1, "upsert", "l2", "n1", "e5", "a", "c", "tests", 1), (1, 2, "delete", "l2", "n2", "e5", None, None, None, 2), (1, 3, "delete", "l2", "n3", "n1", None, None, None, 3), (1, 4, "upsert", "l2", "n4", "n3", "a", "c", "tests", 4), (1, 1, "delete", "l9", "n5", "e1", None, None, None, 1)])
    bad = {r.event_id: r.violation for r in L.validate_appends(df, new).collect()}
    assert bad == {"n1": None, "n2": "replaces another than the last record", "n3": None, "n4": "link is deleted", "n5": "delete of an unknown link"}
    assert L.active(df.where("false")).count() == 0 and L.conflicts(df.where("false")).count() == 0


def test_graph_against_brute_force(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(45)] + [(None, "n1"), ("n1", None)]
    e = spark.createDataFrame(edges, "src string, dst string")
    want = {}
    for root in {s for s, _ in edges if s}:
        seen, front = {root}, {root}
        for depth in range(1, 5):
            front = {d for s, d in edges if s in front and d and s != d} - seen
            seen |= front
            want |= {(root, n): depth for n in front}
    got = {(r.root, r.node): r.depth for r in G.closure(e, e.select(F.col("src").alias("id")), max_depth=4).collect()}
    assert got == want
    st = spark.createDataFrame([(f"n{i}", rnd.choice(G.STATES)) for i in range(25)], "id string, status string")
    rank = {r.id: G.STATES.index(r.status) for r in st.collect()}
    for _ in range(30):
        for s, d in edges:
            if s and d:
                rank[s] = max(rank[s], rank[d])
    assert {r.id: G.STATES.index(r.status) for r in G.worst_status(e, st).collect()} == rank
    assert G.closure(e.where("false"), e.select(F.col("src").alias("id"))).count() == 0


def test_claims(spark):
    text = "# Head\nCall `loadFile` now.\n```\n`hidden_symbol`\n```\nThe timeout is 30 seconds.\nIt has 5 states and each is fine.\nSet `APP_MODE` first.\nGET /api/v1/users works.\nSee `src/a/b.py`.\nNever do it.\nkey = `someValue`\n"
    df = spark.createDataFrame([("d", text), ("n", None)], "doc string, text string")
    got = {(r.line_no, r.claim_type, r.subject) for r in C.extract(df).collect()}
    assert got == {(2, "symbol_exists", "loadFile"), (6, "numeric_value", "30"), (7, "enum_count", "5 states"), (8, "env_var_name", "APP_MODE"), (9, "route_path", "/api/v1/users"), (10, "file_path", "src/a/b.py"), (11, "coverage_assertion", "never")}
    sym = spark.createDataFrame([("LoadFile",)], "name string")
    ver = {r.claim_type: (r.verdict, r.confidence) for r in C.verify(C.extract(df), sym, spark.createDataFrame([("src/a/b.py/x",)], "path string")).collect()}
    assert ver["symbol_exists"] == ("confirmed", 0.75) and ver["file_path"] == ("confirmed", 1.0) and ver["env_var_name"][0] == "unverifiable"


def test_retrieval_fusion(spark):
    a = spark.createDataFrame([(0, "p", 1, 1), (0, "q", 2, 2)], "query_id int, parent_id string, chunk_id int, place int")
    b = spark.createDataFrame([(0, "q", 2, 1)], "query_id int, parent_id string, chunk_id int, place int")
    got = {r.parent_id: r.score for r in R.fuse([("vec", a), ("bm25", b)]).collect()}
    assert abs(got["p"] - 1 / 61) < 1e-9 and abs(got["q"] - 1 / 62 - 1 / 61) < 1e-9


def test_maintenance(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, content_hash string")
    assert {tuple(r) for r in I.manifest_diff(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("d", "new")}
    st = spark.createDataFrame([("h", "2", "m", "x", "1", "m", "x"), ("d", "1", "m", "x", "1", "m", "x"), ("b", "1", None, "x", "1", "m", "x"), ("c", "1", "m", "y", "1", "m", "x"), ("f", "1", "m", "x", "1", "m", "x")], "repo string, head string, branch string, config_hash string, indexed_head string, indexed_branch string, indexed_config_hash string")
    dirty = spark.createDataFrame([("d", "p"), ("f", "q")], "repo string, path string")
    man = spark.createDataFrame([("d", "p")], "repo string, path string")
    stale = I.staleness(st, dirty, man)
    assert {r.repo: r.reason for r in stale.collect()} == {"h": "head_changed", "d": "dirty_files", "b": "branch_changed", "c": "config_changed", "f": None}
    many = spark.createDataFrame([("h", str(i)) for i in range(501)], "repo string, path string")
    assert {r.repo: r.index_state for r in I.index_state(stale, many).collect()}["h"] == "stale-warned"


def test_judgement(spark):
    pairs = spark.createDataFrame([("p_0",), ("p_1",)], "pair_id string")
    resp = spark.createDataFrame([("p_0", True, "tests", 0.9), ("p_1", True, "tests", 0.2), ("p_9", True, "tests", 0.9), ("p_1", False, "tests", 0.9), ("p_1", True, "odd", 0.9), ("p_1", True, "tests", 7.0), ("p_1", None, None, None)], "pair_id string, should_link boolean, link_type string, confidence double")
    assert sorted(r.reason or "" for r in S.judged(resp, pairs).collect()) == ["", "confidence out of range", "confidence too low", "not to be linked", "not to be linked", "unknown link type", "unknown pair"]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for n, b in {"src/a.py": b"x = 1\n", "node_modules/x.js": b"1", "u.md": b"\xff\xfea\x00", "bad.md": b"\xc3\x28", "n.txt": b"t"}.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path: (r.kind, r.skip_reason) for r in FI.repository(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("code", None), "u.md": ("markdown", "utf-16"), "bad.md": ("markdown", "not-utf-8"), "n.txt": ("skip", None)}
    assert values(spark, FI.skip_reason(F.col("b")), [(b"",), (b"a" * 20,), (None,)], "b binary") == ["empty", None, None]
    t = spark.createDataFrame([("---\ntype: spec\nid: 'x-1'\nskip: yes\n---\nbody",), ("no",)], "t string")
    a, b, c = FI.frontmatter(F.col("t"))
    assert [tuple(r) for r in t.select(a, b, c).collect()] == [("spec", "x-1", True), (None, None, False)]
    p = tmp_path / "log.jsonl"
    p.write_text('{"op":"upsert","link_id":"l","event_id":"e1"}\nnot json\n\n{"op":"delete","link_id":"l","event_id":"e2"}\n')
    rows = FI.event_log(spark, str(p), 0)
    assert [r.op for r in L.last_events(rows).collect()] == ["delete"] and rows.count() == 2
    FI.append_events(rows.select("op", "event_id"), str(tmp_path / "t"))
    FI.append_events(rows.select("op", "event_id"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_streams(spark, tmp_path):
    base = datetime.datetime(2025, 1, 1)
    at = lambda s: base + datetime.timedelta(seconds=s)
    ev = spark.createDataFrame([("f", at(0), "a"), ("f", at(0.2), "a"), ("f", at(5), "b"), ("g", at(1), "c"), ("z", at(9000), "d")], "path string, ts timestamp, token string")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))

    def collect(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {(r.path, r.n) for r in collect(ST.bursts(stream(), key="path", at="ts", late="1 second"), "bursts")}
    assert got == {("f", 2), ("f", 1), ("g", 1)}
    assert {r.n for r in collect(ST.windows(stream(), key="path", at="ts", size="10 seconds", late="1 second"), "windows")} == {3, 1}
    assert len(collect(ST.once(stream(), token="token", at="ts"), "once")) == 4
    feed = spark.createDataFrame([(0, "upsert", "l", "e1", 1, 1, None), (0, "upsert", "l", "e2", 2, 1, "e1"), (1, "upsert", "l", "e1", 1, 2, None)], "layer int, op string, link_id string, event_id string, ts int, received_at int, supersedes string")
    feed.coalesce(1).write.parquet(str(tmp_path / "feed"))
    q = ST.keep_links(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed")), lambda n: str(tmp_path / f"state{n}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.event_id for r in ST.links_after(spark.read.parquet(str(tmp_path / "state0"))).collect()] == ["e2"]
