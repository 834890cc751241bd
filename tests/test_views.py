from lodestrata.functions import text as X
from lodestrata.operators import suggest as S
from lodestrata.operators import verifiers as VR
from lodestrata.operators import views as V
from pyspark.sql import functions as F


def test_enum_claims(spark):
    enums = spark.createDataFrame([("a.py", "RunState", ["A", "B", "C"]), ("b.py", "Role", ["X"]), ("c.py", "RunState", ["Z"])], "path string, name string, members array<string>")
    rows = [("c1", "enum_count", "3 states", "A RunState has 3 states", ""), ("c2", "enum_count", "2 states", "the runstate has 2 states", ""), ("c3", "enum_count", "1 values", "It has 1 values", "On the role"), ("c4", "enum_count", "9 tables", "9 tables", ""), ("n1", "numeric_value", "30", "", ""), ("n2", "numeric_value", "2.0", "", "")]
    claims = spark.createDataFrame(rows, "claim_id string, claim_type string, subject string, line string, section string")
    strings = spark.createDataFrame([("a.py", "2")], "path string, value string")
    got = {r.claim_id: (r.verdict, r.confidence) for r in VR.enum_counts(claims.where("claim_type = 'enum_count'"), {"enums": enums}).collect()}
    assert got == {"c1": ("confirmed", 0.95), "c2": ("contradicted", 0.9), "c3": ("confirmed", 0.95), "c4": ("unverifiable", 0.3)}
    got = {r.claim_id: r.verdict for r in VR.numbers(claims.where("claim_type = 'numeric_value'"), {"strings": strings}).collect()}
    assert got == {"n1": "unverifiable", "n2": "confirmed"}
    m = spark.createDataFrame([("m1", "enum_members", "state", ["A", "C"]), ("m2", "enum_members", "state", ["A", "Q"]), ("m3", "enum_members", "colour", ["A"])], "claim_id string, claim_type string, subject string, members array<string>")
    got = {r.claim_id: r.verdict for r in VR.enum_members(m, {"enums": enums}).collect()}
    assert got == {"m1": "confirmed", "m2": "contradicted", "m3": "unverifiable"}
    d = {r.claim_id: (r.missing, r.extra) for r in VR.member_differences(m, enums).collect()}
    assert d == {"m1": ([], ["B"]), "m2": (["Q"], ["B", "C"])}


def test_known_terms_and_evidence(spark):
    claims = spark.createDataFrame([("e1", "env_var_name", "WORKDIR"), ("e2", "env_var_name", "API_KEY"), ("e3", "env_var_name", "NOWHERE_AT_ALL")], "claim_id string, claim_type string, subject string")
    strings = spark.createDataFrame([(f"f{i}.py", "API_KEY") for i in range(9)] + [("docs/a.md", "NOWHERE_AT_ALL")], "path string, value string")
    got = {r.claim_id: (r.verdict, r.confidence) for r in VR.variables(claims, {"strings": strings}).collect()}
    assert got == {"e1": ("confirmed", 0.5), "e2": ("confirmed", 0.9), "e3": ("contradicted", 0.6)}
    shown = [(r.place, r.path) for r in VR.evidence(claims, {"strings": strings}).where("claim_id = 'e2'").orderBy("place").collect()]
    assert shown == [(i + 1, f"f{i}.py") for i in range(5)]


def _log(spark, rows):
    s = "layer int, op string, link_id string, event_id string, supersedes string, from_id string, to_id string, link_type string, received_at int"
    return spark.createDataFrame(rows, s).withColumn("pos", F.struct("received_at", "event_id"))


def test_commit_and_recovery(spark):
    log = _log(spark, [(0, "upsert", "l1", "e1", None, "a", "b", "tests", 1), (1, "upsert", "l1", "e2", "e1", "a", "b", "tests", 2), (1, "upsert", "l2", "e3", None, "a", "c", "tests", 3), (1, "delete", "l2", "e4", "e3", None, None, None, 4)])
    after, promoted = V.commit(log)
    assert {(r.event_id, r.link_id) for r in promoted.collect()} == {("e2", "l1"), ("e3", None), ("e4", None)}
    assert after.where("layer = 1").count() == 0 and after.count() == 4
    marks = spark.createDataFrame([("m", ["e2", "e9", None]), ("empty", None)], "marker string, event_ids array<string>")
    once, done = V.recover(log, marks)
    twice, _ = V.recover(once, marks)
    assert {r.event_id for r in done.collect()} == {"e2", "e9"}
    assert sorted(map(tuple, once.select("layer", "event_id").collect())) == sorted(map(tuple, twice.select("layer", "event_id").collect())) == [(0, "e1"), (0, "e2"), (1, "e3"), (1, "e4")]
    assert {(r.link_id, r.status) for r in V.accept(log, spark.createDataFrame([("l1",), ("l2",), ("l1",)], "link_id string")).collect()} == {("l1", "accepted"), ("l2", "unknown")}
    assert V.commit(log.where("false"))[1].count() == 0


def test_suggestions_are_applied(spark):
    log = _log(spark, [(0, "upsert", "l1", "e1", None, "c1", "s1", "tests", 1)])
    anchors = spark.createDataFrame([(i, "code" if i[0] == "c" else "section", f"h{i}", None) for i in ("c1", "c2", "s1", "s2")], "id string, anchor_type string, content_hash string, closure_hash string")
    pairs = spark.createDataFrame([("p1", "c1", "s1"), ("p2", "c2", "s2"), ("p3", "c1", "s2")], "pair_id string, code_id string, section_id string")
    ans = spark.createDataFrame([("p1", True, "tests", 0.9), ("p2", True, "implements", 0.8), ("p3", False, "tests", 0.9), ("p9", True, "tests", 1.0)], "pair_id string, should_link boolean, link_type string, confidence double")
    got = V.apply_suggestions(log, anchors, pairs, S.judged(ans, pairs), ans, at=F.lit(None).cast("timestamp"), by=F.lit("x")).collect()
    assert {(r.from_id, r.to_id, r.link_type, r.supersedes) for r in got} == {("c1", "s1", "tests", "e1"), ("c2", "s2", "implements", None)}
    assert [r.link_id for r in got if r.from_id == "c1"] == ["l1"]


def test_findings_of_odd_answers(spark):
    pairs = spark.createDataFrame([("p1", "s", "c")], "pair_id string, section_id string, code_id string")
    raw = spark.createDataFrame([("no json",), (None,), ('{"findings": 3}',), ('{"findings":[{"pair_id":"p1","is_drifted":true,"severity":"low"},{"pair_id":"p1","is_drifted":true,"severity":null},{"pair_id":"p1","severity":"HIGH"}]}',)], "response string")
    got = V.audit_findings(raw, pairs).collect()
    assert [(r.pair_id, r.severity, r.place, r.suggestion) for r in got] == [("p1", "LOW", 3, "")]


def test_text_functions(spark):
    df = spark.createDataFrame([("ab\r\ncdef\ngh", 0, 1, 1, 2), ("ab\ncdef\ngh", 1, 1, 1, 3), ("ab\ncdef", 0, 0, 9, 1), ("ab", 5, 0, 6, 0), (None, 0, 0, 0, 1)], "t string, a int, b int, c int, d int")
    got = [r.s for r in df.select(X.text_slice(F.col("t"), F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).collect()]
    assert got == ["b\ncd", "de", "ab\ncdef", None, None]
    q = spark.createDataFrame([("How does C++ work?",), ('a "b',), ("  ",), (None,)], "q string")
    assert [r.s for r in q.select(X.quoted_query(F.col("q")).alias("s")).collect()] == ['"How" "does" "C++" "work?"', '"a" """b"', "", None]
    p = spark.createDataFrame([("a/secrets/k.txt",), ("a/.git/config",), ("a/key.pem",), ("a/b.py",), (None,)], "p string")
    assert [r.s for r in p.select(X.safety_excluded(F.col("p")).alias("s")).collect()] == [True, True, True, False, None]
    assert p.select(X.file_hash(F.lit(None).cast("string")).alias("h")).first().h == "sha256:" + "0" * 64


def test_compact_drops_nested_fields(spark):
    df = spark.sql("SELECT 1 AS id, 'x' AS content_hash, named_struct('path', 'p', 'def_line', 3) AS anchor, array(named_struct('id', 7, 'closure_hash', 'q')) AS links")
    out = V.compact(df)
    assert out.columns == ["id", "anchor", "links"]
    r = out.first()
    assert r.anchor.asDict() == {"path": "p"} and r.links[0].asDict() == {"id": 7}


def test_similar_opposites(spark):
    rows = [("c1", "code", [1.0, 0.0]), ("c2", "code", [0.0, 2.0]), ("s1", "section", [3.0, 0.1]), ("s2", "section", [0.0, 0.0]), ("s3", "code_in_doc", None), ("s4", "section", [1.0])]
    a = spark.createDataFrame(rows, "id string, anchor_type string, overview_embedding array<float>")
    got = {(r.a, r.b) for r in S.similar_opposites(a, a, dim=2, k=1).collect()}
    assert got == {("c1", "s1"), ("c2", "s1"), ("s1", "c1")}
    assert S.similar_opposites(a.where("false"), a.where("false"), dim=2).count() == 0
