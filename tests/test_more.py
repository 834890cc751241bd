"""Fingerprints, verifiers and the seams to outside models."""

import itertools
import random

import numpy as np
from lodestrata.functions import fingerprint as FP
from lodestrata.operators import verifiers as VR
from lodestrata.sources import providers as P
from pyspark.sql import functions as F


def test_simhash(spark):
    a = "the quick brown fox jumps over the lazy dog " * 5
    x, y, z = FP.simhash_of(a), FP.simhash_of(a + "indeed"), FP.simhash_of("entirely different words stand here instead")
    d = lambda p, q: bin((p ^ q) & (2**64 - 1)).count("1")
    assert d(x, y) < 12 < d(x, z) and FP.simhash_of(None) is None and isinstance(FP.simhash_of(""), int)
    got = [r[0] for r in spark.createDataFrame([(a,), (None,), ("",)], "t string").select(FP.simhash("t")).collect()]
    assert got == [x, None, FP.simhash_of("")]


def test_similar_fingerprints_against_brute_force(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(6)]
    vals = [rnd.choice(base) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) for _ in range(80)] + [0, 2**64 - 1, 2**63]
    rows = [(f"k{i}", v - 2**64 if v >= 2**63 else v) for i, v in enumerate(vals)] + [("n", None), (None, 0), ("k0", 5)]
    df = spark.createDataFrame(rows, "key string, f long")
    for dist in (0, 3, 6):
        want = {}
        for (ka, a), (kb, b) in itertools.product([r for r in rows if None not in r], repeat=2):
            if ka < kb and (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= dist:
                want.setdefault((ka, kb), set()).add(d)
        got = {}
        for r in FP.similar_fingerprints(df, key="key", fingerprint="f", distance=dist).collect():
            got.setdefault((r.key_a, r.key_b), set()).add(r.distance)
        assert got == want


def test_verifiers(spark):
    c = spark.createDataFrame(
        [(1, "env_var_name", "APP_MODE"), (2, "env_var_name", "APP"), (3, "env_var_name", "APP_MODEX"), (4, "env_var_name", "OTHER_THING"), (5, "env_var_name", "WORKDIR"), (6, "enum_count", "3 states"), (7, "enum_count", "4 states"), (8, "enum_count", "2 plugins"), (9, "route_path", "/api/v1/users/"), (10, "route_path", "/api/v1/none"), (11, "numeric_value", "3"), (12, "symbol_exists", "Go"), (13, "file_path", "src/x")],
        "claim_id int, claim_type string, subject string",
    )
    repo = {
        "strings": spark.createDataFrame([("APP_MODE", "src/a.py"), ("OTHER_THING", "docs/a.md")], "value string, path string"),
        "enums": spark.createDataFrame([("JobState", ["a", "b", "c"])], "name string, members array<string>"),
        "routes": spark.createDataFrame([("/srv/api/v1/users",)], "route string"),
        "symbols": spark.createDataFrame([("go",)], "name string"),
        "files": spark.createDataFrame([("src/x/y.py",)], "path string"),
    }
    got = {r.claim_id: r.verdict for r in VR.verify_all(c, repo).collect()}
    assert got == {1: "confirmed", 2: "confirmed", 3: "stale_target", 4: "contradicted", 5: "confirmed", 6: "confirmed", 7: "contradicted", 8: "unverifiable", 9: "confirmed", 10: "contradicted", 11: "unverifiable", 12: "confirmed", 13: "confirmed"}


def test_embedding_seam(spark):
    e = P.StubEmbedder(4)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (3, "")], "chunk_id long, text string")
    got = {r.chunk_id: r.embedding for r in P.embed(df, "text", e, batch=1).collect()}
    assert np.allclose(got[1], e.encode(["a"])[0]) and got[2] is None and len(got[3]) == 4
    old = spark.createDataFrame([(1, [9.0] * 4), (3, [1.0]), (7, [1.0] * 4)], "chunk_id long, embedding array<float>")
    again = {r.chunk_id: r.embedding for r in P.reembed(df, old, e).collect()}
    assert again[1] == [9.0] * 4 and set(again) == {1, 2, 3} and len(again[3]) == 4


def test_judges(spark):
    class Odd:
        def complete(self, payload):
            if payload == "x":
                raise RuntimeError
            return payload

    pay = spark.createDataFrame([(0, "x"), (1, '[{"pair_id":"p_0","should_link":true,"link_type":"tests","confidence":0.8}]'), (2, "no json")], "batch_no int, payload string")
    assert [r.pair_id for r in P.responses(P.judge(pay, Odd())).collect()] == ["p_0"]
    ans = spark.createDataFrame([("a", "b", "call"), ("a", "b", "call"), ("c", "b", "extends")], "caller string, callee string, kind string")
    assert P.call_edges(ans).count() == 1 and [tuple(r) for r in P.subclasses(ans).collect()] == [("b", "c")]


def test_payloads_and_candidates(spark):
    from lodestrata.operators import suggest as S

    anchors = spark.createDataFrame([(f"s{i}", "section", "d" * 3000) for i in range(3)] + [(f"c{i}", "code", None if i == 5 else "c" * 3000) for i in range(30)], "id string, anchor_type string, content_text string")
    pairs = spark.createDataFrame([(f"s{i % 3}", f"c{i}") for i in range(30)] + [("s0", "c0")], "section_id string, code_id string")
    import json

    got = [json.loads(r.payload) for r in S.payloads(pairs, anchors, batch=4, lanes=2).collect()]
    flat = [p for b in got for p in b]
    assert len(flat) == len({p["pair_id"] for p in flat}) == 30 and max(map(len, got)) == 4
    assert all(len(p["doc"]) == 1500 and len(p.get("code", "c" * 2000)) == 2000 for p in flat)
    near = spark.createDataFrame([("s0", "c0", 0.9), ("c0", "s0", 0.8), ("s1", "s2", 0.9), ("s1", "c1", 0.7), ("s2", "c2", 0.6)], "a string, b string, similarity double")
    live = spark.createDataFrame([("c1", "s1")], "from_id string, to_id string")
    assert [tuple(r) for r in S.candidate_pairs(near, anchors, live, most=5).collect()] == [("c0", "s0", 0.9), ("c2", "s2", 0.6)]
    audit = {tuple(r) for r in S.audit_pairs(live, near, anchors).collect()}
    assert audit == {("s1", "c1", "link"), ("s0", "c0", "similar"), ("s2", "c2", "similar")}
