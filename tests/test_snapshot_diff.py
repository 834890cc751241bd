import random

import numpy as np
import pytest
from lodestrata.operators.snapshot_diff import _chunks, index_changes, snapshot_changes

ARGS = {"run_id": "r", "series": ["s"], "order_by": "t", "key": "k", "value": "v"}
ITEMS, RUNS = "r long, k string, v string, ver int, extra string", "r long, s string, t int, extra string"


def brute(items, runs):
    snap = {}
    for r, k, v, ver, _ in items:
        if k is not None and r is not None:
            d = snap.setdefault(r, {})
            if k not in d or (ver, v is not None, v or "") > d[k][0]:
                d[k] = ((ver, v is not None, v or ""), v)
    series = {}
    for r, s, t, _ in set(runs):
        if r is not None:
            series.setdefault(s, []).append((t, r))
    out = set()
    for rs in series.values():
        rs.sort()
        for (_, a), (_, b) in zip(rs, rs[1:]):
            old, new = snap.get(a, {}), snap.get(b, {})
            for k in old.keys() | new.keys():
                if k not in old:
                    out.add((b, k, "added"))
                elif k not in new:
                    out.add((b, k, "removed"))
                elif old[k][1] != new[k][1]:
                    out.add((b, k, "changed"))
    return out


def run(spark, items, runs, **kw):
    df = snapshot_changes(spark.createDataFrame(items, ITEMS), spark.createDataFrame(runs, RUNS), version="ver", **ARGS, **kw)
    rows = [(x["r"], x["item_key"], x["change_kind"]) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,chunk", [(1, 2), (2, 5), (3, 1)])
def test_random_against_brute_force(spark, seed, chunk):
    rnd = random.Random(seed)
    runs = [(r, rnd.choice(["a", "b", None]), rnd.randrange(50) * 100 + r, "x") for r in range(14)] + [(3, "a", 1, "y")]
    runs = [x for x in runs if x[0] != 3] + [(3, "a", 777, "y")] * 2
    items = []
    for r in range(16):  # two runs aren't counted
        if r in (5, 6):
            continue
        for _ in range(rnd.randrange(60)):
            items.append((r, rnd.choice([None, "", "k" * 3000, *[f"p/{i}" for i in range(40)]]), rnd.choice([None, "h1", "h2"]), rnd.randrange(3), "z"))
    items += items[:30]
    assert run(spark, items, runs, chunk_rows=chunk) == brute(items, runs)


def test_empty_and_vanished(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, "a", "h", 0, "")], [(1, "s", 1, "")]) == set()
    assert run(spark, [(1, "a", "h", 0, "")], [(1, "s", 1, ""), (2, "s", 2, ""), (3, "s", 3, "")]) == {(2, "a", "removed")}
    assert run(spark, [(2, "a", None, 0, "")], [(1, "s", 1, ""), (2, "s", 2, "")]) == {(2, "a", "added")}


def test_chunks_move_no_foreign_boundary():
    keys = [f"k{i:04}" for i in range(400)]
    ends = [i % 7 == 0 for i in range(400)]
    digests = lambda ks, es: set(_chunks(*(np.array([hash((i, k)) for k in ks]) for i in (1, 2)), np.array(es))[0])
    a = digests(keys, ends)
    b = digests(keys[:100] + ["k0099x"] + keys[100:], ends[:100] + [False] + ends[100:])
    assert len(a - b) == 1 and len(b - a) == 1


def test_index_changes_normal_forms(spark):
    h, g = "a" * 64, "b" * 64
    meta = spark.createDataFrame(
        [
            (1, "r", "m", f'{{"./x\\\\y.py": "sha256:{h}", "z": "{g}"}}', 1),
            (1, "r", "m", f'{{"./x\\\\y.py": "sha256:{h}", "z": "{g}"}}', 1),
            (2, "r", "m", None, 2),
            (3, "r", "m", f'{{ "x/y.py" : "{h.upper()}" }}', 3),
            (4, "r", "m", "{}", 4),
        ],
        "index_id long, repo string, indexed_branch string, indexed_file_manifest string, updated_at int",
    )
    snaps = spark.createDataFrame([(1, "A", h, 1), (1, "A", g, 2), (2, "B", g, 1), (3, "A", "SHA256:" + g.upper(), 1)], "index_id long, anchor_id string, content_hash string, written_at int")
    got = {tuple(x) for x in index_changes(meta, snaps).collect()}
    assert got == {(3, "file", "z", "removed"), (4, "file", "x/y.py", "removed"), (4, "anchor", "A", "removed")}
