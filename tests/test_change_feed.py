import random

from lodestrata.operators.change_feed import apply_changes, deduplicate

COLS = "k string, e string, sup string, ts int, op string, at int, extra string"
ARGS = {"key": "k", "event": "e", "replaces": "sup", "order_by": "ts", "op": "op", "arrival": ["at"]}


def brute(rows):
    first = {}
    for r in rows:
        if r[1] is not None:
            key = tuple((x is None, x) if x is not None else (True, 0) for x in (r[5],))
            if r[1] not in first or key < first[r[1]][0]:
                first[r[1]] = (key, r)
    recs = [r for _, r in first.values()]
    cur = {}
    for r in recs:
        if not any(s[0] == r[0] and s[2] == r[1] and s[1] != r[1] for s in recs):
            rank = (r[3] is not None, r[3] or 0, r[1])
            if r[0] not in cur or rank > cur[r[0]][0]:
                cur[r[0]] = (rank, r)
    return {(r[0], r[1]) for _, r in cur.values() if r[4] != "delete"}


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        k = rnd.choice([None, "hot", "hot", *[f"l{j}" for j in range(40)]])
        rows.append((k, f"e{i}", rnd.choice([None, f"e{rnd.randrange(400)}", f"e{i}", "gone"]), rnd.choice([None, 1, 2, 3]), rnd.choice(["upsert", "delete"]), rnd.randrange(9), None))
    for r in list(rows[:300]):
        if r[2] is None:
            prev = rnd.choice([x for x in rows if x[0] == r[0]])
            rows.append((r[0], "f" + r[1], prev[1], 5, "upsert", 3, "x"))
    rows += [(*r[:5], r[5] + 10, "again") for r in rows[:200]] + rows[:50] + [(None, None, None, None, None, None, None), ("x", None, "e1", 1, "upsert", 1, "")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, COLS)
    got = apply_changes(df, **ARGS)
    assert got.columns == df.columns
    assert {(x.k, x.e) for x in got.collect()} == brute(rows)


def test_cases(spark):
    def run(rows, **kw):
        return {(x.k, x.e) for x in apply_changes(spark.createDataFrame(rows, COLS), **ARGS, **kw).collect()}

    assert run([]) == set()
    assert run([("a", "1", "2", 1, "upsert", 1, ""), ("a", "2", "1", 2, "upsert", 1, "")]) == set()  # a circle
    assert run([("a", "1", None, 9, "upsert", 1, ""), ("a", "2", "1", 1, "delete", 1, "")]) == set()
    assert run([("a", "2", "1", 1, "delete", 1, "")], keep_deleted=True) == {("a", "2")}
    assert run([("a", "3", "2", 1, "upsert", 1, ""), ("a", "2", "1", 1, "delete", 1, "")]) == {("a", "3")}
    base = spark.createDataFrame([("b", "0", None, 0, "upsert", 0, ""), ("a", "1", None, 0, "upsert", 0, "")], COLS)
    assert run([("a", "2", "1", 1, "upsert", 1, ""), ("b", "0", None, 0, "upsert", 0, "")], base=base) == {("a", "2"), ("b", "0")}


def test_first_delivery_stays(spark):
    df = spark.createDataFrame([("a", "1", None, 1, "upsert", 7, "late"), ("a", "1", None, 1, "upsert", 2, "first"), ("a", "1", None, 1, "upsert", None, "never")], COLS)
    assert [x.extra for x in deduplicate(df, event="e", arrival=["at"]).collect()] == ["first"]
