import random
import re

import pytest
from lodestrata.llm import near_duplicates as nd


def brute(rows, bound, width):
    sets = {}
    for key, text in rows:
        if key is not None and text is not None:
            w = re.findall("[a-z0-9]+", text.lower())
            s = frozenset(zip(*[w[i:] for i in range(width)]))
            if s:
                sets.setdefault(key, set()).add(s)
    keys = sorted(sets)
    hit = lambda a, b: any(len(x & y) / len(x | y) >= bound - 1e-12 for x in sets[a] for y in sets[b])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if hit(a, b)}


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 5, 12, 40]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            k = rnd.randrange(len(w))
            w[k : k + rnd.choice([0, 1])] = [rnd.choice(words)]
        rows.append((f"id{i:03}", rnd.choice([" ", "\n", ", "]).join(w) if rnd.random() < 0.8 else " ".join(w).upper()))
    return rows


def found(spark, rows, bound, width, **kw):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "key string, text string, s string, n int")
    out = [(r.key_a, r.key_b) for r in nd.similar_pairs(df, key="key", text="text", bound=bound, width=width, **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("bound,width,bits,hits,rows", [(0.7, 3, 4, 2, 20_000), (0.8, 5, 10, 1, 20_000), (0.5, 1, 2, 3, 7)])
def test_random_against_brute_force(spark, monkeypatch, bound, width, bits, hits, rows):
    monkeypatch.setattr(nd, "LIST_ROWS", rows)  # the last case splits every list
    data = corpus(bits, 90)
    assert found(spark, data, bound, width, sketch_bits=bits, hits=hits) == brute(data, bound, width)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(None, "a b c d"), ("n", None), ("e", ""), ("t", "a b"), ("a", "a b c d"), ("b", "A, b; c d!"), ("a", "a b c d"), ("a", "q r s t"), ("c", "q r s t"), ("l1", long), ("l2", long + " y")]
    assert found(spark, rows, 0.7, 3) == {("a", "b"), ("a", "c"), ("l1", "l2")}
    assert found(spark, [], 0.7, 3) == set()
    assert found(spark, [("a", "x"), ("b", None)], 0.7, 3) == set()


def test_classes_with_membership(spark):
    """Copies stay in one class; links are between classes and are as many as linked pairs of different texts."""
    data = corpus(11, 90) + [(f"copy{i}", "w1 w2 w3 w4 w5 w6") for i in range(40)]
    df = spark.createDataFrame([(k, t, "x") for k, t in data] + [(None, "a b c d", "x"), ("none", None, "x")], "key string, text string, class string")
    members, links = nd.near_classes(df, key="key", text="text", bound=0.7, width=3)
    of = {}
    for r in members.collect():
        of.setdefault(r["class"], set()).add(r.key)
    assert any({f"copy{i}" for i in range(40)} <= v for v in of.values())
    got = {tuple(sorted((a, b))) for v in of.values() for a in v for b in v if a < b}
    pairs = links.collect()
    assert len(pairs) == len({(r.class_a, r.class_b) for r in pairs}) and all(r.class_a < r.class_b for r in pairs)
    got |= {tuple(sorted((a, b))) for r in pairs for a in of[r.class_a] for b in of[r.class_b]}
    assert got == brute(data, 0.7, 3)
    rows = nd.linked_texts(df, key="key", text="text", bound=0.7, width=3).where("key like 'copy%'").collect()
    assert {r.n_copies >= 40 for r in rows} == {True} and len(rows) == 40


def test_full_counters_split_no_list_that_is_short(spark):
    """Counters that overflow a list's bound split only lists that are really hot, so postings don't grow with them."""
    data = corpus(12, 120)
    df = spark.createDataFrame([(k, t) for k, t in data], "key string, text string")
    sets = nd.shingle_sets(df, key="key", text="text", width=3)
    lengths = nd.list_lengths(sets, 1)
    assert lengths.max() > 100  # two cells hold all
    postings = lambda hot: sets.select("_c", "_set").mapInArrow(lambda it: nd._short_lists(it, shared, 0.7, 2, hot), "s long, q int, whole boolean, c long, blk int, n int, p int")
    shared = spark.sparkContext.broadcast(lengths)
    plain = postings(None)
    n = plain.count()
    longest = plain.groupBy("s").count().agg({"count": "max"}).first()[0]
    hot = nd.hot_lists(plain, lengths, 100)
    assert longest <= 100 and len(hot[0]) == 0 and postings(spark.sparkContext.broadcast(hot)).count() == n
    some = nd.hot_lists(plain, lengths, max(longest // 2, 1))
    assert len(some[0]) > 0 and n < postings(spark.sparkContext.broadcast(some)).count() < 4 * n
