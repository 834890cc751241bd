import random

import pytest
from lodestrata.functions.text import symbol_similarity
from lodestrata.operators import claims as C
from pyspark.sql import functions as F


def _names(seed: int) -> list[str]:
    """Names of shared words in camel and snake form, parts of them, and texts of few letters."""
    r = random.Random(seed)
    words = ["get", "set", "lattice", "anchor", "eager", "nested", "queue", "ab", "x", "9"]
    made = [f(r.choices(words, k=r.randint(1, 4))) for _ in range(60) for f in ("_".join, "".join, lambda w: "".join(x.title() for x in w), "--".join)]
    return sorted({*made, *("".join(r.choices("abA_", k=r.randint(0, 7))) for _ in range(80)), "", "_", "-", "a", "B", "Ab", "ß", "İst", "Ünïcode", "ünï", "aaaaaaaa", "aaaa"})


@pytest.mark.parametrize("least, most", [(0.0, 3), (0.5, 10_000), (0.75, 3)])
def test_no_pair_above_the_least_is_lost(spark, least, most):
    df = lambda names, c: spark.createDataFrame([(x,) for x in [*names, names[0], None]], f"{c} string")
    q, s = df(_names(1)[::3], "query"), df(_names(2), "name")
    every = q.distinct().crossJoin(s.distinct()).withColumn("similarity", F.round(symbol_similarity(F.col("query"), F.col("name")), 6)).where(F.col("similarity") > least)
    want = {}
    for r in every.collect():
        want.setdefault(r.query, []).append((-r.similarity, r.name.encode(), r.similarity))
    got = {}
    for r in C.fuzzy_symbols(q, s, least=least, most=most).collect():
        got.setdefault(r.query, []).append((-r.similarity, r.name.encode(), r.similarity))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:most] for k, v in want.items()}


def test_only_what_the_join_leaves_is_compared(spark):
    """Trigrams that most names share make no pairs, and similarities are not computed in a join."""
    names = spark.range(3000).select(F.concat(F.lit("get_the_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("name"))
    df = C.fuzzy_symbols(names.withColumnRenamed("name", "query"), names)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Join" in x for x in lines) >= 4 and not any("Join" in x and "array_intersect" in x for x in lines)
    got = df.collect()
    assert sum(r.query == r.name and r.similarity == 1.0 for r in got) == 3000
