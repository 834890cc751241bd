import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrata.llm import splitting as S

WORD = re.compile(S.WORD)


def checked(text, limit):
    spans = [m.span() for m in WORD.finditer(text)]
    out = S.split_text(text, limit)
    assert "".join(text[own:to] for _, own, to, _ in out) == text
    prev = None
    for a, own, to, rep in out:
        words = WORD.findall(text[a:to])
        if len(out) > 1:
            assert limit.tokens(len(words)) <= limit.max_tokens
        if prev is not None:
            assert rep == limit.overlap and words[:rep] == prev[-rep:] if rep else True
        prev = words
    assert spans == [m.span() for m in WORD.finditer(text)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "c!", "\n", "\n\n", " ", "\t", "```\n", "\r\n", " ", "é。"]), max_size=400), st.integers(8, 40), st.integers(0, 3))
def test_round_trip_and_limits(parts, most, overlap):
    checked(" ".join(parts), S.Limit(max_tokens=most, overlap=overlap))


def brute(n, pos, pen, limit):
    """Least cost over all ways to cut at the positions."""
    best = {0: 0.0}
    for e in [*pos, n]:
        cost = [best[s] + S.PIECE + S.ROOM * ((limit.words - ln) / limit.words) ** 2 for s in best if s < e for ln in [e - s + (limit.overlap if s else 0)] if ln <= limit.words and (e == n or e - s >= limit.overlap)]
        if cost:
            best[e] = min(cost) + (pen[pos.index(e)] if e != n else 0)
    return best.get(n)


@pytest.mark.parametrize("seed", range(6))
def test_least_cost(seed):
    rnd = random.Random(seed)
    limit = S.Limit(max_tokens=28, overlap=3)
    n = 120
    pos = sorted(rnd.sample(range(1, n), 40))
    pen = [rnd.choice([0.0, 2.0, 3.0]) for _ in pos]
    ends = S._best(n, np.array(pos), np.array(pen), limit)
    want = brute(n, pos, pen, limit)
    if want is None:
        assert ends is None
        return
    cost, s = 0.0, 0
    for e in ends:
        cost += S.PIECE + S.ROOM * ((limit.words - (e - s + (3 if s else 0))) / limit.words) ** 2 + (pen[pos.index(e)] if e != n else 0)
        s = e
    assert abs(cost - want) < 1e-9


def test_prefers_blank_lines_outside_fences():
    para = "word " * 150 + "end.\n\n"
    fence = "```\n" + ("code line\n\n" * 40) + "```\n\n"
    text = para + fence + para * 3
    out = checked(text, S.Limit())
    for _, own, _, _ in out[1:]:
        assert text[:own].endswith("\n\n") and text[:own].count("```") % 2 == 0


def test_limit_words():
    assert S.Limit().words == 429 and S.Limit().tokens(429) == 600 and S.Limit().tokens(430) == 602


def test_pieces_of_a_table(spark):
    big = "x " * 1000
    df = spark.createDataFrame([("anchor", "a", big, 1), ("anchor", "n", None, 1), ("anchor", "e", "", 1), ("chunk", None, big, 1), ("chunk", "s", "x " * 429, 1)], "item_kind string, item_key string, text string, start int")
    got = S.pieces(df).collect()
    assert {(r.item_kind, r.item_key) for r in got} == {("anchor", "a"), ("chunk", None)}
    assert all(r.n_tokens <= 600 and (r.chunk_index == 0) == (r.overlap_with_prev == 0) for r in got)
    assert S.pieces(df.where("false")).count() == 0
    huge = spark.createDataFrame([("anchor", "h", "y" * 100_000 + " z." * 20_000)], "item_kind string, item_key string, text string")
    assert "".join(r.text if i == 0 else r.text.split(" ", 35)[-1] for i, r in enumerate(sorted(S.pieces(huge).collect(), key=lambda r: r.chunk_index))).replace(" ", "")[:100] == "y" * 100
