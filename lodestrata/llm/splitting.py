"""Oversized texts cut into pieces under a limit, at natural boundaries, each piece repeating the end of the one before.

Where to cut is found by dynamic programming over boundary positions: of all ways to stay within the limit it takes the
one with the least sum of cut penalties, piece costs and squared room left in the pieces, so cuts fall on blank lines
before sentence and line ends, and pieces come out alike in size. Only where natural boundaries lie too far apart for
the limit are all word boundaries positions too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

WORD = r"[^ \t\n\r]+"
#: Penalties of a cut: blank line, sentence end, line end, and the same inside a code fence, then within a line.
BLANK, SENTENCE, LINE, FENCED, INSIDE = 0.0, 2.0, 3.0, 8.0, 40.0
PIECE, ROOM = 1.0, 4.0

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)", re.M)
_SENTENCE_END = re.compile(r"[.!?]['\")\]]*\Z")


@dataclass(frozen=True)
class Limit:
    """``max_tokens`` of a piece, a text's tokens being words times ``num / den``, rounded down; ``overlap`` in words."""

    max_tokens: int = 600
    num: int = 7
    den: int = 5
    overlap: int = 35

    def tokens(self, words: int) -> int:
        return words * self.num // self.den

    @property
    def words(self) -> int:
        return ((self.max_tokens + 1) * self.den - 1) // self.num


def penalties(text: str, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Penalty of a cut before each word; that before word 0 means nothing."""
    out = np.full(len(starts), INSIDE)
    fences = [(m.start(1), m.group(1)) for m in _FENCE.finditer(text)]
    spans, open_at, mark = [], None, ""
    for at, m in fences:
        if open_at is None:
            open_at, mark = at, m
        elif m[0] == mark[0] and len(m) >= len(mark):
            spans.append((open_at, at + len(m)))
            open_at = None
    if open_at is not None:
        spans.append((open_at, len(text)))
    inside = np.zeros(len(starts), dtype=bool)
    for a, b in spans:
        # a cut before the opening mark or behind the closing one is outside
        inside |= (starts > a) & (starts < b)
    for j in range(1, len(starts)):
        gap = text[stops[j - 1] : starts[j]]
        lines = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        if inside[j]:
            out[j] = FENCED if lines else INSIDE + FENCED
        elif lines > 1:
            out[j] = BLANK
        elif _SENTENCE_END.search(text[max(stops[j - 1] - 4, starts[j - 1]) : stops[j - 1]]):
            out[j] = SENTENCE
        elif lines:
            out[j] = LINE
    return out


def _best(n: int, at: np.ndarray, cost: np.ndarray, limit: Limit) -> list[int] | None:
    """Ends of the pieces over words 0..n with cuts at the positions ``at`` (rising, within 1..n-1) of the given costs."""
    most, over = limit.words, limit.overlap
    pos = np.concatenate([[0], at, [n]])
    pen = np.concatenate([[0.0], cost, [0.0]])
    total = np.full(len(pos), np.inf)
    back = np.zeros(len(pos), dtype=np.int64)
    total[0] = 0
    lo = 0
    for e in range(1, len(pos)):
        last = e == len(pos) - 1
        while pos[e] - pos[lo] > most:
            lo += 1
        if lo == e:
            continue
        s = np.arange(lo, e)
        own = pos[e] - pos[s]
        length = own + np.where(pos[s] > 0, over, 0)
        ok = (length <= most) & (last | (own >= over))
        c = total[s] + np.where(ok, PIECE + ROOM * ((most - length) / most) ** 2, np.inf)
        k = int(np.argmin(c))
        total[e], back[e] = c[k] + pen[e], s[k]
    if not np.isfinite(total[-1]):
        return None
    ends, e = [], len(pos) - 1
    while e > 0:
        ends.append(int(pos[e]))
        e = back[e]
    return ends[::-1]


def split_text(text: str, limit: Limit) -> list[tuple[int, int, int, int]]:
    """Pieces as (from, own, to, words repeated): characters from..to are the piece, own..to its part that no piece
    before has; the own parts put together are the text."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    n = len(spans)
    if limit.tokens(n) <= limit.max_tokens:
        return [(0, 0, len(text), 0)]
    starts, stops = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
    pen = penalties(text, starts, stops)
    at = np.flatnonzero(pen < INSIDE)
    at = at[at > 0]
    ends = _best(n, at, pen[at], limit)
    if ends is None:
        ends = _best(n, np.arange(1, n), pen[1:], limit)
    out, own = [], 0
    for e in ends:
        to = len(text) if e == n else int(starts[e])
        rep = min(limit.overlap, own) if out else 0
        out.append((int(starts[own - rep]) if out else 0, int(starts[own]) if out else 0, to, rep))
        own = e
    return out


SCHEMA = "item_kind string, item_key string, chunk_index int, text string, n_tokens int, overlap_with_prev int, start int, stop int"
_ARROW = pa.schema([("item_kind", pa.string()), ("item_key", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32()), ("overlap_with_prev", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


def _pieces(batches: Iterator[pa.RecordBatch], limit: Limit) -> Iterator[pa.RecordBatch]:
    word = re.compile(WORD)
    for b in batches:
        kinds, keys, texts = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("item_kind", "item_key", "text"))
        rows = []
        for kind, key, text in zip(kinds, keys, texts):
            for i, (a, own, to, rep) in enumerate(split_text(text, limit)):
                piece = text[a:to]
                rows.append((kind, key, i, piece, limit.tokens(sum(1 for _ in word.finditer(piece))), rep, own, to))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def pieces(items: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """``item_kind, item_key, chunk_index, text, n_tokens, overlap_with_prev, start, stop`` of the items (``item_kind,
    item_key, text``) above the limit; start..stop are the characters that no piece before has.

    Items within the limit, null and empty ones give nothing. Every piece is within the limit; every piece but the
    first begins with the last ``overlap`` words of the one before. A word is never cut. Repeated rows repeat their
    pieces. Items within the limit are sorted out before anything leaves the JVM; no shuffle."""
    if limit.overlap * 2 > limit.words:
        raise ValueError("the overlap takes more than half of a piece")
    big = items.where(F.col("text").isNotNull() & (F.floor(word_count(F.col("text")) * limit.num / limit.den) > limit.max_tokens))
    return big.select("item_kind", "item_key", "text").mapInArrow(lambda it: _pieces(it, limit), SCHEMA)


def oversized_pieces(anchors: DataFrame, chunks: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """Pieces of anchors (content_text) and stored sub-chunks (text) above the limit; a sub-chunk stored twice counts once."""
    a = spread(anchors.select(F.lit("anchor").alias("item_kind"), F.col("id").alias("item_key"), F.col("content_text").alias("text")))
    c = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").cast("string").alias("item_key"), "text")
    big = c.where(F.floor(word_count(F.col("text")) * limit.num / limit.den) > limit.max_tokens).distinct()
    return pieces(a.unionByName(big), limit)
