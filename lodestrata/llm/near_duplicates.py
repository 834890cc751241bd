"""Texts that share most of their word shingles: T-occurrence search with long lists set aside (DivideSkip).

A text of ``n`` distinct shingles reaches the Jaccard bound ``t`` only with texts that hold at least ``T = ceil(t n)``
of them. Of its ``n`` inverted lists the ``T - m`` longest are set aside; whoever shares ``T`` shingles must occur at
least ``m`` times in the remaining short lists. Only short lists are built and shuffled. Each text gets, list by list,
the sorted texts that share one of its short lists; these runs are merged, and a text that occurs often enough is a
candidate. Candidates are probed for the long lists by binary search in their sorted shingles, and those that reach the
overlap which the bound asks of both sizes are kept. Nothing is left out: the two conditions are necessary for every pair
above the bound, and stay so if a list holds only those texts for which it is short, as all agree on the order of lists.

Which lists are long is told by counters over all shingles of all texts, in ``2**20`` to ``2**24`` cells (4 bytes each, so 64
MB at most) by the number of shingles. The cells fix only the order of the lists, and any common order gives the same
pairs, so sharing a cell costs time at most. Where a cell is so full that a list in it may be hot, the real lengths of
the short lists are counted, and only lists that are really hot are split into blocks.

Texts with the same set of shingles form a class; all steps work on classes, so copies of one text are shuffled once
however many there are. ``near_classes`` gives one row a text with its class, and the links between classes;
``similar_pairs`` expands them to pairs of keys where these are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize, spread

#: Cells of the counters (as powers of two) at least and at most, shingles a cell on average before there are more.
SKETCH_BITS, MOST_BITS, CELL_SHINGLES = 20, 24, 256
#: Bits of the candidates' filter (as powers of two) at least and at most: 2 to 32 MB.
FILTER_BITS, MOST_FILTER_BITS = 24, 28
SHORT_HITS = 2
#: Rows of an inverted list that one task joins with themselves.
LIST_ROWS = 20_000
#: Slack against rounding where a bound is a product of floats.
EPS = 1e-9


def shingle_sets(df: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """``_id, _set, _c, _d``: sorted distinct 64-bit hashes of ``width`` successive words (runs of a-z and 0-9 after
    lowering), and two hashes of the set. Rows without key or without any shingle are left out."""
    words = F.regexp_extract_all(F.lower("_text"), F.lit("[a-z0-9]+"), F.lit(0))
    rows = spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_text")))
    docs = rows.select("_id", words.alias("_w")).where(F.size("_w") >= width)
    each = F.transform(F.sequence(F.lit(0), F.size("_w") - width), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(width)]))
    sets = docs.select("_id", F.sort_array(F.array_distinct(each)).alias("_set"))
    return sets.select("_id", "_set", F.xxhash64("_set").alias("_c"), F.xxhash64(F.lit(1), "_set").alias("_d"))


def list_lengths(sets: DataFrame, bits: int) -> np.ndarray:
    """Length of the inverted lists that share a cell; at most ``2**bits`` rows come to the driver."""
    cell = F.col("s").bitwiseAND(F.lit((1 << bits) - 1))
    # explode_outer: explode would add a filter on the set's size, which is pushed below and takes the set apart again
    counted = sets.select(F.explode_outer("_set").alias("s")).groupBy(cell.cast("int").alias("cell")).agg(F.count("*").alias("n"))
    out = np.zeros(1 << bits, dtype=np.int32)
    t = counted.toArrow()
    out[t["cell"].to_numpy()] = np.minimum(t["n"].to_numpy(), np.iinfo(np.int32).max)
    more = min(MOST_BITS, math.ceil(math.log2(max(int(out.sum(dtype=np.int64)), 1) / CELL_SHINGLES)))
    return list_lengths(sets, more) if bits < more else out


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, also where the batch is a slice."""
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def _short_lists(batches: Iterator[pa.RecordBatch], lengths, bound: float, hits: int, hot) -> Iterator[pa.RecordBatch]:
    """Postings of the short lists: each text's shingles by rising list length, without the last ``T - hits``.

    ``q`` splits hot lists (sorted shingles and their lengths, in blocks) by class: a posting of block i goes to every
    pair of blocks that i is in, so that no task gets a whole hot list."""
    cells = lengths.value
    mask = len(cells) - 1
    hot_s, hot_k = hot.value if hot is not None else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    for b in batches:
        c = b.column(b.schema.get_field_index("_c")).to_numpy()
        first = np.unique(c, return_index=True)[1]
        if len(first) < len(c):
            b = b.take(pa.array(np.sort(first)))
            c = b.column(b.schema.get_field_index("_c")).to_numpy()
        v, off = _flat(b.column(b.schema.get_field_index("_set")))
        n = np.diff(off)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((v, cells[v & mask], doc))
        need = np.ceil(bound * n - EPS).astype(np.int64)
        keep = n - need + np.minimum(hits, need)
        pos = np.arange(len(v)) - np.repeat(off[:-1], n)
        take = pos < np.repeat(keep, n)
        src, p = order[take], pos[take].astype(np.int32)
        s = v[src]
        q, blk, whole = np.zeros(len(s), dtype=np.int32), np.zeros(len(s), dtype=np.int32), np.ones(len(s), dtype=bool)
        if len(hot_s) and len(s):
            at = np.minimum(np.searchsorted(hot_s, s), len(hot_s) - 1)
            times = np.where(hot_s[at] == s, hot_k[at], 1)
            if times.max() > 1:
                blk = (c[doc[src]] % times).astype(np.int32)
                src, p, s, blk, k = (np.repeat(x, times) for x in (src, p, s, blk, times))
                other = (np.arange(len(s)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                q, whole = (np.minimum(blk, other) * k + np.maximum(blk, other)).astype(np.int32), blk == other
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, q, whole, c[doc[src]], blk, n[doc[src]].astype(np.int32), p)], names=["s", "q", "whole", "c", "blk", "n", "p"])


def hot_lists(postings: DataFrame, lengths: np.ndarray, list_rows: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Shingles of short lists of more than ``list_rows`` texts, and in how many blocks each is split; None where the
    counters prove that there are none. There are at most as many as postings over ``list_rows``."""
    if int(lengths.max(initial=0)) <= list_rows:
        return None
    full = postings.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > list_rows).orderBy("s").toArrow()
    return full["s"].to_numpy(), -(-full["n"].to_numpy() // list_rows)


def _lists(batches: Iterator[pa.RecordBatch], names: list[str], same: tuple[int, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that rows which agree in the columns ``same`` stay together."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]
        if rest is not None:
            cols = [np.concatenate([r, x]) for r, x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = np.logical_and.reduce([cols[i] == cols[i][-1] for i in same])
        cut = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
        if cut:
            yield [x[:cut] for x in cols]
        rest = [x[cut:] for x in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _runs(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[pa.RecordBatch]:
    """From postings sorted by list, each text's run of a list: ``a`` with one later text ``b`` a row, and ``most``, what both
    can share if this is the first shingle they share (by it pairs are dropped that no further list can help). Lists of one
    class, most of all, are dropped at once."""
    for s, q, whole, c, blk, n, p in _lists(batches, ["s", "q", "whole", "c", "blk", "n", "p"], (0, 1)):
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (q[1:] != q[:-1])
        g = np.cumsum(new) - 1
        keep = np.bincount(g)[g] > 1
        if not keep.any():
            continue
        g, whole, c, blk, n, p = (x[keep] for x in (g, whole, c, blk, n, p))
        order = np.lexsort((c, n, g))
        g, whole, c, blk, n, p = (x[order] for x in (g, whole, c, blk, n, p))
        one = np.ones(len(g), dtype=bool)  # copies that other tasks sent
        one[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        g, whole, c, blk, n, p = (x[one] for x in (g, whole, c, blk, n, p))
        i = np.arange(len(g))
        out: list[tuple] = []
        held, d = 0, 0
        while len(i):
            d += 1
            i = i[i + d < len(g)]
            # sizes rise within a list: once a partner is too large all further ones are
            i = i[(g[i] == g[np.minimum(i + d, len(g) - 1)])]
            i = i[n[i] >= bound * n[i + d] - EPS]
            j = i + d
            ok = (whole[i] | (blk[i] != blk[j])) & (c[i] != c[j])
            x, y = i[ok], j[ok]
            if len(x):
                swap = c[x] > c[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                out.append((c[x], c[y], n[x], n[y], np.minimum(n[x] - p[x], n[y] - p[y])))
                held += len(x)
            if held > 200_000 or (held and not len(i)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], names=["a", "b", "na", "nb", "most"])
                out, held = [], 0


def _merge(batches: Iterator[pa.RecordBatch], bound: float, hits: int) -> Iterator[pa.RecordBatch]:
    """The runs of a text, merged: sorted by (a, b) they stand as a heap would pop them, and equal neighbours are the
    occurrences of one candidate. Kept are those that occur in enough short lists and can reach the overlap."""
    for a, b, na, nb, most in _lists(batches, ["a", "b", "na", "nb", "most"], (0, 1)):
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(a)))
        top = np.maximum.reduceat(most, first)
        a, b, na, nb = (x[first] for x in (a, b, na, nb))
        need = np.minimum(hits, np.ceil(bound * np.minimum(na, nb) - EPS))
        ok = (times >= need) & (top >= bound / (1 + bound) * (na + nb) - EPS)
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _bitmap(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << bits, dtype=bool)
    for b in batches:
        for name in ("a", "b"):
            seen[b.column(b.schema.get_field_index(name)).to_numpy() & (len(seen) - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], type=pa.binary())], names=["bits"])


def _only(batches: Iterator[pa.RecordBatch], bitmap) -> Iterator[pa.RecordBatch]:
    seen = np.unpackbits(np.frombuffer(bitmap.value, dtype=np.uint8)).astype(bool)
    for b in batches:
        c = b.column(b.schema.get_field_index("_c")).to_numpy()
        hit = seen[c & (len(seen) - 1)]
        if hit.any():
            yield b.filter(pa.array(hit))


def _probe(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[pa.RecordBatch]:
    """Binary search of the smaller set's shingles in the larger one's."""
    for b in batches:
        if not b.num_rows:
            continue
        (va, oa), (vb, ob) = (_flat(b.column(b.schema.get_field_index(x))) for x in ("sa", "sb"))
        shared = np.empty(b.num_rows, dtype=np.int64)
        for i in range(b.num_rows):
            x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = len(y) - 1
            shared[i] = np.count_nonzero(y[at] == x)
        na, nb = np.diff(oa), np.diff(ob)
        ok = shared >= bound * (na + nb - shared) - EPS
        if ok.any():
            out = [b.column(b.schema.get_field_index(x)) for x in ("a", "da", "b", "db")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(shared / (na + nb - shared))], names=["a", "da", "b", "db", "similarity"]).filter(pa.array(ok))


def similar_classes(sets: DataFrame, *, bound: float, sketch_bits: int = SKETCH_BITS, hits: int = SHORT_HITS) -> DataFrame:
    """Pairs of different classes at or above the bound: ``a, da, b, db`` (hashes of the sets), ``similarity``. ``sets`` is
    scanned several times and should be a table."""
    sc = sets.sparkSession.sparkContext
    counted = list_lengths(sets, sketch_bits)
    lengths = sc.broadcast(counted)
    schema = "s long, q int, whole boolean, c long, blk int, n int, p int"
    postings = lambda hot: sets.select("_c", "_set").mapInArrow(lambda it: _short_lists(it, lengths, bound, hits, hot), schema)
    hot = hot_lists(postings(None), counted, LIST_ROWS)
    shared_hot = sc.broadcast(hot) if hot is not None else None
    lists = postings(shared_hot).repartition("s", "q").sortWithinPartitions("s", "q")
    runs = lists.mapInArrow(lambda it: _runs(it, bound), "a long, b long, na int, nb int, most int")
    merged = runs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(lambda it: _merge(it, bound, hits), "a long, b long")
    candidates = materialize(merged)
    bits = min(MOST_FILTER_BITS, max(FILTER_BITS, math.ceil(math.log2(16 * max(candidates.count(), 1)))))
    parts = candidates.coalesce(16).mapInArrow(lambda it: _bitmap(it, bits), "bits binary").toArrow()["bits"].to_pylist()
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for p in parts:
        bitmap |= np.frombuffer(p, dtype=np.uint8)
    shared = sc.broadcast(bitmap.tobytes())
    wanted = sets.select("_c", "_d", "_set").mapInArrow(lambda it: _only(it, shared), "_c long, _d long, _set array<long>")
    one = wanted.groupBy("_c", "_d").agg(F.first("_set").alias("_set"))
    left = one.select(F.col("_c").alias("a"), F.col("_d").alias("da"), F.col("_set").alias("sa"))
    right = one.select(F.col("_c").alias("b"), F.col("_d").alias("db"), F.col("_set").alias("sb"))
    both = candidates.join(left, "a").join(right, "b").select("a", "da", "sa", "b", "db", "sb")
    return both.mapInArrow(lambda it: _probe(it, bound), "a long, da long, b long, db long, similarity double")


def near_classes(df: DataFrame, *, key: str, text: str, bound: float = 0.8, width: int = 5, sketch_bits: int = SKETCH_BITS, hits: int = SHORT_HITS) -> tuple[DataFrame, DataFrame]:
    """Membership and links: ``key, class`` of every text with shingles (distinct), texts of one class having the same set,
    and ``class_a, class_b, similarity`` of the classes at or above the bound (``class_a`` is the lesser). As many rows as
    texts, and as linked pairs of different texts, however often a text is copied; what has no shingles is in neither."""
    sets = materialize(shingle_sets(df, key=key, text=text, width=width))
    name = lambda c, d: F.concat(F.lpad(F.hex(c), 16, "0"), F.lpad(F.hex(d), 16, "0"))
    classes = similar_classes(sets, bound=bound, sketch_bits=sketch_bits, hits=hits)
    x, y = name(F.col("a"), F.col("da")), name(F.col("b"), F.col("db"))
    members = sets.select(F.col("_id").alias("key"), name(F.col("_c"), F.col("_d")).alias("class")).distinct()
    return members, classes.select(F.least(x, y).alias("class_a"), F.greatest(x, y).alias("class_b"), "similarity")


def linked_texts(df: DataFrame, *, key: str, text: str, bound: float = 0.8, width: int = 5) -> DataFrame:
    """``key, class, n_copies, n_links``: one row a text: its class, the texts in it, and the other classes it is linked to.
    Keys with several texts have a row for each of their classes; texts without shingles have none."""
    members, links = near_classes(df, key=key, text=text, bound=bound, width=width)
    links = materialize(links)
    n = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("class").agg(F.count("*").alias("n_copies"))
    return members.join(sizes.join(n, "class", "left"), "class").select("key", "class", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_pairs(df: DataFrame, *, key: str, text: str, bound: float = 0.8, width: int = 5, sketch_bits: int = SKETCH_BITS, hits: int = SHORT_HITS) -> DataFrame:
    """All pairs of keys whose texts have a Jaccard similarity of at least ``bound`` between their sets of ``width``
    successive words: ``key_a, key_b`` (smaller key first, by bytes), ``similarity``; rows are distinct. Copies are expanded:
    a text given n times is n (n - 1) / 2 pairs; ``near_classes`` has them in n rows.

    Texts that are null or have fewer than ``width`` words have no shingles and no partners; null keys are left out.
    A key given with several texts has the partners of each, but not itself. An empty table gives no rows. Other columns
    are not looked at."""
    sets = materialize(shingle_sets(df, key=key, text=text, width=width))
    members = sets.select("_id", "_c", "_d").distinct()
    classes = similar_classes(sets, bound=bound, sketch_bits=sketch_bits, hits=hits)
    a = members.select(F.col("_c").alias("a"), F.col("_d").alias("da"), F.col("_id").alias("ia"))
    b = members.select(F.col("_c").alias("b"), F.col("_d").alias("db"), F.col("_id").alias("ib"))
    between = classes.join(a, ["a", "da"]).join(b, ["b", "db"]).where(F.col("ia") != F.col("ib")).select("ia", "ib", "similarity")
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("da") == F.col("db")) & (F.col("ia") < F.col("ib"))).select("ia", "ib", F.lit(1.0).alias("similarity"))
    return between.unionByName(within).groupBy(F.least("ia", "ib").alias("key_a"), F.greatest("ia", "ib").alias("key_b")).agg(F.max("similarity").alias("similarity"))


def similar_texts(anchors: DataFrame) -> DataFrame:
    """Pairs of anchors alike beyond the bound of this project's data: three words, 0.7."""
    return similar_pairs(anchors, key="id", text="content_text", bound=0.7, width=3)
