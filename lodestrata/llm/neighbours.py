"""The k most similar vectors of every vector by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook: the nearest word of the first book, which
also names the inverted list the vector lies in, and words of residual books found by beam search; the squared norm of
the sum is stored with them. A query looks into the lists that may hold its neighbours. There its scalar product
with every coded vector is read from tables (query times codewords, made once for all lists of a task, one lookup a
codebook), divided by the stored norm, and all that may be among the best by their quantisation error are scored again
with the exact vectors.

Which lists: a neighbour of similarity s is s times the query plus a remainder of known length across it. For a remainder
of random direction the chance that it lies nearer to another list's codeword than to that of the query's own list is a
normal tail; lists are taken by falling chance until those left out hold less than ``loss`` neighbours together. Dense
groups, whose lists lie close together, so get as many lists as they need. s is the least similarity asked for or, if
none is, the similarity of the k-th best in the query's own list, found by a first round.

The number of lists grows with the root of the number of vectors, from ``total / LIST_ROWS`` where that is less. Codebooks
are fitted on a sample taken by hash, of ``FIT_LIST`` vectors a list, between ``FIT_LEAST`` and ``FIT_MOST`` (128 MB); every
vector is indexed. Lists are put into groups of neighbouring lists, so that a query is sent once to a group and not once
to each list; a group that is hot on either side is split into blocks. Copies of one vector are one query, and of its
keys only the k+1 least are indexed: as ties are broken by key, no other can be among the k nearest of anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import materialize, spread

#: Vectors the codebooks are fitted on: at least, a list, at most.
FIT_LEAST, FIT_LIST, FIT_MOST = 20_000, 32, 500_000
#: Vectors of an inverted list at least, lists as a multiple of the root of all vectors, vectors of a group of lists.
LIST_ROWS, LIST_ROOT, GROUP_ROWS = 500, 0.5, 10_000
#: Codebooks after the first, codewords of each, width of the beam.
LEVELS, WORDS, BEAM = 8, 256, 4
#: Rows of either side that one task holds at a time.
BLOCK_ITEMS, BLOCK_QUERIES = 20_000, 8_000
#: Neighbours a query may expect to lose by the lists it leaves out; standard deviations of the quantisation error.
LOSS, SIGMAS = 0.005, 4.0
#: Times the spread of a remainder of random direction that is allowed for, as vectors of a cluster aren't spread evenly.
WIDEN = 1.5


def usable(vec: Column, dim: int) -> Column:
    """True for vectors of the right length with finite values that aren't all zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vec) == dim) & ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    off = col.offsets.to_numpy()
    v = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest codewords of each row, nearest first."""
    d = (words * words).sum(1) - 2 * x @ words.T
    n = min(n, len(words))
    if n == 1:
        return d.argmin(axis=1)[:, None]
    top = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)


def _sums(x: np.ndarray, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the rows of each of k classes."""
    n = np.bincount(a, minlength=k)
    order = np.argsort(a, kind="stable")
    out = np.zeros((k, x.shape[1]), dtype=np.float32)
    have = np.flatnonzero(n)
    if len(have):
        out[have] = np.add.reduceat(x[order], (np.cumsum(n) - n)[have], axis=0)
    return out, n


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Codewords by k-means; many are found in two steps, so the cost grows with the root of their number."""
    k = max(1, min(k, len(x)))
    if k > 400:
        top = _kmeans(x, math.isqrt(k), rounds, rng)
        a = _nearest(x, top, 1)[:, 0]
        parts = [x[a == c] for c in range(len(top))]
        return np.concatenate([_kmeans(p, min(len(p), max(1, round(k * len(p) / len(x)))), rounds, rng) for p in parts if len(p)])
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        s, n = _sums(x, _nearest(x, c, 1)[:, 0], k)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c.astype(np.float32)


@dataclass
class Quantiser:
    books: list[np.ndarray]
    group: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) and the squared norms of the sums: the nearest word of the first book, then beam search over
        the others in turn."""
        n = len(x)
        rows = np.arange(n)[:, None]
        first = _nearest(x, self.books[0], 1)
        codes = first[:, :, None]
        rest = x[:, None, :] - self.books[0][first]
        for words in self.books[1:]:
            b = rest.shape[1]
            # what remains after each word, without making it: |r|^2 - 2 r w + |w|^2
            err = (rest * rest).sum(-1)[:, :, None] + ((words * words).sum(1) - 2 * (rest.reshape(n * b, -1) @ words.T)).reshape(n, b, -1)
            err = err.reshape(n, -1)
            most = min(beam, err.shape[1])
            keep = np.argpartition(err, most - 1, axis=1)[:, :most]
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(err, keep, 1), axis=1, kind="stable"), 1)
            parent, child = keep // len(words), keep % len(words)
            codes = np.concatenate([codes[rows, parent], child[:, :, None]], axis=2)
            rest = rest[rows, parent] - words[child]
        best = codes[:, 0]
        total = x - rest[:, 0]
        return best, (total * total).sum(1)

    def lists(self, x: np.ndarray, s: np.ndarray, loss: float, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of every list that may hold a vector of similarity ``s`` (one a row) to a row, but for ``loss``; of
        ``least`` lists a row in any case."""
        c = self.books[0]
        cc = (c * c).sum(1)
        dots = x @ c.T
        own = (cc - 2 * dots).argmin(axis=1)
        rows = np.arange(len(x))
        nearer = dots - dots[rows, own][:, None]
        apart = cc[None, :] + cc[own][:, None] - 2 * c[own] @ c.T
        s = np.clip(s.astype(np.float32), -1, 1)[:, None]
        across = np.sqrt(np.maximum(apart - nearer * nearer, 0) / max(x.shape[1] - 1, 1))
        p = np.zeros_like(dots)
        for more in (0, 1 / 3, 2 / 3):  # what is more similar may lie in other lists
            at = s + more * (1 - s)
            mean = at * nearer - (cc[None, :] - cc[own][:, None]) / 2
            z = np.clip(mean / (WIDEN * np.sqrt(1 - at * at) * across + 1e-6), -8, 8)
            p = np.maximum(p, 1 / (1 + np.exp(-z * (1.5976 + 0.07056599 * z * z))))
        p[s[:, 0] <= -1] = 1
        p[rows, own] = 1
        order = np.argsort(-p, axis=1, kind="stable")
        left = np.cumsum(np.take_along_axis(p, order, 1)[:, ::-1], axis=1)[:, ::-1]
        row, at = np.nonzero((left > loss) | (np.arange(p.shape[1]) < least))
        return row, order[row, at]


def fit(x: np.ndarray, lists: int, group_lists: int = 64, *, levels: int = LEVELS, words: int = WORDS, seed: int = 1) -> Quantiser:
    """Codebooks by k-means on residuals, then each refitted given the others: the codewords that minimise the squared
    error for the codes of the beam search are means of what the others leave."""
    rng = np.random.default_rng(seed)
    books = [_kmeans(x, lists, 8, rng)]
    some = x if len(x) <= FIT_LEAST else x[rng.choice(len(x), FIT_LEAST, replace=False)]
    rest = some - books[0][_nearest(some, books[0], 1)[:, 0]]
    for _ in range(levels):
        books.append(_kmeans(rest, words, 4, rng))
        rest = rest - books[-1][_nearest(rest, books[-1], 1)[:, 0]]
    q = Quantiser(books, np.zeros(len(books[0]), dtype=np.int32))
    codes = np.concatenate([q.encode(some[i : i + 2000])[0] for i in range(0, len(some), 2000)])
    total = sum(books[j][codes[:, j]] for j in range(len(books)))
    for m in range(1, len(books)):
        others = total - books[m][codes[:, m]]
        s, n = _sums(some - others, codes[:, m], len(books[m]))
        books[m] = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], books[m]).astype(np.float32)
        total = others + books[m][codes[:, m]]
    groups = _kmeans(books[0], -(-len(books[0]) // group_lists), 8, rng)
    q.group = _nearest(books[0], groups, 1)[:, 0].astype(np.int32)
    return q


def _col(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _floats(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _encode(batches: Iterator[pa.RecordBatch], shared, dim: int) -> Iterator[pa.RecordBatch]:
    q = shared.value
    for big in batches:
        for at in range(0, big.num_rows, 2000):
            b = big.slice(at, 2000)
            x = _unit(_col(b, "vec"), dim)
            codes, norms = q.encode(x)
            raw = np.ascontiguousarray(codes[:, 1:].astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [_col(b, "key"), _col(b, "h"), _col(b, "rn"), pa.array([r.tobytes() for r in x], type=pa.binary()), pa.array(codes[:, 0].astype(np.int32)), pa.array([r.tobytes() for r in raw], type=pa.binary()), pa.array(norms.astype(np.float32))],
                names=["key", "h", "rn", "x", "list", "codes", "norm"],
            )


def _send(batches: Iterator[pa.RecordBatch], shared, dim: int, loss: float, least: int) -> Iterator[pa.RecordBatch]:
    """Each query once to every group that holds one of its lists, with those lists: those that may hold a vector of
    similarity ``s``. Found will be vectors of ``least`` or more."""
    q = shared.value
    for big in batches:
        for at in range(0, big.num_rows, 500):
            b = big.slice(at, 500)
            row, lists = q.lists(_floats(_col(b, "x"), dim), _col(b, "s").to_numpy(), loss, least)
            g = q.group[lists]
            order = np.lexsort((lists, g, row))
            row, g, lists = row[order], g[order], lists[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
            first = np.flatnonzero(new)
            src = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[first].astype(np.int32)), *(_col(b, c).take(src) for c in ("h", "x", "least")), pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32)))],
                names=["g", "h", "x", "least", "look"],
            )


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column; below every score where there are not as many."""
    return np.partition(score, len(score) - k, axis=0)[len(score) - k] if len(score) > k else np.full(score.shape[1], -3.0, dtype=score.dtype)


def _search(items: pd.DataFrame, queries: pd.DataFrame, q: Quantiser, dim: int, k: int) -> pd.DataFrame:
    """The best k of one block of a group's items for each of its queries, with all that tie with the last of a list."""
    none = pd.DataFrame({"h": pd.Series(dtype="int64"), "key": pd.Series(dtype=object), "sim": pd.Series(dtype="float64")})
    if not len(items) or not len(queries):
        return none
    order = np.argsort(items["list"].to_numpy(), kind="stable")
    items = items.iloc[order]
    xs = np.frombuffer(b"".join(items["x"]), dtype=np.float32).reshape(-1, dim)
    codes = np.frombuffer(b"".join(items["codes"]), dtype=np.uint8).reshape(len(items), -1)
    at_list, keys = items["list"].to_numpy(), items["key"].to_numpy()
    scale = (1 / np.sqrt(np.maximum(items["norm"].to_numpy(), 1e-12))).astype(np.float32)
    coded = q.books[0][at_list] + sum(q.books[m + 1][codes[:, m]] for m in range(codes.shape[1]))
    err = np.linalg.norm(xs - coded * scale[:, None], axis=1).astype(np.float32)
    # no similarity is further from its estimate than the coded vector from the true one, and across it few are near that
    slack = np.minimum(err, err * err / 2 + err * min(1.0, SIGMAS / math.sqrt(dim)))
    lists, starts = np.unique(at_list, return_index=True)
    spans = dict(zip(lists.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(items)])))
    qs = np.frombuffer(b"".join(queries["x"]), dtype=np.float32).reshape(-1, dim)
    h, least = queries["h"].to_numpy(), queries["least"].to_numpy().astype(np.float32)
    look = queries["look"].to_numpy()
    out_h, out_i, out_s = [], [], []
    for n0 in range(0, len(qs), 1024):
        y = qs[n0 : n0 + 1024].T
        tables = [book @ y for book in q.books[1:]]  # once for all lists
        asked = np.repeat(np.arange(y.shape[1]), [len(v) for v in look[n0 : n0 + 1024]])
        wanted = np.concatenate([np.asarray(v) for v in look[n0 : n0 + 1024]])
        by = np.argsort(wanted, kind="stable")
        named, first = np.unique(wanted[by], return_index=True)
        for c, who in zip(named.tolist(), np.split(asked[by], first[1:])):
            if c not in spans:
                continue
            w = who + n0
            for i0 in range(spans[c][0], spans[c][1], 4096):
                ix = slice(i0, min(i0 + 4096, spans[c][1]))
                score = np.repeat((q.books[0][c] @ y[:, who])[None, :], ix.stop - ix.start, axis=0)
                for m, t in enumerate(tables):
                    score += t[:, who][codes[ix, m]]
                score *= scale[ix, None]
                high = score + slack[ix, None]
                maybe = high >= least[w] - 1e-5
                if np.count_nonzero(maybe) > 4 * k * len(w):
                    maybe &= high >= _best(score - slack[ix, None], k) - 1e-5
                a, b = np.nonzero(maybe)
                if not len(a):
                    continue
                exact = np.empty(len(a), dtype=np.float32)
                for j in range(0, len(a), 100_000):
                    exact[j : j + 100_000] = np.einsum("nd,nd->n", xs[ix][a[j : j + 100_000]], y.T[who[b[j : j + 100_000]]])
                ok = exact >= least[w[b]]
                if np.count_nonzero(ok) > 4 * k * len(w):
                    full = np.full_like(score, -2)
                    full[a, b] = exact
                    ok &= exact >= _best(full, k)[b]
                out_h.append(h[w[b[ok]]])
                out_i.append(a[ok] + i0)
                out_s.append(exact[ok].astype(np.float64))
    if not out_h:
        return none
    return pd.DataFrame({"h": np.concatenate(out_h), "key": keys[np.concatenate(out_i)], "sim": np.concatenate(out_s)})


def _round(items: DataFrame, wanted: DataFrame, shared, dim: int, k: int, loss: float, probes: int, kt: str) -> DataFrame:
    """``h, neighbour, similarity, r``: the best k items (``list, key, x, codes, norm``) of every query (``h, x, s, least``)."""
    spark, q = items.sparkSession, shared.value
    # as many rows as lists
    groups = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(q.group), dtype=np.int32), "g": q.group}), "list int, g int"))
    placed = items.join(groups, "list")
    sent = materialize(wanted.select("h", "x", "s", "least").mapInArrow(lambda it: _send(it, shared, dim, loss, probes), "g int, h long, x binary, least double, look array<int>"))
    n = lambda size: F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int")
    sizes = F.broadcast(placed.groupBy("g").agg(n(BLOCK_ITEMS).alias("bi")).join(sent.groupBy("g").agg(n(BLOCK_QUERIES).alias("bq")), "g"))
    left = placed.join(sizes, "g").withColumn("i", F.pmod(F.xxhash64("key"), F.col("bi")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("bq") - 1))).drop("bi", "bq")
    right = sent.join(sizes, "g").withColumn("j", F.pmod("h", F.col("bq")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bi") - 1))).drop("bi", "bq")
    found = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInPandas(lambda a, b: _search(a, b, shared.value, dim, k), f"h long, key {kt}, sim double")
    r = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("sim"), "key"))
    return found.withColumn("r", r).where(F.col("r") <= k).select("h", F.col("key").alias("neighbour"), F.col("sim").alias("similarity"), "r")


def nearest(df: DataFrame, *, key: str, vec: str, dim: int, k: int = 5, queries: Column | None = None, least: float | None = None, loss: float = LOSS, probes: int = 1, list_rows: int = LIST_ROWS) -> DataFrame:
    """``key, neighbour, similarity, rank``: up to k most similar other vectors (cosine, then neighbour's key) of every
    usable vector, or of those for which ``queries`` holds, with a similarity of ``least`` or more. ``probes`` lists at least are looked into for each.

    Vectors that are null, of another length, all zero or not finite take no part on either side; norms don't count.
    Null keys are left out; a key given twice with one vector counts once, with several vectors each has its neighbours. An empty table gives no rows. Other columns are not looked at."""
    spark = df.sparkSession
    ask = queries if queries is not None else F.lit(True)
    kt = df.schema[key].dataType.simpleString()
    given = spread(df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"), F.coalesce(ask, F.lit(False)).alias("asks")))
    rows = given.where(usable(F.col("vec"), dim)).select("key", F.col("vec").cast("array<float>").alias("vec"), "asks")
    rows = rows.withColumn("h", F.xxhash64("vec"))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], f"key {kt}, neighbour {kt}, similarity double, rank int")
    lists = max(1, min(round(total / list_rows), max(round(LIST_ROOT * math.sqrt(total)), FIT_LEAST // (4 * FIT_LIST)), FIT_MOST // FIT_LIST))
    fit_rows = min(FIT_MOST, max(FIT_LEAST, FIT_LIST * lists))
    # each vector by its hash with the same chance, so the sample needs no sort and isn't the start of a scan
    take = F.pmod(F.xxhash64("h", "key"), F.lit(1_000_000)) < F.lit(min(1_000_000, max(1, 1_000_000 * fit_rows // total)))
    sample = rows.where(take).select("vec").toArrow()
    if not sample.num_rows:
        sample = rows.select("vec").limit(fit_rows).toArrow()
    x = _unit(sample["vec"].combine_chunks(), dim)
    lists = min(lists, max(1, len(x) // 4))
    shared = spark.sparkContext.broadcast(fit(x, lists, max(1, round(GROUP_ROWS * lists / total))))
    members = rows.select("h", "key", "asks")
    of_class = rows.withColumn("rn", F.dense_rank().over(Window.partitionBy("h").orderBy("key"))).where(F.col("rn") <= k + 1)
    again = F.row_number().over(Window.partitionBy("h", "key").orderBy("rn"))
    ranked = of_class.withColumn("again", again).where("again = 1").drop("again", "asks")
    coded = materialize(ranked.mapInArrow(lambda it: _encode(it, shared, dim), f"key {kt}, h long, rn int, x binary, list int, codes binary, norm float"))
    items = coded.select("list", "key", "x", "codes", "norm")
    wanted = coded.where("rn = 1").select("h", "x")
    wanted = wanted if queries is None else wanted.join(members.where("asks").select("h").distinct(), "h", "left_semi")
    if least is None:
        first = _round(items, wanted.withColumn("s", F.lit(1.0)).withColumn("least", F.lit(-1.0)), shared, dim, k + 1, loss, probes, kt)
        kth = first.where(F.col("r") == k + 1).select("h", F.col("similarity").alias("s"))
        asks = wanted.join(kth, "h", "left").select("h", "x", F.coalesce("s", F.lit(-1.0)).alias("s")).withColumn("least", F.col("s") - 1e-6)
    else:
        asks = wanted.withColumn("s", F.lit(float(least))).withColumn("least", F.col("s"))
    best = _round(items, asks, shared, dim, k + 1, loss, probes, kt).select("h", "neighbour", "similarity")
    own = members.where("asks").select("h", "key").distinct()
    pairs = best.join(own, "h").where(F.col("neighbour") != F.col("key"))
    rank = F.row_number().over(Window.partitionBy("key", "h").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "neighbour", "similarity", "rank")


DIM, BOUND = 64, 0.9


def similar_pairs(df: DataFrame, *, key: str, vec: str, bound: float = BOUND, dim: int = DIM, k: int = 5, loss: float = LOSS) -> DataFrame:
    """``key_a, key_b`` (smaller first): pairs at or above the bound of which one is among the k nearest of the other."""
    near = nearest(df.select(F.col(key).cast("string").alias("key"), F.col(vec).alias("vec")), key="key", vec="vec", dim=dim, k=k, least=bound, loss=loss)
    return near.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
