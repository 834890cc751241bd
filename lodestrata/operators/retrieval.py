"""Hybrid retrieval for a table of queries: BM25 and nearest vectors over chunks, best chunk per anchor, rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import excerpt, preview, trigrams

K1, B, RRF_K = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def counted_terms(chunks: DataFrame, words: list[str]) -> DataFrame:
    """``chunk_id, len, counts``: how often each of the words occurs, counted in a chunk's own row; what is shuffled to tell copies
    of a chunk holds no text."""
    t = chunks.where("text is not null").select("chunk_id", terms(F.col("text")).alias("t"))
    asked = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    of = F.filter("t", lambda x: F.array_contains(asked, x))
    hits = t.select("chunk_id", F.size("t").alias("len"), of.alias("t"))
    counts = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), F.size(F.filter(F.col("t"), lambda x: x == w)).cast("long").alias("tf")))
    return hits.select("chunk_id", "len", counts.alias("counts")).dropDuplicates(["chunk_id"])


def postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, len``; terms are combined within a task before they are shuffled."""
    t = chunks.where("text is not null").select("chunk_id", terms(F.col("text")).alias("t")).dropDuplicates(["chunk_id"])
    return t.select("chunk_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "chunk_id", "len").agg(F.count("*").alias("tf"))


#: Distinct words of a table of queries up to which they are picked out of the texts by a list; beyond it by a join.
MOST_WORDS = 1000


def bm25(chunks: DataFrame, queries: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, chunk_id, score`` of chunks that hold all terms of a query (``query_id, query``); greater is better. Rows of one
    chunk_id count once.

    Where the queries have no more than ``MOST_WORDS`` distinct words, only these are taken from the texts; otherwise all
    words are counted and joined with those asked for."""
    q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    n_terms = q.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    words = [r["term"] for r in q.select("term").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) <= MOST_WORDS:
        rows = counted_terms(chunks, sorted(words))
        size = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        p = rows.select("chunk_id", "len", F.inline("counts"))
    else:
        size = chunks.where("text is not null").select("chunk_id", F.size(terms(F.col("text"))).alias("len")).dropDuplicates(["chunk_id"]).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        p = postings(chunks).join(q.select("term").distinct(), "term", "left_semi")
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    # the sizes are one row
    hits = q.join(p, "term").join(df, "term").crossJoin(F.broadcast(size))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("hit"))
    return scored.join(n_terms, "query_id").where("hit = n_terms").select("query_id", "chunk_id", "score")


def top(scored: DataFrame, n: int, *, order: Column) -> DataFrame:
    """The first n per query with their ``rank``; ties by chunk_id. The rank filter is applied before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy(order, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _block_top(items: pd.DataFrame, queries: pd.DataFrame, n: int, cosine: bool) -> pd.DataFrame:
    """The n nearest of a block's items for each of its queries, and all that tie with the last of them after rounding."""
    parts = [pd.DataFrame({"query_id": pd.Series(dtype=object), "chunk_id": pd.Series(dtype=object), "distance": pd.Series(dtype="float64")})]
    if len(items) and len(queries):
        x, y = np.stack(items["embedding"].to_numpy()).astype(np.float64), np.stack(queries["vec"].to_numpy()).astype(np.float64)
        ids, qs = items["chunk_id"].to_numpy(), queries["query_id"].to_numpy()
        size = (x * x).sum(1)
        for at in range(0, len(y), 128):
            z = y[at : at + 128]
            near = np.sqrt(np.maximum(size - 2 * z @ x.T + (z * z).sum(1)[:, None], 0))
            bar = np.partition(near, min(n, len(x)) - 1, axis=1)[:, min(n, len(x)) - 1]
            # vectors that all but coincide are where the fast form is least exact
            a, b = np.nonzero(near <= (bar + 1e-4 * (1 + bar))[:, None])
            far = 1 - (x[b] * z[a]).sum(1) if cosine else np.sqrt(((x[b] - z[a]) ** 2).sum(1))
            parts.append(pd.DataFrame({"query_id": qs[at : at + 128][a], "chunk_id": ids[b], "distance": far}))
    return pd.concat(parts[1:] or parts)


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, n: int, *, dim: int, block: int = 10_000, cosine: bool = False) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: exact nearest vectors (``chunk_id, embedding``) by Euclidean distance of a stated set
    of queries (``query_id, vec``), by blocks of queries against blocks of vectors; with ``cosine`` all are unit vectors and the distance
    is 1 less their product. Vectors that are null, of another length or hold nulls take no part."""
    ok = lambda c: (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull())
    v = vectors.where(ok("embedding")).select("chunk_id", "embedding")
    q = queries.where(ok("vec")).select("query_id", "vec")
    kq, kc = (df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (v, "chunk_id")))
    bi, bq = max(1, -(-v.count() // block)), max(1, -(-q.count() // block))
    bi = max(bi, -(-v.sparkSession.sparkContext.defaultParallelism // bq))
    items = v.withColumn("i", F.pmod(F.xxhash64("chunk_id"), F.lit(bi)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    asked = q.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(bq)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(bi - 1))))
    found = items.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInPandas(lambda a, b: _block_top(a, b, n, cosine), f"query_id {kq}, chunk_id {kc}, distance double")
    return top(found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance")), n, order=F.col("distance").asc())


def best_per_parent(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, parent_id, chunk_id, place``: each anchor with its best chunk, places counted anew from 1."""
    parents = chunks.select("chunk_id", "parent_id").distinct()
    w = Window.partitionBy("query_id", "parent_id").orderBy("rank", "chunk_id")
    one = ranked.join(parents, "chunk_id").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    again = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return one.withColumn("place", F.row_number().over(again)).select("query_id", "parent_id", "chunk_id", "place")


def fuse(lists: list[tuple[str, DataFrame]], *, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists by (query_id, parent_id): one union and one aggregation, whatever their number."""
    parts = None
    for name, df in lists:
        one = df.select("query_id", "parent_id", F.lit(name).alias("list"), "chunk_id", (1 / (F.col("place") + k)).alias("s"))
        parts = one if parts is None else parts.unionByName(one)
    agg = [F.max(F.when(F.col("list") == n, F.col("chunk_id"))).alias(f"{n}_chunk") for n, _ in lists]
    return parts.groupBy("query_id", "parent_id").agg(F.round(F.sum("s"), 9).alias("score"), *agg)


def search(chunks: DataFrame, vectors: DataFrame, anchors: DataFrame, queries: DataFrame, *, top_k: int = 10, dim: int, types: list[str] | None = None, path_regex: str | None = None, tests: bool = True) -> DataFrame:
    """``query_id, anchor_id, score, rank, vec_chunk, bm25_chunk``: filters hold before anything is cut to length."""
    pool = max(20 * top_k, 200)
    a = anchors.select(F.col("id").alias("parent_id"), "anchor_type", "path", "is_test")
    if types:
        a = a.where(F.col("anchor_type").isin(types))
    if path_regex:
        a = a.where(F.col("path").rlike(path_regex))
    if not tests:
        a = a.where(~F.col("is_test"))
    scoped = chunks.select("chunk_id", "parent_id").dropDuplicates(["chunk_id"]).join(a.select("parent_id"), "parent_id", "left_semi")
    words = top(bm25(chunks, queries), pool, order=F.col("score").desc())
    near = nearest_in_blocks(vectors, queries, pool, dim=dim)
    fused = fuse([("vec", best_per_parent(near, scoped)), ("bm25", best_per_parent(words, scoped))])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).withColumnRenamed("parent_id", "anchor_id")


def packets(found: DataFrame, chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Search results with the anchor's preview and the excerpt of the chunk that matched."""
    text = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", F.col("text").alias("chunk_text"))
    a = anchors.select(F.col("id").alias("anchor_id"), "anchor_type", "path", "heading_path", "symbol_name", "content_text")
    j = found.withColumn("chunk_id", F.coalesce("vec_chunk", "bm25_chunk")).join(a, "anchor_id").join(text, "chunk_id", "left")
    shown, cut = preview(F.col("content_text"))
    e, at = excerpt(F.col("chunk_text"), shown, F.col("content_text"))
    return j.select("query_id", "rank", "score", "anchor_id", "anchor_type", "path", "symbol_name", shown.alias("preview"), cut.alias("truncated"), e.alias("excerpt"), at.alias("excerpt_at"))


def did_you_mean(anchors: DataFrame, queries: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, anchor_id``: the first anchors whose name or path holds a query's word of three letters or more.

    A word and a name are compared only if they share the word's first trigram, by an equi join; of a hot trigram nothing is
    lost, as the join is split by Spark where it is skewed. Anchors' trigrams are kept only if a query asks for them."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.filter(terms(F.col("query")), lambda t: F.length(t) >= 3))).alias("t")).withColumn("g", F.substring("t", 1, 3))
    grams = [r["g"] for r in q.select("g").distinct().limit(MOST_WORDS + 1).collect()]
    low = F.lower(F.concat_ws(" ", "symbol_name", "path"))
    a = anchors.select(F.col("id").alias("anchor_id"), low.alias("of"))
    if len(grams) <= MOST_WORDS:
        some = F.filter(F.array(*[F.lit(g) for g in sorted(grams)]) if grams else F.array().cast("array<string>"), lambda g: F.contains(F.col("of"), g))
        keyed = a.select("anchor_id", "of", F.explode(some).alias("g"))
    else:
        keyed = a.select("anchor_id", "of", F.explode(trigrams(F.col("of"))).alias("g"))
    hits = keyed.join(q, "g").where(F.contains(F.col("of"), F.col("t"))).select("query_id", "anchor_id").distinct()
    w = Window.partitionBy("query_id").orderBy("anchor_id")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
