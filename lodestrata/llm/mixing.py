"""Sources mixed to target shares of all tokens.

The tokens of each source are packed end to end into blocks of fixed length. The mixture is a row of slots, in output
shards of fixed size; each shard draws how many of its slots each source gets (multinomial, seeded by the shard), and
the k-th slot of a source is mapped to a block by a pseudorandom permutation of the source's block indices, a new
permutation for every pass over the source. A pass uses each block once, so a source never repeats more often than it
is passed over. Blocks are joined with their slots by index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.tokens import FOLDER, VOCABULARY, with_tokens
from lodestrata.session import materialize

BLOCK_TOKENS = 256
SHARD_SLOTS = 4096
#: Documents laid end to end by one task; the last block of each such run may be short.
RUN_DOCS = 20_000
#: Output shards whose slots are numbered by one task.
SPAN_SHARDS = 10_000
SEED = 7


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permute(pos: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the positions ``pos``: a Feistel network over the next even power of two,
    walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_key(key, r)) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        x = once(np.asarray(pos, dtype=np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def largest_mixture(sources: list[tuple[str, float, int, int]], sigmas: float = 4.0) -> int:
    """Slots of the largest mixture in which no source runs out: sources as (name, share, max_repeats, blocks), shares
    summing to 1; the draw of each source may exceed its mean by ``sigmas`` standard deviations."""
    most = math.inf
    for _, share, repeats, blocks in sources:
        if share > 0:
            cap = repeats * blocks
            mean = ((-sigmas + math.sqrt(sigmas * sigmas + 4 * cap)) / 2) ** 2 if cap else 0
            most = min(most, mean / share)
    return 0 if math.isinf(most) else int(most)


def blocks_of(docs: DataFrame, *, block_tokens: int, run_docs: int) -> DataFrame:
    """``source, block, doc_id, tokens``: which tokens of which document are in each block of a source; blocks of a source
    are numbered from 0 without gaps. ``docs`` has source, doc_id, n_tokens, and is scanned several times."""
    sized = docs.where(F.col("n_tokens") > 0)
    runs = sized.groupBy("source").agg(F.ceil(F.count("*") / run_docs).alias("runs"))
    # at most one row a source, of which mix_targets has a fixed number
    placed = sized.join(F.broadcast(runs), "source").withColumn("run", F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(SEED)), F.col("runs")).cast("long"))
    w = Window.partitionBy("source", "run").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.withColumn("to", F.sum("n_tokens").over(w)).withColumn("from", F.col("to") - F.col("n_tokens"))
    of = at.select("source", "run", "doc_id", "from", "to", F.explode(F.sequence((F.col("from") / block_tokens).cast("long"), ((F.col("to") - 1) / block_tokens).cast("long"))).alias("b"))
    inside = F.least("to", (F.col("b") + 1) * block_tokens) - F.greatest("from", F.col("b") * block_tokens)
    ends = placed.groupBy("source", "run").agg(F.ceil(F.sum("n_tokens") / block_tokens).alias("n"))
    first = ends.withColumn("first", F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n"))
    return of.join(first, ["source", "run"]).select("source", (F.col("first") + F.col("b")).alias("block"), "doc_id", inside.alias("tokens"))


def slots(spark, sources: list[tuple[str, float, int, int]], total: int, *, shard_slots: int, seed: int) -> DataFrame:
    """``source, block, times``: how often each block is drawn. ``sources`` is as long as the table of targets."""
    shards = -(-total // shard_slots)
    p = np.array([s[1] for s in sources], dtype=float)
    p = p / p.sum() if len(p) and p.sum() > 0 else p

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            counts = np.array([np.random.default_rng(_key(seed, i)).multinomial(min(shard_slots, total - i * shard_slots), p) for i in ids])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(p))), pa.array(np.tile(np.arange(len(p)), len(ids)).astype(np.int32)), pa.array(counts.ravel().astype(np.int64))], names=["shard", "s", "n"])

    # places of a source's slots: sums by span of shards, of which there are few, then within each span
    drawn = spark.range(shards).mapInArrow(draw, "shard long, s int, n long").withColumn("span", F.floor(F.col("shard") / SPAN_SHARDS))
    spans = drawn.groupBy("s", "span").agg(F.sum("n").alias("in_span")).withColumn("base", F.sum("in_span").over(Window.partitionBy("s").orderBy("span")) - F.col("in_span")).drop("in_span")
    inside = F.sum("n").over(Window.partitionBy("s", "span").orderBy("shard")) - F.col("n")
    before = drawn.withColumn("inside", inside).join(spans, ["s", "span"]).withColumn("first", F.col("base") + F.col("inside"))

    def map_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, first, n in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("s", "first", "n"))):
                name, _, repeats, blocks = sources[s]
                k = np.arange(first, min(first + n, repeats * blocks), dtype=np.int64)
                if len(k):
                    pass_, out = k // blocks, np.empty(len(k), dtype=np.int64)
                    for x in np.unique(pass_):
                        out[pass_ == x] = permute(k[pass_ == x] % blocks, blocks, _key(seed, name, int(x)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(out)], names=["source", "block"])

    return before.select("s", "first", "n").where("n > 0").mapInArrow(map_, "source string, block long").groupBy("source", "block").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, run_docs: int = RUN_DOCS, seed: int = SEED) -> DataFrame:
    """``source, doc_id, n_tokens, repeats, used_tokens``: the chosen documents, how often each is used at most (a document
    cut by a block's edge may be used in part) and the tokens it contributes over all uses.

    ``docs`` has source, doc_id and n_tokens; sources are compared without case and outer blanks, null ones and those
    without a target are left out. The mixture has ``total_tokens``, or by default as many as the scarcest source
    allows. Where ``total_tokens`` asks a source for more than all its repeats, it gives all of them and no more: the mixture is
    then that much smaller, and ``shares`` reports the actual shares. A source without tokens gets nothing, its share going to
    the others in proportion. Two rows of one doc_id (a null one too) and source are one document of their tokens' sum.
    Empty documents are never chosen."""
    spark = docs.sparkSession
    norm = F.lower(F.trim(F.regexp_replace("source", r"^\s+|\s+$", "")))
    goals = {r["source"]: (r["share"], r["repeats"]) for r in targets.where("source is not null").select(norm.alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats")).groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")).collect()}
    own = docs.where(F.col("source").isNotNull()).select(norm.alias("source"), "doc_id", "n_tokens").where(F.col("source").isin(list(goals)))
    own = materialize(own.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens")))
    blocks = materialize(blocks_of(own, block_tokens=block_tokens, run_docs=run_docs))
    have = {r["source"]: r["n"] for r in blocks.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    use = [(s, goals[s][0], goals[s][1], have[s]) for s in sorted(have) if goals[s][0] > 0 and goals[s][1] > 0]
    whole = sum(u[1] for u in use)
    use = [(s, share / whole, r, n) for s, share, r, n in use]
    total = total_tokens // block_tokens if total_tokens is not None else largest_mixture(use)
    if not use:
        return own.where("false").select("source", "doc_id", "n_tokens", F.lit(0).cast("long").alias("repeats"), F.lit(0).cast("long").alias("used_tokens"))
    drawn = slots(spark, use, total, shard_slots=shard_slots, seed=seed)
    used = blocks.join(drawn, ["source", "block"]).groupBy("source", "doc_id").agg(F.max("times").alias("repeats"), F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"))
    sizes = own.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), "n_tokens")
    return used.join(sizes, (F.col("source") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("source", "doc_id", "n_tokens", "repeats", "used_tokens")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, used_tokens, max_repeats, most_repeats`` of every target."""
    per = chosen.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("n_docs"))
    goal = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    out = goal.join(per, "source", "left").fillna(0, ["used_tokens", "most_repeats", "n_docs"])
    return out.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy()), F.lit(0.0)))


def mix_documents(documents: DataFrame, targets: DataFrame, *, folder: str = FOLDER, vocabulary: str = VOCABULARY, **kw) -> DataFrame:
    sized = with_tokens(documents.where(F.col("source").isNotNull()), text="text", keep=["source", "doc_id"], folder=folder, vocabulary=vocabulary)
    return mix(sized, targets, **kw)
