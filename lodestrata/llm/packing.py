"""Items of varying size put into containers of fixed capacity with little unused room.

Items are dealt into shards by hash, each small enough for one task. A shard is filled in the order of its keys, a new
container being begun where an item doesn't fit, and then packed by local search: the emptiest container that isn't stuck
gives an item to another (move), or exchanges one for one, two for one or one for two, whenever that raises the sum of
squared fills. A container left without items is gone; the search ends when there are as few containers as the sum of
sizes allows, or when no step raises the sum. All partners in the shard are looked at, by distinct sizes: a container
has at most about the root of twice its capacity of them, so no step needs a limit. Items of the containers that a
shard leaves too empty are dealt again into fewer shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.tokens import FOLDER, VOCABULARY, with_tokens
from lodestrata.session import materialize

CAPACITY = 2048
#: Items of a shard; what one task holds.
SHARD_ITEMS = 4000
#: Containers filled less than this after the first round are packed again with those of other shards.
GOOD_FILL = 0.97


def in_order(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item as they come: a new one where an item doesn't fit."""
    out = np.empty(len(sizes), dtype=np.int64)
    b = room = -1
    for i, s in enumerate(sizes.tolist()):
        if s > room:
            b, room = b + 1, capacity
        out[i] = b
        room -= s
    return out


class Search:
    """Local search over one shard's containers; ``steps`` counts moves and exchanges (by given and taken items)."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.sizes, self.bins, self.capacity = sizes, bins.copy(), capacity
        n = int(bins.max()) + 1 if len(bins) else 0
        self.fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        self.items: list[list[int]] = [[] for _ in range(n)]
        for i in np.flatnonzero(sizes > 0).tolist():
            self.items[bins[i]].append(i)
        # of every container one item of each size, and one pair of items of each sum
        self.one: list[np.ndarray] = [self._ones(b) for b in range(n)]
        self.two: dict[int, np.ndarray] = {}
        self.steps: dict[tuple[int, int], int] = {}

    def _ones(self, b: int) -> np.ndarray:
        """Rows (size, item)."""
        got = {int(self.sizes[i]): i for i in self.items[b]}
        return np.array(sorted(got.items()), dtype=np.int64).reshape(-1, 2)

    def _twos(self, b: int) -> np.ndarray:
        """Rows (sum, item, item)."""
        if b not in self.two:
            own: dict[int, list[int]] = {}
            for i in self.items[b]:
                own.setdefault(int(self.sizes[i]), []).append(i)
            got: dict[int, tuple[int, int]] = {}
            sizes = sorted(own)
            for k, x in enumerate(sizes):
                if len(own[x]) > 1:
                    got[2 * x] = (own[x][0], own[x][1])
                for y in sizes[k + 1 :]:
                    got[x + y] = (own[x][0], own[y][0])
            self.two[b] = np.array([(k, *v) for k, v in sorted(got.items())], dtype=np.int64).reshape(-1, 3)
        return self.two[b]

    def _apply(self, b: int, t: int, give: list[int], take: list[int]) -> None:
        for i in give:
            self.items[b].remove(i)
        for i in take:
            self.items[t].remove(i)
        self.items[t] += give
        self.items[b] += take
        self.bins[give], d = t, int(self.sizes[give].sum())
        if take:
            self.bins[take], d = b, d - int(self.sizes[take].sum())
        self.fill[t] += d
        self.fill[b] -= d
        for x in (b, t):
            self.one[x] = self._ones(x)
            self.two.pop(x, None)
        self.steps[len(give), len(take)] = self.steps.get((len(give), len(take)), 0) + 1

    def _exchange(self, b: int, targets: np.ndarray, mine: np.ndarray, theirs: list[np.ndarray]) -> bool:
        """The exchange of one of ``mine`` for one of ``theirs`` that raises the sum of squares most; rows hold a size and items."""
        if not len(mine) or not len(targets):
            return False
        rows = np.concatenate(theirs)
        of = np.repeat(targets, [len(x) for x in theirs])
        room = self.capacity - self.fill[of]
        d = mine[:, :1] - rows[None, :, 0]
        gain = np.where((d > 0) & (d <= room), d * (self.fill[of] - self.fill[b] + d), 0)
        k = int(np.argmax(gain)) if gain.size else 0
        if not gain.size or gain.flat[k] <= 0:
            return False
        i, j = divmod(k, len(rows))
        self._apply(b, int(of[j]), mine[i, 1:].tolist(), rows[j, 1:].tolist())
        return True

    def step(self, b: int) -> bool:
        """One step that raises the sum of squares, by giving from ``b`` to containers no emptier: a move into the least room
        that the largest possible item fills, else the best exchange of one for one, two for one, or one for two."""
        room = self.capacity - self.fill
        targets = np.flatnonzero((room > 0) & (self.fill >= self.fill[b]) & (self.fill > 0))
        targets = targets[targets != b]
        mine = self.one[b]
        if not len(targets) or not len(mine):
            return False
        rooms = room[targets]
        for s, i in mine[::-1].tolist():
            left = np.where(rooms >= s, rooms - s, self.capacity + 1)
            k = int(np.argmin(left))
            if left[k] <= self.capacity:
                self._apply(b, int(targets[k]), [i], [])
                return True
        ones = [self.one[t] for t in targets.tolist()]
        return (
            self._exchange(b, targets, mine, ones)
            or self._exchange(b, targets, self._twos(b), ones)
            or self._exchange(b, targets, mine, [self._twos(t) for t in targets.tolist()])
        )

    def run(self) -> np.ndarray:
        least = -(-int(self.sizes.sum()) // self.capacity)
        stuck = np.zeros(len(self.fill), dtype=bool)
        while np.count_nonzero(self.fill) > least:
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & ~stuck)
            if not len(open_):
                break
            b = int(open_[np.argmin(self.fill[open_])])
            if self.step(b):
                stuck[:] = False
            else:
                stuck[b] = True
        # items without a size stay where they are, or go to any container if theirs is gone
        used = np.flatnonzero(self.fill > 0)
        gone = (self.sizes == 0) & (self.fill[self.bins] == 0) if len(self.bins) else np.zeros(0, dtype=bool)
        if gone.any() and len(used):
            self.bins[gone] = used[0]
        return np.unique(self.bins, return_inverse=True)[1].reshape(-1)


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search from ``bins``; every step raises the sum of squared fills, so it ends."""
    return Search(np.asarray(sizes, dtype=np.int64), bins, capacity).run() if len(bins) else bins


def pack_shard(sizes: np.ndarray, capacity: int) -> np.ndarray:
    sizes = np.asarray(sizes, dtype=np.int64)
    return improve(sizes, in_order(sizes, capacity), capacity)


def _round(items: DataFrame, shards: int, capacity: int, number: int) -> DataFrame:
    dealt = items.withColumn("_shard", F.pmod(F.xxhash64(F.lit(number), "item_key", "part", "copy"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_key", "part", "copy"], kind="stable", na_position="first")
        b = pack_shard(pdf["n_tokens"].to_numpy(), capacity)
        shard = int(pdf["_shard"].iloc[0])
        full = np.bincount(b, weights=pdf["n_tokens"])
        return pdf.assign(container=[f"{number}-{shard}-{x}" for x in b], fill=full[b].astype(np.int64))[["item_key", "part", "copy", "n_tokens", "container", "fill"]]

    key = items.schema["item_key"].dataType.simpleString()
    # as many partitions as shards, which adaptive execution would merge: the rows are few bytes, but much work
    spark = items.sparkSession
    parts = min(shards, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(parts, "_shard").groupBy("_shard").applyInPandas(one, f"item_key {key}, part int, copy long, n_tokens int, container string, fill long")


def pack(items: DataFrame, *, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, good_fill: float = GOOD_FILL) -> DataFrame:
    """``item_key, part, copy, n_tokens, container, fill``: the container of every item of ``items`` (``item_key,
    n_tokens``), ``fill`` being all that it holds.

    An item above the capacity, and no other, is split: its parts, counted from 0, hold ``capacity`` each, the last the
    rest. Items without size get a container too. A row given k times is k items, told by ``copy`` from 0; a null key is
    a key like any other. A null or negative size counts as 0. An empty table gives no rows."""
    size = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0))
    n = items.select("item_key", size.alias("n")).groupBy("item_key", "n").agg(F.count("*").alias("times"))
    # in steps, so that no array grows with the number of repeats
    step = 100_000
    spans = n.select("item_key", "n", "times", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / step))).alias("m"))
    copies = spans.select("item_key", "n", F.explode(F.sequence(F.col("m") * step, F.least((F.col("m") + 1) * step, F.col("times")) - 1)).alias("copy"))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    parts = copies.select("item_key", "copy", "n", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    sized = materialize(parts.select("item_key", F.col("part").cast("int").alias("part"), "copy", F.when(F.col("part") < F.col("last"), capacity).otherwise(F.col("n") - F.col("last") * capacity).cast("int").alias("n_tokens")))
    whole = sized.where(F.col("n_tokens") == capacity)
    rest = sized.where(F.col("n_tokens") < capacity)
    count = max(1, rest.count())
    first = materialize(_round(rest, -(-count // shard_items), capacity, 1))
    done = first.where(F.col("fill") >= good_fill * capacity)
    poor = first.where(F.col("fill") < good_fill * capacity)
    left = max(1, poor.count())
    second = _round(poor.select("item_key", "part", "copy", "n_tokens"), -(-left // shard_items), capacity, 2)
    alone = whole.withColumn("container", F.concat_ws("-", F.lit("0"), F.coalesce(F.col("item_key").cast("string"), F.lit("")), "copy", "part")).withColumn("fill", F.lit(capacity).cast("long"))
    return alone.unionByName(done).unionByName(second)


def pack_documents(documents: DataFrame, *, capacity: int = CAPACITY, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    sized = with_tokens(documents, text="text", keep=["doc_id"], folder=folder, vocabulary=vocabulary)
    out = pack(sized.withColumnRenamed("doc_id", "item_key"), capacity=capacity)
    return out.withColumnRenamed("item_key", "doc_id")
