"""Incremental maintenance: manifest comparison, staleness, table upserts and cascades, sessions of file events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` (new, changed, removed) of two manifests (``path, content_hash``); equal files are left out."""
    o = old.select("path", F.col("content_hash").alias("o"))
    n = new.select("path", F.col("content_hash").alias("n"))
    kind = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, "path", "full").select("path", kind.alias("change")).where("change is not null")


def staleness(state: DataFrame, dirty: DataFrame, manifest: DataFrame) -> DataFrame:
    """``repo, reason`` (null: fresh): the head, dirty files that are indexed, the branch, the configuration, in this order.
    ``state`` has the indexed and the current value of each; a detached head's branch is named after it."""
    hit = dirty.join(manifest.select("repo", "path"), ["repo", "path"], "left_semi").select("repo").distinct().withColumn("_dirty", F.lit(True))
    branch = F.coalesce("branch", F.concat(F.lit("detached-"), F.substring("head", 1, 7)))
    reason = (
        F.when(~F.col("head").eqNullSafe(F.col("indexed_head")), "head_changed")
        .when(F.coalesce("_dirty", F.lit(False)), "dirty_files")
        .when(~branch.eqNullSafe(F.col("indexed_branch")), "branch_changed")
        .when(~F.col("config_hash").eqNullSafe(F.col("indexed_config_hash")), "config_changed")
    )
    return state.join(hit, "repo", "left").select("repo", reason.alias("reason"))


def index_state(stale: DataFrame, changed: DataFrame, most: int = 500) -> DataFrame:
    """``repo, index_state``: fresh, reconciling, or stale-warned where more than ``most`` files changed."""
    n = changed.groupBy("repo").agg(F.count("*").alias("n"))
    s = F.when(F.col("reason").isNull(), "fresh").when(F.coalesce("n", F.lit(0)) > most, "stale-warned").otherwise("reconciling")
    return stale.join(n, "repo", "left").select("repo", s.alias("index_state"))


def upsert_anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new anchors by id: creation times are kept, overview vectors only where the content hash is the same."""
    cols = [c for c in old.columns if c not in ("id", "created_at", "overview_embedding")]
    o = old.select("id", F.struct(*old.columns).alias("o"))
    n = new.select("id", F.struct(*new.columns).alias("n"))
    j = o.join(n, "id", "full")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    vec = F.when(F.col("n").isNull() | same, F.coalesce("n.overview_embedding", "o.overview_embedding")).otherwise(F.col("n.overview_embedding"))
    return j.select("id", *[pick(c) for c in cols], F.coalesce("o.created_at", "n.created_at").alias("created_at"), vec.alias("overview_embedding")).select(*old.columns)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks of every parent in ``new`` replaced by its new ones."""
    return old.join(new.select("parent_id").distinct(), "parent_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_anchors(anchors: DataFrame, chunks: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors without those of ``ids``, and chunks and vectors without what hung on them."""
    gone = ids.select("id").distinct()
    kept = chunks.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti").select(*chunks.columns)
    dead = chunks.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("chunk_id").distinct()
    live = kept.select("chunk_id").distinct()
    return anchors.join(gone, "id", "left_anti").select(*anchors.columns), kept, vectors.join(dead.join(live, "chunk_id", "left_anti"), "chunk_id", "left_anti").select(*vectors.columns)


def prune_missing(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Anchors whose file is gone."""
    return anchors.join(files.select("path").distinct(), "path", "left_anti")


def sessions(events: DataFrame, *, key: str, at: str, gap: str) -> DataFrame:
    """``key, started, ended, n``: bursts of events of a key, each ended by a quiet time of ``gap``."""
    w = F.session_window(at, gap)
    out = events.where(F.col(at).isNotNull()).groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))
    return out.select(key, "started", "ended", "n")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg((F.count("*") - 1).alias("n_again")).where("n_again > 0")


def suffixed(rows: DataFrame, *, parent: str, name: str, order: Column) -> DataFrame:
    """``unique_name``: the n-th of equal names of one parent gets ``-n``."""
    w = Window.partitionBy(parent, name).orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit("-"), n.cast("string"))).otherwise(F.col(name)))


def chunk_states(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """``chunk_id, state``: current, stale (the parent's hash is another now) or orphan (no parent)."""
    a = anchors.select(F.col("id").alias("parent_id"), "content_hash")
    s = F.when(F.col("content_hash").isNull(), "orphan").when(F.col("content_hash") == F.col("parent_content_hash"), "current").otherwise("stale")
    return chunks.select("chunk_id", "parent_id", "parent_content_hash").distinct().join(a, "parent_id", "left").select("chunk_id", s.alias("state"))
