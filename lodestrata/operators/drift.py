"""Drift of links against current anchors: status ladder, scores, coverage and the repository views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import endpoint_path, language
from lodestrata.functions.vectors import cosine_distance
from lodestrata.operators import links as L

# Statuses from the most to the least pressing, and their weights in the score.
PRECEDENCE = ["merge-conflict", "broken-source", "broken-target", "both-changed", "spec-changed", "code-changed", "drift-unknown", "fresh"]
WEIGHTS = {"merge-conflict": 1.0, "broken-source": 1.0, "broken-target": 1.0, "both-changed": 0.5, "spec-changed": 0.3, "code-changed": 0.3, "drift-unknown": 0.3, "fresh": 0.0}
SEMANTIC_WEIGHT, SEMANTIC_BOUND = 0.2, 0.25


def _side(anchors: DataFrame, p: str) -> DataFrame:
    cols = {"id": f"{p}_id", "anchor_type": f"{p}_now_type", "content_hash": f"{p}_now_hash", "closure_hash": f"{p}_now_closure", "transitive_hash_status": f"{p}_hash_status", "path": f"{p}_path", "overview_embedding": f"{p}_vec"}
    return anchors.select(*[F.col(a).alias(b) for a, b in cols.items()])


def _changed(p: str) -> Column:
    """Content against the hash from before a rename if there is one, else the stored one; closures only if both are
    known and the anchor's is reliable."""
    ref = F.coalesce(f"prior_{p}_content_hash", f"{p}_content_hash")
    content = ~F.col(f"{p}_now_hash").eqNullSafe(ref)
    comparable = (F.col(f"{p}_now_type") != "code") | F.coalesce(F.col(f"{p}_hash_status").isin("complete", "partial"), F.lit(False))
    closure = comparable & F.col(f"{p}_closure_hash").isNotNull() & F.col(f"{p}_now_closure").isNotNull() & (F.col(f"{p}_closure_hash") != F.col(f"{p}_now_closure"))
    return content | F.coalesce(closure, F.lit(False))


def evaluate(live: DataFrame, anchors: DataFrame, conflicted: DataFrame, *, bound: float = SEMANTIC_BOUND) -> DataFrame:
    """Active links with ``drift_status`` and ``semantic_drift`` (three-valued: null where it can't be told; only links of
    type mirrors, and only between vectors of the same language). Two left joins by id; the ladder is one expression."""
    both = live.join(_side(anchors, "from"), "from_id", "left").join(_side(anchors, "to"), "to_id", "left").join(conflicted.select("link_id", F.lit(True).alias("_conflict")), "link_id", "left")
    a, b = _changed("from"), _changed("to")
    kind = lambda p: F.when(F.col(f"{p}_now_type") == "section", "spec-changed").otherwise("code-changed")
    error = lambda p: (F.col(f"{p}_now_type") == "code") & F.coalesce(F.col(f"{p}_hash_status") == "lsp_error", F.lit(False))
    status = (
        F.when(F.coalesce("_conflict", F.lit(False)), "merge-conflict")
        .when(F.col("from_now_type").isNull(), "broken-source")
        .when(F.col("to_now_type").isNull(), "broken-target")
        .when(a & b, "both-changed")
        .when(a, kind("from"))
        .when(b, kind("to"))
        .when(error("from") | error("to"), "drift-unknown")
        .otherwise("fresh")
    )
    la, lb = language(F.col("from_path")), language(F.col("to_path"))
    same = la.isNull() | lb.isNull() | (la == lb)
    semantic = F.when((F.col("link_type") == "mirrors") & status.isin(*PRECEDENCE[3:]) & F.col("from_vec").isNotNull() & F.col("to_vec").isNotNull() & same, cosine_distance(F.col("from_vec"), F.col("to_vec")) > bound)
    return both.select(*live.columns, "from_path", "to_path", status.alias("drift_status"), semantic.alias("semantic_drift"))


def evaluate_all(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """Drift of the baseline's active links."""
    base = log.where("layer = 0")
    return evaluate(L.active(base), anchors, L.conflicts(base))


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: links by status, the drift score (0 to 100, null without links)."""
    weight = F.lit(0.0)
    for s, w in WEIGHTS.items():
        weight = F.when(F.col("drift_status") == s, w).otherwise(weight)
    weight = weight + F.when(F.col("semantic_drift"), SEMANTIC_WEIGHT).otherwise(0.0)
    counts = [F.count_if(F.col("drift_status") == s).alias(s.replace("-", "_")) for s in PRECEDENCE]
    score = F.when(F.count("*") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - F.sum(weight) / F.count("*")))))
    return evaluated.agg(F.count("*").alias("total"), *counts, F.count_if(F.col("semantic_drift")).alias("semantic"), F.round(score, 6).alias("drift_score"))


def coverage(live: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: code anchors, those that are an endpoint of an active link, and the share in percent (null without any)."""
    ends = live.where("from_type = 'code'").select(F.col("from_id").alias("id")).unionByName(live.where("to_type = 'code'").select(F.col("to_id").alias("id"))).distinct()
    code = anchors.where("anchor_type = 'code'").select("id")
    marked = code.join(ends.withColumn("linked", F.lit(1)), "id", "left")
    n = F.count("*")
    return marked.agg(n.alias("code_anchors"), F.count("linked").alias("linked"), F.when(n > 0, F.round(100 * F.count("linked") / n, 6)).alias("coverage_score"))


def uncovered(live: DataFrame, anchors: DataFrame, most: int = 25) -> DataFrame:
    """The longest sections without an active link."""
    ends = live.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    rest = anchors.where("anchor_type = 'section'").join(ends, "id", "left_anti")
    return rest.select("id", "path", F.length("content_text").alias("n_chars")).orderBy(F.desc("n_chars"), "id").limit(most)


def in_scope(evaluated: DataFrame, *, prefix: str | None = None, statuses: list[str] | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Links by the start of the source's id or path, by status, and by changed paths (``path``) at either end."""
    out = evaluated
    if statuses:
        unknown = set(statuses) - set(PRECEDENCE)
        if unknown:
            raise ValueError(f"unknown statuses: {sorted(unknown)}")
        out = out.where(F.col("drift_status").isin(statuses))
    if prefix:
        out = out.where(F.startswith("from_id", F.lit(prefix)) | F.coalesce(F.startswith("from_path", F.lit(prefix)), F.lit(False)))
    if changed is not None:
        ids = changed.select("path").distinct()
        ends = out.select("link_id", F.explode(F.array(endpoint_path(F.col("from_id")), endpoint_path(F.col("to_id")))).alias("path"))
        out = out.join(ends.join(ids, "path", "left_semi").select("link_id").distinct(), "link_id", "left_semi")
    return out


def winners(evaluated: DataFrame) -> DataFrame:
    """``anchor_id, drift_status``: the most pressing status over the links of each anchor."""
    rank = F.array_position(F.array(*[F.lit(s) for s in PRECEDENCE]), F.col("drift_status"))
    ends = evaluated.select(rank.alias("r"), F.explode(F.array("from_id", "to_id")).alias("anchor_id"))
    best = ends.groupBy("anchor_id").agg(F.min("r").alias("r"))
    return best.select("anchor_id", F.element_at(F.array(*[F.lit(s) for s in PRECEDENCE]), F.col("r").cast("int")).alias("drift_status"))


def working_context(evaluated: DataFrame, anchors: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """``path, anchor_id, n_fresh, n_drifted, docs``: for anchors of the files (``path``) their links by state and the
    first other ends."""
    own = anchors.join(files.select("path").distinct(), "path", "left_semi").select("path", F.col("id").alias("anchor_id"))
    ends = evaluated.select(F.col("from_id").alias("anchor_id"), F.col("to_id").alias("other"), "drift_status").unionByName(evaluated.select(F.col("to_id").alias("anchor_id"), F.col("from_id").alias("other"), "drift_status"))
    w = Window.partitionBy("anchor_id").orderBy("other", "drift_status")
    near = ends.join(own.select("anchor_id"), "anchor_id", "left_semi").withColumn("n", F.row_number().over(w))
    per = near.groupBy("anchor_id").agg(F.count_if(F.col("drift_status") == "fresh").alias("n_fresh"), F.count_if(F.col("drift_status") != "fresh").alias("n_drifted"), F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.col("other")))).alias("docs"))
    return own.join(per, "anchor_id", "left").fillna(0, ["n_fresh", "n_drifted"])
