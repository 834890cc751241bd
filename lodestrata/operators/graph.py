"""Graph operators over edges (src, dst): bounded closure, closure hashes, worst-status fixpoint, callers.

Loops run on the driver over frontier DataFrames. Every round is written to the shared folder, which cuts the lineage and
survives the loss of an executor; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize

# Closure states from best to worst.
STATES = ["complete", "partial", "unsupported", "lsp_unavailable", "lsp_error"]
MAX_DEPTH = 32


def closure(edges: DataFrame, roots: DataFrame, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``root, node, depth``: nodes reached from each root over at most ``max_depth`` edges with their least distance;
    cycles are fine, the root itself isn't a node of its own closure. Edges with a null end and self-loops don't count."""
    e = materialize(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    front = materialize(roots.select(F.col("id").alias("root")).where("root is not null").distinct().select("root", F.col("root").alias("node")))
    seen, parts = front, []
    for depth in range(1, max_depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = materialize(step.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        parts.append(front.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    out = front.withColumn("depth", F.lit(0)).where("false")
    for p in parts:
        out = out.unionByName(p)
    return out


def closure_hashes(closed: DataFrame, hashes: DataFrame) -> DataFrame:
    """``root, n_nodes, closure_hash``: SHA-256 over the sorted digests (64 hex digits of ``content_hash``) of a root's nodes;
    equal digests of distinct nodes count each. Nodes without a hash don't count."""
    d = closed.join(hashes.select(F.col("id").alias("node"), F.lower(F.right("content_hash", F.lit(64))).alias("d")), "node")
    of = F.sha2(F.unhex(F.array_join(F.sort_array(F.collect_list("d")), "")), 256)
    return d.groupBy("root").agg(F.count("*").alias("n_nodes"), F.concat(F.lit("sha256:"), of).alias("closure_hash"))


def closure_states(closed: DataFrame, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``root, status``: partial if a root's closure reaches ``max_depth``, as nodes there aren't followed; else complete.
    Roots without nodes have no row."""
    return closed.groupBy("root").agg(F.when(F.max("depth") >= max_depth, "partial").otherwise("complete").alias("status"))


def callers(edges: DataFrame, roots: DataFrame, *, depth: int = 1) -> DataFrame:
    """``root, node, depth``: who reaches each root over at most ``depth`` edges."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, max_depth=depth)


def worst_status(edges: DataFrame, status: DataFrame, *, max_rounds: int = 1000) -> DataFrame:
    """``id, status``: every node takes the worst state among its own and those of all it calls, to the fixpoint. Only
    nodes that changed are carried to the next round."""
    names = F.array(*[F.lit(s) for s in STATES])
    e = materialize(edges.where("src <> dst").select("src", "dst").distinct())
    now = materialize(status.select("id", (F.array_position(names, F.col("status")) - 1).cast("int").alias("r")))
    changed = now
    for _ in range(max_rounds):
        push = changed.join(e, changed["id"] == e["dst"]).groupBy("src").agg(F.max("r").alias("up"))
        joined = now.join(push, now["id"] == push["src"], "left").select("id", "r", F.greatest("r", F.coalesce("up", "r")).alias("to"))
        step = materialize(joined)
        changed = step.where("to > r").select("id", F.col("to").alias("r"))
        if changed.isEmpty():
            return now.select("id", F.element_at(names, F.col("r") + 1).alias("status"))
        now = step.select("id", F.col("to").alias("r"))
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def full_edges(calls: DataFrame, inherited: DataFrame, imported: DataFrame) -> DataFrame:
    """Edges of the full mode: calls, a class to the definitions it inherits, and a user to the definitions it imports, each once."""
    out = calls.select("src", "dst").unionByName(inherited.select("src", "dst")).unionByName(imported.select("src", "dst"))
    return out.where("src is not null and dst is not null").distinct()


def body_hashes(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """``src, dst, body_hash``: the hash of each callee's text in canonical form, null for a callee that is no anchor."""
    from lodestrata.functions.text import content_hash

    a = anchors.select(F.col("id").alias("dst"), content_hash(F.col("content_text")).alias("body_hash"))
    return edges.select("src", "dst").distinct().join(a, "dst", "left").select("src", "dst", "body_hash")


# Languages for which a call graph can be made.
ADAPTERS = ["python", "typescript", "javascript", "go", "rust", "zig"]


def enrich(anchors: DataFrame, edges: DataFrame, failed: DataFrame, *, languages: list[str] = ADAPTERS, available: list[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``id, status, closure_hash`` of code anchors: unsupported where there is no adapter for the language, lsp_unavailable where it
    has no session (``available``), lsp_error where the server failed (``failed``, id), else by the closure: partial where it reaches
    ``max_depth``, complete otherwise, with the hash of the closure (none for an anchor that calls nothing)."""
    from lodestrata.functions.text import language

    have = languages if available is None else available
    code = anchors.where("anchor_type = 'code'").select("id", language(F.col("path")).alias("lang"))
    good = code.where(F.col("lang").isin(have)).join(failed.select("id").distinct(), "id", "left_anti").select("id")
    closed = materialize(closure(edges, good, max_depth=max_depth))
    states = closure_states(closed, max_depth=max_depth).select(F.col("root").alias("id"), F.col("status").alias("reached"))
    hashes = closure_hashes(closed, anchors).select(F.col("root").alias("id"), "closure_hash")
    bad = failed.select("id", F.lit(True).alias("_failed")).distinct()
    status = F.when(~F.coalesce(F.col("lang").isin(languages), F.lit(False)), "unsupported").when(~F.col("lang").isin(have), "lsp_unavailable").when(F.col("_failed"), "lsp_error").otherwise(F.coalesce("reached", F.lit("complete")))
    return code.join(bad, "id", "left").join(states, "id", "left").join(hashes, "id", "left").select("id", status.alias("status"), "closure_hash")


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, other, direction``: one hop both ways, as two equi joins."""
    i = ids.select("id").distinct()
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction"))
    into = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(into).join(i, "id", "left_semi").distinct()
