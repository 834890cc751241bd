"""Views of a repository's index: lookups and listings of anchors, counts and gates, what to reconcile, and the passage of
link proposals from the overlay into the baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import url_slug
from lodestrata.operators import drift as D
from lodestrata.operators import links as L
from lodestrata.operators.lookup import repaired_ids


def get_anchors(asked: DataFrame, anchors: DataFrame) -> DataFrame:
    """``asked`` and the anchor it means (``found`` false and nulls where it means none); ids are repaired first."""
    hit = repaired_ids(asked, anchors)
    a = anchors.select("id", "anchor_type", "path", "heading_path", "symbol_name", "content_hash", "is_test")
    return hit.join(a, "id", "left").select("asked", F.col("anchor_type").isNotNull().alias("found"), "id", "anchor_type", "path", "heading_path", "symbol_name", "content_hash", "is_test")


def list_anchors(anchors: DataFrame, *, types: list[str] | None = None, prefix: str | None = None, most: int = 500) -> DataFrame:
    """The first ``most`` anchors by id, and ``truncated``, whether there are more. Both filters reach the scan, and each task
    keeps no more rows than are asked for."""
    out = anchors.where(F.col("anchor_type").isin(types)) if types else anchors
    if prefix:
        out = out.where(F.startswith("path", F.lit(prefix)))
    some = out.select("id", "anchor_type", "path", "symbol_name", "is_test").orderBy("id").limit(most + 1)
    n = F.row_number().over(Window.orderBy("id"))  # of most + 1 rows
    return some.withColumn("n", n).withColumn("truncated", F.max("n").over(Window.partitionBy()) > most).where(F.col("n") <= most).drop("n")


def repo_summary(anchors: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row a repository: anchors by type, links that start there and how many of them have drifted."""
    kinds = ["section", "code_in_doc", "code"]
    a = anchors.groupBy("repo").agg(F.count("*").alias("anchors"), *[F.count_if(F.col("anchor_type") == k).alias(k) for k in kinds], F.count_if("is_test").alias("tests"), F.count_distinct("path").alias("files"))
    e = evaluated.groupBy(F.substring_index("from_id", "/", 1).alias("repo")).agg(F.count("*").alias("links"), F.count_if(F.col("drift_status") != "fresh").alias("drifted"))
    return a.join(e, "repo", "left").fillna(0, ["links", "drifted"])


def check(evaluated: DataFrame, live: DataFrame, anchors: DataFrame, *, least_drift: float = 0.0, least_coverage: float = 0.0) -> DataFrame:
    """One row: both scores, whether each reaches its gate (a null score passes), and the exit code."""
    both = D.summary(evaluated).select("total", "drift_score").crossJoin(D.coverage(live, anchors).select("code_anchors", "coverage_score"))  # one row each
    ok = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(True))
    out = both.withColumn("drift_passes", ok("drift_score", least_drift)).withColumn("coverage_passes", ok("coverage_score", least_coverage))
    return out.withColumn("exit_code", F.when(F.col("drift_passes") & F.col("coverage_passes"), 0).otherwise(1))


def doctor(anchors: DataFrame, chunks: DataFrame, vectors: DataFrame, *, dim: int) -> DataFrame:
    """``probe, n``: ids given twice, chunks without an anchor, stale chunks, chunks without a vector, vectors without a chunk,
    and vectors of another length. Each is one aggregation over keys."""
    a = anchors.select(F.col("id").alias("parent_id"), "content_hash").distinct()
    c = chunks.select("chunk_id", "parent_id", "parent_content_hash").distinct()
    ids, have = c.select("chunk_id").distinct(), vectors.select("chunk_id").distinct()
    probes = {
        "ids given twice": anchors.groupBy("id").agg(F.count("*").alias("k")).where("k > 1"),
        "chunks without an anchor": c.join(a, "parent_id", "left_anti"),
        "stale chunks": c.join(a, "parent_id").where("content_hash <> parent_content_hash"),
        "chunks without a vector": ids.join(have, "chunk_id", "left_anti"),
        "vectors without a chunk": have.join(ids, "chunk_id", "left_anti"),
        "vectors of another length": vectors.where(F.coalesce(F.size("embedding") != dim, F.lit(True))).select("chunk_id").distinct(),
    }
    out = None
    for name, rows in probes.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("probe"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def to_reconcile(evaluated: DataFrame, live: DataFrame, anchors: DataFrame) -> DataFrame:
    """``link_id, side, anchor_id, stored_hash, current_hash, drift_status``: for links that aren't fresh, each end whose text is
    another than when the link was made; an end that is gone has no current hash. The links' hashes from before a rename
    count if there are any."""
    e = evaluated.where("drift_status <> 'fresh'").select("link_id", "drift_status")
    ref = lambda p: F.coalesce(f"prior_{p}_content_hash", f"{p}_content_hash")
    sides = F.array(*[F.struct(F.lit(p).alias("side"), F.col(f"{p}_id").alias("anchor_id"), ref(p).alias("stored_hash")) for p in ("from", "to")])
    ends = live.join(e, "link_id").select("link_id", "drift_status", F.inline(sides))
    now = anchors.select(F.col("id").alias("anchor_id"), F.col("content_hash").alias("current_hash"))
    return ends.join(now, "anchor_id", "left").where(~F.col("current_hash").eqNullSafe(F.col("stored_hash"))).select("link_id", "side", "anchor_id", "stored_hash", "current_hash", "drift_status")


def index_totals(anchors: DataFrame, chunks: DataFrame, pruned: DataFrame) -> DataFrame:
    """One row: files, anchors, chunks, and anchors pruned (``id``)."""
    a = anchors.agg(F.count_distinct("path").alias("files"), F.count_distinct("id").alias("anchors"))
    c = chunks.agg(F.count_distinct("chunk_id").alias("chunks"))
    return a.crossJoin(c).crossJoin(pruned.agg(F.count_distinct("id").alias("pruned")))  # one row each


def skip_reasons(files: DataFrame) -> DataFrame:
    """``skip_reason, n`` of files that are left out."""
    return files.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def stale_counts(diff: DataFrame, by: list[str]) -> DataFrame:
    """Files to index again (new or changed) and files that are missing, from a manifest comparison (``change``)."""
    return diff.groupBy(*by).agg(F.count_if(F.col("change").isin("new", "changed")).alias("stale"), F.count_if(F.col("change") == "removed").alias("missing"))


def change_estimate(manifest: DataFrame, dirty: DataFrame, diff: DataFrame) -> DataFrame:
    """``repo, n``: dirty files in the manifest plus files of the difference in the manifest (all with ``repo, path``); a file that
    is both counts twice, as the estimate is of work and not of files."""
    m = manifest.select("repo", "path").distinct()
    hit = lambda x: x.select("repo", "path").distinct().join(m, ["repo", "path"], "left_semi").groupBy("repo").agg(F.count("*").alias("k"))
    both = hit(dirty).unionByName(hit(diff)).groupBy("repo").agg(F.sum("k").alias("k"))
    return m.select("repo").distinct().join(both, "repo", "left").select("repo", F.coalesce("k", F.lit(0)).alias("n"))


def pending_branches(records: DataFrame, branch: Column) -> DataFrame:
    """``overlay, n``: overlay names of branches with records that aren't in the baseline yet, and how many."""
    base = records.where("layer = 0").select("event_id").distinct()
    over = records.where("layer = 1").withColumn("overlay", url_slug(branch)).join(base, "event_id", "left_anti")
    return over.groupBy("overlay").agg(F.count_distinct("event_id").alias("n"))


def overlay(records: DataFrame, branch: Column, name: str) -> DataFrame:
    """The log that one branch sees: the baseline and its own overlay."""
    return records.where((F.col("layer") == 0) | (url_slug(branch) == name))


def accept(log: DataFrame, proposed: DataFrame) -> DataFrame:
    """``link_id, status`` and the link's ends: accepted if the proposed link is active, else unknown."""
    live = L.active(log).select("link_id", "from_id", "to_id", "link_type")
    j = proposed.select("link_id").distinct().join(live.withColumn("_live", F.lit(True)), "link_id", "left")
    return j.select("link_id", F.when(F.col("_live"), "accepted").otherwise("unknown").alias("status"), "from_id", "to_id", "link_type")


def commit(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All overlay records promoted: the log after it, and ``event_id, link_id`` of the promoted, the link being named only if the
    record is its last one and it is active."""
    base = log.where("layer = 0").select("event_id").distinct()
    pending = log.where("layer = 1").select("event_id").distinct()
    after = L.promote(log, pending)
    last = L.active(after).select("event_id", "link_id").distinct()
    return after, pending.join(base, "event_id", "left_anti").join(last, "event_id", "left")


def recover(log: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Promotions that broke off, finished: ``markers`` (``marker, event_ids``) name what was to be promoted. What the baseline
    has already is not added again and leaves the overlay; a marker without events has nothing to do. Returns the log and
    the distinct ``event_id`` finished; repeating it changes nothing."""
    named = markers.select(F.explode("event_ids").alias("event_id")).where("event_id is not null").distinct()
    return L.promote(log, named), named


def apply_suggestions(log: DataFrame, anchors: DataFrame, pairs: DataFrame, judged: DataFrame, responses: DataFrame, *, at: Column, by: Column) -> DataFrame:
    """Upsert records of the suggested links that no rule rejects: ``pairs`` (``pair_id, code_id, section_id``) joined with the answers."""
    ok = judged.where("reason is null").select("pair_id").distinct()
    one = responses.join(ok, "pair_id", "left_semi").groupBy("pair_id").agg(F.max_by("link_type", "confidence").alias("link_type"))
    chosen = pairs.join(one, "pair_id").select(F.col("code_id").alias("from_id"), F.col("section_id").alias("to_id"), "link_type")
    return L.proposals(log, chosen, anchors, at=at, by=by)


# Severities from the most to the least pressing.
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
FINDING = "struct<findings:array<struct<pair_id:string,is_drifted:boolean,severity:string,doc_claim:string,code_reality:string,suggestion:string>>>"


def audit_findings(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings of answers (``response``, JSON with ``findings``) about known pairs (``pair_id, section_id, code_id``) that have
    drifted and are of a known severity, whatever its case; ``place`` orders them by severity, then by pair."""
    f = raw.select(F.explode(F.from_json("response", FINDING)["findings"]).alias("f")).select("f.*")
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.upper("severity"))
    good = f.where(F.coalesce("is_drifted", F.lit(False)) & (rank > 0)).join(pairs.select("pair_id", "section_id", "code_id").distinct(), "pair_id")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return good.select("pair_id", "section_id", "code_id", F.upper("severity").alias("severity"), rank.cast("int").alias("place"), text("doc_claim"), text("code_reality"), text("suggestion")).orderBy("place", "pair_id")


def affected_claims(claims: DataFrame, dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """``claim_id, doc`` of claims (``claim_id, doc``) one of whose files (``claim_id, path``) has changed (``path``), by document and
    claim."""
    hit = dependencies.join(changed.select("path").distinct(), "path", "left_semi").select("claim_id").distinct()
    return claims.join(hit, "claim_id", "left_semi").select("claim_id", "doc").distinct().orderBy("doc", "claim_id")


def reusable_verdicts(verdicts: DataFrame, evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """Verdicts (``claim_id``) none of whose files of evidence (``claim_id, path``) has changed (``path``); those without evidence stay."""
    stale = evidence.where("path is not null").join(changed.select("path").distinct(), "path", "left_semi").select("claim_id").distinct()
    return verdicts.join(stale, "claim_id", "left_anti")


def anchors_at(positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """``path, line, char, id``: the code anchor declared at each position (``path, line, char``), null where there is none."""
    a = anchors.where("def_line is not null and def_char is not null").groupBy(F.col("path"), F.col("def_line").alias("line"), F.col("def_char").alias("char")).agg(F.min("id").alias("id"))
    return positions.select("path", "line", "char").distinct().join(a, ["path", "line", "char"], "left")


def token_total(batches: DataFrame, *, tokens: Column, most: int) -> DataFrame:
    """One row: batches, their tokens, and whether that is more than ``most``."""
    return batches.agg(F.count("*").alias("batches"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens")).withColumn("over", F.col("tokens") > most)


# Fields of a packet that are for the engine's own use.
INTERNAL = ["content_hash", "fingerprint_simhash", "def_line", "def_char", "closure_hash", "overview_embedding"]


def compact(packets: DataFrame) -> DataFrame:
    """Packets without internal fields, at the top and in structs and arrays of structs below it."""
    from pyspark.sql import types as T

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            kept = [f for f in t.fields if f.name not in INTERNAL]
            return F.when(c.isNull(), None).otherwise(F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kept])) if kept else F.lit(None)
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        return c

    return packets.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in packets.schema.fields if f.name not in INTERNAL])
