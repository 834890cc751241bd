"""Event-sourced links: replay, conflicts, promotion, validation of appends, and the views over active links.

A log is a DataFrame of link records with ``layer`` (0 baseline, 1 overlay) and ``pos``, the place in its layer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positioned(records: DataFrame) -> DataFrame:
    """The delivered table as a log: the place in a layer is the time of receipt, then the event."""
    return records.withColumn("pos", F.struct("received_at", "event_id"))


def last_events(log: DataFrame) -> DataFrame:
    """The last record of every link: overlay after baseline, then by place."""
    w = Window.partitionBy("link_id").orderBy(F.desc("layer"), F.desc("pos"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def active(log: DataFrame) -> DataFrame:
    """Active links: those whose last record is an upsert."""
    return last_events(log).where(F.col("op") == "upsert")


def conflicts(log: DataFrame) -> DataFrame:
    """``link_id`` of broken chains: distinct upserts that replace the same record, or records that replace an unknown one.

    Both sides work on (event, replaced record, link) only; a record delivered twice counts once."""
    recs = log.select("event_id", "supersedes", "link_id", "op").groupBy("event_id").agg(F.min(F.struct("supersedes", "link_id", "op")).alias("r")).select("event_id", "r.*")
    ups = recs.where((F.col("op") == "upsert") & F.col("supersedes").isNotNull())
    targets = ups.groupBy("supersedes").agg(F.count("*").alias("n")).where("n >= 2").select("supersedes")
    forks = ups.join(targets, "supersedes", "left_semi").select("link_id")
    named = log.where(F.col("supersedes").isNotNull()).select("link_id", "supersedes").distinct()
    known = log.select(F.col("event_id").alias("supersedes")).distinct()
    lost = named.join(known, "supersedes", "left_anti").select("link_id")
    return forks.unionByName(lost).distinct()


def promote(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log after promotion of the overlay records of ``events`` (event_id): they move to the baseline, unless it has
    them already, so that a repeated promotion changes nothing."""
    chosen = log.where("layer = 1").join(events.select("event_id").distinct(), "event_id", "left_semi")
    have = log.where("layer = 0").select("event_id").distinct()
    moved = chosen.join(have, "event_id", "left_anti").withColumn("layer", F.lit(0).cast(log.schema["layer"].dataType))
    stay = log.where("layer = 1").join(events.select("event_id").distinct(), "event_id", "left_anti")
    return log.where("layer = 0").unionByName(moved.select(*log.columns)).unionByName(stay.select(*log.columns))


VIOLATIONS = "link_id string, event_id string, violation string"


def validate_appends(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """``link_id, event_id, violation`` (null if it may be appended) of new records, taken in order of ``ts, event_id``.

    A deleted link stays deleted; an upsert of a link that exists must replace its last record; a delete must name the
    last record; the record replaced must be of the link. A rejected record leaves the state as it was. One link's
    candidates are folded in one task; a link has few of them in a batch."""
    state = last_events(log).select("link_id", F.col("op").alias("last_op"), F.col("event_id").alias("last_event"))
    new = candidates.select("link_id", "event_id", "op", "supersedes", "ts").join(state, "link_id", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"], kind="stable")
        op, event = pdf["last_op"].iloc[0], pdf["last_event"].iloc[0]
        op, event = (None, None) if pd.isna(event) else (op, event)
        out = []
        for r in pdf.itertuples():
            sup = None if pd.isna(r.supersedes) else r.supersedes
            if op == "delete":
                bad = "link is deleted"
            elif r.op == "delete" and event is None:
                bad = "delete of an unknown link"
            elif event is None and sup is not None:
                bad = "replaces an unknown record"
            elif event is not None and sup is None:
                bad = "replaces nothing"
            elif event is not None and sup != event:
                bad = "replaces another than the last record"
            else:
                bad = None
                op, event = r.op, r.event_id
            out.append((r.link_id, r.event_id, bad))
        return pd.DataFrame(out, columns=["link_id", "event_id", "violation"])

    return new.groupBy("link_id").applyInPandas(fold, VIOLATIONS)


def shape_violations(records: DataFrame) -> DataFrame:
    """``event_id, violations`` of records that lack a field their op needs or have one it forbids."""
    ends = ["from_id", "to_id", "from_type", "to_type", "link_type"]
    need = [F.when((F.col("op") == "upsert") & F.col(c).isNull(), F.lit(f"upsert without {c}")) for c in ends]
    forbid = [F.when((F.col("op") == "delete") & F.col(c).isNotNull(), F.lit(f"delete with {c}")) for c in ends]
    other = [
        F.when((F.col("op") == "delete") & F.col("supersedes").isNull(), F.lit("delete without supersedes")),
        F.when(~F.col("link_id").rlike("^lnk_") | F.col("link_id").isNull(), F.lit("link_id")),
        F.when(~F.col("event_id").rlike("^evt_") | F.col("event_id").isNull(), F.lit("event_id")),
    ]
    bad = F.array_compact(F.array(*need, *forbid, *other))
    return records.select("event_id", bad.alias("violations")).where(F.size("violations") > 0)


def latest_logical(log: DataFrame) -> DataFrame:
    """Of the active links of one (from, to, type) the latest, with the number of all records of it."""
    key = ["from_id", "to_id", "link_type"]
    ups = log.where("op = 'upsert'").groupBy(*key).agg(F.count("*").alias("n_records"))
    w = Window.partitionBy(*key).orderBy(F.desc("layer"), F.desc("pos"))
    return active(log).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(ups, key)


def links_of(log: DataFrame, anchors: DataFrame, *, types: list[str] | None = None) -> DataFrame:
    """``anchor_id, direction, link_id, other_id, link_type``: active links of every anchor of ``anchors`` (id), both ways.
    Two equi joins; a link from an anchor to itself is there in both directions."""
    live = active(log).select("link_id", "from_id", "to_id", "link_type", "layer", "pos")
    if types:
        live = live.where(F.col("link_type").isin(types))
    ids = anchors.select(F.col("id").alias("anchor_id")).distinct()
    out = live.withColumn("anchor_id", F.col("from_id")).withColumn("direction", F.lit("outgoing")).withColumn("other_id", F.col("to_id"))
    into = live.withColumn("anchor_id", F.col("to_id")).withColumn("direction", F.lit("incoming")).withColumn("other_id", F.col("from_id"))
    return out.unionByName(into).join(ids, "anchor_id", "left_semi").select("anchor_id", "direction", "link_id", "other_id", "link_type", "layer", "pos")


def capped_links(neighbours: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` links of each anchor and direction in replay order."""
    w = Window.partitionBy("anchor_id", "direction").orderBy("layer", "pos")
    return neighbours.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("layer", "pos")


# Endpoint types a link type is meant for.
DIRECTIONS = {"implements": (["code"], ["section"]), "tests": (["code"], ["code", "section"]), "examples": (["code_in_doc"], ["code", "section"]), "mirrors": (["section", "code", "code_in_doc"], ["section", "code", "code_in_doc"]), "derives-from": (["section"], ["section"]), "references": (["section", "code", "code_in_doc"], ["section", "code", "code_in_doc"])}


def off_direction(links: DataFrame) -> DataFrame:
    """Links whose endpoint types aren't those their type is meant for, and links from an anchor to itself."""
    ok = F.lit(False)
    for kind, (a, b) in DIRECTIONS.items():
        ok = ok | ((F.col("link_type") == kind) & F.col("from_type").isin(a) & F.col("to_type").isin(b))
    return links.where(~F.coalesce(ok, F.lit(False)) | (F.col("from_id") == F.col("to_id")))


def tombstones(log: DataFrame, link_ids: DataFrame, *, at: Column, by: Column) -> DataFrame:
    """Delete records that end the active links of ``link_ids``; ids follow from what they replace, so a repeat is the same event."""
    live = active(log).join(link_ids.select("link_id").distinct(), "link_id", "left_semi")
    event = F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat(F.lit("delete:"), F.col("event_id")), 256), 1, 32))
    return live.select(F.lit(1).alias("layer"), F.lit("delete").alias("op"), "link_id", event.alias("event_id"), at.alias("ts"), F.col("event_id").alias("supersedes"), by.alias("created_by"))


def proposals(log: DataFrame, pairs: DataFrame, anchors: DataFrame, *, at: Column, by: Column) -> DataFrame:
    """Upserts of ``pairs`` (from_id, to_id, link_type) with the anchors' current hashes. A pair that is linked keeps its
    link id and replaces its record; pairs of unknown anchors and of an anchor with itself are left out."""
    a = anchors.select(F.col("id"), "anchor_type", "content_hash", "closure_hash")
    f = a.select(F.col("id").alias("from_id"), F.col("anchor_type").alias("from_type"), F.col("content_hash").alias("from_content_hash"), F.col("closure_hash").alias("from_closure_hash"))
    t = a.select(F.col("id").alias("to_id"), F.col("anchor_type").alias("to_type"), F.col("content_hash").alias("to_content_hash"), F.col("closure_hash").alias("to_closure_hash"))
    w = Window.partitionBy("from_id", "to_id", "link_type").orderBy(F.desc("layer"), F.desc("pos"))
    live = active(log).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("from_id", "to_id", "link_type", F.col("link_id").alias("old_link"), F.col("event_id").alias("supersedes"))
    new = pairs.where("from_id <> to_id").select("from_id", "to_id", "link_type").distinct().join(f, "from_id").join(t, "to_id").join(live, ["from_id", "to_id", "link_type"], "left")
    of = F.sha2(F.concat_ws("|", "from_id", "to_id", "link_type"), 256)
    ev = F.sha2(F.concat_ws("|", "from_id", "to_id", "link_type", F.coalesce("supersedes", F.lit("")), "from_content_hash", "to_content_hash"), 256)
    return new.select(
        F.lit(1).alias("layer"), F.lit("upsert").alias("op"), F.coalesce("old_link", F.concat(F.lit("lnk_"), F.substring(of, 1, 26))).alias("link_id"), F.concat(F.lit("evt_"), F.substring(ev, 1, 32)).alias("event_id"), at.alias("ts"),
        "from_id", "from_type", "to_id", "to_type", "link_type", "from_content_hash", "to_content_hash", "from_closure_hash", "to_closure_hash", "supersedes", by.alias("created_by"),
    )
