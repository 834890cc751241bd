"""Candidates for new links and for audits, the payloads sent out for judgement, and the filters of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINK_TYPES = ["implements", "tests", "examples", "mirrors", "derives-from", "references"]


def unlinked(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """Pairs (a, b) that no active link joins in either direction: one anti join on the ordered pair."""
    have = live.select(F.least("from_id", "to_id").alias("_x"), F.greatest("from_id", "to_id").alias("_y")).distinct()
    p = pairs.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    return p.join(have, ["_x", "_y"], "left_anti").drop("_x", "_y")


def similar_opposites(anchors: DataFrame, asked: DataFrame, *, dim: int, k: int = 5) -> DataFrame:
    """``a, b, similarity``: for every anchor of ``asked`` the k most similar of the other kind (code, or anything else), by cosine of
    their overview vectors, ties by id. ``asked`` is a stated set, compared with all others in blocks, exactly; vectors that are
    null, all zero, not finite or of another length take no part."""
    from lodestrata.operators.retrieval import nearest_in_blocks

    v = F.col("overview_embedding")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(v, lambda x: x.cast("double") / size)
    ok = (F.size(v) == dim) & (size > 0) & (size < float("inf"))
    rows = lambda df: df.where(ok).select("id", (F.col("anchor_type") == "code").alias("code"), unit.alias("u"))
    out = None
    for code in (True, False):
        q = rows(asked).where(F.col("code") == code).select(F.col("id").alias("query_id"), F.col("u").alias("vec"))
        x = rows(anchors).where(F.col("code") != code).select(F.col("id").alias("chunk_id"), F.col("u").alias("embedding"))
        near = nearest_in_blocks(x, q, k, dim=dim, cosine=True)
        out = near if out is None else out.unionByName(near)
    return out.select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"), (1 - F.col("distance")).alias("similarity"))


def unordered(near: DataFrame) -> DataFrame:
    """Each unordered pair once, with its greatest similarity."""
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.max("similarity"), 6).alias("similarity"))


def candidate_pairs(near: DataFrame, anchors: DataFrame, live: DataFrame, *, most: int | None = None) -> DataFrame:
    """``a, b, similarity``: similar sections and code without a link, the first ``most`` if a cap is asked for. ``near`` (a, b,
    similarity) comes from a search; each unordered pair counts once."""
    kinds = anchors.select("id", "anchor_type")
    p = unordered(near)
    p = p.join(kinds.select(F.col("id").alias("a"), F.col("anchor_type").alias("ta")), "a").join(kinds.select(F.col("id").alias("b"), F.col("anchor_type").alias("tb")), "b")
    p = unlinked(p.where("(ta = 'section') <> (tb = 'section')"), live).select("a", "b", "similarity")
    return p if most is None else p.orderBy(F.desc("similarity"), "a", "b").limit(most)


def audit_pairs(live: DataFrame, near: DataFrame, anchors: DataFrame) -> DataFrame:
    """``section_id, code_id, origin``: linked code of a section, else similar code, else nothing."""
    s = anchors.where("anchor_type = 'section'").select(F.col("id").alias("section_id"))
    c = anchors.where("anchor_type = 'code'").select(F.col("id").alias("code_id"))
    both = lambda df, a, b: df.select(F.col(a).alias("section_id"), F.col(b).alias("code_id")).unionByName(df.select(F.col(b).alias("section_id"), F.col(a).alias("code_id")))
    linked = both(live, "from_id", "to_id").join(s, "section_id", "left_semi").join(c, "code_id", "left_semi").distinct()
    similar = both(near, "a", "b").join(s, "section_id", "left_semi").join(c, "code_id", "left_semi").distinct()
    rest = similar.join(linked.select("section_id").distinct(), "section_id", "left_anti")
    return linked.select("section_id", "code_id", F.lit("link").alias("origin")).unionByName(rest.select("section_id", "code_id", F.lit("similar").alias("origin")))


def payloads(pairs: DataFrame, anchors: DataFrame, *, batch: int = 20, lanes: int = 64, doc_chars: int = 1500, code_chars: int = 2000) -> DataFrame:
    """``batch_no, payload``: pairs in batches, as JSON with both texts cut to length. Pairs are dealt by hash into ``lanes`` that
    are numbered on their own, so no task sees them all; a pair's id is its lane and number. Batches but the last of each
    lane are full."""
    lane = F.pmod(F.xxhash64("section_id", "code_id"), F.lit(lanes)).cast("int")
    n = F.row_number().over(Window.partitionBy("lane").orderBy("section_id", "code_id")) - 1
    a = anchors.select(F.col("id"), F.col("content_text"))
    numbered = pairs.select("section_id", "code_id").distinct().withColumn("lane", lane).withColumn("n", n)
    j = numbered.join(a.select(F.col("id").alias("section_id"), F.substring("content_text", 1, doc_chars).alias("doc")), "section_id").join(a.select(F.col("id").alias("code_id"), F.substring("content_text", 1, code_chars).alias("code")), "code_id")
    j = j.withColumn("item", F.struct("n", F.format_string("p_%d_%d", "lane", "n").alias("pair_id"), "section_id", "code_id", "doc", "code"))
    no = (F.floor(F.col("n") / batch) * lanes + F.col("lane")).cast("long")
    return j.groupBy(no.alias("batch_no")).agg(F.to_json(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.dropFields("n"))).alias("payload"))


def judged(responses: DataFrame, pairs: DataFrame, *, least: float = 0.7) -> DataFrame:
    """``pair_id, reason`` for every response (``pair_id, should_link, link_type, confidence``): null if it is to be applied,
    else the first rule it breaks."""
    known = pairs.select("pair_id").distinct().withColumn("_known", F.lit(True))
    reason = (
        F.when(F.col("_known").isNull(), "unknown pair")
        .when(~F.coalesce("should_link", F.lit(False)), "not to be linked")
        .when(~F.coalesce(F.col("link_type").isin(LINK_TYPES), F.lit(False)), "unknown link type")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range")
        .when(F.col("confidence") < least, "confidence too low")
    )
    return responses.join(known, "pair_id", "left").select("pair_id", reason.alias("reason"))
