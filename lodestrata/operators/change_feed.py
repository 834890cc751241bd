"""Current state of a table from a feed of inserts, updates and deletes, repeated and out of order.

The feed is read as a signed multiset of record versions: every deduplicated change adds one to the version it brings
(after-image) and takes one from the version it replaces (before-image). Multiplicities are summed together with those
of a base table; versions left with a positive sum are current. A sum doesn't depend on the order of its terms, so
late and repeated deliveries need no sorting; all three aggregations combine map-side, so no key is too hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _null_last_min(df: DataFrame, cols: list[str]) -> list:
    return [F.struct(F.col(c).isNull(), F.col(c)) for c in cols]


def deduplicate(feed: DataFrame, *, event: str, arrival: list[str]) -> DataFrame:
    """One row per event: the one that comes first by ``arrival`` (nulls last), whole rows deciding among equals. Rows
    without an event id are left out, as nothing can tell a repeat of them."""
    rest = [c for c in feed.columns if c != event and c not in arrival and feed.schema[c].dataType.typeName() not in ("map", "variant")]
    order = F.struct(*_null_last_min(feed, arrival), *_null_last_min(feed, rest))
    whole = F.struct(*[F.col(c) for c in feed.columns])
    return feed.where(F.col(event).isNotNull()).groupBy(F.col(event).alias("_event")).agg(F.min_by(whole, order).alias("_r")).select("_r.*")


def multiset(changes: DataFrame, *, key: str, event: str, replaces: str, base: DataFrame | None = None) -> DataFrame:
    """Multiplicity of every version: ``_key, _event, _n, _row`` (the version's record, null if only ever replaced).

    A change takes one from the version of the same key that it names in ``replaces``; naming itself takes nothing.
    ``base`` holds versions current before the feed, in the columns of ``changes``; a version that is in the base and
    in the feed counts once."""
    whole = F.struct(*[F.col(c) for c in changes.columns])
    after = changes.select(F.col(key).alias("_key"), F.col(event).alias("_event"), F.lit(1).alias("_sign"), whole.alias("_row"))
    if base is not None:
        after = after.unionByName(base.select(F.col(key).alias("_key"), F.col(event).alias("_event"), F.lit(1).alias("_sign"), F.struct(*[F.col(c) for c in changes.columns]).alias("_row")))
    before = changes.where(F.col(replaces).isNotNull() & (F.col(replaces) != F.col(event))).select(
        F.col(key).alias("_key"), F.col(replaces).alias("_event"), F.lit(-1).alias("_sign"), F.lit(None).cast(after.schema["_row"].dataType).alias("_row")
    )
    pos = F.sum(F.when(F.col("_sign") > 0, 1).otherwise(0))
    neg = F.sum(F.when(F.col("_sign") < 0, 1).otherwise(0))
    return after.unionByName(before).groupBy("_key", "_event").agg((F.least(pos, F.lit(1)) - neg).alias("_n"), F.first("_row", ignorenulls=True).alias("_row"))


def apply_changes(
    feed: DataFrame,
    *,
    key: str,
    event: str,
    replaces: str,
    order_by: str,
    op: str,
    delete_op: str = "delete",
    arrival: list[str] | None = None,
    base: DataFrame | None = None,
    keep_deleted: bool = False,
) -> DataFrame:
    """The current record of every key, in the columns of ``feed``.

    Rows of one ``event`` are one change. A version is current if its multiplicity is positive, that is if no other
    change of its key replaces it; of several, the greatest ``order_by`` (nulls lowest), then the greatest event id
    decides. A key whose current record is a delete is left out unless ``keep_deleted``. Keys without any positive
    version (replacements in a circle) have no current record. A null key is a key like any other; rows without an
    event id are left out. An empty feed gives the base.
    """
    changes = deduplicate(feed, event=event, arrival=arrival or [])
    current = multiset(changes, key=key, event=event, replaces=replaces, base=base).where(F.col("_n") > 0)
    rank = F.struct(F.col("_row")[order_by], F.col("_event"))
    out = current.groupBy("_key").agg(F.max_by("_row", rank).alias("_row")).select("_row.*")
    return out if keep_deleted else out.where(F.col(op).isNull() | (F.col(op) != delete_op))


LINK_FEED = {"key": "link_id", "event": "event_id", "replaces": "supersedes", "order_by": "ts", "op": "op", "arrival": ["received_at", "layer"]}


def current_links(link_records: DataFrame) -> DataFrame:
    """Current set of links, each with its whole current record."""
    return apply_changes(link_records, **LINK_FEED)
