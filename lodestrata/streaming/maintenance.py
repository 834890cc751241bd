"""Streaming forms of the incremental operators. The data has no lateness rule of its own; the watermark is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.change_feed import LINK_FEED, apply_changes


def bursts(events: DataFrame, *, key: str, at: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Debounced file events: one row a burst, once ``gap`` and the watermark have passed."""
    s = events.withWatermark(at, late).groupBy(F.col(key), F.session_window(at, gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n")


def windows(events: DataFrame, *, key: str, at: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of a key in tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def once(events: DataFrame, *, token: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each token once within the watermark: idempotent writes."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([token])


def state_after(spark: SparkSession, state_path: Callable[[int], str], n: int) -> DataFrame:
    """All records kept up to a batch."""
    return spark.read.parquet(*[state_path(i) for i in range(n + 1)])


def keep_links(feed: DataFrame, state_path: Callable[[int], str], checkpoint: str):
    """Runs a feed of link records into tables of the records that each batch brought for the first time, whose union
    (``state_after``) is the deduplicated log; ``state_path(batch)`` names the table of a batch, so that a batch repeated after a
    failure writes the same table again. Of a record delivered again the delivery received first is kept within a batch, as in
    the batch operator, and the earlier batch's otherwise. Earlier tables are only read for their event ids."""

    def merge(batch: DataFrame, n: int) -> None:
        order = [F.col(c).asc_nulls_last() for c in ("received_at", "layer") if c in batch.columns]
        w = Window.partitionBy("event_id").orderBy(*(order or [F.lit(0)]))
        new = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        if n > 0:
            new = new.join(state_after(batch.sparkSession, state_path, n - 1).select("event_id"), "event_id", "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(state_path(n))

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def links_after(state: DataFrame) -> DataFrame:
    return apply_changes(state, **LINK_FEED)
