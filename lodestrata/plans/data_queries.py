"""Queries of the general training-data operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import change_feed, snapshot_diff
from lodestrata.session import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_diff.index_changes(table(spark, root, "index_metadata"), table(spark, root, "anchor_snapshots"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    feed = table(spark, root, "link_records").select("layer", "op", "link_id", "event_id", "ts", "received_at", "supersedes")
    return change_feed.current_links(feed).select("link_id", "event_id")


def p4_current_links(spark: SparkSession, root: str) -> DataFrame:
    """The whole current records; which delivery of an event is shown (layer, received_at) is left out."""
    out = change_feed.current_links(table(spark, root, "link_records"))
    return out.select("link_id", "event_id", "ts", "from_id", "from_type", "to_id", "to_type", "link_type", "from_content_hash", "to_content_hash", "commit_sha", "supersedes", "created_by")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_current_links": p4_current_links}

_RUN_CTE = """
WITH runs AS (
  SELECT index_id, repo, indexed_branch, updated_at,
         lag(index_id) OVER (PARTITION BY repo, indexed_branch ORDER BY updated_at, index_id) AS prev
  FROM (SELECT DISTINCT index_id, repo, indexed_branch, updated_at FROM index_metadata WHERE indexed_file_manifest IS NOT NULL)),
items AS (
  SELECT 'file' AS grain, index_id, regexp_replace(replace(k, '\\', '/'), '^(\\./)+', '') AS item_key, lower(right(trim(v), 64)) AS h
  FROM (SELECT index_id, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v
        FROM (SELECT DISTINCT index_id, CAST(CAST(indexed_file_manifest AS JSON) AS MAP(VARCHAR, VARCHAR)) AS m
              FROM index_metadata WHERE indexed_file_manifest IS NOT NULL))
  UNION ALL
  SELECT 'anchor', index_id, anchor_id, arg_max(lower(right(trim(content_hash), 64)), written_at)
  FROM anchor_snapshots GROUP BY index_id, anchor_id),
later AS (SELECT i.grain, r.index_id, i.item_key, i.h FROM items i JOIN runs r ON i.index_id = r.index_id WHERE r.prev IS NOT NULL),
earlier AS (SELECT i.grain, r.index_id, i.item_key, i.h FROM items i JOIN runs r ON i.index_id = r.prev)
"""

_CURRENT_CTE = """
WITH rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at, layer) AS n
                            FROM link_records WHERE event_id IS NOT NULL) WHERE n = 1),
open AS (SELECT r.*, row_number() OVER (PARTITION BY link_id ORDER BY ts DESC, event_id DESC) AS k FROM rec r
         WHERE NOT EXISTS (SELECT 1 FROM rec s WHERE s.link_id = r.link_id AND s.supersedes = r.event_id AND s.event_id <> r.event_id))
"""

SQL = {
    "p1_found": _RUN_CTE
    + """
SELECT index_id, grain, item_key,
       CASE WHEN e.h IS NULL THEN 'added' WHEN l.h IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM later l FULL OUTER JOIN earlier e USING (grain, index_id, item_key)
WHERE l.h IS DISTINCT FROM e.h
""",
    "p4_found": _CURRENT_CTE + "SELECT link_id, event_id FROM open WHERE k = 1 AND op = 'upsert'",
    "p4_current_links": _CURRENT_CTE
    + """SELECT link_id, event_id, ts, from_id, from_type, to_id, to_type, link_type, from_content_hash, to_content_hash,
       commit_sha, supersedes, created_by FROM open WHERE k = 1 AND op = 'upsert'""",
}
