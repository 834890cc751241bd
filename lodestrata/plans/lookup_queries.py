"""Queries of lookups, checks and reports, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import claims as C
from lodestrata.operators import lookup as K
from lodestrata.plans.index_queries import _DRIFT, _drift
from lodestrata.session import table
from lodestrata.sources import tables as T


def id_repair(spark: SparkSession, root: str) -> DataFrame:
    """Every anchor id with its colons written singly, and some that name nothing."""
    a = table(spark, root, "anchors")
    asked = a.select(F.regexp_replace("id", "::", ":").alias("asked")).unionByName(a.select(F.concat("id", F.lit("-gone")).alias("asked")))
    return K.repaired_ids(asked, a)


def anchor_problems(spark: SparkSession, root: str) -> DataFrame:
    return K.invalid_anchors(table(spark, root, "anchors"))


def dashboard_rows(spark: SparkSession, root: str) -> DataFrame:
    return T.dashboard(table(spark, root, "anchors"), _drift(spark, root))


def claim_documents(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors")
    c = C.extract(table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return T.json_report(C.verify(c, a.select(F.col("symbol_name").alias("name")), a.select("path")), c)


def drift_by_repo(spark: SparkSession, root: str) -> DataFrame:
    d = _drift(spark, root)
    return d.groupBy(F.substring_index("from_id", "/", 1).alias("repo")).agg(F.count("*").alias("links"), F.count_if(F.col("drift_status") != "fresh").alias("drifted"))


def chunk_versions(spark: SparkSession, root: str) -> DataFrame:
    """Line difference of an anchor's text and its first stored piece, by number of lines."""
    c = table(spark, root, "chunks").where("chunk_index = 0").groupBy("parent_id").agg(F.min_by("text", "chunk_id").alias("chunk"))
    j = table(spark, root, "anchors").select(F.col("id").alias("parent_id"), "content_text").join(c, "parent_id")
    return j.select("parent_id", F.size(F.split(K.unified_diff("content_text", "chunk"), "\n")).alias("diff_lines"))


QUERIES = {f.__name__: f for f in (id_repair, anchor_problems, dashboard_rows, claim_documents, drift_by_repo, chunk_versions)}

_SINGLE = "replace(id, '::', ':')"
SQL = {
    "id_repair": f"""WITH a AS (SELECT DISTINCT {_SINGLE} AS asked FROM anchors UNION SELECT id || '-gone' FROM anchors),
f AS (SELECT asked, unnest([0, 1, 2, 3]) AS n, unnest([asked, replace(asked, '::', ':'), regexp_replace(replace(asked, '::', ':'), '^([^:]*):', '\\1::'),
  split_part(asked, ':', 1) || regexp_replace(substr(asked, length(split_part(asked, ':', 1)) + 1), ':+', '::', 'g')]) AS id FROM a)
SELECT a.asked, h.id FROM a LEFT JOIN (SELECT asked, arg_min(id, n) AS id FROM f WHERE id IN (SELECT id FROM anchors) GROUP BY asked) h ON h.asked = a.asked""",
    "anchor_problems": """SELECT id, list_filter([CASE WHEN path IS NULL OR regexp_matches(path, '^(/|[A-Za-z]:)|\\\\') THEN 'path' END,
  CASE WHEN anchor_type <> 'code' AND (closure_hash IS NOT NULL OR transitive_hash_status IS NOT NULL) THEN 'closure on other than code' END], lambda x: x IS NOT NULL) AS problems FROM anchors WHERE len(problems) > 0""",
    "drift_by_repo": f"SELECT split_part(from_id, '/', 1) AS repo, count(*) AS links, count(*) FILTER (WHERE drift_status <> 'fresh') AS drifted FROM {_DRIFT} GROUP BY 1",
}
