"""Queries of claims and their verification, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import claims as C
from lodestrata.operators import verifiers as VR
from lodestrata.plans.index_queries import _LINES, _claims
from lodestrata.session import table

QUERIES: dict = {}


def _sql(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CONF = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CONFIDENCE.items())
_NOISY = rf"""(lower(s) IN {_sql(C.SYMBOL_NOISE)} OR (length(s) < 6 AND s = lower(s) AND NOT contains(s, '_') AND NOT contains(s, '.')) OR regexp_matches(s, {_re(C.FILENAME)}) OR (s = lower(s) AND NOT contains(s, '_') AND regexp_matches(s, '(ing|ed)$')))"""
_CLAIMS = rf"""(WITH b AS (SELECT doc_id AS doc, n AS line_no, line, inside, NOT inside AND regexp_matches(line, '^#{{1,6}}\s+\S') AS head FROM {_LINES}),
  s AS (SELECT *, coalesce(last_value(CASE WHEN head THEN trim(regexp_replace(line, '^#{{1,6}}\s+', '')) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM b),
  l AS (SELECT doc, line_no, line, section FROM s WHERE NOT inside AND NOT head AND NOT regexp_matches(line, '^\s*(?:$|<!--)')),
  x AS (SELECT *,
    list_filter(regexp_extract_all(line, {_re(C.BACKTICK)}, 1), lambda s: length(s) >= 3 AND NOT (upper(s) = s AND lower(s) <> s) AND NOT {_NOISY} AND NOT list_contains(regexp_extract_all(line, {_re(r"(?:=|:|set to|value)\s*" + C.BACKTICK)}, 1), s))[1] AS sym,
    nullif(replace(regexp_extract(line, {_re(C.DEFAULT)}, 1), ',', ''), '') AS num,
    list_filter(regexp_extract_all(line, {_re(C.COUNT)}, 0), lambda c: regexp_extract(c, '^(\d+)', 1)::DOUBLE > 1)[1] AS cnt,
    list_filter(regexp_extract_all(line, {_re(C.ENVVAR)}, 1), lambda v: length(v) >= 4 AND v NOT IN {_sql(C.ENVVAR_NOISE)} AND (contains(line, '`' || v || '`') OR regexp_matches(lower(line), 'env|variable|inject|set|export')))[1] AS env,
    nullif(regexp_extract(line, {_re(C.ROUTE)}, 1), '') AS route, nullif(regexp_extract(line, {_re(C.FILE)}, 1), '') AS file, lower(nullif(regexp_extract(line, {_re(C.UNIVERSAL)}, 1), '')) AS uni FROM l),
  k AS (SELECT *, CASE WHEN sym IS NOT NULL THEN 'symbol_exists' WHEN num IS NOT NULL THEN 'numeric_value' WHEN cnt IS NOT NULL THEN 'enum_count' WHEN env IS NOT NULL THEN 'env_var_name' WHEN route IS NOT NULL THEN 'route_path' WHEN file IS NOT NULL THEN 'file_path' WHEN uni IS NOT NULL THEN 'coverage_assertion' END AS claim_type FROM x)
  SELECT doc, line_no::INT AS line_no, line, section, claim_type, coalesce(sym, num, cnt, env, route, file, uni) AS subject, 'claim_' || substr(sha256(doc || ':' || line_no || ':' || trim(line)), 1, 16) AS claim_id, (CASE claim_type {_CONF} END)::DOUBLE AS confidence
  FROM k WHERE claim_type IS NOT NULL)"""
_NAMES = r"(SELECT DISTINCT symbol_name AS name, regexp_extract(regexp_replace(symbol_name, '\(\)$', ''), '([^.]+)$', 1) AS last FROM anchors WHERE symbol_name IS NOT NULL)"
_FOLDERS = "(SELECT DISTINCT list_aggregate(p[1:i], 'string_agg', '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT string_split(path, '/') AS p FROM anchors WHERE path IS NOT NULL)))"
_SYMBOLS_AND_FILES = rf"""SELECT claim_id, claim_type, CASE WHEN step < 4 THEN 'confirmed' ELSE 'contradicted' END AS verdict, CASE step WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM (
    SELECT claim_id, claim_type, CASE WHEN s IN (SELECT name FROM {_NAMES}) THEN 1 WHEN l IN (SELECT last FROM {_NAMES}) THEN 2 WHEN lower(l) IN (SELECT lower(last) FROM {_NAMES}) THEN 3 ELSE 4 END AS step
    FROM (SELECT claim_id, claim_type, regexp_replace(subject, '\(\)$', '') AS s, regexp_extract(regexp_replace(subject, '\(\)$', ''), '([^.]+)$', 1) AS l FROM c WHERE claim_type = 'symbol_exists'))
  UNION ALL SELECT claim_id, claim_type, CASE WHEN f IN (FROM {_FOLDERS}) THEN 'confirmed' ELSE 'contradicted' END, CASE WHEN f IN (FROM {_FOLDERS}) THEN 1.0 ELSE 0.95 END FROM (SELECT *, regexp_replace(replace(subject, '\', '/'), '/+$', '') AS f FROM c WHERE claim_type = 'file_path')"""
_VERDICTS = rf"""(WITH c AS {_CLAIMS} {_SYMBOLS_AND_FILES}
  UNION ALL SELECT claim_id, claim_type, 'unverifiable', 0.0 FROM c WHERE claim_type NOT IN ('symbol_exists', 'file_path'))"""
_STRINGS = "(SELECT DISTINCT path, unnest(list_distinct(regexp_extract_all(content_text, '[\"'']([A-Za-z][\\w.\\-/]*)[\"'']', 1))) AS value FROM anchors WHERE anchor_type = 'code')"
_ROUTES = "(SELECT DISTINCT trim(regexp_replace(unnest(regexp_extract_all(content_text, '[\"''](/(?:api|ws)/v\\d+/[^\\s\"'']+)[\"'']', 1)), '[.,;:)]+$', ''), '/') AS r FROM anchors WHERE anchor_type = 'code')"
_ALL_VERDICTS = rf"""(WITH c AS {_CLAIMS}, st AS {_STRINGS}, w AS (SELECT DISTINCT value FROM st WHERE NOT (starts_with(path, 'docs/') OR ends_with(path, '.md'))), rt AS {_ROUTES},
  pf AS (SELECT DISTINCT list_aggregate(p[1:i], 'string_agg', '_') AS k FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(value, '_') AS p FROM w)))
  {_SYMBOLS_AND_FILES}
  UNION ALL SELECT claim_id, claim_type, CASE WHEN hit THEN 'confirmed' ELSE 'unverifiable' END, CASE WHEN hit THEN 0.7 ELSE 0.3 END FROM (SELECT *, (CASE WHEN subject::DOUBLE = floor(subject::DOUBLE) THEN CAST(subject::DOUBLE::BIGINT AS VARCHAR) ELSE subject END) IN (SELECT value FROM st) AS hit FROM c WHERE claim_type = 'numeric_value')
  UNION ALL SELECT claim_id, claim_type, 'unverifiable', 0.3 FROM c WHERE claim_type = 'enum_count'
  UNION ALL SELECT claim_id, claim_type, CASE WHEN step IN (1, 2, 3) THEN 'confirmed' WHEN step = 4 THEN 'stale_target' ELSE 'contradicted' END, CASE step WHEN 1 THEN 0.5 WHEN 2 THEN 0.9 WHEN 3 THEN 0.75 WHEN 4 THEN 0.7 ELSE 0.6 END FROM (
    SELECT *, CASE WHEN subject IN {_sql(VR.KNOWN_TERMS)} THEN 1 WHEN subject IN (FROM w) THEN 2 WHEN regexp_replace(subject, '_+$', '') IN (FROM pf) THEN 3 WHEN upper(substr(subject, 1, 8)) IN (SELECT upper(substr(value, 1, 8)) FROM w) THEN 4 ELSE 5 END AS step FROM c WHERE claim_type = 'env_var_name')
  UNION ALL SELECT claim_id, claim_type, CASE WHEN hit THEN 'confirmed' ELSE 'contradicted' END, CASE WHEN hit THEN 0.9 ELSE 0.7 END FROM (
    SELECT *, EXISTS (SELECT 1 FROM rt WHERE r = p OR ends_with(r, '/' || p) OR ends_with(p, '/' || r)) AS hit FROM (SELECT *, trim(regexp_replace(subject, '[.,;:)]+$', ''), '/') AS p FROM c WHERE claim_type = 'route_path'))
  UNION ALL SELECT claim_id, claim_type, 'unverifiable', 0.0 FROM c WHERE claim_type = 'coverage_assertion')"""
_TOTALS = "count(*) AS total, count(*) FILTER (WHERE verdict = 'confirmed') AS confirmed, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted, count(*) FILTER (WHERE verdict = 'unverifiable') AS unverifiable"
_OPEN = f"(SELECT v.*, k.doc, k.line_no, k.subject FROM {_VERDICTS} v JOIN {_CLAIMS} k USING (claim_id) WHERE verdict <> 'confirmed')"


def claims_by_type(spark: SparkSession, root: str) -> DataFrame:
    """Claims of each type and the documents they stand in, the most frequent first."""
    return _claims(spark, root).groupBy("claim_type").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs")).orderBy(F.desc("n"), "claim_type")


def ordered_claims(spark: SparkSession, root: str) -> DataFrame:
    """Claims with their place in their document."""
    from pyspark.sql import Window

    c = _claims(spark, root)
    return c.select("doc", "claim_id", F.row_number().over(Window.partitionBy("doc").orderBy("line_no")).alias("place"))


def claim_summary(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the Markdown summary."""
    from lodestrata.sources.files import summary_table

    a = table(spark, root, "anchors")
    return summary_table(C.verify(_claims(spark, root), a.select(F.col("symbol_name").alias("name")), a.select("path")))


def claim_evidence(spark: SparkSession, root: str) -> DataFrame:
    """The first files that hold a claim's word in quotes."""
    a = table(spark, root, "anchors").where("anchor_type = 'code'")
    repo = VR.repository_index(a.select("path", F.col("content_text").alias("text")))
    return VR.evidence(_claims(spark, root), repo)


QUERIES = {f.__name__: f for f in (claims_by_type, ordered_claims, claim_summary, claim_evidence)}

SQL = {
    "claims": f"SELECT * FROM {_CLAIMS}",
    "claims_by_type": f"SELECT claim_type, count(*) AS n, count(DISTINCT doc) AS docs FROM {_CLAIMS} GROUP BY claim_type",
    "ordered_claims": f"SELECT doc, claim_id, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS place FROM {_CLAIMS}",
    "claim_report": f"SELECT {_TOTALS}, coalesce(round(count(*) FILTER (WHERE verdict = 'confirmed') / nullif(count(*) FILTER (WHERE verdict NOT IN ('unverifiable', 'error')), 0), 6), 0.0)::DOUBLE AS pass_rate FROM {_VERDICTS}",
    "claim_annotations": rf"SELECT claim_id, '::' || CASE WHEN verdict = 'contradicted' THEN 'error' ELSE 'warning' END || ' file=' || doc || ',line=' || line_no || '::' || verdict || ' ' || regexp_replace(subject, '\s+', ' ', 'g') AS annotation FROM {_OPEN}",
    "claim_sarif": f"""SELECT claim_id, 'claims/' || claim_type AS rule, '{{"ruleId":"claims/' || claim_type || '","level":"' || CASE WHEN verdict = 'contradicted' THEN 'error' WHEN verdict IN ('incomplete', 'stale_target') THEN 'warning' ELSE 'note' END
      || '","message":{{"text":"' || subject || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || doc || '"}},"region":{{"startLine":' || line_no || '}}}}}}]}}' AS result FROM {_OPEN}""",
    "claim_summary": f"SELECT claim_type, verdict, '| ' || claim_type || ' | ' || verdict || ' | ' || count(*) || ' |' AS row FROM {_VERDICTS} GROUP BY claim_type, verdict",
    "claim_verdicts": f"SELECT * FROM {_ALL_VERDICTS}",
    "claim_documents": f"""SELECT doc, '[' || string_agg('{{"line_no":' || line_no || ',"claim_id":"' || claim_id || '","claim_type":"' || claim_type || '","subject":"' || subject || '","verdict":"' || verdict || '","confidence":' || confidence || '}}', ',' ORDER BY line_no, claim_id) || ']' AS report FROM {_OPEN} GROUP BY doc""",
    "claim_evidence": rf"SELECT claim_id, place, path FROM (SELECT claim_id, regexp_replace(subject, '\(\)$', '') AS value FROM {_CLAIMS}) JOIN (SELECT value, path, row_number() OVER (PARTITION BY value ORDER BY path) AS place FROM {_STRINGS}) USING (value) WHERE place <= 5",
}
