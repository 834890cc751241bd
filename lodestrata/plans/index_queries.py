"""Queries over the index tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions import vectors as V
from lodestrata.operators import claims as C
from lodestrata.operators import drift as D
from lodestrata.operators import extraction as E
from lodestrata.operators import graph as G
from lodestrata.operators import incremental as I
from lodestrata.operators import links as L
from lodestrata.operators import retrieval as R
from lodestrata.operators import suggest as S
from lodestrata.session import table
from lodestrata.sources import files as files_

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ text and path functions

_CANON = r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n+$', chr(10))"


@query(f"SELECT doc_id, 'sha256:' || sha256({_CANON.format('text')}) AS content_hash, substr(sha256({_CANON.format('text')}), 1, 12) AS short_hash FROM documents WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return table(spark, root, "documents").where(t.isNotNull()).select("doc_id", X.content_hash(t).alias("content_hash"), X.short_hash(t).alias("short_hash"))


@query(r"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) * 7 // 5) AS tokens FROM documents WHERE text IS NOT NULL")
def approx_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where("text is not null").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


@query(
    r"""SELECT id, CASE WHEN regexp_matches(path, '\.(md|markdown|mdx)$') THEN 'markdown' WHEN regexp_matches(path, '\.(py|ts|tsx|js|jsx|go|rs|zig)$') THEN 'code' ELSE 'skip' END AS kind,
       regexp_matches(path, '(^|/)(test_[^/]+\.py|[^/]+_tests?\.py|conftest\.py|tests?/|[^/]+\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)|__tests__/|[^/]+_test\.go|[^/]+_test\.rs|[^/]+(Test|Tests|Spec)\.(java|kt))') AS is_test_path,
       CASE regexp_extract(path, '\.(\w+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'zig' THEN 'zig' END AS language,
       CASE WHEN regexp_matches(path, '^docs/spec/(.*/)?[^/]*\.md$') THEN 'spec' WHEN regexp_matches(path, '^(docs|design|notes)/.*\.md$') THEN 'doc' END AS doc_class,
       split_part(id, ':', 1) AS file
       FROM anchors"""
)
def path_functions(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("path")
    rules = [("docs/spec/**/*.md", "spec"), ("docs/*.md", "doc"), ("design/*.md", "doc"), ("notes/*.md", "doc")]
    return table(spark, root, "anchors").select("id", X.file_kind(p).alias("kind"), X.is_test_path(p).alias("is_test_path"), X.language(p).alias("language"), X.classify(p, rules).alias("doc_class"), X.endpoint_path(F.col("id")).alias("file"))


@query(
    r"""SELECT repo, count(*) FILTER (WHERE ok) AS admitted, count(*) FILTER (WHERE NOT ok) AS refused FROM (
       SELECT repo, NOT regexp_matches(path, '^tests/.*$') AND NOT is_test AND (regexp_matches(path, '\.md$') OR regexp_matches(path, '^src/')) AS ok FROM anchors) GROUP BY repo"""
)
def admission(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors")
    ok = X.admitted(F.col("path"), ["*.md", "src/**"], ["tests/**"], F.col("is_test"))
    return a.select("repo", ok.alias("ok")).groupBy("repo").agg(F.count_if("ok").alias("admitted"), F.count_if(~F.col("ok")).alias("refused"))


@query("SELECT id, array_to_string(heading_path, ' ') || chr(10) || substr(content_text, 1, 800) AS overview FROM anchors WHERE heading_path IS NOT NULL AND content_text IS NOT NULL")
def overview_text(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "anchors").where("heading_path is not null and content_text is not null").select("id", X.overview(F.col("heading_path"), F.col("content_text")).alias("overview"))


@query(r"SELECT id, CASE WHEN len(w) > 35 THEN array_to_string(w[1:35], ' ') ELSE content_text END AS preview, len(w) > 35 AS truncated FROM (SELECT id, content_text, regexp_extract_all(content_text, '[^ \t\n\r\f\v]+') AS w FROM anchors WHERE content_text IS NOT NULL)")
def previews(spark: SparkSession, root: str) -> DataFrame:
    shown, cut = X.preview(F.col("content_text"), 50)
    return table(spark, root, "anchors").where("content_text is not null").select("id", shown.alias("preview"), cut.alias("truncated"))


_SNAKE = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[-_]+', '_', 'g'), '_')"


@query(f"SELECT DISTINCT symbol_name, {_SNAKE.format('symbol_name')} AS snake FROM anchors WHERE symbol_name IS NOT NULL")
def symbol_forms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "anchors").where("symbol_name is not null").select("symbol_name", X.snake(F.col("symbol_name")).alias("snake")).distinct()


@query(
    r"""SELECT title, CASE WHEN s = '' THEN 'section-' || substr(sha256(title), 1, 8) ELSE s END AS slug FROM (
       SELECT DISTINCT h AS title, trim(regexp_replace(lower(regexp_replace(h, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT unnest(heading_path) AS h FROM anchors))"""
)
def heading_slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "anchors").select(F.explode("heading_path").alias("title")).distinct().select("title", X.ascii_slug(F.col("title")).alias("slug"))


@query("SELECT doc_id, len(string_split_regex(text, '\\n[ \\t]*\\n')) AS paragraphs, len(regexp_extract_all(text, '[.!?]\\s+')) + 1 AS sentences FROM documents WHERE text IS NOT NULL")
def paragraphs_and_sentences(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return table(spark, root, "documents").where(t.isNotNull()).select("doc_id", F.size(F.split(t, r"\n[ \t]*\n")).alias("paragraphs"), F.size(X.sentences(t)).alias("sentences"))


# ------------------------------------------------------------------ vectors

_V = "SELECT chunk_id, embedding::DOUBLE[] AS e FROM (SELECT DISTINCT chunk_id, embedding FROM chunks_vec WHERE len(embedding) = 64)"


@query(f"SELECT chunk_id, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM ({_V})")
def vector_norms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks_vec").where(F.size("embedding") == 64).distinct().select("chunk_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(
    f"""WITH v AS ({_V}), q AS (SELECT chunk_id AS query_id, e AS qe FROM v WHERE chunk_id % 20 = 0)
    SELECT query_id, chunk_id, distance, rank FROM (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
      FROM (SELECT query_id, chunk_id, round(list_distance(e, qe), 6) AS distance FROM v, q)) WHERE rank <= 10"""
)
def nearest_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The stated query set (every id divisible by 20) against all vectors."""
    v = table(spark, root, "chunks_vec").where(F.size("embedding") == 64).distinct()
    q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vec"))
    return R.nearest_in_blocks(v, q, 10, dim=64)


@query("SELECT doc_id, list_transform(range(0, 8), lambda i: round(('0x' || substr(sha256(text || CAST(i AS VARCHAR)), 1, 2))::INT / 127.5 - 1, 9)) AS vec FROM documents WHERE text IS NOT NULL")
def stub_embeddings(spark: SparkSession, root: str) -> DataFrame:
    v = F.transform(V.stub_embedding(F.col("text"), 8), lambda x: F.round(x, 9))
    return table(spark, root, "documents").where("text is not null").select("doc_id", v.alias("vec"))


# ------------------------------------------------------------------ links

_LOG = "(SELECT *, row_number() OVER (PARTITION BY layer ORDER BY received_at, event_id) AS pos FROM link_records)"
_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY layer DESC, pos DESC) AS n FROM {_LOG}) WHERE n = 1)"
_ACTIVE = f"(SELECT * FROM {_LAST} WHERE op = 'upsert')"


def _log(spark: SparkSession, root: str) -> DataFrame:
    return L.positioned(table(spark, root, "link_records"))


@query(f"SELECT link_id, event_id, from_id, to_id, link_type, layer FROM {_ACTIVE}")
def replay(spark: SparkSession, root: str) -> DataFrame:
    return L.active(_log(spark, root)).select("link_id", "event_id", "from_id", "to_id", "link_type", "layer")


_CONFLICTS = """(WITH r AS (SELECT DISTINCT event_id, supersedes, link_id, op FROM link_records)
  SELECT link_id FROM r WHERE op = 'upsert' AND supersedes IN (SELECT supersedes FROM r WHERE op = 'upsert' AND supersedes IS NOT NULL GROUP BY supersedes HAVING count(*) >= 2)
  UNION SELECT link_id FROM r WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r k WHERE k.event_id = r.supersedes))"""


@query(f"SELECT link_id FROM {_CONFLICTS}")
def conflicts(spark: SparkSession, root: str) -> DataFrame:
    return L.conflicts(_log(spark, root))


@query(
    """WITH o AS (SELECT * FROM link_records WHERE layer = 1), p AS (SELECT DISTINCT event_id FROM o WHERE op = 'upsert' AND created_by IS NOT NULL)
    SELECT layer, count(*) AS n FROM (SELECT 0 AS layer FROM link_records WHERE layer = 0
      UNION ALL SELECT 0 FROM o WHERE event_id IN (FROM p) AND event_id NOT IN (SELECT event_id FROM link_records WHERE layer = 0)
      UNION ALL SELECT 1 FROM o WHERE event_id NOT IN (FROM p)) GROUP BY layer"""
)
def promotion(spark: SparkSession, root: str) -> DataFrame:
    log = _log(spark, root)
    return L.promote(log, log.where("layer = 1 and op = 'upsert' and created_by is not null")).groupBy("layer").agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, list_filter([CASE WHEN op = 'upsert' AND from_id IS NULL THEN 'upsert without from_id' END, CASE WHEN op = 'upsert' AND to_id IS NULL THEN 'upsert without to_id' END,
      CASE WHEN op = 'upsert' AND from_type IS NULL THEN 'upsert without from_type' END, CASE WHEN op = 'upsert' AND to_type IS NULL THEN 'upsert without to_type' END, CASE WHEN op = 'upsert' AND link_type IS NULL THEN 'upsert without link_type' END,
      CASE WHEN op = 'delete' AND from_id IS NOT NULL THEN 'delete with from_id' END, CASE WHEN op = 'delete' AND to_id IS NOT NULL THEN 'delete with to_id' END, CASE WHEN op = 'delete' AND from_type IS NOT NULL THEN 'delete with from_type' END,
      CASE WHEN op = 'delete' AND to_type IS NOT NULL THEN 'delete with to_type' END, CASE WHEN op = 'delete' AND link_type IS NOT NULL THEN 'delete with link_type' END, CASE WHEN op = 'delete' AND supersedes IS NULL THEN 'delete without supersedes' END,
      CASE WHEN link_id IS NULL OR link_id NOT LIKE 'lnk_%' THEN 'link_id' END, CASE WHEN event_id IS NULL OR event_id NOT LIKE 'evt_%' THEN 'event_id' END], lambda x: x IS NOT NULL) AS violations
    FROM link_records WHERE len(violations) > 0"""
)
def record_shapes(spark: SparkSession, root: str) -> DataFrame:
    return L.shape_violations(table(spark, root, "link_records"))


@query()
def append_validation(spark: SparkSession, root: str) -> DataFrame:
    """The overlay's records as candidates for the baseline, folded link by link."""
    log = _log(spark, root)
    return L.validate_appends(log.where("layer = 0"), log.where("layer = 1").dropDuplicates(["event_id"]))


@query(
    f"""SELECT a.link_id, a.from_id, a.to_id, a.link_type, u.n_records FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, link_type ORDER BY layer DESC, received_at DESC, event_id DESC) AS k FROM {_ACTIVE}) WHERE k = 1) a
    JOIN (SELECT from_id, to_id, link_type, count(*) AS n_records FROM link_records WHERE op = 'upsert' GROUP BY ALL) u USING (from_id, to_id, link_type)"""
)
def latest_links(spark: SparkSession, root: str) -> DataFrame:
    return L.latest_logical(_log(spark, root)).select("link_id", "from_id", "to_id", "link_type", "n_records")


_NEAR = f"(SELECT from_id AS anchor_id, 'outgoing' AS direction, link_id, to_id AS other_id, link_type, layer, received_at, event_id FROM {_ACTIVE} UNION ALL SELECT to_id, 'incoming', link_id, from_id, link_type, layer, received_at, event_id FROM {_ACTIVE})"


@query(
    f"SELECT anchor_id, direction, link_id, other_id, link_type, place FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, direction ORDER BY layer, received_at, event_id) AS place FROM {_NEAR} WHERE anchor_id IN (SELECT id FROM anchors)) WHERE place <= 5"
)
def link_caps(spark: SparkSession, root: str) -> DataFrame:
    return L.capped_links(L.links_of(_log(spark, root), table(spark, root, "anchors")))


@query(
    f"""SELECT link_id FROM {_ACTIVE} WHERE from_id = to_id OR coalesce(NOT (
      (link_type = 'implements' AND from_type = 'code' AND to_type = 'section') OR (link_type = 'tests' AND from_type = 'code' AND to_type IN ('code', 'section')) OR (link_type = 'examples' AND from_type = 'code_in_doc' AND to_type IN ('code', 'section'))
      OR (link_type = 'derives-from' AND from_type = 'section' AND to_type = 'section') OR (link_type IN ('mirrors', 'references') AND from_type IN ('section', 'code', 'code_in_doc') AND to_type IN ('section', 'code', 'code_in_doc'))), true)"""
)
def off_direction(spark: SparkSession, root: str) -> DataFrame:
    return L.off_direction(L.active(_log(spark, root))).select("link_id")


@query(f"SELECT link_id, event_id AS supersedes, 'evt_' || substr(sha256('delete:' || event_id), 1, 32) AS event_id FROM {_ACTIVE} WHERE link_type = 'references'")
def unlink(spark: SparkSession, root: str) -> DataFrame:
    log = _log(spark, root)
    return L.tombstones(log, L.active(log).where("link_type = 'references'"), at=F.lit(None).cast("timestamp"), by=F.lit(None).cast("string")).select("link_id", "event_id", "supersedes")


@query(
    f"""SELECT l.from_id, l.to_id, l.link_type, l.link_id, l.event_id AS supersedes, f.content_hash AS from_content_hash, t.content_hash AS to_content_hash
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, link_type ORDER BY layer DESC, received_at DESC, event_id DESC) AS k FROM {_ACTIVE}) WHERE k = 1) l
    JOIN anchors f ON f.id = l.from_id JOIN anchors t ON t.id = l.to_id WHERE l.from_id <> l.to_id"""
)
def refreshed_links(spark: SparkSession, root: str) -> DataFrame:
    """Active links proposed again with the current hashes of both ends."""
    log = _log(spark, root)
    out = L.proposals(log, L.active(log), table(spark, root, "anchors"), at=F.lit(None).cast("timestamp"), by=F.lit(None).cast("string"))
    return out.select("from_id", "to_id", "link_type", "link_id", "supersedes", "from_content_hash", "to_content_hash")


@query(f"SELECT count(*) AS records, count(DISTINCT link_id) AS links, count(DISTINCT event_id) AS events, count(DISTINCT created_by) AS authors, bool_or(created_by IS NULL) AS some_unsigned, (SELECT count(*) FROM {_CONFLICTS}) AS conflicts FROM link_records")
def log_status(spark: SparkSession, root: str) -> DataFrame:
    log = _log(spark, root)
    one = log.agg(F.count("*").alias("records"), F.count_distinct("link_id").alias("links"), F.count_distinct("event_id").alias("events"), F.count_distinct("created_by").alias("authors"), F.bool_or(F.col("created_by").isNull()).alias("some_unsigned"))
    return one.crossJoin(L.conflicts(log).agg(F.count("*").alias("conflicts")))  # one row each


# ------------------------------------------------------------------ drift

_BASE = "(SELECT * FROM link_records WHERE layer = 0)"
_BACTIVE = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY received_at DESC, event_id DESC) AS n FROM {_BASE}) WHERE n = 1 AND op = 'upsert')"
_BCONF = _CONFLICTS.replace("link_records", _BASE)
_COS = "(list_inner_product(f.overview_embedding::DOUBLE[], t.overview_embedding::DOUBLE[]) / (sqrt(list_inner_product(f.overview_embedding::DOUBLE[], f.overview_embedding::DOUBLE[])) * sqrt(list_inner_product(t.overview_embedding::DOUBLE[], t.overview_embedding::DOUBLE[]))))"
_CH = "({0}.content_hash IS DISTINCT FROM coalesce(l.prior_{1}_content_hash, l.{1}_content_hash) OR coalesce(({0}.anchor_type <> 'code' OR coalesce({0}.transitive_hash_status IN ('complete', 'partial'), false)) AND l.{1}_closure_hash <> {0}.closure_hash, false))"
_A, _B = _CH.format("f", "from"), _CH.format("t", "to")
_LANG = "CASE regexp_extract({0}.path, '\\.(\\w+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'zig' THEN 'zig' END"
_DRIFT = f"""(SELECT link_id, from_id, to_id, from_type, to_type, from_path, to_path, drift_status, CASE WHEN link_type = 'mirrors' AND drift_status NOT IN ('merge-conflict', 'broken-source', 'broken-target') AND fe IS NOT NULL AND te IS NOT NULL AND (fl IS NULL OR tl IS NULL OR fl = tl)
    THEN 1 - CASE WHEN len(fe) <> len(te) OR nf * nt = 0 THEN 0.0 ELSE list_inner_product(fe[1:least(len(fe), len(te))], te[1:least(len(fe), len(te))]) / (nf * nt) END > 0.25 END AS semantic_drift
  FROM (SELECT l.link_id, l.link_type, l.from_id, l.to_id, l.from_type, l.to_type, f.path AS from_path, t.path AS to_path, f.overview_embedding::DOUBLE[] AS fe, t.overview_embedding::DOUBLE[] AS te,
    sqrt(list_sum(list_transform(f.overview_embedding::DOUBLE[], lambda x: x * x))) AS nf, sqrt(list_sum(list_transform(t.overview_embedding::DOUBLE[], lambda x: x * x))) AS nt, {_LANG.format('f')} AS fl, {_LANG.format('t')} AS tl,
    CASE WHEN l.link_id IN (SELECT link_id FROM {_BCONF}) THEN 'merge-conflict' WHEN f.id IS NULL THEN 'broken-source' WHEN t.id IS NULL THEN 'broken-target'
      WHEN {_A} AND {_B} THEN 'both-changed' WHEN {_A} THEN CASE WHEN f.anchor_type = 'section' THEN 'spec-changed' ELSE 'code-changed' END
      WHEN {_B} THEN CASE WHEN t.anchor_type = 'section' THEN 'spec-changed' ELSE 'code-changed' END
      WHEN coalesce(f.anchor_type = 'code' AND f.transitive_hash_status = 'lsp_error', false) OR coalesce(t.anchor_type = 'code' AND t.transitive_hash_status = 'lsp_error', false) THEN 'drift-unknown' ELSE 'fresh' END AS drift_status
  FROM {_BACTIVE} l LEFT JOIN anchors f ON f.id = l.from_id LEFT JOIN anchors t ON t.id = l.to_id))"""


def _drift(spark: SparkSession, root: str) -> DataFrame:
    return D.evaluate_all(_log(spark, root), table(spark, root, "anchors"))


@query(f"SELECT link_id, drift_status, semantic_drift FROM {_DRIFT}")
def drift_status(spark: SparkSession, root: str) -> DataFrame:
    return _drift(spark, root).select("link_id", "drift_status", "semantic_drift")


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE s = 'merge-conflict') AS merge_conflict, count(*) FILTER (WHERE s = 'broken-source') AS broken_source, count(*) FILTER (WHERE s = 'broken-target') AS broken_target,
    count(*) FILTER (WHERE s = 'both-changed') AS both_changed, count(*) FILTER (WHERE s = 'spec-changed') AS spec_changed, count(*) FILTER (WHERE s = 'code-changed') AS code_changed, count(*) FILTER (WHERE s = 'drift-unknown') AS drift_unknown,
    count(*) FILTER (WHERE s = 'fresh') AS fresh, count(*) FILTER (WHERE m) AS semantic, round(greatest(0, least(100, 100 * (1 - sum(w + CASE WHEN m THEN 0.2 ELSE 0 END) / count(*)))), 6)::DOUBLE AS drift_score
    FROM (SELECT drift_status AS s, semantic_drift AS m, (CASE WHEN drift_status IN ('merge-conflict', 'broken-source', 'broken-target') THEN 1.0 WHEN drift_status = 'both-changed' THEN 0.5 WHEN drift_status = 'fresh' THEN 0.0 ELSE 0.3 END)::DOUBLE AS w FROM {_DRIFT})"""
)
def drift_summary(spark: SparkSession, root: str) -> DataFrame:
    return D.summary(_drift(spark, root))


@query(f"SELECT link_id, drift_status FROM {_DRIFT} WHERE drift_status IN ('broken-source', 'spec-changed', 'code-changed') AND (from_id LIKE 'polar-mono/%' OR from_path LIKE 'polar-mono/%')")
def find_drift(spark: SparkSession, root: str) -> DataFrame:
    return D.in_scope(_drift(spark, root), prefix="polar-mono/", statuses=["broken-source", "spec-changed", "code-changed"]).select("link_id", "drift_status")


@query(f"WITH c AS (SELECT DISTINCT split_part(id, ':', 1) AS p FROM anchors WHERE is_test) SELECT link_id, drift_status FROM {_DRIFT} WHERE split_part(from_id, ':', 1) IN (FROM c) OR split_part(to_id, ':', 1) IN (FROM c)")
def drift_of_changed_files(spark: SparkSession, root: str) -> DataFrame:
    changed = table(spark, root, "anchors").where("is_test").select(X.endpoint_path(F.col("id")).alias("path"))
    return D.in_scope(_drift(spark, root), changed=changed).select("link_id", "drift_status")


@query(
    f"""SELECT anchor_id, ['merge-conflict', 'broken-source', 'broken-target', 'both-changed', 'spec-changed', 'code-changed', 'drift-unknown', 'fresh'][min(r)] AS drift_status
    FROM (SELECT unnest([from_id, to_id]) AS anchor_id, list_position(['merge-conflict', 'broken-source', 'broken-target', 'both-changed', 'spec-changed', 'code-changed', 'drift-unknown', 'fresh'], drift_status) AS r FROM {_DRIFT}) GROUP BY anchor_id"""
)
def drift_winners(spark: SparkSession, root: str) -> DataFrame:
    return D.winners(_drift(spark, root))


@query(
    f"""WITH e AS (SELECT from_id AS id FROM {_ACTIVE} WHERE from_type = 'code' UNION SELECT to_id FROM {_ACTIVE} WHERE to_type = 'code')
    SELECT count(*) AS code_anchors, count(e.id) AS linked, round(100.0 * count(e.id) / count(*), 6)::DOUBLE AS coverage_score FROM anchors a LEFT JOIN e ON e.id = a.id WHERE anchor_type = 'code'"""
)
def coverage(spark: SparkSession, root: str) -> DataFrame:
    return D.coverage(L.active(_log(spark, root)), table(spark, root, "anchors"))


@query(f"SELECT id, path, length(content_text) AS n_chars FROM anchors WHERE anchor_type = 'section' AND id NOT IN (SELECT unnest([from_id, to_id]) FROM {_ACTIVE}) ORDER BY n_chars DESC, id LIMIT 25")
def uncovered_sections(spark: SparkSession, root: str) -> DataFrame:
    return D.uncovered(L.active(_log(spark, root)), table(spark, root, "anchors"))


@query(
    f"""WITH d AS {_DRIFT}, e AS (SELECT from_id AS a, to_id AS o, drift_status AS s FROM d UNION ALL SELECT to_id, from_id, drift_status FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY o, s) AS k FROM e)
    SELECT x.path, x.id AS anchor_id, count(n.a) FILTER (WHERE n.s = 'fresh') AS n_fresh, count(n.a) FILTER (WHERE n.s <> 'fresh') AS n_drifted, list_sort(list(n.o) FILTER (WHERE n.k <= 10)) AS docs
    FROM anchors x LEFT JOIN n ON n.a = x.id WHERE x.path IN (SELECT path FROM anchors WHERE is_test) GROUP BY x.path, x.id"""
)
def working_context(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors")
    return D.working_context(_drift(spark, root), a, a.where("is_test"))


@query("SELECT repo, anchor_type, count(*) AS n, count(*) FILTER (WHERE is_test) AS tests FROM anchors GROUP BY ALL")
def anchor_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "anchors").groupBy("repo", "anchor_type").agg(F.count("*").alias("n"), F.count_if("is_test").alias("tests"))


@query("SELECT regexp_extract(path, '\\.(\\w+)$', 1) AS ending, count(DISTINCT path) AS files FROM anchors GROUP BY 1")
def language_census(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "anchors").groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("ending")).agg(F.count_distinct("path").alias("files"))


# ------------------------------------------------------------------ graph


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """Active links between code anchors as calls."""
    return L.active(_log(spark, root)).where("from_type = 'code' and to_type = 'code'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


_EDGES = f"(SELECT DISTINCT from_id AS src, to_id AS dst FROM {_ACTIVE} WHERE from_type = 'code' AND to_type = 'code' AND from_id <> to_id)"
_REACH = """WITH RECURSIVE e AS MATERIALIZED {0}, r AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {1})
    SELECT root, node, min(depth) AS depth FROM r WHERE root <> node GROUP BY root, node"""


@query(_REACH.format(_EDGES, G.MAX_DEPTH))
def call_closure(spark: SparkSession, root: str) -> DataFrame:
    """Over at most ``G.MAX_DEPTH`` edges."""
    e = _edges(spark, root)
    return G.closure(e, e.select(F.col("src").alias("id")))


@query(f"WITH x AS ({_REACH.format(_EDGES, G.MAX_DEPTH)}) SELECT root, count(*) AS n_nodes, 'sha256:' || sha256(unhex(string_agg(d, '' ORDER BY d))) AS closure_hash FROM (SELECT root, lower(right(content_hash, 64)) AS d FROM x JOIN anchors a ON a.id = x.node) GROUP BY root")
def closure_hashes(spark: SparkSession, root: str) -> DataFrame:
    """Over the whole closure."""
    return G.closure_hashes(call_closure(spark, root), table(spark, root, "anchors"))


@query(f"SELECT root, CASE WHEN max(depth) >= {G.MAX_DEPTH} THEN 'partial' ELSE 'complete' END AS status FROM ({_REACH.format(_EDGES, G.MAX_DEPTH)}) GROUP BY root")
def closure_states(spark: SparkSession, root: str) -> DataFrame:
    return G.closure_states(call_closure(spark, root))


@query(f"SELECT DISTINCT dst AS root, src AS node, 1 AS depth FROM {_EDGES}")
def callers(spark: SparkSession, root: str) -> DataFrame:
    e = _edges(spark, root)
    return G.callers(e, e.select(F.col("dst").alias("id")))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, s AS (SELECT id, list_position(['complete', 'partial', 'unsupported', 'lsp_unavailable', 'lsp_error'], transitive_hash_status) AS r FROM anchors WHERE anchor_type = 'code' AND transitive_hash_status IS NOT NULL),
    w AS (SELECT id, r FROM s UNION SELECT e.src, w.r FROM w JOIN e ON e.dst = w.id JOIN s ON s.id = e.src)
    SELECT id, ['complete', 'partial', 'unsupported', 'lsp_unavailable', 'lsp_error'][max(r)] AS status FROM w GROUP BY id"""
)
def worst_status(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").where("anchor_type = 'code' and transitive_hash_status is not null")
    return G.worst_status(_edges(spark, root), a.select("id", F.col("transitive_hash_status").alias("status")))


# ------------------------------------------------------------------ retrieval

_WORDS = ["backoff manifest", "trellis", "shallow cursor", "retry lattice"]
_TERM = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_CHUNK = "(SELECT DISTINCT ON (chunk_id) chunk_id, parent_id, text FROM chunks)"
_QSQL = "(SELECT * FROM (VALUES (0, 'backoff manifest'), (1, 'trellis'), (2, 'shallow cursor'), (3, 'retry lattice')) AS t(query_id, query))"
_BM25 = f"""(WITH c AS {_CHUNK}, t AS (SELECT chunk_id, len(w) AS n, unnest(w) AS term FROM (SELECT chunk_id, {_TERM.format('text')} AS w FROM c WHERE text IS NOT NULL)), p AS (SELECT term, chunk_id, n, count(*) AS tf FROM t GROUP BY ALL),
  z AS (SELECT count(*) AS nd, avg(len({_TERM.format('text')})) AS al FROM c WHERE text IS NOT NULL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT query_id, unnest({_TERM.format('query')}) AS term FROM {_QSQL}), k AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1)
  SELECT query_id, chunk_id, round(sum(greatest(ln((nd - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / al))), 6) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN k USING (query_id), z GROUP BY query_id, chunk_id, k.k HAVING count(*) = k.k)"""


def _word_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_WORDS)), "query_id int, query string")


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").dropDuplicates(["chunk_id"])


@query(f"SELECT query_id, chunk_id, score FROM {_BM25}")
def bm25(spark: SparkSession, root: str) -> DataFrame:
    return R.bm25(table(spark, root, "chunks"), _word_queries(spark))


_BEST = f"""(SELECT query_id, parent_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank, chunk_id) AS n FROM (
  SELECT b.query_id, b.chunk_id, c.parent_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {_BM25} b JOIN {_CHUNK} c USING (chunk_id)) WHERE rank <= 200) WHERE n = 1)"""


@query(f"SELECT query_id, parent_id, chunk_id, place FROM {_BEST}")
def best_chunk_per_anchor(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks")
    return R.best_per_parent(R.top(R.bm25(c, _word_queries(spark)), 200, order=F.col("score").desc()), c)


def _search_queries(spark: SparkSession, root: str) -> DataFrame:
    """The word queries, each with the vector of a stated chunk."""
    v = table(spark, root, "chunks_vec").where(F.size("embedding") == 64).agg(F.min_by("embedding", "chunk_id").alias("vec"))
    return _word_queries(spark).crossJoin(v)  # one vector


@query(
    f"""WITH cc AS {_CHUNK}, v AS ({_V}), qv AS (SELECT e FROM v ORDER BY chunk_id LIMIT 1), sc AS (SELECT c.* FROM cc c JOIN anchors a ON a.id = c.parent_id WHERE a.anchor_type IN ('section', 'code') AND NOT a.is_test),
    nv AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS rank FROM (SELECT v.chunk_id, round(list_distance(v.e, qv.e), 6) AS d FROM v, qv) QUALIFY rank <= 200),
    bv AS (SELECT parent_id, chunk_id, row_number() OVER (ORDER BY rank, chunk_id) AS place FROM (SELECT sc.parent_id, nv.*, row_number() OVER (PARTITION BY parent_id ORDER BY rank, chunk_id) AS n FROM nv JOIN sc USING (chunk_id)) WHERE n = 1),
    nb AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {_BM25} QUALIFY rank <= 200),
    bb AS (SELECT query_id, parent_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM (SELECT sc.parent_id, nb.*, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank, chunk_id) AS n FROM nb JOIN sc USING (chunk_id)) WHERE n = 1),
    u AS (SELECT query_id, parent_id, chunk_id AS vc, NULL AS bc, 1 / (60 + place) AS s FROM bv, {_QSQL} UNION ALL SELECT query_id, parent_id, NULL, chunk_id, 1 / (60 + place) FROM bb)
    SELECT query_id, parent_id AS anchor_id, score, vec_chunk, bm25_chunk, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM (SELECT query_id, parent_id, round(sum(s), 9) AS score, max(vc) AS vec_chunk, max(bc) AS bm25_chunk FROM u GROUP BY query_id, parent_id)) WHERE rank <= 10"""
)
def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    q = _search_queries(spark, root)
    v = table(spark, root, "chunks_vec").where(F.size("embedding") == 64).distinct()
    return R.search(table(spark, root, "chunks"), v, table(spark, root, "anchors"), q, top_k=10, dim=64, types=["section", "code"], tests=False)


@query()
def search_packets(spark: SparkSession, root: str) -> DataFrame:
    return R.packets(hybrid_search(spark, root), _chunks(spark, root), table(spark, root, "anchors"))


@query(f"SELECT query_id, anchor_id FROM (SELECT DISTINCT query_id, a.id AS anchor_id, dense_rank() OVER (PARTITION BY query_id ORDER BY a.id) AS n FROM anchors a JOIN (SELECT query_id, unnest({_TERM.format('query')}) AS t FROM {_QSQL}) q ON contains(lower(concat_ws(' ', a.symbol_name, a.path)), q.t) WHERE length(q.t) >= 3) WHERE n <= 3")
def did_you_mean(spark: SparkSession, root: str) -> DataFrame:
    return R.did_you_mean(table(spark, root, "anchors"), _word_queries(spark))


# ------------------------------------------------------------------ extraction and claims

_LINES = r"""(SELECT doc_id, n, line, mark, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 OR mark AS inside FROM (SELECT doc_id, n, line, regexp_matches(line, '^[ \t]*(```|~~~)') AS mark
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL))))"""


@query(
    rf"""WITH h AS (SELECT doc_id, n, length(regexp_extract(line, '^(#+)', 1)) AS lv FROM {_LINES} WHERE NOT inside AND regexp_matches(line, '^#{{1,6}}\s+\S')), m AS (SELECT doc_id, max(n) AS last FROM {_LINES} GROUP BY doc_id)
    SELECT CAST(h.doc_id AS VARCHAR) AS doc, h.n::INT AS start_line, coalesce((SELECT min(g.n) - 1 FROM h g WHERE g.doc_id = h.doc_id AND g.n > h.n AND g.lv <= h.lv), m.last)::INT AS end_line, h.lv::INT AS level FROM h JOIN m ON m.doc_id = h.doc_id WHERE h.lv <= 4"""
)
def sections(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text")
    return E.markdown_anchors(d).where("anchor_type = 'section'").select("doc", "start_line", "end_line", "level")


@query()
def markdown_anchors(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text")
    return E.markdown_anchors(d)


@query()
def code_symbols(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").where("anchor_type = 'code'")
    return E.code_symbols(a.select("path", F.col("content_text").alias("text")))


def _claims(spark: SparkSession, root: str) -> DataFrame:
    return C.extract(table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query()
def claims(spark: SparkSession, root: str) -> DataFrame:
    return _claims(spark, root)


@query()
def claim_report(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors")
    return C.report(C.verify(_claims(spark, root), a.select(F.col("symbol_name").alias("name")), a.select("path")))


@query()
def claim_annotations(spark: SparkSession, root: str) -> DataFrame:
    a, c = table(spark, root, "anchors"), _claims(spark, root)
    return files_.annotations(C.verify(c, a.select(F.col("symbol_name").alias("name")), a.select("path")), c)


@query()
def claim_sarif(spark: SparkSession, root: str) -> DataFrame:
    a, c = table(spark, root, "anchors"), _claims(spark, root)
    return files_.sarif(C.verify(c, a.select(F.col("symbol_name").alias("name")), a.select("path")), c)


_UNIVERSAL = r"(?i)\b(every|all|each|always|never|no|none of|must always|must never)\b"


@query(rf"SELECT doc_id, count(*) AS lines_with FROM {_LINES} WHERE NOT inside AND regexp_matches(line, '{_UNIVERSAL}') GROUP BY doc_id")
def universal_lines(spark: SparkSession, root: str) -> DataFrame:
    ln = C.lines(table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return ln.where(~F.col("in_fence") & F.col("line").rlike(C.UNIVERSAL)).groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("lines_with"))


@query()
def fuzzy_symbols(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").where("symbol_name is not null")
    q = a.where("anchor_type = 'code_in_doc'").select(F.col("symbol_name").alias("query"))
    return C.fuzzy_symbols(q, a.select(F.col("symbol_name").alias("name")))


# ------------------------------------------------------------------ maintenance


@query(
    """WITH r AS (SELECT repo, index_id, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, index_id DESC) AS n FROM (SELECT DISTINCT repo, index_id, updated_at FROM index_metadata WHERE indexed_file_manifest IS NOT NULL)),
    m AS (SELECT DISTINCT index_id, regexp_replace(replace(k, '\\', '/'), '^(\\./)+', '') AS path, lower(right(trim(v), 64)) AS h FROM (SELECT index_id, unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT DISTINCT index_id, CAST(CAST(indexed_file_manifest AS JSON) AS MAP(VARCHAR, VARCHAR)) AS m FROM index_metadata WHERE indexed_file_manifest IS NOT NULL))),
    o AS (SELECT r.repo || '/' || m.path AS path, h FROM r JOIN m USING (index_id) WHERE n = 2), w AS (SELECT r.repo || '/' || m.path AS path, h FROM r JOIN m USING (index_id) WHERE n = 1)
    SELECT path, CASE WHEN o.h IS NULL THEN 'new' WHEN w.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN w USING (path) WHERE o.h IS DISTINCT FROM w.h"""
)
def manifest_diff(spark: SparkSession, root: str) -> DataFrame:
    """The last two counted runs of every repository."""
    from lodestrata.operators.snapshot_diff import counted_runs, manifest_items

    meta = table(spark, root, "index_metadata")
    w = Window.partitionBy("repo").orderBy(F.desc("updated_at"), F.desc("index_id"))
    runs = counted_runs(meta).select("repo", "index_id", "updated_at").distinct().withColumn("n", F.row_number().over(w)).where("n <= 2").select("repo", "index_id", "n")
    items = manifest_items(meta).select("index_id", "item_key", "item_hash").distinct().join(runs, "index_id").select("n", F.concat_ws("/", "repo", "item_key").alias("path"), F.col("item_hash").alias("content_hash"))
    return I.manifest_diff(items.where("n = 2"), items.where("n = 1"))


@query(
    """WITH l AS (SELECT repo, indexed_branch, indexed_git_head, config_hash, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, index_id DESC) AS n FROM (SELECT DISTINCT repo, indexed_branch, indexed_git_head, config_hash, updated_at, index_id FROM index_metadata WHERE indexed_file_manifest IS NOT NULL))
    SELECT a.repo, CASE WHEN a.indexed_git_head IS DISTINCT FROM b.indexed_git_head THEN 'head_changed' WHEN coalesce(a.indexed_branch, 'detached-' || substr(a.indexed_git_head, 1, 7)) IS DISTINCT FROM b.indexed_branch THEN 'branch_changed' WHEN a.config_hash IS DISTINCT FROM b.config_hash THEN 'config_changed' END AS reason
    FROM l a JOIN l b ON a.repo = b.repo AND a.n = 1 AND b.n = 2"""
)
def staleness(spark: SparkSession, root: str) -> DataFrame:
    """The state of the last run against the index of the run before it."""
    m = table(spark, root, "index_metadata").where("indexed_file_manifest is not null").select("repo", "indexed_branch", "indexed_git_head", "config_hash", "updated_at", "index_id").distinct()
    w = Window.partitionBy("repo").orderBy(F.desc("updated_at"), F.desc("index_id"))
    r = m.withColumn("n", F.row_number().over(w))
    now = r.where("n = 1").select("repo", F.col("indexed_branch").alias("branch"), F.col("indexed_git_head").alias("head"), "config_hash")
    was = r.where("n = 2").select("repo", "indexed_branch", F.col("indexed_git_head").alias("indexed_head"), F.col("config_hash").alias("indexed_config_hash"))
    none = spark.createDataFrame([], "repo string, path string")
    return I.staleness(now.join(was, "repo"), none, none)


@query(
    """SELECT DISTINCT c.chunk_id, CASE WHEN a.content_hash IS NULL THEN 'orphan' WHEN a.content_hash = c.parent_content_hash THEN 'current' ELSE 'stale' END AS state FROM (SELECT DISTINCT chunk_id, parent_id, parent_content_hash FROM chunks) c LEFT JOIN anchors a ON a.id = c.parent_id"""
)
def chunk_states(spark: SparkSession, root: str) -> DataFrame:
    return I.chunk_states(table(spark, root, "chunks"), table(spark, root, "anchors")).distinct()


@query("SELECT chunk_id, count(*) - 1 AS n_again FROM chunks GROUP BY chunk_id HAVING count(*) > 1")
def duplicate_chunks(spark: SparkSession, root: str) -> DataFrame:
    return I.duplicate_ids(table(spark, root, "chunks"), "chunk_id")


@query(
    """SELECT id, content_hash, created_at, has_vec FROM (SELECT coalesce(n.id, o.id) AS id, coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(o.created_at, n.created_at) AS created_at,
      CASE WHEN n.id IS NULL OR o.content_hash IS NOT DISTINCT FROM n.content_hash THEN o.overview_embedding IS NOT NULL ELSE false END AS has_vec
    FROM anchors o FULL JOIN (SELECT id, CASE WHEN is_test THEN 'sha256:new' ELSE content_hash END AS content_hash, updated_at AS created_at FROM anchors WHERE anchor_type = 'code') n ON n.id = o.id)"""
)
def anchor_upsert(spark: SparkSession, root: str) -> DataFrame:
    """The code anchors delivered again without vectors, tests with another text."""
    old = table(spark, root, "anchors")
    h = F.when(F.col("is_test"), "sha256:new").otherwise(F.col("content_hash"))
    new = old.where("anchor_type = 'code'").withColumn("content_hash", h).withColumn("created_at", F.col("updated_at")).withColumn("overview_embedding", F.lit(None).cast("array<float>"))
    return I.upsert_anchors(old, new).select("id", "content_hash", "created_at", F.col("overview_embedding").isNotNull().alias("has_vec"))


@query(
    """WITH gone AS (SELECT id FROM anchors WHERE is_test), k AS (SELECT * FROM chunks WHERE parent_id NOT IN (FROM gone)), dead AS (SELECT chunk_id FROM chunks WHERE parent_id IN (FROM gone) AND chunk_id NOT IN (SELECT chunk_id FROM k))
    SELECT (SELECT count(*) FROM anchors WHERE id NOT IN (FROM gone)) AS anchors, (SELECT count(*) FROM k) AS chunks, (SELECT count(*) FROM chunks_vec WHERE chunk_id NOT IN (FROM dead)) AS vectors"""
)
def cascade_delete(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors")
    x, c, v = I.delete_anchors(a, table(spark, root, "chunks"), table(spark, root, "chunks_vec"), a.where("is_test"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(x, "anchors").crossJoin(n(c, "chunks")).crossJoin(n(v, "vectors"))  # one row each


@query(
    """SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, g"""
)
def event_bursts(spark: SparkSession, root: str) -> DataFrame:
    return I.sessions(table(spark, root, "events"), key="user_id", at="ts", gap="2 hours")


# ------------------------------------------------------------------ suggestions


@query(
    f"""WITH live AS {_ACTIVE}, p AS (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM link_records WHERE from_id IS NOT NULL AND to_id IS NOT NULL)
    SELECT a, b FROM p JOIN anchors x ON x.id = a JOIN anchors y ON y.id = b WHERE (x.anchor_type = 'section') <> (y.anchor_type = 'section') AND NOT EXISTS (SELECT 1 FROM live WHERE least(from_id, to_id) = a AND greatest(from_id, to_id) = b)"""
)
def candidate_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that were linked at any time and are not now, as candidates."""
    log = _log(spark, root)
    near = log.where("from_id is not null and to_id is not null").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(1.0).alias("similarity"))
    return S.candidate_pairs(near, table(spark, root, "anchors"), L.active(log)).select("a", "b")


@query(
    f"""WITH live AS {_ACTIVE}, s AS (SELECT id FROM anchors WHERE anchor_type = 'section'), c AS (SELECT id FROM anchors WHERE anchor_type = 'code'),
    l AS (SELECT from_id AS section_id, to_id AS code_id FROM live WHERE from_id IN (FROM s) AND to_id IN (FROM c) UNION SELECT to_id, from_id FROM live WHERE to_id IN (FROM s) AND from_id IN (FROM c)),
    n AS (SELECT from_id AS section_id, to_id AS code_id FROM link_records WHERE from_id IN (FROM s) AND to_id IN (FROM c) UNION SELECT to_id, from_id FROM link_records WHERE to_id IN (FROM s) AND from_id IN (FROM c))
    SELECT section_id, code_id, 'link' AS origin FROM l UNION ALL SELECT section_id, code_id, 'similar' FROM n WHERE section_id NOT IN (SELECT section_id FROM l)"""
)
def audit_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Sections with the code linked now, else with the code they were linked to before."""
    log = _log(spark, root)
    near = log.where("from_id is not null and to_id is not null").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    return S.audit_pairs(L.active(log), near, table(spark, root, "anchors"))


@query()
def audit_payloads(spark: SparkSession, root: str) -> DataFrame:
    return S.payloads(audit_pairs(spark, root), table(spark, root, "anchors"))
