"""Queries of the repository's views, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions import vectors as VF
from lodestrata.operators import drift as D
from lodestrata.operators import links as L
from lodestrata.operators import suggest as S
from lodestrata.operators import views as V
from lodestrata.plans.index_queries import _ACTIVE, _BACTIVE, _DRIFT, _drift, _log, coverage, drift_summary
from lodestrata.plans.index_queries import SQL as INDEX_SQL
from lodestrata.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH q AS (SELECT DISTINCT replace(id, '::', ':') AS asked FROM anchors WHERE anchor_type = 'code' UNION SELECT 'gone/' || id FROM anchors WHERE is_test)
    SELECT q.asked, a.id IS NOT NULL AS found, a.id, a.anchor_type, a.path, a.symbol_name, a.content_hash FROM q LEFT JOIN anchors a ON a.id = q.asked"""
)
def get_anchor(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors")
    code = a.where("anchor_type = 'code'").select(F.regexp_replace("id", "::", ":").alias("asked"))
    asked = code.unionByName(a.where("is_test").select(F.concat(F.lit("gone/"), "id").alias("asked")))
    return V.get_anchors(asked, a).select("asked", "found", "id", "anchor_type", "path", "symbol_name", "content_hash")


@query("SELECT id, anchor_type, path, symbol_name, is_test, (SELECT count(*) FROM anchors WHERE anchor_type = 'section') > 500 AS truncated FROM anchors WHERE anchor_type = 'section' ORDER BY id LIMIT 500")
def anchor_listing(spark: SparkSession, root: str) -> DataFrame:
    return V.list_anchors(table(spark, root, "anchors"), types=["section"])


@query(
    f"""WITH d AS (SELECT split_part(from_id, '/', 1) AS repo, count(*) AS links, count(*) FILTER (WHERE drift_status <> 'fresh') AS drifted FROM {_DRIFT} GROUP BY 1)
    SELECT a.repo, count(*) AS anchors, count(*) FILTER (WHERE anchor_type = 'section') AS section, count(*) FILTER (WHERE anchor_type = 'code_in_doc') AS code_in_doc, count(*) FILTER (WHERE anchor_type = 'code') AS code,
      count(*) FILTER (WHERE is_test) AS tests, count(DISTINCT path) AS files, coalesce(any_value(d.links), 0) AS links, coalesce(any_value(d.drifted), 0) AS drifted FROM anchors a LEFT JOIN d ON d.repo = a.repo GROUP BY a.repo"""
)
def repo_summary(spark: SparkSession, root: str) -> DataFrame:
    return V.repo_summary(table(spark, root, "anchors"), _drift(spark, root))


@query(
    f"""SELECT s.total, s.drift_score, c.code_anchors, c.coverage_score, coalesce(s.drift_score >= 50, true) AS drift_passes, coalesce(c.coverage_score >= 99, true) AS coverage_passes,
      CASE WHEN coalesce(s.drift_score >= 50, true) AND coalesce(c.coverage_score >= 99, true) THEN 0 ELSE 1 END AS exit_code FROM ({INDEX_SQL[drift_summary.__name__]}) s, ({INDEX_SQL[coverage.__name__]}) c"""
)
def check(spark: SparkSession, root: str) -> DataFrame:
    return V.check(_drift(spark, root), L.active(_log(spark, root)), table(spark, root, "anchors"), least_drift=50.0, least_coverage=99.0)


@query(
    """WITH c AS (SELECT DISTINCT chunk_id, parent_id, parent_content_hash FROM chunks), a AS (SELECT DISTINCT id, content_hash FROM anchors), i AS (SELECT DISTINCT chunk_id FROM chunks), h AS (SELECT DISTINCT chunk_id FROM chunks_vec)
    SELECT 'ids given twice' AS probe, (SELECT count(*) FROM (SELECT id FROM anchors GROUP BY id HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'chunks without an anchor', (SELECT count(*) FROM c WHERE parent_id NOT IN (SELECT id FROM anchors))
    UNION ALL SELECT 'stale chunks', (SELECT count(*) FROM c JOIN a ON a.id = c.parent_id WHERE a.content_hash <> c.parent_content_hash)
    UNION ALL SELECT 'chunks without a vector', (SELECT count(*) FROM i WHERE chunk_id NOT IN (FROM h))
    UNION ALL SELECT 'vectors without a chunk', (SELECT count(*) FROM h WHERE chunk_id NOT IN (FROM i))
    UNION ALL SELECT 'vectors of another length', (SELECT count(DISTINCT chunk_id) FROM chunks_vec WHERE coalesce(len(embedding) <> 64, true))"""
)
def doctor(spark: SparkSession, root: str) -> DataFrame:
    return V.doctor(table(spark, root, "anchors"), table(spark, root, "chunks"), table(spark, root, "chunks_vec"), dim=64)


@query(
    f"""WITH e AS (SELECT link_id, drift_status FROM {_DRIFT} WHERE drift_status <> 'fresh'),
    s AS (SELECT l.link_id, e.drift_status, 'from' AS side, l.from_id AS anchor_id, coalesce(l.prior_from_content_hash, l.from_content_hash) AS stored_hash FROM {_BACTIVE} l JOIN e ON e.link_id = l.link_id
      UNION ALL SELECT l.link_id, e.drift_status, 'to', l.to_id, coalesce(l.prior_to_content_hash, l.to_content_hash) FROM {_BACTIVE} l JOIN e ON e.link_id = l.link_id)
    SELECT link_id, side, anchor_id, stored_hash, a.content_hash AS current_hash, drift_status FROM s LEFT JOIN anchors a ON a.id = s.anchor_id WHERE a.content_hash IS DISTINCT FROM s.stored_hash"""
)
def to_reconcile(spark: SparkSession, root: str) -> DataFrame:
    a, log = table(spark, root, "anchors"), _log(spark, root)
    return V.to_reconcile(_drift(spark, root), L.active(log.where("layer = 0")), a)


@query("SELECT (SELECT count(DISTINCT path) FROM anchors) AS files, (SELECT count(DISTINCT id) FROM anchors) AS anchors, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks, (SELECT count(DISTINCT parent_id) FROM chunks WHERE parent_id NOT IN (SELECT id FROM anchors)) AS pruned")
def index_totals(spark: SparkSession, root: str) -> DataFrame:
    a, c = table(spark, root, "anchors"), table(spark, root, "chunks")
    return V.index_totals(a, c, c.select(F.col("parent_id").alias("id")).join(a.select("id"), "id", "left_anti"))


@query("SELECT r AS skip_reason, count(*) AS n FROM (SELECT CASE WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN octet_length(encode(text)) > 4000 THEN 'oversize' END AS r FROM documents WHERE text IS NOT NULL) WHERE r IS NOT NULL GROUP BY r")
def skip_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Documents as files, those of more than 4,000 bytes being too large."""
    from lodestrata.sources.files import skip_reason

    d = table(spark, root, "documents").where("text is not null")
    return V.skip_reasons(d.select(skip_reason(F.encode("text", "UTF-8"), 4000).alias("skip_reason")))


@query(f"SELECT split_part(path, '/', 1) AS repo, count(*) FILTER (WHERE change IN ('new', 'changed')) AS stale, count(*) FILTER (WHERE change = 'removed') AS missing FROM ({INDEX_SQL['manifest_diff']}) GROUP BY 1")
def stale_counts(spark: SparkSession, root: str) -> DataFrame:
    from lodestrata.plans.index_queries import manifest_diff

    return V.stale_counts(manifest_diff(spark, root).withColumn("repo", F.substring_index("path", "/", 1)), ["repo"])


@query(
    """WITH m AS (SELECT DISTINCT repo, path FROM anchors WHERE NOT is_test OR is_test IS NULL), d AS (SELECT DISTINCT repo, path FROM anchors WHERE is_test), f AS (SELECT DISTINCT repo, path FROM anchors WHERE anchor_type = 'code_in_doc')
    SELECT r.repo, (SELECT count(*) FROM d WHERE d.repo = r.repo AND (d.repo, d.path) IN (FROM m)) + (SELECT count(*) FROM f WHERE f.repo = r.repo AND (f.repo, f.path) IN (FROM m)) AS n FROM (SELECT DISTINCT repo FROM m) r"""
)
def change_estimate(spark: SparkSession, root: str) -> DataFrame:
    """The files of other than tests as manifest, those with tests as dirty, those with code in documents as different."""
    a = table(spark, root, "anchors")
    return V.change_estimate(a.where("not is_test or is_test is null"), a.where("is_test"), a.where("anchor_type = 'code_in_doc'"))


@query("SELECT coalesce(created_by, 'main') AS overlay, count(DISTINCT event_id) AS n FROM link_records WHERE layer = 1 AND event_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM link_records WHERE layer = 0 AND event_id IS NOT NULL) GROUP BY 1")
def pending_branches(spark: SparkSession, root: str) -> DataFrame:
    """Overlays named by the records' authors."""
    r = table(spark, root, "link_records").where("event_id is not null")
    return V.pending_branches(r, F.coalesce("created_by", F.lit("main"))).select(F.url_decode("overlay").alias("overlay"), "n")


@query(
    f"""WITH q AS (SELECT DISTINCT link_id FROM link_records WHERE layer = 1 UNION SELECT 'lnk_none')
    SELECT q.link_id, CASE WHEN l.link_id IS NULL THEN 'unknown' ELSE 'accepted' END AS status, l.from_id, l.to_id, l.link_type FROM q LEFT JOIN {_ACTIVE} l ON l.link_id = q.link_id"""
)
def accepted_links(spark: SparkSession, root: str) -> DataFrame:
    log = _log(spark, root)
    asked = log.where("layer = 1").select("link_id").unionByName(spark.range(1).select(F.lit("lnk_none").alias("link_id")))
    return V.accept(log, asked)


_AFTER = """(SELECT event_id, link_id, op, 0 AS layer, received_at FROM link_records WHERE layer = 0
  UNION ALL SELECT event_id, link_id, op, 0, received_at FROM link_records WHERE layer = 1 AND event_id NOT IN (SELECT event_id FROM link_records WHERE layer = 0))"""


@query(
    f"""WITH p AS (SELECT DISTINCT event_id FROM link_records WHERE layer = 1 AND event_id NOT IN (SELECT event_id FROM link_records WHERE layer = 0)),
    l AS (SELECT DISTINCT event_id, link_id FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY received_at DESC, event_id DESC) AS k FROM {_AFTER}) WHERE k = 1 AND op = 'upsert')
    SELECT p.event_id, l.link_id FROM p LEFT JOIN l ON l.event_id = p.event_id"""
)
def committed_links(spark: SparkSession, root: str) -> DataFrame:
    return V.commit(_log(spark, root))[1]


@query(
    """WITH m AS (SELECT DISTINCT event_id FROM link_records WHERE layer = 1 AND op = 'delete')
    SELECT layer, count(*) AS n FROM (SELECT 0 AS layer FROM link_records WHERE layer = 0
      UNION ALL SELECT CASE WHEN event_id IN (FROM m) THEN 0 ELSE 1 END FROM link_records WHERE layer = 1 AND NOT (event_id IN (FROM m) AND event_id IN (SELECT event_id FROM link_records WHERE layer = 0))) GROUP BY layer"""
)
def recovered_links(spark: SparkSession, root: str) -> DataFrame:
    """A promotion of the overlay's deletes, broken off and finished twice."""
    log = _log(spark, root)
    marks = log.where("layer = 1 and op = 'delete'").groupBy(F.col("link_id").alias("marker")).agg(F.collect_set("event_id").alias("event_ids"))
    once = V.recover(log, marks)[0]
    return V.recover(once, marks)[0].groupBy("layer").agg(F.count("*").alias("n"))


_PAIRS = f"(SELECT *, link_id AS pair_id FROM {_ACTIVE} WHERE from_type = 'code' AND to_type = 'section')"


@query(
    f"""SELECT pair_id, to_id AS section_id, from_id AS code_id, CASE hash WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, (hash + 1)::INT AS place
    FROM (SELECT *, length(from_id) % 4 AS hash FROM {_PAIRS}) WHERE hash < 3 AND length(to_id) % 2 = 0"""
)
def audit_findings(spark: SparkSession, root: str) -> DataFrame:
    """Answers made up of the links' names: unknown pairs, unknown severities and pairs without drift among them."""
    live = L.active(_log(spark, root)).where("from_type = 'code' and to_type = 'section'")
    pairs = live.select(F.col("link_id").alias("pair_id"), F.col("to_id").alias("section_id"), F.col("from_id").alias("code_id"))
    severity = F.element_at(F.array(*[F.lit(x) for x in ("high", "Medium", "LOW", "severe")]), (F.length("code_id") % 4 + 1).cast("int"))
    f = F.struct("pair_id", (F.length("section_id") % 2 == 0).alias("is_drifted"), severity.alias("severity"))
    other = F.struct(F.concat(F.lit("other-"), "pair_id").alias("pair_id"), F.lit(True).alias("is_drifted"), F.lit("HIGH").alias("severity"))
    raw = pairs.select(F.to_json(F.struct(F.array(f, other).alias("findings"))).alias("response"))
    return V.audit_findings(raw, pairs).select("pair_id", "section_id", "code_id", "severity", "place")


@query(
    """WITH c AS (SELECT DISTINCT path FROM anchors WHERE is_test), d AS (SELECT DISTINCT event_id AS claim_id, from_id AS doc, split_part(to_id, ':', 1) AS path FROM link_records WHERE op = 'upsert')
    SELECT DISTINCT claim_id, doc FROM d WHERE claim_id IN (SELECT claim_id FROM d JOIN c ON c.path = substr(d.path, strpos(d.path, '/') + 1))"""
)
def affected_claims(spark: SparkSession, root: str) -> DataFrame:
    """Link records as claims of their source about the file of their target; the files with tests have changed."""
    up = table(spark, root, "link_records").where("op = 'upsert'")
    path = X.endpoint_path(F.col("to_id"))
    deps = up.select(F.col("event_id").alias("claim_id"), path.alias("p")).selectExpr("claim_id", "substring(p, instr(p, '/') + 1) AS path")
    return V.affected_claims(up.select(F.col("event_id").alias("claim_id"), F.col("from_id").alias("doc")), deps, table(spark, root, "anchors").where("is_test"))


@query(
    """WITH c AS (SELECT DISTINCT id FROM anchors WHERE is_test), d AS (SELECT DISTINCT link_id AS claim_id, unnest([from_id, to_id]) AS path FROM link_records WHERE op = 'upsert')
    SELECT DISTINCT link_id AS claim_id FROM link_records WHERE link_id NOT IN (SELECT claim_id FROM d WHERE path IN (FROM c))"""
)
def reusable_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Links as verdicts, their ends as evidence; the tests have changed."""
    r = table(spark, root, "link_records")
    ev = r.where("op = 'upsert'").select(F.col("link_id").alias("claim_id"), F.explode(F.array("from_id", "to_id")).alias("path"))
    return V.reusable_verdicts(r.select(F.col("link_id").alias("claim_id")).distinct(), ev, table(spark, root, "anchors").where("is_test").select(F.col("id").alias("path")))


@query(
    """WITH a AS (SELECT path, def_line AS line, def_char AS char, min(id) AS id FROM anchors WHERE def_line IS NOT NULL AND def_char IS NOT NULL GROUP BY ALL), q AS (SELECT path, line, char FROM a UNION SELECT path, line + 100000, char FROM a)
    SELECT q.path, q.line, q.char, a.id FROM q LEFT JOIN a USING (path, line, char)"""
)
def anchors_at(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors")
    p = a.where("def_line is not null and def_char is not null").select("path", F.col("def_line").alias("line"), F.col("def_char").alias("char"))
    return V.anchors_at(p.unionByName(p.withColumn("line", F.col("line") + 100000)), a)


@query("SELECT count(*) AS batches, sum(greatest(1, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) * 7 // 5))::BIGINT AS tokens, sum(greatest(1, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) * 7 // 5)) > 100000 AS over FROM documents WHERE text IS NOT NULL")
def token_total(spark: SparkSession, root: str) -> DataFrame:
    return V.token_total(table(spark, root, "documents").where("text is not null"), tokens=X.approx_tokens(F.col("text")), most=100_000)


@query("SELECT id, anchor_type, path, symbol_name FROM anchors")
def compact_anchors(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").select("id", "anchor_type", "path", "symbol_name", "content_hash", "fingerprint_simhash", "def_line", "def_char", "closure_hash", "overview_embedding")
    return V.compact(a)


@query("SELECT chunk_id, octet_length(v) AS n_bytes, n FROM (SELECT chunk_id, len(embedding) AS n, repeat('x', len(embedding) * 4)::BLOB AS v FROM (SELECT DISTINCT chunk_id, embedding FROM chunks_vec WHERE embedding IS NOT NULL))")
def vector_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Vectors as little-endian bytes and back; only those that come back equal are there."""
    v = table(spark, root, "chunks_vec").where("embedding is not null").distinct().withColumn("v", VF.to_bytes("embedding"))
    return v.where(VF.from_bytes("v") == F.col("embedding")).select("chunk_id", F.octet_length("v").alias("n_bytes"), F.size("embedding").alias("n"))


@query("SELECT doc_id, string_agg(x, '\n' ORDER BY i) AS part FROM (SELECT doc_id, unnest(string_split(text, '\n')[2:4]) AS x, generate_subscripts(string_split(text, '\n')[2:4], 1) AS i FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def line_slices(spark: SparkSession, root: str) -> DataFrame:
    """Lines 2 to 4 of every document that has two."""
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", X.text_slice(F.col("text"), F.lit(1), F.lit(0), F.lit(3), F.lit(None).cast("int")).alias("part")).where(F.col("part").isNotNull())


@query("SELECT symbol_name, '\"' || replace(symbol_name, '\"', '\"\"') || '\"' AS quoted FROM (SELECT DISTINCT symbol_name FROM anchors WHERE symbol_name IS NOT NULL AND NOT regexp_matches(symbol_name, '\\s') AND symbol_name <> '')")
def quoted_queries(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").where(r"symbol_name is not null and not symbol_name rlike '\\s' and symbol_name <> ''").select("symbol_name").distinct()
    return a.select("symbol_name", X.quoted_query(F.col("symbol_name")).alias("quoted"))


_UNIT = """(SELECT id, anchor_type, list_transform(e, lambda x: x / n) AS u FROM (SELECT id, anchor_type, overview_embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(overview_embedding::DOUBLE[], lambda x: x * x))) AS n FROM anchors WHERE len(overview_embedding) = 64) WHERE n > 0)"""


@query(
    f"""WITH u AS {_UNIT}, q AS (SELECT * FROM u WHERE id IN (SELECT id FROM anchors WHERE length(id) % 20 = 0)),
    p AS (SELECT q.id AS a, x.id AS b, round(list_inner_product(q.u, x.u), 6) AS similarity FROM q JOIN u x ON (q.anchor_type = 'code') <> (x.anchor_type = 'code')),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM p) WHERE k <= 5),
    g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(similarity) AS similarity FROM t GROUP BY 1, 2)
    SELECT a, b, similarity FROM g WHERE NOT EXISTS (SELECT 1 FROM {_ACTIVE} l WHERE least(l.from_id, l.to_id) = g.a AND greatest(l.from_id, l.to_id) = g.b)"""
)
def suggested_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Link candidates of a stated set of anchors by similarity: their five nearest of the other kind."""
    a = table(spark, root, "anchors")
    near = S.similar_opposites(a, a.where("length(id) % 20 = 0"), dim=64)
    out = S.unlinked(S.unordered(near), L.active(_log(spark, root)))
    return out.select("a", "b", "similarity")


@query(
    f"""WITH u AS {_UNIT}, s AS (SELECT * FROM u WHERE anchor_type = 'section' AND length(id) % 20 = 0), c AS (SELECT * FROM u WHERE anchor_type = 'code'),
    l AS (SELECT from_id AS section_id, to_id AS code_id FROM {_ACTIVE} WHERE from_type = 'section' AND to_type = 'code' UNION SELECT to_id, from_id FROM {_ACTIVE} WHERE to_type = 'section' AND from_type = 'code'),
    k AS (SELECT DISTINCT l.* FROM l JOIN anchors x ON x.id = section_id AND x.anchor_type = 'section' JOIN anchors y ON y.id = code_id AND y.anchor_type = 'code'),
    n AS (SELECT section_id, code_id FROM (SELECT s.id AS section_id, c.id AS code_id, row_number() OVER (PARTITION BY s.id ORDER BY round(list_inner_product(s.u, c.u), 6) DESC, c.id) AS r FROM s, c) WHERE r <= 5)
    SELECT section_id, code_id, 'link' AS origin FROM k WHERE length(section_id) % 20 = 0 UNION ALL SELECT section_id, code_id, 'similar' FROM n WHERE section_id NOT IN (SELECT section_id FROM k)"""
)
def audited_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections of a stated set with the code linked to them, else with the code most similar to them."""
    a = table(spark, root, "anchors")
    asked = a.where("anchor_type = 'section' and length(id) % 20 = 0")
    near = S.similar_opposites(a.where("anchor_type in ('code', 'section')"), asked, dim=64).select("a", "b")
    live = L.active(_log(spark, root)).where("(from_type = 'section' and to_type = 'code') or (from_type = 'code' and to_type = 'section')")
    return S.audit_pairs(live, near, a).where("length(section_id) % 20 = 0")


@query(
    f"""SELECT link_id, rank FROM (SELECT link_id, row_number() OVER (ORDER BY severity, link_id) AS rank FROM (SELECT link_id, CASE drift_status WHEN 'merge-conflict' THEN 1 WHEN 'broken-source' THEN 2 WHEN 'broken-target' THEN 3 WHEN 'both-changed' THEN 4 ELSE 5 END AS severity FROM {_DRIFT} WHERE drift_status <> 'fresh')) WHERE rank <= 50"""
)
def most_pressing(spark: SparkSession, root: str) -> DataFrame:
    """The fifty links to look at first."""
    rank = F.least(F.array_position(F.array(*[F.lit(s) for s in D.PRECEDENCE]), F.col("drift_status")), F.lit(5).cast("long"))
    first = _drift(spark, root).where("drift_status <> 'fresh'").select("link_id", rank.alias("severity")).orderBy("severity", "link_id").limit(50)
    return first.select("link_id", F.row_number().over(Window.orderBy("severity", "link_id")).alias("rank"))


@query("SELECT DISTINCT file_path AS path FROM documents WHERE file_path IS NOT NULL AND regexp_matches(file_path, '^(docs|doc|documentation)/') AND lower(file_path) LIKE '%.md' AND NOT regexp_matches(file_path, '(?:^|/)\\.git/')")
def doc_files(spark: SparkSession, root: str) -> DataFrame:
    """Documents in the usual folders."""
    from lodestrata.sources.seams import doc_files as found

    return found(table(spark, root, "documents").where("file_path is not null").select(F.col("file_path").alias("path"))).distinct()


@query("SELECT id AS path, count(*) AS n FROM anchors GROUP BY id")
def cached_index(spark: SparkSession, root: str) -> DataFrame:
    """An index by anchor of which the code's part is cached, and of the rest an older state."""
    from lodestrata.sources.seams import cached_index as refreshed

    a = table(spark, root, "anchors").select(F.col("id").alias("path"), (F.col("anchor_type") == "code").cast("int").alias("mtime"))
    cache = a.select("path", F.lit(1).alias("mtime")).groupBy("path", "mtime").agg(F.count("*").alias("n"))
    return refreshed(a, cache, lambda rest: rest.groupBy("path", "mtime").agg(F.count("*").alias("n"))).select("path", "n")


@query(
    f"""WITH a AS (SELECT id, CASE lower(regexp_extract(path, '\\.(\\w+)$', 1)) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'zig' THEN 'zig' END AS lang, transitive_hash_status AS s FROM anchors WHERE anchor_type = 'code'),
    r AS (SELECT root, max(depth) AS depth FROM ({INDEX_SQL['call_closure']}) GROUP BY root)
    SELECT id, CASE WHEN lang IS NULL THEN 'unsupported' WHEN lang = 'zig' THEN 'lsp_unavailable' WHEN s = 'lsp_error' THEN 'lsp_error' WHEN r.depth >= 32 THEN 'partial' ELSE 'complete' END AS status FROM a LEFT JOIN r ON r.root = a.id"""
)
def enrichment(spark: SparkSession, root: str) -> DataFrame:
    """Without a session for one language, and with the stored errors as failures."""
    from lodestrata.operators import graph as G
    from lodestrata.plans.index_queries import _edges

    a = table(spark, root, "anchors")
    failed = a.where("transitive_hash_status = 'lsp_error'").select("id")
    return G.enrich(a, _edges(spark, root), failed, available=[x for x in G.ADAPTERS if x != "zig"]).select("id", "status")


@query(f"SELECT e.src, e.dst, a.h IS NOT NULL AS known FROM (SELECT DISTINCT from_id AS src, to_id AS dst FROM {_ACTIVE} WHERE from_type = 'code' AND to_type = 'code') e LEFT JOIN (SELECT id, content_text AS h FROM anchors) a ON a.id = e.dst")
def callee_bodies(spark: SparkSession, root: str) -> DataFrame:
    from lodestrata.operators import graph as G
    from lodestrata.plans.index_queries import _edges

    return G.body_hashes(_edges(spark, root), table(spark, root, "anchors")).select("src", "dst", F.col("body_hash").isNotNull().alias("known"))


@query()
def code_declarations(spark: SparkSession, root: str) -> DataFrame:
    """Functions and types of code anchors with their headers."""
    from lodestrata.operators import extraction as E

    a = table(spark, root, "anchors").where("anchor_type = 'code'")
    return E.code_declarations(a.select(F.col("path"), F.col("content_text").alias("text"))).select("path", "kind", "qualified_name", "code_id", "signature", "signature_hash")


@query(
    """SELECT id AS anchor_id, 'out' AS direction, to_id AS other FROM anchors JOIN (SELECT DISTINCT from_id, to_id FROM link_records WHERE from_id IS NOT NULL AND to_id IS NOT NULL) l ON l.from_id = id WHERE is_test
    UNION SELECT id, 'in', from_id FROM anchors JOIN (SELECT DISTINCT from_id, to_id FROM link_records WHERE from_id IS NOT NULL AND to_id IS NOT NULL) l ON l.to_id = id WHERE is_test"""
)
def one_hop(spark: SparkSession, root: str) -> DataFrame:
    """Whatever a test was ever linked to."""
    from lodestrata.operators import graph as G

    e = table(spark, root, "link_records").where("from_id is not null and to_id is not null").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.neighbours(e, table(spark, root, "anchors").where("is_test")).select(F.col("id").alias("anchor_id"), "direction", "other")


_WORD = "'[^ \\t\\n\\r\\f\\v]+'"
SQL["search_packets"] = f"""WITH h AS ({INDEX_SQL['hybrid_search']}), c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunks),
    j AS (SELECT h.query_id, h.rank, h.score, h.anchor_id, a.anchor_type, a.path, a.symbol_name, a.content_text AS full_text, c.text AS chunk_text, len(regexp_extract_all(a.content_text, {_WORD})) > 357 AS truncated,
      CASE WHEN len(regexp_extract_all(a.content_text, {_WORD})) > 357 THEN array_to_string(regexp_extract_all(a.content_text, {_WORD})[1:357], ' ') ELSE a.content_text END AS preview
      FROM h JOIN anchors a ON a.id = h.anchor_id LEFT JOIN c ON c.chunk_id = coalesce(h.vec_chunk, h.bm25_chunk)),
    e AS (SELECT *, nullif(substr(chunk_text, 1, 200), substr(preview, 1, 200)) AS excerpt FROM j)
    SELECT query_id, rank, score, anchor_id, anchor_type, path, symbol_name, preview, truncated, excerpt, nullif(strpos(full_text, excerpt), 0) - 1 AS excerpt_at FROM e"""

SQL["append_validation"] = """WITH RECURSIVE b AS (SELECT link_id, op, event_id FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY received_at DESC, event_id DESC) AS n FROM link_records WHERE layer = 0) WHERE n = 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY ts NULLS LAST, event_id) AS k FROM (SELECT DISTINCT link_id, event_id, op, supersedes, ts FROM link_records WHERE layer = 1)),
    r AS (SELECT DISTINCT c.link_id, 0::BIGINT AS k, b.op AS op, b.event_id AS last, NULL::VARCHAR AS event_id, NULL::VARCHAR AS violation FROM c LEFT JOIN b ON b.link_id = c.link_id
      UNION ALL SELECT link_id, k, CASE WHEN violation IS NULL THEN next_op ELSE op END, CASE WHEN violation IS NULL THEN event_id ELSE last END, event_id, violation FROM (
        SELECT r.link_id, c.k, r.op, r.last, c.op AS next_op, c.event_id, CASE WHEN r.op = 'delete' THEN 'link is deleted' WHEN c.op = 'delete' AND r.last IS NULL THEN 'delete of an unknown link' WHEN r.last IS NULL AND c.supersedes IS NOT NULL THEN 'replaces an unknown record'
          WHEN r.last IS NOT NULL AND c.supersedes IS NULL THEN 'replaces nothing' WHEN r.last IS NOT NULL AND c.supersedes <> r.last THEN 'replaces another than the last record' END AS violation
        FROM r JOIN c ON c.link_id = r.link_id AND c.k = r.k + 1))
    SELECT link_id, event_id, violation FROM r WHERE k > 0"""
SQL["dashboard_rows"] = f"""WITH e AS (SELECT id, drift_status, count(*) AS n FROM (SELECT drift_status, unnest([from_id, to_id]) AS id FROM {_DRIFT}) GROUP BY ALL),
    l AS (SELECT id, '{{' || string_agg('"' || drift_status || '":' || n, ',' ORDER BY drift_status) || '}}' AS links FROM e GROUP BY id)
    SELECT a.id, '{{' || concat_ws(',', '"anchor_type":' || to_json(anchor_type), '"path":' || to_json(path), '"preview":' || to_json(substr(content_text, 1, 300)), '"links":' || links) || '}}' AS row FROM anchors a LEFT JOIN l ON l.id = a.id"""
