"""Further queries: fingerprints, verifiers, claim stores, embedding seams, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import fingerprint as FP
from lodestrata.functions import text as X
from lodestrata.functions import vectors as V
from lodestrata.operators import claims as C
from lodestrata.operators import extraction as E
from lodestrata.operators import incremental as I
from lodestrata.operators import links as L
from lodestrata.operators import lookup as K
from lodestrata.operators import suggest as S
from lodestrata.operators import verifiers as VR
from lodestrata.plans.index_queries import _ACTIVE, _LINES, _log
from lodestrata.session import table
from lodestrata.sources import providers as P

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT count(*) AS n, count(fingerprint_simhash) AS with_hash, sum(bit_count(fingerprint_simhash))::BIGINT AS bits FROM anchors")
def fingerprint_bits(spark: SparkSession, root: str) -> DataFrame:
    f = F.col("fingerprint_simhash")
    return table(spark, root, "anchors").agg(F.count("*").alias("n"), F.count(f).alias("with_hash"), F.sum(F.bit_count(f)).alias("bits"))


@query("SELECT least(a.id, b.id) AS key_a, greatest(a.id, b.id) AS key_b, bit_count(xor(a.fingerprint_simhash, b.fingerprint_simhash))::INT AS distance FROM anchors a JOIN anchors b ON a.id < b.id AND bit_count(xor(a.fingerprint_simhash, b.fingerprint_simhash)) <= 3")
def fingerprint_pairs(spark: SparkSession, root: str) -> DataFrame:
    return FP.similar_fingerprints(table(spark, root, "anchors"), key="id", fingerprint="fingerprint_simhash")


_BITS = ", ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN 1::HUGEINT << {b} ELSE 0::HUGEINT END" for b in range(64))


@query(
    f"""WITH d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), '') AS s FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, ('0x' || substr(md5(substr(s, i, 4)), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, s, unnest(range(1, greatest(length(s) - 3, 1) + 1)) AS i FROM d))
    SELECT doc_id, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS simhash FROM (SELECT doc_id, list_sum([{_BITS}])::HUGEINT AS v FROM g GROUP BY doc_id)"""
)
def simhash(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where("text is not null").select("doc_id", FP.simhash("text").alias("simhash"))


@query()
def claim_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """All verifiers against what code anchors hold."""
    a = table(spark, root, "anchors")
    repo = VR.repository_index(a.where("anchor_type = 'code'").select("path", F.col("content_text").alias("text")))
    repo |= {"symbols": a.select(F.col("symbol_name").alias("name")), "enums": K.enums(a.where("anchor_type = 'code'").select("path", F.col("content_text").alias("text"))), "files": a.select("path")}
    c = C.extract(table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return VR.verify_all(c, repo)


@query("SELECT DISTINCT path, unnest(list_distinct(regexp_extract_all(content_text, '[\"'']([A-Za-z][\\w.\\-/]*)[\"'']', 1))) AS value FROM anchors WHERE anchor_type = 'code'")
def quoted_words(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").where("anchor_type = 'code'")
    return VR.repository_index(a.select("path", F.col("content_text").alias("text")))["strings"].distinct()


@query("SELECT user_id AS claim_id, event_type AS verdict, ts AS verified_at, event_id AS code_fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """The events as verdicts of a claim a user."""
    e = table(spark, root, "events").select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("verdict"), F.col("ts").alias("verified_at"), F.col("event_id").alias("code_fingerprint"))
    return C.latest_verdicts(e)


@query("SELECT verdict, count(*) AS n FROM (SELECT event_type AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY verdict")
def verdict_histogram(spark: SparkSession, root: str) -> DataFrame:
    return latest_verdicts(spark, root).groupBy("verdict").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, count(*) FILTER (WHERE inside) AS in_fence, count(*) FILTER (WHERE NOT inside AND regexp_matches(line, '^#{{1,6}}\s+\S')) AS headings, count(*) AS n_lines FROM {_LINES} GROUP BY doc_id")
def fence_state(spark: SparkSession, root: str) -> DataFrame:
    ln = C.lines(table(spark, root, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return ln.groupBy(F.col("doc").alias("doc_id")).agg(F.count_if("in_fence").alias("in_fence"), F.count_if("head").alias("headings"), F.count("*").alias("n_lines"))


@query(
    """SELECT repo, path, symbol_name, id, CASE WHEN n > 1 THEN symbol_name || '-' || n ELSE symbol_name END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY path, symbol_name ORDER BY id) AS n FROM anchors WHERE symbol_name IS NOT NULL)"""
)
def collision_suffixes(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").where("symbol_name is not null").select("repo", "path", "symbol_name", "id")
    return I.suffixed(a, parent="path", name="symbol_name", order=F.col("id"))


@query("SELECT path, count(DISTINCT repo) AS repos, list_sort(list(DISTINCT repo)) AS names FROM anchors GROUP BY path HAVING count(DISTINCT repo) > 1")
def shared_paths(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "anchors").groupBy("path").agg(F.sort_array(F.collect_set("repo")).alias("names"))
    return g.select("path", F.size("names").cast("long").alias("repos"), "names").where("repos > 1")


@query(f"SELECT id FROM anchors WHERE anchor_type = 'code' INTERSECT SELECT unnest([from_id, to_id]) FROM {_ACTIVE}")
def linked_code(spark: SparkSession, root: str) -> DataFrame:
    ends = L.active(_log(spark, root)).select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return table(spark, root, "anchors").where("anchor_type = 'code'").select("id").intersect(ends)


@query("SELECT DISTINCT parent_id FROM chunks EXCEPT SELECT id FROM anchors")
def orphaned_parents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("parent_id").subtract(table(spark, root, "anchors").select(F.col("id").alias("parent_id")))


@query("SELECT a.id, a.path FROM anchors a WHERE a.repo || '/' || a.path NOT IN (SELECT repo || '/' || path FROM anchors WHERE NOT is_test)")
def missing_sources(spark: SparkSession, root: str) -> DataFrame:
    """Anchors whose file isn't among those of other than tests."""
    a = table(spark, root, "anchors").withColumn("path", F.concat_ws("/", "repo", "path"))
    out = I.prune_missing(a, a.where("not is_test"))
    return out.select("id", F.substring_index("path", "/", -1).alias("f"), F.expr("substring(path, length(repo) + 2)").alias("path")).drop("f")


@query("SELECT * EXCLUDE (n) FROM (SELECT chunk_id, parent_id, chunk_index, overlap_with_prev, row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index, chunk_id) AS n, chunk_index <> row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index, chunk_id) - 1 AS gap FROM (SELECT DISTINCT chunk_id, parent_id, chunk_index, overlap_with_prev FROM chunks))")
def chunk_sequences(spark: SparkSession, root: str) -> DataFrame:
    """Stored pieces in order, with those whose number is not their place."""
    c = table(spark, root, "chunks").select("chunk_id", "parent_id", "chunk_index", "overlap_with_prev").distinct()
    w = Window.partitionBy("parent_id").orderBy("chunk_index", "chunk_id")
    return c.withColumn("gap", F.col("chunk_index") != F.row_number().over(w) - 1)


@query(
    """WITH p AS (SELECT DISTINCT parent_id FROM chunks WHERE chunk_index > 3), k AS (SELECT chunk_id, parent_id, text FROM chunks WHERE parent_id NOT IN (FROM p))
    SELECT parent_id, count(*) AS n FROM (SELECT parent_id FROM k UNION ALL SELECT parent_id FROM p) GROUP BY parent_id"""
)
def chunk_replace(spark: SparkSession, root: str) -> DataFrame:
    """Parents of more than four pieces stored again as one piece."""
    c = table(spark, root, "chunks").select("chunk_id", "parent_id", "text")
    parents = table(spark, root, "chunks").where("chunk_index > 3").select("parent_id").distinct()
    new = parents.select(F.lit(None).cast("long").alias("chunk_id"), "parent_id", F.lit("").alias("text"))
    return I.replace_chunks(c, new).groupBy("parent_id").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')))::BIGINT AS words FROM (SELECT coalesce(lang, '?') AS lang, lower(trim(coalesce(source, '?'))) AS source, text FROM documents) GROUP BY lang, source")
def corpus_census(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), F.lower(F.trim(F.coalesce("source", F.lit("?")))).alias("source"), X.word_count(F.col("text")).alias("w"))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("words"))


@query("SELECT id, 'sha256:' || sha256(string_agg(d, '|' ORDER BY d)) AS evidence FROM (SELECT DISTINCT a.id, split_part(l.to_id, ':', 1) AS d FROM anchors a JOIN link_records l ON l.from_id = a.id WHERE l.op = 'upsert') GROUP BY id")
def evidence_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "anchors").select("id")
    ends = table(spark, root, "link_records").where("op = 'upsert'").select(F.col("from_id").alias("id"), X.endpoint_path(F.col("to_id")).alias("d"))
    return a.join(ends, "id").groupBy("id").agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.sort_array(F.collect_set("d")), "|"), 256)).alias("evidence"))


@query(
    """SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL"""
)
def hourly_events(spark: SparkSession, root: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    return table(spark, root, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("started"), "event_type", "n", "mean")


@query("SELECT a.chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM (SELECT DISTINCT chunk_id, embedding FROM chunks_vec WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0) a, (SELECT embedding FROM chunks_vec WHERE len(embedding) = 64 ORDER BY chunk_id LIMIT 1) b")
def cosine_to_first(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "chunks_vec").where(F.size("embedding") == 64)
    one = v.agg(F.min_by("embedding", "chunk_id").alias("q"))  # one row
    ok = v.where(F.exists("embedding", lambda x: x != 0)).distinct()
    return ok.crossJoin(F.broadcast(one)).select("chunk_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("SELECT DISTINCT chunk_id, CASE WHEN text IS NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks_vec WHERE len(embedding) = 64) THEN NULL ELSE 64 END AS dim FROM chunks")
def reembedded(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of all chunks by the stub model where the stored one is of another length."""
    out = P.reembed(table(spark, root, "chunks"), table(spark, root, "chunks_vec"), P.StubEmbedder(64))
    return out.select("chunk_id", F.size("embedding").alias("dim"))


@query()
def link_responses(spark: SparkSession, root: str) -> DataFrame:
    """Candidate pairs sent to a stand-in judge in batches and its answers checked."""
    from lodestrata.plans.index_queries import audit_pairs

    class Echo:
        def complete(self, payload: str) -> str:
            import json

            return json.dumps([{"pair_id": p["pair_id"], "should_link": len(p["code"]) % 3 > 0, "link_type": "tests", "confidence": len(p["doc"]) % 10 / 10} for p in json.loads(payload)])

    pay = S.payloads(audit_pairs(spark, root), table(spark, root, "anchors"))
    ans = P.responses(P.judge(pay, Echo()))
    return S.judged(ans, ans.select("pair_id")).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def symbol_tree(spark: SparkSession, root: str) -> DataFrame:
    """Functions of code anchors with their outer names and depth."""
    a = table(spark, root, "anchors").where("anchor_type = 'code'")
    s = E.code_symbols(a.select("path", F.col("content_text").alias("text")))
    return s.groupBy("language", "depth").agg(F.count("*").alias("n"), F.count_if("is_documented").alias("documented"))
