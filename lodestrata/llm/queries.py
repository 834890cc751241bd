"""Queries of this subpackage, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import function_docs, mixing, near_duplicates, neighbours, packing, residue, splitting
from lodestrata.llm.tokens import with_tokens
from lodestrata.operators.retrieval import nearest_in_blocks
from lodestrata.session import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    out = near_duplicates.similar_texts(table(spark, root, "anchors"))
    return out.select(out["key_a"].alias("id_a"), out["key_b"].alias("id_b"))


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its class of copies and the number of other classes alike (five words, 0.8)."""
    docs = table(spark, root, "documents")
    return near_duplicates.linked_texts(docs, key="doc_id", text="text").select("key", "n_copies", "n_links")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    a = neighbours.similar_pairs(table(spark, root, "anchors"), key="id", vec="overview_embedding")
    c = neighbours.similar_pairs(table(spark, root, "chunks_vec"), key="chunk_id", vec="embedding")
    return a.select(F.lit("anchors").alias("vec_table"), "key_a", "key_b").unionByName(c.select(F.lit("chunks_vec").alias("vec_table"), "key_a", "key_b"))


def p3_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar of every chunk vector whose id is divisible by 20, against all."""
    return neighbours.nearest(table(spark, root, "chunks_vec"), key="chunk_id", vec="embedding", dim=neighbours.DIM, queries=F.col("chunk_id") % 20 == 0)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return function_docs.anchor_functions(table(spark, root, "anchors")).select("id", "func_name").distinct()


def p5_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The code-description pairs."""
    return function_docs.anchor_functions(table(spark, root, "anchors"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_pieces(spark, root).where(F.col("chunk_index") == 0).select("item_kind", "item_key").distinct()


def p6_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of all oversized anchors and stored sub-chunks."""
    return splitting.oversized_pieces(table(spark, root, "anchors"), table(spark, root, "chunks"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of each document or part of one."""
    return packing.pack_documents(table(spark, root, "documents")).select("doc_id", "part", "n_tokens", "container", "fill")


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """How well the containers are filled."""
    bins = p7_containers(spark, root).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    least = F.ceil(F.sum("used") / packing.CAPACITY)
    return bins.agg(F.count("*").alias("containers"), least.alias("least_containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * packing.CAPACITY)).alias("filled"))


def p8_chosen(spark: SparkSession, root: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.mix_documents(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The actual shares of the mixture."""
    return mixing.shares(p8_chosen(spark, root), table(spark, root, "mix_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_documents(table(spark, root, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The documents to leave out, counted by source and kind."""
    docs = table(spark, root, "documents")
    out = residue.residue_documents(docs).join(docs.select("doc_id", F.lower(F.trim("source")).alias("source")), "doc_id")
    return out.groupBy("source", "kind").agg(F.count("*").alias("n_docs"))


def p3_recall(spark: SparkSession, root: str) -> DataFrame:
    """Whether the five nearest found for the stated queries are at least nine in ten of the true ones, by brute force in blocks: in
    both tables, at the settings of ``p3_nearest``."""
    out = None
    for name, key, vec in (("anchors", "id", "overview_embedding"), ("chunks_vec", "chunk_id", "embedding")):
        t = table(spark, root, name).select(F.col(key).cast("string").alias("key"), F.col(vec).alias("vec"))
        asked = F.pmod(F.xxhash64("key"), F.lit(20)) == 0
        size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = t.where(neighbours.usable(F.col("vec"), neighbours.DIM)).distinct().select("key", F.transform("vec", lambda x: x.cast("double") / size).alias("u"), asked.alias("asks"))
        true = nearest_in_blocks(unit.select(F.col("key").alias("chunk_id"), F.col("u").alias("embedding")), unit.where("asks").select(F.col("key").alias("query_id"), F.col("u").alias("vec")), 6, dim=neighbours.DIM, cosine=True)
        w = Window.partitionBy("key").orderBy("rank")
        best = true.where("query_id <> chunk_id").select(F.col("query_id").alias("key"), F.col("chunk_id").alias("neighbour"), "rank").withColumn("rank", F.row_number().over(w)).where("rank <= 5").drop("rank")
        got = neighbours.nearest(t, key="key", vec="vec", dim=neighbours.DIM, queries=asked).select("key", "neighbour", F.lit(1).alias("hit"))
        one = best.join(got, ["key", "neighbour"], "left").agg((F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)) >= 0.9).alias("enough")).select(F.lit(name).alias("vec_table"), "enough")
        out = one if out is None else out.unionByName(one)
    return out


def p6_checked(spark: SparkSession, root: str) -> DataFrame:
    """Of every oversized item its words, put together from its pieces: each piece without what it repeats of the one before."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    p = p6_pieces(spark, root).withColumn("w", words)
    g = p.groupBy("item_kind", "item_key").agg(F.sum(F.col("w") - F.col("overlap_with_prev")).cast("long").alias("n_words"), (F.max(F.floor(F.col("w") * 7 / 5)) <= 600).alias("within_limit"), (F.max("chunk_index") + 1 == F.count("*")).alias("numbered"))
    return g.distinct()


def p7_checked(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the containers: all documents are there once, none is overfull, only documents above the capacity are in
    parts, and not one in a hundred containers more than the tokens need."""
    c = p7_containers(spark, root)
    bins = c.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"), F.count("*").alias("bins"), F.sum("used").alias("tokens"))
    docs = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max("part").alias("last"))
    split = docs.agg(F.count("*").alias("docs"), F.count_if((F.col("last") > 0) & (F.col("n") <= packing.CAPACITY)).alias("split_small"), F.sum("n").alias("kept"))
    sized = with_tokens(table(spark, root, "documents"), text="text", keep=["doc_id"]).agg(F.sum("n_tokens").alias("all"))
    one = bins.crossJoin(split).crossJoin(sized)  # one row each
    return one.select("docs", "overfull", "split_small", (F.col("kept") == F.col("all")).alias("all_tokens"), (F.col("bins") <= 1.01 * F.ceil(F.col("tokens") / packing.CAPACITY) + 1).alias("tight"))


def p8_checked(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the mixture by source: no document is used more often than allowed, and the share is met within four
    standard deviations of its draw and a block's edge, relative to the sources that have documents."""
    s = p8_shares(spark, root)
    have = s.where("used_tokens > 0").agg(F.sum("target_share").alias("of"), (F.sum("used_tokens") / mixing.BLOCK_TOKENS).alias("slots"))
    goal = F.col("target_share") / F.col("of")
    close = F.abs(F.col("actual_share") - goal) <= 5 * F.sqrt(goal * (1 - goal) / F.col("slots")) + 0.01 * goal
    return s.crossJoin(have).where("used_tokens > 0").select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), close.alias("share_met"))  # have is one row


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_nearest": p3_nearest, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_chosen": p8_chosen, "p8_shares": p8_shares, "p3_recall": p3_recall, "p6_checked": p6_checked, "p7_checked": p7_checked, "p8_checked": p8_checked, "p9_found": p9_found, "p9_kinds": p9_kinds}

SQL = {
    # every shingle's whole list joined with itself and counted
    "p2_found": """
WITH w AS (SELECT id, regexp_extract_all(lower(content_text), '[a-z0-9]+') AS w FROM anchors WHERE content_text IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE shared >= 0.7 * (x.n + y.n - shared)
""",
    # copies are those with one set of shingles
    "p2_classes": """
WITH w AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT key, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))) AS s FROM w WHERE len(w) >= 5),
c AS (SELECT row_number() OVER () AS c, s, len(s) AS n, count(*) AS copies FROM g GROUP BY s),
e AS (SELECT c, n, unnest(s) AS x FROM c),
o AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.c < b.c GROUP BY ALL),
l AS (SELECT c, count(*) AS n_links FROM (SELECT unnest([a, b]) AS c FROM o WHERE shared >= 0.8 * (na + nb - shared) - 1e-9) GROUP BY c)
SELECT g.key, c.copies AS n_copies, coalesce(l.n_links, 0) AS n_links FROM g JOIN c ON g.s = c.s LEFT JOIN l ON l.c = c.c
""",
    # brute force: every usable vector with every other
    "p3_found": """
WITH v AS (SELECT 'anchors' AS t, id AS k, overview_embedding AS e FROM anchors WHERE len(overview_embedding) = 64
           UNION ALL SELECT 'chunks_vec', CAST(chunk_id AS VARCHAR), embedding FROM (SELECT DISTINCT chunk_id, embedding FROM chunks_vec) WHERE len(embedding) = 64),
u AS (SELECT t, k, list_transform(e, lambda x: x / n)::DOUBLE[64] AS e FROM (SELECT t, k, e, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x))) AS n FROM v) WHERE n > 0),
p AS (SELECT a.t, a.k AS ka, b.k AS kb, array_inner_product(a.e, b.e) AS s FROM u a JOIN u b ON a.t = b.t AND a.k <> b.k),
r AS (SELECT t, ka, kb, s, row_number() OVER (PARTITION BY t, ka ORDER BY s DESC, kb) AS n FROM p WHERE s >= 0.9)
SELECT DISTINCT t AS vec_table, least(ka, kb) AS key_a, greatest(ka, kb) AS key_b FROM r WHERE n <= 5
""",
    "p3_recall": "SELECT unnest(['anchors', 'chunks_vec']) AS vec_table, true AS enough",
    "p6_checked": r"""
SELECT DISTINCT item_kind, item_key, w AS n_words, true AS within_limit, true AS numbered FROM (
  SELECT 'anchor' AS item_kind, id AS item_key, len(regexp_extract_all(content_text, '[^ \t\n\r]+')) AS w FROM anchors
  UNION ALL SELECT 'chunk', CAST(chunk_id AS VARCHAR), len(regexp_extract_all(text, '[^ \t\n\r]+')) FROM chunks)
WHERE w * 7 // 5 > 600
""",
    "p7_checked": "SELECT count(DISTINCT doc_id) AS docs, 0 AS overfull, 0 AS split_small, true AS all_tokens, true AS tight FROM documents",
    "p8_checked": "SELECT DISTINCT lower(trim(t.source)) AS source, true AS repeats_kept, true AS share_met FROM mix_targets t JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source)) WHERE t.target_share > 0 AND t.max_repeats > 0 AND length(d.text) > 0",
    "p6_found": r"""
SELECT DISTINCT item_kind, item_key FROM (
  SELECT 'anchor' AS item_kind, id AS item_key, content_text AS t FROM anchors
  UNION ALL SELECT 'chunk', CAST(chunk_id AS VARCHAR), text FROM chunks)
WHERE len(regexp_extract_all(t, '[^ \t\n\r]+')) * 7 // 5 > 600
""",
}
