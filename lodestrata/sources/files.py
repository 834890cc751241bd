"""Repository files and event logs as DataFrames, and the writers of reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import file_kind

MAX_BYTES = 5_242_880
#: Folders that hold no sources.
NOISE = r"(?:^|/)(?:\.git|node_modules|__pycache__|\.venv|venv|dist|build|target|\.mypy_cache|\.pytest_cache)(?:/|$)"


def skip_reason(content: Column, most: int = MAX_BYTES) -> Column:
    """Why a file is left out: empty, oversize, of another encoding; null if it isn't."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(F.length(content) == 0, "empty").when(F.length(content) > most, "oversize").when(head.isin("FFFE", "FEFF"), "utf-16").when(~F.is_valid_utf8(content.cast("string")), "not-utf-8")


def folders(spark: SparkSession, root: str) -> list[str]:
    """``root`` and the folders below it, sorted, without noise folders: these are not entered. Only folders' names come to the
    driver, as they do for Spark's own listing."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [at]
    while todo:
        p = todo.pop()
        out.append(p.toUri().getPath())
        todo += [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and not re.search(NOISE, s.getPath().getName())]
    return sorted(out)


def repository(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, kind, skip_reason`` of all files under ``root``; noise folders are pruned before they are listed. Contents are
    read only where a later step asks for them. Files without a byte are not listed by Spark's file source."""
    raw = spark.read.format("binaryFile").load(folders(spark, root))
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base), "")
    out = raw.select(rel.alias("path"), "content").where(~F.col("path").rlike(NOISE))
    return out.select("path", "content", file_kind(F.col("path")).alias("kind"), skip_reason(F.col("content")).alias("skip_reason"))


def frontmatter(text: Column) -> tuple[Column, Column, Column]:
    """``type``, ``id`` and ``skip`` of a leading block between lines of three dashes; nulls where there is none. Only plain
    ``key: value`` lines are understood; anything else in the block is passed over."""
    block = F.regexp_extract(text, r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    get = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{k}[ \t]*:[ \t]*(.*?)[ \t]*$", 1), r"^['\"]|['\"]$", "")), F.lit(""))
    return get("type"), get("id"), F.coalesce(F.lower(get("skip")).isin("true", "yes", "on"), F.lit(False))


EVENT_SCHEMA = "op string, link_id string, event_id string, ts timestamp, from_id string, from_type string, to_id string, to_type string, type string, supersedes string, created_by string"


def event_log(spark: SparkSession, path: str, layer: int) -> DataFrame:
    """JSON lines of one log in file order: the fields, ``layer`` and ``pos``; lines that are no JSON objects are left out.
    Order matters within a file, so a file is read whole, files in parallel."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    rec = text.where(F.trim("line") != "").select("file", "n", F.from_json("line", EVENT_SCHEMA).alias("r"))
    return rec.where("r.event_id is not null").select("r.*", F.lit(layer).alias("layer"), F.struct("file", "n").alias("pos"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends records to a log kept as a table; the commit of the files is atomic."""
    events.write.mode("append").parquet(path)


def sarif(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """``result`` and ``rule``: one SARIF 2.1.0 result a row for what isn't confirmed; a document is assembled by the caller
    from as many rows as it wants in one file."""
    level = F.when(F.col("verdict") == "contradicted", "error").when(F.col("verdict").isin("incomplete", "stale_target"), "warning").otherwise("note")
    j = verdicts.where("verdict <> 'confirmed'").join(claims.select("claim_id", "doc", "line_no", "subject"), "claim_id")
    rule = F.concat(F.lit("claims/"), F.col("claim_type"))
    where_ = F.array(F.struct(F.struct(F.struct(F.col("doc").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation")))
    return j.select("claim_id", rule.alias("rule"), F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(F.col("subject").alias("text")).alias("message"), where_.alias("locations"))).alias("result"))


def sarif_document(results: DataFrame) -> DataFrame:
    """One row with the whole document; for reports of a size that one file holds."""
    rules = F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.struct(r.alias("id")))
    body = F.array_join(F.array_sort(F.collect_list("result")), ",")
    return results.agg(F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"lodestrata","rules":'), F.to_json(rules), F.lit('}},"results":['), body, F.lit("]}]}")).alias("sarif"))


def annotations(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """``::level file=..,line=..::message`` of what isn't confirmed."""
    level = F.when(F.col("verdict") == "contradicted", "error").otherwise("warning")
    j = verdicts.where("verdict <> 'confirmed'").join(claims.select("claim_id", "doc", "line_no", "subject"), "claim_id")
    return j.select("claim_id", F.format_string("::%s file=%s,line=%d::%s %s", level, F.replace(F.col("doc").cast("string"), F.lit("\\"), F.lit("/")), F.col("line_no").cast("int"), F.col("verdict"), F.regexp_replace("subject", r"\s+", " ")).alias("annotation"))


def summary_table(verdicts: DataFrame) -> DataFrame:
    """Rows of a Markdown table of verdicts by claim type."""
    g = verdicts.groupBy("claim_type", "verdict").agg(F.count("*").alias("n"))
    return g.select("claim_type", "verdict", F.concat(F.lit("| "), F.concat_ws(" | ", "claim_type", "verdict", F.col("n").cast("string")), F.lit(" |")).alias("row"))
