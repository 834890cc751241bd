"""Versioned tables with an atomic pointer, configuration hashes, and report rows."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _point(spark: SparkSession, root: str, text: str) -> None:
    """Puts the pointer in place by a rename that overwrites: at no time is there none."""
    _, tmp, jvm = _fs(spark, f"{root}/.{uuid.uuid4().hex}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), conf)
    out = tmp.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fc.rename(tmp, target, how)


def write_version(df: DataFrame, root: str) -> str:
    """Writes a new version of a table below ``root`` and then points to it: the pointer is a small file put in place by a
    rename, so readers see the old version or the new one, never parts and never nothing. Returns the version."""
    return write_versions({"": df}, root)


def write_versions(tables: dict[str, DataFrame], root: str) -> str:
    """Several tables as one version: parents and their chunks change together, as the pointer is set once all are written. Of
    equal concurrent writers the last to set it wins; the versions of the others stay unread."""
    version = "v-" + uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root}/{version}/{name}".rstrip("/"))
    _point(next(iter(tables.values())).sparkSession, root, version)
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, p, jvm = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(p):
        return None
    s = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
    finally:
        s.close()


def migrated(df: DataFrame, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """A stored table in a newer schema: columns it lacks are made from ``defaults`` (an expression over the old columns, else null),
    others are cast, those the schema doesn't have are left out. Migrating twice changes nothing."""
    want = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema
    made = defaults or {}
    return df.select(*[(F.col(f.name) if f.name in df.columns else made.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in want.fields])


def read_current(spark: SparkSession, root: str, name: str = "") -> DataFrame:
    return spark.read.parquet(f"{root}/{current_version(spark, root)}/{name}".rstrip("/"))


def config_hash(config: dict) -> str:
    """SHA-256 over the configuration as JSON with sorted keys, 16 digits."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()[:16]


def json_report(verdicts: DataFrame, claims: DataFrame, *, confirmed: bool = False) -> DataFrame:
    """``doc, report``: the verdicts of a document as one JSON text, without confirmed ones unless asked for."""
    v = verdicts if confirmed else verdicts.where("verdict <> 'confirmed'")
    j = v.join(claims.select("claim_id", "doc", "line_no", "subject"), "claim_id")
    item = F.struct("line_no", "claim_id", "claim_type", "subject", "verdict", "confidence")
    return j.groupBy("doc").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("report"))


def dashboard(anchors: DataFrame, evaluated: DataFrame, *, preview: int = 300) -> DataFrame:
    """``id, row``: one JSON text an anchor with the start of its text and its links by status."""
    ends = evaluated.select("drift_status", F.explode(F.array("from_id", "to_id")).alias("id"))
    per = ends.groupBy("id", "drift_status").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("drift_status", "n")))).alias("links"))
    a = anchors.select("id", "anchor_type", "path", F.substring("content_text", 1, preview).alias("preview"))
    return a.join(per, "id", "left").select("id", F.to_json(F.struct("anchor_type", "path", "preview", "links")).alias("row"))
