"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit any size; the number of shuffle partitions is left to the caller and to adaptive execution.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lodestrata", master: str | None = None, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Where that is unset (tests,
    a single machine) a folder of this machine is made and set; it goes when the process ends."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, *, partitions_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and returns a scan of it. The scan has no lineage into what
    made it, so a lost executor costs a read of the files and never a recomputation; unlike an RDD checkpoint it
    is columnar and prunes."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    w = df.write.mode("error").option("compression", "zstd")
    if partitions_by:
        w = w.partitionBy(*partitions_by)
    w.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _names(plan) -> set[str]:
    out = {plan.nodeName()}
    kids = plan.children()
    for i in range(kids.size()):
        out |= _names(kids.apply(i))
    return out


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work that is heavy per row: a scan of fewer partitions than the session has cores (one small file) is
    dealt out first. Where data is large there are more partitions than cores and nothing is moved. Anything but filtered
    scans is left as it is: to count its partitions would run it."""
    if any(n.split()[0] not in ("Project", "Filter", "Relation", "LogicalRelation", "LocalRelation", "LogicalRDD", "Union") for n in _names(scan._jdf.queryExecution().optimizedPlan())):
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
