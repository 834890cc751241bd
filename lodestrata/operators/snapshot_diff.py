"""What changed between consecutive full snapshots.

Rows of every snapshot are sorted by key and cut into content-defined chunks: a chunk ends after each key whose hash
is a multiple of ``chunk_rows``, so an insertion moves no boundary but its own. A chunk whose digest also occurs in
the neighbouring snapshot is discarded; only rows of chunks without a counterpart are joined by key and classified.

Shuffles: one range shuffle by (series, key), which splits a hot series over many tasks and puts all versions of a key
into one, so that rows of one key are told apart, chunks cut and digests compared without another; and one of the few
rows left. Repeats of a row are dropped batch by batch before it, so a row given very often is no hot key. Rows are hashed
in the JVM; a digest is the sum of two 64-bit hashes of its rows, made for all chunks of a snapshot at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import normal_path
from lodestrata.session import materialize

CHUNK_ROWS = 8
#: Runs up to which they are sent to all tasks (about 50 MB); beyond it rows are joined with their runs by a shuffle.
MOST_RUNS = 500_000


def ordered_runs(runs: DataFrame, *, run_id: str, series: list[str], order_by: str) -> DataFrame:
    """One row per run: ``_run``, ``_series`` (id of the first run of its series), ``_seq`` from 1, ``_next`` (null for
    the last). A run given more than once counts with its greatest ``order_by``; runs of equal ``order_by`` are
    ordered by id; null series values form a series of their own; runs with a null id are left out."""
    one = (
        runs.where(F.col(run_id).isNotNull())
        .select(F.col(run_id).alias("_run"), F.struct(F.col(order_by).alias("o"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(series)]).alias("v"))
        .groupBy("_run")
        .agg(F.max("v").alias("v"))
    )
    w = Window.partitionBy(*[f"v.s{i}" for i in range(len(series))]).orderBy(F.col("v.o").asc_nulls_first(), "_run")
    return one.select("_run", F.first("_run").over(w).alias("_series"), F.row_number().over(w).alias("_seq"), F.lead("_run").over(w).alias("_next"))


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch that have one run and key, the one with the greatest version, then the greatest value."""
    for b in batches:
        if not b.num_rows:
            continue
        if pa.types.is_nested(b.schema.field("_ver").type):  # sorted by Spark only
            yield b
            continue
        d = b.select(["_run", "_key"]).to_pandas()
        again = d.duplicated(keep=False).to_numpy()
        if not again.any():
            yield b
            continue
        some = b.filter(pa.array(again))
        first = pc.sort_indices(some, [("_run", "ascending"), ("_key", "ascending"), ("_ver", "descending"), ("_value", "descending")], null_placement="at_end")
        some = some.take(first)
        kept = ~some.select(["_run", "_key"]).to_pandas().duplicated().to_numpy()
        yield from (b.filter(pa.array(~again)), some.filter(pa.array(kept)))


def _chunks(h1: np.ndarray, h2: np.ndarray, ends: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Digest (sums of both hashes, and rows) and rows of every chunk of key-sorted rows."""
    starts = np.append(0, np.flatnonzero(ends[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(ends)))
    sums = (np.add.reduceat(h.view(np.uint64), starts) for h in (h1, h2))
    return list(zip(*(x.tolist() for x in sums), sizes.tolist())), sizes


class _Run:
    """The rows of one snapshot in one key range: by chunk their number and digest."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(parts).combine_chunks()
        self.series, self.seq, self.run, self.next = (t[c][0].as_py() for c in ("_series", "_seq", "_run", "_next"))
        self.keys, self.values = t["_key"], t["_value"]
        self.digests, self.sizes = _chunks(*(t[c].to_numpy() for c in ("_h1", "_h2", "_end")))

    def rows(self, unlike: set) -> tuple[pa.ChunkedArray, pa.ChunkedArray] | None:
        """Keys and values of the chunks whose digest isn't in ``unlike``."""
        keep = np.array([d not in unlike for d in self.digests], dtype=bool)
        if not keep.any():
            return None
        mask = pa.array(np.repeat(keep, self.sizes))
        return self.keys.filter(mask), self.values.filter(mask)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """Snapshots in turn, from batches sorted by (_series, _seq, _key)."""
    parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        run = b.column(b.schema.get_field_index("_run"))
        code = pc.dictionary_encode(run).indices.to_numpy()
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            now = run[x].as_py()
            if parts and now != last:
                yield _Run(parts)
                parts = []
            parts.append(b.slice(x, y - x))
            last = now
    if parts:
        yield _Run(parts)


def _unmatched(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of chunks without a counterpart; holds two snapshots' rows of one key range at a time."""
    out: list[pa.Table] = []
    held = 0

    def put(run: object, new: bool, rows: tuple[pa.ChunkedArray, pa.ChunkedArray] | None) -> None:
        nonlocal held
        if rows is not None:
            n = len(rows[0])
            out.append(pa.table([pa.array([run] * n, type=schema.field("_run").type), rows[0].cast(pa.string()), pa.array(np.full(n, new)), rows[1].cast(pa.string())], schema=schema))
            held += n

    def compare(old: _Run | None, new: _Run | None) -> None:
        """The two runs' rows in this key range; either may have none here."""
        later = new.run if new else old.next
        if old:
            put(later, False, old.rows(set(new.digests) if new else set()))
        if new:
            put(later, True, new.rows(set(old.digests) if old else set()))

    prev: _Run | None = None
    for cur in _runs(batches):
        adjacent = prev is not None and prev.series == cur.series and prev.seq + 1 == cur.seq
        if prev is not None and not adjacent and prev.next is not None:
            compare(prev, None)
        if adjacent:
            compare(prev, cur)
        elif cur.seq > 1:
            compare(None, cur)
        prev = cur
        if held >= 10_000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out, held = [], 0
    if prev is not None and prev.next is not None:
        compare(prev, None)
    if held:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def snapshot_changes(
    items: DataFrame,
    runs: DataFrame,
    *,
    run_id: str,
    series: list[str],
    order_by: str,
    key: str,
    value: str,
    version: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Changes of every run against the run before it in its series: ``run_id, item_key, change_kind, old_value,
    new_value`` (values as text), change_kind being added, removed or changed.

    ``items`` holds the full rows of all snapshots (``run_id``, ``key``, ``value``), ``runs`` the snapshots that count;
    rows of other runs are ignored. Of several rows of one key in one run the greatest ``version`` decides, then the
    greatest value. Null keys are ignored, as no row can be told by them; a null value equals a null value only. The
    first run of a series has no changes; a run without rows removes everything. Empty inputs give an empty result.
    Other columns of both inputs are not looked at and may have any name.
    """
    rk = runs.schema[run_id].dataType
    ordered = materialize(ordered_runs(runs, run_id=run_id, series=series, order_by=order_by))
    known = F.broadcast(ordered) if ordered.count() <= MOST_RUNS else ordered
    ver: Column = F.col(version) if version else F.lit(0)
    from pyspark.sql.pandas.types import to_arrow_type

    raw = items.where(F.col(key).isNotNull() & F.col(run_id).isNotNull()).select(F.col(run_id).cast(rk).alias("_run"), F.col(key).cast("string").alias("_key"), ver.alias("_ver"), F.col(value).cast("string").alias("_value"))
    placed = raw.mapInArrow(_fewer, raw.schema).join(known, "_run").repartitionByRange(F.col("_series"), F.col("_key"))
    # grouped by what they are partitioned by and more, and sorted by that: neither takes another shuffle or sort
    by = ["_series", "_seq", "_run", "_next", "_key"]
    one = placed.groupBy(*by).agg(F.max(F.struct("_ver", "_value"))["_value"].alias("_value")).sortWithinPartitions(*by)
    hashed = one.select(*by, "_value", (F.pmod(F.xxhash64("_key"), F.lit(chunk_rows)) == 0).alias("_end"), F.xxhash64("_key", "_value").alias("_h1"), F.xxhash64(F.lit(1), "_key", "_value").alias("_h2"))
    schema = pa.schema([("_run", to_arrow_type(rk)), ("_key", pa.string()), ("_new", pa.bool_()), ("_value", pa.string())])
    left = hashed.mapInArrow(lambda it: _unmatched(it, schema), f"_run {rk.simpleString()}, _key string, _new boolean, _value string")
    both = left.groupBy("_run", "_key").agg(
        F.max(F.col("_new")).alias("in_new"),
        F.min(F.col("_new")).alias("only_new"),
        F.max(F.when(F.col("_new"), F.col("_value"))).alias("new_value"),
        F.max(F.when(~F.col("_new"), F.col("_value"))).alias("old_value"),
    )
    kind = F.when(F.col("only_new"), "added").when(~F.col("in_new"), "removed").when(~F.col("new_value").eqNullSafe(F.col("old_value")), "changed")
    return both.select(F.col("_run").alias(run_id), F.col("_key").alias("item_key"), kind.alias("change_kind"), "old_value", "new_value").where(F.col("change_kind").isNotNull())


def normal_hash(c: Column) -> Column:
    """The 64 hex digits in lower case; text without them is kept, trimmed and lowered, so it equals itself only."""
    hit = F.regexp_extract(c, r"([0-9A-Fa-f]{64})\s*$", 1)
    return F.when(c.isNull(), None).when(hit != "", F.lower(hit)).otherwise(F.lower(F.trim(c)))


def counted_runs(index_metadata: DataFrame) -> DataFrame:
    """Runs that count: those with a manifest. Text that can't be a JSON object is none, so such a run has failed, like one without
    a manifest. Manifest texts are not shuffled."""
    return index_metadata.where(F.col("indexed_file_manifest").rlike(r"(?s)\A\s*\{.*\}\s*\z")).select("index_id", "repo", "indexed_branch", "updated_at").distinct()


def manifest_items(index_metadata: DataFrame) -> DataFrame:
    """One row per file of a manifest: ``index_id, item_key, item_hash``, path and hash in normal form. A manifest that
    is no JSON object gives no rows."""
    m = F.from_json("indexed_file_manifest", "map<string,string>")
    return (
        index_metadata.where(F.col("indexed_file_manifest").isNotNull())
        .select("index_id", "updated_at", F.explode(m).alias("p", "h"))
        .select("index_id", "updated_at", normal_path(F.col("p")).alias("item_key"), normal_hash(F.col("h")).alias("item_hash"))
    )


def index_changes(index_metadata: DataFrame, anchor_snapshots: DataFrame) -> DataFrame:
    """Files and anchors added, removed or changed from one index run to the next: ``index_id, grain, item_key,
    change_kind``."""
    runs = counted_runs(index_metadata)
    args = {"run_id": "index_id", "series": ["repo", "indexed_branch"], "order_by": "updated_at"}
    files = snapshot_changes(manifest_items(index_metadata), runs, key="item_key", value="item_hash", version="updated_at", **args)
    seen = anchor_snapshots.select("index_id", "anchor_id", normal_hash(F.col("content_hash")).alias("item_hash"), "written_at")
    anchors = snapshot_changes(seen, runs, key="anchor_id", value="item_hash", version="written_at", **args)
    cols = ["item_key", "change_kind"]
    return files.select("index_id", F.lit("file").alias("grain"), *cols).unionByName(anchors.select("index_id", F.lit("anchor").alias("grain"), *cols))
