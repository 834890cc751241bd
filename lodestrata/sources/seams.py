"""Seams to what a repository lives in: version control, language servers, caches of what they answer, and sinks that push.

Each is a small protocol with a deterministic stand-in; observers, clocks and transports are arguments, so all runs without
the real thing."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Generic, Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import write_versions

K, V = TypeVar("K"), TypeVar("V")


class Git(Protocol):
    """What is asked of version control; ``status`` gives the bytes of a porcelain status with NUL ends."""

    def head(self) -> str | None: ...
    def branch(self) -> str | None: ...
    def status(self) -> bytes: ...
    def changed(self, old: str, new: str) -> list[str] | None: ...


class StaticGit:
    """A state given beforehand."""

    def __init__(self, head: str | None = None, branch: str | None = None, status: bytes = b"", changed: dict[tuple[str, str], list[str]] | None = None) -> None:
        self._head, self._branch, self._status, self._changed = head, branch, status, changed or {}

    def head(self) -> str | None:
        return self._head

    def branch(self) -> str | None:
        return self._branch

    def status(self) -> bytes:
        return self._status

    def changed(self, old: str, new: str) -> list[str] | None:
        return self._changed.get((old, new))


def dirty_files(status: bytes) -> list[str]:
    """Paths of a status whose entries end with NUL: of a rename or copy the new path, whose old one follows it; untracked and
    ignored files are none."""
    parts = status.decode("utf-8", "surrogateescape").split("\0")
    out, i = [], 0
    while i < len(parts):
        x = parts[i]
        i += 1
        if len(x) < 4:
            continue
        i += x[0] in "RC" or x[1] in "RC"
        if x[:2] not in ("??", "!!"):
            out.append(x[3:])
    return sorted(set(out))


def git_state(spark: SparkSession, git: Git, repo: str) -> tuple[DataFrame, DataFrame]:
    """``repo, head, branch`` (one row) and ``repo, path`` of the dirty files, as ``incremental.staleness`` takes them."""
    one = spark.createDataFrame([(repo, git.head(), git.branch())], "repo string, head string, branch string")
    return one, spark.createDataFrame([(repo, p) for p in dirty_files(git.status())], "repo string, path string")


def changed_files(spark: SparkSession, git: Git, repo: str, old: str, manifest: DataFrame) -> DataFrame:
    """``repo, path`` of what changed since a head; all files of the manifest where version control can't tell."""
    new = git.head()
    paths = git.changed(old, new) if new is not None and old != new else []
    if paths is None:
        return manifest.where(F.col("repo") == repo).select("repo", "path").distinct()
    return spark.createDataFrame([(repo, p.strip()) for p in sorted(set(paths)) if p.strip()], "repo string, path string")


class Cached(Generic[V]):
    """An answer that is asked for again after ``seconds``, or once it is declared invalid."""

    def __init__(self, ask: Callable[[], V], seconds: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self._ask, self._seconds, self._clock = ask, seconds, clock
        self._value: V | None = None
        self._at: float | None = None

    def get(self) -> V:
        if self._at is None or self._clock() - self._at >= self._seconds:
            self._value, self._at = self._ask(), self._clock()
        return self._value  # type: ignore[return-value]

    def invalidate(self) -> None:
        self._at = None


class Recent(Generic[K, V]):
    """The ``most`` answers used last, by token: a request sent again gets the answer of the first time."""

    def __init__(self, most: int = 1000) -> None:
        self._most, self._held = most, OrderedDict[K, V]()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, token: K, make: Callable[[], V]) -> V:
        if token in self._held:
            self._held.move_to_end(token)
            return self._held[token]
        out = self._held[token] = make()
        while len(self._held) > self._most:
            self._held.popitem(last=False)
        return out


class LanguageAdapter(Protocol):
    """A language server's side: edges (src, dst, kind) of some anchors of its languages."""

    languages: frozenset[str]

    def outgoing(self, anchors: pd.DataFrame) -> list[tuple[str, str, str]]: ...


def edges_of(anchors: DataFrame, adapters: list[LanguageAdapter]) -> tuple[DataFrame, DataFrame]:
    """``src, dst, kind`` of code anchors (``id, path, content_text``) by the adapter of each one's language, and the ``id`` of those whose
    adapter failed: a batch that fails doesn't take others with it. Anchors without an adapter are in neither."""
    from lodestrata.functions.text import language

    by = {lang: a for a in adapters for lang in a.languages}
    rows = anchors.select("id", "path", "content_text", language(F.col("path")).alias("lang")).where(F.col("lang").isin(list(by)))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, some in part.groupby("lang"):
                try:
                    got = by[lang].outgoing(some)
                    yield pd.DataFrame([(*e, False) for e in got], columns=["src", "dst", "kind", "failed"])
                except Exception:  # noqa: BLE001
                    yield pd.DataFrame({"src": some["id"], "dst": None, "kind": None, "failed": True})

    out = rows.mapInPandas(ask, "src string, dst string, kind string, failed boolean")
    return out.where("not failed").select("src", "dst", "kind"), out.where("failed").select(F.col("src").alias("id"))


# Folders where documents are looked for.
DOC_FOLDERS = ["docs", "doc", "documentation"]


def doc_files(files: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Markdown files (``path``) of the given paths, which are files (.md, .mdx) or folders, or of the usual folders."""
    p = F.col("path")
    md = F.lower(p).endswith(".md") & ~p.rlike(r"(?:^|/)\.git/")
    ok = F.lit(False)
    for x in DOC_FOLDERS if paths is None else paths:
        ok = ok | (F.startswith(p, F.lit(x.rstrip("/") + "/")) & md)
        if paths is not None:
            ok = ok | ((p == x) & p.rlike(r"(?i)\.mdx?$"))
    return files.where(ok)


def cached_index(files: DataFrame, cache: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Index rows (with ``path, mtime``) of all files (``path, mtime``): those in the cache for the same time are kept, ``build`` makes those of
    the other files. Files that are gone leave it."""
    now = files.select("path", "mtime").distinct()
    kept = cache.join(now, ["path", "mtime"], "left_semi")
    rest = files.join(cache.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")
    return kept.unionByName(build(rest).select(*cache.columns))


def push_snapshots(stream: DataFrame, root: str, checkpoint: str, told: Callable[[str], None], *, every: str = "5 seconds", once: bool = False):
    """Writes each state of a streaming aggregate as a version below ``root`` and tells its name; a batch without change is not told."""

    def push(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            told(write_versions({"": batch}, root))

    w = stream.writeStream.outputMode("complete").foreachBatch(push).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
