"""Tolerant lookups, link listings, checks of a table's ids, line differences, and what tests and enums sources hold."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import spread


def repaired_ids(asked: DataFrame, anchors: DataFrame) -> DataFrame:
    """``asked, id``: the anchor meant by an id: itself, with ``::`` as ``:``, with its first ``:`` as ``::``, or with all colons
    after the path doubled; the first form that exists. One equi join over the forms."""
    a = F.col("asked")
    single = F.regexp_replace(a, "::", ":")
    first = F.regexp_replace(single, r"^([^:]*):", "$1::")
    path, rest = F.substring_index(a, ":", 1), F.expr("substring(asked, length(substring_index(asked, ':', 1)) + 1)")
    doubled = F.concat(path, F.regexp_replace(rest, ":+", "::"))
    forms = asked.select("asked").distinct().select("asked", F.posexplode(F.array(a, single, first, doubled)).alias("n", "id"))
    hit = forms.join(anchors.select("id"), "id", "left_semi")
    return asked.select("asked").distinct().join(hit.groupBy("asked").agg(F.min_by("id", "n").alias("id")), "asked", "left")


def get_links(evaluated: DataFrame, anchor: str, *, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Links of one anchor with their direction and drift; both filters reach the scan."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction: {direction}")
    e = evaluated.where(F.col("link_type").isin(types)) if types else evaluated
    out = e.where(F.col("from_id") == anchor).withColumn("direction", F.lit("outgoing"))
    into = e.where(F.col("to_id") == anchor).withColumn("direction", F.lit("incoming"))
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def invalid_anchors(anchors: DataFrame) -> DataFrame:
    """``id, problems``: ids in a wrong form, absolute paths, closures on other than code, ids given twice."""
    again = F.count("*").over(Window.partitionBy("id")) > 1
    checks = [
        F.when(F.col("id").isNull() | ~F.col("id").rlike(r"^[^\s:][^\n]*$") | (F.length("id") > 2048), "id"),
        F.when(F.col("path").isNull() | F.col("path").rlike(r"^(/|[A-Za-z]:)|\\"), "path"),
        F.when((F.col("anchor_type") != "code") & (F.col("closure_hash").isNotNull() | F.col("transitive_hash_status").isNotNull()), "closure on other than code"),
        F.when(F.col("_again"), "id given twice"),
    ]
    return anchors.withColumn("_again", again).select("id", F.array_compact(F.array(*checks)).alias("problems")).where(F.size("problems") > 0)


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Line difference of two texts; null where either is null."""
    return pd.Series(["\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "old", "new", lineterm="")) if a is not None and b is not None else None for a, b in zip(old, new)], dtype=object)


_TEST_CALL = re.compile(r"(?<![\w.])(describe|it|test)(?:\.(?:only|skip|each|concurrent))*\s*\(\s*(['\"`])((?:\\.|(?!\2)[^\\])*)\2")


def _calls(text: str) -> list[tuple[str, str, int]]:
    """(kind, title path, start) of test calls, nested by the parentheses they stand in."""
    out, stack = [], []
    hits = {m.start(): m for m in _TEST_CALL.finditer(text)}
    depth, i, quote = 0, 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                break
        else:
            if i in hits:
                m = hits[i]
                stack = [x for x in stack if x[0] <= depth]
                out.append((m.group(1), "::".join([*[x[1] for x in stack], m.group(3)]), i))
                stack.append((depth + 1, m.group(3)))
            if c in "'\"`":
                quote = c
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                stack = [x for x in stack if x[0] <= depth]
        i += 1
    return out


def test_calls(files: DataFrame) -> DataFrame:
    """``path, kind, title, start`` of describe, it and test calls in script sources (``path, text``)."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *c) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in _calls(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["path", "kind", "title", "start"])

    return spread(files.where("text is not null and path rlike '[.](ts|tsx|js|jsx)$'").select("path", "text")).mapInArrow(op, "path string, kind string, title string, start int")


def _enums(text: str) -> list[tuple[str, list[str]]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef) and any(ast.unparse(b).rpartition(".")[2] in ("Enum", "StrEnum", "IntEnum", "Flag", "IntFlag") for b in n.bases):
            names = [t.id for s in n.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)]
            out.append((n.name, [x for x in names if not x.startswith("_")]))
    return out


def enums(files: DataFrame) -> DataFrame:
    """``path, name, members`` of enum classes in Python sources (``path, text``)."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *e) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in _enums(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.list_(pa.string())))], names=["path", "name", "members"])

    return spread(files.where("text is not null and path like '%.py'").select("path", "text")).mapInArrow(op, "path string, name string, members array<string>")
