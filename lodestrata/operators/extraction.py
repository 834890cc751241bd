"""Addressable units of documents and sources: sections and code blocks of Markdown, symbols of code."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.code_trees import LANGUAGES, Declaration, Function, declarations, functions
from lodestrata.session import spread

MAX_DEPTH = 4
_FENCE = re.compile(r"^\s*(```+|~~~+)\s*([\w+-]*)")
_HEADING = re.compile(r"^(#{1,6})\s+(\S.*?)\s*$")
_CLOSING = re.compile(r"\s+#+$")
_DECL = re.compile(r"^\s*(?:export\s+|pub\s+|async\s+|default\s+)*(?:def|class|function|fn|func|interface|type|const|let|var)\s+([A-Za-z_$][\w$]*)", re.M)
_INLINE = [(re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"[`*]+"), ""), (re.compile(r"(?<!\w)_+|_+(?!\w)"), "")]


def inline_text(title: str) -> str:
    for pattern, by in _INLINE:
        title = pattern.sub(by, title)
    return title.strip()


def slug(text: str) -> str:
    """Letters after compatibility decomposition without those outside ASCII, lower case, runs of others as one dash."""
    s = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    s = re.sub(r"[^a-z0-9]+", "-", s).strip("-")
    return s or "section-" + hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:8]


def unique(names: list[str]) -> list[str]:
    """The n-th of equal names gets ``-n``, with the next number where that name is taken by the input or given out."""
    taken, seen, out = set(names), {}, []
    for n in names:
        k = seen.get(n, 0) + 1
        while k > 1 and f"{n}-{k}" in taken:
            k += 1
        seen[n] = k
        out.append(n if k == 1 else f"{n}-{k}")
        taken.add(out[-1])
    return out


def outline(text: str) -> tuple[list[tuple], list[tuple]]:
    """Headings as (level, title, start line, end line, path of titles) and code blocks as (start, end, info, body, index of
    the heading above or -1). Lines count from 1; a section ends before the next heading of its level or above."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    heads, blocks, fence, start = [], [], None, 0
    for i, line in enumerate(lines, 1):
        m = _FENCE.match(line)
        if m:
            if fence is None:
                fence, info, start = m.group(1), m.group(2), i
            else:
                blocks.append((start, i, info, "\n".join(lines[start : i - 1]), len(heads) - 1))
                fence = None
            continue
        if fence is None and (h := _HEADING.match(line)):
            heads.append([len(h.group(1)), inline_text(_CLOSING.sub("", h.group(2))), i])
    if fence is not None:
        blocks.append((start, len(lines), info, "\n".join(lines[start:]), len(heads) - 1))
    out, stack = [], []
    for k, (level, title, at) in enumerate(heads):
        end = next((heads[j][2] - 1 for j in range(k + 1, len(heads)) if heads[j][0] <= level), len(lines))
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        out.append((level, title, at, end, [t for _, t in stack]))
    return out, blocks


MARKDOWN = "doc string, anchor_type string, anchor_id string, heading_path array<string>, level int, symbol_name string, start_line int, end_line int, content_text string"
_MD_ARROW = pa.schema([("doc", pa.string()), ("anchor_type", pa.string()), ("anchor_id", pa.string()), ("heading_path", pa.list_(pa.string())), ("level", pa.int32()), ("symbol_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content_text", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _markdown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                heads, blocks = outline(text)
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                kept = [k for k, h in enumerate(heads) if h[0] <= MAX_DEPTH]
                paths = unique(["::".join(slug(t) for t in heads[k][4]) for k in kept])
                ids = {k: f"{doc}::{p}" for k, p in zip(kept, paths)}
                for k in kept:
                    level, title, at, end, path = heads[k]
                    yield doc, "section", ids[k], path, level, None, at, end, "\n".join(lines[at - 1 : end])
                named = [(x, m.group(1)) for x in blocks if (m := _DECL.search(x[3]))]
                above = [next((j for j in range(x[4], -1, -1) if j in ids), None) for x, _ in named]
                names = unique([f"{ids[j] if j is not None else doc}#{n}" for (_, n), j in zip(named, above)])
                for ((start, end, _info, body, _), n), j, i in zip(named, above, names):
                    yield doc, "code_in_doc", i, heads[j][4] if j is not None else [], 0, n, start, end, body

    yield from _batches(rows(), _MD_ARROW)


def markdown_anchors(docs: DataFrame) -> DataFrame:
    """Sections (to heading level 4) and named code blocks of documents (``doc, text``), in one pass without a shuffle. Null
    texts give nothing."""
    return spread(docs.where("doc is not null and text is not null").select(F.col("doc").cast("string"), "text")).mapInArrow(_markdown, MARKDOWN)


SYMBOLS = "path string, language string, symbol_name string, qualified_name string, depth int, start int, stop int, is_documented boolean"
_SYM_ARROW = pa.schema([("path", pa.string()), ("language", pa.string()), ("symbol_name", pa.string()), ("qualified_name", pa.string()), ("depth", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("is_documented", pa.bool_())])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def visit(path: str, lang: str, nodes: list[Function], outer: list[str]) -> Iterator[tuple]:
        for n in nodes:
            yield path, lang, n.name, ".".join([*outer, n.name]), len(outer), n.start, n.end, bool(n.doc)
            yield from visit(path, lang, n.inner, [*outer, n.name])

    def rows() -> Iterator[tuple]:
        for b in batches:
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                yield from visit(path, lang, functions(text, lang)[0], [])

    yield from _batches(rows(), _SYM_ARROW)


def code_symbols(files: DataFrame) -> DataFrame:
    """Named functions and methods, nested ones with their outer names, of source files (``path, text``)."""
    end = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[end]
    return spread(files.where("text is not null").select("path", lang.alias("language"), "text").where("language is not null")).mapInArrow(_code, SYMBOLS)


DECLARATIONS = "path string, language string, kind string, name string, qualified_name string, code_id string, signature string, signature_hash string, start int, stop int"
_DECL_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in DECLARATIONS.split(", "))])


def _declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                found, _ = declarations(text, lang)
                outer: list[Declaration] = []
                named = []
                for d in found:
                    while outer and outer[-1].end < d.end:
                        outer.pop()
                    named.append((d, ".".join([*(o.name for o in outer), d.name]), hashlib.sha256(d.signature.encode("utf-8", "surrogatepass")).hexdigest()[:6]))
                    outer.append(d)
                often = Counter(q for _, q, _ in named)
                for d, q, h in named:
                    # overloads of one name are told apart by their signatures
                    yield path, lang, d.kind, d.name, q, f"{path}:{q}" + (f"@{h}" if often[q] > 1 else ""), d.signature, h, d.start, d.end

    yield from _batches(rows(), _DECL_ARROW)


def code_declarations(files: DataFrame) -> DataFrame:
    """Functions, methods and types of source files (``path, text``), with the names they stand in, their headers and the six digits
    that tell overloads apart. One pass without a shuffle; null texts and unknown endings give nothing."""
    end = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[end]
    return spread(files.where("text is not null").select("path", lang.alias("language"), "text").where("language is not null")).mapInArrow(_declared, DECLARATIONS)
