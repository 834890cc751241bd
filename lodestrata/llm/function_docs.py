"""Functions paired with their documentation: code-description pairs without empty or trivial descriptions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.code_trees import LANGUAGES, functions, walk
from lodestrata.session import spread

# Words of placeholders and of notes to write the documentation later, in four languages.
META_WORDS = set(
    """a add added adds an available auto automatically be before by code coming comment comments describe described
completed description descriptions doc docs docstring document documentation documented empty fill filled fixme follow
follows for function functions generated go goes has have here in insert is it later me method missing more must n na
needed needs no none not of on out pending placeholder please provided release scaffold scaffolded see should some soon
still stub stubbed summary supplied tba tbd template temporary text that the this to todo undocumented until up updated
was will write written xxx yet your
beschreibung dokumentation doku fehlt folgt folgen noch nicht ausstehend ergänzen
description à a compléter completer documenter documentation venir suivre manquante
pendiente pendientes de documentar descripción documentación falta completar por hacer""".split()
)
# Those of them of which a note has one at least; the others are only what stands around them.
NOTE_WORDS = set(
    """comment comments describe description descriptions doc docs docstring document documentation documented fill filled
fixme follow follows goes later missing n na none pending placeholder scaffold soon stub stubbed summary tba tbd todo
undocumented write written xxx
beschreibung dokumentation doku fehlt folgt folgen ausstehend ergänzen compléter completer documenter venir suivre
manquante pendiente pendientes documentar descripción documentación falta completar""".split()
)
# Words that add nothing to a function's name.
NAME_FILLERS = set("a an the this that these its is are it of to for and with on function functions method methods func fn def procedure routine helper does do will".split())

_MARKER = re.compile(r"\W*(?:todo|tbd|tba|fixme|xxx)\b\s*(?:\([^)\n]*\))?\s*(?:[:.\-!]|\Z|(?=(?:add|write|docs?|document\w*|describe|fill)\b))", re.I)
_TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|returns?|throws|type|typeparam|template|yields)\b(?:\s*\{[^}]*\})?\s*[\w.$\[\]]*|:(?:param|arg|type|returns?|rtype|raises)\b[^:\n]*:|-?\s*`?\*{0,2}\w+`?\s*(?:\([^)\n]*\))?\s*:)\s*[-–:]?\s*$")
_TAG_TEXT = re.compile(r"^\s*(?:[@\\](?:returns?|yields)\b(?:\s*\{[^}]*\})?)\s*[-–:]?\s*$")
_SECTION = re.compile(r"^\s*#*\s*(?:args?|arguments|parameters|params|returns?|raises|yields|throws)\s*:?\s*$", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


def _stem(w: str) -> str:
    for end in ("ing", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] in "eyi" else w


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _PART.findall(name)]


def _is_note(words: list[str]) -> bool:
    """A note to write documentation, or that there is none: nothing but words of such notes."""
    return all(w in META_WORDS for w in words) and any(w in NOTE_WORDS for w in words)


def says_something(doc: str | None, name: str, min_words: int = 1) -> bool:
    """False for documentation that is missing, blank or of fewer than ``min_words`` words, that is a placeholder or a note
    to write it later, that holds only tags without text, or only the function's name in other words."""
    if doc is None:
        return False
    if _MARKER.match(doc):
        return False
    lines = doc.split("\n")
    tagged = any(_SECTION.match(x) or re.match(r"^\s*[@:\\]\w", x) for x in lines)
    kept = [x for x in lines if not (tagged and (_TAG.match(x) or _TAG_TEXT.match(x) or _SECTION.match(x)))]
    words = re.findall(r"[^\W\d_]+", " ".join(kept))
    if len(words) < max(min_words, 1):
        return False
    if _is_note([w.lower() for w in words]):
        return False
    parts = {_stem(w) for w in name_words(name)}
    told = [w for x in re.findall(r"\w+", " ".join(kept)) for w in name_words(x)]
    return not all(w in NAME_FILLERS or _stem(w) in parts for w in told)


SCHEMA = "id string, language string, func_name string, documentation string, code string, start int, stop int"
_ARROW = pa.schema([("id", pa.string()), ("language", pa.string()), ("func_name", pa.string()), ("documentation", pa.string()), ("code", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])


def _pairs(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, langs, texts = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("id", "language", "text"))
        rows = []
        for i, lang, text in zip(ids, langs, texts):
            tree, source = functions(text, lang)
            for f in walk(tree):
                if says_something(f.doc, f.name, min_words):
                    rows.append((i, lang, f.name, f.doc, source[f.start : f.end], f.start, f.end))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def function_docs(df: DataFrame, *, key: str, path: str, text: str, min_words: int = 1) -> DataFrame:
    """``id, language, func_name, documentation, code, start, stop``: one row per named function or method, nested
    ones too, whose documentation says something. ``start`` and ``stop`` are character positions of the function with
    its attributes in the text (line ends as LF); ``code`` is that range.

    The language follows from the path's ending; rows of other endings, null paths, and null or empty texts give nothing. Two
    functions of one name in one text give two rows, repeated rows repeat them. No shuffle; a row costs memory in
    proportion to its own text. An empty table gives no rows; other columns are not looked at."""
    ending = F.lower(F.regexp_extract(F.col(path), r"\.(\w+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ending]
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), language.alias("language"), F.col(text).alias("text"))
    return spread(rows.where(F.col("language").isNotNull())).mapInArrow(lambda it: _pairs(it, min_words), SCHEMA)


def anchor_functions(anchors: DataFrame) -> DataFrame:
    return function_docs(anchors.where(F.col("anchor_type") == "code"), key="id", path="path", text="content_text")
