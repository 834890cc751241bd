"""Text, path and identifier functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \t\n\r"


def canonical(text: Column) -> Column:
    """Byte-order mark off, line ends as LF, blanks at line ends off, at most one line end at the end."""
    t = F.regexp_replace(text, r"\A﻿", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t\f\x0B]+$", "")
    return F.regexp_replace(t, r"\n+\z", "\n")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical(text), 256))


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(canonical(text), 256), 1, n)


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)))


def approx_tokens(text: Column) -> Column:
    """1.4 tokens a word, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * 7 / 5)).cast("long")


def ascii_slug(text: Column) -> Column:
    """Slug of a heading whose letters are ASCII: others are dropped; a hash stands in for an empty slug."""
    s = F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", "")), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", F.concat(F.lit("section-"), F.substring(F.sha2(text, 256), 1, 8))).otherwise(s)


def normal_path(path: Column) -> Column:
    """``/`` as separator, no leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./+)+", "")


def endpoint_path(anchor_id: Column) -> Column:
    """The part of an anchor id before its first colon."""
    return F.substring_index(anchor_id, ":", 1)


def pinned_id(text: Column) -> Column:
    """Id pinned in an HTML comment, null without one."""
    hit = F.regexp_extract(text, r"<!--\s*(?:anchor|id)\s*:\s*([A-Za-z0-9_\-./:]+)\s*-->", 1)
    return F.when(hit != "", hit)


def signed64(unsigned_hex: Column) -> Column:
    """16 hexadecimal digits as a signed long of the same bits."""
    return F.conv(unsigned_hex, 16, -10).cast("long")


def url_slug(branch: Column, most: int = 200) -> Column:
    """Branch name as a file name: everything outside letters, digits, ``_.-~`` quoted; long ones as a hash."""
    q = F.replace(F.url_encode(branch), F.lit("+"), F.lit("%20"))
    return F.when(F.length(q) <= most, q).otherwise(F.concat(F.substring(q, 1, most - 17), F.lit("-"), F.substring(F.sha2(branch, 256), 1, 16)))


def overview(headings: Column, text: Column, most: int = 800) -> Column:
    return F.concat(F.coalesce(F.array_join(headings, " "), F.lit("")), F.lit("\n"), F.substring(text, 1, most))


def preview(text: Column, tokens: int = 500) -> tuple[Column, Column]:
    """The first words of ``tokens`` tokens and whether more follow; blanks collapse only where it is cut."""
    n = tokens * 5 // 7
    words = F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    cut = F.size(words) > n
    return F.when(cut, F.array_join(F.slice(words, 1, n), " ")).otherwise(text), cut


def excerpt(chunk: Column, shown: Column, full: Column, most: int = 200) -> tuple[Column, Column]:
    """The matched chunk's start, null if it is what is shown anyway, and its character offset in the full text."""
    e = F.nullif(F.substring(chunk, 1, most), F.substring(shown, 1, most))
    return e, F.nullif(F.instr(full, e), F.lit(0)) - 1


# Fixed value: endings of test files and folders.
TEST_PATH = (
    r"(?:^|/)(?:test_[^/]+\.py|[^/]+_tests?\.py|conftest\.py|tests?/|[^/]+\.(?:test|spec)\.(?:ts|tsx|js|jsx|mjs|cjs)"
    r"|__tests__/|[^/]+_test\.go|[^/]+_test\.rs|[^/]+(?:Test|Tests|Spec)\.(?:java|kt))"
)


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


# Languages by ending.
LANGUAGE = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "zig": "zig"}


def language(path: Column) -> Column:
    """Language by the path's ending; null for text and unknown endings."""
    ending = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])[ending]


def glob_regex(pattern: str) -> str:
    """One glob as a regular expression over whole paths. In a pattern with ``**`` a single star stays within a folder;
    in others it crosses folders; a pattern without wildcards matches itself only."""
    p, crossing, out, i = pattern.replace("\\", "/"), "**" not in pattern, [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if p.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = p[i]
        if c == "*":
            out.append(".*" if crossing else "[^/]*")
        elif c == "?":
            out.append("." if crossing else "[^/]")
        elif c == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            body = p[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    if not globs:
        return F.lit(False)
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("|".join(glob_regex(g) for g in globs))


def classify(path: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The class of the first rule (glob, class) that matches."""
    out = F.lit(default)
    for glob, kind in reversed(rules):
        out = F.when(matches_globs(path, [glob]), kind).otherwise(out)
    return out


def file_kind(path: Column) -> Column:
    """markdown, code or skip by ending."""
    end = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.when(end.isin("md", "markdown", "mdx"), "markdown").when(end.isin(*LANGUAGE), "code").otherwise("skip")


def admitted(path: Column, include: list[str], exclude: list[str], skip: Column) -> Column:
    """Exclusion wins, then a skip mark in the file, then inclusion."""
    return ~matches_globs(path, exclude) & ~F.coalesce(skip, F.lit(False)) & matches_globs(path, include)


def snake(name: Column) -> Column:
    """Camel case and dashes as words joined by one underscore."""
    s = F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))
    return F.regexp_replace(F.regexp_replace(s, r"[-_]+", "_"), r"^_|_$", "")


def trigrams(s: Column) -> Column:
    low = F.lower(s)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def symbol_similarity(a: Column, b: Column) -> Column:
    """1 without case, 0.95 in snake form, 0.6 to 0.9 by containment, else the Jaccard similarity of trigrams."""
    la, lb = F.lower(a), F.lower(b)
    ratio = F.least(F.length(la), F.length(lb)) / F.greatest(F.length(la), F.length(lb))
    return (
        F.when(la == lb, 1.0)
        .when(snake(a) == snake(b), 0.95)
        .when(F.contains(lb, la) | F.contains(la, lb), ratio * 0.3 + 0.6)
        .otherwise(jaccard(trigrams(a), trigrams(b)))
    )


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


# Forms of a declaration.
DECLARATION = r"(?m)^\s*(?:export\s+|pub\s+|async\s+|default\s+)*(?:def|class|function|fn|func|interface|type|const|let|var)\s+([A-Za-z_$][\w$]*)"


def declared_name(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, DECLARATION, 1), F.lit(""))


def quoted_query(query: Column) -> Column:
    """A query as quoted words, each to be matched as it is: split at white space, inner quotes doubled; empty without words."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " ")


def text_slice(text: Column, line: Column, char: Column, end_line: Column, end_char: Column) -> Column:
    """The text from a position to another (lines and characters from 0, the end excluded; a null end character is the end of
    its line); ranges past the text are cut to it, null where nothing of it is in the range of lines."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    some = F.slice(lines, line + 1, F.greatest(end_line - line + 1, F.lit(0)))
    n = F.size(some)
    cut = F.transform(some, lambda x, i: F.substring(x, F.when(i == 0, char + 1).otherwise(F.lit(1)), F.length(x)))
    full = (n == end_line - line + 1) & end_char.isNotNull()
    last = F.element_at(some, -1)
    kept = F.when(n == 1, F.substring(last, char + 1, F.greatest(end_char - char, F.lit(0)))).otherwise(F.substring(last, F.lit(1), end_char))
    return F.when(n == 0, None).when(full, F.array_join(F.concat(F.slice(cut, F.lit(1), n - 1), F.array(kept)), "\n")).otherwise(F.array_join(cut, "\n"))


def signature_hash(signature: Column) -> Column:
    """Six digits that tell overloads apart."""
    return short_hash(signature, 6)


def file_hash(text: Column) -> Column:
    """The content hash; for a file that can't be read (null) that of zeros."""
    return F.coalesce(content_hash(text), F.lit("sha256:" + "0" * 64))


# Globs of what is never indexed, whatever a file says of itself.
SAFETY = ["**/.git/**", "**/secrets/**", "secrets/**", "**/.env", ".env", "**/*.pem", "*.pem", "**/*.key", "*.key"]


def safety_excluded(path: Column, globs: list[str] = SAFETY) -> Column:
    """Paths that no mark in the file can bring back."""
    return matches_globs(path, globs)
