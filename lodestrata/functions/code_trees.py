"""Syntax trees of functions in five languages, for pairing them with their documentation.

Python is parsed by the ``ast`` module. For TypeScript, Go, Rust and Zig a lexer splits the text into tokens with exact
positions, comments kept apart, and a parser builds the tree of named functions from the bracket structure: a function
node has its name, its source range from the first attribute to the end of its body, its documentation and the
functions inside it. Text that doesn't parse as a whole still gives the functions that can be told.
"""

from __future__ import annotations

import ast
import inspect
import re
import textwrap
from bisect import bisect_right
from dataclasses import dataclass, field

LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "go": "go", "rs": "rust", "zig": "zig"}


@dataclass
class Function:
    name: str
    start: int
    end: int
    doc: str | None
    inner: list[Function] = field(default_factory=list)


def walk(nodes: list[Function]):
    for n in nodes:
        yield n
        yield from walk(n.inner)


# ---------------------------------------------------------------- Python


def _line_starts(text: str) -> list[int]:
    return [0, *[m.end() for m in re.finditer("\n", text)]]


def _char_at(lines: list[str], starts: list[int], line: int, byte: int) -> int:
    """Character position of an ast position, whose columns count bytes."""
    s = lines[line - 1] if line <= len(lines) else ""
    return starts[min(line, len(starts)) - 1] + len(s.encode("utf-8", "replace")[:byte].decode("utf-8", "ignore"))


_BLOCK = re.compile(r"(?:async\s+def|def|class)\b|@")


def _parts(lines: list[str], lo: int, hi: int) -> list[ast.Module]:
    """Trees of the lines from ``lo`` to ``hi``, with the line numbers of the text. What doesn't parse is split at the
    definitions of its own depth, and a definition that doesn't parse is replaced by those inside it; so only what stands
    in a broken definition itself is lost, and nothing behind it."""
    full = [i for i in range(lo, hi) if lines[i].strip()]
    if not full:
        return []
    depth = min(len(lines[i]) - len(lines[i].lstrip()) for i in full)
    head = "\n" * lo if not depth else "\n" * (lo - 1) + "if 1:\n"
    try:
        return [ast.parse(head + "\n".join(lines[lo:hi]))]
    except SyntaxError:
        pass
    except (ValueError, RecursionError, MemoryError):
        return []
    cuts, decorated = [], False
    for i in full:
        if len(lines[i]) - len(lines[i].lstrip()) == depth:
            if _BLOCK.match(lines[i].lstrip()) and not decorated:
                cuts.append(i)
            decorated = lines[i].lstrip().startswith("@")
    if cuts == [] or cuts == [full[0]]:
        inner = next((i for i in full[1:] if _BLOCK.match(lines[i].lstrip())), hi)
        return _parts(lines, inner, hi)
    spans = zip([full[0], *cuts] if cuts[0] > full[0] else cuts, [*cuts, hi] if cuts[0] > full[0] else [*cuts[1:], hi])
    return [t for x, y in spans for t in _parts(lines, x, y)]


def _parse_python(text: str) -> tuple[list[ast.Module], str]:
    """The modules and the text they were parsed from: as given, dedented, or in parts."""
    dedented = textwrap.dedent(text.expandtabs(8))
    for source in (text, dedented, "if 1:\n" + text if text[:1] in " \t" else dedented):
        try:
            return [ast.parse(source)], source
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    try:
        return _parts(dedented.split("\n"), 0, dedented.count("\n") + 1), dedented
    except RecursionError:
        return [], dedented


def _python(text: str) -> tuple[list[Function], str]:
    trees, source = _parse_python(text)
    lines, starts = source.split("\n"), _line_starts(source)

    def visit(node: ast.AST, into: list[Function]) -> None:
        for child in ast.iter_child_nodes(node):
            target = into
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([child, *child.decorator_list], key=lambda x: x.lineno)
                doc = ast.get_docstring(child, clean=False)
                f = Function(child.name, _char_at(lines, starts, first.lineno, 0), _char_at(lines, starts, child.end_lineno, child.end_col_offset), None if doc is None else inspect.cleandoc(doc))
                into.append(f)
                target = f.inner
            visit(child, target)

    out: list[Function] = []
    for tree in trees:
        visit(tree, out)
    return out, source


# ---------------------------------------------------------------- languages with braces

_COMMON = r"(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))"
_LEX = {
    "typescript": _COMMON + r"|(?P<str>\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z))",
    "go": _COMMON + r"|(?P<str>\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))",
    "rust": _COMMON + r"|(?P<str>b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'|'[A-Za-z_]\w*)",
    "zig": r"(?P<line>//[^\n]*)|(?P<str>\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|\\\\[^\n]*)",
}
_TOKEN = {k: re.compile(v + r"|(?P<word>[A-Za-z_$#][\w$]*|[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|[^\s\w])") for k, v in _LEX.items()}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MODIFIERS = {
    "typescript": {"export", "default", "declare", "async", "abstract", "public", "private", "protected", "static", "readonly", "override", "const", "let", "var", "get", "set"},
    "go": set(),
    "rust": {"pub", "async", "unsafe", "const", "extern", "default", "crate", "in", "self", "super"},
    "zig": {"pub", "export", "extern", "inline", "noinline", "threadlocal"},
}


@dataclass
class _Tok:
    kind: str
    text: str
    start: int
    end: int
    partner: int = -1


class _Braces:
    """Tokens of one text, the comments before each, and the partner of each bracket."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.toks: list[_Tok] = []
        self.before: dict[int, list[_Tok]] = {}
        self.starts = _line_starts(text)
        stack: list[int] = []
        pattern, at = _TOKEN[language], 0
        while m := pattern.search(text, at):
            kind, at = m.lastgroup or "op", m.end()
            if kind == "h":
                kind = "str"
            t = _Tok(kind, m.group(0), m.start(), m.end())
            if kind == "block" and language == "rust":
                t.end = at = self._nested(m.start())
                t.text = text[t.start : t.end]
            if kind in ("line", "block"):
                self.before.setdefault(len(self.toks), []).append(t)
                continue
            if language == "rust" and kind == "word" and t.text.startswith("#"):
                t = _Tok("op", "#", t.start, t.start + 1)
                at = t.end
            i = len(self.toks)
            self.toks.append(t)
            if t.text in _OPEN and kind == "op":
                stack.append(i)
            elif t.text in _CLOSE and kind == "op":
                for k in range(len(stack) - 1, -1, -1):
                    if _OPEN[self.toks[stack[k]].text] == t.text:
                        self.toks[stack[k]].partner, t.partner = i, stack[k]
                        del stack[k:]
                        break

    def _nested(self, at: int) -> int:
        depth, pos = 0, at
        while m := re.compile(r"/\*|\*/").search(self.text, pos):
            depth, pos = depth + (1 if m.group(0) == "/*" else -1), m.end()
            if depth == 0:
                return pos
        return len(self.text)

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, pos) - 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind in ("op", "word") and self.toks[i].text in texts

    def word(self, i: int) -> str | None:
        return self.toks[i].text if 0 <= i < len(self.toks) and self.toks[i].kind == "word" else None

    def skip(self, i: int) -> int:
        """The token after the bracket group that opens at i; after i if none does."""
        return self.toks[i].partner + 1 if self.toks[i].partner > i else i + 1

    def angles(self, i: int) -> int:
        """The token after ``<...>`` at i."""
        depth = 0
        while i < len(self.toks):
            if self.is_(i, "<"):
                depth += 1
            elif self.is_(i, ">"):
                depth -= 1
                if depth == 0:
                    return i + 1
            elif self.is_(i, ";") or self.is_(i, "{") and depth == 0:
                return i
            i = self.skip(i) if self.is_(i, "(", "[", "{") else i + 1
        return i

    def head(self, i: int) -> int:
        """The first token of the declaration that i is in: modifiers, attributes and decorators included."""
        while i > 0:
            j, t = i - 1, self.toks[i - 1]
            if t.kind == "word" and t.text in _MODIFIERS[self.language]:
                i = j
            elif t.kind == "str" and self.is_(j - 1, "extern"):
                i = j - 1
            elif self.language == "rust" and t.text == ")" and t.partner > 0 and self.is_(t.partner - 1, "pub"):
                i = t.partner - 1
            elif self.language == "rust" and t.text == "]" and t.partner > 0 and self.is_(t.partner - 1, "#"):
                i = t.partner - 1
            elif self.language == "typescript" and (k := self._decorator(j)) is not None:
                i = k
            else:
                break
        return i

    def _decorator(self, j: int) -> int | None:
        """The token of the ``@`` of a decorator that ends at j."""
        if self.toks[j].text == ")" and self.toks[j].partner > 0:
            j = self.toks[j].partner - 1
        while self.word(j) and self.is_(j - 1, ".") and self.word(j - 2):
            j -= 2
        return j - 1 if self.word(j) and self.is_(j - 1, "@") else None

    def comments(self, first: int, last: int) -> list[_Tok]:
        """Comments before token ``first`` and between it and ``last``."""
        return [c for i in range(first, last + 1) for c in self.before.get(i, [])]

    def doc(self, first: int, at: int) -> str | None:
        lang = self.language
        above = self.before.get(first, [])
        start_line = self.line(self.toks[first].start)
        if lang == "typescript":
            within = [c for i in range(first + 1, at + 1) for c in self.before.get(i, [])]
            blocks = [c for c in above + within if c.kind == "block" and c.text.startswith("/**") and not c.text.startswith("/***") and c.text != "/**/"]
            if not blocks:
                return None
            c = blocks[-1]
            if c in above:
                # nothing but further comments between, and no blank line
                tail = above[above.index(c) :]
                for x, y in zip(tail, [*tail[1:], None]):
                    nxt = self.line(y.start) if y else start_line
                    if nxt - self.line(max(x.end - 1, x.start)) > 1:
                        return None
            body = re.sub(r"\*+/\Z", "", c.text[3:])
            return "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in body.split("\n")).strip()
        mark = "//" if lang == "go" else "///"
        taken: list[str] = []
        next_line = start_line
        inner = self.comments(first + 1, at) if lang == "rust" else []
        for c in reversed(above):
            end = self.line(max(c.end - 1, c.start))
            if next_line - end > 1 or end == next_line and c.kind != "block" or c.kind == "block":
                break
            own_line = not self.text[self.starts[end] : c.start].strip()
            if not own_line:
                break
            if not c.text.startswith(mark) or mark == "///" and c.text.startswith("////"):
                if lang == "go":
                    break
                next_line = end
                if taken:
                    break
                continue
            taken.append(c.text[len(mark) :])
            next_line = end
        taken.reverse()
        taken += [c.text[3:] for c in inner if c.kind == "line" and c.text.startswith("///") and not c.text.startswith("////")]
        if lang == "go":
            taken = [x for x in taken if not re.match(r"(?:[a-z0-9]+:\S|nolint\b|export \w|extern \w|line \S| ?\+build\b| ?nolint\b|\s*lint:|\s*#nosec)", x)]
        return "\n".join(x[1:] if x.startswith(" ") else x for x in taken).strip() if taken else None

    def body_end(self, i: int) -> int:
        """The last token of a declaration whose parameters end before token i."""
        while i < len(self.toks):
            if self.is_(i, "{"):
                return min(self.skip(i) - 1, len(self.toks) - 1)
            if self.is_(i, ";"):
                return i
            i = self.skip(i) if self.is_(i, "(", "[") else i + 1
        return len(self.toks) - 1

    def found(self) -> list[tuple[str, int, int, int]]:
        """(name, first token, token of the keyword or name, last token) of every named function."""
        out = []
        n = len(self.toks)
        for i in range(n):
            w = self.word(i)
            if w is None:
                continue
            if self.language in ("go", "rust", "zig"):
                if w == ("func" if self.language == "go" else "fn"):
                    j = i + 1
                    if self.language == "go" and self.is_(j, "("):
                        j = self.skip(j)
                    name = self.word(j)
                    if name and self.is_(j + 1, "(", "<", "["):
                        k = self.angles(j + 1) if self.is_(j + 1, "<") else self.skip(j + 1) if self.is_(j + 1, "[") else j + 1
                        if self.is_(k, "("):
                            out.append((name, self.head(i), i, self.body_end(self.skip(k))))
                continue
            if w == "function":
                j = i + 1 + self.is_(i + 1, "*")
                name = self.word(j)
                if name and name != "function" and self.is_(j + 1, "(", "<"):
                    out.append((name, self.head(i), i, self.body_end(self.skip(j + 1) if self.is_(j + 1, "(") else self.angles(j + 1))))
                elif self.is_(i - 1, "=") or self.is_(i - 1, "async") and self.is_(i - 2, "="):
                    v = i - 2 - self.is_(i - 1, "async")
                    if self.word(v):
                        out.append((self.toks[v].text, self.head(v), v, self.body_end(i + 1)))
            elif w in ("class", "interface") and not self.is_(i - 1, ".") and self.word(i + 1):
                j = i + 1
                while j < n and not self.is_(j, "{", ";"):
                    j = self.angles(j) if self.is_(j, "<") else self.skip(j) if self.is_(j, "(", "[") else j + 1
                if w == "class" and self.is_(j, "{"):
                    out += self._members(j)
            elif w in ("const", "let", "var") and self.word(i + 1):
                if (arrow := self._arrow(i + 2)) is not None:
                    out.append((self.toks[i + 1].text, self.head(i), i, arrow))
        return out

    def _arrow(self, i: int) -> int | None:
        """The last token of the arrow function assigned at i (``: type = (..) =>``); None if there is none."""
        n = len(self.toks)
        if self.is_(i, ":"):
            while i < n and not self.is_(i, "=", ";", "{"):
                i = self.angles(i) if self.is_(i, "<") else self.skip(i) if self.is_(i, "(", "[") else i + 1
        if not self.is_(i, "="):
            return None
        i += 1
        i += self.is_(i, "async")
        if self.is_(i, "<"):
            i = self.angles(i)
        if self.is_(i, "("):
            i = self.skip(i)
            while i < n and not self.is_(i, "=>", ";", "=", "}", ","):
                if i and self.is_(i, ":") or self.word(i) or self.is_(i, ".", "|", "&", "?") or self.toks[i].kind in ("str", "num"):
                    i += 1
                elif self.is_(i, "<"):
                    i = self.angles(i)
                elif self.is_(i, "(", "[", "{"):
                    i = self.skip(i)
                else:
                    return None
        elif self.word(i) and self.is_(i + 1, "=>"):
            i += 1
        if not self.is_(i, "=>"):
            return None
        return min(self.skip(i + 1) - 1, n - 1) if self.is_(i + 1, "{") else self.body_end(i + 1)

    def _members(self, brace: int) -> list[tuple[str, int, int, int]]:
        out = []
        stop = self.toks[brace].partner if self.toks[brace].partner > 0 else len(self.toks)
        i = brace + 1
        while i < stop:
            first = i
            while self.is_(i, "@"):
                i += 2
                while self.is_(i, "."):
                    i += 2
                if self.is_(i, "("):
                    i = self.skip(i)
            while self.word(i) in _MODIFIERS["typescript"] and not self.is_(i + 1, "(", "<", "=", ":", ";", "?"):
                i += 1
            i += self.is_(i, "*")
            name = self.word(i)
            j = i + 1
            if name and self.is_(j, "?", "!"):
                j += 1
            if name and self.is_(j, "<"):
                j = self.angles(j)
            if name and self.is_(j, "("):
                last = self.body_end(self.skip(j))
                out.append((name.lstrip("#"), first, i, last))
                i = last + 1
                continue
            if name and (arrow := self._arrow(j)) is not None:
                out.append((name.lstrip("#"), first, i, arrow))
                i = arrow + 1
                continue
            while i < stop and not self.is_(i, ";"):
                if self.is_(i, "(", "[", "{"):
                    closes = self.is_(i, "{")
                    i = self.skip(i)
                    if closes:
                        break
                    continue
                i += 1
                if i < stop and self.line(self.toks[i].start) > self.line(self.toks[i - 1].start) and not self.is_(i, ".", "?", "|", "&", "=", ")"):
                    break
            i += self.is_(i, ";")
        return out


def _braced(text: str, language: str) -> tuple[list[Function], str]:
    b = _Braces(text, language)
    seen: set[int] = set()
    flat = []
    for name, first, at, last in sorted(b.found(), key=lambda x: (x[2], x[3])):
        if at not in seen:
            seen.add(at)
            flat.append(Function(name, b.toks[first].start, b.toks[max(last, at)].end, b.doc(first, at)))
    out: list[Function] = []
    stack: list[Function] = []
    for f in sorted(flat, key=lambda f: (f.start, -f.end)):
        while stack and stack[-1].end <= f.start:
            stack.pop()
        (stack[-1].inner if stack else out).append(f)
        stack.append(f)
    return out, text


def functions(text: str, language: str) -> tuple[list[Function], str]:
    """The tree of named functions and the text their ranges point into (line ends as LF; Python may be dedented)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    return _python(text) if language == "python" else _braced(text, language)


# ---------------------------------------------------------------- declarations

@dataclass
class Declaration:
    """A named function or type with its span and its header in one line."""

    name: str
    kind: str
    start: int
    end: int
    signature: str


def header(code: str, language: str) -> str:
    """What stands before the body of a declaration: decorators, attributes and comments off, blanks joined."""
    if language == "python":
        at = re.search(r"(?m)^[ \t]*(?:async\s+def|def|class)\b", code)
        code, stop = code[at.start() :] if at else code, ":"
    else:
        code, stop = re.sub(r"(?m)^\s*(?://|/\*|\*|@|#\[).*$", "", code), "{"
    depth, i, quote = 0, 0, ""
    while i < len(code):
        c = code[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`" and not (language == "rust" and c == "'"):
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and (c == stop or stop == "{" and (c == ";" or code.startswith("=>", i))):
            break
        i += 1
    return " ".join(code[:i].split())


def _python_types(source: str, trees: list[ast.Module]) -> list[Declaration]:
    lines, starts = source.split("\n"), _line_starts(source)
    out = []
    for tree in trees:
        for n in ast.walk(tree):
            if isinstance(n, ast.ClassDef):
                first = min([n, *n.decorator_list], key=lambda x: x.lineno)
                a, b = _char_at(lines, starts, first.lineno, 0), _char_at(lines, starts, n.end_lineno, n.end_col_offset)
                out.append(Declaration(n.name, "class", a, b, header(source[a:b], "python")))
    return out


# Words that begin the declaration of a type.
_TYPES = {"typescript": {"class", "interface", "type", "enum"}, "go": {"type"}, "rust": {"struct", "enum", "trait", "union", "type"}, "zig": {"struct", "enum", "union", "opaque"}}


def _braced_types(text: str, language: str) -> list[Declaration]:
    b = _Braces(text, language)
    out = []
    for i in range(len(b.toks)):
        w = b.word(i)
        if w not in _TYPES[language] or b.is_(i - 1, ".", "::"):
            continue
        name, at, kind = b.word(i + 1), i, w
        if language == "zig":  # const Name = [extern|packed] struct {
            j = i - 1 - b.is_(i - 1, "extern", "packed")
            if not (b.is_(j, "=") and b.word(j - 1) and b.is_(j - 2, "const", "var")):
                continue
            name, at = b.word(j - 1), j - 2
        elif language == "go":
            kind = b.word(i + 2) if b.is_(i + 2, "struct", "interface") else "type"
        elif w == "type" and not (b.is_(i + 2, "=", "<") if language == "typescript" else b.is_(i + 2, "=", "<", ";", ":")):
            continue
        if not name:
            continue
        first, last = b.head(at), b.body_end(i + 1)
        if w == "type" and language == "typescript":
            # to the end of its line, or of the brackets that open on it
            last = i + 1
            while last + 1 < len(b.toks) and not b.is_(last, ";") and (b.line(b.toks[last + 1].start) == b.line(b.toks[last].end - 1) or b.is_(last + 1, "|", "&") or b.is_(last, "|", "&", "=")):
                last = b.skip(last + 1) - 1 if b.is_(last + 1, "{", "(", "[") else last + 1
        span = b.toks[first].start, b.toks[max(last, at)].end
        out.append(Declaration(name, kind, *span, header(text[slice(*span)], language)))
    return out


def declarations(text: str, language: str) -> tuple[list[Declaration], str]:
    """Functions and types of a source text in the order of their start, and the text their positions are of."""
    tree, source = functions(text, language)
    types = _python_types(source, _parse_python(source)[0]) if language == "python" else _braced_types(source, language)
    own = [Declaration(f.name, "function", f.start, f.end, header(source[f.start : f.end], language)) for f in walk(tree)]
    return sorted(own + types, key=lambda d: (d.start, -d.end)), source
