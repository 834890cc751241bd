from lodestrata.functions.code_trees import declarations
from lodestrata.operators import extraction as E
from lodestrata.operators import graph as G

SOURCES = {
    "python": ("@deco(1)\nclass A(B):\n    def one(self, x: dict[str, int] = {}) -> int:\n        return 1\n\nasync def two(a,\n    b): return a\n", [("A", "class", "class A(B)"), ("one", "function", "def one(self, x: dict[str, int] = {}) -> int"), ("two", "function", "async def two(a, b)")]),
    "typescript": ("export interface P { a: string; b(): void }\ntype Q = { x: 1 }\nexport class C<T> extends D {\n  run(a: number): string { return '{' }\n}\nenum E { X }\n", [("P", "interface", "export interface P"), ("Q", "type", "type Q ="), ("C", "class", "export class C<T> extends D"), ("run", "function", "run(a: number): string"), ("E", "enum", "enum E")]),
    "go": ("type S struct { a int }\n\ntype I interface { M() }\n\nfunc (s *S) M(x int) error { return nil }\n", [("S", "struct", "type S struct"), ("I", "interface", "type I interface"), ("M", "function", "func (s *S) M(x int) error")]),
    "rust": ("#[derive(Debug)]\npub struct S { a: u8 }\npub trait T { fn f(&self) -> u8; }\nimpl T for S { fn f(&self) -> u8 { 1 } }\n", [("S", "struct", "pub struct S"), ("T", "trait", "pub trait T"), ("f", "function", "fn f(&self) -> u8"), ("f", "function", "fn f(&self) -> u8")]),
    "zig": ("pub const S = struct {\n    a: u8,\n    pub fn f(self: S) u8 { return self.a; }\n};\n", [("S", "struct", "pub const S = struct"), ("f", "function", "pub fn f(self: S) u8")]),
}


def test_declarations_of_five_languages():
    for lang, (text, want) in SOURCES.items():
        found, source = declarations(text, lang)
        assert [(d.name, d.kind, d.signature) for d in found] == want, lang
        assert all(d.name in source[d.start : d.end] for d in found)


def test_overloads_and_outer_names(spark):
    rows = [("a.py", SOURCES["python"][0]), ("b.ts", "class C { f(a: string): void {} f(a: number): void {} g() {} }"), ("c.md", "class X"), ("d.py", None), ("e.py", ""), ("f.py", "class (:\n" * 50)]
    got = {r.code_id: r.signature_hash for r in E.code_declarations(spark.createDataFrame(rows, "path string, text string")).collect()}
    plain = {k for k in got if "@" not in k}
    assert plain == {"a.py:A", "a.py:A.one", "a.py:two", "b.ts:C", "b.ts:C.g"}
    over = [k for k in got if "@" in k]
    assert len(over) == 2 and all(k == f"b.ts:C.f@{got[k]}" for k in over)


def test_enrichment_and_full_edges(spark):
    a = spark.createDataFrame([("a", "code", "x.py", "sha256:" + "1" * 64, "A\r\n"), ("b", "code", "x.go", "sha256:" + "2" * 64, "B"), ("c", "code", "x.zz", "h", "C"), ("d", "code", "y.py", "h", None), ("e", "section", "e.md", "h", "E")], "id string, anchor_type string, path string, content_hash string, content_text string")
    edges = G.full_edges(spark.createDataFrame([("a", "b"), ("a", "b"), (None, "b")], "src string, dst string"), spark.createDataFrame([("b", "a")], "src string, dst string"), spark.createDataFrame([("d", "zz")], "src string, dst string"))
    assert edges.count() == 3
    bodies = {(r.src, r.dst): r.body_hash for r in G.body_hashes(edges, a).collect()}
    assert bodies["d", "zz"] is None and bodies["b", "a"].startswith("sha256:")
    got = {r.id: (r.status, r.closure_hash is not None) for r in G.enrich(a, edges, spark.createDataFrame([("d",)], "id string"), available=["python"]).collect()}
    assert got == {"a": ("complete", True), "b": ("lsp_unavailable", False), "c": ("unsupported", False), "d": ("lsp_error", False)}
