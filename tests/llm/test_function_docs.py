import pytest
from lodestrata.llm.function_docs import function_docs, says_something


def run(spark, rows):
    df = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "id string, path string, text string, language string")
    return {(r.id, r.func_name, r.documentation) for r in function_docs(df, key="id", path="path", text="text").collect()}


PY = '''class A:
    """Holds things."""
    def outer(self):
        """Walks the tree once."""
        def inner(x):
            """Counts what is left."""
            return x
    @property
    def silent(self):
        pass
'''
TS = """/** Opens the gate for all callers. */
@Log()
export async function openGate<T extends A<B>>(x: Map<string, number>): Promise<T> {
  const s = "function no() {}"; // function no2() {}
  return `${s} {`;
}
class K {
  /**
   * Merges what was read before.
   * @param a first
   */
  private static async mergeAll(a: string): void { if (a) { go(); } }
  /** Reads one line. */
  readLine = (x) => { return x; };
  /** Nothing here. */

  far() {}
}
/** Sums both parts. */
export const sumUp = (a: number, b: number): number => a + b;
"""
GO = """// Serve answers until the socket closes.
//go:noinline
func (s *Server) Serve(a []int) error {
	return nil
}

// Not attached to it.

func Free() {}
//go:noinline
func Bare() {}
"""
RS = """impl T {
    /// Reads 'a' frame from the wire.
    #[inline]
    pub(crate) async fn read_frame<'a>(&'a self) -> Option<&'a str> { let c = '{'; Some(r#"fn x() {"#) }
    // plain words
    fn plain(&self) {}
}
"""
ZIG = """/// Frees all pages at once.
pub fn freeAll(a: []const u8) !void {
    const s = "fn no() {";
}
//// four slashes
fn four() void {}
"""


def test_five_languages(spark):
    rows = [("py", "a/b.py", PY), ("ts", "x.ts", TS), ("go", "x.go", GO), ("rs", "x.rs", RS), ("zig", "x.zig", ZIG), ("crlf", "y.py", PY.replace("\n", "\r\n")), ("nul", "x.py", None), ("e", "x.py", ""), ("md", "x.md", PY), ("np", None, PY), ("bad", "x.py", "def broken(:\n  pass")]
    got = {(a, b) for a, b, _ in run(spark, rows)}
    assert got == {
        *[("py", x) for x in ("outer", "inner")], *[("crlf", x) for x in ("outer", "inner")],
        *[("ts", x) for x in ("openGate", "mergeAll", "readLine", "sumUp")], ("go", "Serve"), ("rs", "read_frame"), ("zig", "freeAll"),
    }
    assert run(spark, []) == set()


def test_exact_ranges(spark):
    df = spark.createDataFrame([("a", "x.rs", RS)], "id string, path string, text string")
    r = function_docs(df, key="id", path="path", text="text").first()
    assert RS[r.start : r.stop] == r.code and r.code.startswith("#[inline]") and r.code.endswith("}") and r.documentation == "Reads 'a' frame from the wire."


@pytest.mark.parametrize(
    "doc,name,ok",
    [
        (None, "f", False), ("", "f", False), ("...", "f", False), ("TODO", "f", False), ("todo: write it", "f", False), ("FIXME document me before the release", "f", False), ("Todo ranks are gathered from the watcher.", "f", True),
        ("Add docs.", "f", False), ("Beschreibung folgt.", "f", False), ("À compléter.", "f", False), ("[description]", "f", False), ("Merge cold part.", "mergeColdPart", False), ("This function is merge cold part.", "merge_cold_part", False),
        ("Merges the cold parts.", "merge_cold_part", False), ("Merges cold parts into one.", "merge_cold_part", True), ("@param a\n@returns", "f", False), (":param a:\n:return:", "f", False), ("Args:\n    a:\n    b:", "f", False),
        ("Args:\n    a: how far it goes", "f", True), ("@returns the distance in metres", "f", True), ("Replays a sketch", "replaySketch", False), ("_____", "f", False),
    ],
)
def test_says_something(doc, name, ok):
    assert says_something(doc, name) is ok


def test_notes_to_write_it_later():
    from lodestrata.llm.function_docs import says_something

    for doc in ("Auto-generated stub, to be filled in later.", "Generated by the scaffold; add text.", "Description must still be provided. " * 6, "Docs to be completed", "[description]"):
        assert not says_something(doc, "packOrders"), doc
    for doc in ("Stub commits count as lazy here, so the caller retracts them first.", "Generated headings are adjacent until the fence can forward.", "Adds text to the template.", "Closes."):
        assert says_something(doc, "packOrders"), doc
    assert not says_something("Closes.", "packOrders", min_words=2)


def test_python_behind_a_broken_function_is_kept(spark):
    bad = "def one():\n    '''First of all.'''\n    return (1\n\ndef two():\n    '''Second of all.'''\n\nclass C(:\n    def three(self):\n        '''Third of all.'''\n"
    df = spark.createDataFrame([("a", "a.py", bad)], "id string, path string, t string")
    assert {r.func_name for r in function_docs(df, key="id", path="path", text="t").collect()} == {"two", "three"}
