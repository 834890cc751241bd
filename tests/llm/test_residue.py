from lodestrata.llm.residue import residue

CASES = {
    "slot": "We signed {{ release.name }} today.", "env": "Path ${HOME_DIR} is set.", "name": "Dear <customer-name>, hello.", "insert": "See [INSERT TITLE HERE] first.", "here": "The [team name goes here] met.", "num": "Item {0} was sold.",
    "xx": "Ask XX-OWNER-XX about it.", "at": "Run @@JOB@@ now.", "filler": "Sample text sample text sample text.", "lorem": "Lorem ipsum dolor magna augue felis. More.", "open": "```\ncode\n```\nthen %(who)s said",
    "404": "Menu\n\n404 - Page not found\n\nBack to overview", "denied": "# Zugriff verweigert. Kennung 3a8977383ef6", "js": "<h1>notice</h1>\nPlease enable JavaScript to view this page.", "trace": "Unhandled exception while rendering this view\n  at a.b (c.js:40:3)\nconnection refused",
    "ref": "Access denied\r\n\r\nYou do not have permission to open this page.\r\nTicket 5add808a7773\r\n(c) the page guild",
}
FINE = {
    "code": "Use `{{ name }}` or `${X}` in it.", "fence": "```\n{{ name }}\nLorem ipsum dolor magna augue\n```\nfine", "unclosed": "text\n~~~\n{{ x }}", "set": "The set {7, 32} has two members, and <3> sorts first.", "explains": "A 404 from the cache means that it was never published.",
    "reports": "Access denied events rose after the change; most came from one rule.", "needs": "The draft dashboard needs JavaScript, while the plain report is served without it.", "answer": "```\n503 Service Unavailable\n```\n\nThis answer is normal.", "empty": "", "blank": " \n\t", "tiny": "manual", "link": "[your page](docs/x.md) is `__name__`",
    "quoted": "the linter accepts filler such as `your text goes here`; no more", "long": "A plain sentence about a cache. " * 20_000,
}


def test_cases(spark):
    rows = [(k, t, "s", "x") for k, t in {**CASES, **FINE, "null": None}.items()] + [("404", CASES["404"], None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, kind string")
    got = residue(df, key="doc_id", text="text", source="source").collect()
    assert sorted(r.doc_id for r in got) == sorted(CASES)
    assert {r.doc_id for r in got if r.kind == "page"} == {"404", "denied", "js", "trace", "ref"}
    assert residue(df.where("false"), key="doc_id", text="text", source="source").count() == 0


def test_recurring_lines_are_furniture(spark):
    page = "Startleiste\n\nBad gateway"
    rows = [(f"d{i}", "Startleiste\n\nA plain text about it.", f"s{i % 5}") for i in range(30)] + [("p", page, "s1"), ("q", "Selten\n\nBad gateway", "s1")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    assert [r.doc_id for r in residue(df, key="doc_id", text="text", source="source").collect()] == ["p"]


def test_recurring_filler_and_messages(spark):
    """Sentences that no rule names for sure count as filler or message once they recur across sources, in any language."""
    fill, told = "Hier wird noch ein Mustertext verwendet.", "Der Bereich ist für Gäste zurzeit nicht verfügbar."
    rows = [(f"f{i}", f"Abschnitt {chr(97 + i)} ist da. {fill}\n\nMehr {'x' * i} dazu.", f"s{i % 4}") for i in range(24)]
    rows += [(f"m{i}", told, f"s{i % 4}") for i in range(24)]
    rows += [("es", "Texto de relleno, pendiente de sustituir.", "s1"), ("fr", "Voici. Votre texte viendra ici.", "s1"), ("de", "Hier steht später Ihr Text.", "s2")]
    rows += [("once", "Ein Mustertext gehört nicht in ein fertiges Dokument.", "s1"), ("code", f"`{fill}` ist gemeint, Mustertext also.", "s2")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {r.doc_id: r.kind for r in residue(df, key="doc_id", text="text", source="source").collect()}
    assert got == {f"f{i}": "residue" for i in range(24)} | {f"m{i}": "page" for i in range(24)} | {"es": "residue", "fr": "residue", "de": "residue"}


def test_long_recurring_lines_are_furniture(spark):
    """A line of any length is furniture if it recurs, wherever in the page it stands; what recurs is relative to the input."""
    foot = "All times on these pages are given in the zone of the head office."
    page = f"Bad gateway\n\n{foot}"
    rows = [(f"d{i}", f"A plain text, number {chr(97 + i)}{'x' * i}.\n\n{foot}", f"s{i % 4}") for i in range(8)]
    rows += [("p", page, "s1"), ("mid", f"{foot}\n\n404 - Page not found\n\n{foot}", "s2"), ("q", "Bad gateway\n\nWhat the gateway of the mill looks like is told in another text.", "s1")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    run = lambda d: sorted(r.doc_id for r in residue(d, key="doc_id", text="text", source="source").collect())
    assert run(df) == ["mid", "p"]
    many = df.unionByName(spark.range(60_000).selectExpr("concat('z', id) AS doc_id", "concat('Note ', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "'s1' AS source"))
    assert run(many) == []


def test_blind_text_by_its_make():
    from lodestrata.llm.residue import is_blind

    assert is_blind("lorem lorem.") and is_blind("lorem ipsum dolor novum strangum latum.") and is_blind("morbi zzquist pellum vitae tortum")
    assert not is_blind("the word lorem ipsum is a sign of blind text in the page") and not is_blind("massa") and not is_blind("quick brown foxes jump over lazy magna")
