"""Documents that hold template residue or filler, or that are nothing but an error page or a notice about scripts.

All lines of all documents outside code, of any length, and their sentences are normalised (marks, tags and case off;
numbers, dates, addresses and hexadecimal ids masked), hashed and grouped: one aggregation counts in how many documents
and sources each occurs. A unit is judged once, by phrases and placeholder rules, and the same for its whole group; what
recurs across sources is judged by wider rules than what doesn't:

* A group that recurs and has a cue of filler ("dummy text", "... here") is filler, and every document that holds it
  is residue. Slots, blind text and phrases that can be nothing else count wherever they stand, as the sentences around
  them don't recur.
* A group that recurs and has a cue of a message ("not found", "expired") is a message; so is a line that is a message
  from its first word to its last, however rare. A document is a page if one line at least is a message and every other
  is page furniture: known furniture, or a line that recurs.

The scan works on whole Arrow columns with RE2 (no backtracking, all alternatives in one pass), as Java's expressions
took about four times the CPU seconds. Patterns keep to what RE2 has: no look-around, no back references.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize, spread

# Forms of unfilled slots.
SLOTS = [
    r"\{\{[^{}]+\}\}",
    r"\{%[^%]+%\}",
    r"<%[^%]+%>",
    r"\$\{[A-Za-z_][\w.]*\}",
    r"\$[A-Z][A-Z0-9_]*\$",
    r"%[A-Z][A-Z0-9_]*%",
    r"%\([A-Za-z_]\w*\)[sd]",
    r"#\{[A-Za-z_][\w.]*\}",
    r"(?:^|[^\w$#{%])\{[A-Za-z_][\w.]*\}",
    r"(?:^|[^\w$#{%)\]])\{\d\d?\}",
    r"\[\[[A-Za-z][^\[\]]*\]\]",
    r"\[(?i:insert|your|enter|fill in)\b[^\[\]]+\](?:[^(]|$)",
    r"\[[^\[\]]+ (?i:goes here)\]",
    r"<(?i:insert|your|enter|fill in)[ -][^<>]+>",
    r"<[A-Za-z]+[-_ ](?i:name)>",
    r"\bXX+[-_][A-Z]+(?:[-_][A-Z]+)*[-_]XX+\b",
    r"(?:^|\W)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?:\W|$)",
    r"@@[A-Z][A-Z0-9_]*@@",
]

# Words of the classical blind text.
BLIND_WORDS = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore
magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident
sunt culpa qui officia deserunt mollit anim id est laborum augue felis lacus ligula massa mattis mauris morbi nunc orci
ornare pellentesque porta tellus tortor urna varius vestibulum vitae viverra""".split()
#: Words of them that are long and strange enough to tell blind text by.
_BLIND_MARKS = "lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud augue felis massa mattis mauris morbi nulla ornare pellentesque porta tortor varius vestibulum vitae viverra".split()
# Function words; a sentence that has one is told in a language.
FUNCTION_WORDS = set(
    """the a an and or of to in is are was for with that this it its by on as at from be not
der die das ein eine einen einem und oder ist sind war nicht mit für von zu im den dem des als auf wenn
le la les un une des et ou est sont du pas avec pour dans que qui au aux ce cette
el los las una unos y o es son del con para por en no se lo su""".split()
)

# Parts of filler phrases.
_FILL_NOUN = r"(?:sample|dummy|filler|placeholder|fake|mock|blind)"
_FILL_NOUN_X = r"(?:blindtext|mustertext|platzhaltertext|fülltext|beispieltext|faux[ -]texte|texte (?:factice|fictif|provisoire|de remplissage)|texto (?:de relleno|simulado|ficticio|provisional|de muestra))"
_THING = r"(?:text|copy|content|contents|words|paragraph|intro|introduction|summary|body|description)"
#: Phrases that can be nothing but filler.
FILLER = [
    rf"\b{_FILL_NOUN} text(?:[ .,]+{_FILL_NOUN} text)+",
    r"\btext[ .,]+text[ .,]+text[ .,]+text\b",
    r"\bblah[ .,]+blah\b",
    r"\b(?:asdf|qwer|qwerty|jkl|hjkl)[ .,]+(?:asdf|qwer|qwerty|jkl|hjkl)[ .,]+(?:asdf|qwer|qwerty|jkl|hjkl)\b",
    rf"\b(?:your|the|some) {_THING} (?:goes|will go|comes) here\b",
    rf"\b(?:put|write|paste|enter|add|insert|type) (?:a|an|the|your|some) (?:\w+ )?(?:\w+ )?{_THING} (?:of (?:the|this) \w+ )?here\b",
    rf"^{_FILL_NOUN} (?:text|copy|paragraph|content)\b(?: (?:used|only|to|for|here|until|in)\b.*)?[.!]?$",
    rf"^this is (?:only |just )?(?:a |some )?{_FILL_NOUN} (?:text|copy|paragraph|content)\b.*",
    r"^(?:type|write|enter) something (?:\w+ )?(?:here|in this (?:box|field))\b.*",
    r"\bhier (?:steht|kommt|folgt|erscheint) (?:später |noch |bald )?(?:ihr|dein|euer|der) (?:text|inhalt)\b",
    rf"^(?:dies|das|hier) ist (?:nur |lediglich )?(?:ein |der )?{_FILL_NOUN_X}\b.*",
    rf"^bitte diese[ns]? {_FILL_NOUN_X} .*ersetzen[.!]?$",
    r"\b(?:votre|le) (?:texte|contenu) (?:viendra|ira|apparaîtra|sera placé) ici\b",
    rf"^(?:ceci|voici) est (?:un |du )?{_FILL_NOUN_X}.*",
    r"\baqu[ií] (?:irá|va|aparecerá) (?:su|tu|el) (?:texto|contenido)\b",
    r"\b(?:escriba|escribe|inserte|introduzca|ponga) aquí (?:el|su|tu) (?:texto|contenido)\b",
    rf"^(?:esto|este) es (?:un |sólo |solo )?{_FILL_NOUN_X}.*",
    rf"^{_FILL_NOUN_X}[ ,:]+(?:à|en attente|pendiente|por|para|zu|noch)\b.*",
]
#: Cues of filler; a sentence that has one must recur to count.
FILLER_CUES = [
    rf"\b{_FILL_NOUN} (?:text|copy|content|paragraph)\b",
    rf"{_FILL_NOUN_X}",
    r"^(?:please |bitte |por favor,? )?(?:put|write|paste|enter|add|insert|type|schreiben|fügen|écrivez|saisissez|insérez|escriba|escribe|inserte|introduzca) .*(?:text|texte|texto|copy|content|contenu|contenido|inhalt|words|intro)\b.*\b(?:here|hier|ici|aquí)[.!]?$",
]

# Cues of errors, refusals and notices in four languages; a line that has one must recur to count.
MESSAGE_CUES = """not found|does not exist|do not exist|no longer exist|nothing at this|nothing here|has moved|been removed|unavailable|not available|offline for|under maintenance|bad gateway|bad request|gateway time|internal server error|server error|could not handle|could not process|could not complete|could not be loaded|went wrong|unhandled exception|timed out|connection refused|access denied|permission denied|forbidden|unauthorized|unauthorised|too many requests|slow down|has expired|sign in again|are human|are a human|returned status|nicht gefunden|existiert nicht|gibt es nichts|nicht erreichbar|nicht verfügbar|verweigert|abgelaufen|fehler 0|introuvable|n'existe pas|aucun contenu|indisponible|refusé|expiré|no encontrad|no existe|no hay nada|no hay ning|no está disponible|no disponible|denegado|caducad|javascript|allow script|enable script|needs script|requires script|without script|active script|scripting|skripte|scripts activ|scripts autoris|scripts soient|scripts habilit|sin scripts""".split("|")

# What whole lines of errors and refusals are made of, after normalisation.
_SORRY = r"(?:(?:oops|sorry|uh-oh|hm+|whoops|ouch|we are sorry|we're sorry|apologies)[,:!.]? )"
_REASON = r"(?:page not found|not found|bad gateway|bad request|forbidden|unauthori[sz]ed|access denied|permission denied|internal server error|server error|service unavailable|gateway time-?out|request time-?out|too many requests|not available|unavailable)"
_REASON_X = r"(?:seite nicht gefunden|nicht gefunden|zugriff verweigert|page introuvable|introuvable|accès refusé|p[aá]gina no encontrada|no encontrada?|acceso denegado)"
_REF = r"(?: (?:code|reference|ref|kennung|référence|referencia)[: ]*[0#]+\.?)?"
_CODE = r"(?:(?:error|http|status|fehler|erreur) ?)?(?:0 ?[-:–]? ?)?"
_SCRIPT = r"(?:javascript|js|scripts?|scripting|active scripting|client-side scripting|skripten?)"
ERRORS = [
    rf"{_SORRY}.*(?:does not exist|do not exist|timed out|returned status 0|could not be (?:loaded|found)|has been removed|is (?:not available|unavailable|gone)(?: right now)?|went wrong(?: on our (?:end|side))?|not found)\.?{_REF}",
    rf"{_CODE}{_REASON}[.!]?{_REF}",
    rf"{_CODE}{_REASON_X}[.!]?{_REF}",
    r"(?:error|http|status)(?: error)? ?0",
    r"(?:der dienst|die seite|der server) ist (?:gerade|derzeit|zurzeit|vorübergehend) nicht (?:erreichbar|verfügbar)\b.*",
    r"(?:le service|la page|le serveur) est (?:momentanément|actuellement|temporairement) indisponible\b.*",
    r"(?:el servicio|la página|el servidor) no está disponible\b.*",
    r"(?:unter|an) dieser adresse (?:gibt es|ist|liegt) (?:nichts|kein inhalt)\.?",
    r"(?:aucun contenu|aucune page|rien) à cette adresse\.?",
    r"no hay (?:nada|ning\S+ \S+|contenido) en esta dirección\.?",
    r"(?:we looked everywhere, but )?there is nothing (?:at this address|here)\.?",
    r"the page you (?:asked|are looking|were looking|requested)(?: for)? (?:has moved|does not exist|no longer exists|could not be found|was not found)\b.*",
    r"(?:the )?service (?:is )?temporarily (?:offline|unavailable)\b.*",
    r"the server could not (?:handle|process|complete) your request\b.*",
    r"too many requests\. .*",
    r"checking that you are (?:a )?human\b.*",
    r"(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?human\b.*",
    r"you (?:do not|don't) have (?:the )?(?:permission|access|rights) to .*",
    r"the (?:upstream|origin|backend)\b(?: [\w-]+)? (?:did not|could not|is not|is|has|timed|closed|returned|refused)\b.*",
    r"unhandled exception while \w+ this (?:view|page)\.?",
    r"\{\"(?:message|error|code|status)\":.*\}",
    r"(?:your|the|this) session (?:has )?(?:expired|timed out|ended)\b.*",
    r"(?:ihre|deine) sitzung ist abgelaufen\b.*",
    r"votre session a expiré\b.*",
    r"(?:su|tu|la) sesión ha (?:caducado|expirado)\b.*",
]
#: Whole lines that tell the reader to allow scripts.
NOTICES = [
    rf"(?:please |kindly |you (?:need to|must|have to|should) )*(?:enable|activate|turn on|switch on|allow) {_SCRIPT}\b.*",
    rf"{_SCRIPT} (?:is|are|has been|seems to be) (?:disabled|switched off|turned off|blocked)\b.*",
    rf"this (?:site|page|app|application|viewer) (?:needs|requires) {_SCRIPT}\b.*",
    rf"{_SORRY}.* (?:does not|will not|cannot|can't) (?:run|work|load) without {_SCRIPT}\b.*",
    rf"the \S+ (?:viewer|reader|page|app) (?:requires|needs) {_SCRIPT}\.?",
    rf"if nothing (?:appears|loads|happens), (?:allow|enable) {_SCRIPT}\b.*",
    rf"bitte (?:aktivieren|schalten|erlauben) sie {_SCRIPT}\b.*",
    r"diese (?:anwendung|seite) (?:läuft|funktioniert|arbeitet) (?:nur mit|nicht ohne)\b.*(?:skripten?|javascript)\b.*",
    r"diese (?:anwendung|seite) (?:benötigt|erfordert|braucht)\b.*(?:skripte?|javascript)\b.*",
    rf"veuillez (?:activer|autoriser) (?:les )?{_SCRIPT}\b.*",
    r"cette (?:application|page) (?:ne )?(?:fonctionne|marche|exige|nécessite|requiert)\b.*(?:scripts?|javascript)\b.*",
    rf"(?:active|habilite|por favor,? active) (?:los )?{_SCRIPT}\b.*",
    r"esta (?:aplicación|página) (?:no )?(?:funciona|exige|necesita|requiere)\b.*(?:scripts?|javascript)\b.*",
]

# Lines that pages put around their message.
FURNITURE = [
    r"menu|home|search|guides|reload|retry|back|notice|loading(?:\.\.\.|…)?|skip to content",
    r"home(?: \| [\w ]+)+",
    r"(?:go )?back to (?:the )?\w+(?: \w+)?",
    r"\(c\) .+|© .+",
    r"(?:please )?try again(?: later| in .+)?\.?",
    r"contact the .+",
    r"at \S+ \(.+\)",
    r"connection refused|retry-after: 0",
    r"[\w'-]+(?: [\w'-]+)?(?: [\w'-]+)?(?: [\w'-]+)?(?: \| [\w'-]+(?: [\w'-]+)?(?: [\w'-]+)?(?: [\w'-]+)?)+",
    r"(?:incident|ticket|request|error|trace|support|ray|ref|reference)(?: id| code| number)?[: ]+[0#]\S*",
]


def _any(rules: list[str]) -> str:
    return "|".join(f"(?:{x})" for x in rules)


def _whole(rules: list[str]) -> str:
    return "^(?:" + _any(rules) + ")$"


_SLOT = _any(SLOTS)
_FILLER, _FILLER_CUE = _any(FILLER), _any(FILLER_CUES)
_MESSAGE, _MESSAGE_CUE = _whole(ERRORS + NOTICES), _any([re.escape(x) for x in MESSAGE_CUES])
_FURNITURE = _whole(FURNITURE)
#: What a line must hold to be a message: a cue, or how a message without one begins or what it names.
_HINT = _MESSAGE_CUE + r"|\b(?:js|scripts?|skripten?)\b|^(?:error|http|status|[{]|you (?:do not|don't)|the (?:upstream|origin|backend)|checking|(?:please )?(?:verify|confirm|prove)|(?:ihre|deine) sitzung|votre session|(?:su|tu|la) sesión)"
_BLIND = r"\b(?:" + "|".join(_BLIND_MARKS) + r")\b"
#: Kinds of a line.
TEXT, KNOWN_FURNITURE, CUE, MESSAGE = 0, 1, 2, 3


def is_blind(unit: str) -> bool:
    """Blind text: five words or more of which none is a function word and a quarter, two at least, are classical, or
    nothing but classical words from two on."""
    words = re.findall(r"[^\W\d_]+", unit)
    known = sum(w in _BLIND_SET for w in words)
    if len(words) >= 2 and known == len(words):
        return True
    return len(words) >= 5 and known >= 2 and 4 * known >= len(words) and not any(w in FUNCTION_WORDS - _BLIND_SET for w in words)


_BLIND_SET = set(BLIND_WORDS)


def _match(x: pa.Array, pattern: str, gate: np.ndarray | None = None) -> np.ndarray:
    """Where the pattern is found; with a gate, only looked for there."""
    if gate is None:
        return pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False).astype(bool)
    out = np.zeros(len(x), dtype=bool)
    at = np.flatnonzero(gate)
    if len(at):
        out[at] = pc.match_substring_regex(x.take(pa.array(at)), pattern).to_numpy(zero_copy_only=False).astype(bool)
    return out


_OPEN = re.compile(r"\s*(`{3,}|~{3,})(.*)$")


def in_fences(lines: pa.Array, doc: np.ndarray) -> np.ndarray:
    """Lines of fenced blocks, with their fences; an open block ends with its text."""
    code = np.zeros(len(lines), dtype=bool)
    at = np.flatnonzero(_match(lines, r"^\s*(?:```|~~~)"))
    if not len(at):
        return code
    ends = np.searchsorted(doc, doc[at], side="right")
    open_doc, mark, start, stop = -1, "", 0, 0
    for i, end, text in zip(at.tolist(), ends.tolist(), lines.take(pa.array(at)).to_pylist()):
        if open_doc >= 0 and doc[i] != open_doc:
            code[start:stop] = True
            open_doc = -1
        m = _OPEN.match(text)
        if open_doc < 0:
            open_doc, mark, start, stop = int(doc[i]), m.group(1), i, end
        elif m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark) and not m.group(2).strip():
            code[start : i + 1] = True
            open_doc = -1
    if open_doc >= 0:
        code[start:stop] = True
    return code


def normal_lines(lines: pa.Array) -> pa.Array:
    """Tags and marks off, lower case, blanks joined; addresses, dates, hexadecimal ids and numbers masked."""
    x = pc.utf8_lower(pc.replace_substring_regex(lines, r"<[^<>]+>", " "))
    x = pc.utf8_trim_whitespace(pc.replace_substring_regex(x, r"\s+", " "))
    x = pc.replace_substring_regex(x, r"^(?:[#>*\-]+ )+", "")
    x = pc.replace_substring_regex(x, r"https?://\S+|[\w.+\-]+@[\w\-]+\.[\w.]+", "@")
    x = pc.replace_substring_regex(x, r"\b\d{4}-\d\d-\d\d(?:[t ]\d\d:\d\d(?::\d\d)?\S*)?", "0")
    x = pc.replace_substring_regex(x, r"\b[0-9a-f]{8,}\b", "#")
    return pc.replace_substring_regex(x, r"\d+(?:[.:]\d+)*", "0")


def _split(x: pa.Array, at: str) -> tuple[pa.Array, np.ndarray]:
    """Parts of all texts and the text of each."""
    parts = pc.split_pattern(x, at)
    return parts.flatten(), pc.list_parent_indices(parts).to_numpy()


_SCAN = "doc_id {key}, t long, s int, sure boolean, units array<long>, lines array<long>, kinds array<int>, cues array<long>"


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Values grouped by ``of``, which rises, into ``n`` lists."""
    off = np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: whether a rule is sure of residue, the hashes of all its units, and, for those documents that
    may be pages, its lines with their kinds; ``cues`` are the units with a cue of filler."""
    for big in batches:
        for start in range(0, big.num_rows, 2000):
            b = big.slice(start, 2000)
            key, source, text = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "s", "text"))
            n = len(text)
            raw, doc = _split(pc.replace_substring(pc.replace_substring(text, "\r\n", "\n"), "\r", "\n"), "\n")
            code = in_fences(raw, doc)
            normal = normal_lines(raw)
            full = pc.not_equal(normal, "").to_numpy(zero_copy_only=False)
            # outside code: slots, filler and the units that are counted
            out = np.flatnonzero(~code & full)
            plain, pdoc = raw.take(pa.array(out)), doc[out]
            tick = _match(plain, "`")
            if tick.any():
                plain = pc.if_else(pa.array(tick), pc.replace_substring_regex(plain, r"```[^`]+```|``[^`]+(?:`[^`]+)*``|`[^`]+`", " "), plain)
            slot = _match(plain, _SLOT, _match(plain, r"[\[{<$%@]|XX|__"))
            low = pc.if_else(pa.array(tick), normal_lines(plain), normal.take(pa.array(out)))
            several = _match(low, r"[.!?] \S")
            sentences, line = _split(pc.replace_substring_regex(low.take(pa.array(np.flatnonzero(several))), r"([.!?]) ", "\\1\n"), "\n")
            unit = pa.concat_arrays([low.cast(pa.string()), sentences.cast(pa.string())])
            udoc = np.concatenate([pdoc, pdoc[np.flatnonzero(several)[line]]])
            worded = _match(unit, r"\pL\pL")
            unit, udoc = unit.filter(pa.array(worded)), udoc[worded]
            h = pd.util.hash_array(unit.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
            filler = _match(unit, _FILLER)
            maybe = _match(unit, _BLIND)
            blind = np.zeros(len(unit), dtype=bool)
            at = np.flatnonzero(maybe)
            blind[at] = [is_blind(u) for u in unit.take(pa.array(at)).to_pylist()]
            sure = np.zeros(n, dtype=bool)
            sure[pdoc[slot]] = True
            sure[udoc[filler | blind]] = True
            cue = _match(unit, _FILLER_CUE) & ~sure[udoc]
            order = np.lexsort((h, udoc))
            first = np.ones(len(order), dtype=bool)
            first[1:] = (udoc[order][1:] != udoc[order][:-1]) | (h[order][1:] != h[order][:-1])
            once = order[first]
            # pages: all lines, code or not, of documents in which a line has a cue
            told = full & _match(normal, _HINT)
            page = np.zeros(n, dtype=bool)
            page[doc[told]] = True
            page &= ~sure
            of = np.flatnonzero(page[doc] & full)
            ln = normal.take(pa.array(of))
            kinds = np.zeros(len(of), dtype=np.int32)
            kinds[_match(ln, _MESSAGE_CUE)] = CUE
            kinds[_match(ln, _FURNITURE)] = KNOWN_FURNITURE
            kinds[_match(ln, _MESSAGE)] = MESSAGE
            lh = pd.util.hash_array(ln.to_numpy(zero_copy_only=False), categorize=False).view(np.int64) if len(ln) else np.empty(0, dtype=np.int64)
            cued = np.flatnonzero(cue)
            cued = cued[np.argsort(udoc[cued], kind="stable")]
            t = pd.util.hash_array(text.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(t), source, pa.array(sure), _lists(h[once], udoc[once], n, pa.int64()), _lists(lh, doc[of], n, pa.int64()), _lists(kinds, doc[of], n, pa.int32()), _lists(h[cued], udoc[cued], n, pa.int64())],
                names=["doc_id", "t", "s", "sure", "units", "lines", "kinds", "cues"],
            )


def scanned(docs: DataFrame, *, key: str, text: str, source: str) -> DataFrame:
    """The one scan that looks at whole texts. Sources fall into 63 classes by hash."""
    of = F.pmod(F.xxhash64(F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))), F.lit(63)).cast("int")
    one = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), of.alias("s"), F.col(text).alias("text")))
    return one.mapInArrow(_scan, _SCAN.format(key=docs.schema[key].dataType.simpleString()))


def unit_counts(seen: DataFrame) -> DataFrame:
    """``h, n, n_sources`` of every normalised line and sentence of all documents: in how many documents it occurs, and
    in how many of 63 classes of sources, a lower bound that needs one long a unit."""
    return seen.select("s", F.explode("units").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, s)"))).alias("n_sources"))


def recurring(counts: DataFrame, total: int, *, min_share: float, min_rows: int, min_sources: int) -> DataFrame:
    """``h, recurs`` of the units that occur in ``min_share`` of all documents (``min_rows`` at least) and in ``min_sources``
    sources."""
    return counts.where((F.col("n") >= max(min_rows, min_share * total)) & (F.col("n_sources") >= min_sources)).select("h", F.lit(True).alias("recurs"))


def residue(docs: DataFrame, *, key: str, text: str, source: str, min_share: float = 0.0002, min_rows: int = 5, min_sources: int = 3) -> DataFrame:
    """``doc_id, kind`` of the documents to leave out: kind is residue (slots or filler, which comes first) or page.

    Null, empty and blank texts are no cases. A key that occurs twice is judged by each of its rows; rows are distinct.
    Other columns are not looked at. An empty table gives no rows."""
    seen = materialize(scanned(docs, key=key, text=text, source=source))
    often = recurring(unit_counts(seen), seen.count(), min_share=min_share, min_rows=min_rows, min_sources=min_sources)
    # groups that documents ask for; they are read once for filler and pages
    lines = seen.where(F.size("lines") > 0).select("doc_id", "t", F.explode(F.arrays_zip("lines", "kinds")).alias("l")).select("doc_id", "t", F.col("l.lines").alias("h"), F.col("l.kinds").alias("kind"))
    cues = seen.where(~F.col("sure") & (F.size("cues") > 0)).select("doc_id", "t", F.explode("cues").alias("h"), F.lit(-1).alias("kind"))
    recurs = F.coalesce("recurs", F.lit(False))
    judged = lines.unionByName(cues).join(often, "h", "left").groupBy("doc_id", "t").agg(
        F.max((F.col("kind") == -1) & recurs).alias("filler"),
        F.max((F.col("kind") == MESSAGE) | ((F.col("kind") == CUE) & recurs)).alias("some"),
        F.max(F.col("kind").isin(TEXT, CUE) & ~recurs).alias("other"),
    )
    found = judged.where("filler or (some and not other)").select("doc_id", F.when(F.col("filler"), "residue").otherwise("page").alias("kind"))
    return seen.where("sure").select("doc_id", F.lit("residue").alias("kind")).unionByName(found).groupBy("doc_id").agg(F.max("kind").alias("kind"))


def residue_documents(documents: DataFrame) -> DataFrame:
    return residue(documents, key="doc_id", text="text", source="source")
