"""Typed claims mined from lines of documents, and their verification against what the repository holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of the claim types.
BACKTICK = r"`([A-Za-z_]\w*(?:\.\w+)*(?:\(\))?)`"
DEFAULT = r"(?i)(?:default(?:s to|s?:?\s*(?:is|=|of)?)|fallback(?:s to)?|limit(?:s to|:?\s*(?:is)?)?|timeout(?:s to|:?\s*(?:is)?)?|max(?:imum)?(?::\s*|\s+(?:is\s+)?)|min(?:imum)?(?::\s*|\s+(?:is\s+)?))\s*`?(\d[\d,]*(?:\.\d+)?)`?"
COUNT = r"(?i)\b(\d+)\s+(states?|members?|tools?|types?|modes?|roles?|strategies?|values?|fields?|methods?|endpoints?|tables?|columns?|modules?|images?|providers?|plugins?|handlers?|verifiers?)\b"
ENVVAR = r"\b([A-Z][A-Z0-9_]{2,})\b"
ROUTE = r"(/(?:api|ws)/v\d+/[^\s`'\"]+)"
FILE = r"`((?:src|docs|tests|scripts|infra|services|agents|harness|migrations|ui|evaluation)/[^\s`]+)`"
UNIVERSAL = r"(?i)\b(every|all|each|always|never|no|none of|must always|must never)\b"

# Words in capitals that name no variable.
ENVVAR_NOISE = """API URL GET POST PUT DELETE HEAD OPTIONS PATCH HTTP HTTPS TCP UDP DNS SSL TLS SSH SQL JSON YAML TOML CSV
HTML XML JWT HMAC TRUE FALSE NULL NONE YES AND NOT RLS ACL ACR ACI ACA IDS PID WS WSS WAL FTS UUID SHA LLM MCP CLI AST
NOTE TODO FIXME HACK XXX WIP TABLE INDEX WHERE FROM INTO SELECT PULLING PUSHING RUNNING BUILDING DEPLOYING CANCELLED
FAILED COMPLETED PENDING BLOCKED ENABLED DISABLED REQUIRED OPTIONAL DEFAULT EXAMPLE WARNING ERROR INFO DEBUG CRITICAL
IMPORTANT RECOMMENDED DEPRECATED BREAKING MUST SHALL SHOULD WILL WOULD COULD MAY""".split()
# Words between backticks that name no symbol.
SYMBOL_NOISE = """true false none self cls str int float bool list dict set tuple bytes type optional any union literal
object super print len range enumerate isinstance hasattr crash error warning info debug success failure running pending
done cancelled failed completed pulling pushing building deploying testing enabled disabled active inactive ready blocked
default custom manual automatic required example output input result response request config settings options params
args kwargs json yaml toml csv html xml txt log md localhost emptydir dockerfile llmproxy hostpath configmap secretref
nodeport id ok on off up no yes""".split()
FILENAME = r"(?i)^[a-z][\w.-]*\.(ya?ml|json|toml|md|txt|cfg|ini|env|lock|log|sh|bat|ps1)$"

CONFIDENCE = {"symbol_exists": 0.7, "numeric_value": 0.85, "enum_count": 0.8, "env_var_name": 0.8, "route_path": 0.9, "file_path": 0.95, "coverage_assertion": 0.4}
RULES = list(CONFIDENCE)


def lines(docs: DataFrame) -> DataFrame:
    """``doc, line_no, line, section, in_fence``: lines from 1 with the last heading above them, by running windows over the
    lines of each document."""
    arr = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    numbered = docs.where("text is not null").select("doc", F.posexplode(arr).alias("p", "line"))
    w = Window.partitionBy("doc").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("line").rlike(r"^\s*(```|~~~)")
    state = numbered.withColumn("mark", mark).withColumn("fences", F.sum(F.col("mark").cast("int")).over(w))
    inside = (F.col("fences") % 2 == 1) | F.col("mark")
    head = ~inside & F.col("line").rlike(r"^#{1,6}\s+\S")
    title = F.when(head, F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    out = state.withColumn("in_fence", inside).withColumn("head", head).withColumn("section", F.last(title, ignorenulls=True).over(w))
    return out.select("doc", (F.col("p") + 1).alias("line_no"), "line", F.coalesce("section", F.lit("")).alias("section"), "in_fence", "head")


def _noise(sym: Column) -> Column:
    low = F.lower(sym)
    plain = (sym == low) & ~F.contains(sym, F.lit("_"))
    return low.isin(SYMBOL_NOISE) | ((F.length(sym) < 6) & plain & ~F.contains(sym, F.lit("."))) | sym.rlike(FILENAME) | (plain & sym.rlike("(ing|ed)$"))


def extract(docs: DataFrame) -> DataFrame:
    """``doc, line_no, line, section, claim_type, subject, confidence, claim_id`` of documents (``doc, text``).

    At most one claim a line: the first rule that finds one decides, then its first match. All rules are evaluated as
    expressions of the line; the line is the only thing kept apart."""
    ln = lines(docs).where("not in_fence and not head").where(~F.col("line").rlike(r"^\s*(?:$|<!--)"))
    line = F.col("line")
    # value position: what stands before the backticks ends with an assignment or the word value
    syms = F.regexp_extract_all(line, F.lit(BACKTICK), F.lit(1))
    valued = F.regexp_extract_all(line, F.lit(r"(?:=|:|set to|value)\s*" + BACKTICK), F.lit(1))
    sym = F.get(F.filter(syms, lambda s: (F.length(s) >= 3) & ~((F.upper(s) == s) & (F.lower(s) != s)) & ~_noise(s) & ~F.array_contains(valued, s)), F.lit(0))
    value = F.nullif(F.replace(F.regexp_extract(line, DEFAULT, 1), F.lit(","), F.lit("")), F.lit(""))
    counts = F.regexp_extract_all(line, F.lit(COUNT), F.lit(0))
    count = F.get(F.filter(counts, lambda c: F.regexp_extract(c, r"^(\d+)", 1).cast("double") > 1), F.lit(0))
    context = F.lower(line).rlike("env|variable|inject|set|export")
    env = F.get(F.filter(F.regexp_extract_all(line, F.lit(ENVVAR), F.lit(1)), lambda v: (F.length(v) >= 4) & ~v.isin(ENVVAR_NOISE) & (F.contains(line, F.concat(F.lit("`"), v, F.lit("`"))) | context)), F.lit(0))
    route = F.nullif(F.regexp_extract(line, ROUTE, 1), F.lit(""))
    file = F.nullif(F.regexp_extract(line, FILE, 1), F.lit(""))
    universal = F.lower(F.nullif(F.regexp_extract(line, UNIVERSAL, 1), F.lit("")))
    subjects = [sym, value, count, env, route, file, universal]
    kind = F.lit(None).cast("string")
    for name, s in reversed(list(zip(RULES, subjects))):
        kind = F.when(s.isNotNull(), name).otherwise(kind)
    conf = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    cid = F.concat(F.lit("claim_"), F.substring(F.sha2(F.concat_ws(":", F.col("doc").cast("string"), F.col("line_no").cast("string"), F.trim(line)), 256), 1, 16))
    out = ln.select("doc", "line_no", "line", "section", kind.alias("claim_type"), F.coalesce(*subjects).alias("subject"), cid.alias("claim_id"))
    return out.where("claim_type is not null").withColumn("confidence", conf[F.col("claim_type")])


def verify(claims: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``claim_id, claim_type, verdict, confidence``: symbols (``name``) and file paths (``path``) of the repository.

    Symbols are looked up exactly, then by their last part, then without case; files as they are, then as a folder. Each step is an equi join on a key made beforehand, so no pair is compared that has no key in
    common. Claims of other types can't be verified here."""
    last = lambda c: F.regexp_extract(F.regexp_replace(c, r"\(\)$", ""), r"([^.]+)$", 1)
    sy = claims.where("claim_type = 'symbol_exists'").select("claim_id", "claim_type", F.regexp_replace("subject", r"\(\)$", "").alias("s"))
    step = lambda n, k: F.struct(F.lit(n).alias("step"), k.alias("k"))
    tried = F.array(step(1, F.concat(F.lit("x:"), F.col("s"))), step(2, F.concat(F.lit("l:"), last(F.col("s")))), step(3, F.concat(F.lit("i:"), F.lower(last(F.col("s"))))))
    forms = sy.select("claim_id", "claim_type", F.inline(tried))
    names = symbols.where("name is not null").select("name").distinct()
    keys = names.select(F.explode(F.array(F.concat(F.lit("x:"), F.col("name")), F.concat(F.lit("l:"), last(F.col("name"))), F.concat(F.lit("i:"), F.lower(last(F.col("name")))))).alias("k")).distinct().withColumn("hit", F.lit(True))
    found = forms.join(keys, "k", "left").groupBy("claim_id", "claim_type").agg(F.min(F.when(F.col("hit"), F.col("step"))).alias("step"))
    v_sym = found.select("claim_id", "claim_type", F.when(F.col("step").isNotNull(), "confirmed").otherwise("contradicted").alias("verdict"), F.when(F.col("step") == 1, 0.95).when(F.col("step") == 2, 0.85).when(F.col("step") == 3, 0.75).otherwise(0.7).alias("confidence"))
    fl = claims.where("claim_type = 'file_path'").select("claim_id", "claim_type", F.regexp_replace(F.replace("subject", F.lit("\\"), F.lit("/")), "/+$", "").alias("path"))
    paths = files.where("path is not null").select("path").distinct()
    parts = F.split("path", "/")
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct().withColumn("hit", F.lit(True))
    v_file = fl.join(folders, "path", "left").select("claim_id", "claim_type", F.when(F.col("hit"), "confirmed").otherwise("contradicted").alias("verdict"), F.when(F.col("hit"), 1.0).otherwise(0.95).alias("confidence"))
    rest = claims.where(~F.col("claim_type").isin("symbol_exists", "file_path")).select("claim_id", "claim_type", F.lit("unverifiable").alias("verdict"), F.lit(0.0).alias("confidence"))
    return v_sym.unionByName(v_file).unionByName(rest)


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    w = Window.partitionBy("claim_id").orderBy(F.desc("verified_at"), F.desc("code_fingerprint"))
    return verdicts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report(verdicts: DataFrame) -> DataFrame:
    """One row: verdicts by kind and the share confirmed of those that could be verified (0 without any)."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    verified = F.count_if(~F.col("verdict").isin("unverifiable", "error"))
    return verdicts.agg(F.count("*").alias("total"), n("confirmed").alias("confirmed"), n("contradicted").alias("contradicted"), n("unverifiable").alias("unverifiable"), F.when(verified > 0, F.round(n("confirmed") / verified, 6)).otherwise(0.0).alias("pass_rate"))


def _by_rarity(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, n, lo, hi, i, k``: the trigrams ``k`` of each name, the rarest (``counts``: ``k, c``) at place ``i`` = 0, with the
    size ``n`` of the set and 128 bits of it."""
    from lodestrata.functions.text import trigrams

    g = names.select("name", F.explode(trigrams(F.col("name"))).alias("k")).join(counts, "k", "left")
    own = g.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "k"))).alias("t"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x["k"]), F.lit(64)).cast("int"))
    half = lambda h: F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: F.when(F.pmod(F.hash(x["k"]), F.lit(2)) == h, acc.bitwiseOR(bit(x))).otherwise(acc))
    return own.select("name", F.size("t").alias("n"), half(0).alias("lo"), half(1).alias("hi"), "t").select("name", "n", "lo", "hi", F.posexplode("t").alias("i", "x")).select("name", "n", "lo", "hi", "i", "x.k")


def fuzzy_symbols(queries: DataFrame, symbols: DataFrame, *, least: float = 0.5, most: int = 5) -> DataFrame:
    """``query, name, similarity``: the most similar symbols above ``least`` (0 or more); no pair above it is lost.

    Pairs are found by equi joins, each for one way of being similar. Trigrams alike: two sets above ``least`` share one of the
    rarest of each (prefix filter); where its places or the bits of the sets leave too few others in common, the join drops the
    pair. One name in the other: its rarest trigram is one of the other's; if it has fewer than three letters, it is itself
    looked up among the other's letters. Snake forms: equal. Only what is left is compared."""
    from lodestrata.functions.text import snake, symbol_similarity, trigrams

    qs = queries.where("query is not null").select(F.col("query").alias("name")).distinct()
    names = symbols.where("name is not null").select("name").distinct()
    counts = names.select(F.explode(trigrams(F.col("name"))).alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    t = max(least - 1e-6, 0.0)  # similarities are rounded before they are compared
    alike = F.when(F.col("i") <= F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * t - 1e-9)), 0)
    first = F.col("i") == 0
    ways = lambda *w: F.explode(F.array_compact(F.array(*w))).alias("way")
    a = _by_rarity(qs, counts).select("*", ways(alike, F.when(first, 1), F.lit(2))).alias("a")
    b = _by_rarity(names, counts).select("*", ways(alike, F.lit(1), F.when(first, 2))).alias("b")
    c = lambda x: F.col(x)
    after = F.least(c("a.n") - c("a.i"), c("b.n") - c("b.i"))
    apart = F.bit_count(c("a.lo").bitwiseXOR(c("b.lo"))) + F.bit_count(c("a.hi").bitwiseXOR(c("b.hi")))
    enough = lambda common: common * (1 + t) >= (c("a.n") + c("b.n")) * t - 1e-9
    inside = lambda x, y: (c(f"{x}.n") <= c(f"{y}.n")) & (c(f"{x}.lo").bitwiseAND(c(f"{y}.lo")) == c(f"{x}.lo")) & (c(f"{x}.hi").bitwiseAND(c(f"{y}.hi")) == c(f"{x}.hi")) & F.contains(F.lower(f"{y}.name"), F.lower(f"{x}.name"))
    may = F.when(c("a.way") == 0, enough(after) & enough((c("a.n") + c("b.n") - apart) / 2)).when(c("a.way") == 1, inside("a", "b")).otherwise(inside("b", "a"))
    pair = [c("a.name").alias("query"), c("b.name").alias("name")]
    found = a.join(b, (c("a.k") == c("b.k")) & (c("a.way") == c("b.way")) & may).select(*pair)
    low = F.lower("name")
    held = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(low) + 1), lambda i: F.array(F.substring(low, i, F.lit(1)), F.substring(low, i, F.lit(2))))))
    short = lambda df: F.broadcast(df.where(F.length(low) < 3).select("name", low.alias("k")))
    letters = lambda df: df.select("name", F.explode(held).alias("k"))
    forms = lambda df: df.select("name", snake(F.col("name")).alias("k"))
    for x, y in ((short(qs), letters(names)), (letters(qs), short(names)), (forms(qs), forms(names))):
        found = found.unionByName(x.alias("a").join(y.alias("b"), c("a.k") == c("b.k")).select(*pair))
    pairs = found.distinct().withColumn("similarity", F.round(symbol_similarity(F.col("query"), F.col("name")), 6))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "name")
    # ranked before they are filtered, else Spark compares in the join, ahead of the join's own tests
    return pairs.withColumn("n", F.row_number().over(w)).where((F.col("n") <= most) & (F.col("similarity") > least)).drop("n")
