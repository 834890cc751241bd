"""Verifiers of claims by type, as functions from claims and the repository's tables to verdicts, in one registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import claims as C

Verifier = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
REGISTRY: dict[str, Verifier] = {}


def verifier(*types: str) -> Callable[[Verifier], Verifier]:
    def add(f: Verifier) -> Verifier:
        for t in types:
            REGISTRY[t] = f
        return f

    return add


def verdict(v: str, c: float) -> Column:
    return F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence"))


@verifier("symbol_exists", "file_path")
def symbols_and_files(claims: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    return C.verify(claims, repo["symbols"], repo["files"])


# Capitals that are known terms and need no variable.
KNOWN_TERMS = """ENTRYPOINT WORKDIR EXPOSE VOLUME STOPSIGNAL HEALTHCHECK ONBUILD MAINTAINER LABEL COPY ADD STARTING STOPPING
DESTROYING PROVISIONING UNTRUSTED_AGENT UNTRUSTED_GRADING TRUSTED_INTERNAL SHARED CONTAINER LOCALHOST EMPTYDIR""".split()
#: Places of evidence that are shown.
MOST_EVIDENCE = 5


@verifier("env_var_name")
def variables(claims: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """Known terms; else quoted words of code equal to the name; else words it is a prefix of; else words that share its
    first eight characters (then it is stale). Each step is an equi join on a key of the word."""
    strings = repo["strings"].where(~(F.startswith("path", F.lit("docs/")) | F.endswith("path", F.lit(".md"))))
    words = strings.select("value").where("value is not null").distinct()
    parts = F.split("value", "_")
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))).alias("k"), F.size(parts).alias("n")).where("n > 1").select("k").distinct().withColumn("prefix", F.lit(True))
    starts = words.select(F.upper(F.substring("value", 1, 8)).alias("s")).distinct().withColumn("similar", F.lit(True))
    c = claims.select("claim_id", "claim_type", F.col("subject").alias("v"))
    j = c.join(words.select(F.col("value").alias("v"), F.lit(True).alias("exact")), "v", "left").withColumn("k", F.regexp_replace("v", "_+$", "")).withColumn("s", F.upper(F.substring("v", 1, 8)))
    j = j.join(prefixes, "k", "left").join(starts, "s", "left")
    out = F.when(F.col("v").isin(KNOWN_TERMS), verdict("confirmed", 0.5)).when(F.col("exact"), verdict("confirmed", 0.9)).when(F.col("prefix"), verdict("confirmed", 0.75)).when(F.col("similar"), verdict("stale_target", 0.7)).otherwise(verdict("contradicted", 0.6))
    return j.select("claim_id", "claim_type", out.alias("r")).select("claim_id", "claim_type", "r.*")


@verifier("numeric_value")
def numbers(claims: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """A number that stands in quotes in code is confirmed; others can't be verified, as no index of words holds them. Whole
    numbers are looked up without a fraction."""
    words = repo["strings"].select(F.col("value").alias("v"), F.lit(True).alias("hit")).distinct()
    n = F.col("subject").cast("double")
    v = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(F.col("subject"))
    r = F.when(F.col("hit"), verdict("confirmed", 0.7)).otherwise(verdict("unverifiable", 0.3))
    return claims.select("claim_id", "claim_type", v.alias("v")).join(words, "v", "left").select("claim_id", "claim_type", r.alias("r")).select("claim_id", "claim_type", "r.*")


def _first_enum(claims: DataFrame, enums: DataFrame) -> DataFrame:
    """``claim_id, members`` of the first enum, by path and place in it, whose name holds the claim's noun or stands in its text or
    section. The enums' names, which are few (one row a name), are matched as they are: a name within a text is no key."""
    e = _with(enums, "path").groupBy("name").agg(F.min_by("members", F.struct("path")).alias("members"), F.struct(F.min("path").alias("path"), F.first("name").alias("name")).alias("k"))
    noun = F.lower(F.regexp_replace(F.regexp_extract("subject", r"^\d+\s+(\w+)$", 1), "s+$", ""))
    said = F.lower(F.concat_ws("\n", "line", "section"))
    c = claims.select("claim_id", F.lower(F.coalesce(noun, F.lit(""))).alias("noun"), said.alias("said"))
    low = F.lower(F.col("name"))
    hit = c.join(e, ((F.col("noun") != "") & F.contains(low, F.col("noun"))) | F.contains(F.col("said"), low))
    return hit.groupBy("claim_id").agg(F.min_by("members", "k").alias("members"), F.min_by("name", "k").alias("enum"))


def _with(df: DataFrame, *columns: str) -> DataFrame:
    """The table with these columns, as nulls where it lacks them."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


@verifier("enum_count")
def enum_counts(claims: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """The number claimed against the members of the enum that the claim is about; without one it can't be verified."""
    c = _with(claims, "line", "section")
    n = F.regexp_extract("subject", r"^(\d+)", 1).cast("long")
    m = F.size("members")
    r = F.when(F.col("members").isNull(), verdict("unverifiable", 0.3)).when(m == n, verdict("confirmed", 0.95)).otherwise(verdict("contradicted", 0.9))
    return c.join(_first_enum(c, repo["enums"]), "claim_id", "left").select("claim_id", "claim_type", r.alias("r")).select("claim_id", "claim_type", "r.*")


@verifier("enum_members")
def enum_members(claims: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """Members claimed (``members``, of the enum ``subject``) against the first enum whose name holds the subject: all of them must
    be there; what it has besides doesn't matter. ``member_differences`` tells both differences."""
    d = member_differences(claims, repo["enums"])
    r = F.when(F.col("enum").isNull(), verdict("unverifiable", 0.0)).when(F.size("missing") == 0, verdict("confirmed", 0.95)).otherwise(verdict("contradicted", 0.9))
    return claims.select("claim_id", "claim_type").join(d, "claim_id", "left").select("claim_id", "claim_type", r.alias("r")).select("claim_id", "claim_type", "r.*")


def member_differences(claims: DataFrame, enums: DataFrame) -> DataFrame:
    """``claim_id, enum, missing, extra`` of claims about an enum's members, both differences sorted."""
    if "members" not in claims.columns:
        claims = claims.withColumn("members", F.array().cast("array<string>"))
    e = _with(enums, "path").select(F.col("name").alias("enum"), F.col("members").alias("have"), F.struct("path", "name").alias("k"))
    c = claims.select("claim_id", F.lower(F.coalesce("subject", F.lit(""))).alias("of"), "members")
    one = c.join(e, F.contains(F.lower("enum"), F.col("of"))).groupBy("claim_id").agg(F.min_by(F.struct("enum", "have", "members"), "k").alias("r")).select("claim_id", "r.*")
    diff = lambda x, y: F.array_sort(F.array_except(x, y))
    return one.select("claim_id", "enum", diff(F.col("members"), F.col("have")).alias("missing"), diff(F.col("have"), F.col("members")).alias("extra"))


def evidence(claims: DataFrame, repo: dict[str, DataFrame], most: int = MOST_EVIDENCE) -> DataFrame:
    """``claim_id, place, path``: the first files, by path, that hold a claim's word in quotes. Of each word no more than ``most`` files
    are kept before they are joined with claims, so a word in all files is no hot key."""
    w = Window.partitionBy("value").orderBy("path")
    files = repo["strings"].select("value", "path").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    c = claims.select("claim_id", F.regexp_replace("subject", r"\(\)$", "").alias("value"))
    return c.join(files, "value").select("claim_id", "place", "path")


@verifier("route_path")
def routes(claims: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """A route equal to a known one or a suffix of it or the other way round, by joining all suffixes at slashes."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"[.,;:)]+$", ""), "^/+|/+$", "")
    parts = F.split("p", "/")
    suffixes = lambda df: df.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("k")).where("k <> ''")
    known = repo["routes"].select(norm(F.col("route")).alias("p")).distinct()
    c = claims.select("claim_id", "claim_type", norm(F.col("subject")).alias("p"))
    up = suffixes(known).select(F.col("k").alias("p")).distinct().withColumn("a", F.lit(True))
    down = suffixes(c).join(known.select(F.col("p").alias("k")), "k", "left_semi").select("claim_id").distinct().withColumn("b", F.lit(True))
    ok = F.coalesce("a", "b", F.lit(False))
    r = F.when(ok, verdict("confirmed", 0.9)).otherwise(verdict("contradicted", 0.7))
    return c.join(up, "p", "left").join(down, "claim_id", "left").select("claim_id", "claim_type", r.alias("r")).select("claim_id", "claim_type", "r.*")


def verify_all(claims: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """``claim_id, claim_type, verdict, confidence`` of all claims by the registered verifiers; types without one are
    unverifiable. ``repo`` has symbols (name), files (path), strings (value, path), enums (path, name, members) and routes
    (route)."""
    out = claims.where(~F.col("claim_type").isin(list(REGISTRY))).select("claim_id", "claim_type", F.lit("unverifiable").alias("verdict"), F.lit(0.0).alias("confidence"))
    for f in dict.fromkeys(REGISTRY.values()):
        out = out.unionByName(f(claims.where(F.col("claim_type").isin([t for t, g in REGISTRY.items() if g is f])), repo))
    return out


def repository_index(files: DataFrame) -> dict[str, DataFrame]:
    """Words, routes and paths of source files (``path, text``), by patterns over lines."""
    t = files.where("text is not null")
    quoted = F.regexp_extract_all("text", F.lit(r"[\"']([A-Za-z][\w.\-/]*)[\"']"), F.lit(1))
    route = F.regexp_extract_all("text", F.lit(r"[\"'](/(?:api|ws)/v\d+/[^\s\"']+)[\"']"), F.lit(1))
    return {
        "strings": t.select("path", F.explode(F.array_distinct(quoted)).alias("value")),
        "routes": t.select(F.explode(F.array_distinct(route)).alias("route")).distinct(),
        "files": files.select("path").distinct(),
    }
