"""Violation tables: (rule, key, …), empty if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key): a row for each rule that a row breaks. A rule is a condition that must not hold; null is no breach."""
    broken = F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def required_operands(published: DataFrame, fields: list[str]) -> DataFrame:
    """(rule, key) of counts that a one-row artefact lacks; an absent count is a fault, never 0."""
    return violations(published.withColumn("_", F.lit("artefact")), "_", {f"missing {f}": F.col(f).isNull() for f in fields})


def denied(rows: DataFrame, column: str, deny: list[str]) -> DataFrame:
    """(rule, key) of listed values that occur; an empty list is itself a fault."""
    if not deny:
        return rows.sparkSession.createDataFrame([("empty deny list", column)], "rule string, key string")
    return rows.where(F.col(column).isin(deny)).select(F.lit("retired").alias("rule"), F.col(column).cast("string").alias("key")).distinct()


def glob_regex(glob: str) -> str:
    """A pattern for names: * for any run, all else as it is."""
    return "^" + "".join(".*" if c == "*" else "\\" + c if c in ".^$+?{}[]|()\\" else c for c in glob) + "$"


def last_match(names: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """names with excluded and rule: of the ordered rules (glob, or !glob to take back) the last that matches decides."""
    found = [F.struct(F.lit(i).alias("i"), F.lit(not r.startswith("!")).alias("out"), F.lit(r).alias("rule")) for i, r in enumerate(rules)]
    hits = F.array_compact(F.array(*(F.when(F.col(column).rlike(glob_regex(r.removeprefix("!"))), s) for r, s in zip(rules, found, strict=True))))
    last = F.try_element_at(hits, F.lit(-1))
    return names.withColumn("excluded", F.coalesce(last["out"], F.lit(False))).withColumn("rule", last["rule"])


def agreement(values: dict[str, float | None]) -> list[str]:
    """What is wrong between terms that must be equal: missing, not a number, or differing."""
    out = [f"{k} is missing" for k, v in values.items() if v is None] + [f"{k} is not a number" for k, v in values.items() if v is not None and v != v]
    known = {v for v in values.values() if v is not None and v == v}
    return out + (["terms differ"] if len(known) > 1 else [])


def tightened(registered: float, requested: float | None) -> float:
    """An override may only tighten a registered limit."""
    return registered if requested is None else min(registered, requested)


#: Statuses of pages that are no longer there; they end the attempts at a source, as does a host that has no address.
GONE_STATUS = [404, 410]


def attempt_kind(ok: Column, challenged: Column, status: Column, code: Column, reason: Column) -> Column:
    """What an attempt to read a source came to: read, challenge (an interstitial in place of the page), gone, dns, http
    (an answer without a page), or network (no answer). A resolver that didn't answer is network, never dns; the text of
    the reason counts only where there is neither code nor status."""
    unnamed = code.isNull() & status.isNull() & F.coalesce(reason, F.lit("")).rlike(r"\bENOTFOUND\b")
    held = F.coalesce(ok, F.lit(False))
    return (
        F.when(held & ~F.coalesce(challenged, F.lit(False)), "read")
        .when(held, "challenge")
        .when(status.isin(GONE_STATUS), "gone")
        .when((code == "ENOTFOUND") | unnamed, "dns")
        .when(status.isNotNull(), "http")
        .otherwise("network")
    )


def attempt_outcomes(attempts: DataFrame, by: list[str], place: Column, kind: Column) -> DataFrame:
    """by, outcome, fault, decided_at, attempts: attempts at each source as one. A read wins, then the first that is final (gone, dns:
    the evidence is at fault), then what the last one came to (infrastructure, to be tried again). decided_at
    is the place of the attempt that decides."""
    rows = attempts.select(*by, place.alias("_place"), kind.alias("_kind"))
    of = lambda *kinds: F.when(F.col("_kind").isin(*kinds), F.struct("_place", "_kind"))
    found = rows.groupBy(*by).agg(F.min(of("read")).alias("read"), F.min(of("gone", "dns")).alias("final"), F.max(F.struct("_place", "_kind")).alias("last"), F.count("*").alias("attempts"))
    decides = F.coalesce("read", "final", "last")
    fault = F.when(F.col("read").isNotNull(), "none").when(F.col("final").isNotNull(), "evidence").otherwise("infrastructure")
    return found.select(*by, decides["_kind"].alias("outcome"), fault.alias("fault"), decides["_place"].alias("decided_at"), "attempts")


def after_pivot(rows: DataFrame, by: list[str], place: Column, pivot: Column, forbidden: Column, unless: Column, strictly: bool = False) -> DataFrame:
    """Rows that are forbidden, and not excused by `unless`, once the first pivot row of their group is reached, or after
    it if strictly. Groups without a pivot row forbid nothing; nulls are no match."""
    first = rows.groupBy(*by).agg(F.min(F.when(pivot, place)).alias("_first")).where("_first is not null")
    suspect = rows.where(forbidden & ~F.coalesce(unless, F.lit(False))).withColumn("_place", place)
    later = F.col("_place") > F.col("_first") if strictly else F.col("_place") >= F.col("_first")
    return suspect.join(first, by).where(later).drop("_place", "_first")


def hosts_named(files: DataFrame, name: str, text: str) -> DataFrame:
    """(name, host, n): each host that a file's text names in an http or https url, lower case, and how often."""
    hosts = F.transform(F.regexp_extract_all(text, F.lit("https?://([A-Za-z0-9.-]+)"), F.lit(1)), F.lower)
    return files.select(name, F.explode(hosts).alias("host")).groupBy(name, "host").agg(F.count("*").alias("n"))


def scan_faults(files: DataFrame, named: DataFrame) -> DataFrame:
    """(rule, key): a scan that read no file or found no host has approved nothing, which is a fault."""
    read = files.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no files read").alias("rule"), F.lit("scan").alias("key"))
    found = named.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no hosts found").alias("rule"), F.lit("scan").alias("key"))
    return read.union(found)


def host_verdicts(named: DataFrame, retired: dict[str, str], declared: list[str]) -> DataFrame:
    """named (.., host) with verdict and why: retired hosts with the reason given, hosts on neither list as undeclared."""
    known = [(h, "retired", why) for h, why in retired.items()] + [(h, "allowed", None) for h in declared if h not in retired]
    table = F.broadcast(named.sparkSession.createDataFrame(known, "host string, verdict string, why string"))  # as long as the lists
    return named.join(table, "host", "left").withColumn("verdict", F.coalesce("verdict", F.lit("undeclared")))
