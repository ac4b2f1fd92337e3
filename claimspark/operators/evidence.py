"""Claims, the evidence mapped to them, and what its age makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.urls import registrable_host
from claimspark.operators import audit
from claimspark.operators.articles import host_gate
from pyspark.sql.window import Window

from claimspark.functions import dates as D


def newest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def channels(claims: DataFrame, mappings: DataFrame, as_of: Column, ceiling: int) -> DataFrame:
    """claims (claim_id, …) with published_at, age and channel: cited up to `ceiling` days, else context; uncited
    without a source. mappings: (claim_id, published_at), one row a claim. A mapping without a date fails the run."""
    dated = mappings.withColumn("published_at", F.coalesce("published_at", F.raise_error(F.lit("a source without a date"))))
    joined = claims.join(dated, "claim_id", "left").withColumn("age", D.age_days(F.col("published_at"), as_of))
    return joined.withColumn("channel", F.when(F.col("age").isNull(), "uncited").when(F.col("age") <= ceiling, "cited").otherwise("context"))


def coverage(found: DataFrame) -> DataFrame:
    """Counts over the channels of channels(): one row."""
    count = lambda c: F.count_if(F.col("channel") == c).alias(c)
    return found.agg(F.count("*").alias("total"), count("cited"), count("context"), count("uncited"), F.count_distinct("claim_id").alias("distinct_claims"), F.max(F.date_format("published_at", "yyyy-MM-dd")).alias("newest"))


def dispositions(references: DataFrame, as_of: Column, ceiling: int) -> DataFrame:
    """references (published_at, origin_at, …) with disposition: newer references than the origin's day are emitted, or
    demoted beyond the ceiling; those of its day or before are refused; without an origin they are unknown. Rows are
    never filtered, so that counts add up."""
    age = D.age_days(F.col("published_at"), as_of)
    newer = F.to_date("published_at") > F.to_date("origin_at")
    return references.withColumn("disposition", F.when(F.col("origin_at").isNull(), "unknown").when(~newer, "refused").when(age > ceiling, "demoted").otherwise("emitted"))


def registration_diff(held: DataFrame, registered: DataFrame, key: str, url: str, date: str) -> DataFrame:
    """(key, outcome) of a full outer join: absent, unregistered, substituted (url), moved (date) or same."""
    a, b = held.select(key, F.col(url).alias("a_url"), F.col(date).alias("a_date"), F.lit(True).alias("a")), registered.select(key, F.col(url).alias("b_url"), F.col(date).alias("b_date"), F.lit(True).alias("b"))
    outcome = (
        F.when(F.col("a").isNull(), "absent").when(F.col("b").isNull(), "unregistered").when(~F.col("a_url").eqNullSafe(F.col("b_url")), "substituted").when(~F.col("a_date").eqNullSafe(F.col("b_date")), "moved").otherwise("same")
    )
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))


def field_trace(published: DataFrame, ledger: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, compared, equal, both_absent, differing) over fields of rows with the same key."""
    long = lambda df, name: df.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(key, fields, "field", name)
    both = long(published, "mine").join(long(ledger, "theirs"), [key, "field"])
    same = F.col("mine").eqNullSafe(F.col("theirs"))
    absent = F.col("mine").isNull() & F.col("theirs").isNull()
    return both.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(same & ~absent).alias("equal"), F.count_if(absent).alias("both_absent"), F.count_if(~same).alias("differing"))


def unmatched(left: DataFrame, right: DataFrame, on: str, rule: str) -> DataFrame:
    """(rule, key) of keys of left that right lacks."""
    return left.join(right, on, "left_anti").select(F.lit(rule).alias("rule"), F.col(on).cast("string").alias("key")).distinct()


def reuse(mappings: DataFrame, source: str) -> DataFrame:
    """(uses, sources): how many sources are used how often."""
    return mappings.groupBy(source).agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("sources"))


def reviewed_override(candidates: DataFrame, approvals: DataFrame, entries: DataFrame) -> DataFrame:
    """(claim_id, approved, left_over) of each claim with candidates (claim_id, post_id) or an approval that holds.

    A reviewed pair (approvals: claim_id, activity_id, post_id) stands in place of a claim's ranked candidates, if entries
    (activity_id, post_id) hold that activity with that very post; of several the smallest post. Other claims have none
    approved. left_over counts the candidates less the approved one, 0 at least."""
    held = approvals.join(entries.select("activity_id", "post_id").distinct(), ["activity_id", "post_id"], "left_semi").groupBy("claim_id").agg(F.min("post_id").alias("approved"))
    counts = candidates.groupBy("claim_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)) - F.when(F.col("approved").isNotNull(), 1).otherwise(0)
    return counts.join(held, "claim_id", "full").select("claim_id", "approved", F.greatest(n, F.lit(0)).cast("long").alias("left_over"))


def ledger_problems(mappings: DataFrame, sources: DataFrame, claims: DataFrame, reserved: DataFrame, rejected: DataFrame, ceiling: int, types: list[str], qualities: list[str], transports: list[str]) -> DataFrame:
    """(rule, key): what is wrong with a reviewed ledger; a key is a claim or a source, a row for each rule that it breaks.

    mappings: claim_id, source, evidence_type, rationale, reviewed_at, reuse_family, verified_at; sources: source, url,
    publisher_host, quality, transport (null: https); claims and reserved (claims whose evidence has been reviewed
    elsewhere): claim_id; rejected: as in host_gate(). Of a mapping to an unknown source no more is said."""
    known = sources.select("source", F.lit(True).alias("_source")).distinct()
    rows = mappings.join(claims.select("claim_id", F.lit(True).alias("_claim")).distinct(), "claim_id", "left").join(reserved.select("claim_id", F.lit(True).alias("_reserved")).distinct(), "claim_id", "left").join(known, "source", "left")
    sound = F.col("_source").isNotNull()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    of_claims = audit.violations(rows, "claim_id", {
        "unknown claim": F.col("_claim").isNull(), "displaces a reviewed one": F.col("_reserved").isNotNull(), "unknown source": ~sound,
        "bad type": sound & ~F.coalesce(F.col("evidence_type").isin(types), F.lit(False)),
        "incomplete": sound & (blank("rationale") | blank("reviewed_at") | blank("reuse_family") | blank("verified_at")),
    })
    family = F.coalesce("reuse_family", F.lit(""))
    uses = mappings.groupBy("source").agg(F.count("*").alias("_n"), (F.min(family) != F.max(family)).alias("_mixed"))
    gate = host_gate(sources, rejected, "source").select("source", "ok", "host")
    held = sources.select("source", "publisher_host", "quality", "transport").join(uses, "source", "left").join(gate, "source")
    of_sources = audit.violations(held, "source", {
        "unused": F.col("_n").isNull(), "bad quality": ~F.coalesce(F.col("quality").isin(qualities), F.lit(False)), "bad transport": ~F.lower(F.coalesce("transport", F.lit("https"))).isin(transports),
        "gated host": ~F.col("ok"), "host differs": F.col("ok") & (registrable_host(F.col("host")) != registrable_host(F.lower(F.coalesce("publisher_host", F.lit(""))))),
        "over ceiling": F.col("_n") > ceiling, "mixed families": F.col("_mixed"),
    })
    return of_claims.union(of_sources)


def reuse_audit(mapping: DataFrame) -> DataFrame:
    """(source, claim, family, uses, n_families, all_reviewed, invalid) of a mapping (source, claim, family, reviewed): a row
    a use, beside the counts of its source; invalid: used more than once and by more than one family. Counts are summed
    before they are shuffled and joined back, so no source's uses are gathered."""
    counts = mapping.groupBy("source").agg(F.count("*").alias("uses"), F.count_distinct("family").alias("n_families"), F.bool_and("reviewed").alias("all_reviewed"))
    return mapping.drop("reviewed").join(counts, "source").select("source", "claim", "family", "uses", "n_families", "all_reviewed", ((F.col("uses") > 1) & (F.col("n_families") > 1)).alias("invalid"))
