"""Queries that return violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.operators import audit as A

from .registry import query

SCHEMA = {
    "year": "year(o_orderdate) NOT BETWEEN 1995 AND 2000",
    "price": "o_totalprice <= 2000",
    "status": "o_orderstatus NOT IN ('F', 'O')",
    "priority": "o_orderpriority NOT LIKE '_-%'",
    "late": "o_orderstatus = 'F' AND year(o_orderdate) = 2001",
}


def _sql(rules: dict[str, str], key: str, table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, CAST({key} AS VARCHAR) AS key FROM {table} WHERE {c}" for name, c in rules.items())


@query(_sql(SCHEMA, "o_orderkey", "orders"))
def schema_rules(t):
    return A.violations(t("orders"), "o_orderkey", {k: F.expr(c) for k, c in SCHEMA.items()})


LISTS = "(SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, bool_or(l_quantity > 49) AS heavy FROM lineitem GROUP BY l_orderkey)"


@query(_sql({"too short": "n < 2", "too long": "n > 6", "repeated": "parts < n", "heavy": "heavy AND n < 3"}, "l_orderkey", LISTS))
def list_rules(t):
    lists = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.max("l_quantity").alias("q"))
    n = F.col("n")
    return A.violations(lists, "l_orderkey", {"too short": n < 2, "too long": n > 6, "repeated": F.col("parts") < n, "heavy": (F.col("q") > 49) & (n < 3)})


ANCHORS = [("AFRICA", 0), ("AMERICA", 1), ("ASIA", 3), ("EUROPE", 3), ("OCEANIA", 5)]


@query(f"SELECT coalesce(name, r_name) AS name, CASE WHEN r_name IS NULL THEN 'missing' WHEN name IS NULL THEN 'unlisted' WHEN fixed <> r_regionkey THEN 'moved' ELSE 'held' END AS state FROM region FULL OUTER JOIN (VALUES {', '.join(map(str, ANCHORS))}) a(name, fixed) ON name = r_name")
def required_keys(t):
    """Anchors that must be there, each once and in its place."""
    region = t("region")
    anchors = region.sparkSession.createDataFrame(ANCHORS, "name string, fixed int")
    state = F.when(F.col("r_name").isNull(), "missing").when(F.col("name").isNull(), "unlisted").when(F.col("fixed") != F.col("r_regionkey"), "moved").otherwise("held")
    return region.join(anchors, F.col("name") == F.col("r_name"), "full_outer").select(F.coalesce("name", "r_name").alias("name"), state.alias("state"))


@query("SELECT DISTINCT 'retired' AS rule, event_type AS key FROM events WHERE event_type IN ('error', 'signup', 'gone')")
def deny_list(t):
    return A.denied(t("events"), "event_type", ["error", "signup", "gone"])


@query("SELECT 'missing refunds' AS rule, 'artefact' AS key WHERE (SELECT max(value) FILTER (event_type = 'refund') FROM events) IS NULL UNION ALL SELECT 'missing clicks', 'artefact' WHERE (SELECT max(value) FILTER (event_type = 'click') FROM events) IS NULL")
def required_operand(t):
    kind = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    return A.required_operands(t("events").agg(kind("refund").alias("refunds"), kind("click").alias("clicks")), ["refunds", "clicks"])


IGNORE = ["*ring*", "old *", "!old bolt", "large widget", "!*gizmo"]


@query("SELECT p_partkey, coalesce(h[-1].o, false) AS excluded, h[-1].r AS rule FROM (SELECT p_partkey, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(p_name, '{A.glob_regex(r.removeprefix('!'))}') THEN {{'o': {'false' if r[0] == '!' else 'true'}, 'r': '{r}'}} END" for r in IGNORE) + "], lambda x: x IS NOT NULL) AS h FROM part)")
def last_match_rule(t):
    return A.last_match(t("part").select("p_partkey", "p_name"), "p_name", IGNORE).select("p_partkey", "excluded", "rule")
