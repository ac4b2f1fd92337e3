"""Queries over claims and the evidence mapped to them. Claims are customers, sources are urgent orders, references are
line items, as FIXTURES.md binds them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.functions import dates as D
from claimspark.operators import evidence as E

from .dates import BUCKET, ORDER_AGE, ORDERS_AS_OF, at
from .registry import query

CEILING = 14
MAPPED = "(SELECT o_custkey AS claim_id, max(o_orderdate) AS published_at FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"
CHANNELS = f"""(SELECT c_custkey AS claim_id, c_mktsegment AS domain, published_at, date_diff('day', CAST(published_at AS DATE), DATE '2001-08-01') AS age,
 CASE WHEN published_at IS NULL THEN 'uncited' WHEN date_diff('day', CAST(published_at AS DATE), DATE '2001-08-01') <= {CEILING} THEN 'cited' ELSE 'context' END AS channel
 FROM customer LEFT JOIN {MAPPED} m ON c_custkey = claim_id)"""


def claims(t):
    return t("customer").select(F.col("c_custkey").alias("claim_id"), F.col("c_mktsegment").alias("domain"))


def mappings(t):
    return t("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("claim_id")).agg(F.max("o_orderdate").alias("published_at"))


def channels(t):
    return E.channels(claims(t), mappings(t), at(ORDERS_AS_OF), CEILING)


@query(f"SELECT claim_id, domain, CAST(age AS BIGINT) AS age, channel FROM {CHANNELS}")
def evidence_channel(t):
    return channels(t).select("claim_id", "domain", "age", "channel")


@query(
    f"SELECT count(*) AS total, count(*) FILTER (channel = 'cited') AS cited, count(*) FILTER (channel = 'context') AS context, count(*) FILTER (channel = 'uncited') AS uncited, "
    f"count(DISTINCT claim_id) AS distinct_claims, max(strftime(published_at, '%Y-%m-%d')) AS newest FROM {CHANNELS}"
)
def coverage_summary(t):
    return E.coverage(channels(t))


@query(
    f"SELECT claim_id, channel AS shown, CASE WHEN channel = 'cited' THEN (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = claim_id) ELSE 0 END AS attached FROM {CHANNELS}"
)
def evidence_view(t):
    """What a reader sees of a claim: its channel, with references attached only to cited ones."""
    attached = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("claim_id")).agg(F.count("*").alias("n"))
    joined = channels(t).join(attached, "claim_id", "left")
    return joined.select("claim_id", F.col("channel").alias("shown"), F.when(F.col("channel") == "cited", F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("attached"))


REFS = "(SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, o_orderdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
DISPOSED = (
    f"(SELECT *, CASE WHEN origin IS NULL THEN 'unknown' WHEN NOT CAST(l_shipdate AS DATE) > CAST(origin AS DATE) THEN 'refused' "
    f"WHEN date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-08-01') > 365 THEN 'demoted' ELSE 'emitted' END AS disposition FROM "
    f"(SELECT *, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderdate END AS origin FROM {REFS}))"
)


def references(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    origin = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderdate"))
    return E.dispositions(joined.withColumn("published_at", F.col("l_shipdate")).withColumn("origin_at", origin), at(ORDERS_AS_OF), 365)


@query(f"SELECT l_orderkey, l_linenumber, disposition FROM {DISPOSED}")
def newer_than_origin(t):
    return references(t).select("l_orderkey", "l_linenumber", "disposition")


@query(
    f"SELECT o_custkey, count(*) AS considered, count(*) FILTER (disposition = 'emitted') AS emitted, count(*) FILTER (disposition = 'demoted') AS demoted, count(*) FILTER (disposition = 'refused') AS refused, "
    f"count(*) FILTER (disposition = 'unknown') AS unknown, true AS adds_up FROM {DISPOSED} GROUP BY o_custkey"
)
def accounting(t):
    kinds = ("emitted", "demoted", "refused", "unknown")
    found = references(t).groupBy("o_custkey").agg(F.count("*").alias("considered"), *(F.count_if(F.col("disposition") == k).alias(k) for k in kinds))
    return found.withColumn("adds_up", F.col("considered") == sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))


@query(f"SELECT l_orderkey, count(*) AS n, bool_and(disposition <> 'emitted') AS emptied FROM {DISPOSED} GROUP BY l_orderkey")
def emptied_flag(t):
    """Claims all of whose references were demoted or refused."""
    return references(t).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_and(F.col("disposition") != "emitted").alias("emptied"))


@query(f"SELECT b.bucket, count(o_orderkey) AS n FROM (VALUES ('<=14d'), ('15-30d'), ('31-90d'), ('91-365d'), ('>1yr')) b(bucket) LEFT JOIN (SELECT o_orderkey, {BUCKET.format(ORDER_AGE)} AS bucket FROM orders) x ON b.bucket = x.bucket GROUP BY b.bucket")
def freshness_histogram(t):
    orders = t("orders")
    every = orders.sparkSession.createDataFrame([("<=14d",), ("15-30d",), ("31-90d",), ("91-365d",), (">1yr",)], "bucket string")
    counts = orders.groupBy(D.age_bucket(D.age_days(F.col("o_orderdate"), at(ORDERS_AS_OF))).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT uses, count(*) AS sources FROM (SELECT l_suppkey, count(*) AS uses FROM lineitem GROUP BY 1) GROUP BY uses")
def reuse_distribution(t):
    return E.reuse(t("lineitem"), "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS uses, CASE WHEN count(*) OVER (PARTITION BY l_partkey) > 1 THEN 'reuse' ELSE 'unique' END AS mode FROM lineitem")
def reuse_flag(t):
    lines = t("lineitem")
    # a count joined back splits a source that many share; a window would hold it in one task
    uses = lines.groupBy("l_partkey").agg(F.count("*").alias("uses"))
    return lines.join(uses, "l_partkey").select("l_orderkey", "l_linenumber", "uses", F.when(F.col("uses") > 1, "reuse").otherwise("unique").alias("mode"))


@query("""SELECT source, claim, family, uses, n_families, all_reviewed, uses > 1 AND n_families > 1 AS invalid FROM (SELECT o_custkey AS source, o_orderkey AS claim, o_orderpriority AS family FROM orders)
 JOIN (SELECT o_custkey AS source, count(*) AS uses, count(DISTINCT o_orderpriority) AS n_families, bool_and(o_orderstatus = 'F') AS all_reviewed FROM orders GROUP BY 1) USING (source)""")
def reuse_audit(t):
    """Every use of a source beside what is known of all of them; a reused one must stay within a family."""
    return E.reuse_audit(t("orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("claim"), F.col("o_orderpriority").alias("family"), (F.col("o_orderstatus") == "F").alias("reviewed")))


@query("SELECT l_suppkey, count(*) AS uses FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey HAVING count(*) > 10")
def reuse_ceiling(t):
    return t("lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("uses")).where("uses > 10")


@query(
    f"SELECT o_orderkey, d AS age, CAST(365 - d AS BIGINT) AS days_left FROM (SELECT o_orderkey, {ORDER_AGE} AS d FROM orders) WHERE d >= 45 AND d <= 365"
)
def refresh_due(t):
    age = D.age_days(F.col("o_orderdate"), at(ORDERS_AS_OF))
    return t("orders").select("o_orderkey", age.alias("age")).where("age between 45 and 365").withColumn("days_left", 365 - F.col("age"))


@query("""WITH copy AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '-x' ELSE s_name END AS s_name,
 CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier)
SELECT CAST(coalesce(a.s_suppkey, b.s_suppkey) AS BIGINT) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'absent' WHEN b.s_suppkey IS NULL THEN 'unregistered' WHEN a.s_name IS DISTINCT FROM b.s_name THEN 'substituted'
 WHEN a.s_nationkey IS DISTINCT FROM b.s_nationkey THEN 'moved' ELSE 'same' END AS outcome FROM supplier a FULL OUTER JOIN copy b ON a.s_suppkey = b.s_suppkey""")
def registration_diff(t):
    return E.registration_diff(t("supplier"), changed_suppliers(t), "s_suppkey", "s_name", "s_nationkey")


def changed_suppliers(t):
    key = F.col("s_suppkey")
    return t("supplier").select(
        F.when(key % 11 == 0, key + 1000000).otherwise(key).alias("s_suppkey"), F.when(key % 5 == 0, F.concat("s_name", F.lit("-x"))).otherwise(F.col("s_name")).alias("s_name"),
        F.when(key % 3 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("s_nationkey"), F.when(key % 4 == 0, None).otherwise(F.col("s_acctbal")).alias("s_acctbal"),
    )


@query("""WITH x AS (SELECT s.s_suppkey, unnest(['s_name', 's_nationkey', 's_acctbal']) AS field, unnest([s_name, CAST(s_nationkey AS VARCHAR), CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE 'v' END]) AS mine FROM supplier s),
y AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, unnest(['s_name', 's_nationkey', 's_acctbal']) AS field,
 unnest([CASE WHEN s_suppkey % 5 = 0 THEN s_name || '-x' ELSE s_name END, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS VARCHAR), CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'v' END]) AS theirs FROM supplier)
SELECT field, count(*) AS compared, count(*) FILTER (mine = theirs) AS equal, count(*) FILTER (mine IS NULL AND theirs IS NULL) AS both_absent, count(*) FILTER (mine IS DISTINCT FROM theirs) AS differing FROM x JOIN y USING (s_suppkey, field) GROUP BY field""")
def field_trace(t):
    key = F.col("s_suppkey")
    flag = lambda n: F.when(key % n != 0, F.lit("v"))
    ledger = t("supplier").withColumn("s_acctbal", flag(4))
    moved = changed_suppliers(t).drop("s_acctbal").join(ledger.select(F.when(key % 11 == 0, key + 1000000).otherwise(key).alias("s_suppkey"), "s_acctbal"), "s_suppkey")
    return E.field_trace(t("supplier").withColumn("s_acctbal", flag(8)), moved, "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"])


@query(
    "SELECT 'claim without order' AS rule, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL "
    "SELECT DISTINCT 'order without claim', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)"
)
def coverage_anti(t):
    ids, used = t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("id"))
    return E.unmatched(ids, used, "id", "claim without order").unionByName(E.unmatched(used, ids.where("id % 9 <> 0"), "id", "order without claim"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def eligible_semi(t):
    high = t("orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(high, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT DISTINCT a.user_id, CAST(a.first_at AS BIGINT) AS before_at, CAST(b.first_at AS BIGINT) AS after_at FROM
 (SELECT user_id, min(epoch_us(ts)) AS first_at FROM events WHERE event_type = 'signup' GROUP BY 1) a LEFT JOIN (SELECT user_id, min(epoch_us(ts)) AS first_at FROM events WHERE event_type = 'purchase' GROUP BY 1) b
 ON a.user_id = b.user_id WHERE b.first_at IS NULL OR b.first_at < a.first_at""")
def edge_order(t):
    """Dependencies violated: a purchase before the signup it needs, or none at all."""
    first = t("events").groupBy("user_id").pivot("event_type", ["signup", "purchase"]).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))))
    return first.where("signup is not null and (purchase is null or purchase < signup)").select("user_id", F.col("signup").alias("before_at"), F.col("purchase").alias("after_at"))


@query(f"""WITH x AS (SELECT claim_id, channel FROM {CHANNELS} UNION ALL SELECT claim_id, 'context' FROM {CHANNELS} WHERE claim_id % 50 = 0 AND channel = 'cited')
SELECT c_custkey, count(DISTINCT channel) AS channels FROM customer LEFT JOIN x ON c_custkey = claim_id AND c_custkey % 40 <> 1 GROUP BY c_custkey HAVING count(DISTINCT channel) <> 1""")
def partition_check(t):
    """Claims in two channels or in none."""
    found = channels(t).select("claim_id", "channel")
    twice = found.where("claim_id % 50 = 0 and channel = 'cited'").withColumn("channel", F.lit("context"))
    held = found.unionByName(twice).where("claim_id % 40 <> 1").groupBy("claim_id").agg(F.count_distinct("channel").alias("n"))
    joined = t("customer").join(held, F.col("c_custkey") == F.col("claim_id"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("channels")).where("channels <> 1")


@query("""WITH a AS (SELECT o_custkey, min(CASE WHEN l_suppkey % 4 <> 0 THEN l_orderkey END) AS approved FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_quantity > 40 GROUP BY 1)
SELECT o.o_custkey AS claim_id, any_value(approved) AS approved, count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey IS DISTINCT FROM approved) + CASE WHEN any_value(approved) IS NOT NULL AND NOT bool_or(o_orderkey = approved AND o_orderstatus <> 'P') AND count(*) FILTER (o_orderstatus <> 'P') > 0 THEN -1 ELSE 0 END AS left_over
FROM orders o LEFT JOIN a ON o.o_custkey = a.o_custkey GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'P') > 0 OR any_value(approved) IS NOT NULL""")
def reviewed_override(t):
    """Customers as claims, their orders as candidates unless pending, large first lines as reviewed pairs; a fourth of
    these names a post that the activity isn't."""
    orders = t("orders")
    large = t("lineitem").where("l_linenumber = 1 and l_quantity > 40").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    approvals = large.select(F.col("o_custkey").alias("claim_id"), F.col("l_orderkey").alias("activity_id"), (F.col("l_orderkey") + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)).alias("post_id"))
    entries = orders.select(F.col("o_orderkey").alias("activity_id"), F.col("o_orderkey").alias("post_id"))
    return E.reviewed_override(orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("post_id")), approvals, entries)


@query("""SELECT o_orderkey, reason FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice < 5000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'pending urgent' END,
 CASE WHEN CAST(o_orderdate AS DATE) > DATE '2001-07-01' THEN 'ahead' END], lambda x: x IS NOT NULL)) AS reason FROM orders)""")
def provenance_rules(t):
    rules = F.array(
        F.when(F.col("o_totalprice") < 5000, "price"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "pending urgent"),
        F.when(F.to_date("o_orderdate") > F.lit("2001-07-01").cast("date"), "ahead"),
    )
    return t("orders").select("o_orderkey", F.explode(F.array_compact(rules)).alias("reason"))


@query(f"SELECT claim_id, CASE WHEN channel = 'cited' THEN 'cited beyond window' ELSE 'context within window' END AS rule FROM {CHANNELS} WHERE channel = 'cited' AND age > 7 OR channel = 'context' AND age <= 60")
def window_rules(t):
    """Each cited row against a tighter window, each context row against a wider one."""
    broken = channels(t).where("channel = 'cited' and age > 7 or channel = 'context' and age <= 60")
    return broken.select("claim_id", F.when(F.col("channel") == "cited", "cited beyond window").otherwise("context within window").alias("rule"))


SEGMENTS = "('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')"


@query(f"""WITH m AS (SELECT *, CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_custkey END AS source, CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus ELSE 'x' END AS family FROM orders),
u AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n, count(DISTINCT family) AS families FROM customer LEFT JOIN m ON source = c_custkey GROUP BY ALL)
SELECT rule, n FROM (SELECT 'unknown claim' AS rule, count(*) AS n FROM m WHERE o_orderkey % 50 = 1 UNION ALL SELECT 'displaces a reviewed one', count(*) FROM m WHERE o_totalprice > 300000 UNION ALL SELECT 'unknown source', count(*) FROM m WHERE source NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'bad type', count(*) FROM m WHERE source <> -1 AND o_orderpriority = '5-LOW' UNION ALL SELECT 'incomplete', count(*) FROM m WHERE source <> -1 AND o_orderkey % 30 = 0 UNION ALL SELECT 'unused', count(*) FROM u WHERE n = 0
 UNION ALL SELECT 'bad quality', count(*) FROM u WHERE c_mktsegment NOT IN {SEGMENTS} UNION ALL SELECT 'bad transport', count(*) FROM u WHERE c_custkey % 7 = 0 UNION ALL SELECT 'gated host', count(*) FROM u WHERE c_custkey % 10 < 2 UNION ALL SELECT 'host differs', count(*) FROM u WHERE c_custkey % 10 = 2
 UNION ALL SELECT 'over ceiling', count(*) FROM u WHERE n > 12 UNION ALL SELECT 'mixed families', count(*) FROM u WHERE families > 1) WHERE n > 0""")
def ledger_audit(t):
    """Orders as mappings of claims to sources, customers as sources: how many keys break each rule of a reviewed ledger."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    mappings = t("orders").select(
        k.alias("claim_id"), F.when(k % 40 == 0, -1).otherwise(F.col("o_custkey")).alias("source"), F.col("o_orderpriority").alias("evidence_type"), F.when(k % 30 != 0, "because").alias("rationale"),
        F.col("o_orderdate").alias("reviewed_at"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderstatus")).otherwise("x").alias("reuse_family"), F.col("o_orderdate").alias("verified_at"),
    )
    url = F.when(c % 10 == 0, "https://shop.cheap-pills.example.com/a").when(c % 10 == 1, "https://news.example.com/amp/a").when(c % 10 == 2, "https://www.other.org/a").otherwise("https://news.example.com/a")
    sources = t("customer").select(c.alias("source"), url.alias("url"), F.lit("Example.com").alias("publisher_host"), F.col("c_mktsegment").alias("quality"), F.when(c % 7 == 0, "pigeon").when(c % 7 != 1, "HTTPS").alias("transport"))
    claims, reserved = t("orders").where(k % 50 != 1).select(k.alias("claim_id")), t("orders").where("o_totalprice > 300000").select(k.alias("claim_id"))
    rejected = F.broadcast(mappings.sparkSession.createDataFrame([("cheap-pills.example.com", "shop")], "host string, why string"))
    found = E.ledger_problems(mappings, sources, claims, reserved, rejected, 12, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"], ["https", "browser"])
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(f"SELECT (SELECT count(*) FROM {CHANNELS} WHERE channel = 'cited') AS published, count(*) AS recounted, (SELECT count(*) FROM {CHANNELS} WHERE channel = 'cited') = count(*) AS agree FROM {MAPPED} WHERE date_diff('day', CAST(published_at AS DATE), DATE '2001-08-01') <= {CEILING}")
def recount(t):
    """A published count beside the same count made from the mappings."""
    a = E.coverage(channels(t)).select(F.col("cited").alias("published"))
    b = mappings(t).where(D.age_days(F.col("published_at"), at(ORDERS_AS_OF)) <= CEILING).agg(F.count("*").alias("recounted"))
    return a.crossJoin(b).withColumn("agree", F.col("published") == F.col("recounted"))  # one row each


@query(f"SELECT rule, n FROM (SELECT 'uncited' AS rule, count(*) FILTER (channel = 'uncited') AS n FROM {CHANNELS} UNION ALL SELECT 'stale', count(*) FILTER (age > 365) FROM {CHANNELS} UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT claim_id) FROM {CHANNELS})")
def publish_gate(t):
    """How many rows break each rule that must be empty before a table may be published (see sources.publish)."""
    found = channels(t).agg(F.count_if(F.col("channel") == "uncited").alias("uncited"), F.count_if(F.col("age") > 365).alias("stale"), (F.count("*") - F.count_distinct("claim_id")).alias("duplicate"))
    return found.unpivot([], ["uncited", "stale", "duplicate"], "rule", "n")


@query("""SELECT claim, count(*) AS problems FROM (SELECT page_id AS claim, unnest(list_filter([CASE WHEN page_id % 4 = 0 THEN 'url' END, CASE WHEN page_id % 6 = 0 THEN 'text' END], lambda x: x IS NOT NULL)) AS p FROM pages) GROUP BY claim""")
def drift_check(t):
    """Reviewed fields beside extracted ones by key: here a page beside a copy with changed urls and texts."""
    pages = t("pages").select("page_id", "url", F.sha2("html", 256).alias("hash"))
    copy = t("pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url")).alias("url2"), F.sha2(F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("hash2"))
    problems = F.array_compact(F.array(F.when(F.col("url") != F.col("url2"), "url"), F.when(F.col("hash") != F.col("hash2"), "text")))
    return pages.join(copy, "page_id").select("page_id", F.explode(problems).alias("p")).groupBy(F.col("page_id").alias("claim")).agg(F.count("*").alias("problems"))
