"""Counts, rankings, set operations and views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.functions.dates import recency_rank
from claimspark.operators import audit as U
from claimspark.operators import views as V

from .dates import ORDERS_AS_OF, at
from .registry import query


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(floor(avg(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 100 END) + 0.5) AS BIGINT) AS stated, count(*) AS events, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high FROM orders GROUP BY 1")
def year_summary(t):
    return V.year_summary(t("orders"), F.year("o_orderdate"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 100), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


FACETS = """SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM {0} GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM {0} GROUP BY 2 UNION ALL
 SELECT 'tag', tag, count(*) FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderkey % 3 = 0 THEN 'third' END], lambda x: x IS NOT NULL)) AS tag FROM {0}) GROUP BY 2"""


@query(FACETS.format("orders") + " UNION ALL SELECT 'all', 'all', count(*) FROM orders")
def facet_counts(t):
    tags = F.array_compact(F.array(F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderkey") % 3 == 0, "third")))
    return V.facet_counts(t("orders"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, {"tag": tags})


@query("SELECT p.priority, s.status, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders) p CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderpriority = priority AND o_orderstatus = status GROUP BY 1, 2")
def tally_zero_filled(t):
    """A tally with a row for each value that could occur."""
    orders = t("orders")
    domain = orders.select(F.col("o_orderpriority").alias("priority")).distinct().withColumn("status", F.explode(F.array(*map(F.lit, "FOPX"))))
    counts = orders.groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return domain.join(counts, ["priority", "status"], "left").select("priority", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(*) AS entries, count(DISTINCT user_id) AS users, count(*) FILTER (ts >= TIMESTAMP '2024-01-17 00:00:00') AS eligible, count(*) FILTER (ts >= TIMESTAMP '2024-01-24 00:00:00') AS week, max(epoch_us(ts)) AS newest, min(epoch_us(ts)) AS oldest, count(*) FILTER (event_type = 'click') AS clicks FROM events")
def corpus_counts(t):
    since = lambda x: F.count_if(F.col("ts") >= at(x))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").agg(
        F.count("*").alias("entries"), F.count_distinct("user_id").alias("users"), since("2024-01-17 00:00:00").alias("eligible"), since("2024-01-24 00:00:00").alias("week"),
        F.max(micros).alias("newest"), F.min(micros).alias("oldest"), F.count_if(F.col("event_type") == "click").alias("clicks"),
    )


@query("SELECT o_orderpriority AS quality, count(*) AS n, floor(count(*) * 1000.0 / sum(count(*)) OVER () + 0.5) / 10 AS share, count(DISTINCT o_custkey) AS publishers, strftime(max(o_orderdate), '%Y-%m-%d') AS newest, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1")
def dashboard(t):
    return V.mix(t("orders"), F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderdate"))


@query("SELECT bool_and(o_totalprice > 0) AS valid, count(*) = count(DISTINCT o_orderkey) AS distinct_keys, bool_and(o_orderstatus IN ('F', 'O', 'P')) AS known, count(*) AS total FROM orders")
def gate_bool_and(t):
    return t("orders").agg(F.bool_and(F.col("o_totalprice") > 0).alias("valid"), (F.count("*") == F.count_distinct("o_orderkey")).alias("distinct_keys"), F.bool_and(F.col("o_orderstatus").isin("F", "O", "P")).alias("known"), F.count("*").alias("total"))


@query("""SELECT user_id, CAST(min_by(code, p) AS BIGINT) AS code, string_agg(DISTINCT CASE WHEN code = 70 THEN event_type END, ',' ORDER BY CASE WHEN code = 70 THEN event_type END) AS inert FROM
 (SELECT user_id, event_type, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 75 WHEN 'click' THEN 70 WHEN 'purchase' THEN 70 ELSE 0 END AS code, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 3 ELSE 4 END AS p FROM events) GROUP BY user_id""")
def run_verdict(t):
    """The exit code of each run, by the most serious of its findings, and what was inert."""
    kind = F.col("event_type")
    code = F.when(kind == "error", 1).when(kind == "signup", 75).when(kind.isin("click", "purchase"), 70).otherwise(0)
    serious = F.when(kind == "error", 1).when(kind == "signup", 2).when(kind.isin("click", "purchase"), 3).otherwise(4)
    inert = F.array_join(F.array_sort(F.collect_set(F.when(code == 70, kind))), ",")
    return t("events").groupBy("user_id").agg(F.min_by(code, serious).cast("long").alias("code"), F.nullif(inert, F.lit("")).alias("inert"))


@query("""SELECT user_id, CAST(a AS BIGINT) AS attention, CAST(b AS BIGINT) AS trade, CAST(floor(100.0 * (a + b) / 60 + 0.5) AS BIGINT) AS percent, CASE WHEN a + b >= 45 THEN 'late' WHEN a + b >= 30 THEN 'mid' WHEN a + b >= 15 THEN 'early' ELSE 'start' END AS phase,
 concat_ws(',', CASE WHEN a > b THEN 'mostly attention' END, CASE WHEN b = 0 THEN 'no trade' END) AS checklist FROM (SELECT user_id, least(30, count(*) FILTER (event_type IN ('view', 'click'))) AS a, least(30, 3 * count(*) FILTER (event_type = 'purchase')) AS b FROM events GROUP BY 1)""")
def rubric_score(t):
    """Points of answers by dimension, their percentage, phase and what the rules say."""
    kind = F.col("event_type")
    sums = t("events").groupBy("user_id").agg(F.least(F.lit(30), F.count_if(kind.isin("view", "click"))).alias("a"), F.least(F.lit(30), 3 * F.count_if(kind == "purchase")).alias("b"))
    total = F.col("a") + F.col("b")
    phase = F.when(total >= 45, "late").when(total >= 30, "mid").when(total >= 15, "early").otherwise("start")
    checks = F.concat_ws(",", F.when(F.col("a") > F.col("b"), "mostly attention"), F.when(F.col("b") == 0, "no trade"))
    return sums.select("user_id", F.col("a").cast("long").alias("attention"), F.col("b").cast("long").alias("trade"), F.floor(100.0 * total / 60 + 0.5).cast("long").alias("percent"), phase.alias("phase"), checks.alias("checklist"))


LOG = """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_id, event_type = 'purchase' AS ok, value < 20 AS challenged, CASE event_type WHEN 'click' THEN 429 WHEN 'view' THEN [404, 403, 410, 503, 200, 401, 500][event_id % 7 + 1] END AS status,
 CASE WHEN event_type = 'error' THEN ['ENOTFOUND', 'EAI_AGAIN', NULL, 'ETIMEDOUT'][event_id % 4 + 1] END AS code, CASE WHEN event_type IN ('error', 'click') THEN 'getaddrinfo ENOTFOUND host' END AS reason FROM events"""


@query(f"""WITH kinds AS (SELECT *, CASE WHEN ok THEN CASE WHEN challenged THEN 'challenge' ELSE 'read' END WHEN status = 404 OR status = 410 THEN 'gone' WHEN code = 'ENOTFOUND' OR (code IS NULL AND status IS NULL AND contains(reason, 'ENOTFOUND')) THEN 'dns' WHEN status > 0 THEN 'http' ELSE 'network' END AS kind FROM ({LOG})),
places AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY kind <> 'read', kind NOT IN ('gone', 'dns'), CASE WHEN kind IN ('read', 'gone', 'dns') THEN event_id ELSE -event_id END) AS place, count(*) OVER (PARTITION BY user_id, run) AS attempts FROM kinds)
SELECT user_id, run, kind AS outcome, CASE WHEN kind = 'read' THEN 'none' WHEN kind IN ('gone', 'dns') THEN 'evidence' ELSE 'infrastructure' END AS fault, event_id AS decided_at, attempts FROM places WHERE place = 1""")
def attempt_outcome(t):
    """A crawl log, made from events, a source being a user and a run a day."""
    kind, k = F.col("event_type"), F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    status = F.when(kind == "click", 429).when(kind == "view", pick([404, 403, 410, 503, 200, 401, 500], 7))
    code = F.when(kind == "error", pick(["ENOTFOUND", "EAI_AGAIN", None, "ETIMEDOUT"], 4))
    reason = F.when(kind.isin("error", "click"), "getaddrinfo ENOTFOUND host")
    log = t("events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("run"), "event_id", U.attempt_kind(kind == "purchase", F.col("value") < 20, status, code, reason).alias("kind"))
    return U.attempt_outcomes(log, ["user_id", "run"], F.col("event_id"), F.col("kind"))


@query("""WITH x AS (SELECT o_orderkey, (epoch_us(TIMESTAMP '2001-08-01 00:00:00') - epoch_us(o_orderdate) + (o_orderkey % 24) * 3600000000) / 86400000000.0 AS d FROM orders)
SELECT rule, count(*) FILTER (v <> floor(d + 0.5)) AS differs, count(*) FILTER (abs(d - floor(d) - 0.5) <= 0.25) AS near_edge, count(*) FILTER ((v <= 365) <> (floor(d + 0.5) <= 365)) AS ceiling_changes FROM
 (SELECT d, 'floor' AS rule, floor(d) AS v FROM x UNION ALL SELECT d, 'ceil', ceil(d) FROM x UNION ALL SELECT d, 'round', floor(d + 0.5) FROM x) GROUP BY rule""")
def rule_sensitivity(t):
    """How many rows each other rounding rule would change, beside the pinned one."""
    d = (F.unix_micros(at(ORDERS_AS_OF)) - F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * F.lit(3_600_000_000)) / 86_400_000_000.0
    rows = t("orders").select(d.alias("d"))
    pinned = F.floor(F.col("d") + 0.5)
    each = rows.select("d", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("v")) for k, v in (("floor", F.floor("d")), ("ceil", F.ceil("d")), ("round", pinned))))).alias("x"))
    v = F.col("x.v")
    return each.groupBy("x.rule").agg(F.count_if(v != pinned).alias("differs"), F.count_if(F.abs(F.col("d") - F.floor("d") - 0.5) <= 0.25).alias("near_edge"), F.count_if((v <= 365) != (pinned <= 365)).alias("ceiling_changes"))


@query("SELECT n_name, orders, CAST(ceiling - orders AS BIGINT) AS headroom, round(CAST(ceiling - orders AS DOUBLE) / ceiling, 4) AS fraction, orders > ceiling AS over, NOT orders > ceiling AND CAST(ceiling - orders AS DOUBLE) / ceiling < 0.02 AS tight FROM (SELECT n_name, count(o_orderkey) AS orders, (SELECT count(*) FROM orders) / 25 * 1.1 AS ceiling_ , CAST(ceil((SELECT count(*) FROM orders) * 11 / 250.0) AS BIGINT) AS ceiling FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name)")
def budget_margin(t):
    orders = t("orders")
    per = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("n_name").agg(F.count("o_orderkey").alias("orders"))
    ceiling = orders.agg(F.ceil(F.count("*") * 11 / 250.0).alias("ceiling"))  # one row
    return V.margins(per.crossJoin(F.broadcast(ceiling)), "orders", "ceiling").select("n_name", "orders", "headroom", "fraction", "over", "tight")


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS final, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS final_large, count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus = 'O') AS low_open FROM orders")
def conditional_counts(t):
    status = F.col("o_orderstatus")
    return t("orders").agg(F.count("*").alias("n"), F.count_if(status == "F").alias("final"), F.count_if((status == "F") & (F.col("o_totalprice") > 100000)).alias("final_large"), F.count_if((F.col("o_orderpriority") == "5-LOW") & (status == "O")).alias("low_open"))


# --- windows ----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, -(o_orderkey % 3), CASE WHEN o_orderkey % 6 = 0 THEN 9 ELSE -(o_orderkey % 5) END, -floor(o_totalprice / 50000),
 CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') <= 1 THEN 0 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') <= 7 THEN 1 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') <= 30 THEN 2 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') <= 180 THEN 3 ELSE 4 END, o_orderdate DESC, o_orderkey) AS place FROM orders""")
def rank_candidates(t):
    """Candidates of a customer in the order of candidates of a claim; the keys are made from orders."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    authorship = F.when(status == "F", 2).when(status == "O", 1).otherwise(0)
    concepts = F.when(k % 6 != 0, k % 5)
    recency = recency_rank(F.col("o_orderdate"), at("1998-08-01 00:00:00"))
    order = V.candidate_order(F.col("o_orderpriority") == "1-URGENT", authorship, k % 3, concepts, F.floor(F.col("o_totalprice") / 50000), recency, F.col("o_orderdate"), k)
    return V.ranked(t("orders"), "o_custkey", order).select("o_orderkey", "place")


@query("SELECT l_orderkey, l_linenumber, l_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) WHERE place <= 3")
def top3(t):
    ranked = V.ranked(t("lineitem"), "l_orderkey", [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return ranked.where("place <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""SELECT event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE WHEN kind = 'repost' AND event_id % 3 <> 0 THEN 0 ELSE 1 END, CASE kind WHEN 'post' THEN 0 WHEN 'repost' THEN 1 WHEN 'like' THEN 2 WHEN 'bookmark' THEN 3 ELSE 4 END, event_id) AS rn FROM
 (SELECT *, CASE event_type WHEN 'purchase' THEN 'post' WHEN 'signup' THEN 'repost' WHEN 'click' THEN 'like' WHEN 'view' THEN 'bookmark' END AS kind FROM events)) WHERE rn = 1""")
def dedupe_priority(t):
    """One entry of each user and day; two of three reposts name an activity of their own."""
    event, k = F.col("event_type"), F.col("event_id")
    kind = F.when(event == "purchase", "post").when(event == "signup", "repost").when(event == "click", "like").when(event == "view", "bookmark")
    entries = t("events").select("user_id", F.to_date("ts").alias("day"), "event_id", kind.alias("kind"))
    return V.one_of_each(entries, ["user_id", "day"], F.col("kind"), k, k - k % 3, k).select("event_id", "kind")


@query("SELECT CAST(y AS BIGINT) AS year, n, n < lag(n) OVER (ORDER BY y) AS narrower FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)")
def monotone_lag(t):
    years = t("orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))  # a row a year
    return years.withColumn("narrower", F.col("n") < F.lag("n").over(Window.orderBy("year")))


@query("SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, min(event_id) AS first_error FROM events WHERE event_type = 'error' GROUP BY 1) f ON e.user_id = f.user_id AND e.event_id > first_error WHERE event_type = 'purchase' AND value < 100 AND NOT coalesce(CAST(json_extract_string(props, '$.k') AS INT) < 20, false)")
def after_first_event(t):
    """Small purchases after a user's first error, unless their properties excuse them."""
    kind = F.col("event_type")
    excused = F.get_json_object("props", "$.k").try_cast("int") < 20
    return U.after_pivot(t("events"), ["user_id"], F.col("event_id"), kind == "error", (kind == "purchase") & (F.col("value") < 100), excused, strictly=True).select("event_id", "user_id")


@query("""WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS exact FROM customer GROUP BY 1, 2),
r AS (SELECT *, 100 - sum(floor(exact)) OVER (PARTITION BY c_nationkey) AS rest, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(exact - floor(exact), 9) DESC, c_mktsegment) AS rn FROM s)
SELECT CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, CAST(floor(exact) + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def largest_remainder(t):
    counts = t("customer").groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return V.apportion(counts, "nation", "segment", "n").select("nation", "segment", "share")


@query("SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS first_purchase, min(event_id) FILTER (value > 400) AS first_large, min_by(event_type, event_id) AS first_kind FROM events GROUP BY user_id")
def first_match(t):
    return t("events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("first_purchase"), F.min(F.when(F.col("value") > 400, F.col("event_id"))).alias("first_large"), F.min_by("event_type", "event_id").alias("first_kind"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderpriority, o_orderkey) AS place FROM orders""")
def nulls_last_sort(t):
    when = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate"))
    return V.ranked(t("orders"), "o_custkey", [(F.col("o_orderstatus") == "F").desc(), when.desc_nulls_last(), F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_orderkey", "place")


# --- sets -------------------------------------------------------------------------------------------------------------


@query("SELECT kind, count(*) AS n, CAST(sum(length(label)) AS BIGINT) AS chars FROM (SELECT 'supplier' AS kind, s_name AS label FROM supplier UNION ALL SELECT 'customer', c_name FROM customer UNION ALL SELECT 'part', p_name FROM part) GROUP BY kind")
def union_kinds(t):
    kind = lambda name, df, c: df.select(F.lit(name).alias("kind"), F.col(c).alias("label"))
    every = kind("supplier", t("supplier"), "s_name").unionByName(kind("customer", t("customer"), "c_name")).unionByName(kind("part", t("part"), "p_name"))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("label")).alias("chars"))


@query("SELECT 'gained' AS change, o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 2000 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999) UNION ALL SELECT 'lost', o_custkey FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)")
def run_diff(t):
    run = lambda y: t("orders").where(F.year("o_orderdate") == y).select("o_custkey")
    return V.run_diff(run(1999), run(2000), "o_custkey")


@query("SELECT 'idle' AS side, n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) UNION ALL SELECT DISTINCT 'undeclared', s_nationkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20)")
def roster_diff(t):
    declared, used = t("nation").select(F.col("n_nationkey").alias("k")), t("supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k"))
    idle, other = declared.subtract(used), used.subtract(declared.where("k < 20"))
    return idle.select(F.lit("idle").alias("side"), "k").union(other.select(F.lit("undeclared").alias("side"), "k"))


# --- views ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderpriority LIKE '%high%' OR o_orderstatus = 'F' AND o_totalprice >= 100000 AND lower(o_orderpriority) LIKE '%high%'")
def faceted_filter(t):
    text = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    return V.faceted(t("orders"), {"o_orderstatus": "F", "o_orderpriority": "no such value"}, "HIGH f", text).where("o_totalprice >= 100000").select("o_orderkey")


@query("SELECT CAST(y.year AS BIGINT) AS year, count(o_orderkey) AS shown, count(*) FILTER (o_orderpriority = '1-URGENT') AS high, count(o_orderkey) = 0 AS empty FROM (SELECT DISTINCT year(o_orderdate) AS year FROM orders) y LEFT JOIN orders ON year(o_orderdate) = y.year AND o_totalprice > 390000 GROUP BY 1")
def filtered_summary(t):
    orders = t("orders").withColumn("year", F.year("o_orderdate").cast("long"))
    shown = orders.where("o_totalprice > 390000").groupBy("year").agg(F.count("*").alias("shown"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("high"))
    return orders.select("year").distinct().join(shown, "year", "left").select("year", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("high", F.lit(0)).alias("high"), F.col("shown").isNull().alias("empty"))


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) AND props IS NOT NULL")
def latest_revision(t):
    events = t("events").withColumn("day", F.to_date("ts"))
    last = events.agg(F.max("day").alias("day"))  # one row
    return events.join(F.broadcast(last), "day").where("props is not null").select("event_id", "event_type")


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def grouped_list(t):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return joined.groupBy("r_name").agg(F.array_join(F.transform(names, lambda x: x["n_name"]), ",").alias("nations"), F.count("*").alias("n"))


@query("SELECT n_nationkey, coalesce(r_name, 'ELSEWHERE') AS grp FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def group_lookup(t):
    regions = t("region").where("r_regionkey < 3")
    return t("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("ELSEWHERE")).alias("grp"))


@query("SELECT 'batch' AS mode, (SELECT count(*) FROM events WHERE event_type <> 'error') AS active_rows, string_agg(event_type, ',' ORDER BY event_type) AS retired FROM (SELECT event_type FROM events GROUP BY event_type HAVING avg(value) < 51)")
def run_status(t):
    events = t("events")
    retired = events.groupBy("event_type").agg(F.avg("value").alias("m")).where("m < 51").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("retired"))
    return events.where("event_type <> 'error'").agg(F.count("*").alias("active_rows")).crossJoin(retired).select(F.lit("batch").alias("mode"), "active_rows", F.nullif("retired", F.lit("")).alias("retired"))


@query("SELECT CASE WHEN value >= 10 THEN 'observed' ELSE 'blank' END AS card, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-24 00:00:00') AS fresh FROM events GROUP BY 1")
def observed_blank(t):
    card = F.when(F.col("value") >= 10, "observed").otherwise("blank")
    return t("events").groupBy(card.alias("card")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= at("2024-01-24 00:00:00")).alias("fresh"))
