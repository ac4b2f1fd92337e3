"""Queries over dates and rounding rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import dates as D

from .registry import query

EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-01 00:00:00"
ORDER_AGE = "date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')"
EVENT_DAYS = "((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400000000.0)"
BUCKET = "CASE WHEN {0} <= 14 THEN '<=14d' WHEN {0} <= 30 THEN '15-30d' WHEN {0} <= 90 THEN '31-90d' WHEN {0} <= 365 THEN '91-365d' ELSE '>1yr' END"


def at(text: str):
    return F.lit(text).cast("timestamp")


@query(f"SELECT event_id, CAST(floor({EVENT_DAYS} + 0.5) AS BIGINT) AS age_round, CAST(floor({EVENT_DAYS}) AS BIGINT) AS age_floor FROM events")
def age_days(t):
    as_of = at(EVENTS_AS_OF)
    return t("events").select("event_id", D.age_days(F.col("ts"), as_of).alias("age_round"), D.age_days_floor(F.col("ts"), as_of).alias("age_floor"))


@query(f"SELECT o_orderkey, {BUCKET.format(ORDER_AGE)} AS bucket FROM orders")
def age_bucket(t):
    return t("orders").select("o_orderkey", D.age_bucket(D.age_days(F.col("o_orderdate"), at(ORDERS_AS_OF))).alias("bucket"))


@query(
    f"SELECT event_id, CAST(r AS BIGINT) AS rank, CASE WHEN r >= 3 THEN 'week' WHEN r = 2 THEN 'recent' ELSE 'historical' END AS tier FROM (SELECT event_id, "
    f"CASE WHEN {EVENT_DAYS} <= 1 THEN 4 WHEN {EVENT_DAYS} <= 7 THEN 3 WHEN {EVENT_DAYS} <= 30 THEN 2 WHEN {EVENT_DAYS} <= 180 THEN 1 ELSE 0 END AS r FROM events)"
)
def recency_rank(t):
    as_of = at(EVENTS_AS_OF)
    return t("events").select("event_id", D.recency_rank(F.col("ts"), as_of).alias("rank"), D.recency_tier(F.col("ts"), as_of).alias("tier"))


@query(f"""SELECT o_orderkey, CASE WHEN d <= 0 THEN 'published today' WHEN d = 1 THEN 'published yesterday' WHEN d < 14 THEN 'published ' || d || ' days ago' WHEN d < 61 THEN 'published ' || ((2 * d + 7) // 14) || ' weeks ago'
 WHEN d < 365 THEN 'published ' || ((d + 15) // 30) || ' months ago' ELSE 'published ' || (t // 10) || CASE WHEN t % 10 = 0 THEN '' ELSE '.' || (t % 10) END || CASE WHEN t = 10 THEN ' year ago' ELSE ' years ago' END END AS phrase,
 CASE WHEN d <= 1 THEN 'today' WHEN d <= 7 THEN d || ' days ago' WHEN d <= 14 THEN 'this fortnight' WHEN d <= 31 THEN 'this month' WHEN d <= 92 THEN 'this quarter' ELSE ((d + 15) // 30) || ' months ago' END AS card,
 CASE WHEN d <= 92 THEN d || ' days old' WHEN d <= 365 THEN ((d + 15) // 30) || ' months old' ELSE (t // 10) || '.' || (t % 10) || ' years old' END AS context
 FROM (SELECT *, (20 * d + 365) // 730 AS t FROM (SELECT o_orderkey, {ORDER_AGE} AS d FROM orders))""")
def age_phrase(t):
    rows = t("orders").select("o_orderkey", D.age_days(F.col("o_orderdate"), at(ORDERS_AS_OF)).alias("d"))
    d = F.col("d")
    return rows.select("o_orderkey", D.age_phrase(d).alias("phrase"), D.age_on_card(d).alias("card"), D.age_in_context(d).alias("context"))


@query(
    "SELECT o_orderkey, b AS band, CASE WHEN b <= 2 THEN 'month' WHEN b <= 4 THEN 'quarter' WHEN b <= 7 THEN 'half' ELSE 'year' END AS precision "
    "FROM (SELECT o_orderkey, CAST(2 + greatest(0, year(o_orderdate) - 1995) AS BIGINT) AS b FROM orders)"
)
def year_band(t):
    band = D.year_band(F.year("o_orderdate"), 1995)
    return t("orders").select("o_orderkey", band.alias("band"), D.precision(band).alias("precision"))


@query("""
WITH x AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, 2 + greatest(0, year(o_orderdate) - 1995) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b <= 2 THEN monthname(make_date(y, m, 1)) || ' ' || y
  WHEN b <= 4 THEN 'Q' || CAST(ceil(m / 3.0) AS INT) || ' ' || y WHEN b <= 7 THEN 'H' || CASE WHEN m <= 6 THEN '1' ELSE '2' END || ' ' || y
  ELSE CASE WHEN m <= 4 THEN 'Early' WHEN m <= 8 THEN 'Mid' ELSE 'Late' END || ' ' || y END AS label,
  '±' || b || ' months' AS band,
  strftime(last_day(make_date(y, m, 1) + to_months(CAST(b AS INT))), '%Y-%m-%d') AS window_end,
  last_day(make_date(y, m, 1) + to_months(CAST(b AS INT))) < DATE '2001-08-01' AS elapsed FROM x
""")
def timing_label(t):
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    band = D.year_band(year, 1995)
    end = D.window_end(year, month, band)
    return t("orders").select("o_orderkey", D.timing_label(year, month, D.precision(band)).alias("label"), D.band_text(band).alias("band"), F.date_format(end, "yyyy-MM-dd").alias("window_end"), (end < F.lit("2001-08-01").cast("date")).alias("elapsed"))


@query(
    "SELECT o_orderkey, round(least(2000.0, greatest(1996.0, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CAST(dayofyear(make_date(year(o_orderdate), 12, 31)) AS DOUBLE))), 6) AS coordinate, "
    "CAST(dayofyear(o_orderdate) AS BIGINT) AS day FROM orders"
)
def year_fraction(t):
    year = F.year("o_orderdate")
    length = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    at_ = year + (F.dayofyear("o_orderdate") - 1) / length
    return t("orders").select("o_orderkey", F.round(F.least(F.lit(2000.0), F.greatest(F.lit(1996.0), at_)), 6).alias("coordinate"), F.dayofyear("o_orderdate").cast("long").alias("day"))


@query(
    "SELECT band, count(*) AS n FROM (SELECT CASE WHEN p IS NULL THEN 'unstated' WHEN p >= 80 THEN 'very likely' WHEN p >= 60 THEN 'likely' WHEN p >= 40 THEN 'even' ELSE 'low' END AS band "
    "FROM (SELECT CASE WHEN l_returnflag = 'A' THEN NULL ELSE round(l_discount * 1000) END AS p FROM lineitem)) GROUP BY band"
)
def prob_band(t):
    p = F.when(F.col("l_returnflag") != "A", F.round(F.col("l_discount") * 1000))
    return t("lineitem").groupBy(D.probability_band(p).alias("band")).agg(F.count("*").alias("n"))


@query(
    "SELECT event_type, count(*) AS n, count(*) FILTER ((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3.6e9 <= 36) AS fresh FROM events GROUP BY event_type"
)
def freshness_hours(t):
    fresh = D.hours_since(F.col("ts"), at(EVENTS_AS_OF)) <= 36
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(fresh).alias("fresh"))


CEILING = 60
_AGE = "CASE WHEN rule LIKE 'round%' THEN floor(d + 0.5) WHEN rule LIKE 'floor%' THEN floor(d) ELSE ceil(d) END"
_PAST = f"CASE WHEN rule LIKE '%>=' THEN {_AGE} >= {CEILING} ELSE {_AGE} > {CEILING} END"


@query(f"""WITH r(rule, days) AS (VALUES {', '.join(f"('{k}', {CEILING + v})" for k, v in D.EXPIRY_OFFSETS.items())}),
x AS (SELECT o_orderkey, rule, epoch_us(o_orderdate) + CAST(days * 86400000000 AS BIGINT) AS due, (epoch_us(TIMESTAMP '2001-08-01 00:00:00') - epoch_us(o_orderdate)) / 86400000000.0 AS d FROM orders CROSS JOIN r)
SELECT rule, count(*) FILTER (past) AS expired, min(due) FILTER (NOT past) AS next_due, min_by(o_orderkey, CAST(due AS HUGEINT) * 100000000 + o_orderkey) FILTER (NOT past) AS next_key FROM (SELECT *, {_PAST} AS past FROM x) GROUP BY rule""")
def expiry_rules(t):
    """What each way of rounding and comparing ages has let expire, and what it lets expire next."""
    now = at(ORDERS_AS_OF)
    each = (F.struct(F.lit(k).alias("rule"), D.expires_at(F.col("o_orderdate"), CEILING, k).alias("due"), D.expired(D.expires_at(F.col("o_orderdate"), CEILING, k), now, k).alias("past")) for k in D.EXPIRY_OFFSETS)
    rows = t("orders").select("o_orderkey", F.explode(F.array(*each)).alias("x")).select("o_orderkey", "x.*")
    ahead = ~F.col("past")
    return rows.groupBy("rule").agg(F.count_if("past").alias("expired"), F.min(F.when(ahead, F.col("due"))).alias("next_due"), F.min_by("o_orderkey", F.when(ahead, F.struct("due", "o_orderkey"))).alias("next_key"))


@query(
    "SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) > CASE WHEN epoch_us(o_orderdate) % 86400000000 = 0 THEN epoch_us(o_orderdate) + 86400000000 - 1000 ELSE epoch_us(o_orderdate) END AS beaten "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
def origin_bar(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", (F.unix_micros(F.col("l_shipdate").cast("timestamp")) > D.day_bar(F.col("o_orderdate"))).alias("beaten"))


@query(
    "SELECT drift, count(*) AS n FROM (SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'undecidable' WHEN a = b THEN 'same' ELSE 'moved' END AS drift FROM (SELECT CASE WHEN l_linenumber % 5 = 0 THEN NULL "
    "ELSE CAST(l_shipdate AS DATE) END AS a, CAST(o_orderdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) GROUP BY drift"
)
def utc_day_drift(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = F.to_date(F.try_to_timestamp(F.when(F.col("l_linenumber") % 5 == 0, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))))
    b = F.to_date("o_orderdate")
    drift = F.when(a.isNull() | b.isNull(), "undecidable").when(a == b, "same").otherwise("moved")
    return joined.groupBy(drift.alias("drift")).agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%d %b %Y') AS shown FROM events")
def display_date(t):
    return t("events").select("event_id", F.date_format("ts", "dd MMM yyyy").alias("shown"))


@query(
    "SELECT o_orderstatus, count(*) AS n, floor(count(*) * 1000 / CAST((SELECT count(*) FROM orders) AS DOUBLE) + 0.5) / 10 AS share FROM orders GROUP BY o_orderstatus"
)
def share_pct(t):
    orders = t("orders")
    total = orders.agg(F.count("*").alias("total"))  # one row
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("o_orderstatus", "n", D.share_percent(F.col("n"), F.col("total")).alias("share"))
