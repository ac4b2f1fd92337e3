"""Articles that feeds lead to: the first of a feed's first links that was captured and tells enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import urls as U
from claimspark.operators.articles import host_gate

#: Links of a feed that are tried, and the characters that an article's path exceeds.
TRIED, SHORT_PATH = 4, 12
_TAG, _TEXT, _HREF = r'(?i)<link[^>]*>[^<]+</link>|<link[^>]+href="[^"]+"', r"(?i)<link[^>]*>([^<]+)</link>", r'(?i)<link[^>]+href="([^"]+)"'
_WHITE = " \t\r\n"
#: A sentence that may be quoted.
_SENTENCE = r"[^.!?]{60,220}[.!?]"


def feed_links(feeds: DataFrame, rejected: DataFrame, most: int = TRIED, short: int = SHORT_PATH) -> DataFrame:
    """(feed_id, place, link) of feeds (feed_id, text): the first `most` links, in a link element or its href, that are http
    urls, no feeds themselves, of hosts that host_gate() lets pass, with a path longer than `short`. rejected: (host, why).

    A null text has no links; feeds that repeat are one. The list of a feed comes from its own text, so its links meet
    again in one row."""
    tags = F.regexp_extract_all("text", F.lit(_TAG), F.lit(0))
    link = lambda t: F.btrim(F.coalesce(F.nullif(F.regexp_extract(t, _TEXT, 1), F.lit("")), F.regexp_extract(t, _HREF, 1)), F.lit(_WHITE))
    able = lambda u: u.rlike(r"^https?://") & ~u.rlike(r"(?i)\.(rss|xml)(\?|$)") & (F.length(F.regexp_extract(u, r"^[^:]*://[^/?#]*([^?#]*)", 1)) > short)
    rows = feeds.select("feed_id", F.posexplode(F.filter(F.transform(tags, link), able)).alias("i", "link")).distinct()
    passed = host_gate(rows.select(F.col("link").alias("page_id"), F.col("link").alias("url")).distinct(), rejected).where("ok").select(F.col("page_id").alias("link"))
    kept = rows.join(passed, "link").groupBy("feed_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("i", "link"))), 1, most).alias("l"))
    return kept.select("feed_id", F.posexplode("l").alias("p", "x")).select("feed_id", (F.col("p") + 1).cast("long").alias("place"), "x.link")


def sentence(text: Column) -> Column:
    """The first sentence of 60 to 220 characters, trimmed, that still has 60; null without one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0)), lambda s: F.btrim(s, F.lit(_WHITE)))
    return F.try_element_at(F.filter(found, lambda s: F.length(s) >= 60), F.lit(1))


def first_articles(feeds: DataFrame, captured: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each distinct feed_id: place, link, headline, publisher, published and a sentence of the first of its
    feed_links() whose captured page (url, headline, publisher, published, text) has all four; nulls where none has. Urls
    meet in their normal form; of a page captured twice the first by its fields counts."""
    links = feed_links(feeds, rejected).withColumn("_u", U.normal_url(F.col("link")))
    quote = captured.select(U.normal_url(F.col("url")).alias("_u"), "headline", "publisher", "published", sentence(F.col("text")).alias("sentence"))
    told = quote.where("headline <> '' and publisher <> '' and published is not null and sentence is not null")
    fields = "place", "link", "headline", "publisher", "published", "sentence"
    first = links.join(told, "_u").groupBy("feed_id").agg(F.min(F.struct(*fields)).alias("x")).select("feed_id", "x.*")
    return feeds.select("feed_id").distinct().join(first, "feed_id", "left")
