"""What a captured page says, and which hosts may be cited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions import html as H
from claimspark.functions import urls as U


def articles(pages: DataFrame) -> DataFrame:
    """One row a page of (page_id, url, html): headline, publisher, author, published, host, canonical url, text hash."""
    read = pages.withColumn("main", H.main_text(F.col("html"))).withColumn("ld", H.json_ld(F.col("html"))).withColumn("host", U.host(F.col("url")))
    author = F.coalesce(F.col("ld.author"), H.meta(F.col("html"), ["author", "article:author"]), F.lit(""))
    author = F.when(author.rlike("^https?://") | (F.length(author) > 120), "").otherwise(author)
    stated = F.to_date(F.try_to_timestamp(F.coalesce(F.col("ld.date"), H.published_raw(F.col("html")))))
    link = H.canonical(F.col("html"))
    own = U.registrable_host(U.host(link)) == U.registrable_host(F.col("host"))
    return read.select(
        "page_id", F.coalesce("ld.headline", H.headline(F.col("html")), F.lit("")).alias("headline"),
        F.coalesce("ld.publisher", H.meta(F.col("html"), ["og:site_name"]), U.registrable_host(F.col("host"))).alias("publisher"), author.alias("author"),
        F.date_format(F.coalesce(stated, H.rendered_date(F.col("main"))), "yyyy-MM-dd").alias("published"), "host",
        F.when(own, U.normal_url(link)).otherwise(U.normal_url(F.col("url"))).alias("canonical"), F.length("main").cast("long").alias("n_chars"), F.sha2("main", 256).alias("hash"),
    )


#: How a page may be read: plainly, or by a browser that runs its scripts.
TRANSPORTS = ["https", "browser"]


def scanned(pages: DataFrame, declared: DataFrame) -> DataFrame:
    """(page_id, host, transport, violation) of pages (page_id, url), by what is declared for their host: (host, transport),
    a row a host. transport is never guessed from a url or from a read that failed: violation is undeclared without a
    row, unknown transport for one that isn't in TRANSPORTS, unreadable url without a host, else null."""
    rows = pages.select("page_id", U.host(F.col("url")).alias("host")).join(declared.select("host", "transport"), "host", "left")
    broken = F.when(F.coalesce("host", F.lit("")) == "", "unreadable url").when(F.col("transport").isNull(), "undeclared").when(~F.col("transport").isin(TRANSPORTS), "unknown transport")
    return rows.select("page_id", "host", F.when(broken.isNull(), F.col("transport")).alias("transport"), broken.alias("violation"))


# fixed values: hosts, then urls, that are no publisher's original whatever their name
HOST_FORMS = [(r"(?i)(^|\.)(amp|amp-cdn)\.", "AMP mirror"), (r"(?i)(^|\.)(webcache|cache)\.", "cache mirror"), (r"(?i)(^|\.)translate\.", "translation proxy"), (r"(?i)(^|\.)(m|mobile)\.facebook\.com$", "social platform")]
URL_FORMS = [(r"(?i)/amp(/|$|\.html)", "AMP rendition"), (r"(?i)^https?://[^/]*/?$", "site root")]


def host_gate(urls: DataFrame, rejected: DataFrame, key: str = "page_id") -> DataFrame:
    """urls (key, url), one row a key, with host, ok and reason. rejected: (host, why), a small table; a url is out if it
    can't be read or isn't http, if its host or anything it is a subdomain of is listed (the longest tells why), or by the
    form of host or url, in this order."""
    gated = urls.select(key, "url", U.host(F.col("url")).alias("host"))
    listed = gated.select(key, F.explode(U.host_suffixes(F.col("host"))).alias("_h")).join(rejected.select(F.col("host").alias("_h"), "why"), "_h").groupBy(key).agg(F.max_by("why", F.length("_h")).alias("why"))
    scheme = F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    reason = F.when(F.coalesce(F.col("host"), F.lit("")) == "", "unparsable").when(~scheme.isin("http", "https"), "protocol").when(F.col("why").isNotNull(), F.col("why"))
    for form, why in HOST_FORMS:
        reason = reason.when(F.col("host").rlike(form), why)
    for form, why in URL_FORMS:
        reason = reason.when(F.col("url").rlike(form), why)
    return gated.join(listed, key, "left").select(key, "host", reason.isNull().alias("ok"), reason.alias("reason"))


def redirects(edges: DataFrame, starts: DataFrame, most: int = 6, rejected: DataFrame | None = None) -> DataFrame:
    """(start, final, hops, reason) following edges (src, dst): reason is loop, too many hops, rejected: and why, or null.
    edges has one row a src; each hop is a join, so nothing is iterated on the driver. rejected: (node, why), as of
    host_gate(); each node on the way is held against it, the start too, and a rejected one is never left."""
    if rejected is None:
        gated, now = edges.withColumn("why", F.lit(None).cast("string")), starts.withColumn("why", F.lit(None).cast("string"))
    else:
        gate = rejected.select("node", F.concat(F.lit("rejected: "), "why").alias("why"))
        gated, now = edges.join(gate, F.col("dst") == F.col("node"), "left"), starts.join(gate, F.col("start") == F.col("node"), "left")
    gated = gated.select("src", "dst", "why")
    now = now.select(F.col("start"), F.col("start").alias("at"), F.lit(0).alias("hops"), F.array("start").alias("seen"), F.col("why").alias("reason"))
    for _ in range(most):
        step = now.join(gated, F.when(F.col("reason").isNull(), F.col("at")) == F.col("src"), "left")
        loop = F.array_contains("seen", F.col("dst"))
        now = step.select(
            "start", F.when(F.col("dst").isNull() | loop, F.col("at")).otherwise(F.col("dst")).alias("at"), (F.col("hops") + F.when(F.col("dst").isNotNull() & ~loop, 1).otherwise(0)).alias("hops"),
            F.when(F.col("dst").isNull(), F.col("seen")).otherwise(F.array_append("seen", F.col("dst"))).alias("seen"), F.coalesce("reason", F.when(loop, "loop").otherwise(F.col("why"))).alias("reason"),
        )
    more = edges.select(F.col("src").alias("_src"))
    left = now.join(more, F.when(F.col("reason").isNull(), F.col("at")) == F.col("_src"), "left")
    return left.select("start", F.col("at").alias("final"), F.col("hops").cast("long").alias("hops"), F.coalesce("reason", F.when(F.col("_src").isNotNull(), "too many hops")).alias("reason"))
