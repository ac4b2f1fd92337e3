"""Queries over captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.functions import html as H
from claimspark.functions import urls as U
from claimspark.operators import articles as A
from claimspark.operators import feeds as L
from claimspark.operators import audit as V

from .registry import query

HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
LINK = r"<a[^>]*href=\"([^\"]*)\""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


NAMES = f"map([{', '.join(map(_quoted, H.NAMED))}], [{', '.join(map(_quoted, H.NAMED.values()))}])"
_CODE = "try_cast(CASE WHEN n[2] IN ('x', 'X') THEN '0x' || n[3:] ELSE n[2:] END AS INTEGER)"
_SIGN = f"CASE WHEN n[1] = '#' THEN CASE WHEN {_CODE} = 160 THEN ' ' WHEN {_CODE} BETWEEN 1 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111 THEN chr({_CODE}) END ELSE map_extract({NAMES}, n)[1] END"
_PART = f"list_transform([regexp_extract(p, '{H.REFERENCE}', 1)], lambda n: coalesce({_SIGN} || p[length(n) + 2:], '&' || p))[1]"


def _decoded(c: str) -> str:
    return rf"trim(regexp_replace(list_transform([{c}], lambda t: CASE WHEN contains(t, '&') THEN array_to_string(list_transform(string_split(t, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {_PART} END), '') ELSE t END)[1], '\s+', ' ', 'g'))"


def _stripped(c: str) -> str:
    c = f"regexp_replace({c}, '<!--.*?-->', ' ', 'gs')"
    for tag in H.GONE:
        c = rf"regexp_replace({c}, '<{tag}(?:\s[^>]*)?>.*?</{tag}>', ' ', 'gis')"
    return f"regexp_replace(regexp_replace({c}, '</(?:{H.ENDS})>|<br[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'gs')"


BODY, REGION = _decoded(_stripped("html")), _decoded(_stripped("x"))
MAIN = rf"""(SELECT page_id, url, html, CASE WHEN length(best) >= greatest(400.0, 0.3 * length(body)) THEN best ELSE body END AS main FROM (SELECT *, coalesce(list_reduce(list_prepend('', list_transform(regexp_extract_all(html, '(?is)<article(?:\s[^>]*)?>(.*?)</article>', 1), lambda x: {REGION})), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), '') AS best, {BODY} AS body FROM pages))"""
H1, TITLE = r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)", r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
HEADLINE = f"coalesce(nullif({_decoded(H1)}, ''), nullif({_decoded(TITLE)}, ''), '')"
REGISTRABLE = "array_to_string(list_slice(string_split(regexp_replace({0}, '^www\\.', ''), '.'), -2, -1), '.')"
TRACKED = "[" + ", ".join(f"'{x}'" for x in U.TRACKING) + "]"
STARTS = " OR ".join(f"starts_with(lower(p), '{x}')" for x in U.TRACKING_STARTS)
NORMAL = rf"(regexp_extract(u, '^([^?]*)', 1) || CASE WHEN q = '' THEN '' ELSE '?' || q END)"  # noqa: F541
NORMALISED = rf"(SELECT *, array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains({TRACKED}, lower(regexp_extract(p, '^([^=]*)', 1))) AND NOT ({STARTS})), '&') AS q FROM (SELECT *, regexp_replace(url, '#.*$', '') AS u FROM {{0}}))"


DECLARED = f"(SELECT DISTINCT host, CASE length(host) % 4 WHEN 0 THEN 'https' WHEN 1 THEN 'browser' ELSE 'carrier pigeon' END AS transport FROM (SELECT {HOST.format('url')} AS host FROM pages) WHERE length(host) % 4 < 3)"


@query(f"""SELECT page_id, p.host, CASE WHEN transport IN ('https', 'browser') THEN transport END AS transport, CASE WHEN p.host = '' THEN 'unreadable url' WHEN transport IS NULL THEN 'undeclared' WHEN transport NOT IN ('https', 'browser') THEN 'unknown transport' END AS violation
 FROM (SELECT page_id, {HOST.format('url')} AS host FROM pages) p LEFT JOIN {DECLARED} d ON d.host = p.host""")
def page_scan(t):
    """Pages with the transport declared for their host, here by the length of its name, and what is wrong with others."""
    hosts = t("pages").select(U.host(F.col("url")).alias("host")).distinct()
    k = F.length("host") % 4
    declared = hosts.where(k < 3).withColumn("transport", F.when(k == 0, "https").when(k == 1, "browser").otherwise("carrier pigeon"))
    return A.scanned(t("pages").select("page_id", "url"), declared)


NAMED_HOSTS = r"(SELECT page_id, lower(unnest(regexp_extract_all(url || ' ' || html, 'https?://([A-Za-z0-9.-]+)', 1))) AS host FROM pages)"


def named(t):
    return V.hosts_named(t("pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text")), "page_id", "text")


@query(f"SELECT host, count(*) AS n, count(DISTINCT page_id) AS pages FROM {NAMED_HOSTS} GROUP BY host UNION ALL SELECT 'fault: no files read', 0, 0 WHERE NOT EXISTS (SELECT * FROM pages) UNION ALL SELECT 'fault: no hosts found', 0, 0 WHERE NOT EXISTS (SELECT * FROM {NAMED_HOSTS})")
def hosts_named(t):
    """Hosts that pages name, and a row for each fault of the scan itself."""
    hosts = named(t)
    faults = V.scan_faults(t("pages"), hosts).select(F.concat(F.lit("fault: "), "rule").alias("host"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pages"))
    return hosts.groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("pages")).union(faults)


@query(f"SELECT page_id, sha256({_decoded('html')}) AS decoded FROM pages")
def entities(t):
    return t("pages").select("page_id", F.sha2(H.decoded(F.col("html")), 256).alias("decoded"))


ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE url END AS safe, sha256({ESCAPED}) AS escaped, length({ESCAPED}) AS n_chars FROM pages")
def safe_url(t):
    """Urls that may be linked, and whole pages escaped, as hash and length."""
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    rows = t("pages").select("page_id", U.safe_url(url).alias("safe"), U.html_escaped(F.col("html")).alias("x"))
    return rows.select("page_id", "safe", F.sha2("x", 256).alias("escaped"), F.length("x").cast("long").alias("n_chars"))


@query(f"SELECT page_id, {REGISTRABLE.format(HOST.format('url'))} AS registrable FROM pages")
def registrable_host(t):
    return t("pages").select("page_id", U.registrable_host(U.host(F.col("url"))).alias("registrable"))


@query(f"SELECT page_id, {NORMAL} AS normal FROM {NORMALISED.format('pages')}")
def url_norm(t):
    return t("pages").select("page_id", U.normal_url(F.col("url")).alias("normal"))


REJECTED = [("cheap-pills.example.com", "shop"), ("casino-win.example.org", "betting"), ("free-bets.example.com", "betting"), ("adult-x.example.net", "adult"), ("ads-track.example.org", "tracker")]


GATED = rf"""(SELECT page_id, host, CASE WHEN host = '' THEN 'unparsable' WHEN NOT regexp_matches(url, '^https?:') THEN 'protocol' {' '.join(f"WHEN host = '{h}' OR host LIKE '%.{h}' THEN '{w}'" for h, w in REJECTED)}
 WHEN host LIKE 'amp.%' OR host LIKE '%.amp.%' OR host LIKE 'amp-cdn.%' OR host LIKE '%.amp-cdn.%' THEN 'AMP mirror' WHEN regexp_matches('.' || host, '\.(web)?cache\.') THEN 'cache mirror' WHEN contains('.' || host, '.translate.') THEN 'translation proxy'
 WHEN regexp_matches('.' || host, '\.(m|mobile)\.facebook\.com$') THEN 'social platform' WHEN regexp_matches(lower(url), '/amp(/|\.html|$)') THEN 'AMP rendition' WHEN regexp_matches(url, '^https?://[^/]*/?$') THEN 'site root' END AS reason
 FROM (SELECT page_id, url, {HOST.format('url')} AS host FROM pages))"""


@query(f"SELECT page_id, host, reason IS NULL AS ok, reason FROM {GATED}")
def host_gate(t):
    pages = t("pages").select("page_id", "url")
    return A.host_gate(pages, F.broadcast(pages.sparkSession.createDataFrame(REJECTED, "host string, why string")))


@query(f"SELECT page_id, sha256({BODY}) AS text, length({BODY}) AS n_chars FROM pages")
def html_to_text(t):
    return t("pages").select("page_id", H.plain_text(F.col("html")).alias("x")).select("page_id", F.sha2("x", 256).alias("text"), F.length("x").cast("long").alias("n_chars"))


@query(f"SELECT page_id, sha256(main) AS text, length(main) AS n_chars FROM {MAIN}")
def main_text(t):
    return t("pages").select("page_id", H.main_text(F.col("html")).alias("x")).select("page_id", F.sha2("x", 256).alias("text"), F.length("x").cast("long").alias("n_chars"))


@query(f"SELECT page_id, {HEADLINE} AS headline FROM pages")
def meta_first(t):
    return t("pages").select("page_id", F.coalesce(H.headline(F.col("html")), F.lit("")).alias("headline"))


@query(f"""SELECT page_id, {HEADLINE} AS headline, {REGISTRABLE.format(HOST.format('url'))} AS publisher, '' AS author, CAST(NULL AS VARCHAR) AS published, {HOST.format('url')} AS host, {NORMAL} AS canonical, length(main) AS n_chars, sha256(main) AS hash FROM {NORMALISED.format(MAIN)}""")
def extract_articles(t):
    return A.articles(t("pages"))


FEEDS = """(SELECT a.page_id AS feed_id, '<link>' || a.url || '.rss</link><link rel="x" href="' || coalesce(b.url, '') || '"/><LINK> ' || coalesce(c.url, '') || ' </LINK><link>http://a.b/short</link><link>' || a.url || '</link><link>' || a.url || '?utm_x=1</link>' AS text
 FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1 LEFT JOIN pages c ON c.page_id = a.page_id + 2)"""
LINKS = rf"""(SELECT feed_id, i, trim(CASE WHEN regexp_matches(tag, '(?i)^<link[^>]*>[^<]+</link>') THEN regexp_extract(tag, '(?i)<link[^>]*>([^<]+)</link>', 1) ELSE regexp_extract(tag, '(?i)href="([^"]+)"', 1) END) AS link
 FROM (SELECT feed_id, unnest(x) AS tag, unnest(range(len(x))) AS i FROM (SELECT feed_id, regexp_extract_all(text, '(?i)<link[^>]*>[^<]+</link>|<link[^>]+href="[^"]+"') AS x FROM {FEEDS})))"""
#: page_id here counts links.
ABLE = rf"(SELECT *, row_number() OVER (ORDER BY feed_id, i) AS page_id, link AS url FROM {LINKS} WHERE regexp_matches(link, '^https?://') AND NOT regexp_matches(link, '(?i)\.(rss|xml)(\?|$)') AND length(regexp_extract(link, '^[^:]*://[^/?#]*([^?#]*)', 1)) > 12)"
FIRST_FOUR = f"(SELECT feed_id, link, row_number() OVER (PARTITION BY feed_id ORDER BY i) AS place FROM able JOIN {GATED.replace('FROM pages', 'FROM able')} g USING (page_id) WHERE reason IS NULL)"


@query(rf"""WITH able AS {ABLE}, l AS (SELECT *, link AS url FROM {FIRST_FOUR} WHERE place <= 4), m AS (SELECT page_id, {NORMAL} AS normal FROM {NORMALISED.format('pages')}), n AS (SELECT feed_id, link, place, {NORMAL} AS normal FROM {NORMALISED.format('l')}),
p AS (SELECT normal, {HEADLINE} AS headline, {HOST.format('url')} AS publisher, CASE WHEN page_id % 7 > 0 THEN '2024-01-0' || page_id % 7 END AS published, list_filter(list_transform(regexp_extract_all(main, '[^.!?]{{60,220}}[.!?]'), lambda s: trim(s)), lambda s: length(s) >= 60)[1] AS sentence FROM {MAIN} JOIN m USING (page_id)),
f AS (SELECT feed_id, min(place) AS place FROM n JOIN p USING (normal) WHERE headline <> '' AND publisher <> '' AND published IS NOT NULL AND sentence IS NOT NULL GROUP BY 1)
SELECT page_id AS feed_id, f.place, n.link, headline, publisher, published, sentence FROM pages LEFT JOIN f ON f.feed_id = page_id LEFT JOIN n ON n.feed_id = page_id AND n.place = f.place LEFT JOIN p USING (normal)""")
def page_links(t):
    """The first article that a feed leads to; here a feed names its page and the two after it, among other links."""
    p = t("pages").select("page_id", "url")
    after = lambda n: p.select((F.col("page_id") - n).alias("page_id"), F.col("url").alias(f"u{n}"))
    parts = F.lit("<link>"), "url", F.lit('.rss</link><link rel="x" href="'), F.coalesce("u1", F.lit("")), F.lit('"/><LINK> '), F.coalesce("u2", F.lit("")), F.lit(" </LINK><link>http://a.b/short</link><link>"), "url", F.lit("</link><link>"), "url", F.lit("?utm_x=1</link>")
    feeds = p.join(after(1), "page_id", "left").join(after(2), "page_id", "left").select(F.col("page_id").alias("feed_id"), F.concat(*parts).alias("text"))
    k = F.col("page_id") % 7
    captured = t("pages").select("url", F.coalesce(H.headline(F.col("html")), F.lit("")).alias("headline"), U.host(F.col("url")).alias("publisher"), F.when(k > 0, F.concat(F.lit("2024-01-0"), k.cast("string"))).alias("published"), H.main_text(F.col("html")).alias("text"))
    return L.first_articles(feeds, captured, p.sparkSession.createDataFrame(REJECTED, "host string, why string"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-03-0' || (1 + doc_id % 9) WHEN 1 THEN '2023-05-05' END AS published FROM documents")
def rendered_date(t):
    k = F.col("doc_id") % 4
    lead = F.when(k == 0, F.concat(F.lit("Posted 2024-03-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit(". "))).when(k == 1, "On 5 May 2023, ").when(k == 2, "March 7, 2022 and 2022-03-08 ").otherwise("")
    return t("documents").select("doc_id", F.date_format(H.rendered_date(F.concat(lead, "text")), "yyyy-MM-dd").alias("published"))


MARK = "Enable JavaScript and cookies to continue"


@query(f"SELECT page_id, {' OR '.join(f'contains(html, {_quoted(m)})' for m in H.STRONG)} OR (length(html) + CASE WHEN page_id % 6 = 0 THEN {len(MARK)} ELSE 0 END < {H.SMALL_PAGE} AND (page_id % 6 = 0 OR length(main) < {H.LITTLE_PROSE} OR {' OR '.join(f'contains(html, {_quoted(m)})' for m in H.WEAK)})) AS challenged FROM {MAIN}")
def challenge_flag(t):
    """Pages, every sixth with a weak marker at its end, that are interstitials."""
    marked = F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit(MARK))).otherwise(F.col("html"))
    rows = t("pages").select("page_id", marked.alias("marked"), H.main_text(F.col("html")).alias("prose"))
    return rows.select("page_id", H.challenge(F.col("marked"), F.col("prose")).alias("challenged"))


RETIRED = {"blog.tionsh.example.net": "blog closed", "www.cheap-pills.example.com": "shop", "m.ththth.example.net": "mobile copy"}
DECLARED = ["thther.example.org", "blog.ththan.example.net", "blog.tiontion.example.com", "www.ththhe.example.com", "ththed.example.org", "m.ththth.example.net"]


@query(f"""SELECT host, CASE {' '.join(f"WHEN host = '{h}' THEN 'retired'" for h in RETIRED)} WHEN host IN ({', '.join(map(_quoted, DECLARED))}) THEN 'allowed' ELSE 'undeclared' END AS verdict, CASE host {' '.join(f"WHEN '{h}' THEN '{w}'" for h, w in RETIRED.items())} END AS why, count(DISTINCT page_id) AS pages FROM {NAMED_HOSTS} GROUP BY host""")
def host_allowlist(t):
    """Hosts that pages name, beside the lists of those retired and those declared."""
    return V.host_verdicts(named(t).groupBy("host").agg(F.count("*").alias("pages")), RETIRED, DECLARED).select("host", "verdict", "why", "pages")


@query(f"""WITH RECURSIVE e AS (SELECT page_id AS src, CASE WHEN page_id % 17 = 0 THEN page_id + 1 WHEN page_id % 3 = 0 THEN page_id + 3 ELSE page_id + 1 END AS dst FROM pages WHERE page_id % 10 <> 9),
g AS (SELECT page_id AS node, reason FROM {GATED} WHERE reason IS NOT NULL),
w AS (SELECT page_id AS start, page_id AS cur, 0 AS hops FROM pages UNION ALL SELECT start, dst, hops + 1 FROM w JOIN e ON cur = src WHERE hops < 6 AND cur NOT IN (SELECT node FROM g)),
l AS (SELECT start, max_by(cur, hops) AS final, max(hops) AS hops FROM w GROUP BY start)
SELECT start, CAST(final AS BIGINT) AS final, CAST(hops AS BIGINT) AS hops, CASE WHEN reason IS NOT NULL THEN 'rejected: ' || reason WHEN hops = 6 AND final IN (SELECT src FROM e) THEN 'too many hops' END AS reason FROM l LEFT JOIN g ON final = node""")
def redirect_resolve(t):
    """Pages that lead to others; each hop is held against the gate of hosts."""
    k = F.col("page_id")
    edges = t("pages").where(k % 10 != 9).select(k.alias("src"), F.when(k % 17 == 0, k + 1).when(k % 3 == 0, k + 3).otherwise(k + 1).alias("dst"))
    rejected = host_gate(t).where("not ok").select(k.alias("node"), F.col("reason").alias("why"))
    return A.redirects(edges, t("pages").select(k.alias("start")), rejected=rejected)


@query(r"""SELECT page_id, target FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="/([^"]*)"', 1)) AS target FROM pages WHERE page_id % 2 = 0) WHERE NOT regexp_matches(target, '^[A-Z]') AND target NOT IN (SELECT unnest(regexp_extract_all(html, '<a[^>]*href="/([^"]*)"', 1)) FROM pages WHERE page_id % 2 = 1)""")
def closure_holes(t):
    """Targets that listed pages link to and that are not themselves listed."""
    links = lambda rest: t("pages").where(f"page_id % 2 = {rest}").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="/([^"]*)"'), F.lit(1))).alias("target"))
    named = links(0).distinct().where(~F.col("target").rlike("^[A-Z]"))
    return named.join(links(1), "target", "left_anti").select("page_id", "target")
