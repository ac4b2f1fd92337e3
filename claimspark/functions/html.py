"""Column functions over html; native expressions."""

from __future__ import annotations

from html.entities import codepoint2name

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

GONE = ["script", "style", "noscript", "svg", "nav", "header", "footer", "aside", "form", "figure"]
#: Named references: the standard's names of signs, Latin letters, Greek letters and typography, and ' with a plain space for
#: a no-break one.
NAMED = {name: chr(code) for code, name in sorted(codepoint2name.items())} | {"apos": "'", "nbsp": " "}
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
ENDS = "p|div|li|tr|h[1-6]|ul|ol|table|section|article|main|blockquote"


def references(c: Column) -> Column:
    """Character references decoded once, by name, number or hexadecimal number; others stay as they are."""
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in NAMED.items())), F.lit("\x01"), F.lit("\x02"))  # folded to one literal

    def sign(code: Column) -> Column:
        fits = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        return F.when(code == 160, " ").when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def replaced(part: Column, name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 7)).try_cast("int")
        found = F.when(F.startswith(name, F.lit("#")), once(number, sign)).when(name != "", F.try_element_at(names, name))
        return once(found, lambda x: F.when(x.isNotNull(), F.concat(x, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part)))

    def one(part: Column) -> Column:
        return once(F.regexp_extract(part, REFERENCE, 1), lambda name: replaced(part, name))

    joined = lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return once(c, lambda x: F.when(F.contains(x, F.lit("&")), once(F.split(x, "&"), joined)).otherwise(x))


def decoded(c: Column) -> Column:
    """Character references decoded, white space single."""
    return F.trim(F.regexp_replace(references(c), r"\s+", " "))


def stripped(c: Column) -> Column:
    """Text without comments and parts that are not the page's own; a line a block."""
    c = F.regexp_replace(c, "(?s)<!--.*?-->", " ")
    for tag in GONE:
        c = F.regexp_replace(c, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}>", " ")
    c = F.regexp_replace(c, f"(?i)</(?:{ENDS})>|<br[^>]*>", "\n")
    return F.regexp_replace(c, "(?s)<[^>]*>", " ")


def plain_text(c: Column) -> Column:
    return decoded(stripped(c))


def main_text(c: Column) -> Column:
    """The longest article or main region if it is long enough, else the body."""
    regions = F.concat(F.regexp_extract_all(c, F.lit("(?is)<article(?:\\s[^>]*)?>(.*?)</article>"), F.lit(1)), F.regexp_extract_all(c, F.lit("(?is)<main(?:\\s[^>]*)?>(.*?)</main>"), F.lit(1)))
    texts = F.transform(regions, lambda r: plain_text(r))
    best = F.coalesce(F.aggregate(texts, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a)), F.lit(""))
    chosen = lambda x: F.when(F.length(x.best) >= F.greatest(F.lit(400.0), 0.3 * F.length(x.body)), x.best).otherwise(x.body)
    return once(F.struct(best.alias("best"), plain_text(c).alias("body")), chosen)


def _first(*found: Column) -> Column:
    texts = F.transform(F.array(*found), decoded)
    return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))


def meta(c: Column, names: list[str]) -> Column:
    """The first non-empty content of a meta tag of these names, in order, attributes either way round; null if none."""
    found = []
    for n in names:
        n = n.replace(".", "\\.")
        found += [F.regexp_extract(c, f"(?is)<meta[^>]*(?:name|property)=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1), F.regexp_extract(c, f"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:name|property)=[\"']{n}[\"']", 1)]
    return _first(*found)


def headline(c: Column) -> Column:
    return _first(F.coalesce(meta(c, ["og:title", "twitter:title"]), F.lit("")), F.regexp_extract(c, "(?is)<h1[^>]*>(.*?)</h1>", 1), F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1))


def canonical(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)[\"']", 1), F.lit(""))


def published_raw(c: Column) -> Column:
    """A stated publish time; a time of change is never one."""
    return F.coalesce(meta(c, ["article:published_time", "datePublished", "date", "dc.date"]), F.nullif(F.regexp_extract(c, "(?is)<time[^>]*datetime=[\"']([^\"']*)[\"']", 1), F.lit("")))


DATE_PATTERNS = [("([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd"), ("([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})", "d MMMM yyyy"), ("((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})", "MMMM d, yyyy")]


def rendered_date(text: Column) -> Column:
    """The only date in the first 1200 characters, in three spellings; null if there is none or more than one."""
    head = F.left(text, F.lit(1200))
    read = lambda form: lambda d: F.to_date(F.try_to_timestamp(d, F.lit(form)))
    dates = F.concat(*(F.transform(F.regexp_extract_all(head, F.lit(p), F.lit(1)), read(form)) for p, form in DATE_PATTERNS))
    dates = F.array_distinct(F.array_compact(dates))
    return F.when(F.size(dates) == 1, F.try_element_at(dates, F.lit(1)))


# fixed values: markers of interstitial pages, those that tell by themselves and those that do in a small page, what a small
# page is, and how little prose one holds
STRONG = ["cf-browser-verification", "__cf_chl", "Client Challenge", "Attention Required! | Cloudflare", "Checking your browser before accessing", "DDoS protection by", "Please verify you are a human"]
WEAK = ["JavaScript is disabled in your browser", "Enable JavaScript and cookies to continue", "Just a moment"]
SMALL_PAGE, LITTLE_PROSE = 20000, 500


def challenge(html: Column, text: Column) -> Column:
    """Whether a page is an interstitial: a strong marker, a weak one in a small page, or hardly any prose in one."""
    any_of = lambda marks: F.greatest(*(F.contains(html, F.lit(m)) for m in marks))
    return any_of(STRONG) | ((F.length(html) < SMALL_PAGE) & (any_of(WEAK) | (F.length(text) < LITTLE_PROSE)))


def json_ld(c: Column) -> Column:
    """The first ld+json node of an article-like type with a headline, as a struct (headline, publisher, author, date);
    null if there is none. Blocks that don't parse are skipped."""
    blocks = F.regexp_extract_all(c, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    kind = "headline string, datePublished string, author string, publisher string, `@type` string, `@graph` string"
    one = F.transform(blocks, lambda b: F.from_json(F.trim(b), f"struct<{kind}>"))
    many = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(F.trim(b), f"array<struct<{kind}>>"), F.array())))
    graphs = F.flatten(F.transform(one, lambda x: F.coalesce(F.from_json(x["@graph"], f"array<struct<{kind}>>"), F.array())))
    nodes = F.filter(F.concat(one, many, graphs), lambda x: x["@type"].rlike("(?i)article|newsarticle|blogposting|report") & (F.coalesce(x["headline"], F.lit("")) != ""))
    name = lambda v: F.coalesce(F.get_json_object(v, "$.name"), F.get_json_object(v, "$[0].name"), F.get_json_object(v, "$[0]"), v)
    first = F.try_element_at(nodes, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["headline"].alias("headline"), name(first["publisher"]).alias("publisher"), name(first["author"]).alias("author"), first["datePublished"].alias("date")))
