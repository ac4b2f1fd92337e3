"""Column functions over urls and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track or belong to a visit, by name and by how names begin
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "igsh", "ref", "ref_src", "referrer", "source", "cmpid", "smid", "partner", "sh", "s", "error", "code", "token", "_ga", "spm"]
TRACKING_STARTS = ["utm_", "session", "at_"]
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "ac", "edu", "or", "ne"]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def registrable_host(h: Column) -> Column:
    """The last two labels, or three under a second level of a country."""
    labels = F.split(F.regexp_replace(h, r"^www\.", ""), r"\.")
    n = F.size(labels)
    country = (n >= 3) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL)
    kept = F.when(country, F.slice(labels, -3, 3)).when(n > 2, F.slice(labels, -2, 2)).otherwise(labels)
    return F.array_join(kept, ".")


def normal_url(url: Column) -> Column:
    """Without fragment and tracking parameters; what doesn't look like a url is left as it is."""
    bare = F.regexp_replace(url, r"#.*$", "")
    path, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    tracks = f"(?i)^(?:(?:{'|'.join(TRACKING)})(?:=|$)|{'|'.join(TRACKING_STARTS)})"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracks)), "&")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept))).otherwise(url)


def safe_url(url: Column) -> Column:
    """http and https urls; null for others."""
    return F.when(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), url)


def html_escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def host_suffixes(h: Column) -> Column:
    """The host and all that it is a subdomain of."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def doi(url: Column) -> Column:
    """The DOI that a journal's url carries; null without one."""
    return F.nullif(F.regexp_extract(url, r"/(10\.[0-9]{4,9}/[^?#\s]+)", 1), F.lit(""))
