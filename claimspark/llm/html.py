"""HTML extraction: a page's blocks outside menus and the like, less token runs that a suffix array over the pages of
its host shows to repeat on most of them."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A run of at least RUN tokens is boilerplate if at least this share, in hundredths, of the host's distinct pages hold
#: it, and no fewer than LEAST_PAGES of them.
RUN, SHARE_PERCENT, LEAST_PAGES = 8, 60, 10
#: Pages of a host that one suffix array covers; larger hosts are dealt in chunks, whose counts are added up.
CHUNK_PAGES = 512

# fixed values: elements without main text, elements that end a block, and names of parts that aren't the article
DROPPED = {
    "head", "title", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "nav", "header", "footer", "aside",
    "form", "button", "select", "textarea", "input", "dialog", "menu", "audio", "video", "figure",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "h1", "h2",
    "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Words that name such a part wherever they stand in a class or id, and words that do so alone or beside a word for a box.
PART = {
    "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup",
    "modal", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "comment", "comments",
    "disqus", "newsletter", "subscribe", "pagination", "pager", "toolbar",
}
PART_OR_TOPIC = {"ad", "ads", "notice", "notices", "alert", "side", "replies", "respond", "related", "recommended", "share", "sharing", "social", "signup", "login", "widget", "skip"}
BOX = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "column", "container", "content", "form", "icons", "inner", "left", "link",
    "links", "list", "main", "media", "message", "module", "page", "panel", "post", "posts", "right", "row", "section", "site", "slot", "stories", "text",
    "to", "top", "unit", "wrap", "wrapper",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")


#: Words for what a part holds or how it looks.
OF_PART = {"item", "items", "card", "cards", "logo", "copyright", "meta", "title", "heading", "primary", "secondary", "global", "dark", "light", "fixed", "sticky", "mobile", "desktop", "policy", "body", "thread", "author", "avatar", "reply", "default", "expand", "brand", "toggle", "collapse"}
#: Words before which a part's name tells of the page's layout, or that there is none, and words of a reader's comment.
STATE = {"no", "not", "non", "has", "have", "with", "without", "is", "hide", "hidden", "show"}
COMMENT, OF_COMMENT = {"comment", "comments", "reply", "replies"}, BOX | {"body", "meta", "author", "thread", "item", "wrap", "div"}


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[\W_\d]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


def names_part(value: str) -> bool:
    """Whether a class or id says that an element is no part of the article, judged by each whole name: it ends with the
    word for such a part, or holds nothing but words for parts, boxes and how they look, and doesn't begin with a word of
    state. "site-footer", "cookie-notice" and "share-buttons" do, "no-sidebar", "nav-open", "header-image" and
    "side-by-side" don't."""
    for name in value.split():
        words = _words(name)
        if not words or words[0] in STATE:
            continue
        stem = list(words)
        while stem and stem[-1] in BOX:
            stem.pop()
        if stem and stem[-1] in PART or PART.union(PART_OR_TOPIC).intersection(words) and all(w in PART or w in PART_OR_TOPIC or w in BOX or PART.intersection(words) and w in OF_PART for w in words):
            return True
    return False


def names_comment(value: str) -> bool:
    """Whether a class or id of an article element says that it is a reader's comment."""
    return any(COMMENT.intersection(words := _words(name)) and all(w in COMMENT or w in OF_COMMENT for w in words) for name in value.split())


def _dropped(name: str, attributes: str, by_name: bool = True) -> bool:
    if name in DROPPED:
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            if names_comment(value) if name == "article" else by_name and names_part(value):
                return True
            continue
        if name == "article":
            continue
        value = value.lower()
        if key == "hidden" or key == "role" and value in ROLE:
            return True
        if key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str | None) -> list[str]:
    """The blocks of a page in order, as _blocks() finds them. A page that would be left without any, as the name of a
    wrapper speaks of a part, is read without regard to classes and ids."""
    return _blocks(page, True) or _blocks(page, False) if page else []


def _blocks(page: str, by_name: bool) -> list[str]:
    """The blocks of a page in order, white space single: those in its articles, or in main if the articles hold less than
    half of its text (as a teaser does), else in the body, and none in parts that _dropped() tells. What stands in script
    and the like is passed over up to the literal end tag, whatever signs it holds. Of an article's own header the
    headings stay."""
    found: list[tuple[int, list[str]]] = []  # (0 body, 1 main, 2 article in no main, 3 article in main), pieces of text
    stack: list[tuple[str, int, int]] = []  # name, how much it adds to gone, region before
    region, gone, here = 0, 0, []
    last = 0

    def flush() -> None:
        nonlocal here
        if here:
            found.append((region, here))
            here = []

    while m := _TAG.search(page, last):
        name = (m[2] or "").lower()
        if not gone and m.start() > last:
            here.append(page[last : m.start()])
        last = m.end()
        if not name:
            continue
        if m[1]:
            if any(s[0] == name for s in stack):
                if name in BLOCKS or name in DROPPED:
                    flush()
                while stack:
                    top, dropped, before = stack.pop()
                    gone -= dropped
                    region = before
                    if top == name:
                        break
            elif name in ("p", "br"):
                flush()
            continue
        dropped = int(_dropped(name, m[3] or "", by_name))
        if gone and name in HEADINGS and gone == sum(s[0] == "header" and s[1] == 1 and s[2] >= 2 for s in stack):
            dropped = -gone
        if name in BLOCKS or name in DROPPED:
            flush()
        if name in VOID or (m[3] or "").endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, last)
            last = end.end() if end else len(page)
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:  # an open one ends
            _, was, region = stack.pop()
            gone -= was
        stack.append((name, dropped, region))
        gone += dropped
        if not gone:
            region = (3 if region in (1, 3) else 2) if name == "article" else max(region, 1) if name == "main" else region
    if not gone and last < len(page):
        here.append(page[last:])
    flush()
    texts = [(r, _SPACE.sub(" ", entities.unescape("".join(t))).strip()) for r, t in found]
    size = [sum(len(t) for r, t in texts if r == k) for k in range(4)]
    if size[1] > size[3]:  # articles in main are part of it
        taken: tuple[int, ...] = (1, 2, 3)
    else:
        taken = (2, 3) if size[2] + size[3] else (0,)
    return [t for r, t in texts if t and r in taken]


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the next `depth` tokens (prefix doubling), and their rank by these."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < depth:
        step = min(width, depth - width)
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step] = rank[step:]
        both = rank * (len(rank) + 2) + ahead
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64) + 1
        width += step
    return np.argsort(rank, kind="stable"), rank


def repeated_runs(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the RUN-token substrings on two pages or more, and on how many: neighbours in a suffix array over the
    pages' token streams, a sign of its own ending each."""
    words = [w for p in pages for w in [*p, ""]]
    sizes = np.array([len(p) + 1 for p in pages])
    if not words:
        return np.empty(0, C.U), np.empty(0, np.int64)
    tokens = C.word_hashes([w.encode("utf-8", "surrogatepass") for w in words])
    page = np.repeat(np.arange(len(pages)), sizes)
    ends = np.cumsum(sizes) - 1
    tokens[ends] = np.arange(len(pages)).astype(C.U)  # differ, so no run goes over an end
    order, rank = suffix_order(tokens, RUN)
    order = order[ends[page[order]] >= order + RUN]  # a whole run before the page's end
    r, of = rank[order], page[order]
    by = np.lexsort((of, r))
    r, of, order = r[by], of[by], order[by]
    new = np.r_[True, (r[1:] != r[:-1]) | (of[1:] != of[:-1])] if len(r) else np.empty(0, bool)
    r, order = r[new], order[new]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, int)
    n = np.diff(np.r_[first, len(r)])
    first, n = first[n > 1], n[n > 1]
    hashes = C.shingle_hashes(C.word_hashes([w.encode("utf-8", "surrogatepass") for w in words]), RUN)
    return hashes[order[first]], n


def keep_unique(texts: list[str], boilerplate: np.ndarray) -> list[str]:
    """Blocks less the tokens that a boilerplate run covers; runs go over the ends of blocks."""
    words = [t.split(" ") for t in texts]
    flat = [w for x in words for w in x]
    hashes = C.shingle_hashes(C.word_hashes([w.encode("utf-8", "surrogatepass") for w in flat]), RUN)
    hit = np.flatnonzero(np.isin(hashes, boilerplate))
    if not len(hit):
        return texts
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[hit] += 1
    np.subtract.at(edge, hit + RUN, 1)
    kept = np.cumsum(edge[:-1]) == 0
    out, at = [], 0
    for x in words:
        out.append(" ".join(w for w, k in zip(x, kept[at : at + len(x)], strict=True) if k))
        at += len(x)
    return [t for t in out if t]


def _tokens(streams: pa.ChunkedArray) -> list[list[str]]:
    """One of each group of equal token streams; pages without a token are one group."""
    return [x.split(" ") if x else [] for x in dict.fromkeys(streams.to_pylist())]


def _run_hashes(tokens: list[str]) -> np.ndarray:
    return np.unique(C.shingle_hashes(C.word_hashes([w.encode("utf-8", "surrogatepass") for w in tokens]), RUN))


def boilerplate(rows: DataFrame) -> DataFrame:
    """(host, runs): hashes of the runs that at least SHARE_PERCENT of a host's distinct pages hold, and LEAST_PAGES of
    them. rows: (host, html).

    Token streams are dealt by hash, so equal ones meet; a host of more than CHUNK_PAGES pages is dealt in chunks. What
    reaches the share in all of a host reaches it in one of its chunks, so a suffix array over each chunk names the
    candidates, and those of hosts of several chunks are counted in all of them: results don't depend on the chunks."""
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    large = C.saved(counts.where(F.col("n") > CHUNK_PAGES).select("host", F.ceil(F.col("n") / CHUNK_PAGES).cast("int").alias("chunks")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies in one task go before the shuffle
        for b in batches:
            hosts, streams = [], []
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stream = " ".join(blocks(page.as_py()))
                key = hashlib.blake2b(f"{host}\0{stream}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in seen:
                    seen.add(key)
                    hosts.append(host)
                    streams.append(stream)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(streams, pa.string())], names=["host", "stream"])

    def dealt(rows: DataFrame) -> DataFrame:
        parsed = rows.select("host", "html").mapInArrow(C.tidied(parse), "host string, stream string")
        chunks = F.coalesce("chunks", F.lit(1))
        return parsed.join(large, "host", "left").select("host", F.pmod(F.xxhash64("stream"), chunks).alias("chunk"), chunks.alias("chunks"), "stream")

    def found_in(host: str, hashes: np.ndarray, n: np.ndarray, pages: int | None = None) -> pa.Table:
        more = [] if pages is None else [pages]  # a row without a run tells how many distinct pages there are
        runs = pa.array([*hashes.view(np.int64).tolist(), *[None] * len(more)], pa.int64())
        C.tidy()
        return pa.table({"host": pa.array([host] * len(runs), pa.string()), "run": runs, "n": pa.array([*n.tolist(), *more], pa.int64())})

    def scan(table: pa.Table) -> pa.Table:
        pages, whole = _tokens(table.column("stream")), table.column("chunks")[0].as_py() == 1
        if whole and len(pages) < LEAST_PAGES:
            hashes, n = np.empty(0, C.U), np.empty(0, np.int64)
        elif len(pages) == 1:
            hashes = _run_hashes(pages[0])
            n = np.ones(len(hashes), np.int64)
        else:
            hashes, n = repeated_runs(pages)
        often = (100 * n >= SHARE_PERCENT * len(pages)) & (n >= (LEAST_PAGES if whole else 1))
        return found_in(table.column("host")[0].as_py(), hashes[often], n[often], len(pages))

    def count(table: pa.Table, candidates: pa.Table) -> pa.Table:
        runs = np.sort(candidates.column("run").to_numpy().view(C.U))
        n = np.zeros(len(runs), np.int64)
        for tokens in _tokens(table.column("stream")) if len(runs) else []:
            n += np.isin(runs, _run_hashes(tokens))
        return found_in(candidates.column("host")[0].as_py() if len(runs) else "", runs[n > 0], n[n > 0])

    kind = "host string, run long, n long"
    found = C.saved(dealt(rows).groupBy("host", "chunk").applyInArrow(scan, kind))
    sizes = found.where("run is null").groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("parts")).where(F.col("pages") >= LEAST_PAGES)
    runs = C.saved(found.where("run is not null").join(sizes, "host"))
    settled, parted = runs.where("parts = 1"), C.saved(runs.where("parts > 1").select("host", "run", "pages").distinct())
    if not parted.isEmpty():
        hosts = C.saved(parted.select("host").distinct())
        asked = parted.join(large, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - F.lit(1).cast("long"))).alias("chunk"), "run")
        counted = dealt(rows.join(hosts, "host", "left_semi")).groupBy("host", "chunk").cogroup(asked.groupBy("host", "chunk")).applyInArrow(count, kind)
        counted = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(parted, ["host", "run"])
        settled = settled.select("host", "run", "n", "pages").union(counted.select("host", "run", "n", "pages"))
    often = (F.col("n") >= LEAST_PAGES) & (100 * F.col("n") >= SHARE_PERCENT * F.col("pages"))
    return C.saved(settled.where(often).groupBy("host").agg(F.collect_list("run").alias("runs")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of (page_id, url, html).

    text joins the blocks by two line feeds, less the runs of boilerplate(). Null or empty html, and pages without a
    block, have an empty text and 0 characters; a null url is of an empty host, whose pages are compared like another's;
    repeated rows and null page_ids are rows like others; an empty table gives none. Pages of equal tokens count as one
    page, so copies of an article are no boilerplate.

    Pages are read twice: token streams are shuffled once to find the runs of a host, and each page is then cut where it
    stands, beside the runs of its host, so a page's text depends on no other host and on no chunk. Very long pages are
    pages like others. Columns of pages beside the three play no part."""
    C.in_small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, runs in zip(b.column(2), b.column(3), strict=True):
                found = blocks(page.as_py())
                if found and runs.is_valid:
                    found = keep_unique(found, runs.values.to_numpy().view(C.U))
                texts.append("\n\n".join(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    beside = rows.join(boilerplate(rows), "host", "left").select("page_id", "url", "html", "runs")
    return beside.mapInArrow(C.tidied(cut), "page_id long, url string, text string, n_chars long")
