"""HTML extraction and URL filters."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import html, urls

from .conftest import SF


def test_blocks():
    cases = {
        "<html><body><nav>menu</nav><article><h1>A &amp; b</h1><p>One\n two<p>three<br>four</article><footer>f</footer>": ["A & b", "One two", "three", "four"],
        "<body><header>h</header><div class='cookie-notice'>eat</div><p>text &#233;&nbsp;x</p><form>f</form><!-- c --></body>": ["text é x"],
        "<article><p>a</p><div id=comments><p>me too</p></div><aside>s</aside><p>b</p></article><p>outside</p>": ["a", "b"],
        "<main><p>m</p></main><p>o</p>": ["m"],
        "<script>var t = '<p>no</p>';</script><p>yes</p><style>p{}</style>": ["yes"],
        "<p>a <b>bold</b>ly <i>x</i></p>": ["a boldly x"],
        "<article><p>cut off &amp; he": ["cut off & he"],
        "<article><p>cut off <a href='x": ["cut off"],
        "<ul><li>a<li>b</ul>": ["a", "b"],
        "<div class='headline address'>kept</div><div class='ad'>gone</div><div hidden>gone</div><div style='display:none'>gone</div>": ["kept"],
        "just text": ["just text"],
        "<article></article><p>body</p>": ["body"],
        "</p></div><p>a</p></span>": ["a"],
        "<p>1 < 2 and 3 > 2</p>": ["1 < 2 and 3 > 2"],
        "": [],
        "<script>for(i=0;i<n;i++){x()}</script><article>after <b>a</b> script</article>": ["after a script"],
        "<style>a<b{}</STYLE ><p>y</p><script>never ends <p>no": ["y"],
        "<main><h1>Head</h1><article>Teaser</article><p>Body</p></main>": ["Head", "Teaser", "Body"],
        "<main><p>by</p><article><p>A long article</p><p>of two</p></article></main>": ["A long article", "of two"],
        "<div class='side-by-side'>a</div><p class='social-science'>b</p><p class='share-buttons'>c</p><p id=siteFooter>d</p><p class='left sidebar-2'>e</p>": ["a", "b"],
    }
    for page, want in cases.items():
        assert html.blocks(page) == want, page
    assert html.blocks(None) == []


def test_wrappers_comments_and_headings():
    for name in ("content no-sidebar", "site has-sidebar", "layout with-sidebar", "entry-content has-header", "nav-open", "header-image", "comment-on-the-budget", "post sponsored-by-none", "alert"):
        assert html.blocks(f'<body><nav>menu</nav><div class="{name}"><p>Text that stays.</p></div></body>') == ["Text that stays."], name
    for name in ("site-footer", "cookie-notice", "newsletter-signup", "navbar-dark", "menu-item", "sidebar-widget", "comments-area", "share-buttons", "comment-list"):
        assert html.blocks(f'<body><p>Text.</p><div class="{name}">gone</div></body>') == ["Text."], name
    page = '<article class="post no-comments"><header><h1>Title</h1><p>by</p></header><p>Text.</p><footer><h2>f</h2></footer></article><article class="comment"><p>no</p></article><article id="div-comment-7" class="comment-body"><p>no</p></article>'
    assert html.blocks(f"<header><h1>Site</h1></header>{page}") == ["Title", "Text."]
    assert html.blocks(f"<main>{page}<article class='comment'>no</article></main>") == ["Title", "Text."]


def test_long_urls_end(spark):
    import time

    rows = [(1, "https://a.org/" + "1" * 8000 + "x" * 32000), (2, "https://a.org/" + "1x" * 20000), (3, "https://a.org/" + "1" * 20000 + "-" * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    urls.judge(df).collect()
    began = time.time()
    kinds = [r[0] for r in df.select(urls._kind(urls.F.substring("url", 15, 50_000))).collect()]
    assert time.time() - began < 5 and [k == "*" for k in kinds] == [False, True, True]


def test_pages_as_written(spark):
    """Every page of the table has its text in one article of h1, p, b and br."""
    import html as entities

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>?", "", x))).strip() for x in re.split(r"</?(?:h1|p|br)>", m[1])] if m else []
        want[r["page_id"]] = "\n\n".join(x for x in parts if x)
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_repeated_runs_against_brute_force():
    random.seed(1)
    pages = [[random.choice("abc") for _ in range(random.randrange(0, 40))] for _ in range(20)]
    seen = {}
    for i, p in enumerate(pages):
        for k in range(len(p) - html.RUN + 1):
            seen.setdefault(tuple(p[k : k + html.RUN]), set()).add(i)
    hashes, n = html.repeated_runs(pages)
    from claimspark.llm import common

    want = {int(common.shingle_hashes(common.word_hashes([w.encode() for w in run]), html.RUN)[0]): len(s) for run, s in seen.items() if len(s) > 1}
    assert dict(zip(hashes.tolist(), n.tolist(), strict=True)) == want and want
    assert len(html.repeated_runs([])[0]) == 0 and len(html.repeated_runs([[], ["a"]])[0]) == 0


def test_boilerplate_of_a_host(spark, words, monkeypatch):
    monkeypatch.setattr(html, "CHUNK_PAGES", 24)
    note = " ".join(words(12, 1))
    rows = [(i, f"https://a.example.com/{i}", f"<article><p>{' '.join(words(20, i + 9))}</p><p>{note}</p><p>{i} end</p></article>") for i in range(40)]
    rows += [(100 + i, "http://b.example.com/", f"<p>{note}</p><p>own {i}</p>") for i in range(4)]
    rows += [(200, None, f"<p>{note}</p>"), (201, "https://a.example.com/x", None), (202, "https://a.example.com/y", ""), (None, "https://a.example.com/z", f"<p>{note} tail</p>"), (203, "x", "<p>twice</p>"), (203, "x", "<p>twice</p>")]
    got = html.extract(spark.createDataFrame([(*r, 1, "r") for r in rows], "page_id long, url string, html string, host int, runs string")).collect()
    assert len(got) == len(rows)
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert all(text[i, f"https://a.example.com/{i}"] == f"{' '.join(words(20, i + 9))}\n\n{i} end" for i in range(40))
    assert text[100, "http://b.example.com/"].startswith(note)  # too few pages to tell
    assert text[200, None] == note and text[201, "https://a.example.com/x"] == "" and text[None, "https://a.example.com/z"] == "tail"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("chunk", [1, 12, 512])
def test_boilerplate_does_not_depend_on_chunks(spark, words, monkeypatch, chunk):
    """A note on 61 of 100 distinct pages goes and one on 59 stays, wherever the pages are dealt; copies count once."""
    monkeypatch.setattr(html, "CHUNK_PAGES", chunk)
    often, seldom = " ".join(words(12, 1)), " ".join(words(12, 2))
    own = [" ".join(words(20, i + 9)) for i in range(100)]
    rows = [(i, "https://a.example.com/", f"<article><p>{own[i]}</p>" + f"<p>{often}</p>" * (i < 61) + f"<p>{seldom}</p>" * (i >= 41) + "</article>") for i in range(100)]
    rows += [(1000 + i, "https://a.example.com/", rows[99][2]) for i in range(200)] + [(2000 + i, "https://b.example.com/", f"<p>{often}</p><p>{own[i]}</p>") for i in range(9)]
    text = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(text) == len(rows) and all(text[i] == "\n\n".join([own[i], *[seldom] * (i >= 41)]) for i in range(100))
    assert all(text[1000 + i] == text[99] for i in range(200)) and all(text[2000 + i].startswith(often) for i in range(9))


def test_copies_are_no_boilerplate(spark, words):
    """A host mostly of copies of one article keeps it; a note on its distinct pages goes, from the copies too."""
    note, article = " ".join(words(12, 1)), " ".join(words(40, 2))
    page = lambda text: f"<article><p>{text}</p><p>{note}</p></article>"
    rows = [(i, f"https://a.example.com/{i}", page(article)) for i in range(60)] + [(100 + i, "https://a.example.com/", page(" ".join(words(20, i + 9)))) for i in range(20)]
    rows += [(200 + i, f"https://b.example.com/{i}", f"<article><p>{article}</p></article>") for i in range(30)]
    text = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[i] == article for i in [*range(60), *range(200, 230)])
    assert all(text[100 + i] == " ".join(words(20, i + 9)) for i in range(20))


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_rules(spark):
    odd = ["HTTP://A.COM/en/x", "http://com/en/", "http://xcom/en/", "http://example.com/en/7?a", "http://a.example.com/en/70", "http://m.example.net/de/8x", "no scheme", None, "", "http://", "http://h?q/en/", "a://b://c/d", "http://ORG/es/\nx", "http://é.com/en/ü"]
    rows = [(i, u) for i, u in enumerate(odd)]
    pages = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "page_id long, url string, host string, purity double").union(spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id") + 1000, "url", F.lit("h"), F.lit(1.0)))
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        host, path, rule, verdict = brute_rule(r["url"])
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule), r["url"]
        assert g["verdict"] == verdict if verdict else g["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_templates(spark):
    """Ids become wildcards, rare names too; what the rules block in a template decides for the rest of it."""
    rules = [("spam.com", "/buy/1", "block"), ("spam.com", "/news/2", "allow")]
    rows = [(i, f"http://spam.com/buy/{i}") for i in range(200)] + [(1000 + i, f"http://spam.com/news/{i}") for i in range(200)] + [(2000 + i, f"http://other.com/w{'abcdefghij'[i % 10]}{i // 10 * 'x'}/p") for i in range(100)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[i]["template"] for i in range(200)} == {"/buy/*"} and {got[1000 + i]["template"] for i in range(200)} == {"/news/*"}
    assert {got[i]["verdict"] for i in range(200)} == {"block"} and {got[1000 + i]["verdict"] for i in range(200)} == {"allow"}
    assert {got[2000 + i]["template"] for i in range(100)} == {"/*/p"}


def test_deep_paths_and_heirs(spark):
    """Segments below the last level count; a branch without labels is judged as its parent, until it has labels."""
    rules = [("a.com", "/x/bad/", "block"), ("a.com", "/y/", "allow")]
    rows = [(i, f"http://a.com/x/bad/{i}") for i in range(60)] + [(100 + i, f"http://a.com/x/more/{i}") for i in range(20)] + [(200 + i, f"http://a.com/y/{i}") for i in range(60)]
    rows += [(300 + i, f"http://a.com/z/{i}") for i in range(20)] + [(400, "http://b.com/a/b/c/d/e/f"), (401, "http://b.com/a/b/c/d/e/g"), (402, "http://b.com/a/b/c/d/1/2"), (403, "http://b.com/" + "s/" * 5000)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert len(got) == len(rows)
    assert {got[100 + i]["verdict"] for i in range(20)} == {"block"} and got[100]["rule"] is None  # all of /x that is known is blocked
    assert {got[300 + i]["verdict"] for i in range(20)} == {"allow"}
    assert got[403]["verdict"] == "allow" and all(got[400 + i]["template"].count("/") == urls.DEPTH + 1 for i in range(4))


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 60).astype(np.uint64)
    order, _ = html.suffix_order(tokens, 8)
    runs = [tuple(tokens[i : i + 8].tolist()) for i in order.tolist()]
    assert runs == sorted(runs)
