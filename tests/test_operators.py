"""Operators that SQL can't express, beside plain Python, and branches that the tables don't reach."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from claimspark.functions import dates, html, quantities, text, urls
from claimspark.operators import articles, audit, evidence, matching, views
from claimspark.operators.tables import saved
from claimspark.plans import registry
from claimspark.sources import forecasts

SF = "/root/testdata/sf0.001"


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_bound_quantity(spark):
    yes = ["AI will replace 2 million jobs.", "more than 1.5 million workers lose out", "jobs reached 3 million", "It takes two million units"]
    no = ["fewer than 2 million jobs", "about one million jobs", "2030 jobs", "not 5 million workers", "900,000 jobs", "$5 million jobs", "workers are at most 2 million", "up to 5 million jobs", ""]
    f = lambda c: quantities.bound_quantity(text.guard_norm(c), "jobs|workers|units", 1e6)
    assert column(spark, yes, f) == [True] * len(yes)
    assert column(spark, no, f) == [False] * len(no)


def serial_choice(edges):
    owner, out = set(), {}
    for claim in sorted({e[0] for e in edges}):
        for _, post in sorted((place, post) for c, _, post, place in edges if c == claim):
            if post not in owner:
                owner.add(post)
                out[claim] = post
                break
    return out


def size_of_matching(edges):
    match = {}

    def augment(claim, seen):
        for c, post in edges:
            if c == claim and post not in seen:
                seen.add(post)
                if post not in match or augment(match[post], seen):
                    match[post] = claim
                    return True
        return False

    return sum(augment(c, set()) for c in {c for c, _ in edges})


EDGES = [(c, c, (c * 7 + k * k) % 11, k) for c in range(14) for k in range(1 + c % 4)]


def test_choice_in_order(spark):
    df = spark.createDataFrame(sorted({(c, r, p): k for c, r, p, k in EDGES}.items(), key=str) and [(c, r, p, k) for (c, r, p), k in {(c, r, p): k for c, r, p, k in EDGES}.items()], "claim_id long, rank long, post_id long, place long")
    got = {r["claim_id"]: r["post_id"] for r in matching.rounds_of_choice(df, saved).collect()}
    assert got == serial_choice([tuple(r) for r in df.collect()])


def test_family_choice(spark):
    rows = [(c, c, c % 3, p, k) for (c, p), k in {(c, p): k for c, _, p, k in EDGES}.items()]
    df = spark.createDataFrame(rows, "claim_id long, rank long, family long, post_id long, place long")
    got = {r["claim_id"]: r["post_id"] for r in matching.family_choice(df, saved).collect()}
    owner, want = {}, {}
    for claim in sorted({r[0] for r in rows}):
        for _, post, family in sorted((k, p, f) for c, _, f, p, k in rows if c == claim):
            if owner.get(post, family) == family:
                owner[post] = family
                want[claim] = post
                break
    assert got == want


def test_family_choice_ends_in_few_rounds(spark):
    """Claims with the same posts on their lists: each family has its post, whatever the number of claims."""
    rows = [(c, c, c % 3, p, (p * (1 + c % 2)) % 7) for c in range(30) for p in range(1, 7)]
    tables = []
    keep = lambda df: tables.append(saved(df)) or tables[-1]
    got = {r["claim_id"]: r["post_id"] for r in matching.family_choice(spark.createDataFrame(rows, "claim_id long, rank long, family long, post_id long, place long"), keep).collect()}
    owner, want = {}, {}
    for claim in range(30):
        for _, post in sorted((k, p) for c, _, _, p, k in rows if c == claim):
            if owner.setdefault(post, claim % 3) == claim % 3:
                want[claim] = post
                break
    assert got == want and len(tables) <= 8


@pytest.mark.parametrize("edges", [sorted({(c, p) for c, _, p, _ in EDGES}), [(1, 1), (1, 2), (2, 1)], [(1, 1), (2, 1), (3, 1)], [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 1)], []])
def test_maximum_matching(spark, edges):
    got = [tuple(r) for r in matching.maximum_matching(spark.createDataFrame(edges, "claim_id long, post_id long"), saved).collect()]
    assert len(got) == size_of_matching(edges)
    assert set(got) <= set(edges)
    assert len({c for c, _ in got}) == len({p for _, p in got}) == len(got)


def test_every_quantity_of_a_clause_is_tried(spark):
    from claimspark.functions import quantities, text

    f = lambda c: quantities.bound_quantity(text.guard_norm(c), "jobs|workers|units", 1e6)
    texts = ["we lost 5 jobs and gained 3 million jobs", "jobs are 5 and units reached 2.5 million", "5 jobs, not 3 million jobs", "1 of 2 million workers in 2030", "jobs reached at most 3 million", "no numbers of jobs"]
    assert column(spark, texts, f) == [True, True, False, True, False, False]


def test_character_references(spark):
    from claimspark.functions import html

    texts = ["caf&#233; &#x41;&#X1F389; &eacute;&Aacute;&szlig;", "&amp;lt; &amp;amp;", "a & b &; &nope; &#0; &#xD800; &#1114112; &#99999999;", "&lt;b&gt;&nbsp;x&#160;y", "&", "plain", "x&hellip;"]
    assert column(spark, texts, html.decoded) == ["café A\U0001f389 éÁß", "&lt; &amp;", "a & b &; &nope; &#0; &#xD800; &#1114112; &#99999999;", "<b> x y", "&", "plain", "x…"]


def test_tracking_parameters(spark):
    from claimspark.functions import urls

    texts = ["https://a.com/p?utm_x=1&id=2&SessionId=9#top", "https://a.com/?at_medium=x", "https://a.com/?s=1&sort=2&refs=3&REF=4", "https://a.com/?token&b"]
    assert column(spark, texts, urls.normal_url) == ["https://a.com/p?id=2", "https://a.com/", "https://a.com/?sort=2&refs=3", "https://a.com/?b"]


@pytest.mark.parametrize("name", ["bound_quantity", "attribution_tags", "max_matching", "family_reuse", "top1_without_replacement"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


PAGE = """<html><head><title>T</title><meta property="og:title" content="Head &amp; line"><meta content="Jo" name="author"><link rel="canonical" href="https://www.a.example.co.uk/x?utm_source=q&id=1#f">
<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": "NewsArticle", "headline": "From graph", "publisher": {"name": "Pub"}, "author": [{"name": "Ann"}], "datePublished": "2024-02-03"}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav>menu</nav><article>%s</article><footer>foot</footer></body></html>""" % ("Words &amp; more. " * 40)


def test_article_fields(spark):
    rows = spark.createDataFrame([(1, "https://b.example.co.uk/p", PAGE), (2, "https://x.example.com/", "<h1>Only</h1><p>On 5 May 2023 it was.</p>"), (3, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r.asDict() for r in articles.articles(rows).collect()}
    one = got[1]
    assert (one["headline"], one["publisher"], one["author"], one["published"]) == ("From graph", "Pub", "Ann", "2024-02-03")
    assert one["canonical"] == "https://www.a.example.co.uk/x?id=1"
    assert got[2]["headline"] == "Only" and got[2]["published"] == "2023-05-05"
    assert got[3]["host"] is None


def test_meta_and_dates(spark):
    assert column(spark, [PAGE, "<p>", None], lambda c: html.meta(c, ["none", "author"])) == ["Jo", None, None]
    assert column(spark, ["5 May 2023", "2024-01-02 and 2024-01-02", "2024-01-02 and 2024-01-03", "no", None], lambda c: F.date_format(html.rendered_date(c), "yyyy-MM-dd")) == ["2023-05-05", "2024-01-02", None, None, None]


def test_urls(spark):
    assert column(spark, ["https://x.org/10.1000/ab.c?d", "https://x.org/"], urls.doi) == ["10.1000/ab.c", None]
    assert column(spark, ["www.bbc.co.uk", "a.b.c.com", "localhost", None], urls.registrable_host) == ["bbc.co.uk", "c.com", "localhost", None]
    assert column(spark, ["not a url?ref=1", "http://a/b?ref=1", "http://a/b?c=1&ref=2"], urls.normal_url) == ["not a url?ref=1", "http://a/b", "http://a/b?c=1"]


def test_undated_mapping_fails(spark):
    claims = spark.createDataFrame([(1,)], "claim_id long")
    mapping = spark.createDataFrame([(1, None)], "claim_id long, published_at timestamp")
    with pytest.raises(Exception, match="without a date"):
        evidence.channels(claims, mapping, F.lit("2024-01-01").cast("timestamp"), 14).collect()


def test_rounding_and_phrases(spark):
    rows = spark.createDataFrame([("2024-01-01 12:00:00",), ("2024-01-02 00:00:01",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert [tuple(r) for r in rows.select(dates.age_days(F.col("t"), as_of), dates.age_days_floor(F.col("t"), as_of), dates.hours_since(F.col("t"), as_of) > 36).collect()] == [(1, 0, False), (0, -1, False), (None, None, True)]


def test_audit_helpers():
    assert audit.agreement({"a": 1, "b": 1}) == []
    assert audit.agreement({"a": 1, "b": 2, "c": None, "d": float("nan")}) == ["c is missing", "d is not a number", "terms differ"]
    assert audit.tightened(14, 30) == 14 and audit.tightened(14, 7) == 7 and audit.tightened(14, None) == 14


def test_empty_deny_list(spark):
    df = spark.createDataFrame([("a",)], "k string")
    assert audit.denied(df, "k", []).count() == 1


def test_forecast_scan(spark, tmp_path):
    doc = {"updated": "2024", "basis": "b", "years": [{"year": 2026, "summary": "s", "events": [{"t": "one", "d": "x", "prob": 5}, {"t": "two", "d": "y", "prob": None}]}, {"year": 2027, "summary": "", "events": []}], "postSuperintelligence": {"items": [{"id": "far-off", "t": "three", "d": "z", "conditionalProb": 9}]}}
    path = tmp_path / "f.json"
    path.write_bytes(b"\xef\xbb\xbf" + json.dumps(doc).encode())
    got = {tuple(r) for r in forecasts.read_forecast(spark, str(path)).collect()}
    assert got == {("2026-0", 2026, "one", "x", 5, "file"), ("2026-1", 2026, "two", "y", None, "file"), ("horizon-far-off", 2041, "three", "z", 9, "file")}
    assert [r["origin"] for r in forecasts.read_forecast(spark, str(tmp_path / "none.json"), [(2026, "d")]).collect()] == ["default"]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):  # noqa: B017
        forecasts.read_forecast(spark, str(tmp_path / "bad.json")).collect()
    whole = spark.read.schema(forecasts.FORECAST).option("multiLine", True).json(str(path))
    assert [r["year"] for r in forecasts.well_formed_years(whole).collect()] == [2026]


def test_publish_gate(spark, tmp_path):
    table, none, one = spark.range(3), spark.range(0), spark.range(1)
    with pytest.raises(ValueError, match="not published"):
        forecasts.publish(table, one, str(tmp_path / "t"), "2024-01-01")
    assert forecasts.previous_run(spark, str(tmp_path / "t"), "id long").count() == 0
    forecasts.publish(table, none, str(tmp_path / "t"), "2024-01-01")
    forecasts.publish(spark.range(5), none, str(tmp_path / "t"), "2024-01-02")
    assert forecasts.previous_run(spark, str(tmp_path / "t"), "id long").count() == 5
    forecasts.pin_once(spark.range(2), str(tmp_path / "p"))
    assert forecasts.pin_once(spark.range(9), str(tmp_path / "p")).count() == 2
    assert forecasts.duplicates(spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "source long, claim long")).count() == 1


def test_failed_publish_leaves_the_last_output(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.range(0)
    forecasts.publish(spark.range(3), none, path, "2024-01-01")
    broken = spark.range(8).select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        forecasts.publish(broken, none, path, "2024-01-01")
    assert sorted(r.id for r in forecasts.previous_run(spark, path, "id long").collect()) == [0, 1, 2]
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["run_date=2024-01-01"]
    forecasts.publish(spark.range(5), none, path, "2024-01-01")
    assert forecasts.previous_run(spark, path, "id long").count() == 5
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["run_date=2024-01-01"]


def test_feeds(spark):
    from claimspark.operators import feeds

    say = "This is a sentence that is long enough to be quoted by anyone who reads it"
    texts = [
        (1, "<link>https://a.org/feed/of/articles.rss</link><link>https://a.org/short</link><link>https://bad.org/long/enough/path</link><LINK>\n https://a.org/article/number-one </LINK><link rel='x' href=\"https://b.org/article/number-two?utm_a=1\"/>"),
        (2, "<link>https://b.org/article/number-two</link>" * 2), (3, None), (4, "<link>ftp://a.org/article/number-one</link><link>https://a.org/article/number-one</link>"),
        (5, "".join(f"<link>https://c.org/article/number-{i}</link>" for i in range(5)) + "<link>https://b.org/article/number-two</link>"),
    ]
    captured = [("https://b.org/article/number-two", "Two", "B", "2024-01-01", f"No. {say}. And more."), ("https://a.org/article/number-one", "One", "A", None, f"{say}."), ("https://c.org/article/number-3", "", "C", "2024-01-01", f"{say}.")]
    rejected = spark.createDataFrame([("bad.org", "bad")], "host string, why string")
    found = feeds.first_articles(spark.createDataFrame(texts, "feed_id long, text string"), spark.createDataFrame(captured, "url string, headline string, publisher string, published string, text string"), rejected)
    got = {r.feed_id: (r.place, r.headline, r.sentence) for r in found.collect()}
    none = (None, None, None)
    assert got == {1: (2, "Two", f"{say}."), 2: (1, "Two", f"{say}."), 3: none, 4: none, 5: none}


def test_ledger_groups_are_bounded(spark):
    rows = spark.createDataFrame([(i % 3 // 2, i) for i in range(50)], "source long, claim long")
    groups = forecasts.ledger_groups(rows, "source", "claim", 7)
    assert max(len(r.ids) for r in groups.collect()) <= 7
    assert sorted((r.source, r.claim) for r in forecasts.mappings(groups, "source", "ids").collect()) == sorted((r.source, r.claim) for r in rows.collect())


def test_page_stream(spark, tmp_path):
    from claimspark.streaming.pages import extract_new

    spark.createDataFrame([(1, "https://b.example.com/p", PAGE)], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    extract_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_merged_terms(spark):
    rows = spark.createDataFrame([(1, True), (2, False)], "i int, head boolean")
    topic = text.plural_variants(F.lit("robots at work"))
    got = rows.orderBy("i").select(text.merged_terms(F.col("head"), F.array(F.lit("robot arms"), F.lit("banks"), F.lit("jobs")), F.array(F.lit("jobs"), F.lit("work")), topic)).collect()
    assert [r[0] for r in got] == [["robot arms", "jobs", "work"], ["jobs", "work"]]


def test_short_publisher(spark):
    assert column(spark, ["Daily | News", "Plain", None], text.short_publisher) == ["Daily", "Plain", None]


def written_by_shuffles(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_pairs_send_sets_of_a_cluster_once(spark):
    """80 sets that are all alike make 3,160 pairs; shuffles don't carry their tokens for each."""
    random.seed(6)
    word = lambda: f"{random.getrandbits(60):x}"
    core = [word() for _ in range(400)]
    rows = [(i, core + [word() for _ in range(20)]) for i in range(80)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = written_by_shuffles(spark)
    found = matching.near_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), saved).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in found} == {(a, b, 400, 420, 420) for a in range(80) for b in range(a + 1, 80)}
    assert written_by_shuffles(spark) - before < 3_000_000, written_by_shuffles(spark) - before


def test_near_pairs_in_slices(spark, monkeypatch):
    """Clusters that are dealt in slices have the same links."""
    random.seed(8)
    rows = [(i, [f"c{i % 3}w{j}" for j in range(30)] + [f"own{i}"]) for i in range(60)] + [(100 + i, random.sample([f"c{i % 3}w{j}" for j in range(30)], 27)) for i in range(20)]
    want = set()
    for (a, x), (b, y) in ((p, q) for p in rows for q in rows if p[0] < q[0]):
        x, y = set(x), set(y)
        if len(x & y) >= 0.86 * min(len(x), len(y)) or len(x & y) >= 0.72 * len(x | y):
            want.add((a, b, len(x & y), len(x), len(y)))
    assert len({frozenset(t) for _, t in rows}) == len(rows)
    monkeypatch.setattr(matching, "SLICE", 4)
    got = [tuple(r) for r in matching.near_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), saved).collect()]
    assert set(got) == want and len(got) == len(want) > 500


def test_near_pairs(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    sets = [rng.sample(words, rng.randint(1, 60)) for _ in range(60)]
    for base in list(sets[:30]):
        sets.append([w for w in base if rng.random() > 0.1] + rng.sample(words, rng.randint(0, 4)))
    whole = words[:43]
    sets += [whole, words[:36] + words[200:207], sets[3], sets[3][::-1], [], ["w"] * 5, ["w"]]  # 36 of 43 is the least that can do
    got = {tuple(r) for r in matching.near_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>"), saved).collect()}
    first, want = {}, set()
    for i, s in enumerate(map(frozenset, sets)):
        if s and s in first:
            want.add((first[s], i, len(s), len(s), len(s)))
        elif s:
            for t, j in first.items():
                n = len(s & t)
                if n >= 0.86 * min(len(s), len(t)) or n >= 0.72 * (len(s) + len(t) - n):
                    want.add((j, i, n, len(t), len(s)))
            first[s] = i
    assert got == want and len(want) > 20
    assert matching.near_pairs(spark.createDataFrame([], "id long, tokens array<string>"), saved).count() == 0


def test_age_wordings(spark):
    ages = [-2, 0, 1, 7, 8, 13, 14, 31, 45, 60, 61, 92, 93, 364, 365, 366, 400, 730, 1000, None]
    rows = spark.createDataFrame(list(enumerate(ages)), "i int, d long").orderBy("i")
    d = F.col("d")
    got = rows.select(dates.age_phrase(d), dates.age_on_card(d), dates.age_in_context(d)).collect()
    said = {a: tuple(r) for a, r in zip(ages, got, strict=True)}
    assert said[-2] == ("published today", "today", "-2 days old") and said[1][:2] == ("published yesterday", "today")
    assert said[7][1] == "7 days ago" and said[8][1] == "this fortnight" and said[31][1] == "this month" and said[92] == ("published 3 months ago", "this quarter", "92 days old")
    assert said[13][0] == "published 13 days ago" and said[14][0] == "published 2 weeks ago" and said[60][0] == "published 9 weeks ago" and said[61][0] == "published 2 months ago"
    assert said[45][1] == "this quarter" and said[93] == ("published 3 months ago", "3 months ago", "3 months old")
    assert said[365] == ("published 1 year ago", "12 months ago", "12 months old") and said[366][2] == "1.0 years old" and said[400][0] == "published 1.1 years ago"
    assert said[730][0] == "published 2 years ago" and said[1000][2] == "2.7 years old" and said[None] == (None, "", None)


def test_timing(spark):
    rows = spark.createDataFrame([(2026, 5, 1, "month"), (2027, 6, 3, "quarter"), (2029, 7, None, "half"), (2033, 8, 12, "year"), (2033, 13, 1, "month"), (2033, None, 1, "month")], "y int, m int, b long, p string")
    y, m, b = F.col("y"), F.col("m"), F.col("b")
    got = [tuple(map(str, r)) for r in rows.select(dates.timing_label(y, m, F.col("p")), dates.band_text(b), dates.window_end(y, m, b)).collect()]
    assert got == [("May 2026", "±1 month", "2026-06-30"), ("Q2 2027", "±3 months", "2027-09-30"), ("H2 2029", "", "2029-07-31"), ("Mid 2033", "±12 months", "2034-08-31"), ("None", "±1 month", "None"), ("None", "±1 month", "None")]


def test_expiry_instants_agree_with_rounded_ages(spark):
    rows = spark.range(0, 400).select((F.col("id") * F.lit(21_600_000_000)).alias("age"))  # steps of six hours
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ts = F.timestamp_micros(F.unix_micros(as_of) - F.col("age"))
    days = F.col("age") / dates.DAY_MICROS
    by = {"round": F.floor(days + 0.5), "floor": F.floor(days), "ceil": F.ceil(days)}
    for rule in dates.EXPIRY_OFFSETS:
        age = by[rule.rstrip(">=")]
        past = age >= 14 if rule.endswith("=") else age > 14
        assert rows.where(dates.expired(dates.expires_at(ts, 14, rule), as_of, rule) != past).isEmpty(), rule


def test_attempts(spark):
    log = [
        ("a", 1, False, None, 503, None, None), ("a", 2, True, False, 200, None, None), ("a", 3, False, None, 404, None, None),
        ("b", 1, False, None, 429, None, None), ("b", 2, False, None, 410, None, None), ("b", 3, False, None, None, "ETIMEDOUT", None),
        ("c", 1, False, None, None, "ENOTFOUND", None), ("d", 1, False, None, None, "EAI_AGAIN", "getaddrinfo ENOTFOUND d"), ("e", 1, False, None, None, None, "getaddrinfo ENOTFOUND e"),
        ("f", 1, False, None, 403, None, "ENOTFOUND"), ("f", 2, True, True, 200, None, None), ("g", 1, None, None, None, None, None),
    ]
    rows = spark.createDataFrame(log, "source string, n int, ok boolean, challenged boolean, status int, code string, reason string")
    kind = audit.attempt_kind(*(F.col(c) for c in ("ok", "challenged", "status", "code", "reason")))
    got = {tuple(r) for r in audit.attempt_outcomes(rows, ["source"], F.col("n"), kind).collect()}
    assert got == {
        ("a", "read", "none", 2, 3), ("b", "gone", "evidence", 2, 3), ("c", "dns", "evidence", 1, 1), ("d", "network", "infrastructure", 1, 1), ("e", "dns", "evidence", 1, 1),
        ("f", "challenge", "infrastructure", 2, 2), ("g", "network", "infrastructure", 1, 1),
    }


def test_pivot(spark):
    rows = spark.createDataFrame([(1, 2030, "automation career"), (1, 2029, "career"), (1, 2031, "career with meaning"), (1, 2032, "career"), (2, 2040, "career"), (1, 2033, None)], "g int, year int, text string")
    has = lambda w: F.contains("text", F.lit(w))
    year = lambda strictly: sorted(r.year for r in audit.after_pivot(rows, ["g"], F.col("year"), has("automation"), has("career"), has("meaning"), strictly).collect())
    assert year(False) == [2030, 2032] and year(True) == [2032]


def test_one_of_each(spark):
    rows = [(1, "like", None, 1), (1, "post", None, 2), (1, "post", None, 3), (2, "post", 2, 4), (2, "repost", 20, 5), (2, "repost", 21, 6), (3, "repost", 3, 7), (3, "bookmark", None, 8), (4, "other", None, 9), (4, "bookmark", None, 10), (5, None, None, 11)]
    df = spark.createDataFrame(rows, "post long, kind string, activity long, n long")
    got = {r.post: r.n for r in views.one_of_each(df, ["post"], F.col("kind"), F.col("post"), F.col("activity"), F.col("n")).collect()}
    assert got == {1: 2, 2: 5, 3: 7, 4: 10, 5: 11}


def test_candidate_order(spark):
    rows = [(1, False, 3, 1.0, 9.0, 9.0, 4, 9), (2, True, 0, None, 0.0, 0.0, 0, 0), (3, False, 3, 1.0, 9.0, 9.0, 4, 9), (4, False, 3, 1.0, None, 99.0, 4, 9), (5, False, 3, 2.0, 0.0, 0.0, 0, 0), (6, False, 3, 1.0, 9.0, 9.0, 4, 10)]
    df = spark.createDataFrame([(0, *r) for r in rows], "claim int, id int, direct boolean, authorship int, coverage double, concepts double, score double, recency int, created int")
    order = views.candidate_order(*(F.col(c) for c in ("direct", "authorship", "coverage", "concepts", "score", "recency", "created", "id")))
    assert [r.id for r in views.ranked(df, "claim", order).orderBy("place").collect()] == [2, 5, 6, 1, 3, 4]


def test_gate_and_redirects(spark):
    pages = [
        (1, "https://a.example.com/x"), (2, "https://news.bad.com/x"), (3, "https://amp.example.com/x"), (4, "https://example.com/amp/x"), (5, "https://example.com/"), (6, "ftp://example.com/x"), (7, "none"), (8, None),
        (9, "https://m.facebook.com/x"), (10, "https://m.example.com/x"), (11, "https://webcache.example.com/x"), (12, "https://translate.example.com/x"), (13, "https://example.com/amplify"), (14, "HTTP://notbad.com/x"),
    ]
    rejected = spark.createDataFrame([("bad.com", "farm")], "host string, why string")
    gate = articles.host_gate(spark.createDataFrame(pages, "page_id long, url string"), rejected)
    got = {r.page_id: r.reason for r in gate.collect()}
    assert got == {1: None, 2: "farm", 3: "AMP mirror", 4: "AMP rendition", 5: "site root", 6: "protocol", 7: "unparsable", 8: "unparsable", 9: "social platform", 10: None, 11: "cache mirror", 12: "translation proxy", 13: None, 14: None}
    assert all(r.ok == (r.reason is None) for r in gate.collect())
    edges = spark.createDataFrame([(1, 10), (10, 2), (2, 13), (13, 14), (14, 13), *((k, k + 1) for k in range(20, 30))], "src long, dst long")
    nodes = gate.where("not ok").selectExpr("page_id as node", "reason as why")
    got = {tuple(r) for r in articles.redirects(edges, spark.createDataFrame([(1,), (2,), (13,), (20,), (24,), (99,)], "start long"), rejected=nodes).collect()}
    assert got == {(1, 2, 2, "rejected: farm"), (2, 2, 0, "rejected: farm"), (13, 14, 1, "loop"), (20, 26, 6, "too many hops"), (24, 30, 6, None), (99, 99, 0, None)}


def test_override(spark):
    candidates = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "claim_id long, post_id long")
    approvals = spark.createDataFrame([(1, 100, 10), (2, 200, 21), (4, 400, 40), (5, 500, 50), (1, 110, 11)], "claim_id long, activity_id long, post_id long")
    entries = spark.createDataFrame([(100, 10), (110, 11), (200, 20), (400, 40), (400, 40)], "activity_id long, post_id long")
    assert {tuple(r) for r in evidence.reviewed_override(candidates, approvals, entries).collect()} == {(1, 10, 1), (2, None, 1), (3, None, 1), (4, 40, 0)}


def test_ledger(spark):
    mappings = [(1, "a", "t", "r", "d", "f", "d"), (2, "a", "t", "r", "d", "g", "d"), (3, "b", None, "", "d", "f", "d"), (4, "none", None, None, None, None, None), (5, "b", "t", "r", "d", None, "d")]
    sources = [("a", "https://x.example.com/p", "example.com", "good", None), ("b", "https://x.example.com/p", "example.org", "poor", "fax"), ("c", None, None, None, "Browser")]
    got = evidence.ledger_problems(
        spark.createDataFrame(mappings, "claim_id long, source string, evidence_type string, rationale string, reviewed_at string, reuse_family string, verified_at string"), spark.createDataFrame(sources, "source string, url string, publisher_host string, quality string, transport string"),
        spark.createDataFrame([(i,) for i in (1, 3, 4, 5)], "claim_id long"), spark.createDataFrame([(1,), (1,)], "claim_id long"), spark.createDataFrame([], "host string, why string"), 1, ["t"], ["good"], ["https", "browser"],
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted([
        ("displaces a reviewed one", "1"), ("unknown claim", "2"), ("bad type", "3"), ("incomplete", "3"), ("unknown source", "4"), ("incomplete", "5"), ("over ceiling", "a"), ("mixed families", "a"),
        ("bad quality", "b"), ("bad transport", "b"), ("host differs", "b"), ("over ceiling", "b"), ("mixed families", "b"), ("unused", "c"), ("bad quality", "c"), ("gated host", "c"),
    ])


def test_scan_of_hosts(spark):
    files = spark.createDataFrame([("a.js", "x https://API.example.com/p http://b.org, https://api.example.com"), ("b.js", None), ("c.js", "no host")], "name string, text string")
    named = audit.hosts_named(files, "name", "text")
    assert {tuple(r) for r in named.collect()} == {("a.js", "api.example.com", 2), ("a.js", "b.org", 1)}
    assert audit.scan_faults(files, named).isEmpty()
    assert {r.rule for r in audit.scan_faults(files.limit(0), named.limit(0)).collect()} == {"no files read", "no hosts found"}
    got = {(r.host, r.verdict, r.why) for r in audit.host_verdicts(named, {"b.org": "closed"}, ["b.org", "c.org"]).collect()}
    assert got == {("api.example.com", "undeclared", None), ("b.org", "retired", "closed")}


def test_excused_links(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 9)], "a long, b long")
    marks = spark.createDataFrame([(1, 1, None), (2, 2, "x"), (3, None, "y"), (4, 1, "y")], "id long, level long, branch string")
    assert {(r.a, r.b): r.excused for r in matching.excused(links, marks).collect()} == {(1, 2): True, (2, 3): True, (3, 4): False, (1, 4): False, (4, 9): False}
