"""Matching of texts to claims beside plain loops over all pairs."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from claimspark.operators import guards, matching, relevance
from claimspark.operators.guards import Guard
from claimspark.operators.tables import numbered, saved
from claimspark.plans import matching as plan

CLAIMS = [(1, "Warehouse robots replacing forklift drivers"), (2, "Regulators approve sensors for trucks"), (3, ""), (4, None), (5, "Forklift drivers")]
POSTS = [
    (10, "Warehouse robots replacing forklift drivers already", 5), (11, "The robot and its driver; replacings of a warehouses' forklift-drivers", 5), (12, "sensor truck", 5), (13, "Regulatorship approves sensors", 40),
    (14, "Nothing of this", 5), (15, "", 5), (16, None, 5), (17, "robots robots robots", 90), (18, "forklift drivership", 5), (19, "forklifts and a regulator approve warehouse robotics", 31), (20, "replacing warehouse", 2),
]
CURATED = [(1, "autonomous forklift fleet", "phrase"), (1, "forklift", "strong"), (1, "warehouse", "weak"), (1, "quantum", "strong"), (2, "regulator", "strong"), (9, "nobody", "strong")]
VOCABULARY = "warehouse robots forklift driver drivers replacing sensor sensors regulators approve trucks because quantum fleet autonomous of the".split()


def norm(text):
    return " ".join(re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split())


def plain_score(post, terms, domain):
    n = f" {norm(post)} "
    one = lambda w: f" {w} " in n
    held = {"phrase": lambda w: f" {w}" in n, "strong": lambda w: f" {w}" in n, "single": lambda w: one(w) or one(w + "s") or (w.endswith("s") and one(w[:-1])), "weak": one}
    hits = [(t, k) for t, k in terms if held[k](t)]
    specific = [t for t, k in hits if k == "single" and len(t) >= 7 and t not in relevance.SOFT and t not in domain]
    firm = [t for t, k in hits if k == "strong" or k == "single" and t in domain]
    n_phrases = sum(k == "phrase" for _, k in hits)
    words = {t[:-1] if len(t) > 4 and t.endswith("s") else t for t in [*specific, *firm]}
    return sum(relevance.POINTS[k] for _, k in hits), n_phrases + len(firm) + (len(specific) >= 2), len(hits), len(words) + 2 * n_phrases


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(6)
    posts = POSTS + [(100 + i, " ".join(random.choice(VOCABULARY) for _ in range(random.randrange(1, 12))), i % 60) for i in range(120)]
    claims = CLAIMS + [(50 + i, " ".join(random.choice(VOCABULARY) for _ in range(5))) for i in range(12)]
    return claims, posts, spark.createDataFrame(claims, "claim_id long, title string"), spark.createDataFrame(posts, "post_id long, text string, age int")


@pytest.mark.parametrize("domain", [[], ["sensors", "trucks"]])
def test_only_qualifying_pairs(spark, tables, domain):
    _, posts, claims_df, posts_df = tables
    terms_df = relevance.claim_terms(claims_df, spark.createDataFrame(CURATED, "claim_id long, term string, kind string"))
    terms = {}
    for r in terms_df.collect():
        terms.setdefault(r.claim_id, []).append((r.term, r.kind))
    assert ("forklift", "strong") in terms[1] and ("quantum", "strong") not in terms[1] and ("autonomous forklift fleet", "phrase") in terms[1]
    want = {(c, p, *s) for c, ts in terms.items() for p, text, _ in posts if (s := plain_score(text, ts, domain))[0] >= 2 and s[1] >= 1}
    got = [tuple(r) for r in relevance.lexical_pairs(terms_df, posts_df, saved, domain).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_pairs_of_one_specific_word_are_not_made(spark):
    claims = spark.createDataFrame([(1, "replacing warehouses")], "claim_id long, title string")
    posts = spark.createDataFrame([(i, "replacing") for i in range(50)] + [(99, "warehouse of replacing")], "post_id long, text string")
    terms = relevance.claim_terms(claims).where("kind = 'single'")
    assert [r.post_id for r in relevance.lexical_pairs(terms, posts, saved).collect()] == [99]


@pytest.mark.parametrize("domain", [[], ["sensors", "trucks"]])
def test_all_pairs_that_share_a_term(spark, tables, domain):
    _, posts, claims_df, posts_df = tables
    curated = [*CURATED, (1, "robots replacing forklift", "weak"), (2, "sensor trucks", "single"), (2, "approve sensors trucks", "phrase")]
    terms_df = relevance.claim_terms(claims_df).union(spark.createDataFrame(curated, "claim_id long, term string, kind string"))
    terms = {}
    for r in terms_df.distinct().collect():
        terms.setdefault(r.claim_id, []).append((r.term, r.kind))
    want = {(c, p, *s) for c, ts in terms.items() for p, text, _ in posts if (s := plain_score(text, ts, domain))[2]}
    got = [tuple(r) for r in relevance.all_pairs(terms_df, posts_df, saved, domain).collect()]
    assert set(got) == want and len(got) == len(want) and sum(x[2] < 2 or x[3] < 1 for x in want) > 100


def test_lexical_match_gives_pairs_below_the_bar(spark):
    claims = spark.createDataFrame([(1, "that station replacing warehouses")], "item_id long, text string")
    posts = spark.createDataFrame([(1, "station"), (2, "replacing"), (3, "replacing warehouse"), (4, "nothing")], "doc_id long, text string")
    assert {r.post_id: (r.score, r.solid) for r in plan.lexical_match({"benchmark": claims, "documents": posts}.__getitem__).collect()} == {1: (2, 0), 2: (2, 1), 3: (2, 1)}


ONTOLOGY = [("labour", 1.5, False), ("machines", 1.5, False), ("law", 1.0, False), ("depot", 1.0, True)]
RULES = [Guard(r"\brobots\b", ("all", (r"\brobot", ("any", (r"\bdriver", r"\bwarehouse\b"))))), Guard("sensors", ("none", ("regulator",)), ("law",)), Guard("fleet", ("fact", "fleet"))]


def plain_passes(title, domain, text, facts, rules=RULES):
    def holds(t):
        if isinstance(t, str):
            return bool(re.search(t, norm(text)))
        kind, parts = t
        return parts in facts if kind == "fact" else {"all": all, "any": any, "none": lambda x: not any(x)}[kind](list(map(holds, parts)))

    return all(holds(g.tree) for g in rules if re.search(g.selector, norm(title)) and (g.domains is None or domain in g.domains))


def test_matches_beside_all_pairs(spark, tables):
    claims, posts, _, _ = tables
    random.seed(1)
    tags = lambda: random.choice((None, [], random.sample([t for t, *_ in ONTOLOGY] + ["unknown"], random.randrange(1, 4))))
    cs = [(c, title, random.choice(("law", "work", None)), tags()) for c, title in claims]
    ps = [(p, text, age, tags(), random.choice((None, ["fleet"]))) for p, text, age in posts]
    cdf = spark.createDataFrame(cs, "claim_id long, title string, domain string, tags array<string>")
    pdf = spark.createDataFrame(ps, "post_id long, text string, age int, tags array<string>, facts array<string>")
    terms_df = relevance.claim_terms(cdf)
    terms = {}
    for r in terms_df.collect():
        terms.setdefault(r.claim_id, []).append((r.term, r.kind))
    weight, solo = {t: w for t, w, _ in ONTOLOGY}, {t for t, _, s in ONTOLOGY if s}
    want = set()
    for (c, title, domain, ct), (p, text, age, pt, facts) in product(cs, ps):
        score, solid, hits, coverage = plain_score(text, terms.get(c, []), [])
        shared = set(ct or ()) & set(pt or ()) & weight.keys()
        total = sum(weight[t] for t in shared)
        semantic = bool(shared & solo) or (sum(weight[t] >= 1.5 for t in shared) >= 2 and total >= 2.5)
        lexical = score >= 2 and solid >= 1
        if lexical or (semantic and age <= 30):
            method = "hybrid" if lexical and semantic else "lexical" if lexical else "semantic"
            own = (score, solid, hits, coverage) if lexical else (0, 0, 0, 0)
            want.add((c, p, *own[:3], own[3] + len(shared), total, method, None if plain_passes(title, domain, text, facts or ()) else "facet"))
    ontology = spark.createDataFrame(ONTOLOGY, "tag string, weight double, solo boolean")
    found = saved(relevance.matches(relevance.lexical_pairs(terms_df, pdf, saved), cdf, pdf, ontology, RULES, saved))
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert {x[-2:] for x in want} >= {("hybrid", None), ("lexical", "facet"), ("semantic", None), ("semantic", "facet")}
    counts = {r.claim_id: r for r in relevance.relevance_rejections(found, cdf, pdf).collect()}
    assert all(r.considered == len(ps) == r.relevance + r.facet + r.accepted for r in counts.values()) and counts.keys() == {c for c, *_ in cs}
    assert sum(r.facet for r in counts.values()) == sum(x[-1] == "facet" for x in want)


def sent_to_all_tasks(df):
    """Scans of written rows of posts below the plan's broadcasts."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        depth = None if depth is not None and at <= depth else depth
        if "BroadcastExchange" in line:
            depth = at if depth is None else depth
        elif depth is not None and "FileScan" in line and "post_id#" in line:
            found.append(line.strip())
    return found


def rows_in_few_bytes(spark, n=200_000):
    return saved(spark.range(n).select((F.col("id") % 4 + 1).alias("claim_id"), F.floor(F.col("id") / 4).alias("post_id")))


def test_pairs_of_few_bytes_are_not_broadcast(spark):
    """200,000 pairs take less than 1 MB in a file, so their size alone would have them sent to all tasks."""
    claims = spark.createDataFrame([(c, "trucks", "law", ["labour", "machines"]) for c in range(1, 5)], "claim_id long, title string, domain string, tags array<string>")
    pairs = rows_in_few_bytes(spark)
    posts = spark.range(50_000).select(F.col("id").alias("post_id"), F.lit("a truck").alias("text"), F.lit(5).alias("age"), F.array(F.lit("labour"), F.lit("machines")).alias("tags"))
    rules, ontology = [Guard("truck", "truck")], spark.createDataFrame(ONTOLOGY, "tag string, weight double, solo boolean")
    passed = guards.guarded(pairs, claims, posts, rules)
    assert not sent_to_all_tasks(passed) and passed.where("passes").count() == 200_000
    nil = [F.lit(2).cast("long").alias(x) for x in ("score", "solid", "hits", "coverage")]
    plans = []
    keep = lambda df: plans.append(df) or saved(df)
    matched = saved(relevance.matches(saved(pairs.where("post_id % 2 = 0").select("*", *nil)), claims, posts, ontology, rules, keep))
    assert matched.count() == 200_000 and not [x for df in plans for x in sent_to_all_tasks(df)]
    ranked = saved(matched.where("post_id < 3").select("claim_id", "post_id", (F.col("post_id") + 1).alias("place")))
    report = relevance.run_report(matched, ranked, ranked.where("place = 1 and claim_id = 1").select("claim_id", "post_id"), claims, posts)
    assert not sent_to_all_tasks(report.select("claim_id", "outcome", "best", "chosen_method")) and {r.outcome for r in report.collect()} == {"chosen", "crowded out"}


def test_members_of_families_are_not_broadcast(spark):
    claims = spark.createDataFrame([(c, "trucks", "law", "a") for c in range(1, 5)], "claim_id long, title string, domain string, family string")
    posts = spark.range(50_000).select(F.col("id").alias("post_id"), F.lit("a robot").alias("text"), F.array(F.lit("labour"), F.lit("law")).alias("tags"))
    fdf = spark.createDataFrame(FAMILIES, "family string, all array<string>, any array<string>, core string, match boolean")
    plans = []
    keep = lambda df: plans.append(df) or saved(df)
    out = relevance.family_matches(fdf, claims, posts, spark.createDataFrame([("labour", 1.5)], "tag string, weight double"), [Guard("truck", "truck")], keep)
    assert not [x for df in (*plans, out) for x in sent_to_all_tasks(df)]
    assert {tuple(r) for r in out.select("coverage", "concept_score", "reason").distinct().collect()} == {(2, 2.5, "facet")} and out.count() == 200_000


def test_guards(spark):
    rules = [Guard("robot", ("all", ("robot", "driver"))), Guard("truck", "truck", ("law",))]
    claims = spark.createDataFrame([(1, "Robots, Drivers", "work"), (2, "trucks", "law"), (3, "trucks", "work"), (4, None, None)], "claim_id long, title string, domain string")
    posts = spark.createDataFrame([(1, "ROBOT and Driver"), (2, "robot"), (3, "a truck"), (4, None)], "post_id long, text string")
    pairs = spark.createDataFrame([(c, p) for c in (1, 2, 3, 4) for p in (1, 2, 3, 4)], "claim_id long, post_id long")
    got = {(r.claim_id, r.post_id) for r in guards.guarded(pairs, claims, posts, rules).where("passes").collect()}
    assert got == {(1, 1), (2, 3), *((c, p) for c in (3, 4) for p in (1, 2, 3, 4))}
    table = spark.createDataFrame([("robot", None, ["robot", "driver"], None, None), ("truck", ["law"], ["truck"], ["truck", "lorry"], ["ship"])], "selector string, domains array<string>, all array<string>, any array<string>, none array<string>")
    assert {(r.claim_id, r.post_id) for r in guards.guarded(pairs, claims, posts, guards.from_table(table)).where("passes").collect()} == got
    for broken in ([], [Guard("x", ("all", ()))], [Guard("x", "")], [Guard("x", ("any", ("a", ("none", ()))))], [Guard("x", ("maybe", ("a",)))], [Guard("(", "a")], [Guard("a", "[")]):
        with pytest.raises((ValueError, re.error)):
            guards.guarded(pairs, claims, posts, broken)
    for rows in ([], [("robot", None, [], None, None)], [("robot", None, None, None, None)]):
        with pytest.raises(ValueError):
            guards.from_table(spark.createDataFrame(rows, table.schema))


def test_anchors_call_for_every_pattern_that_matches():
    """Texts built from each pattern's own words: what the automaton leaves out never matches."""
    patterns = [r"\b(?:audit|audits|auditable|transparen\w*)\b", r"\b(?:one|two) (?:third|half)\b", r"a.*b", r"[0-9]+ percent", r"(?:x|y)?z+", r"\bai\b.{0,20}\brobots?\b", r"^start|end$", r"\d+", r"(?:ab)+c", r"colou?r"]
    assert guards.anchors(patterns[0]) == {"audit", "audits", "auditable", "transparen"} and guards.anchors(r"\d+") is None and guards.anchors(r"(?:x|\d)") is None
    random.seed(2)
    compiled = guards.Patterns(patterns)
    automaton, words = compiled.automaton(), "audit transparency one third two half a b 50 percent z xz ai robot start end ababc color colour abc".split()
    for _ in range(400):
        text = " ".join(random.choices(words, k=random.randrange(0, 6)))
        assert compiled.hits(automaton, text) == {i for i, p in enumerate(patterns) if re.search(p, text)}


FAMILIES = [("a", ["labour"], ["law", "depot"], r"\brobot", True), ("b", [], ["law"], None, True), ("c", ["labour", "machines"], [], None, True), ("d", None, None, "driver", True), ("e", ["law"], None, None, False), ("f", ["nothing"], None, None, True)]


def test_families(spark, tables):
    claims, posts, _, _ = tables
    random.seed(3)
    ps = [(p, text, random.choice((None, random.sample(["labour", "machines", "law", "depot"], random.randrange(0, 5))))) for p, text, _ in posts]
    cs = [(c, title, "law", FAMILIES[i % 6][0]) for i, (c, title) in enumerate(claims)]
    pdf = spark.createDataFrame(ps, "post_id long, text string, tags array<string>")
    cdf = spark.createDataFrame(cs, "claim_id long, title string, domain string, family string")
    fdf = spark.createDataFrame(FAMILIES, "family string, all array<string>, any array<string>, core string, match boolean")
    ontology = spark.createDataFrame([("labour", 1.5), ("law", 0.5)], "tag string, weight double")
    weight, reasons, members = {"labour": 1.5, "law": 0.5}, {}, {}
    for (name, all_, any_, core, match), (p, text, tags) in product(FAMILIES, ps):
        held = set(tags or ())
        step = "family-match-not-declared" if not match else "family-required-concept" if set(all_ or ()) - held else "family-corroboration" if any_ and not set(any_) & held else "family-core-facet" if core and not re.search(core, norm(text)) else None
        if step:
            reasons[name, step] = reasons.get((name, step), 0) + 1
        else:
            taken = held & (set(all_ or ()) | set(any_ or ()))
            members[name, p] = (len(taken), sum(weight.get(t, 1) for t in taken))
    want = {(c, p, *members[f, p], None if plain_passes(title, d, text, ()) else "facet") for c, title, d, f in cs for p, text, _ in ps if (f, p) in members}
    got = [tuple(r) for r in relevance.family_matches(fdf, cdf, pdf, ontology, RULES, saved).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    counted = {(r.family, r.reason): r.n for r in relevance.family_rejections(fdf, pdf, saved).collect() if r.n}
    assert counted == reasons and {r for _, r in reasons} == {"family-match-not-declared", "family-required-concept", "family-corroboration", "family-core-facet"}


def test_subjects(spark):
    subjects = [(1, "Forklift fleet"), (1, "forklift fleet!"), (1, "robots"), (1, "AI model"), (2, "autonomous forklift fleet"), (2, "fleet"), (3, None), (3, "robot"), (4, "of the")]
    posts = [(1, "Forklift fleets", "An autonomous forklift fleet"), (2, None, "robots, an AI model"), (3, "robot", None), (4, None, None), (5, "fleet fork", "lift fleet forklift"), (6, "probots", "of the fleet")]
    banned = ["ai", "model", "of"]
    want = {}
    for (c, s), (p, title, body) in product({(c, norm(s)) for c, s in subjects if norm(s)}, posts):
        t, n = f" {norm(title)} ", f" {norm(f'{title or str()} {body or str()}')} "
        if set(s.split()) - set(banned) and f" {s}" in n:
            k = len(s.split())
            score, found = want.get((c, p), (0, 0))
            want[c, p] = (score + (4 + k if k > 1 else 3) * (2 if f" {s}" in t else 1), found + 1)
    got = relevance.subject_scores(spark.createDataFrame(subjects, "claim_id long, subject string"), spark.createDataFrame(posts, "post_id long, title string, body string"), banned, saved)
    assert {(r.claim_id, r.post_id): (r.score, r.n_subjects) for r in got.collect()} == want and len(want) > 6


def test_subjects_do_not_cross_the_first_line(spark):
    """The end of the first line and its beginning are no neighbours; its end and the second line are."""
    docs = [(1, "autonomous forklift\nwarehouse", 0), (2, "forklift autonomous", 0), (3, "the autonomous\nforklift", 0), (4, "warehouse\n", 0), (5, "\nwarehouse", 0), (6, None, 0), (7, "", 0)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string, x int"), "benchmark": spark.createDataFrame([(1, "Autonomous forklift warehouse")], "item_id long, text string")}
    got = {(r.post_id, r.score, r.n_subjects) for r in plan.subject_score(tables.get).collect()}
    assert got == {(1, 2 * 6 + 6 + 3 + 2 * 3, 4), (2, 2 * 3, 1), (3, 6 + 2 * 3, 2), (4, 2 * 3, 1), (5, 3, 1)}


def test_allocation_order(spark):
    random.seed(5)
    claims = [(c, random.choice((2026, 2027, None)), random.randrange(3)) for c in range(60)]
    cands = [(c, p, p + 1, *(random.choice((None, 0, 1, 2)) for _ in range(3))) for c in range(50) for p in range(random.randrange(0, 4))]
    by = {}
    for c, p, k, a, b, s in cands:
        by.setdefault(c, []).append((k, a or 0, b or 0, s or 0))
    key = lambda c: (len(by.get(c[0], [])), *(-v for v in (min(by[c[0]])[1:] if c[0] in by else (0, 0, 0))), c[1] is not None, c[1] or 0, c[2], c[0])
    want = {c[0]: (len(by.get(c[0], [])), i + 1) for i, c in enumerate(sorted(claims, key=key))}
    got = matching.allocation_order(spark.createDataFrame(claims, "claim_id long, year int, place int"), spark.createDataFrame([(c, p, k, a, None if b is None else float(b), s) for c, p, k, a, b, s in cands], "claim_id long, post_id long, place int, coverage int, concept_score double, score int"))
    assert {r.claim_id: (r.n_candidates, r.rank) for r in got.collect()} == want


def test_numbers_of_a_global_order(spark):
    random.seed(7)
    rows = [(random.choice((None, *range(5))), i, random.getrandbits(60)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, x long").repartition(7)
    got = {r.i: (r.number, r.px) for r in numbered(df, "k", "i", running={"px": "x"}).collect()}
    run, want = 0, {}
    for n, (_, i, x) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        run ^= x
        want[i] = (n + 1, run)
    assert got == want
    assert numbered(df.limit(0), "k", running={"px": "x"}).count() == 0


def test_usage(spark):
    candidates = spark.createDataFrame([(c, p) for c in range(3) for p in range(c, 40)], "claim_id long, post_id long")
    chosen = spark.createDataFrame([(0, 5), (1, 39)], "claim_id long, post_id long")
    posts = spark.createDataFrame([(p, p) for p in range(60)], "post_id long, age int")
    row = relevance.usage(candidates, chosen, spark.range(5).select("id").withColumnRenamed("id", "claim_id"), posts).first()
    assert (row.relevant, row.used, row.week_relevant, row.week_used, row.unused, row.claims_with, row.unmatched) == (40, 2, 8, 1, 38, 3, 1)
    assert row.unused_samples == [p for p in range(21) if p != 5]
