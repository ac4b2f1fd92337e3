"""Queries that match text to claims. Claims are benchmark items and posts are documents, as FIXTURES.md binds them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.functions import quantities as Q
from claimspark.functions import text as T
from claimspark.operators import matching as M
from claimspark.operators import relevance as R
from claimspark.operators.guards import Guard, guarded
from claimspark.operators.tables import large, saved

from .registry import query
from .texts import CONCEPTS, FIRST, NORM, STOP, TERM, UNLESS, WORDS, _tag_sql, sample

CLAIM_TERMS = f"""c0 AS (SELECT item_id, {WORDS.format('text')} AS ws FROM benchmark), c1 AS (SELECT item_id, ws, list_filter(ws, lambda w: {TERM}) AS ok FROM c0),
c2 AS (SELECT item_id, list_slice({FIRST.format('ok')}, 1, 12) AS terms, list_filter(list_transform(range(1, len(ws)), lambda i: CASE WHEN list_contains(ok, ws[i]) AND list_contains(ok, ws[i + 1]) THEN ws[i] || ' ' || ws[i + 1] END), lambda p: p IS NOT NULL) AS ps FROM c1),
terms AS (SELECT item_id AS claim_id, unnest(list_slice({FIRST.format('ps')}, 1, 6)) AS term, 'phrase' AS kind, 3 AS points FROM c2 UNION ALL SELECT item_id, unnest(list_filter(terms, lambda w: length(w) >= 9)), 'strong', 2 FROM c2
 UNION ALL SELECT item_id, unnest(list_filter(terms, lambda w: length(w) BETWEEN 6 AND 8)), 'single', 2 FROM c2 UNION ALL SELECT item_id, unnest(list_slice(list_filter(terms, lambda w: length(w) < 6), 1, 6)), 'weak', 1 FROM c2)"""
DOMAIN = ["section", "number", "message"]
ABLE = f"length(term) >= {R.SPECIFIC} AND term NOT IN ({', '.join(f"'{w}'" for w in R.SOFT)})"
SCORES = f"""{CLAIM_TERMS}, d0 AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents), held AS (SELECT DISTINCT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS token FROM d0),
met AS (SELECT DISTINCT claim_id, doc_id AS post_id, term, kind, points, term IN ({', '.join(f"'{w}'" for w in DOMAIN)}) AS dom FROM held JOIN terms ON left(token, 4) = left(term, 4) AND CASE kind WHEN 'weak' THEN token = term WHEN 'single' THEN token = term OR token = term || 's' OR (term LIKE '%s' AND token = left(term, -1)) WHEN 'strong' THEN starts_with(token, term) AND NOT contains(token, ' ') ELSE starts_with(token, term) END),
flagged AS (SELECT *, kind = 'single' AND NOT dom AND {ABLE} AS specific, CASE WHEN length(term) > 4 AND term LIKE '%s' THEN left(term, -1) ELSE term END AS base FROM met),
summed AS (SELECT claim_id, post_id, CAST(sum(points) AS BIGINT) AS score, CAST(count(*) FILTER (kind IN ('phrase', 'strong') OR kind = 'single' AND dom) + CASE WHEN count(*) FILTER (specific) >= 2 THEN 1 ELSE 0 END AS BIGINT) AS solid, count(*) AS hits,
 count(DISTINCT base) FILTER (kind = 'strong' OR kind = 'single' AND dom OR specific) + 2 * count(*) FILTER (kind = 'phrase') AS coverage FROM flagged GROUP BY 1, 2),
scores AS (SELECT * FROM summed WHERE score >= {R.MIN_SCORE} AND solid >= 1)"""


def claims(t):
    return t("benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("title"))


def posts(t):
    return t("documents").select(F.col("doc_id").alias("post_id"), "text")


def terms(t):
    """A title's pairs of terms, and as what was curated for it, its words by their length: strong, single or weak."""
    found, pairs, title = T.terms(F.col("title")), T.bigrams(F.col("title")), claims(t)
    of = lambda low, high: F.filter(found, lambda w: (F.length(w) >= low) & (F.length(w) < high))
    part = lambda c, kind: F.transform(c, lambda w: F.struct(w.alias("term"), F.lit(kind).alias("kind")))
    kinds = part(pairs, "phrase"), part(of(9, 1 << 30), "strong"), part(of(6, 9), "single"), part(F.slice(of(0, 6), 1, 6), "weak")
    return title.select("claim_id", F.explode(F.concat(*kinds)).alias("x")).select("claim_id", "x.*")


def scores(t):
    return R.lexical_pairs(terms(t), posts(t), saved, DOMAIN)


@query(f"WITH {SCORES} SELECT claim_id, post_id, score, solid, hits, coverage FROM summed")
def lexical_match(t):
    """All pairs that share a term; what follows from them takes those of scores()."""
    return R.all_pairs(terms(t), posts(t), saved, DOMAIN)


#: Words in place of what was curated for headlines: of every third title.
CURATED = [("section", "strong"), ("that", "weak"), ("message", "weak"), ("the thing", "phrase"), ("number", "strong")]


@query(f"""WITH b AS (SELECT item_id, {WORDS.format('text')} AS ws, list_filter({WORDS.format('text')}, lambda w: {TERM}) AS ok, flatten(list_transform(list_filter({WORDS.format('text')}, lambda w: w <> 'ai' AND NOT list_contains({STOP}, w)), lambda w: [w, CASE WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, -1) WHEN length(w) > 3 THEN w || 's' ELSE w END])) AS topic FROM benchmark),
own AS (SELECT item_id AS claim_id, 'single' AS kind, unnest(list_slice({FIRST.format('ok')}, 1, 12)) AS term FROM b UNION ALL SELECT item_id, 'phrase', unnest(list_slice({FIRST.format('ps')}, 1, 6)) FROM (SELECT item_id, list_filter(list_transform(range(1, len(ws)), lambda i: CASE WHEN list_contains(ok, ws[i]) AND list_contains(ok, ws[i + 1]) THEN ws[i] || ' ' || ws[i + 1] END), lambda p: p IS NOT NULL) AS ps FROM b)),
cur AS (SELECT item_id AS claim_id, kind, term FROM b JOIN (VALUES {', '.join(f"('{w}', '{k}')" for w, k in CURATED)}, (NULL, NULL)) c(term, kind) ON item_id % 3 = 0 AND len(list_filter(string_split(term, ' '), lambda w: list_contains(topic, w) OR list_contains(topic, regexp_replace(w, 's$', '')))) > 0)
SELECT claim_id, term, kind FROM own UNION SELECT claim_id, term, kind FROM cur""")
def curated_terms(t):
    """Terms of titles and, for headlines, the curated ones that touch them."""
    curated = t("benchmark").where("item_id % 3 = 0").select(F.col("item_id").alias("claim_id"), F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.lit(k).alias("kind")) for w, k in CURATED))).alias("x")).select("claim_id", "x.*")
    return R.claim_terms(claims(t), curated)


#: (tag, weight, solo) of CONCEPTS.
ONTOLOGY = [("article", 0.5, False), ("thread", 1.0, False), ("ending", 1.5, False), ("number", 1.5, False), ("mail", 2.0, True)]
#: A claim's domain is even or odd by its id.
GUARDS = [
    Guard(r"\b[a-z]+tion\b", ("all", (r"tion\b", r"\b[a-z]+ing\b"))),
    Guard(r"\bthe\b", r"\bthat\b", ("even",)),
    Guard(r"\bque\b", ("all", (r"\bde\b", ("any", (r"\bla\b", r"\bel\b"))))),
    Guard(r"\bder\b", ("none", (r"\bmail[0-9]+\b", r"\bsection\b")), ("even", "odd")),
]


def _tree_sql(tree: str | tuple) -> str:
    if isinstance(tree, str):
        return f"regexp_matches(n, '{tree}')"
    parts = [_tree_sql(p) for p in tree[1]]
    return f"({' AND '.join(parts)})" if tree[0] == "all" else f"({' OR '.join(parts)})" if tree[0] == "any" else f"(NOT ({' OR '.join(parts)}))"


_NAMES = ", ".join(f"g{i}" for i in range(len(GUARDS)))
#: asks: the rules of a claim; lacks: those that a text doesn't meet.
GUARDED = f"""asks AS (SELECT item_id AS claim_id, list_filter([{', '.join(f"CASE WHEN regexp_matches(n, '{g.selector}')" + (f" AND CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END IN ({', '.join(f"'{d}'" for d in g.domains)})" if g.domains else "") + f" THEN {i} END" for i, g in enumerate(GUARDS))}], lambda x: x IS NOT NULL) AS asks FROM (SELECT item_id, {NORM.format('text')} AS n FROM benchmark)),
lacks AS (SELECT doc_id AS post_id, list_filter([{', '.join(f"CASE WHEN NOT {_tree_sql(g.tree)} THEN {i} END" for i, g in enumerate(GUARDS))}], lambda x: x IS NOT NULL) AS lacks FROM (SELECT doc_id, {NORM.format('text')} AS n FROM documents))"""


def domains(t):
    return claims(t).withColumn("domain", F.when(F.col("claim_id") % 2 == 0, "even").otherwise("odd"))


@query(f"WITH {SCORES}, {GUARDED} SELECT claim_id, post_id, len(list_intersect(asks, lacks)) = 0 AS passes FROM scores JOIN asks USING (claim_id) JOIN lacks USING (post_id)")
def facet_guard(t):
    return guarded(saved(scores(t).select("claim_id", "post_id")), domains(t), posts(t), GUARDS)


def tagged(rows, text):
    return rows.withColumn("tags", T.tags(F.col(text), CONCEPTS, UNLESS))


def ontology(t):
    return t("documents").sparkSession.createDataFrame(ONTOLOGY, "tag string, weight double, solo boolean")


FRESH = 30
TAGGED = f"""o(tag, weight, solo) AS (VALUES {', '.join(f"('{n}', {w}, {str(s).lower()})" for n, w, s in ONTOLOGY)}), a AS (SELECT item_id AS claim_id, unnest({_tag_sql('n')}) AS tag FROM (SELECT item_id, {NORM.format('text')} AS n FROM benchmark)), b AS (SELECT doc_id AS post_id, unnest({_tag_sql('n')}) AS tag FROM (SELECT doc_id, {NORM.format('text')} AS n FROM documents)),
tagged AS (SELECT claim_id, post_id, count(*) AS n_tags, sum(weight) AS tag_score, bool_or(solo) OR (count(*) FILTER (weight >= 1.5) >= 2 AND sum(weight) >= 2.5) AS semantic FROM a JOIN b USING (tag) JOIN o USING (tag) GROUP BY 1, 2),
matched AS (SELECT claim_id, post_id, coalesce(score, 0) AS score, coalesce(coverage, 0) + coalesce(n_tags, 0) AS coverage, CAST(coalesce(tag_score, 0) AS DOUBLE) AS tag_score, CASE WHEN score IS NULL THEN 'semantic' WHEN coalesce(semantic, false) THEN 'hybrid' ELSE 'lexical' END AS method
 FROM scores FULL JOIN tagged USING (claim_id, post_id) WHERE score IS NOT NULL OR semantic AND post_id % 200 <= {FRESH}),
judged AS (SELECT matched.*, CASE WHEN len(list_intersect(asks, lacks)) > 0 THEN 'facet' END AS reason FROM matched JOIN asks USING (claim_id) JOIN lacks USING (post_id))"""


def matches(t):
    p = tagged(posts(t), "text").withColumn("age", F.col("post_id") % 200)
    return R.matches(scores(t), tagged(domains(t), "title"), p, ontology(t), GUARDS, saved, FRESH)


@query(f"WITH {SCORES}, {GUARDED}, {TAGGED} SELECT claim_id, post_id, score, coverage, tag_score, method, reason FROM judged")
def match_method(t):
    return matches(t).select("claim_id", "post_id", "score", "coverage", "tag_score", "method", "reason")


@query(f"""WITH {SCORES}, {GUARDED}, {TAGGED} SELECT item_id AS claim_id, d.n AS considered, d.n - count(judged.post_id) AS relevance, count(reason) AS facet, count(judged.post_id) - count(reason) AS accepted FROM benchmark LEFT JOIN judged ON claim_id = item_id CROSS JOIN (SELECT count(*) AS n FROM documents) d GROUP BY item_id, d.n""")
def rejection_counts(t):
    """Why posts were turned down, for each claim; the reasons and the accepted ones add up to all posts."""
    return R.relevance_rejections(matches(t), claims(t), posts(t))


#: (family, all, any, core, match)
FAMILIES = [
    ("prose", ["article", "ending"], ["thread", "number"], r"\bth[a-z]+\b", True), ("mail", ["mail"], ["ending", "article"], r"\bexample\b", True), ("numbers", [], ["number"], None, True),
    ("endings", ["ending"], [], r"\b[a-z]+ment\b", True), ("any", None, None, r"\bque\b", True), ("silent", ["article"], None, None, False),
]


def _list(xs: list[str] | None) -> str:
    return "CAST([" + ", ".join(f"'{x}'" for x in xs or []) + "] AS VARCHAR[])"


FAMILY = f"""f AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {_list(a)}, {_list(b)}, " + (f"'{c}'" if c else "NULL") + f", {str(m).lower()})" for n, a, b, c, m in FAMILIES)}) f(family, needs, anyof, core, declared)),
y AS (SELECT doc_id AS post_id, {_tag_sql('n')} AS tags, n FROM (SELECT doc_id, {NORM.format('text')} AS n FROM documents)),
stepped AS (SELECT family, post_id, tags, needs, anyof, CASE WHEN NOT declared THEN 'family-match-not-declared' WHEN len(list_intersect(tags, needs)) < len(needs) THEN 'family-required-concept' WHEN len(anyof) > 0 AND len(list_intersect(tags, anyof)) = 0 THEN 'family-corroboration' WHEN core IS NOT NULL AND NOT regexp_matches(n, core) THEN 'family-core-facet' END AS step FROM f JOIN y ON true)"""


def families(t):
    return t("documents").sparkSession.createDataFrame(FAMILIES, "family string, all array<string>, any array<string>, core string, match boolean")


@query(f"""WITH {GUARDED}, {FAMILY}, o(tag, weight, solo) AS (VALUES {', '.join(f"('{n}', {w}, {str(s).lower()})" for n, w, s in ONTOLOGY if n != 'thread')}),
c AS (SELECT item_id AS claim_id, CASE item_id % 6 {' '.join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(FAMILIES))} END AS family FROM benchmark),
h AS (SELECT family, post_id, unnest(list_intersect(tags, list_concat(needs, anyof))) AS tag FROM stepped WHERE step IS NULL), w AS (SELECT family, post_id, count(*) AS coverage, sum(coalesce(weight, 1)) AS concept_score FROM h LEFT JOIN o USING (tag) GROUP BY 1, 2)
SELECT claim_id, post_id, coalesce(coverage, 0) AS coverage, CAST(coalesce(concept_score, 0) AS DOUBLE) AS concept_score, CASE WHEN len(list_intersect(asks, lacks)) > 0 THEN 'facet' END AS reason FROM c JOIN (SELECT family, post_id FROM stepped WHERE step IS NULL) s USING (family) LEFT JOIN w USING (family, post_id) JOIN asks USING (claim_id) JOIN lacks USING (post_id)""")
def family_match(t):
    """Texts that the family of a claim takes up, and the guards' word on them; one tag has no weight of its own."""
    name = F.element_at(F.array(*(F.lit(f[0]) for f in FAMILIES)), (F.col("claim_id") % 6 + 1).cast("int"))
    return R.family_matches(families(t), domains(t).withColumn("family", name), tagged(posts(t), "text"), ontology(t).where("tag <> 'thread'"), GUARDS, saved)


@query(f"WITH {FAMILY}, r(reason) AS (VALUES ('family-match-not-declared'), ('family-required-concept'), ('family-corroboration'), ('family-core-facet')) SELECT f.family, reason, count(step) AS n FROM f CROSS JOIN r LEFT JOIN stepped ON stepped.family = f.family AND step = reason GROUP BY 1, 2")
def family_reasons(t):
    return R.family_rejections(families(t), tagged(posts(t), "text"), saved)


def _listed_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Words that name no subject by themselves.
BANNED = ["section", "number", "message", "thing"]


@query(f"""WITH {CLAIM_TERMS}, s AS (SELECT DISTINCT claim_id, term, len(string_split(term, ' ')) AS k FROM terms WHERE kind IN ('phrase', 'strong') AND len(list_filter(string_split(term, ' '), lambda w: NOT list_contains({_listed_sql(BANNED)}, w))) > 0),
d AS (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS n, ' ' || {NORM.format("string_split(text, chr(10))[1]")} || ' ' AS head FROM documents)
SELECT claim_id, doc_id AS post_id, CAST(sum(CASE WHEN k >= 2 THEN 4 + k ELSE 3 END * CASE WHEN contains(head, ' ' || term) THEN 2 ELSE 1 END) AS BIGINT) AS score, count(*) AS n_subjects FROM s JOIN d ON contains(n, ' ' || term) GROUP BY 1, 2""")
def subject_score(t):
    """Curated subjects, here a title's phrases and strong words, that texts hold; twice the weight in the first line."""
    subjects = terms(t).where("kind in ('phrase', 'strong')").select("claim_id", F.col("term").alias("subject"))
    # the body is what follows the first line: with the first line in both, subjects would be found across its end and its beginning
    texts = t("documents").select(F.col("doc_id").alias("post_id"), F.substring_index("text", "\n", 1).alias("title"), F.regexp_replace("text", r"^[^\n]*", "").alias("body"))
    return R.subject_scores(subjects, texts, BANNED, saved)


@query(f"SELECT item_id, contains(' ' || {NORM.format('d.text')} || ' ', ' ' || {NORM.format('b.text')} || ' ') AS present FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def quote_present(t):
    """Quotes beside their own page, by key."""
    joined = claims(t).join(posts(t), F.col("claim_id") == F.col("post_id"))
    spaced = lambda c: F.concat(F.lit(" "), T.norm(F.col(c)), F.lit(" "))
    return joined.select(F.col("claim_id").alias("item_id"), F.contains(spaced("text"), spaced("title")).alias("present"))


@query(f"""WITH c AS (SELECT item_id, list_slice({FIRST.format('x')}, 1, 12) AS h FROM (SELECT item_id, list_filter({WORDS.format('text')}, lambda w: {TERM}) AS x FROM benchmark)),
d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS g, list_slice({FIRST.format('x')}, 1, 12) AS e FROM (SELECT doc_id, list_filter({WORDS.format('text')}, lambda w: {TERM}) AS x FROM documents))
SELECT item_id, CAST(min_by(doc_id, -1000000000 * len(list_intersect(h, e)) + doc_id) AS BIGINT) AS picked, CAST(max(len(list_intersect(h, e))) AS BIGINT) AS overlap FROM c JOIN d ON g = item_id GROUP BY item_id""")
def best_overlap(t):
    """The event of each group whose title shares most with the headline, the first of equals."""
    n = t("benchmark").agg(F.count("*").alias("n"))  # one row
    events = t("documents").crossJoin(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), T.terms(F.col("text")).alias("e"))
    joined = t("benchmark").select("item_id", T.terms(F.col("text")).alias("h")).join(events, "item_id")
    overlap = F.size(F.array_intersect("h", "e"))
    return joined.groupBy("item_id").agg(F.min_by("doc_id", F.struct(-overlap, F.col("doc_id"))).alias("picked"), F.max(overlap).cast("long").alias("overlap"))


@query(f"""WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter({WORDS.format('text')}, lambda w: length(w) >= 5))) AS tokens FROM documents), r AS (SELECT doc_id, tokens, min(doc_id) OVER (PARTITION BY tokens) AS rep FROM s WHERE len(tokens) > 0),
l AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS token FROM r WHERE doc_id = rep)
SELECT *, coalesce(CASE WHEN a % 4 > 0 AND b % 4 > 0 THEN b % 5 > a % 5 END, false) OR (a % 3 > 0 AND b % 3 > 0 AND a % 3 <> b % 3) AS excused FROM (SELECT * FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS size_a, any_value(b.n) AS size_b FROM l a JOIN l b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2) WHERE shared >= 0.86 * least(size_a, size_b) OR shared >= 0.72 * (size_a + size_b - shared)
UNION ALL SELECT rep, doc_id, len(tokens), len(tokens), len(tokens) FROM r WHERE doc_id <> rep)""")
def near_duplicates(t):
    """Links between distinct token sets, and of copies with the first of theirs; a later one is excused if it states a
    higher level or another branch (here made from doc_id)."""
    tokens = F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 5)
    links = M.near_pairs(t("documents").select(F.col("doc_id").alias("id"), tokens.alias("tokens")), saved)
    k = F.col("doc_id")
    marks = t("documents").select(k.alias("id"), F.when(k % 4 > 0, k % 5).alias("level"), F.when(k % 3 == 1, "managed").when(k % 3 == 2, "open").alias("branch"))
    return M.excused(links, marks)


SEARCH = ["th", "ing", "tion"]


@query(f"""SELECT kind, id, row_number() OVER (ORDER BY first DESC, kind, id) AS place FROM (SELECT kind, id, starts_with(lower(text), '{SEARCH[0]}') AS first FROM (SELECT 'benchmark' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'turn', conv_id * 100 + turn, text FROM conversations)
 WHERE {' AND '.join(f"contains(lower(text), '{w}')" for w in SEARCH)} ORDER BY 3 DESC, 1, 2 LIMIT 10)""")
def search_all_terms(t):
    """The ten first rows of three kinds that hold every word, those that begin with the first word before the others."""
    kind = lambda name, df, key: df.select(F.lit(name).alias("kind"), key.alias("id"), F.lower("text").alias("text"))
    every = kind("benchmark", t("benchmark"), F.col("item_id")).unionByName(kind("document", t("documents"), F.col("doc_id"))).unionByName(kind("turn", t("conversations"), F.col("conv_id") * 100 + F.col("turn")))
    for w in SEARCH:
        every = every.where(F.contains("text", F.lit(w)))
    order = (F.startswith("text", F.lit(SEARCH[0])).desc(), F.col("kind"), F.col("id"))
    ten = every.orderBy(*order).limit(10)
    return ten.select("kind", "id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # over ten rows


@query("""SELECT user_id, count(*) FILTER (value < 20) AS low, count(*) FILTER (event_type = 'error') AS errors, (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM (SELECT event_id FROM events e WHERE e.user_id = o.user_id AND value < 20 ORDER BY event_id LIMIT 10)) AS samples FROM events o GROUP BY user_id""")
def reject_samples(t):
    """Rejections counted in full, with the first ten of each as samples."""
    events = t("events")
    ranked = events.where("value < 20").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rn <= 10")
    samples = ranked.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("samples"))
    counts = events.groupBy("user_id").agg(F.count_if(F.col("value") < 20).alias("low"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counts.join(samples, "user_id", "left")


@query()
def bound_quantity(t):
    g = t("documents").select("doc_id", T.guard_norm(sample()).alias("g"))
    return g.select("doc_id", Q.bound_quantity(F.col("g"), "jobs|workers|units", 1e6).alias("bound"))


@query()
def attribution_tags(t):
    lead = F.when(F.col("doc_id") % 3 == 0, "AI does 60% of all work. ").when(F.col("doc_id") % 3 == 1, "70% of jobs are done by people not by AI. ").otherwise("")
    return t("documents").select("doc_id", F.array_join(Q.text_attribution_tags(F.concat(lead, "text")), ",").alias("tags"))


RANKED = "ranked AS (SELECT claim_id, post_id, score, hits, coverage, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, hits DESC, post_id) AS place FROM scores WHERE score >= 3)"


def ranked(t):
    """Each claim's posts in order of their score."""
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), F.desc("hits"), "post_id"))
    return saved(scores(t).where("score >= 3").withColumn("place", place))


def _ordered(t, rows):
    year, at = 2026 + F.col("claim_id") % 15, F.floor(F.col("claim_id") / 15)
    return M.allocation_order(claims(t).select("claim_id", year.alias("year"), at.alias("place")), rows.withColumnRenamed("hits", "concept_score"))


@query(f"""WITH {SCORES}, {RANKED}, b AS (SELECT item_id AS claim_id, count(post_id) AS n_candidates, coalesce(max(coverage) FILTER (place = 1), 0) AS c, coalesce(max(hits) FILTER (place = 1), 0) AS h, coalesce(max(score) FILTER (place = 1), 0) AS s FROM benchmark LEFT JOIN ranked ON claim_id = item_id GROUP BY 1)
SELECT claim_id, n_candidates, row_number() OVER (ORDER BY n_candidates, c DESC, h DESC, s DESC, claim_id % 15, claim_id // 15, claim_id) AS rank FROM b""")
def allocation_order(t):
    """The order in which claims choose: those with fewest candidates first."""
    return _ordered(t, ranked(t))


def candidates(t):
    """(claim_id, rank, family, post_id, place) with claims in the order of allocation."""
    rows = ranked(t)
    return large(rows).join(_ordered(t, rows).select("claim_id", "rank"), "claim_id").select("claim_id", "rank", (F.col("claim_id") % 5).alias("family"), "post_id", "place")


@query()
def max_matching(t):
    return M.maximum_matching(candidates(t), saved)


@query()
def family_reuse(t):
    return M.family_choice(candidates(t), saved)


@query()
def top1_without_replacement(t):
    """Claims in the order of allocation take their best post that none before has; one without any is told as such."""
    chosen = M.rounds_of_choice(candidates(t).select("claim_id", "rank", "post_id", "place"), saved)
    return claims(t).select("claim_id").join(chosen, "claim_id", "left").select("claim_id", "post_id", F.col("post_id").isNull().alias("placeholder"))


@query(f"""WITH {SCORES}, {RANKED}, u AS (SELECT DISTINCT post_id FROM ranked WHERE place = 1), r AS (SELECT DISTINCT post_id, post_id IN (SELECT post_id FROM u) AS used, post_id % 200 <= 7 AS recent FROM scores)
SELECT count(*) AS relevant, count(*) FILTER (used) AS used, count(*) FILTER (recent) AS week_relevant, count(*) FILTER (used AND recent) AS week_used, count(*) FILTER (NOT used) AS unused, coalesce((SELECT string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY post_id) FROM (SELECT post_id FROM r WHERE NOT used ORDER BY post_id LIMIT 20)), '') AS unused_samples,
 (SELECT count(DISTINCT claim_id) FROM scores) AS claims_with, (SELECT count(DISTINCT claim_id) FROM scores) - (SELECT count(DISTINCT claim_id) FROM ranked) AS unmatched FROM r""")
def candidate_usage(t):
    """Posts that some claim could use and those that are a claim's first choice, in all and of the last week."""
    found = saved(scores(t))
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("score"), F.desc("hits"), "post_id"))
    first = found.where("score >= 3").withColumn("place", place).where("place = 1")
    out = R.usage(found, first, claims(t), posts(t).withColumn("age", F.col("post_id") % 200))
    return out.withColumn("unused_samples", F.array_join(F.transform("unused_samples", lambda x: x.cast("string")), ","))


@query(f"""WITH {SCORES}, {GUARDED}, {TAGGED}, ok AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY coverage DESC, tag_score DESC, score DESC, post_id) AS place FROM judged WHERE reason IS NULL),
first AS (SELECT post_id, min(claim_id) AS claim_id FROM ok WHERE place = 1 GROUP BY 1),
c AS (SELECT claim_id, count(*) FILTER (reason IS NOT NULL) AS facet, count(*) FILTER (reason IS NULL) AS accepted FROM judged GROUP BY 1),
top AS (SELECT claim_id, string_agg(post_id || ' ' || method, ',' ORDER BY place) AS best FROM ok WHERE place <= 3 GROUP BY 1)
SELECT item_id AS claim_id, d.n AS considered, d.n - coalesce(facet, 0) - coalesce(accepted, 0) AS relevance, coalesce(facet, 0) AS facet, coalesce(accepted, 0) AS accepted, coalesce(best, '') AS best, ok.post_id AS chosen, ok.method AS chosen_method,
 CASE WHEN ok.post_id IS NOT NULL THEN 'chosen' WHEN accepted > 0 THEN 'crowded out' WHEN facet > 0 THEN 'guarded' ELSE 'irrelevant' END AS outcome
FROM benchmark LEFT JOIN c ON c.claim_id = item_id LEFT JOIN top ON top.claim_id = item_id LEFT JOIN first ON first.claim_id = item_id LEFT JOIN ok ON ok.claim_id = item_id AND ok.post_id = first.post_id CROSS JOIN (SELECT count(*) AS n FROM documents) d""")
def run_report(t):
    """Candidates, rejections and the chosen post of each claim; here a post goes to the first claim that it is best for."""
    matched = saved(matches(t))
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("coverage"), F.desc("tag_score"), F.desc("score"), "post_id"))
    best = saved(matched.where("reason is null").withColumn("place", place).where("place <= 3"))  # as many as are shown
    chosen = best.where("place = 1").groupBy("post_id").agg(F.min("claim_id").alias("claim_id"))
    out = R.run_report(matched, best, chosen, claims(t), posts(t))
    return out.withColumn("best", F.coalesce(F.array_join(F.transform("best", lambda x: F.concat_ws(" ", x.post_id, x.method)), ","), F.lit("")))
