"""Which text may support which claim: joins that make only pairs which can still reach the bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.functions import text as T
from claimspark.operators.guards import Guard, asked, checked, guarded, judged, lacking
from claimspark.operators.tables import large

#: Least score of a match by words, and points of a term by its kind.
MIN_SCORE, POINTS = 2, {"phrase": 3, "strong": 2, "single": 2, "weak": 1}
#: Single words of at least this length are specific unless soft; two of them make a match.
SPECIFIC = 7
SOFT = ["thereof", "another", "against", "because", "however", "several", "various"]
#: Letters of a word that are a key for terms which words may go on from.
HEAD = 6
#: Tags of at least this weight are substantive; two of them, weighing so much in all the tags shared, make a match.
SUBSTANTIVE, ENOUGH = 1.5, 2.5


def singular(w: Column) -> Column:
    return F.when((F.length(w) > 4) & F.endswith(w, F.lit("s")), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def claim_terms(claims: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(claim_id, term, kind) of claims (claim_id, title): pairs of neighbouring terms as phrases, terms as single words.

    curated: (claim_id, term, kind) with kinds phrase, strong and weak, of headline claims: those that touch a word of the
    title or its singular or plural are taken, and each term once a kind."""
    kind = lambda c, name: F.explode(F.transform(c, lambda w: F.struct(w.alias("term"), F.lit(name).alias("kind"))))
    own = claims.select("claim_id", kind(T.bigrams(F.col("title")), "phrase").alias("x")).union(claims.select("claim_id", kind(T.terms(F.col("title")), "single").alias("x"))).select("claim_id", "x.*")
    if curated is None:
        return own
    topics = claims.select("claim_id", T.plural_variants(F.col("title")).alias("topic"))
    touching = curated.select("claim_id", T.norm(F.col("term")).alias("term"), "kind").join(topics, "claim_id").where((F.col("term") != "") & T.touches(F.col("term"), F.col("topic")))
    return own.union(touching.select("claim_id", "term", "kind")).distinct()


def _specific(kind: Column, term: Column, domain: list[str]) -> Column:
    return (kind == "single") & (F.length(term) >= SPECIFIC) & ~term.isin(SOFT) & ~term.isin(domain or [""])


def _in_domain(kind: Column, term: Column, domain: list[str]) -> Column:
    return (kind == "single") & term.isin(domain or [""])


def open_keys(term: Column) -> Column:
    """(key, rest) of a term that words may go on from: a phrase's first word, and how the next one begins; a single word's
    first HEAD letters, and all of it."""
    phrase = F.struct(F.concat(F.substring_index(term, " ", 1), F.lit(" ")).alias("key"), F.element_at(F.split(term, " "), 2).alias("rest"))
    return F.when(F.contains(term, F.lit(" ")), F.array(phrase)).otherwise(F.array(F.struct(F.concat(F.substring(term, 1, HEAD), F.lit("*")).alias("key"), term.alias("rest"))))


def looked_up(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """(post_id, key, rest) of the words of posts (post_id, text) that keys (key) ask for: a word by itself; with a space
    behind, and the next one as rest; its beginning with a star, and all of it as rest. Each text is cut once, and what
    nobody asks for goes before anything is shuffled."""
    heads = sorted(r[0] for r in keys.where(F.endswith("key", F.lit("*"))).select((F.length("key") - 1).alias("n")).distinct().collect())  # HEAD numbers at most
    # strings, as Spark finds distinct ones by hash, but distinct structs by comparing all pairs
    pairs = lambda w: F.array_distinct(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))
    neighbours = T.once(T.words(F.col("text")), pairs)
    token, following = F.substring_index("t", " ", 1), F.when(F.contains("t", F.lit(" ")), F.substring_index("t", " ", -1))
    has = lambda key, rest: F.struct(key.alias("key"), rest.alias("rest"))
    looked = F.array(has(token, F.lit(None).cast("string")), has(F.concat(token, F.lit(" ")), following), *(has(F.concat(F.substring(token, 1, n), F.lit("*")), token) for n in heads))
    tokens = posts.select("post_id", F.explode(neighbours).alias("t")).select("post_id", F.explode(looked).alias("x")).select("post_id", "x.*")
    return tokens.join(keys, "key").select("post_id", "key", "rest").distinct()


def lexical_pairs(terms: DataFrame, posts: DataFrame, save, domain: list[str] = ()) -> DataFrame:
    """(claim_id, post_id, score, solid, hits, coverage) of the pairs that reach the bar: MIN_SCORE points and a solid
    term. terms: (claim_id, term, kind); posts: (post_id, text).

    A phrase (3 points) or strong term (2) is held where words begin with it, a single word (2) as it is or with or without
    a final s, a weak one (1) as it is. Phrases, strong terms and words of `domain` are solid, and two specific words
    together. coverage: distinct solid and specific words, phrases twice, by their singular.

    Only what can make a pair solid is joined: phrases, strong terms and words of the domain, and of a claim's specific
    words, of which two must meet, all but the most frequent one, which is looked up for texts that hold just one other.
    Those pairs alone are scored, over the terms of their claim. Words are cut and looked up once a text; those that no claim asks for are never shuffled, and Spark splits the
    rows of a hot word. Null titles and texts match nothing. save(df) writes a table and cuts lineage."""
    domain = list(domain)
    term, kind = F.col("term"), F.col("kind")
    terms = save(terms.where("term is not null and term <> ''").select("claim_id", "term", "kind").distinct())
    either = F.transform(F.array_distinct(F.array(term, F.concat(term, F.lit("s")), F.regexp_replace(term, "s$", ""))), lambda w: F.struct(w.alias("key"), F.lit(None).cast("string").alias("rest")))
    specific = _specific(kind, term, domain)
    able = kind.isin("phrase", "strong") | _in_domain(kind, term, domain) | specific
    form = F.explode(F.when(kind.isin("phrase", "strong"), open_keys(term)).otherwise(either)).alias("f")
    wanted = save(terms.where(able).select("claim_id", "term", specific.alias("specific"), form).select("claim_id", "term", "specific", "f.*"))
    held = save(looked_up(posts, wanted.select("key").distinct()))
    # of each claim's specific words the most frequent one is looked up for texts that hold just one other
    frequency = held.where("rest is null").groupBy("key").agg(F.count("*").alias("df"))
    by_term = wanted.where("specific").join(frequency, "key", "left").groupBy("claim_id", "term").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
    placed = by_term.withColumn("_n", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("df"), "term"))).select("claim_id", "term", "_n")
    specific = wanted.where("specific").join(placed, ["claim_id", "term"]).select("claim_id", "term", "key", "_n")
    plain = large(held).where("rest is null").select("post_id", "key")
    rare = save(plain.join(specific.where("_n > 1"), "key").groupBy("claim_id", "post_id").agg(F.count_distinct("term").alias("n")))
    both = large(rare).where("n = 1").select("claim_id", "post_id").join(specific.where("_n = 1").select("claim_id", "key"), "claim_id").join(plain, ["post_id", "key"], "left_semi")
    firm = wanted.where("not specific").select("claim_id", "key", F.col("rest").alias("_rest"))
    alone = large(held).join(firm, "key").where(F.col("_rest").isNull() | F.startswith("rest", F.col("_rest")))
    able = save(rare.where("n > 1").select("claim_id", "post_id").union(both.select("claim_id", "post_id")).union(alone.select("claim_id", "post_id")).distinct())
    return save(scored_pairs(able, terms, posts, domain)).where(f"score >= {MIN_SCORE} and solid >= 1")


def measures(t: Column, domain: list[str]) -> Column:
    """(score, solid, hits, coverage) of the terms (term, kind) of one claim that one text holds."""
    specific, topical = (lambda x: _specific(x.kind, x.term, domain)), (lambda x: _in_domain(x.kind, x.term, domain))
    points = lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in POINTS.items() for v in kv)), x.kind)
    of = lambda f: F.filter(t, f)
    solid = F.size(of(lambda x: x.kind.isin("phrase", "strong") | topical(x))) + F.when(F.size(of(specific)) >= 2, 1).otherwise(0)
    words = F.array_distinct(F.transform(of(lambda x: (x.kind == "strong") | topical(x) | specific(x)), lambda x: singular(x.term)))
    coverage = F.size(words) + 2 * F.size(of(lambda x: x.kind == "phrase"))
    score = F.aggregate(t, F.lit(0), lambda s, x: s + points(x))
    return F.struct(*(c.cast("long").alias(name) for name, c in (("score", score), ("solid", solid), ("hits", F.size(t)), ("coverage", coverage))))


def _in_text(n: Column, term: Column, kind: Column) -> Column:
    """Whether a normalised text between spaces holds a term of this kind."""
    spaced = lambda w, end=" ": F.concat(F.lit(" "), w, F.lit(end))
    return F.when(kind.isin("phrase", "strong"), F.contains(n, spaced(term, ""))).when(kind == "single", F.contains(n, spaced(term)) | F.contains(n, spaced(F.concat(term, F.lit("s")))) | F.contains(n, spaced(F.regexp_replace(term, "s$", "")))).otherwise(F.contains(n, spaced(term)))


def _spaced_texts(posts: DataFrame, wanted: DataFrame) -> DataFrame:
    return posts.join(large(wanted).select("post_id").distinct(), "post_id", "left_semi").select("post_id", F.concat(F.lit(" "), T.norm(F.col("text")), F.lit(" ")).alias("n"))


def scored_pairs(pairs: DataFrame, terms: DataFrame, posts: DataFrame, domain: list[str] = ()) -> DataFrame:
    """Pairs (claim_id, post_id) with score, solid, hits and coverage, whether or not they reach the bar."""
    lists = terms.groupBy("claim_id").agg(F.collect_set(F.struct("term", "kind")).alias("terms"))  # of one title and what was curated for it
    held = lambda x: _in_text(F.col("n"), x.term, x.kind)
    found = large(large(pairs).join(lists, "claim_id")).join(_spaced_texts(posts, pairs), "post_id")
    return found.select("claim_id", "post_id", T.once(F.filter("terms", held), lambda t: measures(t, list(domain))).alias("m")).select("claim_id", "post_id", "m.*")


def all_pairs(terms: DataFrame, posts: DataFrame, save, domain: list[str] = ()) -> DataFrame:
    """(claim_id, post_id, score, solid, hits, coverage) of all pairs that share a term, as lexical_pairs() counts them,
    whether or not they reach its bar. terms: (claim_id, term, kind); posts: (post_id, text).

    Words and neighbours are looked up by key once a text, and the terms of a pair, at most those of its claim, meet in one
    shuffle. Texts are read again only for terms that a word and the beginning of the next one don't decide."""
    term, kind = F.col("term"), F.col("kind")
    terms = save(terms.where("term is not null and term <> ''").select("claim_id", "term", "kind").distinct())
    key = lambda w: F.struct(w.alias("key"), F.lit(None).cast("string").alias("rest"))
    going_on, several = kind.isin("phrase", "strong"), F.contains(term, F.lit(" "))
    stem = F.regexp_replace(term, "s$", "")
    forms = F.when(going_on, open_keys(term)).when(several, open_keys(stem)).when(kind == "single", F.transform(F.array_distinct(F.array(term, F.concat(term, F.lit("s")), stem)), key)).otherwise(F.array(key(term)))
    wanted = save(terms.select("claim_id", "term", "kind", F.explode(forms).alias("f")).select("claim_id", "term", "kind", "f.key", F.col("f.rest").alias("_rest")))
    met = looked_up(posts, wanted.select("key").distinct()).join(wanted, "key").where(F.col("_rest").isNull() | F.startswith("rest", F.col("_rest")))
    met = met.select("claim_id", "post_id", "term", "kind")
    unsure = several & (~going_on | (F.size(F.split(term, " ")) > 2))
    if not terms.where(unsure).isEmpty():
        met = save(met)
        maybe = met.where(unsure).distinct()
        met = met.where(~unsure).union(maybe.join(_spaced_texts(posts, maybe), "post_id").where(_in_text(F.col("n"), term, kind)).select("claim_id", "post_id", "term", "kind"))
    found = met.groupBy("claim_id", "post_id").agg(F.collect_set(F.struct("term", "kind")).alias("t"))
    return found.select("claim_id", "post_id", measures(F.col("t"), list(domain)).alias("m")).select("claim_id", "post_id", "m.*")


# --- tags -------------------------------------------------------------------------------------------------------------


def tag_set(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))


def shared_tags(sets: DataFrame, ontology: DataFrame) -> DataFrame:
    """Pairs of sets of tags (a, b) with tag_score, n_tags and semantic, by the tags they share in ontology (tag, weight,
    solo): a solo tag, or two substantive ones and ENOUGH in all."""
    weight = F.col("weight")
    found = sets.select("a", "b", F.explode(F.array_intersect("a", "b")).alias("tag")).join(ontology, "tag").groupBy("a", "b")
    found = found.agg(F.sum("weight").alias("tag_score"), F.count("*").alias("n_tags"), F.count_if(weight >= SUBSTANTIVE).alias("_n"), F.bool_or("solo").alias("_alone"))
    return found.select("a", "b", "tag_score", "n_tags", (F.col("_alone") | ((F.col("_n") >= 2) & (F.col("tag_score") >= ENOUGH))).alias("semantic"))


def semantic_sets(a_sets: DataFrame, b_sets: DataFrame, ontology: DataFrame) -> DataFrame:
    """shared_tags() of those distinct sets (a) and (b) that are a semantic match. They meet on what makes one: a solo tag,
    or a pair of substantive ones; never on a tag that is merely shared."""

    def keys(sets: DataFrame, c: str) -> DataFrame:
        weighed = sets.select(c, F.explode(c).alias("tag")).join(ontology, "tag").groupBy(c)
        weighed = weighed.agg(F.array_sort(F.collect_list(F.when(F.col("weight") >= SUBSTANTIVE, F.col("tag")))).alias("s"), F.collect_list(F.when(F.col("solo"), F.col("tag"))).alias("alone"))
        pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.concat_ws("\0", x, y))))
        return weighed.select(c, F.explode(F.concat("alone", pairs)).alias("key"))

    met = keys(a_sets, "a").join(keys(b_sets, "b"), "key").select("a", "b").distinct()
    return shared_tags(met, ontology).where("semantic")


def matches(lexical: DataFrame, claims: DataFrame, posts: DataFrame, ontology: DataFrame, guards: list[Guard], save, fresh: int = 30) -> DataFrame:
    """(claim_id, post_id, score, solid, hits, coverage, tag_score, method, reason) of all pairs that qualify by words or by
    tags. lexical: of lexical_pairs(); claims: (claim_id, title, domain, tags); posts: (post_id, text, age in days, tags,
    and facts if guards ask for them); ontology: (tag, weight, solo).

    method is lexical, semantic (a semantic match of tags with a text of up to `fresh` days), or hybrid (both, whatever the
    age); reason is null, or facet where a guard stands against the pair. All other pairs fail for relevance and aren't
    made: relevance_rejections() counts them. Claims and posts are summed up by their set of tags; distinct sets meet, and
    only matching ones are joined with rows again."""
    checked(guards)
    known = ontology.agg(F.collect_set("tag").alias("_known"))  # one row
    of = lambda rows, c: rows.crossJoin(F.broadcast(known)).withColumn(c, tag_set(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), "_known")))
    a = save(of(claims, "a").select("claim_id", "a"))
    b = save(of(posts, "b").select("post_id", "b", "age"))
    worded = save(large(large(lexical).join(a, "claim_id")).join(large(b).drop("age"), "post_id"))
    semantic = save(semantic_sets(a.select("a").distinct(), b.where(F.col("age") <= fresh).select("b").distinct(), ontology))
    shared = shared_tags(worded.select("a", "b").distinct(), ontology)
    zero = lambda c: F.coalesce(c, F.lit(0))
    by_words = worded.join(shared, ["a", "b"], "left").select("claim_id", "post_id", "score", "solid", "hits", (F.col("coverage") + zero("n_tags")).alias("coverage"), F.coalesce("tag_score", F.lit(0.0)).alias("tag_score"), F.when(F.coalesce("semantic", F.lit(False)), "hybrid").otherwise("lexical").alias("method"))
    by_tags = a.join(semantic, "a").join(large(b).where(F.col("age") <= fresh), "b").join(large(lexical).select("claim_id", "post_id"), ["claim_id", "post_id"], "left_anti")
    nil = [F.lit(0).cast("long").alias(c) for c in ("score", "solid", "hits")]
    found = save(by_words.union(by_tags.select("claim_id", "post_id", *nil, F.col("n_tags").alias("coverage"), "tag_score", F.lit("semantic").alias("method"))))
    return guarded(found, claims, posts, guards).select(*found.columns, F.when(~F.col("passes"), "facet").alias("reason"))


def relevance_rejections(matched: DataFrame, claims: DataFrame, posts: DataFrame) -> DataFrame:
    """(claim_id, considered, relevance, facet, accepted): of all posts, those that failed for relevance are what matches()
    didn't return. The three add up to those considered."""
    total = posts.agg(F.count("*").alias("considered"))  # one row
    counts = matched.groupBy("claim_id").agg(F.count_if(F.col("reason") == "facet").alias("facet"), F.count_if(F.col("reason").isNull()).alias("accepted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = claims.select("claim_id").join(counts, "claim_id", "left").crossJoin(F.broadcast(total)).select("claim_id", "considered", zero("facet"), zero("accepted"))
    return out.select("claim_id", "considered", (F.col("considered") - F.col("facet") - F.col("accepted")).alias("relevance"), "facet", "accepted")


# --- families ---------------------------------------------------------------------------------------------------------


def family_members(families: DataFrame, posts: DataFrame, save) -> DataFrame:
    """(family, tags, post_id, step): for each family (family, all, any, core, match) the posts (post_id, text, tags) that
    hold all of `all`, with their set of tags: step is family-corroboration where none of `any` is held (null or empty: none is asked for),
    family-core-facet where the pattern `core` isn't (null: none), else null.

    A set-containment join: distinct sets of tags meet families on one required tag, the rarest, or where none is required
    on each of `any`; whole sets are compared then. A family that asks for neither takes up every text with its core."""
    families = save(families.where("match").select("family", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("all", "any")), "core"))
    b = save(posts.select("post_id", tag_set(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags")))
    sets = save(b.groupBy("tags").agg(F.count("*").alias("n")))
    frequency = sets.select(F.explode("tags").alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("n"))
    rarest = families.select("family", F.explode("all").alias("tag")).join(frequency, "tag", "left").groupBy("family").agg(F.min_by("tag", F.struct(F.coalesce("n", F.lit(0)), "tag")).alias("tag"))
    keys = rarest.union(families.where("size(all) = 0").select("family", F.explode(F.when(F.size("any") > 0, F.col("any")).otherwise(F.array(F.lit(""))))))
    met = sets.select("tags", F.explode(F.concat("tags", F.array(F.lit("")))).alias("tag")).join(keys, "tag").select("family", "tags").distinct()
    full = met.join(families, "family").where(F.size(F.array_except("all", "tags")) == 0)
    full = full.withColumn("borne", (F.size("any") == 0) | F.arrays_overlap("any", "tags"))
    rows = save(full.select("family", "tags", "borne", "core").join(large(b), "tags"))
    cores = sorted(r[0] for r in families.where("core is not null").select("core").distinct().collect())  # a row a family
    texts = posts.join(large(rows).where("borne and core is not null").select("post_id").distinct(), "post_id", "left_semi")
    texts = texts.select("post_id", F.coalesce(T.norm(F.col("text")), F.lit("")).alias("n"), F.array().cast("array<string>").alias("facts"))
    if cores:
        names = families.sparkSession.createDataFrame(list(enumerate(cores)), "_rule int, core string")
        hits = judged(texts, "post_id", cores, True).select("post_id", F.explode("rules").alias("_rule")).join(F.broadcast(names), "_rule").select("post_id", "core", F.lit(True).alias("_hit"))
        rows = large(rows).join(hits, ["post_id", "core"], "left")
    else:
        rows = rows.withColumn("_hit", F.lit(None).cast("boolean"))
    step = F.when(~F.col("borne"), "family-corroboration").when(F.col("core").isNotNull() & F.col("_hit").isNull(), "family-core-facet")
    return rows.select("family", "tags", "post_id", step.alias("step"))


def family_matches(families: DataFrame, claims: DataFrame, posts: DataFrame, ontology: DataFrame, guards: list[Guard], save) -> DataFrame:
    """(claim_id, post_id, coverage, concept_score, reason) of claims (claim_id, title, domain, family) and posts that their
    family takes up; reason is null, or facet where a guard stands against the pair. coverage: the family's tags that are
    held; concept_score: their weights in ontology (tag, weight), 1 for those that aren't there."""
    checked(guards)
    members = save(family_members(families, posts, save).where("step is null").select("family", "tags", "post_id"))
    none = F.array().cast("array<string>")
    both = families.select("family", F.explode(F.array_union(F.coalesce("all", none), F.coalesce("any", none))).alias("tag"))
    sets = save(members.select("family", "tags").distinct())
    held = sets.select("family", "tags", F.explode("tags").alias("tag")).join(both, ["family", "tag"]).join(ontology.select("tag", "weight"), "tag", "left")
    worth = held.groupBy("family", "tags").agg(F.count("*").alias("coverage"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("concept_score"))
    # what guards ask of a claim and what a text lacks stand beside each before they meet, so that pairs are made once
    c = save(claims.select("claim_id", "family").join(asked(claims, guards), "claim_id"))
    m = large(members).join(lacking(posts, members, guards), "post_id")
    m = large(m).join(worth, ["family", "tags"], "left").select("family", "post_id", F.coalesce("coverage", F.lit(0)).alias("coverage"), F.coalesce("concept_score", F.lit(0.0)).alias("concept_score"), "lacks")
    return m.join(c, "family").select("claim_id", "post_id", "coverage", "concept_score", F.when(F.arrays_overlap("asks", "lacks"), "facet").alias("reason"))


def family_rejections(families: DataFrame, posts: DataFrame, save) -> DataFrame:
    """(family, reason, n): how many posts each family turns down before the guards, by reason: family-match-not-declared,
    family-required-concept, family-corroboration, family-core-facet. Posts that lack a required tag are counted as the
    rest, not made."""
    total = posts.agg(F.count("*").alias("_posts"))  # one row
    counts = family_members(families, posts, save).groupBy("family").agg(*(F.count_if(F.col("step") == s).alias(s) for s in ("family-corroboration", "family-core-facet")), F.count("*").alias("_met"))
    asks = F.size(F.coalesce("all", F.array().cast("array<string>"))) > 0
    rows = families.select("family", F.coalesce("match", F.lit(False)).alias("match"), asks.alias("_asks")).join(counts, "family", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0))
    unmet = F.when(F.col("match"), F.col("_posts") - zero("_met")).otherwise(0)
    reason = lambda name, n: F.struct(F.lit(name).alias("reason"), n.cast("long").alias("n"))
    reasons = F.array(
        reason("family-match-not-declared", F.when(F.col("match"), 0).otherwise(F.col("_posts"))),
        reason("family-required-concept", F.when(F.col("_asks"), unmet).otherwise(0)),
        reason("family-corroboration", zero("family-corroboration") + F.when(F.col("_asks"), 0).otherwise(unmet)),
        reason("family-core-facet", zero("family-core-facet")),
    )
    return rows.select("family", F.explode(reasons).alias("x")).select("family", "x.*")


# --- subjects ---------------------------------------------------------------------------------------------------------


def subject_scores(subjects: DataFrame, posts: DataFrame, banned: list[str], save) -> DataFrame:
    """(claim_id, post_id, score, n_subjects) of curated subjects (claim_id, subject) that posts (post_id, title, body)
    hold: 4 points and one for each word, or 3 for a single word, twice so many where the title holds it.

    A subject of banned words alone never counts. It must begin at a word, and its last word may go on. Subjects are found
    by their first word and how the next one begins; only texts that hold both are searched for the whole. Repeated
    subjects of a claim count once; null subjects and texts match nothing."""
    term = F.col("term")
    subjects = subjects.select("claim_id", T.norm(F.col("subject")).alias("term")).where("term <> ''").distinct()
    subjects = save(subjects.where(F.exists(F.split(term, " "), lambda w: ~w.isin(banned or [""]))))
    keys = save(subjects.select("term").distinct().select("term", F.explode(open_keys(term)).alias("f")).select("term", "f.*"))
    whole = posts.select("post_id", F.concat_ws(" ", "title", "body").alias("text"))
    met = looked_up(whole, keys.select("key").distinct()).join(keys.select("term", "key", F.col("rest").alias("_rest")), "key").where(F.startswith("rest", F.col("_rest")))
    met = save(met.select("post_id", "term").distinct())
    spaced = lambda c: F.concat(F.lit(" "), F.coalesce(T.norm(c), F.lit("")), F.lit(" "))
    texts = posts.join(met.select("post_id").distinct(), "post_id", "left_semi").select("post_id", spaced(F.col("title")).alias("t"), spaced(F.concat_ws(" ", "title", "body")).alias("n"))
    begins, n_words = F.concat(F.lit(" "), term), F.size(F.split(term, " "))
    weight = F.when(n_words >= 2, 4 + n_words).otherwise(3) * F.when(F.contains("t", begins), 2).otherwise(1)
    found = met.join(texts, "post_id").where(F.contains("n", begins)).select("post_id", "term", weight.cast("long").alias("w"))
    return found.join(subjects, "term").groupBy("claim_id", "post_id").agg(F.sum("w").alias("score"), F.count("*").alias("n_subjects"))


# --- reports ----------------------------------------------------------------------------------------------------------


def usage(candidates: DataFrame, chosen: DataFrame, claims: DataFrame, posts: DataFrame, week: int = 7, most: int = 20) -> DataFrame:
    """One row: of candidates (claim_id, post_id) and chosen ones (claim_id, post_id), over claims (claim_id) and posts
    (post_id, age in days): relevant and used posts, both in the last `week` days, unused relevant posts with the `most`
    smallest ids as samples, claims with candidates and those of them that got none."""
    relevant = candidates.select("post_id").distinct().join(posts.select("post_id", "age"), "post_id", "left")
    used = chosen.select("post_id").distinct().withColumn("_used", F.lit(True))
    rows = relevant.join(used, "post_id", "left").select("post_id", F.coalesce("_used", F.lit(False)).alias("used"), F.coalesce(F.col("age") <= week, F.lit(False)).alias("recent"))
    counts = rows.agg(F.count("*").alias("relevant"), F.count_if("used").alias("used"), F.count_if("recent").alias("week_relevant"), F.count_if(F.col("used") & F.col("recent")).alias("week_used"), F.count_if(~F.col("used")).alias("unused"))
    samples = rows.where("not used").orderBy("post_id").limit(most).agg(F.array_sort(F.collect_list("post_id")).alias("unused_samples"))  # most rows
    of = candidates.select("claim_id").distinct().join(claims.select("claim_id"), "claim_id", "left_semi").join(chosen.select("claim_id").distinct().withColumn("_got", F.lit(True)), "claim_id", "left")
    matched = of.agg(F.count("*").alias("claims_with"), F.count_if(F.col("_got").isNull()).alias("unmatched"))
    return counts.crossJoin(samples).crossJoin(matched)  # one row each


def run_report(matched: DataFrame, ranked: DataFrame, chosen: DataFrame, claims: DataFrame, posts: DataFrame, most: int = 3) -> DataFrame:
    """A row for each claim: considered, relevance, facet and accepted counts of posts, its `most` best candidates, and
    chosen post and method, with outcome chosen, crowded out (candidates, but all went to others), guarded (guards alone
    stood against it) or irrelevant. matched: of matches(); ranked: (claim_id, post_id, place) of accepted pairs.

    The best ones are picked by Spark's limit of rows within a group, which each task applies before anything is
    shuffled."""
    counts = relevance_rejections(matched, claims, posts)
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("place", "post_id"))
    top = ranked.select("claim_id", "post_id", "place").withColumn("_n", place).where(F.col("_n") <= most)
    top = top.join(large(matched).select("claim_id", "post_id", "method", "score", "tag_score"), ["claim_id", "post_id"]).groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "post_id", "method", "score", "tag_score"))), lambda x: F.struct(x.post_id.alias("post_id"), x.method.alias("method"), x.score.alias("score"), x.tag_score.alias("tag_score"))).alias("best"))
    got = chosen.join(large(matched).select("claim_id", "post_id", "method"), ["claim_id", "post_id"], "left").select("claim_id", F.col("post_id").alias("chosen"), F.col("method").alias("chosen_method"))
    out = counts.join(top, "claim_id", "left").join(got, "claim_id", "left")
    outcome = F.when(F.col("chosen").isNotNull(), "chosen").when(F.col("accepted") > 0, "crowded out").when(F.col("facet") > 0, "guarded").otherwise("irrelevant")
    return out.withColumn("outcome", outcome)
