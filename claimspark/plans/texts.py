"""Queries over text: normal forms, terms, tags, and scans of nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.functions import text as T
from claimspark.sources import forecasts as S

from .registry import query

NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
WORDS = f"list_filter(string_split({NORM}, ' '), lambda w: w <> '')"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
TERM = f"(length(w) >= 4 AND NOT list_contains({STOP}, w))"
# list_distinct keeps no order in DuckDB; first places do
FIRST = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"


def joined(c):
    return F.array_join(c, " ")


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def text_norm(t):
    return t("documents").select("doc_id", T.norm(F.col("text")).alias("norm"))


@query(f"SELECT item_id, array_to_string(list_slice({FIRST.format('x')}, 1, 12), ' ') AS terms FROM (SELECT item_id, list_filter({WORDS.format('text')}, lambda w: {TERM}) AS x FROM benchmark)")
def derive_terms(t):
    return t("benchmark").select("item_id", joined(T.terms(F.col("text"))).alias("terms"))


@query(f"""SELECT item_id, array_to_string(list_slice({FIRST.format('x')}, 1, 6), ',') AS pairs FROM (SELECT item_id, list_filter(list_transform(range(1, len(ws)), lambda i: CASE WHEN list_contains(ok, ws[i]) AND list_contains(ok, ws[i + 1]) THEN ws[i] || ' ' || ws[i + 1] END), lambda p: p IS NOT NULL) AS x
 FROM (SELECT item_id, ws, list_filter(ws, lambda w: {TERM}) AS ok FROM (SELECT item_id, {WORDS.format('text')} AS ws FROM benchmark)))""")
def title_bigrams(t):
    return t("benchmark").select("item_id", F.array_join(T.bigrams(F.col("text")), ",").alias("pairs"))


@query(f"""SELECT source, string_agg(term, ' ' ORDER BY doc_id, i) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS rn FROM (SELECT source, term, min(doc_id) AS doc_id, min_by(i, doc_id * 1000000 + i) AS i FROM
 (SELECT source, doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS i FROM (SELECT source, doc_id, {WORDS.format('text')} AS ws FROM documents)) WHERE length(term) >= 5 AND NOT list_contains({STOP}, term) GROUP BY 1, 2)) WHERE rn <= 14 GROUP BY source""")
def group_terms(t):
    """The first 14 distinct terms of a group's texts, in order. Places are summed up before the shuffle, so a large
    group costs as many rows as it has terms."""
    each = t("documents").select("source", "doc_id", F.posexplode(T.words(F.col("text"))).alias("i", "term")).where((F.length("term") >= 5) & ~F.col("term").isin(T.STOP))
    first = each.groupBy("source", "term").agg(F.min(F.struct("doc_id", "i")).alias("at"))
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("at"))).where("rn <= 14")
    return ranked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("x")).select("source", joined(F.transform("x", lambda x: x["term"])).alias("terms"))


@query(f"""SELECT p_partkey, array_to_string({FIRST.format('x')}, ' ') AS variants FROM (SELECT p_partkey, flatten(list_transform({WORDS.format('p_name')}, lambda w: [w, CASE WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, length(w) - 1) WHEN length(w) > 3 THEN w || 's' ELSE w END])) AS x FROM part)""")
def plural_variants(t):
    return t("part").select("p_partkey", joined(T.plural_variants(F.col("p_name"))).alias("variants"))


@query("SELECT doc_id, CASE WHEN length(text) > 220 THEN left(text, 217) || '…' ELSE text END AS shown FROM documents")
def ellipsize(t):
    return t("documents").select("doc_id", T.ellipsized(F.col("text"), 220).alias("shown"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace('RT @a_b: ' || text || ' https://t.co/Ab9', 'https?://t\.co/[A-Za-z0-9]+', '', 'g'), '^\s*(RT\s+)?(@[A-Za-z0-9_]+:?\s+)*', ''), '\s+', ' ', 'g')) AS clean FROM conversations")
def clean_text(t):
    return t("conversations").select("conv_id", "turn", T.clean_social(F.concat(F.lit("RT @a_b: "), "text", F.lit(" https://t.co/Ab9"))).alias("clean"))


@query(r"""SELECT item_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(translate('“' || text || ' ” – ok ( x ) !', '‘’“”–—' || chr(160), '''''""-- '), '\s+', ' ', 'g'), ' ([,.;:!?)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'))) AS quote FROM benchmark""")
def quote_norm(t):
    return t("benchmark").select("item_id", T.quote_norm(F.concat(F.lit("“"), "text", F.lit(" ” – ok ( x ) !"))).alias("quote"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def text_hash(t):
    return t("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query("SELECT priority, coalesce(label, 'other') AS label, n FROM (SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1) LEFT JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'soon'), ('5-LOW', 'later')) l(p, label) ON p = priority")
def label_map(t):
    orders = t("orders")
    labels = orders.sparkSession.createDataFrame([("1-URGENT", "now"), ("2-HIGH", "soon"), ("5-LOW", "later")], "priority string, label string")
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")).join(labels, "priority", "left").select("priority", F.coalesce("label", F.lit("other")).alias("label"), "n")


@query(r"SELECT doc_id, regexp_matches(text, '^[A-Z0-9]') AS opens, regexp_matches(text, '[.!?]$') AS closes, length(text) >= 40 AS long_enough FROM documents")
def quote_shape(t):
    text = F.col("text")
    return t("documents").select("doc_id", text.rlike("^[A-Z0-9]").alias("opens"), text.rlike(r"[.!?]\z").alias("closes"), (F.length(text) >= 40).alias("long_enough"))


@query(r"SELECT page_id, regexp_matches(url, '^https://[^/]+/.+') AS article_url, regexp_matches('news:p-' || page_id, '^news:[a-z0-9]+(-[a-z0-9]+)*$') AS slug FROM pages")
def id_shape(t):
    return t("pages").select("page_id", F.col("url").rlike("^https://[^/]+/.+").alias("article_url"), F.concat(F.lit("news:p-"), F.col("page_id").cast("string")).rlike("^news:[a-z0-9]+(-[a-z0-9]+)*$").alias("slug"))


def _guard_sql(c: str) -> str:
    out = f"lower({c})"
    for pattern, to in T.GUARD_STEPS:
        pattern, to = pattern.replace("'", "''"), to.replace("$1", r"\1").replace("$2", r"\2")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


SAMPLE = "CASE doc_id % 4 WHEN 0 THEN text || ' It''s >= 1,250,000 jobs; can''t reach 40% of A$5' WHEN 1 THEN text || ' about 3.5 million workers but not two billion.' WHEN 2 THEN text || ' 12,34 units ≤ $7 while ten won''t' ELSE text END"


def sample():
    """Whole texts with a sentence that the normal form has something to do on."""
    more = lambda x: F.concat("text", F.lit(x))
    k = F.col("doc_id") % 4
    return (
        F.when(k == 0, more(" It's >= 1,250,000 jobs; can't reach 40% of A$5"))
        .when(k == 1, more(" about 3.5 million workers but not two billion."))
        .when(k == 2, more(" 12,34 units ≤ $7 while ten won't"))
        .otherwise(F.col("text"))
    )


@query(f"SELECT doc_id, {_guard_sql(SAMPLE)} AS guard FROM documents")
def guard_norm(t):
    return t("documents").select("doc_id", T.guard_norm(sample()).alias("guard"))


SPLIT = f"list_filter(list_transform(regexp_split_to_array({_guard_sql(SAMPLE)}, ' [.;!?] ?| (?:but|although|though|whereas|while|however|yet) '), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len(c) AS BIGINT) AS n, c[1] AS first, c[-1] AS last FROM (SELECT doc_id, {SPLIT} AS c FROM documents)")
def clauses(t):
    return t("documents").select("doc_id", T.clauses(T.guard_norm(sample())).alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), F.try_element_at("c", F.lit(1)).alias("first"), F.try_element_at("c", F.lit(-1)).alias("last"))


_Q = T.QUANTITY
_NUMBERS = "CASE tok " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.NUMBER_WORDS.items()) + " END"
_UNITS = "CASE unit " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.MAGNITUDES.items()) + " END"


@query(f"""SELECT doc_id, place, tok, unit, coalesce(try_cast(tok AS DOUBLE), {_NUMBERS}) * {_UNITS} AS quantity FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS place, unnest(a) AS tok, unnest(b) AS unit
 FROM (SELECT doc_id, regexp_extract_all(g, '{_Q}', 1) AS a, list_transform(regexp_extract_all(g, '{_Q}', 2), lambda x: coalesce(x, '')) AS b FROM (SELECT doc_id, {_guard_sql(SAMPLE)} AS g FROM documents)))""")
def quantity_parse(t):
    """Every quantity of a text, in order."""
    g = t("documents").select("doc_id", T.guard_norm(sample()).alias("g"))
    return T.quantities(g, "doc_id", "g")


CONCEPTS = [("article", r"\b(the|le|la|der|die|el)\b"), ("thread", r"\bth[a-z]*ed\b"), ("ending", r"\b[a-z]+tion\b"), ("number", r"\b[0-9]+\b"), ("mail", r"\bmail[0-9]+ example com\b")]
UNLESS = [("article", r"\b(und|nicht)\b"), ("number", r"\bmail[0-9]+\b")]


def _tag_sql(c: str) -> str:
    rules = ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN '{n}' END" for n, p in CONCEPTS)
    gone = ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN '{n}' END" for n, p in UNLESS)
    return f"list_filter([{rules}], lambda x: x IS NOT NULL AND NOT coalesce(list_contains([{gone}], x), false))"


@query(f"SELECT doc_id, array_to_string({_tag_sql('n')}, ',') AS tags FROM (SELECT doc_id, {NORM.format('text')} AS n FROM documents)")
def concept_tags(t):
    return t("documents").select("doc_id", F.array_join(T.tags(F.col("text"), CONCEPTS, UNLESS), ",").alias("tags"))


THEMES = [("endings", r"\b[a-z]+(ing|ung|ment)\b"), ("numbers", r"\b[0-9]{2,}\b")]


@query(f"""SELECT lang, theme, count(*) AS n FROM (SELECT lang, unnest(CASE WHEN len(x) = 0 THEN ['default ' || lang] ELSE x END) AS theme FROM (SELECT lang, list_filter([CASE WHEN regexp_matches(n, '{THEMES[0][1]}') THEN 'endings' END, CASE WHEN regexp_matches(n, '{THEMES[1][1]}') THEN 'numbers' END], lambda x: x IS NOT NULL) AS x
 FROM (SELECT lang, {NORM.format('text')} AS n FROM documents))) GROUP BY 1, 2""")
def theme_tags(t):
    found = t("documents").select("lang", T.tags(F.col("text"), THEMES).alias("x"))
    theme = F.explode(F.when(F.size("x") == 0, F.array(F.concat(F.lit("default "), "lang"))).otherwise(F.col("x")))
    return found.select("lang", theme.alias("theme")).groupBy("lang", "theme").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, CAST(2 * (contains(n, ' of the ')::INT + contains(n, ' de la ')::INT) + (contains(n, ' thing ') OR contains(n, ' things '))::INT + (contains(n, ' ment ') OR contains(n, ' ments '))::INT AS BIGINT) AS score FROM (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS n FROM documents)""")
def theme_score(t):
    return t("documents").select("doc_id", T.theme_score(F.col("text"), ["of the", "de la"], ["thing", "ment"]).alias("score"))


MILESTONE = r"([0-9]+) percent"


@query(f"SELECT doc_id, CAST(list_max(list_concat(list_transform(regexp_extract_all(g, '([0-9]+) percent', 1), lambda x: CAST(x AS INT)), [CASE WHEN contains(g, 'million') THEN 51 END, CASE WHEN contains(g, 'at least') THEN 25 END])) AS BIGINT) AS level FROM (SELECT doc_id, {_guard_sql(SAMPLE)} AS g FROM documents)")
def milestone_level(t):
    g = t("documents").select("doc_id", T.guard_norm(sample()).alias("g"))
    numbers = F.transform(F.regexp_extract_all("g", F.lit(MILESTONE), F.lit(1)), lambda x: x.cast("int"))
    phrases = F.array(F.when(F.contains("g", F.lit("million")), 51), F.when(F.contains("g", F.lit("at least")), 25))
    return g.select("doc_id", F.array_max(F.concat(numbers, phrases)).cast("long").alias("level"))


@query(f"SELECT branch, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(n, '\\b(not|nicht|pas)\\b') THEN 'negated' WHEN regexp_matches(n, '\\b(will|would|werden)\\b') THEN 'managed' ELSE 'unspecified' END AS branch FROM (SELECT {NORM.format('text')} AS n FROM documents)) GROUP BY branch")
def branch_tag(t):
    n = T.norm(F.col("text"))
    branch = F.when(n.rlike(r"\b(not|nicht|pas)\b"), "negated").when(n.rlike(r"\b(will|would|werden)\b"), "managed").otherwise("unspecified")
    return t("documents").groupBy(branch.alias("branch")).agg(F.count("*").alias("n"))


# --- scans ------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(2026 + doc_id % 15 AS BIGINT) AS year, (2026 + doc_id % 15) || '-' || (row_number() OVER (PARTITION BY doc_id % 15 ORDER BY doc_id) - 1) AS claim_id, doc_id FROM documents")
def claims_flatten(t):
    """Events of years, one row a claim; its id tells the year and the place in it."""
    events = t("documents").select((2026 + F.col("doc_id") % 15).alias("year"), "doc_id")
    return S.numbered_claims(events, "year", "doc_id").select("year", "claim_id", "doc_id")


@query("SELECT CASE WHEN value < 1 THEN 'malformed' WHEN user_id % 50 = 0 THEN 'retired' ELSE 'kept' END AS outcome, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS registered FROM events GROUP BY 1")
def scan_census(t):
    reason = F.when(F.col("value") < 1, "malformed").when(F.col("user_id") % 50 == 0, "retired")
    return S.census(t("events"), reason)


@query("SELECT o_custkey AS source, count(*) AS n, count(DISTINCT o_orderkey) AS ids, min(o_orderdate) IS NOT NULL AS dated FROM orders GROUP BY 1")
def ledger_scan(t):
    return t("orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"), F.min("o_orderdate").isNotNull().alias("dated"))


@query("SELECT o_custkey AS source, o_orderkey AS claim FROM orders")
def mapping_explode(t):
    groups = S.ledger_groups(t("orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("id")), "source", "id")
    return S.mappings(groups, "source", "ids")


# --- rules over text --------------------------------------------------------------------------------------------------


@query(f"SELECT sig, n FROM (SELECT sha256({NORM.format('text')}) AS sig, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def dup_signature(t):
    return t("documents").groupBy(F.sha2(T.norm(F.col("text")), 256).alias("sig")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"SELECT family, n FROM (SELECT family, count(*) AS n FROM (SELECT unnest({_tag_sql('n')}) || ' ' || lang AS family FROM (SELECT lang, {NORM.format('text')} AS n FROM documents)) GROUP BY 1) WHERE n > 1")
def family_unique(t):
    """Families that more than one row claims to be."""
    found = t("documents").select("lang", F.explode(T.tags(F.col("text"), CONCEPTS, UNLESS)).alias("tag"))
    return found.groupBy(F.concat_ws(" ", "tag", "lang").alias("family")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT doc_id, missing FROM (SELECT doc_id, unnest(['the', 'und', 'de la']) AS missing, text FROM documents) WHERE NOT contains(lower(text), missing)")
def required_content(t):
    """Rows that lack a phrase they must mention. The rules are a few literals."""
    rules = F.explode(F.array(*map(F.lit, ("the", "und", "de la"))))
    rows = t("documents").select("doc_id", "text", rules.alias("missing"))
    return rows.where(~F.contains(F.lower("text"), F.col("missing"))).select("doc_id", "missing")


@query("SELECT a.doc_id, sha256(a.text) = sha256(b.text) AS same FROM documents a JOIN (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN text || ' ' ELSE text END AS text FROM documents) b ON a.doc_id = b.doc_id")
def text_pin(t):
    """Texts beside pinned ones; only hashes travel."""
    now = t("documents").select("doc_id", F.sha2("text", 256).alias("a"))
    pinned = t("documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("b"))
    return now.join(pinned, "doc_id").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))
