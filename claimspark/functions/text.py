"""Column functions over text; all native expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that name nothing by themselves.
STOP = ["about", "after", "again", "also", "been", "before", "being", "between", "both", "could", "does", "down", "each", "even", "ever", "from", "have", "having", "here", "into", "just", "less", "like", "made", "make", "many", "more", "most", "much", "must", "only", "other", "over", "same", "should", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "under", "until", "upon", "very", "were", "what", "when", "where", "which", "while", "will", "with", "within", "without", "would", "your"]


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once a row, however often f uses it: Spark would write it out at each place."""
    return F.element_at(F.transform(F.array(c), f), 1)


def norm(c: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 as one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    return F.array_remove(F.split(norm(c), " "), "")


def is_term(w: Column, keep: list[str] = ()) -> Column:
    """Four characters or more and no stop word, or in the keep list."""
    return ((F.length(w) >= 4) & ~w.isin(STOP)) | w.isin(list(keep) or [""])


def terms(c: Column, most: int = 12, keep: list[str] = ()) -> Column:
    """The first `most` distinct terms, in order."""
    return F.slice(F.array_distinct(F.filter(words(c), lambda w: is_term(w, keep))), 1, most)


def bigrams(c: Column, most: int = 6) -> Column:
    """The first `most` distinct pairs of neighbouring words that are both terms."""
    w = words(c)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(is_term(a) & is_term(b), F.concat_ws(" ", a, b)))
    return F.slice(F.array_distinct(F.array_compact(pairs)), 1, most)


def plural_variants(c: Column) -> Column:
    """Each word that isn't a stop word, and its form with or without a final s."""
    other = lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("s")), F.substring(w, F.lit(1), F.length(w) - 1)).when(F.length(w) > 3, F.concat(w, F.lit("s"))).otherwise(w)
    kept = F.filter(words(c), lambda w: ~w.isin([*STOP, "ai"]))
    return F.array_distinct(F.flatten(F.transform(kept, lambda w: F.array(w, other(w)))))


def ellipsized(c: Column, most: int) -> Column:
    """Cut to `most` characters, three of them for the sign of the cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("…"))).otherwise(c)


def clean_social(c: Column) -> Column:
    """Short links, a leading RT and mentions go; white space is single."""
    c = F.regexp_replace(c, r"https?://t\.co/[A-Za-z0-9]+", "")
    c = F.regexp_replace(c, r"^\s*(RT\s+)?(@[A-Za-z0-9_]+:?\s+)*", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def quote_norm(c: Column) -> Column:
    """Curly quotes, dashes and no-break spaces plain, white space single, none before closing or after opening signs,
    lower case."""
    c = F.translate(c, "‘’“”–— ", "''\"\"-- ")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r" ([,.;:!?)\]])", "$1"), r"([(\[]) ", "$1")
    return F.lower(F.trim(c))


#: In this order, each on the result of the one before: (pattern, replacement) for what claims measure.
GUARD_STEPS = [
    (r"won't\b", "will not"), (r"can't\b", "can not"), (r"n't\b", " not"), (r"'(re|ve|ll|d|m|s)\b", ""),
    (r"(\d),(\d{3})\b", "$1$2"), (r"(\d),(\d{3})\b", "$1$2"), (r"\d+(,\d+)+", "invalidnumber"),
    (r"≤|<=", " at most "), (r"≥|>=", " at least "), (r"<", " less than "), (r">", " more than "),
    (r"\b(a|c|nz|hk)\$", " nonusd "), (r"\$", " usd "), (r"€", " eur "), (r"£", " gbp "), (r"%", " percent "),
    (r"[^a-z0-9.;!? ]+", " "), (r"([.;!?])( |$)", " $1 "), (r" +", " "),
]


def guard_norm(c: Column) -> Column:
    """Claim text with contractions, thousands, comparisons, currencies and percents spelled one way."""

    def step(x: Column, of: tuple[str, str]) -> Column:
        pattern, by = of
        signs = pattern.replace("\\$", "$").split("|")
        if any(set(s) & set(r"\[](){}.*+?^") or s == "" for s in signs):
            return F.regexp_replace(x, pattern, by)
        return reduce(lambda y, s: F.replace(y, F.lit(s), F.lit(by)), signs, x)  # signs of their own need no search by pattern

    quoted = [s for s in GUARD_STEPS if "'" in s[0]]
    rest = [s for s in GUARD_STEPS if s not in quoted]
    spelled = once(F.lower(c), lambda x: F.when(F.contains(x, F.lit("'")), reduce(step, quoted, x)).otherwise(x))
    return F.trim(reduce(step, rest, spelled))


def clauses(c: Column) -> Column:
    """Parts of a guard_norm() text between sentence signs and contrast words; decimal points stay."""
    parts = F.split(c, r" [.;!?] ?| (?:but|although|though|whereas|while|however|yet) ")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


MAGNITUDES = {"m": 1e6, "million": 1e6, "millions": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "billions": 1e9, "t": 1e12, "trillion": 1e12, "trillions": 1e12, "k": 1e3, "thousand": 1e3, "thousands": 1e3, "": 1.0}
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dozen": 12, "hundred": 100}
QUANTITY = r"\b([0-9]+(?:\.[0-9]+)?|one|two|three|four|five|six|seven|eight|nine|ten|dozen|hundred) ?(millions?|billions?|trillions?|thousands?|bn|[mbtk])?\b"


def _mapped(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, float(v)))), key)


def quantity(token: Column, unit: Column) -> Column:
    """A number in digits or words times its magnitude; null for anything else."""
    return F.coalesce(F.try_cast(token, "double") if hasattr(F, "try_cast") else token.try_cast("double"), _mapped(NUMBER_WORDS, token)) * _mapped(MAGNITUDES, unit)


def quantities(rows: DataFrame, key: str, guard: str) -> DataFrame:
    """(key, place, tok, unit, quantity): every quantity of a guard_norm() text, in order from 1; unit is empty for none."""
    parts = F.arrays_zip(F.regexp_extract_all(guard, F.lit(QUANTITY), F.lit(1)).alias("tok"), F.regexp_extract_all(guard, F.lit(QUANTITY), F.lit(2)).alias("unit"))
    found = rows.select(key, F.posexplode(parts).alias("p", "x")).select(key, (F.col("p") + 1).cast("long").alias("place"), F.col("x.tok").alias("tok"), F.coalesce("x.unit", F.lit("")).alias("unit"))
    return found.withColumn("quantity", quantity(F.col("tok"), F.col("unit")))


def theme_score(c: Column, phrases: list[str], singles: list[str]) -> Column:
    """Two points for each phrase held, one for each word held, plain or plural."""

    def points(t: Column) -> Column:
        has = lambda x: F.contains(t, F.lit(f" {x} "))
        each = [F.when(has(p), 2).otherwise(0) for p in phrases] + [F.when(has(w) | has(w + "s"), 1).otherwise(0) for w in singles]
        return sum(each[1:], each[0]).cast("long")

    return once(F.concat(F.lit(" "), norm(c), F.lit(" ")), points)


def tags(c: Column, rules: list[tuple[str, str]], unless: list[tuple[str, str]] = ()) -> Column:
    """Names of the patterns that norm() text holds, in rule order, less each (name, pattern) of `unless` that holds."""
    named = lambda t, of: F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(t.rlike(p), n) for n, p in of)))
    return once(norm(c), lambda t: F.array_except(named(t, rules), named(t, unless)))


def touches(term: Column, topic: Column) -> Column:
    """Whether any word of a term, or its singular, is in topic, an array of plural_variants()."""
    return F.exists(F.split(term, " "), lambda w: F.array_contains(topic, w) | F.array_contains(topic, F.regexp_replace(w, "s$", "")))


def merged_terms(is_headline: Column, curated: Column, derived: Column, topic: Column) -> Column:
    """A headline row's curated terms that touch its topic, then the derived ones, once each; other rows' derived terms."""
    return F.when(is_headline, F.array_distinct(F.concat(F.filter(curated, lambda t: touches(t, topic)), derived))).otherwise(derived)


def short_publisher(c: Column) -> Column:
    """What stands before ` | `."""
    return F.element_at(F.split(c, r" \| "), 1)
