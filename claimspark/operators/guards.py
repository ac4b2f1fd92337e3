"""Guards: what a text must and must not hold to support claims whose titles a rule selects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text as T
from claimspark.operators.tables import large

#: Rules that one job compiles; they are sent to every task.
MOST_RULES = 10_000


@dataclass(frozen=True)
class Guard:
    """Claims whose normalised title matches `selector`, of these domains (None: any), need texts that `tree` holds for: a
    pattern, or ("all" | "any" | "none", trees), or ("fact", name) for a name among the text's facts."""

    selector: str
    tree: str | tuple
    domains: tuple[str, ...] | None = None


def checked(guards: list[Guard]) -> list[Guard]:
    """guards, or ValueError for a table without rules, a node without conditions or a pattern that doesn't compile: each of
    these would let texts pass unseen."""

    def check(tree: str | tuple) -> None:
        if isinstance(tree, str):
            if not tree:
                raise ValueError("a guard has an empty pattern")
            re.compile(tree)
        elif not tree[1] or tree[0] not in ("all", "any", "none", "fact"):
            raise ValueError(f"a guard has no conditions: {tree!r}")
        elif tree[0] != "fact":
            for part in tree[1]:
                check(part)

    if not guards:
        raise ValueError("the table of guards is empty")
    if len(guards) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} guards")
    for g in guards:
        check(g.selector)
        check(g.tree)
    return guards


def from_table(rules: DataFrame) -> list[Guard]:
    """Guards of a table (selector, domains, all, any, none): arrays of patterns; null for no such condition or domain. An
    empty array is an error, and so is a rule without conditions."""
    found = []
    for r in rules.orderBy("selector").limit(MOST_RULES + 1).collect():
        parts = [(kind, tuple(r[kind])) for kind in ("all", "any", "none") if r[kind] is not None]
        found.append(Guard(r["selector"], ("all", tuple(parts)), None if r["domains"] is None else tuple(r["domains"])))
    return checked(found)


def anchors(pattern: str) -> frozenset[str] | None:
    """Literals one of which any match of the pattern holds; None if no such set is known."""

    def better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
        return max((x for x in (a, b) if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)

    def of(nodes) -> frozenset[str] | None:
        best, run = None, ""
        for kind, value in nodes:
            name = str(kind)
            if name == "LITERAL":
                run += chr(value)
                continue
            if name == "AT":  # no width: what stands around it is one run
                continue
            best, run = better(best, frozenset([run]) if run else None), ""
            if name == "SUBPATTERN":
                best = better(best, of(value[-1]))
            elif name == "BRANCH":
                parts = [of(p) for p in value[1]]
                best = better(best, frozenset().union(*parts) if all(parts) else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
                best = better(best, of(value[2]))
        return better(best, frozenset([run]) if run else None)

    return of(re._parser.parse(pattern))


class Patterns:
    """Numbered patterns, and an automaton over their anchors: one pass over a text says which of them need a try."""

    def __init__(self, patterns: list[str]):
        self.patterns = [re.compile(p) for p in patterns]
        found = [anchors(p) for p in patterns]
        self.always = [i for i, a in enumerate(found) if not a]
        self.by_anchor: dict[str, list[int]] = {}
        for i, a in enumerate(found):
            for literal in a or ():
                self.by_anchor.setdefault(literal, []).append(i)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for literal, ids in self.by_anchor.items():
            a.add_word(literal, ids)
        if self.by_anchor:
            a.make_automaton()
        return a

    def hits(self, automaton, text: str) -> set[int]:
        to_try = set(self.always)
        if self.by_anchor:
            for _, ids in automaton.iter(text):
                to_try.update(ids)
        return {i for i in to_try if self.patterns[i].search(text)}


def _holds(tree: str | tuple, number: dict[str, int], hits: set[int], facts: set[str]) -> bool:
    if isinstance(tree, str):
        return number[tree] in hits
    kind, parts = tree
    if kind == "fact":
        return parts in facts
    results = (_holds(p, number, hits, facts) for p in parts)
    return all(results) if kind == "all" else any(results) if kind == "any" else not any(results)


def _leaves(tree: str | tuple) -> Iterator[str]:
    if isinstance(tree, str):
        yield tree
    elif tree[0] != "fact":
        for part in tree[1]:
            yield from _leaves(part)


def judged(texts: DataFrame, key: str, trees: list[str | tuple], wanted: bool) -> DataFrame:
    """(key, rules) of texts (key, n normalised, facts array): the numbers of the trees that hold for it, or that don't."""
    patterns = sorted({p for t in trees for p in _leaves(t)})
    number, compiled = {p: i for i, p in enumerate(patterns)}, Patterns(patterns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled.automaton()
        for b in batches:
            out = []
            for text, facts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hits = compiled.hits(automaton, text)
                out.append([i for i, t in enumerate(trees) if _holds(t, number, hits, set(facts or ())) == wanted])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=[key, "rules"])

    return texts.select(key, "n", "facts").mapInArrow(rows, f"{key} {texts.schema[key].dataType.simpleString()}, rules array<int>")


def asked(claims: DataFrame, guards: list[Guard]) -> DataFrame:
    """(claim_id, asks): the numbers of the rules that select each claim (claim_id, title, domain); none a null title."""
    none = F.array().cast("array<string>")
    titles = claims.select("claim_id", F.coalesce(T.norm(F.col("title")), F.lit("")).alias("n"), none.alias("facts"))
    allowed = F.array_compact(F.array(F.lit(None).cast("int"), *(F.when(F.lit(True) if g.domains is None else F.col("domain").isin(list(g.domains)), i) for i, g in enumerate(guards))))
    return judged(titles, "claim_id", [g.selector for g in guards], True).join(claims.select("claim_id", allowed.alias("allowed")), "claim_id").select("claim_id", F.array_intersect("rules", "allowed").alias("asks"))


def lacking(posts: DataFrame, wanted: DataFrame, guards: list[Guard]) -> DataFrame:
    """(post_id, lacks): the numbers of the rules that don't hold for posts (post_id, text, and facts if guards ask for
    them), of those in wanted (post_id)."""
    none = F.array().cast("array<string>")
    texts = posts.join(large(wanted).select("post_id").distinct(), "post_id", "left_semi")
    facts = F.coalesce("facts", none) if "facts" in posts.columns else none
    return judged(texts.select("post_id", F.coalesce(T.norm(F.col("text")), F.lit("")).alias("n"), facts.alias("facts")), "post_id", [g.tree for g in guards], False).withColumnRenamed("rules", "lacks")


def guarded(pairs: DataFrame, claims: DataFrame, posts: DataFrame, guards: list[Guard]) -> DataFrame:
    """Pairs (claim_id, post_id, …) with passes: of claims (claim_id, title, domain) and posts (post_id, text, and facts if
    guards ask for them).

    Every rule that selects the claim must hold for the text. Rules are tried once a title and once a text, by one pass of
    an automaton and the patterns that it calls for; pairs carry short lists of rules, no texts. A null title selects no
    rule; a null text is an empty one, of which only what mustn't be there holds. ValueError as in checked()."""
    checked(guards)
    met = large(large(pairs).join(asked(claims, guards), "claim_id")).join(lacking(posts, pairs, guards), "post_id")
    return met.select(*pairs.columns, (~F.arrays_overlap("asks", "lacks")).alias("passes"))
