"""Ranked search by max-sketches beside a brute-force ranking of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from claimspark.llm import sketches

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total, df = len(counts), sum(c.total() for _, c in counts), Counter(w for _, c in counts for w in c)
    out = []
    for item_id, text in items:
        best = {}
        for d, c in counts:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if d is not None and s > 0:
                best[d] = max(s, best.get(d, 0))
        out += [(item_id, i + 1, d, s) for i, (d, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_matches_brute_force(docs_of, items_of, words):
    random.seed(2)
    vocabulary = words(400, 7)
    rows = [(d, " ".join(random.choice(vocabulary[: 40 + 9 * (d % 40)]) for _ in range(random.randrange(1, 300)))) for d in range(300)]
    rows += [(1000 + d, rows[5][1]) for d in range(70)]  # ties across the 50th place
    rows += [(d, "Émile's TIME, ÀB x_y 3.14 naïve") for d in (2000, 2001, None)] + [(2002, None), (2003, ""), (2004, "!! --")]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(20))) for i in range(12)] + [(20, rows[5][1]), (21, None), (22, "unheard of"), (23, "À naïve 14 X"), (24, "àb"), (20, "time"), (None, "time")]
    for k in (50, 3):
        got = sorted((tuple(r) for r in sketches.search(docs_of(rows), items_of(items), k).collect()), key=str)
        assert got == brute(rows, items, k)


def test_awkward(awkward, docs_of, items_of, words):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = [(1, "one same row ID"), (2, " ".join(words(3000, 1))), (3, "")]
    got = sorted((tuple(r) for r in sketches.search(awkward, items_of(items)).collect()), key=str)
    assert got == brute(rows, items)
    assert sketches.search(docs_of([]), items_of(items)).count() == 0
    assert sketches.search(docs_of([(1, None)]), items_of(items)).count() == 0
    assert sketches.search(awkward, items_of([])).count() == 0


def test_blocks_and_stored_index(docs_of, items_of, words, monkeypatch):
    from claimspark.llm import common

    docs = docs_of([(d, " ".join(words(50, d % 9))) for d in range(60)])
    items = [(i, " ".join(words(10, i))) for i in range(9)]
    index = common.saved(sketches.index(docs))
    monkeypatch.setattr(sketches, "BLOCK_TERMS", 25)
    monkeypatch.setattr(sketches, "BROADCAST_ROWS", 0)
    got = sorted((tuple(r) for r in sketches.search(docs, items_of(items), 5, index).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items, 5)


@pytest.mark.parametrize("bits", [1, 5, 8, 26])
def test_bounds_hold_where_terms_collide(words, monkeypatch, bits):
    random.seed(1)
    monkeypatch.setattr(sketches, "BITS", bits)
    vocabulary = [w.encode() for w in words(900, 3)]
    block = sketches.Block([list(set(random.sample(vocabulary, 30))) for _ in range(20)], {w: random.randrange(0, 90) for w in vocabulary}, 100, 50_000)
    loose = 0
    for size in (1, 5, 500, 70_000) * 8:
        counts = Counter(random.choices(vocabulary, k=size))
        bounds = block.bounds(counts.total(), *sketches.unsketched(sketches.sketch(counts)))
        scores = [block.score(counts, counts.total(), q) for q in range(20)]
        assert all(b >= s for b, s in zip(bounds, scores, strict=True))
        loose += any(b > s for b, s in zip(bounds, scores, strict=True))
    assert loose if bits < 20 else not loose
