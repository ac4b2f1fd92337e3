"""The prefix trie by the Euler tour beside a trie walked in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from claimspark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth long"


def sequences(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in by.items()}


def rebuild(rows):
    by = sequences(rows)
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = by.get(base, [])[:h] + own[h:]
    return out


def brute(by):
    members = defaultdict(list)
    for c, seq in sorted(by.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        childless = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        ends = ",".join(str(c) for c in cs if len(by[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        children = sum(len(k) == len(key) + 1 for k in below)
        out.append((cs[0], len(key), members[key[:-1]][0] if key else None, len(cs), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    rows = df.collect()
    n = len(rows)
    assert sorted(x for r in rows for x in (r["enter_rank"], r["exit_rank"])) == list(range(2 * n))  # each place of the tour once
    return sorted((tuple(r)[:8] for r in rows), key=str)


def some(seed, n):
    random.seed(seed)
    rows = []
    for _ in range(n):
        c = random.choice((random.randrange(-150, 250), random.randrange(0, 3000)))
        for turn in range(random.choice((0, 1, 2, 3, 5, 9))):
            rows.append((c, random.choice((turn, turn, None)), random.choice(("user", "user", "assistant", None)), random.choice(("é", "\U0001f600x", "", None, "yes", "ab", "a" * 50))))
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_matches_brute_force(conversations, monkeypatch):
    rows = some(3, 160) + [(7, 1, "user", "same")] * 3 + [(None, 0, "user", "no id"), (None, None, None, None)]
    rows += [(100 + i, t, "user", f"t{t}") for i in range(40) for t in range(6)] + [(5000, t, "a", "long") for t in range(300)]
    assert result(tries.rebuilt_trie(conversations(rows))) == brute(rebuild(rows))
    monkeypatch.setattr(tries, "BLOCK", 60)  # several rounds, by ranges and by chance
    monkeypatch.setattr(tries, "POOR", 0.3)
    monkeypatch.setattr(tries, "STRETCH", 4)
    assert result(tries.prefix_trie(conversations(rows))) == brute(sequences(rows))


def test_small_and_empty(conversations):
    assert tries.rebuilt_trie(conversations([])).count() == 0
    assert tries.prefix_trie(conversations([(None, 1, "user", "x")])).count() == 0
    for rows in ([(3, None, None, None)], [(100, 0, "user", "x" * 200_000)], [(c, 0, "u", "x") for c in range(100, 140)]):
        assert result(tries.rebuilt_trie(conversations(rows))) == brute(rebuild(rows))
        assert result(tries.prefix_trie(conversations(rows))) == brute(sequences(rows))


def test_list_without_locality(spark, monkeypatch):
    """A list in random order, on which ranges alone would hardly get on."""
    random.seed(8)
    order = random.sample(range(1000), 400)
    arcs = [(h, n, 1, i % 3, i) for i, (h, n) in enumerate(zip(order, [*order[1:], None], strict=True))]
    got = tries.list_ranked(spark.createDataFrame(arcs, "head long, next long, rank long, leaves long, saved long"), 400, 50).collect()
    assert sorted(tuple(r) for r in got) == sorted((h, i, sum(j % 3 for j in range(i)), i * (i - 1) // 2) for i, h in enumerate(order))


def test_digest_ranges(spark):
    ids = list(range(-5000, 9000, 7))
    ends = spark.createDataFrame([(1, 2, c % 2, c) for c in ids], "depth long, k1 long, k2 long, conv_id long")
    got = {r["k2"]: r["ends_sha256"] for r in tries.digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for c in ids if c % 2 == k).encode()).hexdigest() for k in (0, 1)}
