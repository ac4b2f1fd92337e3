"""Min-max hashing, its linking and components beside brute force."""

import random
from itertools import combinations

import numpy as np

from claimspark.llm import common, minhash

from .conftest import by_id


def brute(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split() if t else []
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def test_matches_brute_force(docs_of, words):
    random.seed(5)
    rows, base = [], words(120, 3)
    for d in range(60):  # a group whose pairs lie on both sides of the threshold
        w = list(base)
        for i in random.sample(range(120), d % 9):
            w[i] = f"x{d}y{i}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(words(80, 50 + d % 7))) for d in range(20)]  # exact copies
    rows += [(200, None), (201, ""), (202, "two words"), (203, "TWO words"), (204, "  \n ")]
    for k, percent in ((4, 80), (5, 80)):
        got = by_id(minhash.near_duplicates(docs_of(rows), k, percent), "n_shingles", "component_id", "kept")
        assert got == brute(rows, k, percent)


def test_awkward(awkward, docs_of):
    rows = [tuple(r) for r in minhash.near_duplicates(awkward).collect()]
    assert len(rows) == 11  # the repeated row is one
    assert sorted((r for r in rows if r[0] is None), key=str) == [(None, 0, None, True), (None, 1, None, True)]
    got = {r[0]: r[1:] for r in rows}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[6][1:] == (5, False) and got[8] == (1, 8, True)
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_slices_of_a_large_cluster(docs_of, words, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_IDS", 7)
    rows = [(d, " ".join([*words(60, 1), f"end{d}"])) for d in range(30)]
    got = by_id(minhash.near_duplicates(docs_of(rows)), "component_id")
    assert set(got.values()) == {0}


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(root[k] == k for k in root.keys() - got.keys())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimate_is_unbiased():
    """Agreement of minima and of maxima both estimate the similarity."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    a, b = minhash.signature(values[:1200]), minhash.signature(values[300:])
    assert abs((a == b).mean() - 0.6) < 0.08
    assert abs((a == b)[:, 0].mean() - 0.6) < 0.12 and abs((a == b)[:, 1].mean() - 0.6) < 0.12


def test_runs_round_trip():
    rng = np.random.default_rng(2)
    keys, ids = rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(0, 50, 1000)
    import pyarrow as pa

    table = pa.Table.from_batches([common.runs(keys, ids, 5)])
    assert table.num_rows <= 5
    k, i = common.merged(table)
    assert sorted(zip(k.tolist(), i.tolist(), strict=True)) == sorted(set(zip(keys.tolist(), ids.tolist(), strict=True)))
    assert common.runs(keys[:0], ids[:0], 5).num_rows == 0


def test_myers():
    def distance(a, b, inside):
        row = [0 if inside else j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row) if inside else row[-1]

    random.seed(4)
    for _ in range(300):
        a, b = ("".join(random.choices("abc", k=random.randrange(1, 90))) for _ in range(2))
        for inside in (False, True):
            assert common.myers(common.pattern_masks(a), len(a), b, inside)[0] == distance(a, b, inside)
