"""Certified packing beside the tokenizer itself, valid sequences, and brute force over small cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from claimspark.llm import packing
from claimspark.llm.queries import op13_certified_packing

from .conftest import SF


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(tokenizer, rows, capacity=2048):
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out += [(doc_id, at // capacity, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for at in range(0, len(ids), capacity)]
    return sorted(out, key=str)


def valid(rows, capacity=2048):
    """Every sequence is full of its pieces from 0 on, without gaps or overlaps."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_query_matches_tokenizer(spark, tokenizer):
    rows = op13_certified_packing(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected(tokenizer, docs)
    lengths = np.array([r["length"] for r in rows])
    assert valid(rows) - packing.least_bins(lengths, np.ones(len(rows), int)) <= 1


def test_odd_texts(spark, docs_of, awkward, tokenizer):
    odd = ["Á é x y", "<|endoftext|>in<|startoftext|> <|ENDOFTEXT|>", "ΣΑΣ σας'S I'LL", "a\x1cb\x85c d", "x" * 5000, "a\x01b \x01 \x01\x01 c", "́ ́a", "1234 !!?? \U0001f600‍", " \n\t", "İİ"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1, odd[1]), (None, "no id"), (9, None)]
    got = packing.pieces(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(tokenizer, rows)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = packing.pack(packing.pieces(awkward)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(tokenizer, rows)
    valid(got)
    assert packing.pack(packing.pieces(docs_of([]))).count() == 0


def test_latin_words_skip_rules(tokenizer):
    """Words of Latin letters take the short way, with the tokenizer's ids, also when they come again after others."""
    random.seed(8)
    letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha()]
    texts = [None, "", " ".join(letters)] + [" ".join("".join(random.choice(letters) for _ in range(random.randrange(1, 9))) + random.choice(["", ".", ",!", "µ", "\u0301"]) for _ in range(300)) for _ in range(20)]
    encoder = packing.Encoder(packing.MODEL)
    assert encoder.plain is not None
    for _ in range(2):
        ids, ends = encoder.ids(pa.array(texts, pa.string()))
        encoder.former, encoder.known = encoder.known, {b"": b""}
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_exchange(spark, monkeypatch):
    """Partitions that waste room give up pieces: after the rounds there are nearly as few sequences as the bound."""
    random.seed(4)
    for sizes in ([random.randrange(1, 100) for _ in range(3000)], [random.choice((34, 35, 51, 66)) for _ in range(2000)], [random.randrange(30, 60) for _ in range(2000)], [7] * 1000):
        rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], packing.PIECE)
        got = packing.pack(rows, capacity=100, per_task=200).collect()
        assert len(got) == len(sizes) and {r["doc_id"] for r in got} == set(range(len(sizes)))
        bound = packing.least_bins(np.array(sizes), np.ones(len(sizes), int), 100)
        whole = len(packing.best_fit(np.array(sizes), 100)[2])
        assert bound <= valid(got, 100) <= max(whole, bound) * 1.02 + 1
        assert packing.certificate(spark.createDataFrame(got), 100) == (valid(got, 100), bound)


def fewest(sizes, capacity):
    """Brute force: pieces one by one into each open bin or a new one."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_bound_and_best_fit_beside_brute_force():
    random.seed(9)
    exact = 0
    for _ in range(150):
        capacity = random.choice((10, 12, 17, 30))
        sizes = sorted((random.randrange(1, capacity + 1) for _ in range(random.randrange(1, 9))), reverse=True)
        least, bound = fewest(sizes, capacity), packing.least_bins(np.array(sizes), np.ones(len(sizes), int), capacity)
        used = len(packing.best_fit(np.array(sizes), capacity)[2])
        assert bound <= least <= used
        exact += bound == least
    assert exact > 130
