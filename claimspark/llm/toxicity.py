"""Toxicity by noisy-channel deobfuscation: suspicious tokens become lattices of what each character may stand for, a
character language model counted over the whole corpus picks the path, and the restored words are scored."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Labelled documents, at most, of each label that the classifier is fitted on; those of smallest hash are taken.
TRAIN_ROWS = 3000
#: A feature needs so many toxic documents, and so many standard deviations above what chance gives.
LEAST_DOCUMENTS, LEAST_Z = 4, 5.0
#: Word beginnings of these lengths are features beside the word.
PREFIXES = (4, 5, 6, 7)

# fixed values: what a character may be written for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that may stand for any letter between two others.
MASKS = "*#_"
#: Costs (negative log chances) of writing a letter as a sign, of a sign that stands for nothing, and of a mask.
AS_SIGN, AS_NOISE, AS_MASK = 1.5, 1.0, 0.5

_TOKEN = re.compile(r"\S+")
_L, _SIGNS = "a-zÀ-ɏ", "0-9@$!|+(<€£¡"
#: Letters with other signs between, a run of these with a sign of LEET before a letter (tried once a run), and the like.
_SUSPECT = re.compile(rf"[{_L}][^{_L}\s'’-]++[{_L}]|(?<![^{_L}\s])(?=[^{_L}\s]++[{_L}])[^{_L}\s]*?[{_SIGNS}]|[{_L}][0-9@$|+]|([{_L}])\1\1|[{_L}][_*.'’-][{_L}][_*.'’-][{_L}]")
_MASKED = re.compile(rf"[a-zÀ-ɏ][{re.escape(MASKS)}]+[a-zÀ-ɏ]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ \t._*-]{1,2}){3,}[^\W_](?![\w])")


def bare(token: str) -> str:
    """A token without what is no letter or digit at its ends."""
    start, stop = 0, len(token)
    while start < stop and not token[start].isalnum():
        start += 1
    while stop > start and not token[stop - 1].isalnum():
        stop -= 1
    return token[start:stop]


# --- alphabet of the language model -----------------------------------------------------------------------------------

#: a-z, space, and one sign for all else; accents are taken off.
LETTERS = "abcdefghijklmnopqrstuvwxyz "
OTHER = len(LETTERS)
SIZE = OTHER + 1


def _classes() -> np.ndarray:
    out = np.full(0x250, OTHER, np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        if base in LETTERS and base:
            out[c] = LETTERS.index(base)
    out[[9, 10, 11, 12, 13, 160]] = LETTERS.index(" ")
    return out


CLASSES = _classes()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(codes, 0x24F)] if len(codes) else np.empty(0, np.uint8)


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts, SIZE ** 3 numbers however large the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for text in b.column(0):
                c = classes(" " + (text.as_py() or "") + " ").astype(np.int32)
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3) if len(c) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(C.tidied(count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


class Restorer:
    """The channel and the language model: restore() gives the likeliest letters behind a token."""

    def __init__(self, counts: np.ndarray):
        grams = counts.reshape(SIZE, SIZE, SIZE)
        pairs, ones = grams.sum(0), grams.sum((0, 1))
        one = (ones + 1) / (ones.sum() + SIZE)
        two = (pairs + 20 * one) / (pairs.sum(1, keepdims=True) + 20)
        three = (grams + 20 * two[None]) / (grams.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(three)).tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def lattice(self, token: str, masked: bool = False) -> list[list[tuple[str, float]]]:
        """For each character, or run of a repeated one, what it may stand for and at what cost. If masked, a mask stands for
        a letter, and a run of masks for as many."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            if masked and c in MASKS and 0 < i and j < len(token):
                out += [[(x, AS_MASK) for x in LETTERS if x != " "]] * (j - i)
                i = j
                continue
            if c.isalpha():
                run = [(c, 0.0), (c * 2, 0.0)] if j - i > 1 else [(c, 0.0)]
            elif c in LEET:
                run = [(x * k, AS_SIGN) for x in LEET[c] for k in ((1, 2) if j - i > 1 else (1,))] + [("", AS_NOISE + AS_SIGN)]
            else:
                run = [("", AS_NOISE)]
            out.append(run)
            i = j
        return out

    def restore(self, token: str, masked: bool = False) -> str:
        """Viterbi over the lattice; the state is the last two letters. Of paths of equal cost the one found first counts, of
        equal ends the first in the alphabet."""
        if (found := self.known.get((token, masked))) is not None:
            return found
        space = LETTERS.index(" ")
        code = lambda x: int(CLASSES[min(ord(x), 0x24F)])
        best: dict[tuple[int, int], tuple[float, str]] = {(OTHER, space): (0.0, "")}
        for options in self.lattice(token, masked):
            now: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (total, text) in best.items():
                for letters, cost in options:
                    x, y, s = a, b, total + cost
                    for letter in letters:
                        z = code(letter)
                        s += self.cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in now or s < now[x, y][0]:
                        now[x, y] = (s, text + letters)
            best = now
        out = min((total + self.cost[a][b][space], text) for (a, b), (total, text) in best.items())[1]
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[token, masked] = out
        return out

    def words(self, text: str | None) -> set[str]:
        """The distinct words of a text, and what suspicious ones and letters spaced apart restore to."""
        out: set[str] = set()
        if not text:
            return out
        text = text.lower()
        tokens = set(text.split())
        for token in tokens:
            if token.isalpha():
                out.add(token)
                continue
            word = bare(token)
            if word:
                out.add(word)
            if _SUSPECT.search(token):
                # signs at the end may be letters or noise: both readings count
                out.add(self.restore(word))
                out.add(self.restore(token))
                if _MASKED.search(word):
                    out.add(self.restore(word, masked=True))
            if not word.isalpha():
                out.update(x for x in re.split(r"[\W_]+", word) if len(x) > 2)
        for token in tokens:
            if len(token) > 2 and token.isalpha() and _SUSPECT.search(token):
                out.add(self.restore(token))
        for m in _SPACED.finditer(text):
            out.add(self.restore(re.sub(r"[ \t._*-]+", "", m[0])))
        out.discard("")
        return out


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "+" for n in PREFIXES if len(word) > n)]


class Model:
    """Restorer, feature weights and bias."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], bias: float):
        self.restorer, self.weights, self.bias = restorer, weights, bias
        self.hits: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        for word in self.restorer.words(text):
            hit = self.hits.get(word)
            if hit is None:
                if len(self.hits) > 200_000:
                    self.hits.clear()
                hit = self.hits[word] = tuple(f for f in word_features(word) if f in self.weights)
            if hit:
                found.update(hit)
        x = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A logistic regression on which words, and beginnings of words, a text holds.

    Rows of labels (doc_id, toxic) with crc32(doc_id) mod 5 = 0 are held out. At most train_rows documents of each label
    are read for it, those of smallest doc_id hash; their distinct restored words come to the driver, where features
    that stand out in toxic documents are picked and weighted. Without any usable label every score is the bias's."""
    C.in_small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    restorer = Restorer(trigrams(docs))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = lambda k: usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = C.saved(first(0).union(first(1)))  # 2 * train_rows rows of two numbers: small enough for a broadcast
    sent = documents.sparkSession.sparkContext.broadcast(restorer)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ["\n".join(sorted(sent.value.words(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["toxic", "words"])

    rows = docs.join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(C.tidied(words), "toxic int, words string").collect()
    rows.sort()
    return _regress(restorer, [r["words"].split("\n") for r in rows], np.array([r["toxic"] for r in rows], float), totals)


def _regress(restorer: Restorer, texts: list[list[str]], toxic: np.ndarray, totals: dict[int, int]) -> Model:
    prior = math.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)) if totals else 0.0
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(restorer, {}, prior)
    at: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    docs, feats = [], []
    for i, words in enumerate(texts):
        seen: set[int] = set()
        for w in words:
            if (fs := of_word.get(w)) is None:
                fs = of_word[w] = [at.setdefault(f, len(at)) for f in word_features(w)]
            seen.update(fs)
        docs.append(np.full(len(seen), i, np.int32))
        feats.append(np.fromiter(seen, np.int32, len(seen)))
    docs, feats = np.concatenate(docs), np.concatenate(feats)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    k1 = np.bincount(feats, weights=toxic[docs], minlength=len(at))
    k0 = np.bincount(feats, weights=1 - toxic[docs], minlength=len(at))
    p = (k1 + k0 + 1) / (n1 + n0 + 2)
    z = (k1 / n1 - k0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((k1 >= LEAST_DOCUMENTS) & (z >= LEAST_Z) & (k1 / n1 > 3 * k0 / n0))
    place = np.full(len(at), -1)
    place[chosen] = np.arange(len(chosen))
    held = place[feats] >= 0
    d, f = docs[held], place[feats[held]]
    # batch gradient descent with momentum on the sparse matrix, L2 on weights
    w, b, vw, vb = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
    for _ in range(400):
        x = b + np.bincount(d, weights=w[f], minlength=len(toxic))
        g = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - toxic
        vw = 0.9 * vw - 0.5 * (np.bincount(f, weights=g[d], minlength=len(chosen)) / np.sqrt(k1[chosen] + k0[chosen] + 1) / 10 + 0.002 * w)
        vb = 0.9 * vb - 2.0 * g.mean()
        w, b = w + vw, b + vb
    bias = b + prior - math.log((n1 + 0.5) / (n0 + 0.5))
    names = list(at)
    return Model(restorer, {names[c]: float(x) for c, x in zip(chosen, w, strict=True) if x > 0}, bias)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score (0 to 1, higher is likelier toxic) and predicted (1 from 0.5 on) for each text.

    Null and empty texts have the score of no evidence; very long ones are scored whole. Every row is scored by itself, so nulls and repeats in other
    columns change nothing; columns of documents called score or predicted are replaced; an empty table gives none."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def points(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype=float)

    scored = documents.drop("score", "predicted").withColumn("score", points(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
