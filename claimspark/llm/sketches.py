"""Ranked lexical search through hashed sketches of coordinatewise maxima.

An index holds for each document its length and a sketch: terms hash to coordinates, and each coordinate keeps the largest
number of occurrences of its terms. As a term's impact grows with its occurrences, the sketch gives the largest impact of
each coordinate too, whatever the corpus' statistics. A batch of queries looks up its terms and sums bounds; documents are
scored exactly in order of their bounds until none that is left can reach the k-th score."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Results of a query, and bits of a sketch's coordinates: a query's term meets one that another term of a document of n
#: distinct terms fills with a chance of n / 2 ** BITS.
K, BITS = 50, 26
#: Terms of queries that one block may hold; queries are looked up by blocks, each broadcast.
BLOCK_TERMS = 100_000
#: (document, queries) rows that are broadcast to be scored; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: A term's impact: SCALE * tf div (TF * tf + LENGTH * m), m = PERCENT - SLOPE + SLOPE * length div the mean length.
SCALE, TF, LENGTH, PERCENT, SLOPE = 1_000_000_000, 1000, 20, 100, 50

#: Bytes of terms as they are, A-Z lower-cased, all others a space.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, only A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return SCALE * tf // (TF * tf + LENGTH * m)


# --- index ------------------------------------------------------------------------------------------------------------


def coordinates(words: list[bytes]) -> np.ndarray:
    return (C.word_hashes(words) >> C.U(64 - BITS)).astype(np.int64)


def sketch(counts: Counter) -> bytes:
    """The coordinates that terms hash to, in order, each with the largest count among its terms; all others are 0. Kept
    as steps from one to the next, beside their counts, and compressed."""
    at, tf = coordinates(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    order = np.lexsort((tf, at))
    at, tf = at[order], tf[order]
    last = np.r_[at[1:] != at[:-1], True]  # of equal coordinates the last, largest one
    at, tf = at[last], tf[last]
    return C.packed(np.diff(at, prepend=0) << 32 | tf)


def unsketched(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = C.unpacked(b, np.int64)
    return np.cumsum(both >> 32), both & 0xFFFFFFFF


def index(documents: DataFrame) -> DataFrame:
    """(doc_id, n, sketch) of documents (doc_id, text): n terms with repeats. Documents without any have no row; rows of a
    null doc_id have one, as they count for the statistics. It doesn't depend on queries or other documents, so that of
    new documents is put beside it."""
    C.in_small_batches(documents.sparkSession, 1000)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if words := terms(text.as_py()):
                    out.append((doc_id, len(words), sketch(Counter(words))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n", "sketch"])

    return _docs(documents).mapInArrow(C.tidied(rows), "doc_id long, n long, sketch binary")


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequencies(documents: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each term of a block's vocabulary stands; each task sums its own."""
    spark = documents.sparkSession
    numbers = {w: i for i, w in enumerate(sorted(vocabulary))}
    sent = spark.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(1):
                found.update(sent.value.keys() & set(terms(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([sent.value[w] for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    got = _docs(documents).mapInArrow(C.tidied(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # bounded by BLOCK_TERMS
    df = {r["term"]: r["df"] for r in got}
    return {w: df.get(i, 0) for w, i in numbers.items()}


# --- queries ----------------------------------------------------------------------------------------------------------


class Block:
    """The terms of a block of queries, laid out for lookups: hashes, weights and where each query's begin."""

    def __init__(self, queries: list[list[bytes]], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.queries = [[(w, weight(n_docs, df[w])) for w in q if df[w]] for q in queries]
        flat = [x for q in self.queries for x in q]
        at, owner = coordinates([w for w, _ in flat]), np.repeat(np.arange(len(queries)), [len(q) for q in self.queries])
        order = np.argsort(at, kind="stable")
        self.at, self.starts = np.unique(at[order], return_index=True)
        self.sizes = np.diff(np.r_[self.starts, len(flat)])
        self.owner, self.weights = owner[order], np.array([x for _, x in flat], np.int64)[order]

    def m(self, n: int) -> int:
        return PERCENT - SLOPE + SLOPE * n * self.n_docs // self.n_terms

    def bounds(self, n: int, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """For each query, what no score of a document of n terms and this sketch exceeds."""
        out = np.zeros(len(self.queries), np.int64)
        if len(self.at):
            place = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
            hit = np.flatnonzero(self.at[place] == at)
            place = place[hit]
            size = self.sizes[place]
            entry = np.repeat(self.starts[place] - np.cumsum(size) + size, size) + np.arange(size.sum())
            np.add.at(out, self.owner[entry], self.weights[entry] * np.repeat(impacts(tf[hit], self.m(n)), size))
        return out

    def score(self, counts: Counter, n: int, query: int) -> int:
        m = self.m(n)
        return sum(w * (SCALE * tf // (TF * tf + LENGTH * m)) for word, w in self.queries[query] if (tf := counts.get(word, 0)))


def best_bounds(rows: DataFrame, sent, k: int) -> DataFrame:
    """(doc_id, queries): each task's k documents of highest bound for each query, those of a document together."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in block.queries]
        floor = np.zeros(len(block.queries), np.int64)
        for b in batches:
            for doc_id, n, z in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                bounds = block.bounds(n, *unsketched(z))
                for q in np.flatnonzero(bounds > floor).tolist():
                    if len(best[q]) < k:
                        heapq.heappush(best[q], (int(bounds[q]), doc_id))
                    else:
                        heapq.heapreplace(best[q], (int(bounds[q]), doc_id))
                    if len(best[q]) == k:
                        floor[q] = best[q][0][0]
        out = [(q, doc_id, bound) for q, found in enumerate(best) for bound, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["query", "doc_id", "bound"])

    found = rows.where("doc_id is not null").mapInArrow(C.tidied(look), "query long, doc_id long, bound long")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "doc_id"))  # k rows of each task at most
    return found.withColumn("_place", first).where(F.col("_place") <= k).groupBy("doc_id").agg(F.collect_set("query").alias("queries"))


def reaching(rows: DataFrame, sent, floors: list[int]) -> DataFrame:
    """(doc_id, queries): all documents whose bound reaches a query's floor, above 0."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        floor = np.maximum(np.array(floors, np.int64), 1)
        for b in batches:
            out = []
            for doc_id, n, z in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if len(held := np.flatnonzero(block.bounds(n, *unsketched(z)) >= floor)):
                    out.append((doc_id, held.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "queries"])

    found = rows.where("doc_id is not null").mapInArrow(C.tidied(look), "doc_id long, queries array<long>")
    return found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries"))  # a row a document; more only where ids repeat


def scored(documents: DataFrame, wanted: DataFrame, sent) -> DataFrame:
    """(query, doc_id, score) above 0 of the wanted (doc_id, queries), from whole texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for b in batches:
            out = []
            for doc_id, text, queries in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                counts = Counter(terms(text.as_py()))
                n = counts.total()
                out += [(q, doc_id, s) for q in queries if n and (s := block.score(counts, n, q)) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["query", "doc_id", "score"])

    wanted = C.saved(wanted)
    size = wanted.agg(F.count("*") + F.coalesce(F.sum(F.size("queries")), F.lit(0))).first()[0]
    right = F.broadcast(wanted) if size <= BROADCAST_ROWS else wanted
    met = _docs(documents).join(right, "doc_id").select("doc_id", "text", "queries")
    return met.mapInArrow(C.tidied(rows), "query long, doc_id long, score long").groupBy("query", "doc_id").agg(F.max("score").alias("score"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; Spark keeps k rows of each task before it shuffles."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items (item_id, distinct terms) in blocks of about BLOCK_TERMS terms, one after the other."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        words = sorted(set(terms(r["text"])))
        if words:
            block.append((r["item_id"], words))
            size += len(words)
        if size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


RESULT = "item_id long, rank int, doc_id long, score long"


def search(documents: DataFrame, items: DataFrame, k: int = K, indexed: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) the k documents of highest score above 0,
    equal ones by ascending doc_id. indexed: a stored index() of documents; made here if not given.

    Two rounds: the k documents of highest bound are scored exactly, and the k-th of these scores is a floor; then all
    documents whose bounds reach the floor are scored, and no other can be among the best. Where fewer than k have a score,
    the floor is 0 and every document with a bound is scored.

    A null or empty text has no terms: it is no document, and no query. Repeated rows of items are queries each. Rows that
    repeat a doc_id count as documents each, but the id is returned once, with its best score; null doc_ids count and are
    never returned. Very long texts are whole texts like others; empty tables give an empty result."""
    spark = documents.sparkSession
    rows = C.saved(index(documents)) if indexed is None else indexed
    stats = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    out = spark.createDataFrame([], RESULT)
    if not stats["n"]:
        return out
    for block in blocks(items):
        df = frequencies(documents, set().union(*(words for _, words in block)))
        sent = spark.sparkContext.broadcast(Block([words for _, words in block], df, stats["n"], stats["l"]))
        first = ranked(scored(documents, best_bounds(rows, sent, k), sent), k)
        floor = {r["query"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # one row a query
        found = ranked(scored(documents, reaching(rows, sent, [floor.get(q, 0) for q in range(len(block))]), sent), k)
        names = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(block)], "query long, item_id long")
        out = out.union(found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
