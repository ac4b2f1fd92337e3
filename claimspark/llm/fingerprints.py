"""Substring dedup over a log-structured fingerprint index.

The index is a list of immutable sorted runs of window fingerprints. Each new batch is merge-joined with the runs
bucket by bucket, what meets is verified on whole windows, the batch becomes a run itself, and runs are compacted when
they get many. A window's fingerprint is the smallest hash among the GRAM-word grams in it, so windows of the same
words have the same fingerprint and neighbouring windows mostly share one: a fifth of the windows' number is kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM = 13, 4


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of `window` words the smallest gram hash in it, mixed; bit 0 is clear."""
    if len(hashes) < window:
        return np.empty(0, C.U)
    low, width, need = C.shingle_hashes(hashes, GRAM, salt=7), 1, window - GRAM + 1
    while width * 2 <= need:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    if width < need:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    return C.mix(low) & ~C.U(1)


def whole_keys(hashes: np.ndarray) -> tuple[int, int]:
    """Two keys of the whole word sequence, told from fingerprints by bit 0 and from each other by bit 1."""
    place = C.mix(np.arange(1, len(hashes) + 1, dtype=C.U))
    a, b = C.mix(hashes + place).sum(dtype=C.U), C.mix(hashes * C.PLACES[0] ^ place).sum(dtype=C.U)
    a, b = C.mix(np.array([a, b], C.U))
    return int(a) & ~3 | 1, int(b) & ~3 | 3


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, doc_id), grown batch by batch.

    expected_keys: about how many fingerprints the index will hold; fixes the number of buckets."""

    def __init__(self, spark: SparkSession, expected_keys: int, window: int = WINDOW, fan_in: int = 8):
        self.n_buckets, self.window, self.fan_in = C.buckets(spark, expected_keys), window, fan_in
        self.runs: list[DataFrame] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds (doc_id, text); returns (key, id) of each key that a new document shares with any other one."""
        n_buckets, window = self.n_buckets, self.window

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, ids = [np.empty(0, C.U)], [np.empty(0, np.int64)]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    h = C.word_hashes(words_of(text.as_py()))
                    if len(h) >= window:
                        f = fingerprints(h, window)
                        f = f[np.r_[True, f[1:] != f[:-1]]]
                        keys += [f, np.array(whole_keys(h), C.U)]
                        ids.append(np.full(len(f) + 2, doc, np.int64))
                yield C.runs(np.concatenate(keys), np.concatenate(ids), n_buckets)

        def merge_join(table: pa.Table) -> pa.Table:
            fresh = np.array(table.column("fresh").to_pylist(), bool)
            sizes = [len(C.unpacked(x, C.U)) for x in table.column("keys").to_pylist()]
            keys, ids, is_new = C.merged(table, np.repeat(fresh, sizes))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
            n = np.diff(np.r_[starts, len(keys)])
            hit = (n > 1) & np.logical_or.reduceat(is_new, starts) if len(keys) else np.empty(0, bool)
            kept = np.repeat(hit, n)
            return pa.table({"key": keys[kept].view(np.int64), "id": ids[kept]})

        docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        fresh = C.saved(docs.mapInArrow(C.tidied(pack), C.RUNS))
        both = fresh.withColumn("fresh", F.lit(True))
        for run in self.runs:
            both = both.union(run.withColumn("fresh", F.lit(False)))
        found = C.saved(both.groupBy("bucket").applyInArrow(merge_join, "key long, id long"))
        self.runs.append(fresh)
        if len(self.runs) > self.fan_in:
            self.compact()
        return found

    def compact(self) -> None:
        """All runs become one."""

        def one(table: pa.Table) -> pa.Table:
            keys, ids = C.merged(table)
            return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([C.packed(keys)], pa.binary()), "ids": pa.array([C.packed(ids)], pa.binary())})

        every = self.runs[0]
        for run in self.runs[1:]:
            every = every.union(run)
        was, self.runs = self.runs, [C.saved(every.groupBy("bucket").applyInArrow(one, C.RUNS))]
        C.drop(*was)

    def stored(self) -> dict:
        """What reopen() needs: where the runs are, and what they were made with. The folders belong to the caller."""
        return {"paths": [run.stored_at for run in self.runs], "n_buckets": self.n_buckets, "window": self.window, "fan_in": self.fan_in}

    @classmethod
    def reopen(cls, spark: SparkSession, paths: list[str], n_buckets: int, window: int, fan_in: int) -> FingerprintIndex:
        """An index as it was stored, for the next day's batch."""
        out = cls(spark, 0, window, fan_in)
        out.n_buckets = n_buckets
        for path in paths:
            run = spark.read.schema(C.RUNS).parquet(path)
            run.stored_at = path
            out.runs.append(run)
        return out


def substring_dedup(documents: DataFrame, window: int = WINDOW, batches: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each row of (doc_id, text).

    A word goes if it is covered by a window of `window` words that also starts in a document of smaller doc_id, as the
    input has them. Documents come in `batches` ranges of doc_id, as they would day by day. Null and empty texts have no
    words and an empty kept text; rows that repeat a doc_id are one document, each cut by itself; a null doc_id is never
    cut and cuts no other. Of equal windows in one document none cuts another; very long texts are texts like others;
    columns beside the two play no part. An empty table gives none. The last of the batches makes the index compact.

    Verification compares whole windows by two independent hashes, 128 bits together. A document whose words all equal an
    earlier one's is settled by the keys of the whole sequence; its windows never travel."""
    spark = documents.sparkSession
    C.in_small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    chars, low, high = size["chars"] or 0, size["low"] or 0, size["high"] or 0
    index = FingerprintIndex(spark, chars // 30, window, fan_in=batches - 1 or 1)
    edges = [low + (high - low + 1) * i // batches for i in range(batches + 1)]
    found = None
    for start, end in zip(edges, edges[1:], strict=False):
        new = index.add(docs.where((F.col("doc_id") >= start) & (F.col("doc_id") < end)))
        found = new if found is None else found.union(new)

    whole = found.where("key & 1 = 1").distinct()
    first = whole.groupBy("key").agg(F.min("id").alias("first"))
    copies = whole.join(first, "key").where("id > first").groupBy("id").agg(F.count_if(F.expr("key & 2 = 0")).alias("x"), F.count_if(F.expr("key & 2 = 2")).alias("y"), F.min("first").alias("a"), F.max("first").alias("b"))
    copies = C.saved(copies.where("x > 0 and y > 0 and a = b").select("id"))
    # a key that only copies of one document share finds nothing new
    shared = found.where("key & 1 = 0").join(copies, "id", "left_anti").groupBy("id").agg(F.collect_set("key").alias("keys"))
    n_buckets = C.buckets(spark, chars // 20)
    packed = C.squeezed(docs)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, ids = [np.empty(0, C.U)], [np.empty(0, C.U)], [np.empty(0, np.int64)]
            for doc, z, keys in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                h = C.word_hashes(words_of(C.unsqueezed(z.as_py())))
                at = np.isin(fingerprints(h, window), keys.values.to_numpy().view(C.U))
                one.append(C.shingle_hashes(h, window)[at])
                two.append(C.shingle_hashes(h, window, salt=11)[at])
                ids.append(np.full(len(one[-1]), doc, np.int64))
            keys, other, ids = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
            yield C.runs(keys, ids, n_buckets, other)

    def repeated(table: pa.Table) -> pa.Table:
        keys, ids, other = C.merged(table, other=True)
        order = np.lexsort((ids, other, keys))
        keys, ids, other = keys[order], ids[order], other[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])] if len(keys) else np.empty(0, bool)
        again = ids != ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))] if len(ids) else new
        ids, keys = ids[again], keys[again]
        return pa.Table.from_batches([C.runs(C.mix(ids.view(C.U)), ids, n_buckets, keys)])

    def by_document(table: pa.Table) -> pa.Table:
        _, ids, keys = C.merged(table, other=True)
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, int)
        parts = [keys[s:e].tobytes() for s, e in zip(cuts, np.r_[cuts[1:], len(ids)].astype(int), strict=True)]
        return pa.table({"id": pa.array(ids[cuts], pa.int64()), "part": pa.array(parts, pa.binary())})

    candidates = packed.join(shared.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "z", "keys").mapInArrow(C.tidied(windows), C.RUNS_OTHER)
    cut = candidates.groupBy("bucket").applyInArrow(repeated, C.RUNS_OTHER).groupBy("bucket").applyInArrow(by_document, "id long, part binary")
    marks = C.saved(cut.withColumn("copy", F.lit(False)).union(copies.select("id", F.lit(None).cast("binary"), F.lit(True))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digest, text = [], [], [], []
            for z, part, copy in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = words_of(C.unsqueezed(z))
                n_words.append(len(words))
                if copy and len(words) >= window:
                    words = []
                elif part:
                    at = np.isin(C.shingle_hashes(C.word_hashes(words), window), np.frombuffer(part, C.U))
                    if at.any():
                        edge = np.zeros(len(words) + 1, np.int64)
                        edge[np.flatnonzero(at)] += 1
                        np.subtract.at(edge, np.flatnonzero(at) + window, 1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                raw = b" ".join(words)
                digest.append(hashlib.sha256(raw).hexdigest())
                text.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return packed.join(marks.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "z", "part", "copy").mapInArrow(C.tidied(keep), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
