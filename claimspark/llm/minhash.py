"""MinHash near-dedup with both ends: one permutation gives a minimum and a maximum, so half the hash evaluations fill
a signature; signatures are banded, candidates confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A band is ROWS values of the signature, of 2 * PERMUTATIONS values. At a similarity of 0.8 two sets miss all bands
#: with a chance of (1 - 0.8 ** 8) ** 48, one in seven thousand, at 0.85 of one in four million.
PERMUTATIONS, ROWS = 192, 8
BANDS = 2 * PERMUTATIONS // ROWS
_A = (C.mix(np.arange(1, PERMUTATIONS + 1, dtype=C.U) * C.U(0x9E3779B97F4A7C15)) >> C.U(32)).astype(np.uint32) | np.uint32(1)
_B = (C.mix(np.arange(1, PERMUTATIONS + 1, dtype=C.U) * C.U(0xC2B2AE3D27D4EB4F)) >> C.U(32)).astype(np.uint32)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted set of k-word shingle hashes; a text of fewer words is one shingle, a text without words has none."""
    words = C.word_hashes(C.ascii_lower_words(text))
    if not len(words):
        return words
    return np.unique(C.shingle_hashes(words, min(k, len(words)), salt=min(k, len(words))))


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, as PERMUTATIONS pairs; values: at least one."""
    short = (values >> C.U(32)).astype(np.uint32)
    low, high = np.empty(PERMUTATIONS, np.uint32), np.empty(PERMUTATIONS, np.uint32)
    step = max(1, min(PERMUTATIONS, 65536 // len(short)))
    for i in range(0, PERMUTATIONS, step):
        seen = short[None, :] * _A[i : i + step, None]
        seen += _B[i : i + step, None]
        seen ^= seen >> np.uint32(15)
        seen *= np.uint32(0x2C1B3C6D)
        seen.min(1, out=low[i : i + step])
        seen.max(1, out=high[i : i + step])
    return np.stack([low, high], 1).astype(C.U)


def band_keys(values: np.ndarray) -> np.ndarray:
    # minimum and maximum of one permutation go to different bands
    rows = signature(values).T.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=C.U) * C.U(0x9FB21C651E98DF25)
    for i in range(ROWS):
        keys = C.mix(keys ^ rows[:, i]) + C.PLACES[i]
    return C.mix(keys)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): the size and a 128-bit fingerprint of each set, and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, bands = [], [], [], []
            for text in b.column(1):
                values = shingles(text.as_py(), k)
                n.append(len(values))
                place = np.arange(1, len(values) + 1, dtype=C.U)
                s1.append(int(C.mix(values + place).sum(dtype=C.U).view(np.int64)))
                s2.append(int(C.mix(values * C.U(0x9E3779B97F4A7C15) ^ place).sum(dtype=C.U).view(np.int64)))
                bands.append(band_keys(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return docs.mapInArrow(C.tidied(sketch), "doc_id long, n_shingles long, s1 long, s2 long, bands binary")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document of (doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles;
    component_id is the smallest doc_id that links lead to and kept says that it is the document's own. Nulls and texts
    without words have n_shingles 0 and stand alone. Rows that repeat a doc_id give one row (of their largest text); a
    null doc_id gives a row with null component_id, kept, linked with nothing. An empty table gives none.

    Equal sets meet by fingerprint first, so thousands of copies cost one candidate; the rest meet by band, in sorted
    runs of packed keys, and all that share one are confirmed against the full sets."""
    spark = documents.sparkSession
    C.in_small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = C.saved(sketches(docs, k))
    one = every.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("n_shingles", "s1", "s2", "bands"), F.struct("n_shingles", "s1", "s2")).alias("x")).select("doc_id", "x.*")
    copies = one.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    n = every.count()
    n_buckets = C.buckets(spark, n * BANDS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=C.U)
                yield C.runs(keys, np.repeat(b.column(0).to_numpy().astype(np.int64), BANDS), n_buckets)

    keyed = C.saved(copies.select("rep", "bands").mapInArrow(C.tidied(pack), C.RUNS))
    wanted = C.clusters(C.shared_keys(keyed)).withColumnRenamed("id", "doc_id")
    C.drop(keyed)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [shingles(C.unsqueezed(z), k).tobytes() for z in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary()), *b.columns[2:]], names=["id", "value", "cluster", "slices"])

    held = C.squeezed(docs.where("doc_id is not null")).hint("merge").join(wanted, "doc_id").select("doc_id", "z", "cluster", "slices").mapInArrow(C.tidied(sets), "id long, value binary, cluster long, slices int")
    if one.count() < n:
        held = held.groupBy("id", "cluster", "slices").agg(F.max_by("value", F.struct(F.length("value"), "value")).alias("value"))

    def similar(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(y) for y in ys])
        flat = np.concatenate(ys)
        at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        both = np.add.reduceat(x[at] == flat, np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64)
        return 100 * both >= percent * (len(x) + n - both)

    held = C.saved(held)
    comps = C.linked(held, lambda raw: [np.frombuffer(v, dtype=C.U) for v in raw], lambda values: [band_keys(v) for v in values], similar)
    C.drop(held)
    reps = C.saved(copies.select("n_shingles", "s1", "s2", "rep"))  # written: Spark splits the rows of a hot set in the join
    of = C.saved(one.drop("bands")).join(reps, ["n_shingles", "s1", "s2"], "left")
    found = of.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    alone = every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
