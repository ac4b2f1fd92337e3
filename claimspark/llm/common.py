"""What the corpus operators share: scratch tables, word hashes, sorted key runs, linking and components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that one bucket of runs should hold; a bucket is read whole by one task (16 bytes a key).
KEYS_PER_BUCKET = 1_000_000


def scratch(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or a folder of our own where it is unset and Spark
    runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="claimspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def tidy() -> None:
    """Gives freed memory of a Python task back to the system: workers live on from task to task and would keep it."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, a function of mapInArrow, with tidy() when a task ends."""

    @functools.wraps(f)
    def tidy_at_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            tidy()

    return tidy_at_end


def in_small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Has Python tasks of this session take at most so many rows at a time: texts may be long, and workers keep the
    memory that they once needed."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(rows, int(spark.conf.get(name, "10000"))))


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage and outlives executors."""
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote and that nothing yet to be computed reads."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Holds the other columns of a table while an operator works on doc_id and text.
ROW = "_row_beside_text"


def beside(documents: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of run(doc_id, text) with the columns of documents: text is run's, all others are as they were, whatever
    names run uses for its own."""
    columns = documents.columns
    other = [F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")]
    out = run(documents.select("doc_id", "text", *([F.struct(*other).alias(ROW)] if other else [])))
    return out.select(*(c if c in ("doc_id", "text") else F.col(f"{ROW}.`{c}`").alias(c) for c in columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, n_keys: int) -> int:
    """How many buckets n_keys are dealt over; grows with the input, so that a bucket does not."""
    return max(shuffle_partitions(spark), -(-n_keys // KEYS_PER_BUCKET))


# --- hashes -----------------------------------------------------------------------------------------------------------

U = np.uint64
#: Odd multipliers, one for each place of a shingle.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD1B54A32D192ED03) | 1 for i in range(64)], dtype=object)
PLACES = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in PLACES], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=U, count=len(words))


def shingle_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash for each run of k consecutive word hashes; fewer than k words give none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    out = np.full(n, salt, dtype=U)
    for i in range(k):
        out += words[i : i + n] * PLACES[i]
    return mix(out)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8 (lone surrogates pass)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# --- sorted runs of keys ----------------------------------------------------------------------------------------------

RUNS = "bucket int, n long, keys binary, ids binary"
RUNS_OTHER = f"{RUNS}, other binary"


def packed(a: np.ndarray) -> bytes:
    """Eight-byte values, byte planes apart, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(b: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _sorted(keys: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """By key, then id, then the rest, without repeats."""
    order = np.lexsort((*more[::-1], ids, keys))
    columns = [c[order] for c in (keys, ids, *more)]
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return tuple(c[new] for c in columns)


def runs(keys: np.ndarray, ids: np.ndarray, n_buckets: int, other: np.ndarray | None = None) -> pa.RecordBatch:
    """One sorted run of (key, id), or (key, id, other), for each bucket, a bucket being a range of keys."""
    columns = _sorted(keys, ids, *([] if other is None else [other]))
    of = ((columns[0] >> U(32)) * U(n_buckets)) >> U(32)
    cuts = np.flatnonzero(np.diff(of)) + 1 if len(of) else np.empty(0, int)
    starts, ends = np.r_[0, cuts].astype(int), np.r_[cuts, len(of)].astype(int)
    spans = [(s, e) for s, e in zip(starts, ends, strict=True) if e > s]
    names = ["keys", "ids", "other"][: len(columns)]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(of[s]) for s, _ in spans], pa.int32()), pa.array([e - s for s, e in spans], pa.int64()), *(pa.array([packed(c[s:e]) for s, e in spans], pa.binary()) for c in columns)],
        names=["bucket", "n", *names],
    )


def merged(table: pa.Table, flags: np.ndarray | None = None, other: bool = False) -> tuple[np.ndarray, ...]:
    """The runs of one bucket as one, sorted by key, then id, without repeats. flags: a value for each entry of the runs
    as they stand in the table, returned in the new order."""
    columns = [np.concatenate([np.empty(0, kind), *(unpacked(b, kind) for b in table.column(name).to_pylist())]) for name, kind in (("keys", U), ("ids", np.int64), *([("other", U)] if other else []))]
    return _sorted(*columns, *([] if flags is None else [flags]))


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted entries: the smallest id of each key and the others that share it, each pair once, and where keys begin."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    center = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    center, others = center[~first], ids[~first]
    order = np.lexsort((others, center))
    center, others = center[order], others[order]
    new = np.r_[True, (center[1:] != center[:-1]) | (others[1:] != others[:-1])] if len(others) else np.empty(0, bool)
    return center[new], others[new], np.flatnonzero(first)


def shared_keys(runs_: DataFrame) -> DataFrame:
    """(center, id): each id that shares a key with another, beside the smallest id of the key. runs_: a written table of
    RUNS, as it is read twice.

    A bucket that a hot key makes large is dealt in parts; each links its own ids and passes on the smallest of each key
    alone, and these are linked in a second round."""
    sizes = runs_.groupBy("bucket").agg(F.ceil(F.sum("n") / (2 * KEYS_PER_BUCKET)).cast("int").alias("parts")).where("parts > 1")
    large = saved(sizes)
    if large.isEmpty():
        dealt = runs_.select("bucket", F.lit(0).alias("part"), F.lit(1).alias("parts"), "keys", "ids")
    else:
        dealt = runs_.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.select("bucket", F.pmod(F.xxhash64("keys"), F.col("parts")).cast("int").alias("part"), "parts", "keys", "ids")

    def stars(table: pa.Table) -> pa.Table:
        keys, ids = merged(table)
        center, others, first = _stars(keys, ids)
        n, parted = len(others), bool(table.num_rows) and table.column("parts")[0].as_py() > 1
        rest = [packed(keys[first]), packed(ids[first])] if parted else [None, None]
        bucket = table.column("bucket")[0].as_py() if table.num_rows else None
        out = {"center": pa.array(center, pa.int64()), "id": pa.array(others, pa.int64()), "bucket": pa.nulls(n, pa.int32()), "keys": pa.nulls(n, pa.binary()), "ids": pa.nulls(n, pa.binary())}
        if parted:
            more = {"center": [None], "id": [None], "bucket": [bucket], "keys": [rest[0]], "ids": [rest[1]]}
            out = {k: pa.chunked_array([v, pa.array(more[k], v.type)]) for k, v in out.items()}
        tidy()
        return pa.table(out)

    kind = "center long, id long, bucket int, keys binary, ids binary"
    found = dealt.groupBy("bucket", "part").applyInArrow(stars, kind)
    if large.isEmpty():
        return found.select("center", "id").distinct()
    found = saved(found)
    again = found.where("keys is not null").select("bucket", F.lit(0).alias("part"), F.lit(1).alias("parts"), "keys", "ids").groupBy("bucket", "part").applyInArrow(stars, kind)
    return found.where("keys is null").union(again).select("center", "id").distinct()


# --- links and groups -------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id of edges (a, b) the smallest id it reaches. Large-star and small-star rounds
    (Kiveris et al., 2014), each written to the shared folder."""
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        checks = now.agg(F.count("*").alias("n"), F.count_distinct("hi").alias("k")).first()
        if checks["n"] == checks["k"] and now.join(now.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty():
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        # written, so that the join's sides are plain shuffles: Spark splits the rows of a hot node
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = saved(large)
        small = saved(large.groupBy("hi").agg(F.min("lo").alias("m")))
        joined = large.join(small, "hi")
        was, now = now, saved(joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", "m")).distinct())
        drop(was, least, large, small)
    return saved(now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select(F.col("lo"), F.col("lo"))).distinct())


#: Ids whose values one task compares at a time.
BLOCK_IDS = 4000


def clusters(stars: DataFrame) -> DataFrame:
    """(id, cluster, slices): what candidate stars (center, id) connect, and in how many slices of BLOCK_IDS or less
    its members are dealt."""
    found = components(stars.select(F.col("center").alias("a"), F.col("id").alias("b")))
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_IDS).cast("int").alias("slices"))
    return saved(found.join(sizes, "component").select("id", F.col("component").alias("cluster"), "slices"))


def linked(held: DataFrame, decode: Callable[[list[bytes]], list], keys_of: Callable[[list], list[np.ndarray]], match: Callable[[object, list], np.ndarray]) -> DataFrame:
    """(id, component) of ids that match, for all ids of held (id, cluster, slices, value) that match any other.

    Two ids are compared if they share a key of keys_of(values); match(x, ys) says which ys x is linked with. Small
    clusters share tasks; a cluster of more than BLOCK_IDS is dealt in slices, and each pair of slices is a task. A task
    compares only what it hasn't connected yet and returns a spanning forest, so neither pairs nor groups leave it."""
    spark = held.sparkSession
    n_bins = max(shuffle_partitions(spark), -(-held.where("slices = 1").count() // BLOCK_IDS))
    own = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    small = held.where("slices = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(n_bins)).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("slice"), "id", "value")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    large = held.where("slices > 1").select("cluster", own.alias("slice"), other, "id", "value")
    large = large.select(F.col("cluster").alias("block"), F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "id", "value")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, part = ids[order], table.column("slice").to_numpy()[order]
        raw = table.column("value")
        values = decode([raw[int(k)].as_py() for k in order])
        across = bool(len(ids)) and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        keys = keys_of(values)
        owner = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        flat = np.concatenate([np.empty(0, U), *keys])
        by = np.lexsort((owner, flat))
        flat, owner = flat[by], owner[by]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, int)
        stop = np.r_[first[1:], len(flat)].astype(int)
        # for each entry but the last of its key: the id of the entry, and the run of ids after it
        end = np.repeat(stop, stop - first)
        at = np.flatnonzero(end - np.arange(len(flat)) > 1)
        at = at[np.argsort(owner[at], kind="stable")]
        cuts = np.searchsorted(owner[at], np.arange(len(ids) + 1))
        root = np.arange(len(ids))
        for x in range(len(ids)):
            entries = at[cuts[x] : cuts[x + 1]]
            if not len(entries):
                continue
            ys = np.unique(np.concatenate([owner[e + 1 : end[e]] for e in entries]))
            ys = ys[(root[ys] != root[x]) & (ys != x)]
            if across:
                ys = ys[part[ys] != part[x]]
            if len(ys):
                for y in ys[match(values[x], [values[y] for y in ys])]:
                    if root[y] != root[x]:
                        root[root == max(root[x], root[y])] = min(root[x], root[y])
        tied = root != np.arange(len(ids))
        tidy()
        return pa.table({"a": ids[root[tied]], "b": ids[tied]})

    forest = small.union(large).groupBy("block", "i", "j").applyInArrow(compare, "a long, b long")
    return components(forest)


# --- text shuffled small ----------------------------------------------------------------------------------------------


def squeezed_text(text: str | None) -> bytes | None:
    raw = None if text is None else text.encode("utf-8", "surrogatepass")
    return None if raw is None else len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): each text as compressed UTF-8, for joins that must move whole texts. Null texts stay null."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [squeezed_text(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], names=["doc_id", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(squeeze), "doc_id long, z binary")


def unsqueezed(z: bytes | None) -> str | None:
    if z is None:
        return None
    size = int.from_bytes(z[:8], "little")
    return pa.decompress(z[8:], size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else ""


# --- edit distance ----------------------------------------------------------------------------------------------------


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, inside: bool, most: int | None = None) -> tuple[int, int]:
    """Myers' bit-parallel distance of a pattern (masks, m > 0 long) to text: the least over substrings of text and where
    the first such one ends if inside, else the distance to all of text and its length. Without inside, a distance that
    must get above most is given as most + 1 as soon as that shows."""
    ahead = len(text) + most if most is not None and not inside else None
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | (0 if inside else 1)
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
        if inside and score < best:
            best, end = score, j + 1
        if ahead is not None and score + j >= ahead:  # each character to come takes one off at most
            return most + 1, len(text)
    return (best, end) if inside else (score, len(text))
