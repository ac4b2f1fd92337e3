"""Quality rules over words and lines, with cross-document line frequency: normalised lines are hashed, distinct
documents counted for each host, lines above the limit removed, and documents with little left rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: A line is boilerplate of a host if more than LEAST_DOCUMENTS of its documents, and more than one in HOST_SHARE, hold it.
LEAST_DOCUMENTS, HOST_SHARE = 3, 20
#: A document is rejected if less than this share of its words, in hundredths, is left without such lines.
LEFT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"\d+")


def normalise(line: bytes) -> bytes:
    """Lower case (A-Z), digit runs as 0, white space runs as one space."""
    return b" ".join(_DIGITS.sub(b"0", line.lower()).split())


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = C.shingle_hashes(C.word_hashes(words), WINDOW)
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[which] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(docs: DataFrame, text: bool = False) -> DataFrame:
    """Counts of each row of (doc_id, host, text), and hash and words of its lines with a word; with text, the compressed
    text (z)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            z = [C.squeezed_text(t.as_py()) for t in b.column(2)] if text else [None] * b.num_rows
            for value in b.column(2):
                text_ = value.as_py() or ""
                raw = text_.encode("utf-8", "surrogatepass")
                words = raw.split()
                lines = [(x, len(x.split())) for x in raw.split(b"\n")]
                lines = [(x, n) for x, n in lines if n]
                chars = sum(map(len, text_.encode("ascii", "replace").split())) if text_.isascii() else len(text_) - sum(map(text_.count, " \t\n\v\f\r"))
                rows.append((
                    len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len({x for x, _ in lines}), repeated_words(words),
                    C.word_hashes([normalise(x) for x, _ in lines]).view(np.int64), np.array([n for _, n in lines], np.int64),
                ))
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (5, 6)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, *lists, pa.array(z, pa.binary())], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "hashes", "sizes", "z"])

    return docs.mapInArrow(C.tidied(measure), "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, sizes array<long>, z binary")


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, hashes: pd.Series) -> pd.Series:
    out = []
    for z, gone in zip(texts, hashes, strict=True):
        text = C.unsqueezed(z)
        if text and gone is not None and len(gone):
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            keys = C.word_hashes([normalise(x) for x in lines]).view(np.int64)
            worded = np.array([bool(x.split()) for x in lines])
            text = b"\n".join(x for x, g in zip(lines, np.isin(keys, np.asarray(gone, np.int64)) & worded, strict=True) if not g).decode("utf-8", "surrogatepass")
        out.append(text)
    return pd.Series(out, dtype=object)


def quality(documents: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words for each row
    of (doc_id, text, source); a document's host is its source. With text, kept_text too: the text without the lines
    above the limit (null for null).

    n_line_words counts words in lines that more of the host's documents hold than the limit. A row is kept unless it
    fails the base rules or less than LEFT_PERCENT of its words is outside such lines. Null and empty texts have no
    words and fail; a null source is a host of its own; rows that repeat a doc_id are one document in counts, each
    judged by itself; null doc_ids count as one document. A line that exactly as many documents hold as the limit says
    stays. Very long texts are texts like others, columns beside the three play no part, an empty table gives none.

    Texts are read once; lines travel as hashes, each once a document, and texts move only where they are asked for."""
    C.in_small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    every = C.saved(measures(docs, text).withColumn("row", F.monotonically_increasing_id()))
    lines = every.select("row", "doc_id", "host", F.explode(F.arrays_zip("hashes", "sizes")).alias("x")).select("row", "doc_id", "host", F.col("x.hashes").alias("hash"), F.col("x.sizes").alias("size"))
    # lines that no other document can share are most; counting first by (host, hash) sums them map-side
    held = lines.select("host", "hash", "doc_id").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_DOCUMENTS)
    hosts = every.groupBy("host").agg(F.count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("docs"))
    common = held.join(hosts, held["host"].eqNullSafe(hosts["host"])).where(F.col("n") * HOST_SHARE > F.col("docs")).select(held["host"].alias("of"), held["hash"].alias("common"))
    removed = lines.join(common, (F.col("hash") == F.col("common")) & F.col("host").eqNullSafe(F.col("of"))).groupBy("row").agg(F.sum("size").alias("gone"), *([F.collect_set("hash").alias("lines")] if text else []))
    out = every.drop("hashes", "sizes").join(removed, "row", "left").withColumn("n_line_words", F.coalesce("gone", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    depleted = 100 * (F.col("n_words") - F.col("n_line_words")) < LEFT_PERCENT * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words", *([_without("z", "lines").alias("kept_text")] if text else []))
