"""Benchmark decontamination by pigeonhole edit matching: an item with an error budget of e edits is split into e + 1
pieces, one of which any match must hold unchanged; piece hits are verified with Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Items of one automaton, which every task holds; more items are matched in further blocks over all documents.
BLOCK = 20_000


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return " ".join(text.lower().split()) if text else ""


def budget(length: int) -> int:
    return length // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(key, text, C.pattern_masks(text)) for key, text in items if text]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, _) in enumerate(self.items):
            for offset, piece in pieces(text):
                places.setdefault(piece, []).append((i, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """item_id -> least number of edits between the item and a substring of text, within the item's budget."""
        found: dict[int, int] = {}
        if not self.items or not text:
            return found
        seen: dict[tuple[int, int], tuple[int, int]] = {}  # least and largest start tried of each item and stretch
        for end, places in self.automaton.iter(text):
            for i, back in places:
                start = end + 1 - back
                key, item, masks = self.items[i]
                edits = budget(len(item))
                at = start // (edits + 1)  # starts of one stretch are within the budget of each other
                before, same, after = (seen.get((i, at + k)) for k in (-1, 0, 1))
                if found.get(key) == 0 or same or before and start - before[1] <= edits or after and after[0] - start <= edits:
                    continue
                seen[i, at] = (start, start)
                # starts within the budget of any start skipped above lie in here too
                window = text[max(0, start - 2 * edits) : start + len(item) + 2 * edits]
                d = 0 if item in window else C.myers(masks, len(item), window, inside=True)[0]
                if d <= edits:
                    found[key] = min(d, found.get(key, d))
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK rows, one after another; each passes the driver alone."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n = -(-items.count() // BLOCK) or 1
    for i in range(n):
        yield [(r["item_id"], normalise(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()]


_matchers: dict[int, Matcher] = {}


def _matcher(sent) -> Matcher:
    if sent.value[0] not in _matchers:
        _matchers.clear()
        _matchers[sent.value[0]] = Matcher(sent.value[1])
    return _matchers[sent.value[0]]


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance): each item found in each text of (doc_id, text), distance edits away at most
    len(item) / CHARS_PER_EDIT, on lower-cased text with single spaces.

    Null and empty texts and items match nothing; of rows that repeat a doc_id the least distance counts; a null doc_id
    is reported as null. Empty tables give no rows. Documents are read once for each BLOCK of items; nothing of them is
    shuffled but the matches."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    C.in_small_batches(documents.sparkSession)
    found = None
    for block in _blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast((hash(tuple(block)), block))

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = _matcher(sent)
            for b in batches:
                rows = [(doc, key, d) for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for key, d in m.find(normalise(text.as_py())).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "item_id", "distance"])

        new = docs.mapInArrow(C.tidied(match), "doc_id long, item_id long, distance long")
        found = new if found is None else found.union(new)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _holds_item(sent):
    @F.pandas_udf(T.BooleanType())
    def hit(texts: pd.Series) -> pd.Series:
        m = _matcher(sent)
        return pd.Series([bool(m.find(normalise(t))) for t in texts], dtype=bool)

    return hit


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents whose text holds no item, with all their columns; no shuffle."""
    C.in_small_batches(documents.sparkSession)
    for block in _blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast((hash(tuple(block)), block))
        documents = documents.where(~_holds_item(sent)(F.col("text").cast("string")))
    return documents
