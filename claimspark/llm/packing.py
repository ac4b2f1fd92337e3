"""Best-fit packing of tokenised documents into sequences, certified by dual feasible functions.

Documents are tokenised once; only what is longer than a sequence is cut. Tails are dealt to partitions of bounded size,
each packed by best-fit decreasing and held against a lower bound of its bins; what a partition leaves ill filled is
exchanged with the others and packed again."""

from __future__ import annotations

import codecs
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MODEL = public_tokenizers.path("word_bpe_49k.json")
#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 2048, 0
#: Pieces that one task packs.
PIECES = 50_000
#: Bins with this share of their space free, or more, leave a partition that isn't certified.
SLACK = 1 / 64
#: Rounds end when one saves less than this share of the bins that were exchanged.
LEAST_SAVED = 0.001
#: Words whose ids a worker remembers, twice so many at most, of up to so many bytes each.
WORDS, WORD_BYTES = 400_000, 64
#: Stands between words that are encoded together; marks that a word may end with, apart from which it is looked up.
MARK, MARK_BYTE, MARKS = "\x01", b"\x01", b".,;:!?"

#: Words of these letters, lower-cased, are left as they are and whole by the following rules, as a tokenizer's file gives
#: them, but that each byte is written as a letter: those of bytes that have one in Latin-1, and 256 and so on for others.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_OTHERS = iter(range(256, 512))
BYTE_LETTERS = "".join(chr(b) if b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)) else chr(next(_OTHERS)) for b in range(256)).replace("\u0120", " ")
KEEPS_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- tokens -----------------------------------------------------------------------------------------------------------


class Encoder:
    """The tokenizer's ids of whole texts, put together from those of their words.

    Its rules never join what white space parts (normal forms, lower case, the pattern of words and the added tokens all
    stay within a word), so a text's ids are its words' ids in order, and a word that comes again is looked up. Letters and
    the marks after them never join either. Words of Latin letters skip rules that would leave them as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.known, self.former = Tokenizer.from_file(path), {b"": b""}, {}
        self.mark = self._ids(MARK)
        self.last = np.zeros(self.model.get_vocab_size() + 1, bool)
        self.last[[i for w, i in self.model.get_vocab().items() if w.endswith("</w>")]] = True
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no id of its own for U+0001")
        rules = json.loads(self.model.to_str())
        self.plain = None
        if all(rules[k] == v for k, v in KEEPS_WORDS.items()) and not any(t["content"].isalpha() for t in rules["added_tokens"]):
            split = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.plain = Tokenizer.from_str(json.dumps(rules | split))

    def _ids(self, text: str, plain: bool = False) -> np.ndarray:
        model = self.plain if plain else self.model
        return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, none of which holds MARK: read as one text with marks between, and cut at the marks' id."""
        ids = self._ids(f" {MARK} ".encode().join(words).decode())
        at = np.r_[-1, np.flatnonzero(ids == self.mark[0]), len(ids)]
        raw = ids.tobytes()
        return [raw[4 * (s + 1) : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def letters(self, words: list[bytes], plain: bool = False) -> list[bytes]:
        """Ids of words of letters alone, each of which ends with the only id that ends a word. plain: they are all of LATIN
        and in lower case."""
        text = b" ".join(words)
        ids = self._ids(codecs.charmap_decode(text, "strict", BYTE_LETTERS)[0], True) if plain and self.plain else self._ids(text.decode())
        at = np.r_[0, np.flatnonzero(self.last[ids]) + 1].tolist()
        if len(at) != len(words) + 1:  # a letter whose lower case holds a mark
            return self.words(words)
        raw = ids.tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip(at[:-1], at[1:], strict=True)]

    def looked_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, which are remembered."""
        if len(self.known) > WORDS:  # words that come again return from the former ones
            self.former, self.known = self.known, {b"": b""}
        known, former = self.known, self.former
        out = list(map(known.get, words))
        unknown = [i for i, x in enumerate(out) if x is None]
        if former:
            back = [i for i in unknown if words[i] in former]
            for i in back:
                out[i] = known[words[i]] = former[words[i]]
            unknown = [i for i in unknown if out[i] is None]
        places, new, stems, plain, other = [], [], [], set(), set()
        for i in unknown:
            w = words[i]
            if len(w) > WORD_BYTES or MARK_BYTE in w:
                out[i] = self._ids(w.decode()).tobytes()
                continue
            s = w.rstrip(MARKS)
            if s.isalpha():
                s = s.lower()
                plain.add(s)
            elif LATIN(t := s.decode()):
                s = t.lower().encode()
                plain.add(s)
            elif t.isalpha():
                other.add(s)
            else:
                s = None
            places.append(i)
            new.append(w)
            stems.append(s)
        tails = [b"" if s is None else w[len(s) :] for w, s in zip(new, stems, strict=True)]
        rest = {w for w, s in zip(new, stems, strict=True) if s is None}.union(tails)
        for encode, wanted in ((partial(self.letters, plain=True), plain), (self.letters, other), (self.words, rest)):
            found = [w for w in wanted if w not in known]  # a set less a dict's keys would go through all that is known
            for i in range(0, len(found), 1000):
                known.update(zip(found[i : i + 1000], encode(found[i : i + 1000]), strict=True))
        for i, w, s, tail in zip(places, new, stems, tails, strict=True):
            out[i] = known[w] = known[w] if s is None else known[s] + known[tail] if tail else known[s]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of all texts in a row, and where each one's end."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary())
        if not len(distinct):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
        raw = distinct.buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        known = self.looked_up([raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)])
        ids, n = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, words = np.cumsum(n) - n, coded.indices.to_numpy()
        parts = []
        for i in range(0, len(words), 1 << 20):
            some = words[i : i + (1 << 20)]
            ends = np.cumsum(n[some])
            parts.append(ids[np.repeat(start[some] - ends + n[some], n[some]) + np.arange(ends[-1])])
        return np.concatenate(parts), np.r_[0, np.cumsum(n[words])][split.offsets.to_numpy()[1:]]


#: One for each file and worker.
_ENCODERS: dict[str, Encoder] = {}


def pieces(documents: DataFrame, path: str = MODEL, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and END, cut only where they exceed `capacity`.

    path: the tokenizer's file, on every executor. Null texts are empty ones: END alone. Lone surrogates are read as ?."""
    C.in_small_batches(documents.sparkSession, 500)
    end = np.array([END], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the work
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for b in batches:
            out = []
            ids, ends = encoder.ids(b.column(1))
            for doc_id, s, e in zip(b.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                raw = ids[s:e].tobytes() + end
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(C.tidied(rows), PIECE)


# --- bounds and bins --------------------------------------------------------------------------------------------------


def least_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, most_k: int = 64) -> int:
    """A number of bins that no packing of so many pieces of these lengths goes below.

    The best of three families of dual feasible functions: the sum itself; lengths above capacity - e counted whole and
    those below e left out (Martello and Toth, 1990), for each e; and lengths rounded to k-ths, those that are no multiple
    of capacity / (k + 1) downwards (Fekete and Schepers, 2001), for k up to most_k."""
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, lengths, counts)
    x = np.arange(capacity + 1, dtype=np.int64)
    up = lambda a, b: -(-int(a) // int(b))
    n_from, sum_upto = np.r_[np.cumsum(hist[::-1])[::-1], 0], np.r_[0, np.cumsum(hist * x)]
    best = up(sum_upto[-1], capacity)
    e = np.arange(1, capacity // 2 + 1)
    # whole: x > capacity - e; as they are: e <= x <= capacity - e
    whole, kept = n_from[capacity - e + 1], sum_upto[capacity - e + 1] - sum_upto[e]
    best = max(best, int((whole - (-kept // capacity)).max(initial=0)))
    for k in range(1, most_k + 1):
        exact = ((k + 1) * x) % capacity == 0
        a, b = int((hist * x)[exact].sum()), int((hist * ((k + 1) * x // capacity))[~exact].sum())
        best = max(best, up(a * k + b * capacity, k * capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and the bins' fill. Longest first, each to the fullest bin that
    has room; of equal bins the latest opened."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    some = 0  # a bit for each free space that a bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                some ^= 1 << space
        else:
            space, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        if left := space - size:
            free[left].append(at)
            some |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


PACKED = f"n long, {PIECE}, sequence_id long, offset long, leaves boolean"


def pack_round(pool: DataFrame, round_: int, n_parts: int, capacity: int = CAPACITY) -> DataFrame:
    """pool (n, doc_id, piece, start, length, ids_crc32) packed in n_parts partitions dealt by hash: sequence_id, offset,
    and whether the piece leaves for the next exchange.

    A partition with a gap to its bound passes on all bins with SLACK of their space free, and so does a certified one
    with room for a whole bin more, which others may fill. One that has neither keeps all but its emptiest bin, as the
    bound is rounded up in each."""

    def pack(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        order = pc.sort_indices(table, [("n", "ascending")])
        table = table.drop_columns("_part").take(order)
        lengths = table.column("length").to_numpy()
        at, offsets, fill = best_fit(lengths, capacity)
        certified = len(fill) == least_bins(lengths, np.ones(len(lengths), np.int64), capacity)
        leaves = np.zeros(len(fill), bool)
        if n_parts > 1:
            if not certified or len(fill) * capacity - lengths.sum() >= capacity:
                leaves = fill <= capacity * (1 - SLACK)
            leaves[np.argmin(fill)] = True
        sequence = (np.int64(round_) << np.int64(52)) + (np.int64(part) << np.int64(20)) + at
        C.tidy()
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets)).append_column("leaves", pa.array(leaves[at]))

    dealt = pool.withColumn("_part", F.pmod(F.xxhash64("n", F.lit(round_)), F.lit(n_parts)).cast("long"))
    return dealt.groupBy("_part").applyInArrow(pack, PACKED)


def pack(pieces_: DataFrame, capacity: int = CAPACITY, per_task: int | None = None) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: sequences of at most `capacity`
    tokens, without gaps, as few as bound-certified best-fit decreasing gets. Every row is a piece of its own, so repeated
    ids and rows and null ids are packed like others; an empty table gives none.

    Full pieces are sequences by themselves. The others are dealt by hash to partitions of some `per_task` pieces; after a
    round only what leaves its partition is dealt anew, till it fits one task or a round saves next to nothing."""
    per_task = per_task or PIECES
    rows = C.saved(pieces_.withColumn("n", F.monotonically_increasing_id()))
    columns = [c.split()[0] for c in PIECE.split(", ")]
    full = rows.where(F.col("length") >= capacity).select(*columns, (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool, done, round_, had, was = rows.where(F.col("length") < capacity).select("n", *columns), [full], 0, None, None
    size = pool.count()
    while size:
        n_parts = math.ceil(size / per_task)
        packed = C.saved(pack_round(pool, round_, n_parts, capacity))
        bins = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if had is not None and had - bins < LEAST_SAVED * had:
            done.append((was if bins >= had else packed).select(*columns, "sequence_id", "offset"))
            break
        done.append(packed.where("not leaves").select(*columns, "sequence_id", "offset"))
        was = packed.where("leaves")
        pool, round_ = was.select("n", *columns), round_ + 1
        had, bound = certificate(was, capacity)
        size = was.count()
        if had == bound:  # no exchange can save any
            done.append(was.select(*columns, "sequence_id", "offset"))
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and the least number that any packing of these pieces needs: from the counts of each
    length, at most `capacity` rows."""
    lengths = packed.groupBy("length").count().collect()
    bound = least_bins(np.array([r["length"] for r in lengths], int), np.array([r["count"] for r in lengths], int), capacity)
    return packed.agg(F.count_distinct("sequence_id")).first()[0], bound
