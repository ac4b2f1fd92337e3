"""SentencePiece encoding by suffix-array matching: the new chunks of a batch of texts are laid end to end and indexed,
every piece is looked up by binary search, the edges found are sorted by position, and chunks are relaxed over them all
at once, best merge first. Decoding joins pieces and bytes again."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of text that are cut in chunks at a time, those of new chunks that are indexed at a time (an index takes
#: some 200 bytes a character), and chunks whose ids a task remembers.
BATCH_CHARS, INDEX_CHARS, REMEMBERED = 1_000_000, 400_000, 250_000
#: Longer chunks are relaxed one by one with a heap, as a round over all of them merges one pair of each.
LONG = 256


#: fixed values: fields of a model file (protocol buffers): trainer and normaliser messages, their type and name, and the
#: number that stands for BPE; unigram is the type where none is given
TRAINER, NORMALISER, MODEL_TYPE, NAME, BPE, UNIGRAM = 2, 3, 3, 1, 2, 1


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if size is None else size
            yield key >> 3, raw[at : at + size]
            at += size


def model_kind(path: str) -> tuple[int, str]:
    """Type of a model and the name of its normaliser."""
    kind, normaliser = UNIGRAM, ""
    with open(path, "rb") as f:
        for field, value in _fields(f.read()):
            if field == TRAINER:
                kind = dict(_fields(value)).get(MODEL_TYPE, kind)
            elif field == NORMALISER:
                normaliser = dict(_fields(value)).get(NAME, b"").decode()
    return kind, normaliser


@dataclass
class Vocabulary:
    """The pieces of a BPE model with byte fallback, as plain arrays that go to the tasks."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: list[int]
    unknown: int
    kinds: bytes  # of each id: n normal, b byte, u unknown, c control

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kind, normaliser = model_kind(path)
        if kind != BPE or normaliser not in ("", "identity"):
            raise ValueError(f"{path}: model type {kind}, normaliser {normaliser!r}; only BPE models that leave texts as they are can be encoded by merging")
        n = sp.get_piece_size()
        kinds = b"".join(b"b" if sp.is_byte(i) else b"u" if sp.is_unknown(i) else b"c" if sp.is_control(i) or sp.is_unused(i) else b"n" for i in range(n))
        pieces = [sp.id_to_piece(i) for i in range(n)]
        at = {p: i for i, p in enumerate(pieces)}
        return cls(pieces, np.array([sp.get_score(i) for i in range(n)]), [at.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)], sp.unk_id(), kinds)

    def __post_init__(self) -> None:
        normal = [i for i, k in enumerate(self.kinds) if k == ord("n")]
        self.single = {self.pieces[i]: i for i in normal if len(self.pieces[i]) == 1}
        self.ids = np.array([i for i in normal if len(self.pieces[i]) > 1], dtype=np.int32)
        words = [self.pieces[i] for i in self.ids]
        if any(SPACE in w.lstrip(SPACE) for w in words):
            raise ValueError("a piece holds a space after a letter: texts cannot be cut at spaces")
        self.most = max(map(len, words))
        self.codes = np.zeros((len(words), self.most), np.uint32)
        for i, w in enumerate(words):
            self.codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        self.lengths = np.array([len(w) for w in words], dtype=np.int32)
        # no piece reaches over a character that is in none, so each such character is a chunk
        inner = "".join(re.escape(c) for c in sorted({c for w in words for c in w} - {SPACE}))
        self.chunk = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|.", re.S)
        self.known: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("pieces", "scores", "byte_ids", "unknown", "kinds")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    # --- encoding -----------------------------------------------------------------------------------------------------

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Positions sorted by the characters that follow, as far as the longest piece reaches (prefix doubling)."""
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        width = 1
        while True:
            ahead = np.zeros(len(rank), np.int64)
            ahead[:-width] = rank[width:]
            both = rank * (len(rank) + 2) + ahead
            order = np.argsort(both)
            width *= 2
            if width >= self.most:
                return order
            sorted_ = both[order]
            rank[order] = np.cumsum(np.r_[1, sorted_[1:] != sorted_[:-1]])

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each occurrence of a piece of two characters or more: position * (most + 1) + length, sorted, and its id."""
        order = self.suffixes(codes)
        padded = np.r_[codes, np.zeros(self.most, codes.dtype)]
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(order), np.int64)
        for depth in range(self.most):
            live = np.flatnonzero((self.lengths > depth) & (low < high))
            if not len(live):
                break
            wanted = self.codes[live, depth]
            for right in (False, True):  # first not below the wanted character, then first above it
                a, b = low[live].copy(), high[live].copy()
                while (a < b).any():
                    mid = (a + b) >> 1
                    seen = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                    up = (seen <= wanted if right else seen < wanted) & (a < b)
                    a, b = np.where(up, mid + 1, a), np.where(up | (a >= b), b, mid)
                if right:
                    high_live = a
                else:
                    low_live = a
            low[live], high[live] = low_live, high_live
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n), dtype=np.int32), n)
        kind = np.int32 if len(codes) * (self.most + 1) < 2**31 else np.int64
        order = order.astype(kind)
        at = order[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        keys = at * kind(self.most + 1) + self.lengths[which]
        by = np.argsort(keys)
        return keys[by], self.ids[which[by]]

    def relax(self, codes: np.ndarray, starts: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the symbols left when in each chunk the best pair, leftmost of equals, has been merged
        until no pair is a piece. starts: of the chunks, with the end of the last; a chunk ends before a 0."""

        def scores(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            out = np.full(len(start), -np.inf)
            fits = end - start <= self.most
            key = (start[fits] * (self.most + 1) + (end - start)[fits]).astype(keys.dtype)
            i = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            if len(keys):
                out[fits] = np.where(keys[i] == key, self.scores[ids[i]], -np.inf)
            return out

        done_at, done_len = [], []
        sizes = np.diff(starts) - 1
        for c in np.flatnonzero(sizes > LONG):
            at, length = self._relax_long(starts[c], starts[c] + sizes[c], keys, ids)
            done_at.append(at)
            done_len.append(length)
        short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
        n = sizes[short]
        owner = np.repeat(np.arange(len(short)), n)
        at = np.repeat(starts[short] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        end = at + 1
        last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.empty(0, bool)
        pair = np.where(last, -np.inf, scores(at, np.r_[end[1:], 0])) if len(at) else np.empty(0)
        while len(at):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.maximum.reduceat(pair, first)
            counts = np.diff(np.r_[first, len(owner)])
            ended = np.repeat(best == -np.inf, counts)
            done_at.append(at[ended])
            done_len.append((end - at)[ended])
            hit = np.flatnonzero((pair == np.repeat(best, counts)) & ~ended)
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]] if len(hit) else hit
            end[hit] = end[hit + 1]
            pair[hit] = pair[hit + 1]  # -inf if the merged one is last now
            stay = ~ended
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            hit = place[hit]
            at, end, owner, pair = at[stay], end[stay], owner[stay], pair[stay]
            if not len(hit):
                continue
            inner = hit[(hit + 1 < len(at))]
            inner = inner[owner[inner + 1] == owner[inner]]
            pair[hit] = -np.inf
            pair[inner] = scores(at[inner], end[inner + 1])
            before = hit[hit > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            pair[before] = scores(at[before], end[before + 1])
        if not done_at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, length = np.concatenate(done_at), np.concatenate(done_len)
        order = np.argsort(at)
        return at[order], length[order]

    def _relax_long(self, start: int, stop: int, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(keys, [start * (self.most + 1), stop * (self.most + 1)])
        score = dict(zip((keys[low:high]).tolist(), self.scores[ids[low:high]].tolist(), strict=True))
        after, before = {i: i + 1 for i in range(start, stop)}, {i + 1: i for i in range(start, stop)}
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < stop and (c := after[b]) - a <= self.most and (s := score.get(a * (self.most + 1) + c - a)) is not None:
                heapq.heappush(heap, (-s, a, b, c))

        for a in range(start, stop):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if after.get(a) == b and after.get(b) == c:
                after[a], before[c] = c, a
                del after[b]
                offer(a)
                if a > start:
                    offer(before[a])
        at = np.array(sorted(after), np.int64)
        return at, np.array([after[a] for a in at.tolist()], np.int64) - at

    def learn(self, chunks: list[str]) -> None:
        """Encodes distinct chunks together and remembers their ids as bytes."""
        text = "\0".join([*chunks, ""])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(c) for c in chunks])
        starts = np.r_[0, np.cumsum(sizes + 1)]
        keys, ids = self.edges(codes)
        at, length = self.relax(codes, starts, keys, ids)
        known = {}
        found = ids[np.minimum(np.searchsorted(keys, (at * (self.most + 1) + length).astype(keys.dtype)), max(len(keys) - 1, 0))] if len(keys) else np.zeros(len(at), np.int64)
        singles = {}
        values = np.unique(codes)
        for v in values.tolist():
            c = chr(v)
            singles[v] = [self.single[c]] if c in self.single else [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        plain = np.array([singles[v][0] if len(singles[v]) == 1 else -1 for v in values.tolist()])
        one = length == 1
        found = np.where(one, plain[np.searchsorted(values, codes[at])], found)
        owner = np.searchsorted(starts, at, side="right") - 1
        if (found < 0).any():
            parts = [singles[v] if f < 0 else [f] for f, v in zip(found.tolist(), codes[at].tolist(), strict=True)]
            owner = np.repeat(owner, [len(p) for p in parts])
            found = np.array([x for p in parts for x in p])
        cuts = np.searchsorted(owner, np.arange(len(chunks) + 1)) * 4
        raw = found.astype(np.int32).tobytes()
        for c, a, b in zip(chunks, cuts.tolist(), cuts[1:].tolist(), strict=False):
            known[c] = raw[a:b]
        self.known.update(known)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text as 32-bit integers; None for None."""
        out: list[bytes | None] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < BATCH_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            if len(self.known) > REMEMBERED:
                self.known = {}
            cut = [None if t is None else self.chunk.findall((SPACE + t.replace(" ", SPACE)) if t else "") for t in texts[start:stop]]
            new = list(set().union(*(c for c in cut if c)) - self.known.keys())
            sizes = np.cumsum([len(c) for c in new]) // INDEX_CHARS
            for part in np.split(np.arange(len(new)), np.flatnonzero(np.diff(sizes)) + 1) if new else ():
                self.learn([new[i] for i in part])
            out += [None if c is None else b"".join(map(self.known.__getitem__, c)) for c in cut]
            start = stop
        return out

    # --- decoding -----------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        """The text of ids: pieces joined, bytes put together as UTF-8, the first space dropped."""
        if ids is None:
            return None
        if not hasattr(self, "raw"):
            value = {i: b for b, i in enumerate(self.byte_ids)}
            self.raw = [bytes([value[i]]) if k == ord("b") else b"" if k == ord("c") else " ⁇ ".encode() if k == ord("u") else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def _given(spark, path: str):
    return spark.sparkContext.broadcast(Vocabulary.load(path))


def encode(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) for each row of (doc_id, text): the ids that the model's library gives.

    round_trip says that decoding gives the text back, which it does unless the text holds U+2581 or a lone surrogate. A
    null text gives null ids, 0 pieces and a null round_trip; an empty one no ids. Repeated rows and null doc_ids are
    rows like others; an empty table gives none. Nothing is shuffled; a task holds BATCH_CHARS characters at a time."""
    C.in_small_batches(documents.sparkSession)
    sent = _given(documents.sparkSession, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.column(1).slice(start, 1000).to_pylist()
                raw = v.encode(part)
                ids = [None if r is None else np.frombuffer(r, np.int32) for r in raw]
                same = [None if t is None else v.decode(i.tolist()) == t for t, i in zip(part, ids, strict=True)]
                n = [0 if i is None else len(i) for i in ids]
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(r for r in raw if r is not None), np.int32))
                lists = pa.ListArray.from_arrays(offsets, values, mask=pa.array([i is None for i in ids], pa.bool_()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, 1000), pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(C.tidied(rows), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with a column text made from ids (null for null)."""
    sent = _given(encoded.sparkSession, path)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([sent.value.decode(None if i is None else i.tolist()) for i in ids], dtype=object)

    return encoded.withColumn("text", text("ids"))
