"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as secret begin, inside or
outside from their shape, their neighbours and features of the file, decoded by Viterbi."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Documents, at most, that the field is fitted on, those of smallest hash; and runs of tokens from them, at most, with a
#: secret and without one, again those of smallest hash.
TRAIN_ROWS, TRAIN_RUNS = 10_000, (4_000, 8_000)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

#: What keys and secrets are written with. A token is a run of it, or one other sign.
SIGN = "A-Za-z0-9+/_.=-"
TOKEN = re.compile(rf"[{SIGN}]+|[^\s{SIGN}]")
#: Tokens that chains are laid around: those of eight signs or more that are no word of up to 15 letters, and those that
#: hold a word for secrets. A chain takes in AROUND tokens on both sides, whatever they are.
ODD = re.compile(rf"(?<![{SIGN}])(?![A-Za-z]{{1,15}}[.]?(?![{SIGN}]))[{SIGN}]{{8,}}")
KEYS = ("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "credential", "bearer")
KEY = re.compile(rf"(?<![{SIGN}])(?=[{SIGN}]*?(?:{'|'.join(KEYS)}))[{SIGN}]+", re.I)
AROUND = 3
_AFTER = re.compile(rf"(?:\s*(?:[{SIGN}]+|[^\s{SIGN}])){{0,{AROUND}}}")
_PROSE = re.compile(r"[A-Za-z]{1,15}[.]?")
TAGS = 3  # outside, begin, inside
O, B, I = range(TAGS)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and non-overlapping for each kind."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYS):
        out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shape(token: str) -> str:
    """Runs of upper, lower, digit and other signs, each run once; of a token of many runs, which kinds there are."""
    runs = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", token))))
    return runs if len(runs) <= 12 else "many:" + "".join(sorted(set(runs)))


def own(token: str) -> list[str]:
    """Features of a token by itself."""
    n = len(token)
    counts = Counter(token)
    bits = -sum(k / n * math.log2(k / n) for k in counts.values())
    digits = sum(k for c, k in counts.items() if c.isdigit())
    out = ["shape=" + shape(token), f"len={min(int(math.log2(n)), 8)}", f"bits={round(bits)}", f"digits={10 * digits // n}", "is=" + word_of(token)]
    if re.fullmatch(r"[0-9a-f]+", token) and n >= 8:
        out.append("hex")
    if n >= 8 and digits and digits < n:
        out.append("mixed")
    return out


def word_of(token: str) -> str:
    """How a token looks to its neighbours: all words for secrets alike, other prose by length, signs as they are, the rest
    by shape."""
    low = token.lower()
    if any(k in low for k in KEYS):
        return "key" if _PROSE.fullmatch(token) or len(token) < 8 else "key+"
    return f"prose{min(len(token), 9) // 3}" if _PROSE.fullmatch(token) else token if len(token) == 1 else shape(token)


def features(tokens: list[str], file: str) -> list[list[str]]:
    """Shape, neighbouring words and the file's features of each token of a chain."""
    looks = ["edge"] * AROUND + [word_of(t) for t in tokens] + ["edge"]
    out = []
    for i, token in enumerate(tokens):
        mine = own(token)
        out.append([*mine, file, f"{file}&{mine[0]}", f"+1={looks[AROUND + i + 1]}", *(f"-{d}={looks[AROUND + i - d]}" for d in range(1, AROUND + 1)), f"-2-1={looks[AROUND + i - 2]} {looks[AROUND + i - 1]}"])
    return out


def file_feature(text: str) -> str:
    """What kind of file it looks like: share of lines with an assignment, and whether it is code."""
    lines = text.count("\n") + 1
    return f"file={min(3, 4 * (text.count('=') + text.count(': ')) // lines)}{int('{' in text and ';' in text)}"


def _before(text: str, start: int) -> list[tuple[int, int]]:
    """The last AROUND tokens before a place."""
    size = 64
    while True:
        low = max(0, start - size)
        found = [(low + m.start(), low + m.end()) for m in TOKEN.finditer(text[low:start])]
        if not low or len(found) > AROUND:  # the first of more may be cut
            return found[-AROUND:]
        size *= 4


def token_runs(text: str) -> list[list[tuple[int, int, list[str]]]]:
    """Chains of neighbouring tokens, as (start, end, features): ODD and KEY tokens with AROUND tokens on both sides, chains
    that touch being one."""
    low = text.lower()
    anchors = {m.span() for m in ODD.finditer(text)} | ({m.span() for m in KEY.finditer(text)} if any(k in low for k in KEYS) else set())
    if not anchors:
        return []
    runs: list[list[tuple[int, int]]] = []
    last = -1
    for start, end in sorted(anchors):
        after = _AFTER.match(text, end)
        near = [*_before(text, start), (start, end), *((end + m.start(), end + m.end()) for m in TOKEN.finditer(after[0]))]
        if last < 0 or near[0][0] > last and text[last : near[0][0]].strip():
            runs.append([])
            last = -1
        new = [t for t in near if t[0] >= last]
        runs[-1] += new
        last = max([last, *(e for _, e in new)])
    file = file_feature(text)
    return [[(s, e, f) for (s, e), f in zip(run, features([text[s:e] for s, e in run], file), strict=True)] for run in runs]


class Field:
    """Weights of a linear-chain field over chains of tokens; what stands around a chain is outside."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.emit = np.zeros((0, TAGS))
        self.move = np.zeros((TAGS, TAGS))
        self.move[O, I] = -30.0  # inside follows begin or inside alone

    def fit(self, chains: list[tuple[list[list[str]], list[int]]], rounds: int = 150) -> Field:
        """Gradient steps on the conditional likelihood, by forward and backward sums, chains of a length together."""
        for feats, _ in chains:
            for fs in feats:
                for f in fs:
                    self.at.setdefault(f, len(self.at))
        by_length: dict[int, list[int]] = {}
        for i, (_, tags) in enumerate(chains):
            by_length.setdefault(len(tags), []).append(i)
        groups = []
        for n, members in sorted(by_length.items()):
            cell = np.array([j * n + t for j, i in enumerate(members) for t in range(n) for _ in chains[i][0][t]])
            ids = np.array([self.at[f] for i in members for t in range(n) for f in chains[i][0][t]])
            groups.append((n, len(members), cell, ids, np.array([chains[i][1] for i in members])))
        size = len(self.at)
        self.emit = np.zeros((size, TAGS))
        if not groups:
            return self
        seen = np.sum([np.bincount(g[3], minlength=size) for g in groups], axis=0)
        total, fixed = sum(n * m for n, m, *_ in groups), self.move[O, I]
        ve, vm = np.zeros_like(self.emit), np.zeros_like(self.move)
        added = lambda at, values, n: np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(TAGS)], 1)
        for _ in range(rounds):
            ge, gm = np.zeros_like(self.emit), np.zeros_like(self.move)
            for n, m, cell, ids, tags in groups:
                e = added(cell, self.emit[ids], m * n).reshape(m, n, TAGS)
                fwd, back = np.zeros((m, n, TAGS)), np.zeros((m, n, TAGS))
                fwd[:, 0] = e[:, 0] + self.move[O]
                for t in range(1, n):
                    fwd[:, t] = e[:, t] + np.logaddexp.reduce(fwd[:, t - 1, :, None] + self.move, axis=1)
                back[:, -1] = self.move[:, O]
                for t in range(n - 2, -1, -1):
                    back[:, t] = np.logaddexp.reduce(self.move + (e[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
                z = np.logaddexp.reduce(fwd[:, -1] + self.move[:, O], axis=1)
                p = np.exp(fwd + back - z[:, None, None])
                p[np.arange(m)[:, None], np.arange(n), tags] -= 1
                ge += added(ids, p.reshape(m * n, TAGS)[cell], size)
                gm[O] += p[:, 0].sum(0)
                gm[:, O] += p[:, -1].sum(0)
                for t in range(1, n):
                    q = np.exp(fwd[:, t - 1, :, None] + self.move + (e[:, t] + back[:, t])[:, None, :] - z[:, None, None])
                    q[np.arange(m), tags[:, t - 1], tags[:, t]] -= 1
                    gm += q.sum(0)
            ve = 0.9 * ve - 0.2 * (ge / np.sqrt(seen + 1)[:, None] / 10 + 0.001 * self.emit)
            vm = 0.9 * vm - 1.0 * gm / total
            self.emit += ve
            self.move += vm
            self.move[O, I] = fixed
        return self

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The likeliest tags of a run (Viterbi)."""
        best, back = self.move[O], []
        for t, fs in enumerate(feats):
            ids = [self.at[f] for f in fs if f in self.at]
            e = self.emit[ids].sum(0) if ids else np.zeros(TAGS)
            if t:
                total = best[:, None] + self.move
                back.append(total.argmax(0))
                best = total.max(0)
            best = best + e
        tags = [int((best + self.move[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each begin tag with its inside tags."""
        out: list[tuple[int, int]] = []
        for run in token_runs(text):
            for tag, (start, end, _) in zip(self.decode([f for _, _, f in run]), run, strict=True):
                if tag == B:
                    out.append((start, end))
                elif tag == I:
                    out[-1] = (out[-1][0], end)
        return out


def _overlaps(spans: list[tuple[int, int]], starts: list[int], start: int, end: int) -> int | None:
    """Which of the sorted, disjoint spans a range overlaps first. starts: theirs."""
    k = max(0, bisect.bisect_right(starts, start) - 1)
    return next((i for i in range(k, min(k + 2, len(spans))) if spans[i][0] < end and start < spans[i][1]), None)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap being one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def chains(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """The chains of a text with the tags that the patterns give: begin for a secret's first token, inside for its others."""
    low = text.lower()
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(k in low for k in KEYS) else []
    spans = _union(spans + [(s, e) for s, e, k in base_spans(text) if k != "assign"])
    starts = [s for s, _ in spans]
    out = []
    for run in token_runs(text):
        tags, before = [], None
        for start, end, _ in run:
            k = _overlaps(spans, starts, start, end)
            tags.append(O if k is None else I if k == before else B)
            before = k
        out.append(([f for _, _, f in run], tags))
    return out


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS, train_runs: tuple[int, int] = TRAIN_RUNS) -> Field:
    """A field fitted on chains of at most train_rows documents, at most train_runs with and without a secret, with the
    patterns' matches as the tags. Chains, not texts, come to the driver.

    Documents of a null doc_id aren't fitted on; null and empty texts have no chains; rows that repeat a doc_id give
    theirs each; without any chain all tokens are outside."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    C.in_small_batches(documents.sparkSession)
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = C.saved(ids.distinct())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(any(tags), "\n".join("\t".join([str(t), *fs]) for t, fs in zip(tags, feats, strict=True))) for text in b.column(1) for feats, tags in chains(text.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.string())], names=["secret", "chain"])

    every = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(C.tidied(windows), "secret boolean, chain string")
    every = C.saved(every.distinct())
    first = lambda secret, n: every.where(F.col("secret") == secret).orderBy(F.xxhash64("chain"), "chain").limit(n)
    rows = sorted(r["chain"] for k, n in zip((True, False), train_runs, strict=True) for r in first(k, n).collect())
    split = [[token.split("\t") for token in r.split("\n")] for r in rows]
    return Field().fit([([t[1:] for t in c], [int(t[0]) for t in c]) for c in split])


def scan(documents: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans): for each row of (doc_id, text) all secrets as an array of (kind, start, end) in code points, end
    exclusive, ordered by start, then kind as assign, access, hex, crf. crf marks what the field adds outside the
    patterns' spans. Null and empty texts have none; repeated rows and null doc_ids are rows like others; very long texts
    and tokens are taken whole; of paths of equal weight the one of smaller tags counts (outside, begin, inside); columns
    beside the two play no part; an empty table gives none. Nothing is shuffled."""
    sent = documents.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                taken = _union([(s, e) for s, e, _ in base])
                starts = [s for s, _ in taken]
                more = [(s, e, "crf") for s, e in sent.value.spans(text) if _overlaps(taken, starts, s, e) is None]
                every = sorted([*base, *more], key=lambda s: (s[0], (*KINDS, "crf").index(s[2]), s[1]))
                out.append([{"kind": k, "start": s, "end": e} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(C.tidied(find), "doc_id long, spans array<struct<kind string, start int, end int>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of each pattern, the hash of the patterns' spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *(n(k) for k in KINDS), F.sha2(join(base), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
