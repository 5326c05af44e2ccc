"""Repeated word windows by recompression.

A text is a string of symbols, at first one per word. Each round names runs of one symbol and then pairs (a symbol of the
left half of the alphabet followed by one of the right half; a seeded hash halves the alphabet). Names are hashes of
what they stand for, so all chunks name alike without meeting, and equal substrings get equal symbols but for a fringe
at their ends. For every symbol its support is kept: the words that alone decide that it stands there. A symbol whose
support lies inside a window is therefore a symbol of every equal window.

Each window is named by its symbol of the highest round with such a support (of several, the least by hash), together
with the words of the support. Spark rounds over these names find the symbols that occur again; only their windows go on
to an exact comparison (windows.py), which verifies the repeats. Three rounds are the default: more (rounds=None: until
no support fits in a window) give the same result from 2.7 times the names.

Edge cases. Null, empty and short texts (under `size` words) have no windows and lose nothing. A window that occurs
twice in one document is repeated. Repeated rows repeat each other. A null id is kept. An empty table gives an empty
table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import windows as W

U = np.uint64


def pair_round(name: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """Name pairs. left and right bound the supports; doc is the row of each symbol."""
    n = len(name)
    low = (C.mix(name + U(salt)) & U(1)) == 0  # the left half of the alphabet
    next_ = np.zeros(n, bool)
    next_[:-1] = doc[:-1] == doc[1:]
    pair = np.zeros(n, bool)
    pair[:-1] = next_[:-1] & low[:-1] & ~low[1:]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    # alone: a left symbol depends on what follows, a right one on what comes before
    new_left, new_right = left.copy(), right.copy()
    follows, after = np.flatnonzero(low & ~pair & next_), np.flatnonzero(~low & ~second)
    new_right[follows] = right[follows + 1]
    after = after[(after > 0) & next_[after - 1]]
    new_left[after] = left[after - 1]
    # at a document's end nothing follows: such a symbol is no property of a window
    last = np.flatnonzero(low & ~next_)
    new_right[last] = right[last] + (1 << 40)
    start = np.ones(n, bool)
    start[1:] = ~next_[:-1]
    head = np.flatnonzero(start & ~low)
    new_left[head] = left[head] - (1 << 40)
    at = np.flatnonzero(pair)
    new_name = name.copy()
    new_name[at] = C.mix(C.mix(name[at] + U(2 * salt + 1)) * U(0x2545F4914F6CDD1D) + name[at + 1])
    new_right[at] = right[at + 1]
    keep = ~second
    return new_name[keep], new_left[keep], new_right[keep], doc[keep]


def run_round(name: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """Name runs. Where a run begins and ends depends on both neighbours."""
    n = len(name)
    if not n:
        return name, left, right, doc
    head = np.ones(n, bool)
    head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    new_name = name[first].copy()
    long = size > 1
    new_name[long] = C.mix(C.mix(name[first[long]] + U(2 * salt + 2)) + size[long].astype(U))
    before = (first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first])
    after = (last < n - 1) & (doc[np.minimum(last + 1, n - 1)] == doc[first])
    new_left = np.where(before, left[np.maximum(first - 1, 0)], left[first] - (1 << 40))
    new_right = np.where(after, right[np.minimum(last + 1, n - 1)], right[last] + (1 << 40))
    return new_name, new_left, new_right, doc[first]


class Recompression(W.Scheme):
    sums = True

    hot = 1024

    def __init__(self, size: int = 35, rounds: int | None = 3):
        self.size, self.rounds = size, rounds

    def values(self, ids: pa.Array) -> np.ndarray:
        return np.ones(len(ids), np.int64)

    def levels(self, w: C.Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(name, left, right) of the symbols of each round whose support can lie in a window, words first."""
        name = C.hash_ranges(C.load8(w.buf), w.start, w.end - w.start)
        at = np.arange(w.n)
        state = (name, at, at + 1, np.repeat(np.arange(len(w.doc) - 1), w.size()))
        out = [state[:3]]
        while self.rounds is None or len(out) <= self.rounds:
            r = len(out) - 1
            state = pair_round(*run_round(*state, 3 * r + 1), 3 * r + 2)
            fits = state[2] - state[1] <= self.size
            if not fits.any():
                break
            out.append(tuple(x[fits] for x in state[:3]))
        return out

    def runs(self, text: pa.Array) -> W.Runs:
        w = C.Words(text)
        k = self.size
        ok = np.zeros(w.n + 1, np.int32)
        long = w.size() >= k
        np.add.at(ok, w.doc[:-1][long], 1)
        np.add.at(ok, w.doc[1:][long] - k + 1, -1)
        open_ = np.flatnonzero(np.cumsum(ok)[:-1] > 0)  # windows without a symbol yet
        all_ = open_
        name = np.zeros(w.n, U)
        place = np.zeros(w.n, np.int64)  # level and symbol
        levels = self.levels(w)
        base, factor = levels[0][0], U(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(w.n + 1, factor, U)) if w.n else np.ones(1, U)
            inverse = np.cumprod(np.full(w.n + 1, U(pow(int(factor), -1, 1 << 64)), U)) if w.n else np.ones(1, U)
            prefix = np.concatenate([np.zeros(1, U), np.cumsum(base * power[: w.n], dtype=U)])
        for level in range(len(levels) - 1, -1, -1):
            sym, left, right = levels[level]
            if not len(open_) or not len(sym):
                continue
            lo, hi = np.searchsorted(left, open_), np.searchsorted(right, open_ + k, side="right")
            have = hi > lo
            p, lo, hi = open_[have], lo[have], hi[have]
            open_ = open_[~have]
            if not len(p):
                continue
            # the least hash in lo..hi-1, by two overlapping powers of two
            rank = C.mix(sym + U(level))
            places = U((1 << len(sym).bit_length()) - 1)
            table = [(rank & ~places) | np.arange(len(sym), dtype=U)]
            while len(table[-1]) > (1 << (len(table) - 1)) and (1 << len(table)) <= int((hi - lo).max()):
                step = 1 << (len(table) - 1)
                table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            depth = np.frexp((hi - lo).astype(np.float64))[1] - 1
            best = np.empty(len(p), np.int64)
            for d, row in enumerate(table):
                at = np.flatnonzero(depth == d)
                best[at] = (np.minimum(row[lo[at]], row[hi[at] - (1 << d)]) & places).astype(np.int64)
            a, b = left[best], right[best]
            words = (prefix[b] - prefix[a]) * inverse[a]
            name[p] = C.mix(words ^ rank[best])
            place[p] = best * 64 + level
        head = np.ones(len(all_), bool)
        head[1:] = (all_[1:] != all_[:-1] + 1) | (place[all_[1:]] != place[all_[:-1]])
        i = np.flatnonzero(head)
        first, count = all_[i], np.diff(np.append(i, len(all_)))
        row = np.searchsorted(w.doc, first, side="right") - 1
        self.words = w
        end = w.end[first + count + k - 2] if len(first) else first
        return W.Runs(name[first], first, count, row, w.start[first], end, w.buf)

    def windows(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts are words one space apart."""
        if not len(a):
            none = np.zeros(0, np.int64)
            return none, none, none
        blank = buf == 32
        edge = np.zeros(len(buf) + 1, bool)
        edge[a] = edge[b] = True
        start = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
        end = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
        inside = np.searchsorted(a, start, side="right") - 1
        whole = (inside >= 0) & (start < b[inside])
        start, end, inside = start[whole], end[whole], inside[whole]
        n = np.bincount(inside, minlength=len(a)) - self.size + 1
        words = np.cumsum(n + self.size - 1) - (n + self.size - 1)
        of = np.repeat(np.arange(len(a)), n)
        at = np.repeat(words - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return of, start[at], end[at + self.size - 1] - start[at]

    def classes(self, v8: np.ndarray, start: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
        return W.group_equal(v8, start, size)[1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, rounds: int | None = 3, keep_text: bool = True, **parts: int) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): kept holds the words left, one space apart (with keep_text)."""

    def finish(c: W.Chunk, first: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        w: C.Words = c.scheme.words
        edge = np.zeros(w.n + 1, np.int32)
        np.add.at(edge, first[hit], 1)
        np.add.at(edge, first[hit] + size, -1)
        gone = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[w.doc[1:]] - total[w.doc[:-1]]
        room = w.end - w.start + 1
        kept = w.buf[: int(room.sum())][np.repeat(~gone, room)].tobytes()
        left = np.concatenate([[0], np.cumsum(np.where(gone, 0, room))])[w.doc]
        bodies = [kept[a : b - 1] if b > a else b"" for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
        cols = {"id": c.ids, "n_words": pa.array(w.size()), "n_removed": pa.array(removed)}
        cols["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())
        cols["kept"] = pa.array(bodies if keep_text else [None] * len(bodies), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return W.repeated_windows(own, Recompression(size, rounds), finish, "id long, n_words long, n_removed long, kept_sha256 string, kept string", **parts)


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.read_table(spark, sf_dir, "documents"), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
