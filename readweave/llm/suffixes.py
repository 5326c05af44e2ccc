"""Repeated byte strings by a depth-limited radix sort of suffixes.

A byte is removed if a `size`-byte string over it also starts in a document with a smaller id. Strings are suffixes read
only through `size` bytes. They are scattered by a name of their own content (the least of the hashes of the `gram`-byte
strings inside, with its place), which is the first pass of the sort; within a bucket, most-significant-digit passes of
eight bytes order the suffixes of each group until a suffix is alone or `size` bytes are read. The groups left are
exactly the repeated strings. See windows.py for how they travel.

Edge cases. Null and empty texts have no bytes and remove nothing; so have texts under `size` bytes. A null id is larger
than every other and no two nulls differ. Rows with one id never remove from each other. Repeated rows get a result row
each. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import windows as W

U = np.uint64
TILE = 1 << 18


class Suffixes(W.Scheme):
    def __init__(self, size: int = 50, gram: int = 16):
        if not 16 <= gram <= size:
            raise ValueError("gram must be from 16 to size")
        self.size, self.gram = size, gram

    def values(self, ids: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(ids, 2**63 - 1)).astype(np.int64)

    def runs(self, text: pa.Array) -> W.Runs:
        data, off = C.raw(text)
        k, span = self.size, self.size - self.gram + 1
        buf = np.concatenate([data, np.zeros(k + 16, np.uint8)])
        n = np.diff(off)
        ok = np.zeros(len(data) + 1, np.int32)  # places where a whole string starts
        long = n >= k
        np.add.at(ok, off[:-1][long], 1)
        np.add.at(ok, off[1:][long] - k + 1, -1)
        ok = np.cumsum(ok)[:-1] > 0
        first, name, count = [], [], []
        for a in range(0, len(data), TILE):
            b = min(a + TILE, len(data))
            v8 = C.load8(buf[a : b + span + self.gram + 8])
            m = b - a + span
            h = C.mix(v8[:m] * U(0x9E3779B97F4A7C15) ^ v8[self.gram - 8 : m + self.gram - 8])
            for j in range(8, self.gram - 8, 8):
                h = C.mix(h * U(0x2545F4914F6CDD1D) + v8[j : m + j])
            low = (h & ~U(0xFFFFF)) | np.arange(m, dtype=U)
            width = 1
            while 2 * width <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[: b - a], low[span - width : b - a + span - width])
            at = np.flatnonzero(ok[a:b])
            if not len(at):
                continue
            place = (low[at] & U(0xFFFFF)).astype(np.int64)
            head = np.ones(len(at), bool)
            head[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
            i = np.flatnonzero(head)
            first.append(at[i] + a)
            count.append(np.diff(np.append(i, len(at))))
            name.append(h[place[i]])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        first, count = cat(first, np.int64), cat(count, np.int64)
        row = np.searchsorted(off, first, side="right") - 1
        return W.Runs(cat(name, U), first, count, row, first, first + count + k - 1, buf)

    def windows(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = b - a - self.size + 1
        of = np.repeat(np.arange(len(a)), n)
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return of, at, np.broadcast_to(np.int64(self.size), at.shape)

    def classes(self, v8: np.ndarray, start: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Most-significant-digit passes of 8 bytes. A group of one value is done: its strings cannot be removed here."""
        cls = np.arange(len(start))
        order, group = np.arange(len(start)), np.zeros(len(start), np.int64)
        for depth in range(0, self.size, 8):
            digit = v8[start[order] + depth].byteswap()
            if self.size - depth < 8:
                digit = digit >> U(8 * (8 - (self.size - depth)))
            by = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
            order, group, digit = order[by], group[by], digit[by]
            head = np.ones(len(order), bool)
            head[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
            at = np.flatnonzero(head)
            if not len(at):
                return cls
            v = value[order]
            mixed = np.minimum.reduceat(v, at) != np.maximum.reduceat(v, at)
            group = np.cumsum(head) - 1
            live = mixed[group]
            order, group = order[live], group[live]
        if len(order):
            head = np.ones(len(order), bool)
            head[1:] = group[1:] != group[:-1]
            cls[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        return cls


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, keep_text: bool = True, **parts: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept): spans are the maximal removed runs (start, end) in
    bytes; kept holds the bytes left (with keep_text)."""

    def finish(c: W.Chunk, first: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        data, off = C.raw(c.text)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, first[hit], 1)
        np.add.at(edge, first[hit] + size, -1)
        gone = np.cumsum(edge)[:-1] > 0
        before = np.concatenate([[False], gone[:-1]])[: len(gone)]
        inner = off[(off > 0) & (off < len(data))]
        before[inner] = False
        after = np.concatenate([gone[1:], [False]])[: len(gone)]
        after[inner - 1] = False
        begin, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[off[1:]] - total[off[:-1]]
        at = np.searchsorted(begin, off)
        kept, left = data[~gone].tobytes(), off - total[off]
        bodies = [kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
        base = np.repeat(off[:-1], np.diff(at))
        spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], names=["start", "end"]))
        cols = {"id": c.ids, "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(removed), "n_spans": pa.array(np.diff(at).astype(np.int64)), "spans": spans}
        cols["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())
        cols["kept"] = pa.array(bodies if keep_text else [None] * len(bodies), pa.binary())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long, end:long>>, kept_sha256 string, kept binary"
    return W.repeated_windows(own, Suffixes(size), finish, schema, **parts)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.read_table(spark, sf_dir, "documents"), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
