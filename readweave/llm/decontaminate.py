"""Benchmark decontamination by SimHash over item-sized windows.

Per document, every window of as many words as a benchmark item that could reach the similarity t is fingerprinted: of
the m shingles of such a window at least 2 t m / (1 + t) are shingles of items of its length, so only windows with as
many are computed (a lossless cut). Fingerprints meet the items of their length through a multi-index: two blocks of 32
bits, of which at least one is within its share of the radius (10 and 9 bits) for any pair within it. Pairs within the
radius are verified by the exact similarity of their shingles weighted by multiplicity: sum of minima over sum of
maxima.

A document with fewer words than an item is one window, the whole of it.

At similarity 0.8 a fingerprint bit differs with probability 0.15, so of 64 bits 10 differ, standard deviation 3; the
radius of 20 misses fewer than one in 10,000 such pairs.

The benchmark is read to the driver in blocks of at most `block_items` items and `block_chars` characters (bytes bound
the broadcast); each block is matched against all documents. After every `CHAIN` blocks what is found so far is written,
so no stage holds more than that many blocks, whatever the size of the benchmark.

Edge cases. Null or blank texts and items match nothing. An item of fewer than `shingle` words is one shingle. Letters
A-Z are compared in lower case. Items with equal texts all match; repeated rows are matched each; a null item_id is
reported as null. Extra columns are kept unless named `leaks`. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))
FILTER_BITS = 22
CHAIN = 4


def chain(names: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words, by the hashes of the words."""
    n = max(0, len(names) - k + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = C.mix(h * np.uint64(0x2545F4914F6CDD1D) + names[j : n + j])
    return h


def window_prints(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SimHash of the m shingle hashes from each place in `at` (sorted, distinct)."""
    need = np.zeros(len(h) + 1, np.int64)
    np.add.at(need, at, 1)
    np.add.at(need, at + m, -1)
    rows = np.flatnonzero(np.cumsum(need)[:-1] > 0)
    out = np.empty(len(at), np.uint64)
    place = np.searchsorted(rows, at)
    step = max(m, 1 << 14)
    for a in range(0, len(at), step):
        p = place[a : a + step]
        bits = np.unpackbits(h[rows[p[0] : p[-1] + m]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        count = total[p - p[0] + m] - total[p - p[0]]
        out[a : a + step] = np.packbits(2 * count > m, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


class MultiIndex:
    """Fingerprints by a few wide blocks of bits. Two fingerprints within the radius are, in at least one block, within
    that block's share of it: the shares r1, r2, ... are chosen with (r1 + 1) + (r2 + 1) + ... = radius + 1, so if every
    block differed by more than its share, the sum would be over the radius. pairs() is exact within the radius."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int = 2):
        self.prints, self.radius = prints, radius
        blocks = max(1, min(blocks, radius + 1))
        cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
        spare = radius + 1 - blocks
        self.blocks = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            value = self.value(prints, a, b)
            known, at = np.unique(value, return_inverse=True)
            order = np.argsort(at, kind="stable")
            first = np.searchsorted(at[order], np.arange(len(known) + 1))
            self.blocks.append((a, b, spare // blocks + (i < spare % blocks), known, order, first))

    @staticmethod
    def value(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)

    def candidates(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, item index) of pairs near in a block, block by block; each value of a block is asked once."""
        for a, b, r, known, order, first in self.blocks:
            asked, which = np.unique(self.value(query, a, b), return_inverse=True)
            rows = np.argsort(which, kind="stable")
            start = np.searchsorted(which[rows], np.arange(len(asked) + 1))
            step = max(1, (1 << 21) // max(1, len(known)))
            for i in range(0, len(asked), step):
                x, y = np.nonzero(np.bitwise_count(asked[i : i + step, None] ^ known[None, :]) <= r)
                x += i
                # all queries of a value with all items of a near one
                n, m = start[x + 1] - start[x], first[y + 1] - first[y]
                size = n * m
                pair = np.repeat(np.arange(len(x)), size)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
                yield rows[start[x][pair] + at // m[pair]], order[first[y][pair] + at % m[pair]]

    def pairs(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query index, item index), each pair once."""
        keys = [np.zeros(0, np.int64)]
        for s in range(0, len(query), 1 << 13):
            part = query[s : s + (1 << 13)]
            for q, item in self.candidates(part):
                near = np.bitwise_count(part[q] ^ self.prints[item]) <= self.radius
                keys.append((q[near] + s) * len(self.prints) + item[near])
        key = np.unique(np.concatenate(keys))
        return key // len(self.prints), key % len(self.prints)


class Benchmark:
    """One block of items, grouped by their number of words."""

    def __init__(self, ids: list[int | None], texts: list[str | None], shingle: int, radius: int):
        self.k = shingle
        w = C.Words(pa.array(texts, pa.string()), lower=True)
        names = C.hash_ranges(C.load8(w.buf), w.start, w.end - w.start)
        self.groups: dict[int, dict] = {}
        by: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(w.size().tolist()):
            if n:
                by[n].append(i)
        for n, items in sorted(by.items()):
            k = min(n, shingle)
            m = n - k + 1
            h = np.concatenate([chain(names[w.doc[i] : w.doc[i + 1]], k) for i in items])
            prints = np.concatenate([window_prints(h[j * m : (j + 1) * m], np.array([0]), m) for j in range(len(items))])
            bags = [bag(w, int(w.doc[i]), n, k) for i in items]
            self.groups[n] = {"k": k, "m": m, "ids": [ids[i] for i in items], "index": MultiIndex(prints, radius), "bags": bags, "shingles": np.unique(h)}
        self.filters = {}
        for k in {g["k"] for g in self.groups.values()}:
            known = np.unique(np.concatenate([g["shingles"] for g in self.groups.values() if g["k"] == k]))
            hit = np.zeros(1 << FILTER_BITS, bool)
            hit[(known & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.filters[k] = (hit, known)


def bag(w: C.Words, first: int, n: int, k: int) -> Counter:
    """The shingles, with multiplicity, of n words."""
    start, end = w.start[first : first + n].tolist(), w.end[first : first + n].tolist()
    text = w.buf[start[0] : end[-1]].tobytes()
    return Counter(text[start[j] - start[0] : end[j + k - 1] - start[0]] for j in range(n - k + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def leaks(col: pa.Array, bench: Benchmark, threshold: float) -> list[list[dict]]:
    """Per text, the items found, each with its most similar window (the first of equals)."""
    w = C.Words(col, lower=True)
    out: list[list[dict]] = [[] for _ in range(len(w.doc) - 1)]
    names = C.hash_ranges(C.load8(w.buf), w.start, w.end - w.start)
    doc_of = np.repeat(np.arange(len(out)), w.size())
    hits = {}
    for k, (hit, known) in bench.filters.items():
        h = chain(names, k)
        maybe = np.flatnonzero(hit[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        hits[k] = (h, maybe[known[at] == h[maybe]])
    best: dict[tuple[int, int, int], tuple[float, int, int]] = {}
    for n, g in bench.groups.items():
        h, at = hits[g["k"]]
        at = at[np.isin(h[at], g["shingles"])] if len(at) else at
        if not len(at):
            continue
        # a document shorter than the item is one window, if it has enough shingles for the threshold
        near = np.unique(doc_of[at])
        own = w.size()[near]
        near = near[(own < n) & (own - g["k"] + 1 >= threshold * g["m"] - 1e-9)]
        for words in np.unique(w.size()[near]).tolist():
            short = near[w.size()[near] == words]
            first = w.doc[short]
            q, item = g["index"].pairs(window_prints(h, first, words - g["k"] + 1))
            for p, i in zip(first[q].tolist(), item.tolist(), strict=True):
                s = similarity(bag(w, p, words, g["k"]), g["bags"][i])
                if s >= threshold:
                    best[int(doc_of[p]), n, i] = (s, 0, words)
        if len(names) < n:
            continue
        # at this similarity, so many of a window's shingles are shingles of items
        need = max(1, math.ceil(2 * threshold * g["m"] / (1 + threshold) - 1e-9))
        if len(at) < need:
            continue
        known = np.zeros(len(names) + 1, np.int32)
        known[at + 1] = 1
        total = np.cumsum(known)
        starts = len(names) - n + 1
        first = np.flatnonzero(total[g["m"] : g["m"] + starts] - total[:starts] >= need)
        first = first[doc_of[first] == doc_of[first + n - 1]]
        if not len(first):
            continue
        q, item = g["index"].pairs(window_prints(h, first, g["m"]))
        bags: dict[int, Counter] = {}
        for p, i in zip(first[q].tolist(), item.tolist(), strict=True):
            if p not in bags:
                bags = {p: bag(w, p, n, g["k"])}
            s = similarity(bags[p], g["bags"][i])
            key = (int(doc_of[p]), n, i)
            if s >= threshold and s > best.get(key, (0.0, 0, 0))[0]:
                best[key] = (s, p - int(w.doc[doc_of[p]]), n)
    for (d, n, i), (s, p, words) in best.items():
        out[d].append({"item_id": bench.groups[n]["ids"][i], "similarity": s, "start_word": p, "n_words": words})
    for x in out:
        x.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["start_word"]))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_items: int, block_chars: int) -> Iterator[tuple[list, list]]:
    ids, texts, chars = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        chars += len(r.t or "")
        if len(ids) >= block_items or chars >= block_chars:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    radius: int = 20,
    block_items: int = 20_000,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """docs with leaks: array of (item_id, similarity, start_word, n_words), one per item found."""
    schema = C.plus(docs.schema, ("leaks", T.ArrayType(LEAK)))
    out = docs.select(*[c for c in docs.columns if c.lower() != "leaks"], F.array().cast(T.ArrayType(LEAK)).alias("leaks"))
    for i, (ids, texts) in enumerate(blocks(benchmark, item_col, item_text_col, block_items, block_chars)):
        if i and i % CHAIN == 0:
            out = C.materialize(out, "leaks")
        bench = docs.sparkSession.sparkContext.broadcast(Benchmark(ids, texts, shingle, radius))

        def run(batches: Iterator[pa.RecordBatch], bench=bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in C.slices(batch, text_col, 2 << 20):
                    old = part.column("leaks").to_pylist()
                    new = leaks(part.column(text_col), bench.value, threshold)
                    yield C.with_columns(part, schema.names, {"leaks": pa.array([a + b for a, b in zip(old, new, strict=True)], ARROW)})

        out = out.mapInArrow(run, schema)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, C.read_table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.similarity", "leak.start_word", "leak.n_words")
