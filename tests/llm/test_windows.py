"""Substring operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from readweave.llm import common as C
from readweave.llm import recompression, suffixes
from readweave.llm import windows as W


def brute_bytes(docs, k=50):
    least = {}
    top = 2**63 - 1
    for d, x in docs:
        b = (x or "").encode()
        for i in range(len(b) - k + 1):
            s = b[i : i + k]
            least[s] = min(least.get(s, top), top if d is None else d)
    out = []
    for d, x in docs:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if least[b[i : i + k]] < (top if d is None else d):
                gone[i : i + k] = b"\1" * k
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(x):
    return re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode())


def brute_words(docs, k=35):
    seen = Counter(tuple(w[i : i + k]) for _, x in docs for w in [words(x)] for i in range(len(w) - k + 1))
    out = []
    for d, x in docs:
        w = words(x)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def synthetic():
    rng = random.Random(5)
    docs = [(2000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 150)))) for i in range(60)]
    docs += [(2100 + i, "be " * rng.randint(20, 90) + "x y" + " be" * 40) for i in range(6)]
    docs += [(2200, "z" * 49), (2201, "z" * 49), (2202, "z" * 50), (2203, "z" * 51), (2204, "ab " * 100), (2205, "ab cd " * 100)]
    big = " ".join(rng.choice(["alpha", "beta", "gam"]) for _ in range(3000))
    return docs + [(2300, big), (2301, "q " + big[100:9000] + " z")]


@pytest.mark.parametrize("parts", [{}, {"chunk_bytes": 20_000, "bucket_bytes": 20_000}, {"chunk_bytes": 20_000, "bucket_bytes": 20_000, "hot": 2}])
def test_bytes(spark, make_docs, documents, odd, parts):
    docs = documents[:120] + odd + synthetic()
    got = suffixes.remove_repeats(make_docs(*docs, extra=True), **parts)
    assert sorted((tuple(r) for r in got.select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == brute_bytes(docs)
    for r in got.select("n_bytes", "n_removed", "spans", "kept").collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)


@pytest.mark.parametrize("parts", [{}, {"chunk_bytes": 20_000, "bucket_bytes": 20_000}, {"chunk_bytes": 20_000, "bucket_bytes": 20_000, "hot": 2}])
def test_words(spark, make_docs, documents, odd, parts):
    docs = documents[:120] + odd + synthetic()
    got = recompression.remove_repeats(make_docs(*docs, extra=True), **parts)
    assert sorted((tuple(r) for r in got.select("id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute_words(docs)


def test_queries(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert sorted(map(tuple, suffixes.op2_suffix_dedup(spark, tiny).collect()), key=str) == brute_bytes(docs)
    assert sorted(map(tuple, recompression.op6_recompression(spark, tiny).collect()), key=str) == brute_words(docs)


def test_empty(spark, make_docs):
    assert suffixes.remove_repeats(make_docs()).count() == 0
    assert recompression.remove_repeats(make_docs()).count() == 0


def test_equal_substrings_have_equal_interior_symbols():
    rng = random.Random(7)
    middle = [f"w{rng.randint(0, 40)}" for _ in range(60)]
    texts = [" ".join([f"a{i}" for i in range(9)] + middle), " ".join(middle + ["be"] * 5)]
    scheme = recompression.Recompression(35)
    per = []
    for t in texts:
        w = C.Words(pa.array([t]))
        shift = 9 if t is texts[0] else 0
        per.append([{(n, a - shift, b - shift) for n, a, b in zip(*map(np.ndarray.tolist, level), strict=True) if a >= shift and b <= shift + 60} for level in scheme.levels(w)])
    assert all(x == y for x, y in zip(*per, strict=True)) and len(per[0][-1]) > 0


def test_collisions_are_told_apart(monkeypatch):
    buf = np.frombuffer(b"abcdefghabcdefgiabcdefgh" + b" " * 16, np.uint8)
    v8 = C.load8(buf)
    monkeypatch.setattr(C, "hash_ranges", lambda v8, start, size: np.zeros(len(start), np.uint64))
    cls = W.group_equal(v8, np.array([0, 8, 16]), np.array([8, 8, 8]))[1]
    assert cls[0] == cls[2] != cls[1]


def test_radix_passes_order_only_to_the_limit():
    s = suffixes.Suffixes(50)
    text = b"A" * 50 + b"x" + b"A" * 50 + b"y" + b"A" * 49 + b"B" + b" " * 16
    v8 = C.load8(np.frombuffer(text, np.uint8))
    start = np.array([0, 51, 102])
    cls = s.classes(v8, start, np.full(3, 50), np.array([1, 2, 3]))
    assert cls[0] == cls[1] != cls[2]
