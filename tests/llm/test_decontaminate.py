import random
from collections import Counter

import numpy as np
import pyarrow as pa

from readweave.llm import decontaminate as D


def low(x):
    return [w.decode() for w in (x or "").encode().lower().split()]


def bag(w, k=5):
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(text, items, threshold=0.8):
    w, out = low(text), []
    for i, item in items:
        v = low(item)
        b, best = bag(v), (0.0, 0)
        if not v:
            continue
        for p in range(len(w) - len(v) + 1):
            a = bag(w[p : p + len(v)])
            n = sum((a & b).values())
            s = n / (sum(a.values()) + sum(b.values()) - n)
            if s >= threshold and s > best[0]:
                best = (s, p)
        if best[0]:
            out.append((i, best[0], best[1]))
    return out


def cases():
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(6, 60)))) for i in range(12)] + [(50, "a b c"), (51, None), (52, " "), (53, "a b c")]
    fill = lambda n: [rng.choice(voc) for _ in range(n)]
    docs = [None, "", " ", "a b c", "x a b c y"]
    for _, item in items[:12]:
        w = item.split()
        docs.append(" ".join(fill(30) + w + fill(30)))
        w[len(w) // 2] = "changed"
        docs.append(" ".join(fill(5) + w + fill(9)).upper())
        docs.append(" ".join(fill(5) + w[:-1] + fill(9)))
    return items, docs + [" ".join(fill(300)) for _ in range(10)]


def test_against_brute_force():
    items, docs = cases()
    bench = D.Benchmark([i for i, _ in items], [t for _, t in items], 5, 20)
    got = D.leaks(pa.array(docs), bench, 0.8)
    assert [[(r["item_id"], r["similarity"], r["start_word"]) for r in g] for g in got] == [brute(x, items) for x in docs]


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 200, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    for r in (3, 20):
        q, i = D.MultiIndex(b, r).pairs(a)
        want = {(x, y) for x in range(200) for y in range(100) if int(a[x] ^ b[y]).bit_count() <= r}
        assert set(zip(q.tolist(), i.tolist(), strict=True)) == want


def test_blocks_of_items_and_odd_rows(spark, make_docs, odd):
    items, docs = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = make_docs(*enumerate(docs), extra=True)
    whole = sorted(map(str, D.find_leaks(frame, bench).select("doc_id", "leaks").collect()))
    assert whole == sorted(map(str, D.find_leaks(frame, bench, block_items=5).select("doc_id", "leaks").collect()))
    assert D.find_leaks(make_docs(*odd), bench).where("size(leaks) > 0").count() == 0
    assert D.find_leaks(make_docs(), bench).count() == 0
    assert D.find_leaks(make_docs(*odd), bench.limit(0)).where("size(leaks) = 0").count() == len(odd)


def test_query(spark, tiny, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    shared = {g for _, t in items for g in bag(low(t))}
    want = set()
    for d, x in documents:
        if any(g in shared for g in bag(low(x))):
            want |= {(d, i, p) for i, _, p in brute(x, items)}
    assert {(r.doc_id, r.item_id, r.start_word) for r in D.op3_decontamination(spark, tiny).collect()} == want


def test_document_shorter_than_the_item():
    rng = random.Random(5)
    item = [f"w{rng.randrange(500)}" for _ in range(60)]
    bench = D.Benchmark([1], [" ".join(item)], 5, 20)
    docs = [" ".join(item[:55]), " ".join(item[3:]), "other words", " ".join(item[:45]), " ".join(item[:20]), None]
    want = [[(1, 51 / 56, 0, 55)], [(1, 53 / 56, 0, 57)], [], [], [], []]
    for batch in (docs, docs[:1]):
        got = D.leaks(pa.array(batch), bench, 0.8)
        assert [[(r["item_id"], r["similarity"], r["start_word"], r["n_words"]) for r in g] for g in got] == want[: len(batch)]
