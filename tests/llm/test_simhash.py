import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from readweave.llm import common as C
from readweave.llm import simhash as S


def fingerprint(x, k=4):
    w = (x or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def classes(fp, r=4):
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= r:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fp))]


def test_hash_and_fingerprints(odd):
    texts = [x for _, x in odd] + ["A b", "one", "a  b\tc d e", "x" * 200 + " y " * 40, "Éa ÉB c d"]
    assert S.fingerprint_column(pa.array(texts), 4).tolist() == [fingerprint(x) for x in texts]
    data = bytes(range(256)) * 2
    v8 = C.load8(np.frombuffer(data + b" " * 16, np.uint8))
    size = np.arange(0, 130)
    assert C.xxh64(v8, np.full(130, 3), size).tolist() == [xxhash.xxh64_intdigest(data[3 : 3 + n], 42) for n in size]


def near(rng, n):
    fp = [rng.getrandbits(64) for _ in range(n // 2)]
    return fp + [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fp]


@pytest.mark.parametrize("shard", [16, 8192])
@pytest.mark.parametrize("real", [False, True])
def test_links_span_all_near_pairs(spark, shard, real):
    rng = random.Random(3)
    fp = near(rng, 300)
    base = rng.getrandbits(64)
    fp += list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)})  # a dense group
    fp = list(dict.fromkeys(fp))
    reps = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64)), 0) for i, f in enumerate(fp)], "node long, fp long, lane int")
    links = S.near_links(reps, 4, shard, real=real).collect()
    if real:
        assert all((fp[r.a] ^ fp[r.b]).bit_count() <= 4 for r in links)
    roots = {r.node: r.root for r in S.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(fp)
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    assert [roots.get(i, i) for i in range(len(fp))] == [least[c] for c in want]


def test_more_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    fp = list(dict.fromkeys(near(rng, 200)))
    reps = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64)), 0) for i, f in enumerate(fp)], "node long, fp long, lane int")
    one = {tuple(sorted((r.a, r.b))) for r in S.near_links(reps, 4, real=True).collect()}
    two = {tuple(sorted((r.a, r.b))) for r in S.near_links(reps, 4, count=10**9, real=True).collect()}
    assert S.block_choice(10**9, 4, 4096) > 1 and one == two


def test_query_against_brute_force(spark, tiny, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op5_simhash(spark, tiny).collect()}
    fp = [fingerprint(x) for _, x in documents]
    ids = [d for d, _ in documents]
    want = classes(fp)
    least = {}
    for d, c in zip(ids, want, strict=True):
        least[c] = min(d, least.get(c, d))
    assert got == {d: (f"{f:016x}", least[c]) for d, f, c in zip(ids, fp, want, strict=True)}


def test_odd_rows(spark, make_docs, odd):
    rows = S.near_duplicates(make_docs(*odd, extra=True)).collect()
    assert len(rows) == len(odd)
    by = {(r.id, r.fp): r.component for r in rows}
    assert by[900, 0] == by[901, 0] == by[902, 0] == 900
    assert S.near_duplicates(make_docs()).count() == 0


def test_similar_documents(spark, make_docs, odd):
    rng = random.Random(1)
    voc = [f"w{i}" for i in range(3000)]
    base = [rng.choice(voc) for _ in range(400)]
    edited = list(base)
    edited[50], edited[200] = "new1", "new2"
    other = [rng.choice(voc) for _ in range(400)]
    docs = [(5, " ".join(base)), (3, " ".join(base)), (9, " ".join(edited)), (7, " ".join(other)), (11, "a short text")]
    got = {r.id: r.component for r in S.similar_documents(make_docs(*docs)).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 7, 11: 11}
    kept = S.drop_similar(make_docs(*docs, *odd, extra=True))
    assert {r.doc_id for r in kept.collect()} == {3, 7, 11, 900, 903, 905, 906, 907, None}
    assert "row_key" not in kept.columns
    assert S.drop_similar(make_docs()).count() == 0


def test_shingle_similarity(odd):
    rng = random.Random(2)
    texts = [x for _, x in odd] + [" ".join(rng.choice("ab C") for _ in range(rng.randrange(40))) for _ in range(60)]
    a, b = texts, texts[1:] + texts[:1]

    def bag(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").replace("C", "c"))
        return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))

    want = [sum((x & y).values()) / max(1, sum((x | y).values())) for x, y in zip(map(bag, a), map(bag, b), strict=True)]
    assert np.allclose(S.shingle_similarity(pa.array(a), pa.array(b), 5), want)


def test_texts_decide_near_the_threshold(spark, make_docs):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(5000)]
    docs, want = [], {}
    for n in range(12):
        base = [rng.choice(voc) for _ in range(604)]  # 600 shingles
        tail = base[: 604 - (66 if n % 2 else 67)]  # with as many words of its own, 534 or 533 of 666 or 667 are shared
        docs += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(tail + [f"x{n}y{i}" for i in range(604 - len(tail))]))]
        want |= {2 * n: 2 * n, 2 * n + 1: 2 * n if n % 2 else 2 * n + 1}
    got = {r.id: r.component for r in S.similar_documents(make_docs(*docs), candidate_shingle=1, radius=12).collect()}
    assert got == want


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def similar_classes(docs, least=0.8):
    bags = {}
    for d, x in docs:
        w = x.lower().split()
        bags[d] = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))
    root = {d: d for d in bags}
    for a in bags:
        for b in bags:
            if a < b and root[a] != root[b]:
                low = sum((bags[a] & bags[b]).values())
                if low / (sum(bags[a].values()) + sum(bags[b].values()) - low) >= least:
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {d: new if r == old else r for d, r in root.items()}
    out = {}
    for d, r in root.items():
        out.setdefault(r, set()).add(d)
    return sorted(map(sorted, out.values()))


def star(rng, n, words=300, edits=5):
    """Copies of one text, each similar to it and to no other copy."""
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    docs = [base]
    for c in range(n):
        w = list(base)
        for e in range(edits):
            at = rng.randrange(e * words // edits + 5, (e + 1) * words // edits - 5)
            w[at] = f"c{c}e{e}"
        docs.append(w)
    return docs


def test_copies_similar_only_to_the_original(spark, make_docs):
    rng = random.Random(11)
    docs = [(i, " ".join(w)) for i, w in enumerate(star(rng, 200, edits=6)[::-1])]  # the original is last
    want = similar_classes(docs)
    assert len(want) == 1
    assert groups(S.similar_documents(make_docs(*docs)).collect()) == want
    alone = docs[:-1]  # without it
    assert groups(S.similar_documents(make_docs(*alone)).collect()) == similar_classes(alone)


def test_block_edits_at_the_threshold(spark, make_docs):
    rng = random.Random(12)
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(404)]
        cut = [w[:324], w[80:], w + [f"n{i}x{j}" for j in range(100)]][i % 3]  # similarity 0.8
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(cut))]
    want = [[2 * i, 2 * i + 1] for i in range(60)]
    assert similar_classes(docs) == want
    assert groups(S.similar_documents(make_docs(*docs)).collect()) == want


def test_a_repeated_line_is_no_similarity(spark, make_docs):
    rng = random.Random(13)
    line = [f"l{j}" for j in range(9)]
    docs = []
    for i in range(6):
        own = [f"d{i}w{rng.randrange(10**6)}" for _ in range(2800)]
        parts = [own[j : j + 21] for j in range(0, len(own), 21)]
        docs.append((i, " ".join(" ".join(p + line) for p in parts)))
    assert similar_classes(docs) == [[i] for i in range(6)]
    assert groups(S.similar_documents(make_docs(*docs)).collect()) == [[i] for i in range(6)]


def test_rows_of_one_id_with_different_texts_stay(spark, make_docs):
    rng = random.Random(14)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(100))
    a, b, c = text(), text(), text()
    rows = S.drop_similar(make_docs((1, a), (1, b), (1, a), (2, c), (3, b))).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted([(1, a), (1, b), (2, c)])


def test_near_pairs_of_a_large_token():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**64, 700, dtype=np.uint64)
    root, side = rng.integers(0, 500, 700), rng.integers(1, 3, 700)
    wide = np.stack([fp, fp, fp[::-1]], axis=1)
    near = np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 26, 1) & (root[:, None] != root[None])
    near &= np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2) <= 82
    for s in (side, np.zeros(700, np.int64)):
        want = near & ((s[:, None] != s[None]) | (s[:, None] == 0))
        assert set(zip(*S.near_pairs(fp, 26, root, s, wide, 82), strict=True)) == set(zip(*np.nonzero(want), strict=True))


def test_groups_of_sorted_batches():
    token = np.sort(np.concatenate([np.repeat(7, 250_000), np.repeat(9, 140_000), np.arange(10, 300_000) // 3]))
    cols = [token, np.arange(len(token))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 9_999]) for c in cols], names=["token", "node"]) for i in range(0, len(token), 9_999)]
    seen = {}
    for t, at, large in S.grouped(iter(batches), ["token"], ["node"], 1 << 15):
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(t["token"])], strict=True):
            assert int(t["token"][a]) not in seen
            seen[int(t["token"][a])] = large or b - a
    value, n = np.unique(token, return_counts=True)
    assert seen == dict(zip(value.tolist(), n.tolist(), strict=True))


def test_shingles_of_many_texts(spark, make_docs):
    """A class of copies that are similar to the original only, larger than a token may have nodes for all pairs."""
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(3000)]
    first = [rng.choice(voc) for _ in range(250)]
    docs = [(0, " ".join(first))]
    for i in range(1, 160):
        w = list(first)
        for j in rng.sample(range(250), 4):
            w[j] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    apart = [(200 + i, " ".join(rng.choice(voc) for _ in range(100)) + " " + " ".join(first[:40])) for i in range(160)]
    got = {r.id: r.component for r in S.similar_documents(make_docs(*docs, *apart), lanes=1).collect()}
    assert all(got[i] == 0 for i, _ in docs) and all(got[i] == i for i, _ in apart)


def test_links_of_bags_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.choice(400, 60, replace=False)
    bags = [rng.permutation(np.unique(np.concatenate([rng.choice(base, k, replace=False), rng.integers(400, 900, rng.integers(0, 12))]))) for k in rng.integers(35, 61, 300)] + [base[:0]]
    off = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    known = rng.integers(0, 280, 301)
    close = lambda i, j: len(np.intersect1d(bags[i], bags[j])) >= 0.8 * len(np.union1d(bags[i], bags[j]))
    x, y = np.triu_indices(301, 1)
    sets = S.Sets.of(known)
    a, b = S.similar_links(iter([(x[:20_000], y[:20_000]), (x[20_000:], y[20_000:])]), np.concatenate(bags).astype(np.int32), off, 0.8, sets)
    assert all(close(i, j) for i, j in zip(a, b, strict=True)) and 0 < len(a) < 301
    want = S.Sets.of(known)
    for i, j in zip(x, y, strict=True):
        if close(i, j):
            want.join(np.array([i]), np.array([j]))
    assert sets.root(np.arange(301)).tolist() == want.root(np.arange(301)).tolist()


def test_whole_groups_of_sorted_texts():
    key = np.sort(np.random.default_rng(6).integers(0, 60, 4000))
    key[1000:3000] = key[1000]
    key.sort()
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(4000)), pa.array(["t" * 900] * 4000)], names=["key", "node", "text"])
    seen, nodes = [], []
    for t, at in S.whole_groups((batch.slice(i, 700) for i in range(0, 4000, 700)), ["key"], 1 << 19):
        seen += np.asarray(t.column("key"))[at].tolist()
        nodes += t.column("node").to_pylist()
    assert seen == np.unique(key).tolist() and nodes == list(range(4000))


def crowd(rng, n=300):
    """Texts of one passage, most pairs just below the similarity."""
    docs = []
    for i in range(n):
        w = [f"w{j}" for j in range(300)]
        for e in range(6 if i % 10 else 4):
            w[rng.randrange(e * 50 + 5, e * 50 + 45)] = f"x{i}e{e}"
        docs.append((i, " ".join(w)))
    return docs


def test_a_large_group_in_many_shards(spark, make_docs, monkeypatch):
    docs = crowd(random.Random(15))
    hot, compared, dealt = S.hot_links, S.compared, []

    def spread(rows, key, real=S.paired_shards):
        dealt.append((key, real(rows, key).select(key, "lo", "hi").distinct().count()))
        return real(rows, key)

    monkeypatch.setattr(S, "paired_shards", spread)
    monkeypatch.setattr(S, "hot_links", lambda *a: hot(*a, shard=64))
    monkeypatch.setattr(S, "compared", lambda *a: compared(*a, shard=32))
    got = groups(S.similar_documents(make_docs(*docs), lanes=1).collect())
    assert got == similar_classes(docs)
    assert min(n for _, n in dealt) >= 15, dealt


def test_pairs_of_a_large_group_are_no_rows(spark, make_docs, monkeypatch):
    """What is written grows with the texts, not the pairs."""
    docs = crowd(random.Random(15))
    want = similar_classes(docs)
    assert 200 < len(want) < 300
    sizes, write = {}, C.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(C, "materialize", counted)
    assert groups(S.similar_documents(make_docs(*docs)).collect()) == want
    assert max(sizes.values()) <= 64 * len(docs), sizes  # shingles of up to 128 texts leave as many pairs


@pytest.mark.parametrize("order", ["hash only", "commonest first"])
def test_any_order_of_prefixes_gives_the_same_classes(spark, make_docs, monkeypatch, order):
    """The sampled counts only order the prefixes: without them, or with them turned round, no link is lost or added."""
    rng = random.Random(16)
    docs = [(i, " ".join(w)) for i, w in enumerate(star(rng, 150, edits=6)[::-1])]
    for i in range(200, 260, 2):
        w = [f"b{rng.randrange(5000)}" for _ in range(404)]
        docs += [(i, " ".join(w)), (i + 1, " ".join(w[: 324 if i % 4 else 323]))]  # similarity 0.8 and just below
    shared = [f"s{j}" for j in range(60)]
    docs += [(300 + i, " ".join(shared + [f"o{rng.randrange(5000)}" for _ in range(120)])) for i in range(60)]
    count = S.common_shingles
    monkeypatch.setattr(S, "common_shingles", lambda *a: count(*a) * 0 if order == "hash only" else ~count(*a))
    assert groups(S.similar_documents(make_docs(*docs)).collect()) == similar_classes(docs)


def jobs_of(spark, run):
    """What run() returns, and how many Spark jobs it took."""
    sc = spark.sparkContext
    group = f"jobs-{random.getrandbits(64)}"
    sc.setJobGroup(group, "counted")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("how", [{}, {"most": 0}])
def test_components_of_few_links_take_few_jobs(spark, how):
    """Rounds, each of many jobs, serve more links than one task joins; both find the same."""
    rng = random.Random(17)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(500)]
    links = list(zip(ids[:200], ids[1:201], strict=True)) + [(ids[0], ids[0]), (ids[7], ids[8]), (ids[8], ids[7]), (ids[450], ids[450])]  # a chain, repeats, loops
    links += [(ids[300], i) for i in ids[301:400]]  # a star
    rng.shuffle(links)
    want = {i: min(ids[:201]) for i in ids[:201]} | {i: min(ids[300:400]) for i in ids[300:400]}
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    found, jobs = jobs_of(spark, lambda: S.components(frame, **how))
    rows = found.collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.root for r in rows} == {i: r for i, r in want.items() if i != r}
    assert how or jobs <= 6, jobs  # a chain of 200 took several times as many
    assert S.components(frame.where("a = b"), **how).count() == 0


def test_bitmaps_take_few_jobs(spark):
    """However many the shuffle partitions, what comes to the driver comes in a few jobs."""
    rng = random.Random(18)
    tokens = [(rng.randrange(-(1 << 63), 1 << 63), level) for level in (0, 1) for _ in range(3000)]
    frame = spark.createDataFrame(tokens, "token long, level int")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 60)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, jobs = jobs_of(spark, lambda: S.bitmaps(frame, 23, 2))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = np.zeros((2, 1 << 20), np.uint8)
    for t, level in tokens:
        at = t % (1 << 23)
        want[level, at >> 3] |= 1 << (at & 7)
    assert (got == want).all()
    assert jobs <= 12, jobs
