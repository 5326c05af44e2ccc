import itertools
import re

import numpy as np
import pyarrow as pa

from readweave.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x):
    x = x or ""
    w = WORD.findall(x)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [s for s in x.split("\n") if WORD.search(s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_counts(documents, odd):
    texts = [x for _, x in documents + odd] + ["\n", " \n a", "a b\nc\na b\n\na b", "x " * 30]
    t = Q.Texts(pa.array(texts))
    assert [tuple(int(getattr(t, c)[i]) for c in Q.RESULT[:5]) for i in range(len(texts))] == [brute(x) for x in texts]


def total(score, marks, stay):
    """The weight of a sequence of marks."""
    return sum(x for x, m in zip(score, marks, strict=True) if m) + sum(stay[p] for p, q in zip(marks[:-1], marks[1:], strict=True) if p == q)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(0)
    sizes = [int(rng.integers(1, 8)) for _ in range(40)]
    line = np.concatenate([[0], np.cumsum(sizes)])
    score, stay = rng.normal(size=line[-1]), np.array([0.7, 0.2])
    marks = Q.viterbi(score, line, stay)
    for a, b in zip(line[:-1], line[1:], strict=True):
        best = max(itertools.product([1, 0], repeat=b - a), key=lambda z: total(score[a:b], z, stay))
        assert tuple(marks[a:b].astype(int)) == best


def test_marginals():
    score, line, stay = np.array([0.3, -1.0, 0.5]), np.array([0, 3]), np.array([0.4, -0.3])
    weight = {z: np.exp(total(score, z, stay)) for z in itertools.product([0, 1], repeat=3)}
    p, same, z = Q.forward_backward(score, line, stay)
    every = sum(weight.values())
    assert np.isclose(z[0], np.log(every))
    assert np.allclose(p, [sum(v for m, v in weight.items() if m[i]) / every for i in range(3)])
    for s in (0, 1):
        assert np.isclose(same[0, s], sum(v * sum(a == b == s for a, b in zip(m[:-1], m[1:], strict=True)) for m, v in weight.items()) / every)


def test_transitions_matter():
    """Lines of weak evidence in long stretches: with the learned transitions fewer texts are judged wrong."""
    rng = np.random.default_rng(5)
    n, size = 400, 12
    label = rng.integers(0, 2, n)
    x = np.zeros((n * size, len(Q.FEATURES)))
    x[:, 0] = 1
    x[:, 1] = rng.normal(np.where(np.repeat(label, size) > 0, 0.0, 0.15), 0.12)
    line = np.arange(0, n * size + 1, size)
    w = Q.train(x[: n * size // 2], line[: n // 2 + 1], label[: n // 2])
    assert w[-2:].sum() > 0.5

    def wrong(w):
        marks = Q.viterbi(x @ w[:-2], line, w[-2:]).reshape(n, size)[n // 2 :]
        return (marks != label[n // 2 :, None]).mean()

    assert wrong(w) < 0.8 * wrong(np.append(w[:-2], [0, 0]))


def test_held_out_accuracy(spark):
    """Trained on labels of even ids, judged on odd ones."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = Q.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept", "base_failed", "n_words").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.15


def test_odd_rows_and_no_labels(spark, make_docs, odd):
    out = Q.judge(make_docs(*odd, extra=True), None)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(odd) - 1 and rows[900].base_failed and not rows[900].kept and rows[900].n_words == 0
    assert out.columns.count("kept") == 1
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judge(make_docs(), empty).count() == 0
    assert Q.judge(make_docs(*odd), empty).count() == len(odd)


def test_query(spark, tiny, documents):
    rows = {r.doc_id: r for r in Q.op1_quality(spark, tiny).collect()}
    for d, x in documents:
        n, *rest = brute(x)
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n) and not (r.base_failed and r.kept)


def test_repeated_ids_are_sampled_once(spark, make_docs):
    docs = make_docs((1, "good words"), (1, "other words here"), (2, "bad $$$"), (2, "bad $$$"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    one, two = (Q.sample_features(d, labels, "doc_id", "text", 10, 400) for d in (docs, docs.orderBy("text", ascending=False)))
    assert one[2].tolist() == [1, 0]
    assert all((a == b).all() for a, b in zip(one, two, strict=True))
