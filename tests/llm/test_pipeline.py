"""The pipeline against brute force on the smallest tables."""

import random
from collections import Counter

import corpus_pipeline as P
from readweave.llm import quality

from .test_decontaminate import bag, brute, low
from .test_simhash import similar_classes, star


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, {"": docs.collect()}
    for i, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, tiny)
        docs.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage{i}")
        docs = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage{i}")
        assert docs.columns == columns or name == "sharding"
        kept[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    # quality: what its operator keeps
    verdict = quality.op1_quality(spark, tiny).where("kept").collect()
    assert ids["quality rules"] == {r.doc_id for r in verdict}
    # near-duplicates: all that goes is similar to something that was there, and exact copies go
    texts = {r.doc_id: r.text for r in kept["quality rules"]}
    assert len({texts[d] for d in ids["SimHash near-dedup"]}) == len(ids["SimHash near-dedup"])
    shingles = {d: bag(low(x)) for d, x in texts.items()}

    def jaccard(a, b):
        n = sum((a & b).values())
        return n / (sum(a.values()) + sum(b.values()) - n)

    for d in ids["quality rules"] - ids["SimHash near-dedup"]:
        assert max(jaccard(shingles[d], shingles[e]) for e in texts if e != d) > 0.7
    for d in ids["SimHash near-dedup"]:
        assert all(jaccard(shingles[d], shingles[e]) < 0.9 for e in ids["SimHash near-dedup"] if e != d)
    # decontamination
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    shared = {g for _, t in items for g in bag(low(t))}
    clean = {d for d in ids["SimHash near-dedup"] if not (shared & set(shingles[d]) and brute(texts[d], items))}
    assert ids["benchmark decontamination"] == clean
    # mixing: up to two copies of what was there, and 150 % of its words
    copies = Counter(r.doc_id for r in kept["mixing"])
    assert set(copies) <= clean and max(copies.values()) <= 2
    words = {d: len(low(texts[d])) for d in clean}
    assert abs(sum(words[d] * n for d, n in copies.items()) / (1.5 * sum(words.values())) - 1) < 0.1
    # sharding: every row once
    assert Counter(r.doc_id for r in kept["sharding"]) == copies


def test_run(spark, tiny):
    assert P.run(spark, tiny).count() > 0


def test_near_duplicate_stage_against_brute_force(spark, make_docs, tiny):
    rng = random.Random(21)
    docs = [(i, " ".join(w)) for i, w in enumerate(star(rng, 40, edits=6)[::-1])]
    for i in range(100, 130, 2):
        w = [f"b{rng.randrange(5000)}" for _ in range(404)]
        docs += [(i, " ".join(w)), (i + 1, " ".join(w[: 324 if i % 4 else 323]))]  # similarity 0.8 and just below
    line = " ".join(f"l{j}" for j in range(9))
    docs += [(200 + i, " ".join(f"{line} " + " ".join(f"r{i}x{rng.randrange(10**6)}" for _ in range(21)) for _ in range(100))) for i in range(4)]
    kept = {r.doc_id for r in P.near_duplicate_stage(spark, make_docs(*docs), tiny).collect()}
    assert kept == {c[0] for c in similar_classes(docs)}
