import random

import numpy as np
import pytest

from readweave.operators import clustering as K

EXAMPLE = {"ACGT": 456, "AAAT": 90, "ACAT": 72, "TCGT": 2, "CCGT": 2, "ACAG": 1}


def groups(counts, method, threshold=1):
    out = K.label_bundle(list(counts), np.array(list(counts.values())), np.arange(len(counts)), method, threshold)
    return [(g["final_umi"].iloc[0], set(g["umi"])) for _, g in out.groupby("group_ix", sort=True)]


def test_worked_example():
    assert [g for _, g in groups(EXAMPLE, "unique")] == [{u} for u in EXAMPLE]
    assert len(groups(EXAMPLE, "percentile")) == 6
    assert [g for _, g in groups({"AAAA": 100, "CCCC": 100, "GGGG": 100, "TTTT": 1}, "percentile")] == [{"AAAA"}, {"CCCC"}, {"GGGG"}]
    assert groups(EXAMPLE, "cluster") == [("ACGT", set(EXAMPLE))]
    assert groups(EXAMPLE, "directional") == [("ACGT", {"ACGT", "ACAT", "CCGT", "TCGT", "ACAG"}), ("AAAT", {"AAAT"})]
    assert sorted(map(sorted, (g for _, g in groups(EXAMPLE, "adjacency")))) == [["AAAT"], ["ACAG", "ACAT"], ["ACGT", "CCGT", "TCGT"]]


def test_ties_thresholds_and_errors():
    assert len(groups({"AAAA": 1, "AAAC": 1}, "directional")) == 1
    assert len(groups({"AAAA": 5, "AAAC": 5}, "directional", 0)) == 2
    assert groups({"": 7}, "directional") == [("", {""})]
    with pytest.raises(ValueError):
        groups({"ACGT": 1, "ACG": 1}, "directional")
    with pytest.raises(ValueError):
        K.check_method("other")


def sequential(counts, method, threshold):
    """Breadth-first from each seed in the order of counts."""
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= threshold
    order = sorted(counts, key=lambda u: -counts[u])
    edge = lambda a, b: a != b and near(a, b) and (method == "cluster" or counts[a] >= 2 * counts[b] - 1)
    done, out = set(), []
    for seed in order:
        if seed in done:
            continue
        found, queue = {seed}, [seed]
        while queue:
            a = queue.pop()
            for b in counts:
                if b not in found and edge(a, b):
                    found.add(b)
                    queue.append(b)
        out.append(found - done)
        done |= found
    return out


@pytest.mark.parametrize("method", ["directional", "cluster"])
def test_random_bundles_against_breadth_first_search(method):
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 4)
        umis = list({"".join(rng.choice("ACGT") for _ in range(n)) for _ in range(rng.randint(1, 30))})
        counts = {u: rng.randint(1, 6) for u in umis}
        t = rng.randint(0, 2)
        got = groups(counts, method, t)
        assert [g for _, g in got] == sequential(counts, method, t)
        assert [f for f, _ in got] == [min(g, key=lambda u: (-counts[u], u)) for _, g in got]


def test_large_bundles_meet_by_blocks():
    rng = random.Random(5)
    umis = sorted({"".join(rng.choice("ACGT") for _ in range(8)) for _ in range(600)})
    a, b = K.edges(umis, 2)
    want = {(i, j) for i in range(len(umis)) for j in range(len(umis)) if i != j and sum(x != y for x, y in zip(umis[i], umis[j], strict=True)) <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


@pytest.mark.parametrize("method", ["directional", "adjacency", "cluster", "percentile"])
def test_plans_agree(spark, method):
    rng = random.Random(6)
    rows = [(k or None, u, rng.randint(1, 9), i) for k in range(6) for i, u in enumerate(sorted({"".join(rng.choice("ACGT") for _ in range(4)) for _ in range(25)}))]
    counts = spark.createDataFrame(rows, "k int, umi string, n long, first_ord long")
    cols = ["k", "umi", "group_ix", "final_umi", "is_top", "group_n"]
    take = lambda plan, **how: sorted(map(tuple, K.cluster_umis(counts, ["k"], method, 1, plan, **how).select(cols).collect()), key=str)
    assert take("local") == take("frames") == take("auto", most_local=20)
