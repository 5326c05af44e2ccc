import random

import pytest

from readweave.operators import bundles as R
from readweave.sources.fastq import read_fastq
from readweave.sources.text import numbered_lines


def survivors(group, method):
    """Every ord that may stay, by following the reads one by one with both outcomes of each draw."""
    states = set()
    for o, mapq, tag in group:
        if not states:
            states = {((o, mapq, tag), 0)}
            continue
        after = set()
        for best, n in states:
            if best[1] > mapq:
                after.add((best, n))
                continue
            if best[1] < mapq:
                after.add(((o, mapq, tag), 0))
                continue
            if method in ("NH", "X0"):
                if int(best[2]) < int(tag):
                    after.add((best, n))
                    continue
                if int(best[2]) > int(tag):
                    best, n = (o, mapq, tag), 0
            elif method == "XT":
                if best[2] == "U":
                    after.add((best, n))
                    continue
                if tag == "U":
                    best, n = (o, mapq, tag), 0
            after.add(((o, mapq, tag), n + 1))
            if n:
                after.add((best, n + 1))
        states = after
    return {best[0] for best, _ in states}


@pytest.mark.parametrize("method", [None, "NH", "X0", "XT"])
def test_default_ties_against_a_sequential_model(spark, method):
    rng = random.Random(3)
    groups, rows, o = {}, [], 0
    for g in range(300):
        for _ in range(rng.randint(1, 6)):
            tag = rng.choice("URU") if method == "XT" else str(rng.randint(1, 3))
            mapq = rng.choice([3, 8, 8])
            groups.setdefault(g, []).append((o, mapq, tag))
            rows.append((o, f"b{g}", "AC", mapq, {method or "NH": tag}))
            o += 1
    df = spark.createDataFrame(rows, "ord long, contig string, umi string, mapq int, tags map<string,string>")
    seen = {g: set() for g in groups}
    for seed in range(12):
        opts = R.BundleOptions(detection_method=method, seed=seed)
        for r in R.best_reads(df, opts, ["contig"]).collect():
            seen[int(r.contig[1:])].add(r.ord)
    allowed = {g: survivors(v, method) for g, v in groups.items()}
    assert all(seen[g] <= allowed[g] for g in groups)
    assert sum(map(len, seen.values())) > 0.97 * sum(map(len, allowed.values()))


def test_tags_are_asked_for_on_ties_only(spark):
    make = lambda *rows: spark.createDataFrame([(i, "c", "A", m, t) for i, (m, t) in enumerate(rows)], "ord long, contig string, umi string, mapq int, tags map<string,string>")
    nh = R.BundleOptions(detection_method="NH")
    assert R.best_reads(make((8, {"NH": "1"}), (3, {})), nh, ["contig"]).first().ord == 0
    with pytest.raises(Exception, match="NH not present"):
        R.best_reads(make((8, {"NH": "1"}), (8, {})), nh, ["contig"]).collect()
    xt = R.BundleOptions(detection_method="XT")
    assert R.best_reads(make((8, {"XT": "U"}), (8, {})), xt, ["contig"]).first().ord == 0
    with pytest.raises(Exception, match="XT not present"):
        R.best_reads(make((8, {"XT": "R"}), (8, {})), xt, ["contig"]).collect()


def test_many_files_in_many_parts(spark, tmp_path):
    want = []
    for name, n in (("a", 61), ("b", 60), ("c", 1)):
        with open(tmp_path / f"{name}.fastq", "w") as f:
            for i in range(n):
                want.append(f"{name}{i}")
                f.write(f"@{name}{i} x\n{'ACGT' * (1 + i % 20)}\n+\n{'IIII' * (1 + i % 20)}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = [r.identifier.split(" ")[0] for r in read_fastq(spark, str(tmp_path)).orderBy("ord").collect()]
        assert got == want
        assert [r.line_no for r in numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == list(range(4 * 122))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
