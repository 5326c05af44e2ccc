import pytest

from readweave import cli

SAM = "@SQ\tSN:c\tLN:99\n" + "".join(f"r{i}_{u}\t0\tc\t{p}\t9\t4M\t*\t0\t0\tACGT\tIIII\tXF:Z:g\n" for i, (u, p) in enumerate([("AAAA", 5), ("AAAA", 5), ("AAAA", 5), ("AAAC", 5), ("GGGG", 5), ("AAAA", 50)]))


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_alignments(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    base = ["-I", str(tmp_path / "a.sam"), "-S"]
    cli.run(spark, ["dedup", *base, str(tmp_path / "d"), "--output-stats", str(tmp_path / "s")])
    assert sorted(x.split("\t")[0].split("_")[1] for x in lines(spark, tmp_path / "d")) == ["AAAA", "AAAA", "GGGG"]
    assert "counts\tinstances_pre\tinstances_post" in lines(spark, tmp_path / "s_per_umi_per_position.tsv")
    cli.run(spark, ["group", *base, str(tmp_path / "g"), "--group-out", str(tmp_path / "t"), "-L", str(tmp_path / "log")])
    assert len(lines(spark, tmp_path / "g")) == 6 and all("UG:" in x and "BX:Z:" in x for x in lines(spark, tmp_path / "g"))
    assert sum("AAAC\t1\tAAAA\t4\t0" in x for x in lines(spark, tmp_path / "t")) == 1
    cli.run(spark, ["count", *base, str(tmp_path / "c"), "--per-gene", "--gene-tag", "XF"])
    assert "g\t2" in lines(spark, tmp_path / "c")


def test_raw_reads(spark, tmp_path):
    cells = ["AA"] * 6 + ["CC"] * 5 + ["AC"]
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\n{c}GT{'ACGT'[i % 4]}ACC\n+\nIIIIIIII\n" for i, c in enumerate(cells)))
    base = ["-I", str(tmp_path / "a.fq"), "-p", "CCNNN", "-S"]
    cli.run(spark, ["whitelist", *base, str(tmp_path / "w"), "--set-cell-number", "2"])
    assert lines(spark, tmp_path / "w") == ["AA\t\t6\t", "CC\t\t5\t"]
    cli.run(spark, ["extract", *base, str(tmp_path / "e"), "--whitelist", str(tmp_path / "w"), "--filtered-out", str(tmp_path / "f")])
    assert len(lines(spark, tmp_path / "e")) == 44 and lines(spark, tmp_path / "e")[0] == "@r0_AA_GTA" and len(lines(spark, tmp_path / "f")) == 4


def test_tables_and_pairs(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("r_AAAA\tg1\nr_AAAA\tg1\nr_CCCC\tg2\n")
    cli.run(spark, ["count-tab", "-I", str(tmp_path / "t.tsv"), "-S", str(tmp_path / "o")])
    assert {"g1\t1", "g2\t1"} <= set(lines(spark, tmp_path / "o"))
    one, two = "r1\t65\tc\t5\t9\t4M\t=\t9\t0\tACGT\tIIII\tBX:Z:AA", "r1\t129\tc\t9\t9\t4M\t=\t5\t0\tACGT\tIIII"
    (tmp_path / "p.sam").write_text(f"@SQ\tSN:c\tLN:99\n{one}\n{two}\n")
    cli.run(spark, ["prepare-for-em", "-I", str(tmp_path / "p.sam"), "-S", str(tmp_path / "q")])
    assert lines(spark, tmp_path / "q") == [one, f"{two}\tBX:Z:AA"]


def test_wrong_options():
    with pytest.raises(SystemExit) as e:
        cli.parser().parse_args(["dedup", "--method", "other"])
    assert e.value.code == 2
