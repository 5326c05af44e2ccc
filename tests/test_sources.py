import gzip
import struct

import pytest
from pyspark.sql import functions as F

from readweave.sources import alignments as A
from readweave.sources import fastq as Q
from readweave.sources import text as X

READS = "@r1/1 x\nACGT\n+\nIIII\n@r2/1 x\nGG\n+\nII\n"


def test_fastq(spark, tmp_path):
    for name, write in (("a.fq", open), ("a.fq.gz", gzip.open)):
        with write(tmp_path / name, "wt") as f:
            f.write(READS)
        got = Q.read_fastq(spark, str(tmp_path / name), ignore_suffix=True).orderBy("ord").collect()
        assert [tuple(r) for r in got] == [(0, "r1 x", "ACGT", "IIII"), (1, "r2 x", "GG", "II")]
    with gzip.open(tmp_path / "b.z", "wt") as f:
        f.write(READS)
    assert Q.read_fastq(spark, str(tmp_path / "b.z")).count() == 2
    (tmp_path / "c.fq").write_text(READS + "\n@later\nA\n+\nI\n")
    assert Q.read_fastq(spark, str(tmp_path / "c.fq")).count() == 2
    (tmp_path / "d.fq").write_text("r1\nA\n+\nI\n")
    with pytest.raises(Exception, match="no @"):
        Q.read_fastq(spark, str(tmp_path / "d.fq")).collect()


def test_pairs(spark):
    make = lambda *names: spark.createDataFrame([(i, n, "A", "I") for i, n in enumerate(names)], "ord long, identifier string, seq string, quals string")
    assert Q.join_pairs(make("a 1", "b 1"), make("a 2", "b 2", "c 2")).count() == 2
    for other in (make("a", "x"), make("a")):
        with pytest.raises(Exception, match="names differ|ends before"):
            Q.join_pairs(make("a", "b"), other).collect()
    assert Q.join_pairs(make("a", "b"), make("z"), check_names=False).count() == 1
    assert Q.reconcile_pairs(make("b", "d"), make("a", "b", "c", "d")).count() == 2


def test_sam(spark, tmp_path):
    line = "r1\t99\tchr1\t10\t60\t5S45M\t=\t110\t150\tACGT\tIIII\tRX:Z:AC\tNH:i:1"
    lone = "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"
    (tmp_path / "a.sam").write_text("@HD\tVN:1.5\n@SQ\tSN:chr1\tLN:99\n" + line + "\n" + lone + "\n")
    reads = A.read_alignments(spark, str(tmp_path / "a.sam"))
    assert [r.line for r in A.sam_text(reads).orderBy("ord").collect()] == [line.replace("RX:Z:AC\tNH:i:1", "NH:i:1\tRX:Z:AC"), lone]
    assert A.read_alignments(spark, str(tmp_path / "a.sam"), contig="chr1").count() == 1
    assert A.read_contigs(spark, str(tmp_path / "a.sam")).first().contig == "chr1"
    assert A.sorted_header(["@HD\tVN:1.5\tSO:unsorted", "@SQ\tSN:a"]) == ["@HD\tVN:1.5\tSO:coordinate", "@SQ\tSN:a"]
    assert A.sorted_header([])[0] == "@HD\tVN:1.6\tSO:coordinate"


def bam(path):
    name = b"r1\0"
    seq = bytes([0x12, 0x48])
    tags = b"RXZAC\0" + b"NHC\x01"
    body = struct.pack("<iiBBHHHiiii", 0, 9, len(name), 60, 0, 1, 16, 4, -1, -1, 0) + name + struct.pack("<I", 4 << 4) + seq + bytes([40] * 4) + tags
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 99)
    path.write_bytes(gzip.compress(head + struct.pack("<i", len(body)) + body) + A.BGZF_END)


def test_bam(spark, tmp_path):
    bam(tmp_path / "a.bam")
    (r,) = A.read_alignments(spark, str(tmp_path / "a.bam")).collect()
    assert (r.qname, r.flag, r.rname, r.pos, r.cigar, r.seq, r.qual, r.tags) == ("r1", 16, "chr1", 9, "4M", "ACGT", "IIII", {"RX": "AC", "NH": "1"})
    (tmp_path / "b.bam").write_bytes((tmp_path / "a.bam").read_bytes()[:-28])
    with pytest.raises(Exception, match="cut off"):
        A.read_alignments(spark, str(tmp_path / "b.bam")).collect()
    with pytest.raises(ValueError):
        A.read_alignments(spark, "x.cram")
    assert [A.alignment_format(*x) for x in (("a.BAM",), ("a.txt",), ("a.bam", True), ("a", False, "SAM"))] == ["bam", "bam", "sam", "sam"]


def test_tables(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("#c\nAA\tAC,AG\t5\nCC\t\t3\n")
    assert [(r.barcode, r.errors) for r in X.read_whitelist(spark, str(tmp_path / "w.tsv")).orderBy("ord").collect()] == [("AA", "AC,AG"), ("CC", "")]
    (tmp_path / "m.tsv").write_text("#x\ng1\tt1\ng1\tt2\ng2\tt9\n\ng3\tt1\n")
    contigs = spark.createDataFrame([("t1",), ("t2",)], "contig string")
    assert {(r.gene, r.transcript) for r in X.read_transcript_map(spark, str(tmp_path / "m.tsv"), contigs).collect()} == {("g1", "t1"), ("g1", "t2")}
    (tmp_path / "g.tsv").write_text("r_A\tg\nbad\n")
    with pytest.raises(Exception, match="two fields"):
        X.read_gene_table(spark, str(tmp_path / "g.tsv")).collect()
    X.write_lines(spark.createDataFrame([(1, "b"), (0, "a")], "o long, v string"), str(tmp_path / "out"), "o")
    assert [r.line for r in X.numbered_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()] == ["a", "b"]
    X.write_table(spark.range(2).select(F.col("id")), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
