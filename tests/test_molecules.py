import pytest

from readweave.operators import bundles as R
from readweave.operators import extraction as X
from readweave.operators import molecules as M
from readweave.sources.alignments import SCHEMA


def reads(spark, *rows):
    full = lambda i, qname, flag=0, rname="c", pos=0, mapq=9, cigar="9M", tags=None, mate="c", mate_pos=5: (i, qname, flag, rname, pos, mapq, cigar, mate, mate_pos, 0, "ACGT", None, tags or {}, {})
    return spark.createDataFrame([full(i, **r) for i, r in enumerate(rows)], SCHEMA)


def test_dedup_keeps_the_best_read(spark):
    df = reads(spark, {"qname": "a_AAAA", "mapq": 3}, {"qname": "b_AAAA", "mapq": 8}, {"qname": "c_AAAC"}, {"qname": "d_GGGG"}, {"qname": "e_AAAA", "flag": 4})
    out = {(r.qname, r.group_n) for r in M.dedup(df, R.BundleOptions(), tie="ord").collect()}
    assert out == {("b_AAAA", 3), ("d_GGGG", 1)}


def test_ties_drop_the_first_read(spark):
    df = reads(spark, *[{"qname": f"{c}_AAAA"} for c in "abc"])
    (r,) = M.dedup(df, R.BundleOptions()).collect()
    assert r.qname != "a_AAAA"


def test_missing_tags(spark):
    df = reads(spark, {"qname": "a", "tags": {"RX": "AA"}}, {"qname": "b"})
    o = R.BundleOptions(extract_method="tag")
    events = {r.event: r.n for r in R.event_counts(R.triage(df, o)).collect()}
    assert events == {"Input Reads": 2, "Read skipped, missing umi and/or cell tag": 1}
    with pytest.raises(Exception, match="no barcode tag"):
        R.triage(df, R.BundleOptions(extract_method="tag", ignore_umi=True, per_cell=True, cell_tag="CB")).collect()


def test_option_checks():
    for bad in ({"per_gene": True}, {"gene_tag": "XF", "per_contig": True, "per_gene": True}, {"chimeric_pairs": "x"}, {"per_cell": True, "extract_method": "tag"}):
        with pytest.raises(ValueError):
            R.BundleOptions(**bad)


def test_unpaired_output_is_also_bundled(spark):
    df = reads(spark, {"qname": "a_AA"})
    (r,) = R.triage(df, R.BundleOptions(paired=True, unpaired_reads="output")).collect()
    assert r.single and r.bundled


def test_extraction(spark):
    df = spark.createDataFrame([(0, ("r1 x", "AACCGG", "IIIIII"))], "ord long, read1 struct<identifier:string, seq:string, quals:string>")
    o = X.ExtractOptions("(?P<cell_3>.{2})(?P<cell_1>.{2})(?P<umi_1>.{2})", method="regex")
    r = X.extract(df, o).first()
    assert (r.cell, r.umi, r.read1.identifier, r.read1.seq) == ("CCAA", "GG", "r1_CCAA_GG x", "")
    kept = X.extract(df, X.ExtractOptions("NNXX", retain_umi=False)).first()
    assert (kept.umi, kept.read1.seq) == ("AA", "CCGG")
    with pytest.raises(Exception, match="shorter"):
        X.extract(df, X.ExtractOptions("N" * 9)).collect()
    with pytest.raises(ValueError):
        X.ExtractOptions("NNZ")
    with pytest.raises(ValueError):
        X.ExtractOptions("NN", separator="")
    none = X.extract(df, X.ExtractOptions("(?P<umi_1>T{2})", method="regex"))
    assert not none.first().kept and X.rejected(df, none).count() == 1


def test_either_read(spark):
    row = (0, ("r1", "ATTTT", "IIIII"), ("r2", "GTTTT", "!!!!!"))
    df = spark.createDataFrame([row], "ord long, read1 struct<identifier:string, seq:string, quals:string>, read2 struct<identifier:string, seq:string, quals:string>")
    p = "^(?P<umi_1>[AG])T+"
    quality = X.extract(df, X.ExtractOptions(p, p, method="regex", either_read=True, either_read_resolve="quality")).first()
    assert quality.kept and quality.umi == "A" and quality.read2.identifier == "r1_A"
    assert not X.extract(df, X.ExtractOptions(p, p, method="regex", either_read=True)).first().kept


def test_runs_do_not_depend_on_the_number_of_ranges(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate("aabbbacca")], "ord long, gene string")
    runs = [[r.run for r in M.gene_runs(df, p).orderBy("ord").collect()] for p in (1, 2, 5, 64)]
    assert runs[0] == [0, 0, 1, 1, 1, 2, 3, 3, 4] and all(r == runs[0] for r in runs)
    assert M.wide_counts(spark.createDataFrame([("g", "c", 2)], "gene string, cell string, count long")).collect()[0].c == 2
