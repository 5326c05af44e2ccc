import pytest
from pyspark.sql import functions as F

from readweave.functions import barcodes as B
from readweave.functions import fuzzy as Z
from readweave.functions import positions as P


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_slices():
    assert B.block_slices(8, 2) == [(0, 4), (4, 8)]
    assert B.block_slices(10, 3) == [(0, 4), (4, 7), (7, 10)]
    assert B.block_slices(8, -1) == []
    with pytest.raises(ValueError):
        B.block_slices(8, 0)


def test_splice_offsets(spark):
    cigars = ["5S40M", "5S40M100N10M", "10M5I10M50N", "10M5D10M50N"]
    assert one(spark, *[P.splice_offset(P.parse_cigar(F.lit(c))) for c in cigars]) == [0, 45, 20, 25]
    with pytest.raises(Exception, match="bad CIGAR"):
        one(spark, P.splice_offset(P.parse_cigar(F.lit("5Q"))))


def test_positions(spark):
    at = lambda pos, cigar, flag: P.read_position(F.lit(pos).cast("long"), F.lit(cigar), F.lit(flag))
    (forward, back) = one(spark, at(2, "5S45M", 0), at(10, "40M10S", 16))
    assert (forward.start, forward.pos) == (-3, -3)
    assert (back.start, back.pos) == (10, 60)


def test_qualities(spark):
    mask = B.mask_low(F.lit("ACGT"), F.lit("II!I"), "phred33", 30)
    assert one(spark, mask, B.any_below(F.lit("II!I"), "phred33", 1), B.any_below(F.lit("III"), "phred33", 1)) == ["ACNT", True, False]


def test_python_integers_and_slices(spark):
    n = lambda x: F.lit(x).cast("long")
    assert one(spark, *[B.floor_div(n(a), n(b)) for a, b in ((7, 2), (-7, 2), (7, -2), (-7, -2))]) == [3, -4, -4, 3]
    assert one(spark, *[B.floor_mod(n(a), n(b)) for a, b in ((7, 2), (-7, 2), (7, -2), (-7, -2))]) == [1, 1, -1, -1]
    text = F.lit("abcde")
    assert one(spark, B.item(text, -1), B.item(text, 9), B.piece(text, -3), B.piece(text, 1, -1), B.piece(text, 4, 2)) == ["e", None, "cde", "bcd", ""]


def test_prefix_edits(spark):
    near = [B.within_prefix_edits(F.lit("AAAA"), F.lit(x), 1) for x in ("AAAA", "AAAC", "AACA", "CCCC", "AAACC")]
    assert one(spark, *near) == [True, True, True, False, True]


def test_barcodes_in_names_and_tags(spark):
    cell, umi = B.barcode_from_name(F.lit("read_1_AC_GT"), per_cell=True)
    c2, u2 = B.barcode_from_labels(F.lit("x:CELL_AA:UMI_CC:UMI_GG"), per_cell=True)
    tags = F.create_map(F.lit("RX"), F.lit("AC-GT"), F.lit("CB"), F.lit("AA-1"))
    c3, u3 = B.barcode_from_tags(tags, "RX", "CB", True, umi_delimiter="-")
    assert one(spark, cell, umi, c2, u2, c3, u3) == ["AC", "GT", "AA", "GG", "AA", "ACGT"]


def test_errors_bind_to_the_element_before(spark):
    last = Z.match(F.lit("AACTG"), "(?P<umi_1>.{2})CTT{s<=1}")
    group = Z.match(F.lit("AAGTT"), "(?P<umi_1>.{2})(?P<discard_1>CTT){s<=1}")
    fails = Z.match(F.lit("AAGTT"), "(?P<umi_1>.{2})CTT{s<=1}")
    a, b, c = one(spark, last, group, fails)
    assert a["umi_1"].text == "AA" and b["discard_1"].stop == 5 and c is None


def test_flat_and_general_patterns_agree(spark):
    flat, nested = "(?P<cell_1>A+)(?P<umi_1>.{3})C", "(?P<cell_1>A+)(?P<umi_1>(?:.){3})C"
    assert Z.flat_parts(flat) and Z.flat_parts(nested) is None
    for text in ("AAGGGC", "AGGGC", "GGG", "AAAAC"):
        a, b = one(spark, Z.match(F.lit(text), flat), Z.match(F.lit(text), nested))
        assert a == b


def test_refused_patterns():
    for p in ("(?=A)", "(?<!A)", r"(A)\1", "(?i:a)", "(A", "(?>A)"):
        with pytest.raises(ValueError):
            Z.check_pattern(p)


def test_tags(spark):
    tags = F.create_map(F.lit("RX"), F.lit("A"), F.lit("NH"), F.lit("1"))
    empty = F.create_map().cast("map<string,string>")
    a, b, c = one(spark, P.set_tag(tags, "RX", F.lit("B")), P.copy_tag(tags, empty, "RX"), P.copy_tag(empty, tags, "NH"))
    assert a == {"RX": "B", "NH": "1"} and b == {"RX": "A", "NH": "1"} and c == {"NH": "1"}
    with pytest.raises(ValueError):
        P.check_tag("ABC")
