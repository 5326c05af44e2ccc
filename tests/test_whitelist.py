import numpy as np
import pytest

from readweave.operators import whitelist as L


def cells(spark, *counts):
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(counts)], "cell string, n long, first_ord long")


def test_numbers():
    assert L.local_minima(np.array([3, 1, 2, 0.5, 2, 2, 1, 4])).tolist() == [1, 3, 6]
    assert L.gaussian_density(np.array([0.0, 1, 2, 3]), np.array([1.5]))[0] == pytest.approx(0.000854568894921412)
    counts = np.array([100, 95, 90, 88, 3, 2, 2, 1, 1, 1])
    assert L.knee_index(counts) == 3
    assert L.cell_number_threshold(counts, -1) == 1
    for bad in (10, -11):
        with pytest.raises(ValueError):
            L.cell_number_threshold(counts, bad)
    with pytest.raises(ValueError):
        L.knee_index(np.array([5]))


def test_order_and_knee(spark):
    h = cells(spark, ("ZZZ", 5), ("AAA", 5), ("MMM", 9))
    assert [r.cell for r in L.most_common(h).orderBy("rank").collect()] == ["MMM", "ZZZ", "AAA"]
    many = cells(spark, *[(f"A{i}", 100 - i) for i in range(4)], *[(f"C{i}", 1) for i in range(9)])
    assert {r.cell for r in L.find_cells(many).collect()} == {"A0", "A1", "A2", "A3"}


def test_corrections(spark):
    near = lambda c, *w: {(r.barcode, r.error) for r in L.near_whitelist(cells(spark, (c, 1)), cells(spark, *[(x, 9) for x in w]), 1).collect()}
    assert near("AAAG", "AAAA", "AAAT") == set()
    assert near("AAAT", "AAAA") == {("AAAA", "AAAT")}


def test_errors_above(spark):
    h = cells(spark, ("AAAA", 9), ("AAAC", 3), ("GGGG", 5))
    stay, fixes = L.errors_above(h, 1, "correct")
    assert {r.cell for r in stay.collect()} == {"AAAA", "GGGG"}
    assert [tuple(r) for r in fixes.collect()] == [("AAAA", "AAAC")]


def test_derived_errors(spark):
    w = spark.createDataFrame([("ACGTA",)], "barcode string")
    tally = lambda t: (lambda rows: (sum(r.barcode is not None for r in rows), len(rows)))(L.derive_errors(w, t).collect())
    assert [tally(t) for t in (0, 1, 2)] == [(1, 1), (20, 20), (0, 180)]
    with pytest.raises(Exception, match="no errors are known"):
        L.derive_errors(spark.createDataFrame([("ANA",)], "barcode string"), 1).collect()
