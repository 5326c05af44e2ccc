"""Which cell barcodes are real: histogram, knee, corrections."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import barcodes as B

GRID = 10_000


def cell_histogram(codes: DataFrame, method: str = "reads") -> DataFrame:
    """(cell, n, first_ord) from (ord, cell, umi): reads, or distinct UMIs, of each cell."""
    if method not in ("reads", "umis"):
        raise ValueError("method must be reads or umis")
    n = F.count(F.lit(1)) if method == "reads" else F.countDistinct("umi")
    return codes.groupBy("cell").agg(n.alias("n"), F.min("ord").alias("first_ord"))


def subset_matched(codes: DataFrame, matched: str, n: int, paired: bool) -> DataFrame:
    """The reads that a subset of n looks at: single reads up to the one after n matches, pairs up to the first match
    after n pairs. Counting by ranges of ord keeps every window small."""
    if not n:
        return codes
    if paired:
        stop = codes.where(F.col(matched) & (F.col("ord") >= n)).agg(F.min("ord").alias("stop"))
    else:
        stop = codes.where(matched).select("ord").orderBy("ord").limit(n + 1).agg(F.max("ord").alias("stop"), F.count(F.lit(1)).alias("k")).select(F.when(F.col("k") > n, F.col("stop")).alias("stop"))
    return codes.crossJoin(F.broadcast(stop)).where("stop is null or ord <= stop").drop("stop")


def most_common(histogram: DataFrame) -> DataFrame:
    """histogram with rank from 0: by n, ties first seen."""
    return histogram.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "first_ord")) - 1).cast("long"))


def chord_distances(values: np.ndarray) -> np.ndarray:
    """How far each point of a curve is from the line between its ends."""
    x = np.arange(len(values), dtype=float)
    y = values.astype(float) - values[0]
    dx, dy = x[-1], y[-1]
    length = math.hypot(dx, dy)
    if not length:
        return np.hypot(x, y)
    ux, uy = dx / length, dy / length
    along = x * ux + y * uy
    return np.hypot(x - along * ux, y - along * uy)


def knee_index(counts: np.ndarray, most: int = 100) -> int:
    """The knee of the cumulative curve of descending counts: the farthest point from the chord, found again on the
    first three times as many points until it stays."""
    values = np.cumsum(counts.astype(float))
    at = int(np.argmax(chord_distances(values)))
    if at == 0:
        raise ValueError("the counts have no knee")
    for _ in range(most):
        before, at = at, int(np.argmax(chord_distances(values[: max(at * 3, 1)])))
        if at == before:
            break
    return at


def gaussian_density(data: np.ndarray, points: np.ndarray, bandwidth: float = 0.1) -> np.ndarray:
    """A kernel density whose kernel's width is `bandwidth` times the data's standard deviation. Equal data are summed
    once, so the cost follows the number of different counts."""
    sd = np.std(data, ddof=1) * bandwidth
    if not sd:
        raise ValueError("all counts are equal")
    value, n = np.unique(data, return_counts=True)
    out = np.zeros(len(points))
    for i in range(0, len(value), 256):
        z = (points[:, None] - value[None, i : i + 256]) / sd
        out += np.exp(-0.5 * z * z) @ n[i : i + 256]
    return out / (len(data) * sd * math.sqrt(2 * math.pi))


def local_minima(y: np.ndarray) -> np.ndarray:
    return np.flatnonzero((y[1:-1] < y[:-2]) & (y[1:-1] < y[2:])) + 1


def descending_counts(histogram: DataFrame) -> np.ndarray:
    """All counts, largest first: run lengths come to the driver, one row per different count."""
    runs = histogram.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
    return np.repeat(np.array([r.n for r in runs], np.int64), np.array([r.k for r in runs], np.int64))


def density_threshold(counts: np.ndarray, expect_cells: int | None = None) -> tuple[float | None, list[tuple[int, bool]]]:
    """The count above which cells are real (None: no minimum is accepted), and per minimum of the density, from the
    right, how many cells pass it and whether it was taken."""
    logs = np.log10(counts[counts > 0.001 * counts[0]].astype(float))
    grid = np.linspace(logs.min(), logs.max(), GRID)
    chosen, tried = None, []
    for i in local_minima(gaussian_density(logs, grid))[::-1]:
        passing = int((counts > 10.0 ** grid[i]).sum())
        if chosen is None:
            if expect_cells:
                good = 0.1 * expect_cells < passing <= expect_cells
            else:
                good = i >= 0.2 * GRID and (logs.max() - grid[i] > 0.5 or grid[i] < logs.max() / 2)
            if good:
                chosen = i
        tried.append((passing, chosen == i))
    return (None if chosen is None else float(10.0 ** grid[chosen])), tried


def cell_number_threshold(counts: np.ndarray, k: int) -> int:
    """The count at rank k (negative: from the end); only cells above it stay."""
    if not -len(counts) <= k < len(counts):
        raise ValueError(f"{len(counts)} cell barcodes were observed, {k} were asked for")
    return int(counts[k])


def find_cells(histogram: DataFrame, knee_method: str = "distance", expect_cells: int | None = None, cell_number: int | None = None) -> DataFrame | None:
    """The rows of the real cells, with rank; None if no threshold is accepted."""
    counts = descending_counts(histogram)
    if not len(counts):
        raise ValueError("no cell barcodes were observed")
    if cell_number is not None:
        if cell_number > len(counts):
            raise ValueError(f"{len(counts)} cell barcodes were observed, {cell_number} were asked for")
        return histogram.where(F.col("n") > cell_number_threshold(counts, cell_number))
    if knee_method == "distance":
        at = knee_index(counts)
        # cells of the knee's own count are taken first seen
        above = histogram.where(F.col("n") > int(counts[at]))
        room = at + 1 - int((counts > counts[at]).sum())
        return above.unionByName(histogram.where(F.col("n") == int(counts[at])).orderBy("first_ord").limit(room))
    if knee_method != "density":
        raise ValueError("knee_method must be distance or density")
    threshold, _ = density_threshold(counts, expect_cells)
    return None if threshold is None else histogram.where(F.col("n") > threshold)


def threshold_table(spark: SparkSession, histogram: DataFrame, knee_method: str = "distance", expect_cells: int | None = None) -> DataFrame:
    """What a plot of the threshold would say: (count) of the knee, or (count, action) of each minimum."""
    counts = descending_counts(histogram)
    if knee_method == "distance":
        return spark.createDataFrame([(knee_index(counts),)], "count long")
    _, tried = density_threshold(counts, expect_cells)
    return spark.createDataFrame([(n, "Selected" if s else "Rejected") for n, s in tried], "count long, action string")


def near_whitelist(cells: DataFrame, whitelist: DataFrame, threshold: int = 1) -> DataFrame:
    """(barcode, error): cells within threshold substitutions of exactly one whitelisted barcode. Both sides are cut
    into threshold + 1 blocks by length and meet where a block is equal."""
    spark = cells.sparkSession
    lengths = sorted(r[0] for r in whitelist.select(F.length("cell")).distinct().collect())  # a handful of lengths
    out = None
    for n in lengths:
        blocks = lambda df, name: df.where(F.length("cell") == n).select(F.col("cell").alias(name), F.inline(B.block_keys(F.col("cell"), n, threshold + 1)))  # noqa: B023, E731
        others = cells.join(whitelist.select("cell").distinct(), "cell", "left_anti")
        pairs = blocks(others, "error").join(blocks(whitelist, "barcode"), ["block", "part"]).select("error", "barcode").distinct()
        near = pairs.where(B.hamming("error", "barcode") <= threshold)
        one = near.groupBy("error").agg(F.count(F.lit(1)).alias("k"), F.first("barcode").alias("barcode")).where("k = 1").select("barcode", "error")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "barcode string, error string")


def errors_above(whitelist: DataFrame, errors: int = 1, resolve: str = "discard") -> tuple[DataFrame, DataFrame]:
    """(cells that stay, corrections (barcode, error)): a cell goes if a more frequent one (ties: a later one in the
    order of counts) begins with something within `errors` edits of it; with `correct`, one that differs by
    substitutions from exactly one such cell is recorded as its error."""
    if resolve not in ("discard", "correct"):
        raise ValueError("resolve must be discard or correct")
    ranked = whitelist.withColumn("place", F.row_number().over(Window.orderBy("n", "first_ord")))
    a, b = ranked.select(F.col("cell").alias("a"), F.col("place").alias("pa")), ranked.select(F.col("cell").alias("b"), F.col("place").alias("pb"))
    close = a.join(b, (F.col("pb") > F.col("pa")) & (F.abs(F.length("a") - F.length("b")) <= errors) & B.within_prefix_edits(F.col("a"), F.col("b"), errors))
    near = close.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.first("b").alias("b"))
    stay = whitelist.join(near.select(F.col("a").alias("cell")), "cell", "left_anti")
    start = F.substr("b", F.lit(1), F.length("a"))
    fixes = near.where((F.col("k") == 1) & (F.length("b") >= F.length("a")) & (B.hamming_or_null(F.col("a"), start) <= errors))
    corrections = fixes.select(F.col("b").alias("barcode"), F.col("a").alias("error"))
    return stay, corrections if resolve == "correct" else corrections.limit(0)


def whitelist_table(histogram: DataFrame, cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """(barcode, errors, n, error_counts), by barcode; the lists are joined by commas, in the order of the errors."""
    known = corrections.join(histogram.select(F.col("cell").alias("error"), "n"), "error").groupBy(F.col("barcode").alias("cell"))
    lists = known.agg(F.array_sort(F.collect_set(F.struct("error", "n"))).alias("e"))
    joined = cells.select("cell", "n").join(lists, "cell", "left")
    text = lambda k: F.coalesce(F.array_join(F.transform("e", lambda x: x[k].cast("string")), ","), F.lit(""))
    return joined.select(F.col("cell").alias("barcode"), text("error").alias("errors"), "n", text("n").alias("error_counts")).orderBy("barcode")


def product_barcodes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(ord, barcode): every barcode of the first list joined to every one of the second."""
    a, b = first.select("ord", "barcode"), second.select(F.col("ord").alias("ord2"), F.col("barcode").alias("barcode2"))
    size = second.agg(F.coalesce(F.max("ord"), F.lit(0)) + 1).first()[0]
    return a.crossJoin(b).select((F.col("ord") * size + F.col("ord2")).alias("ord"), F.concat("barcode", "barcode2").alias("barcode"))


def derive_errors(barcodes: DataFrame, threshold: int = 1) -> DataFrame:
    """(error, barcode): all barcodes made by `threshold` substitutions (places may repeat), with a null barcode where
    an error comes up more than once. Threshold 0 gives each barcode itself."""
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    made = barcodes.select("barcode", F.split("barcode", "").alias("bases"), F.col("barcode").alias("error"))
    table = F.create_map(*[x for k, v in B.BASE_ERRORS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    for _ in range(threshold):
        spots = made.where(F.length("barcode") > 0).select("barcode", "error", F.explode(F.sequence(F.lit(1), F.length("barcode"))).alias("i"))
        base = F.substr("barcode", F.col("i"), F.lit(1))
        choices = F.coalesce(F.try_element_at(table, base), F.raise_error(F.concat(F.lit("no errors are known for this base: "), base)).cast("array<string>"))
        made = spots.select("barcode", "error", "i", F.explode(choices).alias("to"))
        made = made.select("barcode", F.overlay("error", "to", F.col("i"), F.lit(1)).alias("error"))
    return made.groupBy("error").agg(F.when(F.count(F.lit(1)) == 1, F.first("barcode")).alias("barcode"))


def listed_errors(whitelist: DataFrame) -> DataFrame:
    """(error, barcode) from (ord, barcode, errors); of several barcodes with one error, the last line's holds."""
    bad = F.raise_error(F.concat(F.lit("the whitelist has no second field: "), F.col("barcode"))).cast("string")
    each = whitelist.select("ord", "barcode", F.explode(F.split(F.coalesce("errors", bad), ",")).alias("error"))
    return each.groupBy("error").agg(F.max_by("barcode", "ord").alias("barcode"))
