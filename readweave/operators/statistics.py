"""Statistics before and after deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import barcodes as B


def kept_counts(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, umi, n): the representative of each group, with the reads of the group."""
    return groups.where("is_top").select(*keys, "umi", F.col("group_n").alias("n"))


def count_histogram(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(counts, instances_pre, instances_post): how many (bundle, umi) have each number of reads."""
    tally = lambda df, c: df.groupBy(F.col("n").alias("counts")).agg(F.count(F.lit(1)).alias(c))
    both = tally(pre, "instances_pre").join(tally(post, "instances_post"), "counts", "full_outer")
    return both.fillna(0, ["instances_pre", "instances_post"]).orderBy("counts")


def per_umi(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(UMI, median, times and total before; the same after, 0 where the UMI is gone); medians are cut to integers."""

    def side(df: DataFrame, when: str) -> DataFrame:
        return df.groupBy(F.col("umi").alias("UMI")).agg(
            F.median("n").cast("long").alias(f"median_counts_{when}"), F.count(F.lit(1)).alias(f"times_observed_{when}"), F.sum("n").alias(f"total_counts_{when}")
        )

    return side(pre, "pre").join(side(post, "post"), "UMI", "left").fillna(0).orderBy("UMI")


def mean_distance(umis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, m, distance): the mean distance of all pairs of UMIs of a bundle, -1 for a single one. Counted place by
    place from how often each base stands there, so that no pairs are made."""
    length = F.length("umi")
    bases = umis.select(*keys, F.posexplode(F.filter(F.split("umi", ""), lambda c: c != "")).alias("i", "base"))
    equal = bases.groupBy(*keys, "i", "base").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.sum(F.expr("c * (c - 1) div 2")).alias("equal"))
    sizes = umis.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.max(length).alias("width"))
    both = sizes.join(equal, [sizes[k].eqNullSafe(equal[k]) for k in keys], "left").select(*[sizes[k] for k in keys], "m", "width", "equal")
    pairs = F.expr("m * (m - 1) div 2")
    return both.select(*keys, "m", F.when(F.col("m") == 1, F.lit(-1.0)).otherwise((pairs * F.col("width") - F.coalesce("equal", F.lit(0))) / pairs).alias("distance"))


def sampled_umis(umis: DataFrame, reads_per_umi: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """A random UMI for every row of umis, drawn by how many reads each UMI of reads_per_umi(umi, n, first_ord) has."""
    over = Window.orderBy("first_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = reads_per_umi.withColumn("hi", F.sum("n").over(over)).withColumn("lo", F.col("hi") - F.col("n"))
    total = reads_per_umi.agg(F.sum("n")).first()[0] or 0
    drawn = umis.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), *keys, F.col("umi")), F.lit(max(total, 1))))
    hit = cdf.select(F.col("umi").alias("random_umi"), "lo", "hi")
    # the ranges meet the draws by cells of equal width
    width = max(1, total // 1024)
    cells = hit.withColumn("cell_no", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    found = drawn.withColumn("cell_no", F.expr(f"u div {width}")).join(cells, "cell_no").where("u >= lo and u < hi")
    return found.select(*keys, F.col("random_umi").alias("umi"))


def distance_bins(observed: dict[str, DataFrame]) -> DataFrame:
    """(edit_distance, one column per name): bundles by mean distance, rounded up; Single_UMI first."""
    every = None
    for name, df in observed.items():
        one = df.select(F.lit(name).alias("name"), F.ceil("distance").cast("long").alias("bin"))
        every = one if every is None else every.unionByName(one)
    counts = every.groupBy("bin").pivot("name", list(observed)).count()
    last = every.agg(F.coalesce(F.max("bin"), F.lit(0)).alias("last"))
    bins = last.select(F.explode(F.sequence(F.lit(-1).cast("long"), F.greatest(F.col("last"), F.lit(0)))).alias("bin"))
    label: Column = F.when(F.col("bin") == -1, "Single_UMI").otherwise(F.col("bin").cast("string"))
    return bins.join(counts, "bin", "left").fillna(0).orderBy("bin").select(*observed, label.alias("edit_distance"))


def umi_histogram(reads: DataFrame, o) -> DataFrame:
    """(umi, n, first_ord, cdf) over mapped reads that are not second reads."""
    from ..functions import positions as P

    umi = o.barcode()[1]
    f = F.col("flag")
    kept = reads.where(F.col("rname").isNotNull() & ~P.has(f, "unmapped") & ~P.has(f, "read2")).select("ord", umi.alias("umi")).where("umi is not null")
    counts = kept.groupBy("umi").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    over = Window.orderBy("first_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("cdf", F.sum("n").over(over) / F.col("total")).drop("total")
