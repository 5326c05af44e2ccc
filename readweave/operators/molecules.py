"""Deduplicate, label and count: what the clusters of UMIs are for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import barcodes as B
from ..functions import positions as P
from . import bundles as R
from .clustering import cluster_umis


def join_groups(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a with the other columns of b, where all keys agree (null with null)."""
    right = b.select(*[F.col(k).alias(f"right_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return a.join(right, on).drop(*[f"right_{k}" for k in keys])


def sorted_alignments(reads: DataFrame) -> DataFrame:
    """By contig and place (reverse strand last), unplaced reads at the end, ties as they came."""
    return reads.orderBy(F.asc_nulls_last("rname"), "pos", P.has(F.col("flag"), "reverse"), "ord")


def dedup(
    reads: DataFrame,
    o: R.BundleOptions,
    method: str = "directional",
    threshold: int = 1,
    tie: str = "hash",
    umi_whitelist: DataFrame | None = None,
    output_unmapped: bool = False,
    plan: str = "auto",
) -> DataFrame:
    """One read per molecule: the best read of each group's representative, with final_umi and group_n. With a
    umi_whitelist (umi), groups stay only if it holds their representative. Paired reads bring their mates."""
    triaged = R.triage(reads, o, return_unmapped=output_unmapped)
    keyed = R.bundle_keys(triaged, o)
    tops = cluster_umis(R.umi_counts(keyed), R.KEYS, method, threshold, plan).where("is_top")
    if umi_whitelist is not None:
        tops = tops.join(umi_whitelist.select(F.col("umi").alias("final_umi")).distinct(), "final_umi", "left_semi")
    best = R.best_reads(keyed, o, tie=tie)
    kept = join_groups(best, tops.select(*R.KEYS, "umi", "group_n"), [*R.KEYS, "umi"]).select(*reads.columns, "umi", "group_n")
    if o.paired:
        kept = kept.unionByName(mates(reads, kept), allowMissingColumns=True)
    if output_unmapped:
        kept = kept.unionByName(triaged.where("single").select(*reads.columns), allowMissingColumns=True)
    return kept


def mates(reads: DataFrame, kept: DataFrame) -> DataFrame:
    """The second reads of the kept pairs: one for every (name, mate contig, mate place), the first as they came."""
    f = F.col("flag")
    wanted = kept.where(~P.has(f, "unmapped") & ~P.has(f, "mate_unmapped")).select("qname", F.col("mate_rname").alias("rname"), F.col("mate_pos").alias("pos")).distinct()
    found = reads.where(~P.has(f, "unmapped") & ~P.has(f, "mate_unmapped") & ~P.has(f, "read1")).join(wanted, ["qname", "rname", "pos"], "left_semi")
    first = F.row_number().over(Window.partitionBy("qname", "rname", "pos").orderBy("ord"))
    return found.withColumn("place", first).where("place = 1").select(*reads.columns)


def label(reads: DataFrame, o: R.BundleOptions, method: str = "directional", threshold: int = 1, group_tag: str = "BX", output_unmapped: bool = False, plan: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(alignments, table): all bundled reads tagged UG (number of the group) and group_tag (its UMI), together with
    the reads passed through; and one table row per bundled read."""
    if o.ignore_umi:
        raise ValueError("groups cannot be labelled without UMIs")
    triaged = R.triage(reads, o, return_read2=True, return_unmapped=output_unmapped)
    keyed = R.bundle_keys(triaged, o)
    groups = number_groups(cluster_umis(R.umi_counts(keyed), R.KEYS, method, threshold, plan))
    groups = groups.select(*R.KEYS, "umi", F.col("n").alias("umi_count"), "final_umi", F.col("group_n").alias("final_umi_count"), "unique_id")
    joined = join_groups(keyed, groups, [*R.KEYS, "umi"])
    tags = P.set_tag(P.set_tag(F.col("tags"), "UG", F.col("unique_id")), group_tag, F.col("final_umi"))
    labelled = joined.withColumn("tags", tags)
    alignments = labelled.select(*reads.columns).unionByName(triaged.where("single").select(*reads.columns))
    gene = F.col("rname") if o.per_contig else F.coalesce(F.col("tags")[o.gene_tag], F.lit("NA")) if o.per_gene else F.lit("NA")
    place = P.read_position(F.col("pos"), F.col("cigar"), F.col("flag"), o.soft_clip_threshold)["pos"]
    table = joined.select(F.col("qname").alias("read_id"), F.col("rname").alias("contig"), place.alias("position"), gene.alias("gene"), "umi", "umi_count", "final_umi", "final_umi_count", "unique_id")
    return alignments, table


def number_groups(groups: DataFrame) -> DataFrame:
    """groups with unique_id from 0, in the order of contig, position and key: ranks within a contig plus the totals of
    the contigs before it, so that no window spans the table."""
    order = ["gene", "position", "is_reverse", "spliced", "tlen_key", "length_key", "cell", "group_ix"]
    heads = groups.where("is_top").select(*R.KEYS, "group_ix")
    within = heads.withColumn("within", F.row_number().over(Window.partitionBy("contig").orderBy(*[F.asc_nulls_first(c) for c in order])))
    totals = heads.groupBy("contig").agg(F.count(F.lit(1)).alias("k"))
    before = totals.withColumn("before", F.sum("k").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")).drop("k")
    ids = join_groups(within, before, ["contig"]).withColumn("unique_id", F.col("before") + F.col("within") - 1).drop("before", "within")
    return join_groups(groups, ids, [*R.KEYS, "group_ix"])


def count_genes(reads: DataFrame, o: R.BundleOptions, method: str = "directional", threshold: int = 1, plan: str = "auto") -> DataFrame:
    """(gene, count) with one row per gene and contig, or (gene, cell, count) with per_cell, where the last contig of a
    gene counts."""
    if not o.per_gene:
        raise ValueError("counting needs per_gene")
    keyed = R.bundle_keys(R.triage(reads, o), o)
    keys = ["contig", "gene", "cell"]
    groups = cluster_umis(R.umi_counts(keyed, keys), keys, method, threshold, plan)
    per = groups.groupBy(*keys).agg(F.sum(F.col("is_top").cast("long")).alias("count"))
    if o.per_cell:
        return per.groupBy("gene", "cell").agg(F.max_by("count", "contig").alias("count")).orderBy("gene", "cell")
    return per.orderBy("contig", "gene").select("gene", "count")


def wide_counts(counts: DataFrame, cells: Sequence[str] | None = None) -> DataFrame:
    """(gene, one column per cell in order), 0 where there is none. Given the cells, the table is read once."""
    return counts.groupBy("gene").pivot("cell", cells and sorted(cells)).agg(F.first("count")).fillna(0).orderBy("gene")


def count_table(rows: DataFrame, per_cell: bool = False, method: str = "directional", threshold: int = 1, separator: str = "_", plan: str = "auto") -> DataFrame:
    """Counts from (ord, read_id, gene), a table sorted by gene: (gene, count) or (cell, gene, count). A gene that
    comes back after another one is counted again."""
    cell, umi = B.barcode_from_name(F.col("read_id"), per_cell, separator)
    numbered = gene_runs(rows)
    keys = ["run", "gene", "cell"]
    counts = numbered.select("ord", "run", "gene", F.coalesce(cell, F.lit("")).alias("cell"), umi.alias("umi")).where("gene <> ''").groupBy(*keys, "umi").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    groups = cluster_umis(counts, keys, method, threshold, plan)
    per = groups.groupBy(*keys).agg(F.sum(F.col("is_top").cast("long")).alias("count"), F.min("first_ord").alias("at")).orderBy("run", "at")
    return per.select("cell", "gene", "count") if per_cell else per.select("gene", "count")


def gene_runs(rows: DataFrame, parts: int = 64) -> DataFrame:
    """rows with run, the number of the run of equal genes: changes are counted inside ranges of ord, and the totals of
    the ranges before are added, so that no window spans the table."""
    if parts > 1:
        lo, hi = rows.agg(F.min("ord"), F.max("ord")).first()
        width = max(1, ((hi or 0) - (lo or 0)) // parts + 1)
        cut = F.floor((F.col("ord") - F.lit(lo or 0)) / width).cast("int")
    else:
        cut = F.lit(0)
    parted = rows.withColumn("cut", cut)
    by = Window.partitionBy("cut").orderBy("ord")
    marked = parted.withColumn("change", F.coalesce((~F.col("gene").eqNullSafe(F.lag("gene").over(by))).cast("long"), F.lit(1)) * (F.row_number().over(by) > 1).cast("long"))
    marked = marked.withColumn("inside", F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = parted.groupBy("cut").agg(F.min_by("gene", "ord").alias("first_gene"), F.max_by("gene", "ord").alias("last_gene"))
    sums = marked.groupBy("cut").agg(F.sum("change").alias("changes"))
    over = Window.orderBy("cut")
    base = ends.join(sums, "cut").withColumn("edge", F.coalesce((~F.col("first_gene").eqNullSafe(F.lag("last_gene").over(over))).cast("long"), F.lit(1)) * (F.row_number().over(over) > 1).cast("long"))
    base = base.withColumn("base", F.sum(F.col("edge") + F.col("changes")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("changes"))
    return marked.join(base.select("cut", "base"), "cut").withColumn("run", F.col("inside") + F.col("base")).drop("cut", "change", "inside", "base")
