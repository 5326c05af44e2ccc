"""Command line: python -m readweave.cli COMMAND [options]. Outputs are folders of part files; tables have a header.

whitelist, extract, group, dedup, count, count-tab, prepare-for-em. Wrong options exit with 2, failed runs with 1.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bundles as R
from .operators import extraction as X
from .operators import molecules as M
from .operators import pairing as J
from .operators import statistics as S
from .operators import whitelist as L
from .operators.clustering import METHODS, cluster_umis
from .sources import alignments as A
from .sources import fastq as Q
from .sources import text as T


def _barcode_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--extract-method", choices=["string", "regex"], default="string")
    p.add_argument("-p", "--bc-pattern")
    p.add_argument("--bc-pattern2")
    p.add_argument("--3prime", dest="three_prime", action="store_true")
    p.add_argument("--read2-in")
    p.add_argument("--filtered-out")
    p.add_argument("--ignore-read-pair-suffixes", action="store_true")
    p.add_argument("--subset-reads", type=int, default=0)


def _alignment_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--in-format", choices=["sam", "bam", "cram"])
    p.add_argument("--in-sam", action="store_true")
    p.add_argument("--extract-umi-method", choices=["read_id", "tag", "umis"], default="read_id")
    p.add_argument("--umi-separator", default="_")
    p.add_argument("--umi-tag", default="RX")
    p.add_argument("--umi-tag-split")
    p.add_argument("--umi-tag-delimiter")
    p.add_argument("--cell-tag")
    p.add_argument("--cell-tag-split", default="-")
    p.add_argument("--cell-tag-delimiter")
    p.add_argument("--method", choices=METHODS, default="directional")
    p.add_argument("--edit-distance-threshold", type=int, default=1)
    p.add_argument("--spliced-is-unique", action="store_true")
    p.add_argument("--soft-clip-threshold", type=float, default=4)
    p.add_argument("--read-length", action="store_true")
    p.add_argument("--per-gene", action="store_true")
    p.add_argument("--gene-tag")
    p.add_argument("--assigned-status-tag")
    p.add_argument("--skip-tags-regex", default="^(__|Unassigned)")
    p.add_argument("--per-contig", action="store_true")
    p.add_argument("--gene-transcript-map")
    p.add_argument("--per-cell", action="store_true")
    p.add_argument("--multimapping-detection-method", choices=["NH", "X0", "XT"])
    p.add_argument("--mapping-quality", type=int, default=0)
    p.add_argument("--output-unmapped", action="store_true")
    p.add_argument("--unmapped-reads", choices=["discard", "use", "output"], default="discard")
    p.add_argument("--chimeric-pairs", choices=["discard", "use", "output"], default="use")
    p.add_argument("--unpaired-reads", choices=["discard", "use", "output"], default="use")
    p.add_argument("--ignore-umi", action="store_true")
    p.add_argument("--ignore-tlen", action="store_true")
    p.add_argument("--chrom")
    p.add_argument("--subset", type=float)
    p.add_argument("--paired", action="store_true")
    p.add_argument("--no-sort-output", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    made = {}
    for name in ("whitelist", "extract", "group", "dedup", "count", "count-tab", "prepare-for-em"):
        p = made[name] = commands.add_parser(name)
        p.add_argument("-I", "--stdin", required=True)
        p.add_argument("-S", "--stdout", required=True)
        p.add_argument("--compress", action="store_true")
        p.add_argument("--random-seed", type=int, default=0)
        p.add_argument("-L", "--log", help="folder for the counts of events")
    for name in ("whitelist", "extract"):
        _barcode_options(made[name])
    for name in ("group", "dedup", "count"):
        _alignment_options(made[name])
    w = made["whitelist"]
    w.add_argument("--method", choices=["reads", "umis"], default="reads")
    w.add_argument("--knee-method", choices=["distance", "density"], default="distance")
    w.add_argument("--expect-cells", type=int)
    w.add_argument("--set-cell-number", type=int)
    w.add_argument("--error-correct-threshold", type=int, default=1)
    w.add_argument("--ed-above-threshold", choices=["discard", "correct"])
    w.add_argument("--allow-threshold-error", action="store_true")
    w.add_argument("--plot-prefix")
    e = made["extract"]
    e.add_argument("--read2-out")
    e.add_argument("--retain-umi", action="store_true")
    e.add_argument("--quality-filter-threshold", type=int)
    e.add_argument("--quality-filter-mask", type=int)
    e.add_argument("--quality-encoding", choices=["phred33", "phred64", "solexa"], default="phred33")
    e.add_argument("--whitelist")
    e.add_argument("--blacklist")
    e.add_argument("--error-correct-cell", action="store_true")
    e.add_argument("--umi-whitelist")
    e.add_argument("--umi-whitelist-paired")
    e.add_argument("--correct-umi-threshold", type=int, default=0)
    e.add_argument("--reconcile-pairs", action="store_true")
    e.add_argument("--umi-separator", default="_")
    e.add_argument("--either-read", action="store_true")
    e.add_argument("--either-read-resolve", choices=["discard", "quality"], default="discard")
    made["group"].add_argument("--group-out")
    made["group"].add_argument("--umi-group-tag", default="BX")
    made["dedup"].add_argument("--output-stats")
    made["dedup"].add_argument("--umi-whitelist")
    made["count"].add_argument("--wide-format-cell-counts", action="store_true")
    t = made["count-tab"]
    t.add_argument("--per-cell", action="store_true")
    t.add_argument("--barcode-separator", default="_")
    t.add_argument("--method", choices=METHODS, default="directional")
    t.add_argument("--edit-distance-threshold", type=int, default=1)
    made["prepare-for-em"].add_argument("--tags", default="UG,BX")
    return top


def _raw_reads(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    one = Q.read_fastq(spark, a.stdin, a.ignore_read_pair_suffixes)
    if not a.read2_in:
        return one.select("ord", F.struct("identifier", "seq", "quals").alias("read1"))
    two = Q.read_fastq(spark, a.read2_in, a.ignore_read_pair_suffixes)
    if getattr(a, "reconcile_pairs", False):
        return Q.reconcile_pairs(one, two)
    return Q.join_pairs(one, two, check_names=a.command == "extract")


def _bundle_options(spark: SparkSession, a: argparse.Namespace) -> R.BundleOptions:
    transcripts = T.read_transcript_map(spark, a.gene_transcript_map) if a.gene_transcript_map else None
    return R.BundleOptions(
        extract_method={"umis": "labels"}.get(a.extract_umi_method, a.extract_umi_method), separator=a.umi_separator, umi_tag=a.umi_tag, cell_tag=a.cell_tag, umi_split=a.umi_tag_split,
        umi_delimiter=a.umi_tag_delimiter, cell_split=a.cell_tag_split, cell_delimiter=a.cell_tag_delimiter, per_cell=a.per_cell, ignore_umi=a.ignore_umi, per_gene=a.per_gene, per_contig=a.per_contig,
        gene_tag=a.gene_tag, assigned_tag=a.assigned_status_tag, skip_regex=a.skip_tags_regex, transcripts=transcripts, paired=a.paired, unpaired_reads=a.unpaired_reads, unmapped_reads=a.unmapped_reads,
        chimeric_pairs=a.chimeric_pairs, mapping_quality=a.mapping_quality, chrom=a.chrom, subset=a.subset, seed=a.random_seed, spliced=a.spliced_is_unique, soft_clip_threshold=a.soft_clip_threshold,
        read_length=a.read_length, ignore_tlen=a.ignore_tlen, detection_method=a.multimapping_detection_method,
    )


def _write_fastq(reads: DataFrame, side: str, path: str, compress: bool) -> None:
    text = Q.fastq_text(F.col(f"{side}.identifier"), F.col(f"{side}.seq"), F.col(f"{side}.quals"))
    T.write_lines(reads.select("ord", text.alias("value")), path, "ord", compress)


def _write_alignments(reads: DataFrame, a: argparse.Namespace) -> None:
    ordered = reads.orderBy("ord") if a.no_sort_output else M.sorted_alignments(reads)
    T.write_lines(A.sam_text(ordered).select("line"), a.stdout, None, a.compress)


def _whitelist(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = _raw_reads(spark, a)
    o = X.ExtractOptions(a.bc_pattern, a.bc_pattern2, a.extract_method, a.three_prime)
    codes = L.subset_matched(X.extract(reads, o), "kept", a.subset_reads, bool(a.read2_in))
    if a.filtered_out:
        _write_fastq(X.rejected(reads, codes), "read1", a.filtered_out, a.compress)
    histogram = L.cell_histogram(codes.where("kept"), a.method)
    if a.plot_prefix and a.set_cell_number is None:
        T.write_table(L.threshold_table(spark, histogram, a.knee_method, a.expect_cells), f"{a.plot_prefix}_cell_thresholds.tsv")
    cells = L.find_cells(histogram, a.knee_method, a.expect_cells, a.set_cell_number)
    if cells is None:
        if not a.allow_threshold_error or a.ed_above_threshold:
            raise ValueError("no local minimum was accepted; set the number of cells")
        cells = histogram.limit(0)
    fixes = L.near_whitelist(histogram, cells, a.error_correct_threshold) if a.error_correct_threshold > 0 else spark.createDataFrame([], "barcode string, error string")
    if a.ed_above_threshold:
        cells, more = L.errors_above(cells, a.error_correct_threshold, a.ed_above_threshold)
        fixes = fixes.unionByName(more)
    rows = L.whitelist_table(histogram, cells, fixes)
    T.write_lines(rows.select("barcode", F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")), a.stdout, "barcode", a.compress)


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = X.first_reads(_raw_reads(spark, a), a.subset_reads)
    o = X.ExtractOptions(
        a.bc_pattern, a.bc_pattern2, a.extract_method, a.three_prime, a.retain_umi, a.quality_encoding, a.quality_filter_threshold, a.quality_filter_mask, a.umi_separator, a.either_read, a.either_read_resolve
    )
    cells = umis = None
    if a.whitelist:
        listed = T.read_whitelist(spark, a.whitelist)
        black = T.read_barcode_list(spark, a.blacklist) if a.blacklist else None
        cells = X.Lookup("cell", listed, L.listed_errors(listed) if a.error_correct_cell else None, black)
    if a.umi_whitelist:
        listed = T.read_barcode_list(spark, a.umi_whitelist)
        if a.umi_whitelist_paired:
            listed = L.product_barcodes(listed, T.read_barcode_list(spark, a.umi_whitelist_paired))
        umis = X.Lookup("umi", listed, L.derive_errors(listed.select("barcode").distinct(), a.correct_umi_threshold) if a.correct_umi_threshold else None)
    out = X.extract(reads, o, cells, umis)
    _write_fastq(out.where("kept"), "read1", a.stdout, a.compress)
    if a.read2_out:
        _write_fastq(out.where("kept"), "read2", a.read2_out, a.compress)
    if a.filtered_out:
        _write_fastq(out.where("not kept"), "read1", a.filtered_out, a.compress)
    if a.log:
        T.write_table(X.read_events(out), a.log)


def _on_alignments(spark: SparkSession, a: argparse.Namespace) -> None:
    o = _bundle_options(spark, a)
    reads = A.read_alignments(spark, a.stdin, a.in_sam, a.in_format)
    if a.command == "count":
        counts = M.count_genes(reads, o, a.method, a.edit_distance_threshold)
        T.write_table(M.wide_counts(counts) if a.wide_format_cell_counts else counts, a.stdout, a.compress)
    elif a.command == "group":
        alignments, table = M.label(reads, o, a.method, a.edit_distance_threshold, a.umi_group_tag, a.output_unmapped)
        _write_alignments(alignments, a)
        if a.group_out:
            T.write_table(table, a.group_out)
    else:
        listed = T.read_barcode_list(spark, a.umi_whitelist).select(F.col("barcode").alias("umi")) if a.umi_whitelist else None
        _write_alignments(M.dedup(reads, o, a.method, a.edit_distance_threshold, umi_whitelist=listed, output_unmapped=a.output_unmapped).drop("umi", "group_n"), a)
        if a.output_stats:
            groups = cluster_umis(R.umi_counts(R.bundle_keys(R.triage(reads, o), o)), R.KEYS, a.method, a.edit_distance_threshold)
            pre, post = groups.select(*R.KEYS, "umi", "n"), S.kept_counts(groups, R.KEYS)
            by_umi = S.umi_histogram(reads, o)
            T.write_table(S.count_histogram(pre, post), f"{a.output_stats}_per_umi_per_position.tsv")
            T.write_table(S.per_umi(pre, post), f"{a.output_stats}_per_umi.tsv")
            sides = {"unique": pre, "unique_null": S.sampled_umis(pre, by_umi, R.KEYS, a.random_seed), a.method: post, f"{a.method}_null": S.sampled_umis(post, by_umi, R.KEYS, a.random_seed)}
            T.write_table(S.distance_bins({k: S.mean_distance(v, R.KEYS) for k, v in sides.items()}), f"{a.output_stats}_edit_distance.tsv")
    if a.log:
        T.write_table(R.event_counts(R.triage(reads, o)), a.log)


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    if a.command == "whitelist":
        _whitelist(spark, a)
    elif a.command == "extract":
        _extract(spark, a)
    elif a.command == "count-tab":
        rows = M.count_table(T.read_gene_table(spark, a.stdin), a.per_cell, a.method, a.edit_distance_threshold, a.barcode_separator)
        T.write_table(rows, a.stdout, a.compress)
    elif a.command == "prepare-for-em":
        pairs = J.prepare_pairs(A.read_alignments(spark, a.stdin), [t for t in a.tags.split(",") if t])
        placed = pairs.withColumn("ord", F.col("pair_ord") * 2 + F.col("side"))
        T.write_lines(A.sam_text(placed), a.stdout, "ord", a.compress)
    else:
        _on_alignments(spark, a)


def main() -> int:
    args = sys.argv[1:]
    parser().parse_args(args)
    spark = SparkSession.builder.appName("readweave").getOrCreate()
    try:
        run(spark, args)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
