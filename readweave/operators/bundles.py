"""Read triage and bundles.

Alignments: ord, qname, flag, rname, pos (0-based), mapq, cigar, mate_rname, mate_pos, tlen, seq, qual, tags (map) and
optionally kinds (map of tag types). One CASE decides each read, so survivors, passed-through reads and counters come
from one expression:
  events    all counters that the read adds to, in order
  bundled   it goes into a bundle
  single    it is passed through as it is
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import barcodes as B
from ..functions import positions as P


# The names of the counters of read triage.
EVENTS = {
    "input": "Input Reads",
    "pairs": "Read pairs",
    "unpaired": "Unpaired reads",
    "both_unmapped": "Both unmapped",
    "read1_unmapped": "Read 1 unmapped",
    "single_unmapped": "Single end unmapped",
    "read2_unmapped": "Read 2 unmapped",
    "chimeric": "Chimeric read pair",
    "excluded": "Randomly excluded",
    "low_mapq": "< MAPQ threshold",
    "no_barcode": "Read skipped, missing umi and/or cell tag",
    "no_tag": "Read skipped, no tag",
    "empty_gene": "Read skipped - gene string is empty",
    "skipped_gene": "Read skipped - assigned tag matches skip_regex",
}


@dataclass(frozen=True)
class BundleOptions:
    extract_method: str = "read_id"  # read_id, tag or labels
    separator: str = "_"
    umi_tag: str = "RX"
    cell_tag: str | None = None
    umi_split: str | None = None
    umi_delimiter: str | None = None
    cell_split: str | None = "-"
    cell_delimiter: str | None = None
    per_cell: bool = False
    ignore_umi: bool = False
    per_gene: bool = False
    per_contig: bool = False
    gene_tag: str | None = None
    assigned_tag: str | None = None
    skip_regex: str = "^(__|Unassigned)"
    transcripts: DataFrame | None = field(default=None, compare=False)  # (gene, gene_ord, transcript)
    paired: bool = False
    unpaired_reads: str = "use"  # use, discard or output
    unmapped_reads: str = "discard"  # use, discard or output
    chimeric_pairs: str = "use"  # use, discard or output
    mapping_quality: int = 0
    chrom: str | None = None
    subset: float | None = None
    seed: int = 0
    spliced: bool = False
    soft_clip_threshold: float = 4
    read_length: bool = False
    ignore_tlen: bool = False
    detection_method: str | None = None  # NH, X0 or XT

    def __post_init__(self):
        allowed = {"extract_method": ("read_id", "tag", "labels"), "unpaired_reads": ("use", "discard", "output"), "unmapped_reads": ("use", "discard", "output"), "chimeric_pairs": ("use", "discard", "output"), "detection_method": (None, "NH", "X0", "XT")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}")
        if self.per_gene and not (self.per_contig or self.gene_tag):
            raise ValueError("per_gene needs gene_tag or per_contig")
        if self.per_contig and self.gene_tag:
            raise ValueError("gene_tag and per_contig exclude each other")
        if self.transcripts is not None and not self.per_contig:
            raise ValueError("transcripts need per_contig")
        if self.per_cell and self.extract_method == "tag" and not self.cell_tag:
            raise ValueError("per_cell with tags needs cell_tag")

    def barcode(self) -> tuple[Column, Column]:
        """(cell, umi), null where a tag is missing."""
        if self.extract_method == "tag":
            return B.barcode_from_tags(F.col("tags"), self.umi_tag, self.cell_tag, self.per_cell, self.umi_split, self.umi_delimiter, self.cell_split, self.cell_delimiter)
        if self.extract_method == "labels":
            return B.barcode_from_labels(F.col("qname"), self.per_cell)
        return B.barcode_from_name(F.col("qname"), self.per_cell, self.separator)


KEYS = ("contig", "gene", "position", "is_reverse", "spliced", "tlen_key", "length_key", "cell")
POSITION_KEYS = ("contig", "position", "is_reverse", "spliced", "tlen_key", "length_key", "cell")


def triage(reads: DataFrame, o: BundleOptions, return_read2: bool = False, return_unmapped: bool = False) -> DataFrame:
    """reads with cell, umi, gene, events, bundled and single. Filters on the contig are pushed to the scan."""
    if o.chrom:
        reads = reads.where(F.col("rname") == o.chrom)
    if not return_unmapped:
        reads = reads.where(F.col("rname").isNotNull())
    if o.transcripts is not None:
        reads = with_transcripts(reads, o.transcripts)
    f = F.col("flag")
    yes, no = F.lit(True), F.lit(False)
    cell, umi = o.barcode()
    rules: list[tuple[Column, list, Column, Column]] = []  # condition, events, single, stop
    paired, unmapped, mate_un = P.has(f, "paired"), P.has(f, "unmapped"), P.has(f, "mate_unmapped")

    def rule(when: Column, event: str | None, single: Column | bool = False, stop: bool = False) -> None:
        rules.append((when, event, F.lit(single) if isinstance(single, bool) else single, stop))

    if o.paired:
        rule(paired, EVENTS["pairs"])
        rule(~paired, EVENTS["unpaired"], o.unpaired_reads == "output", o.unpaired_reads == "discard")
        rule(unmapped & mate_un, EVENTS["both_unmapped"])
        rule(unmapped & ~mate_un, EVENTS["read1_unmapped"])
    else:
        rule(unmapped, EVENTS["single_unmapped"])
    rule(unmapped, EVENTS["input"] if return_unmapped else None, return_unmapped, True)
    if o.paired:
        rule(mate_un, EVENTS["read2_unmapped"], o.unmapped_reads != "use" and return_unmapped, o.unmapped_reads != "use")
    rule(paired & ~F.col("rname").eqNullSafe(F.col("mate_rname")), EVENTS["chimeric"], o.chimeric_pairs == "output", o.chimeric_pairs != "use")
    if o.subset:
        share = F.pmod(F.xxhash64(F.lit(o.seed), F.col("ord")), F.lit(1 << 53)) / F.lit(float(1 << 53))
        rule(share >= o.subset, EVENTS["excluded"], stop=True)
    if o.mapping_quality:
        rule(F.col("mapq") < o.mapping_quality, EVENTS["low_mapq"], stop=True)
    missing = umi.isNull() | (cell.isNull() if o.per_cell else no)
    if o.ignore_umi:
        if o.per_cell:
            cell = F.when(missing, F.raise_error(F.lit("a read has no barcode tag")).cast("string")).otherwise(cell)
        umi = F.lit("")
    else:
        rule(missing, EVENTS["no_barcode"], stop=True)
    gene = F.lit(None).cast("string")
    if o.per_gene and o.per_contig:
        gene = F.col("bundle_gene") if o.transcripts is not None else F.col("rname")
    elif o.per_gene:
        gene = F.col("tags")[o.gene_tag]
        assigned = F.col("tags")[o.assigned_tag or o.gene_tag]
        rule(gene.isNull() | assigned.isNull(), EVENTS["no_tag"], stop=True)
        rule(gene == "", EVENTS["empty_gene"], stop=True)
        rule(assigned.rlike(o.skip_regex), EVENTS["skipped_gene"], stop=True)

    alive, events, single = ~P.has(f, "read2"), [], P.has(f, "read2") & F.lit(return_read2) & (~unmapped | F.lit(return_unmapped))
    events.append(F.when(alive, F.lit(EVENTS["input"])))
    for when, event, passed, stop in rules:
        hit = alive & F.coalesce(when, no)
        if event:
            events.append(F.when(hit, F.lit(event)))
        single = single | (hit & passed)
        if stop:
            alive = alive & ~F.coalesce(when, no)
    return reads.withColumns({"cell": cell, "umi": umi, "gene": gene, "events": F.array_compact(F.array(*events)), "bundled": alive & yes, "single": single})


def with_transcripts(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Reads once per gene that lists their contig, tagged MC; bundle_gene is the last gene that lists the contig."""
    last = transcripts.groupBy("transcript").agg(F.max_by("gene", "gene_ord").alias("bundle_gene"))
    pairs = transcripts.select("gene", "transcript").distinct().join(last, "transcript")
    out = reads.join(pairs.withColumnRenamed("gene", "mc"), reads["rname"] == F.col("transcript")).drop("transcript")
    return out.withColumn("tags", P.set_tag(F.col("tags"), "MC", F.col("mc"))).drop("mc")


def event_counts(triaged: DataFrame) -> DataFrame:
    """(event, n), most common first, ties first seen."""
    each = triaged.select("ord", F.posexplode("events").alias("i", "event"))
    return each.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "i")).alias("first")).orderBy(F.desc("n"), "first").drop("first")


def bundle_keys(triaged: DataFrame, o: BundleOptions) -> DataFrame:
    """The bundled reads with the key of their bundle: the gene on its contig, or the position."""
    kept = triaged.where("bundled").withColumn("contig", F.col("rname"))
    zero = F.lit(0).cast("long")
    null = F.lit(None).cast("long")
    if o.per_gene:
        contig = F.lit("") if o.transcripts is not None else F.col("rname")
        return kept.withColumns({"contig": contig, "position": null, "is_reverse": zero, "spliced": zero, "tlen_key": zero, "length_key": zero})
    at = P.read_position(F.col("pos"), F.col("cigar"), F.col("flag"), o.soft_clip_threshold)
    kept = kept.withColumn("at", at)
    return kept.withColumns(
        {
            "position": F.col("at.pos"),
            "is_reverse": P.has(F.col("flag"), "reverse").cast("long"),
            "spliced": F.col("at.is_spliced") if o.spliced else zero,
            "tlen_key": F.col("tlen").cast("long") if o.paired and not o.ignore_tlen else zero,
            "length_key": F.length("seq").cast("long") if o.read_length else zero,
        }
    ).drop("at")


def umi_counts(keyed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (bundle, umi): n reads, first seen at first_ord. Partial sums on the map side."""
    return keyed.groupBy(*keys, "umi").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def best_reads(keyed: DataFrame, o: BundleOptions, keys: Sequence[str] = KEYS, tie: str = "hash") -> DataFrame:
    """The best read of every (bundle, umi): highest mapq, then the fewest hits (NH, X0) or the first with XT = U, then
    the tie rule. tie `hash`: of equal reads the least seeded hash of ord stays, as likely for each. The first read of
    the highest mapq takes no part if another is equal to it; one that came with fewer hits than an earlier read of its
    mapq does. tie `ord`: the first seen. A tag is looked at only where a read has the highest mapq so far together with
    another (XT: until the first U); there it must be present."""
    group = Window.partitionBy(*keys, "umi")
    level = Window.partitionBy(*keys, "umi", "mapq")
    before = lambda w: w.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    method, top = o.detection_method, F.max("mapq").over(group)
    marked = keyed.withColumns({"top": F.col("mapq") == top, "first": F.col("ord") == F.min("ord").over(level)})
    score = F.lit(0).cast("long")
    if method:
        tag = F.col("tags")[method]
        unique = F.coalesce(tag == "U", F.lit(False))
        so_far = F.max("mapq").over(before(group))
        marked = marked.withColumn("contends", F.coalesce(F.col("mapq") >= so_far, F.lit(True)))
        asked = F.col("contends") & (F.sum(F.col("contends").cast("int")).over(level) > 1)
        if method == "XT":
            asked = asked & ~F.coalesce(F.max(unique & F.col("contends")).over(before(level)), F.lit(False))
            value = F.when(unique, F.col("ord")).otherwise(F.lit((1 << 63) - 1))
        else:
            value = F.coalesce(tag.cast("long"), F.lit((1 << 63) - 1))
        missing = F.raise_error(F.lit(f"tag {method} not present")).cast("long")
        marked = marked.withColumn("asked", asked).withColumn("score", F.when(F.col("asked") & tag.isNull(), missing).otherwise(value))
        score = F.col("score")
    last = [F.col("ord")] if tie == "ord" else [F.col("first").asc(), F.xxhash64(F.lit(o.seed), F.col("ord"))]
    place = F.row_number().over(group.orderBy(F.col("top").desc(), score.asc(), *last))
    return marked.withColumn("place", place).where("place = 1").select(*keyed.columns)


def detect_features(reads: DataFrame, tags: Sequence[str] = ("NH", "X0", "XT"), n: int = 1000) -> DataFrame:
    """(tag, present): whether every mapped one of the first n + 1 reads has the tag."""
    head = reads.orderBy("ord").limit(n + 1).where(~P.has(F.col("flag"), "unmapped"))
    wide = head.agg(*[F.coalesce(F.bool_and(F.map_contains_key("tags", t)), F.lit(False)).alias(t) for t in tags])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("present")) for t in tags])))
