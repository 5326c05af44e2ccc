"""Barcodes from raw reads: extraction by pattern, quality and whitelist filters, new read names.

Input: (ord, read1) or (ord, read1, read2) with reads struct<identifier, seq, quals>. Output: the same columns, changed,
with cell, umi, umi_quals, events (all counters a read adds to, in order) and kept; rows that are not kept still hold
the original reads, so rejected reads are the complement of the same frame.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import barcodes as B
from ..functions import fuzzy as Z


# The names of the counters of barcode extraction.
EVENTS = {
    "input": "Input Reads",
    "output": "Reads output",
    "no_match1": "regex does not match read1",
    "match1": "regex matches read1",
    "no_match2": "regex does not match read2",
    "match2": "regex matches read2",
    "both_discarded": "regex matches both. discarded",
    "both_read1": "regex matches both. read1 used",
    "both_read2": "regex matches both. read2 used",
    "only_read1": "regex only matches read1",
    "only_read2": "regex only matches read2",
    "low_quality": "filtered: umi quality",
    "masked": "UMI masked",
    "black": "Cell barcode in blacklist",
    "cell_corrected": "False cell barcode. Error-corrected",
    "cell_unknown": "Filtered cell barcode. Not correctable",
    "cell_filtered": "Filtered cell barcode",
    "corrected_to_black": "Cell barcode corrected to barcode blacklist",
    "umi_corrected": "False UMI barcode. Error-corrected",
    "umi_ambiguous": "False UMI barcode. Not correctable - within threshold to more than one whitelisted UMI",
    "umi_unknown": "False UMI barcode. Not correctable - not within threshold to whitelisted UMI",
    "umi_filtered": "Filtered umi barcode",
}


@dataclass(frozen=True)
class ExtractOptions:
    pattern: str | None = None
    pattern2: str | None = None
    method: str = "string"  # string or regex
    three_prime: bool = False
    retain_umi: bool = False
    quality_encoding: str = "phred33"
    quality_filter_threshold: int | None = None
    quality_filter_mask: int | None = None
    separator: str = "_"
    either_read: bool = False
    either_read_resolve: str = "discard"  # discard or quality

    def __post_init__(self):
        if not self.separator:
            raise ValueError("the separator must not be empty")
        if self.method not in ("string", "regex"):
            raise ValueError("method must be string or regex")
        if not (self.pattern or self.pattern2):
            raise ValueError("a pattern is needed")
        for p in (self.pattern, self.pattern2):
            if p and self.method == "string" and not re.fullmatch("[NXC]*", p):
                raise ValueError(f"a barcode pattern holds only N, X and C: {p}")
            if p and self.method == "regex":
                Z.check_pattern(p)
        if self.either_read and (self.method != "regex" or self.either_read_resolve not in ("discard", "quality")):
            raise ValueError("either_read needs regex patterns and resolves by discard or quality")


def add_to_name(identifier: Column, umi: Column, cell: Column, separator: str) -> Column:
    """The identifier with the barcodes after its first token."""
    sep = F.lit(separator)
    code = F.when(F.coalesce(cell, F.lit("")) == "", F.concat(sep, umi)).otherwise(F.concat(sep, cell, sep, umi))
    at = F.instr(identifier, " ")
    first = F.when(at > 0, F.substr(identifier, F.lit(1), at - 1)).otherwise(identifier)
    return F.concat(first, code, F.when(at > 0, F.substr(identifier, at)).otherwise(F.lit("")))


def _picked(text: Column, at: Sequence[int]) -> Column:
    return F.concat(*[F.substring(text, i + 1, 1) for i in at]) if at else F.lit("")


def by_letters(read: Column, pattern: str, three_prime: bool) -> dict[str, Column]:
    """N is UMI, C is cell, X goes back to the read. A read shorter than the pattern is an error."""
    n = len(pattern)
    seq, quals = read["seq"], read["quals"]
    short = F.raise_error(F.concat(F.lit("read is shorter than the pattern: "), seq)).cast("string")
    seq = F.when(F.length(seq) < n, short).otherwise(seq)
    if three_prime and n:
        cut = lambda t: (F.right(t, F.lit(n)), F.substr(t, F.lit(1), F.greatest(F.length(t) - n, F.lit(0))))
    elif three_prime:
        cut = lambda t: (t, F.lit(""))
    else:
        cut = lambda t: (F.substring(t, 1, n), F.substr(t, F.lit(n + 1)))
    (code, rest), (code_q, rest_q) = cut(seq), cut(quals)
    umi, cell, back = ([i for i, c in enumerate(pattern) if c == k] for k in "NCX")
    joined = lambda a, b: F.concat(b, a) if three_prime else F.concat(a, b)
    return {
        "umi": _picked(code, umi),
        "cell": _picked(code, cell),
        "umi_quals": _picked(code_q, umi),
        "seq": joined(_picked(code, back), rest),
        "quals": joined(_picked(code_q, back), rest_q),
    }


def by_groups(read: Column, found: Column, retain_umi: bool) -> dict[str, Column]:
    """umi_, cell_ and discard_ groups, joined in the order of their names; what is in none stays in the read."""
    umi, cell = Z.groups_of(found, "umi_"), Z.groups_of(found, "cell_")
    drop = F.filter(F.map_values(F.map_filter(found, lambda k, _: k.startswith("discard_"))), lambda s: s["start"] >= 0)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), "")
    n = F.least(F.length(read["seq"]), F.length(read["quals"]))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    within = lambda spans, i: F.exists(spans, lambda s: (i >= s["start"]) & (i < s["stop"]))
    out = lambda i: within(drop, i) | within(cell, i)
    stays = F.filter(places, lambda i: ~out(i) if retain_umi else ~(out(i) | within(umi, i)))
    code = F.filter(places, lambda i: ~out(i) if retain_umi else ~out(i) & within(umi, i))
    at = lambda text, idx: F.array_join(F.transform(idx, lambda i: F.substr(text, i + 1, F.lit(1))), "")
    return {"umi": joined(umi), "cell": joined(cell), "umi_quals": at(read["quals"], code), "seq": at(read["seq"], stays), "quals": at(read["quals"], stays)}


def _events(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(e)) for c, e in pairs]))


def extract(reads: DataFrame, o: ExtractOptions, cells: "Lookup | None" = None, umis: "Lookup | None" = None) -> DataFrame:
    """Extract, filter and rename; see above. cells and umis are whitelists with corrections (see Lookup)."""
    paired = "read2" in reads.columns
    r1, r2 = F.col("read1"), F.col("read2")
    none = F.lit(None).cast("string")
    fields = ("umi", "cell", "umi_quals", "seq", "quals")
    if o.method == "string":
        got1 = by_letters(r1, o.pattern, o.three_prime) if o.pattern else None
        got2 = by_letters(r2, o.pattern2, o.three_prime) if o.pattern2 and paired else None
        frame = reads.withColumn("ok", F.lit(not o.pattern2 or paired))
        frame = frame.withColumn("events", _events((F.lit(True), EVENTS["input"])))
        frame = frame.withColumn("m1", F.struct(*[(got1[k] if got1 else none).alias(k) for k in fields]))
        frame = frame.withColumn("m2", F.struct(*[(got2[k] if got2 else none).alias(k) for k in fields]))
        both = {k: F.concat(*[F.coalesce(F.col(f"{m}.{k}"), F.lit("")) for m in ("m1", "m2")]) for k in ("umi", "cell", "umi_quals")}
        changed1, changed2 = F.lit(bool(o.pattern)), F.lit(bool(o.pattern2))
    else:
        frame = reads
        frame = frame.withColumn("f1", Z.match(F.col("read1.seq"), o.pattern) if o.pattern else F.lit(None).cast(Z.MATCH))
        frame = frame.withColumn("f2", Z.match(F.col("read2.seq"), o.pattern2) if o.pattern2 and paired else F.lit(None).cast(Z.MATCH))
        frame = frame.withColumn("m1", F.when(F.col("f1").isNotNull(), F.struct(*[v.alias(k) for k, v in by_groups(r1, F.col("f1"), o.retain_umi).items()])))
        second = by_groups(r2, F.col("f2"), o.retain_umi) if paired else dict.fromkeys(fields, none)
        frame = frame.withColumn("m2", F.when(F.col("f2").isNotNull(), F.struct(*[v.alias(k) for k, v in second.items()])))
        has1, has2 = F.col("f1").isNotNull(), F.col("f2").isNotNull()
        use1, use2 = F.lit(bool(o.pattern)), F.lit(bool(o.pattern2) and paired)
        go_on = has1 | ~use1 | F.lit(o.either_read)
        tried = [(F.lit(True), EVENTS["input"]), (use1 & ~has1, EVENTS["no_match1"]), (use1 & has1, EVENTS["match1"])]
        tried += [(use2 & go_on & ~has2, EVENTS["no_match2"]), (use2 & go_on & has2, EVENTS["match2"])]
        if o.either_read:
            quals = lambda m: F.array_min(B.qualities(F.col(f"{m}.umi_quals"), o.quality_encoding))
            one = has1 & has2
            first = F.coalesce(quals("m1") >= quals("m2"), F.lit(True)) if o.either_read_resolve == "quality" else F.lit(True)
            pick1 = (has1 & ~has2) | (one & first)
            if o.either_read_resolve == "discard":
                tried.append((one, EVENTS["both_discarded"]))
                ok = has1 != has2
            else:
                tried += [(one & first, EVENTS["both_read1"]), (one & ~first, EVENTS["both_read2"])]
                ok = has1 | has2
            tried += [(has1 & ~has2, EVENTS["only_read1"]), (has2 & ~has1, EVENTS["only_read2"])]
            both = {k: F.when(pick1, F.col(f"m1.{k}")).otherwise(F.col(f"m2.{k}")) for k in ("umi", "cell", "umi_quals")}
            # the read keeps its bases if the other read matched as well
            changed1, changed2 = has1 & ~has2, has2 & ~has1
        else:
            ok = (has1 | ~use1) & (has2 | ~use2)
            both = {k: F.concat(*[F.coalesce(F.col(f"{m}.{k}"), F.lit("")) for m in ("m1", "m2")]) for k in ("umi", "cell", "umi_quals")}
            changed1, changed2 = use1, use2
        frame = frame.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("events", _events(*tried))
    frame = frame.withColumns(both)
    more = lambda f, when, event: f.withColumn("events", F.when(when, F.array_append("events", F.lit(event))).otherwise(F.col("events")))
    if o.quality_filter_threshold is not None:
        low = F.col("ok") & B.any_below(F.col("umi_quals"), o.quality_encoding, o.quality_filter_threshold)
        frame = more(frame.withColumn("low", low), F.col("low"), EVENTS["low_quality"]).withColumn("ok", F.col("ok") & ~F.col("low")).drop("low")
    if o.quality_filter_mask is not None:
        frame = frame.withColumn("masked", B.mask_low(F.col("umi"), F.col("umi_quals"), o.quality_encoding, o.quality_filter_mask))
        frame = more(frame, F.col("ok") & (F.col("masked") != F.col("umi")), EVENTS["masked"]).withColumn("umi", F.col("masked")).drop("masked")
    if umis is not None:
        frame = umis.apply(frame, "umi")
    if cells is not None:
        frame = cells.apply(frame, "cell")
    frame = more(frame, F.col("ok"), EVENTS["output"])
    named = lambda r: add_to_name(r["identifier"], F.col("umi"), F.col("cell"), o.separator)

    def renamed(r: Column, m: str, changed: Column, name: Column) -> Column:
        seq, quals = (F.when(changed, F.col(f"{m}.{k}")).otherwise(r[k]) for k in ("seq", "quals"))
        return F.when(F.col("ok"), F.struct(name.alias("identifier"), seq.alias("seq"), quals.alias("quals"))).otherwise(r)

    out = {"read1": renamed(r1, "m1", changed1, named(r1))}
    if paired:
        # with either_read, both reads get the first one's name
        out["read2"] = renamed(r2, "m2", changed2, named(r1) if o.either_read else named(r2))
    frame = frame.withColumns(out).withColumnRenamed("ok", "kept")
    return frame.select(*reads.columns, "cell", "umi", "umi_quals", "events", "kept")


class Lookup:
    """A whitelist (barcode), corrections (error, barcode; a null barcode marks an error of several) and a blacklist
    (barcode). Each is broadcast up to `most` rows and joined by key beyond."""

    def __init__(self, kind: str, whitelist: DataFrame, corrections: DataFrame | None = None, blacklist: DataFrame | None = None, most: int = 1_000_000):
        self.kind, self.most = kind, most
        self.whitelist, self.corrections, self.blacklist = whitelist, corrections, blacklist

    def _join(self, frame: DataFrame, side: DataFrame, on: str) -> DataFrame:
        small = side.limit(self.most + 1).count() <= self.most
        return frame.join(F.broadcast(side) if small else side, on, "left")

    def _mark(self, frame: DataFrame, column: str, table: DataFrame | None, name: str) -> DataFrame:
        if table is None:
            return frame.withColumn(name, F.lit(False))
        side = table.select(F.col("barcode").alias(column)).distinct().withColumn(name, F.lit(True))
        return self._join(frame, side, column).withColumn(name, F.coalesce(name, F.lit(False)))

    def apply(self, frame: DataFrame, column: str) -> DataFrame:
        frame = self._mark(frame, column, self.whitelist, "known")
        frame = self._mark(frame, column, self.blacklist, "black")
        if self.corrections is not None:
            side = self.corrections.select(F.col("error").alias(column), F.col("barcode").alias("true"), F.lit(True).alias("listed"))
            frame = self._join(frame, side, column).withColumn("listed", F.coalesce("listed", F.lit(False)))
        else:
            frame = frame.withColumn("true", F.lit(None).cast("string")).withColumn("listed", F.lit(False))
        known, black, listed, true = (F.col(c) for c in ("known", "black", "listed", "true"))
        some = F.lit(self.corrections is not None)
        if self.kind == "cell":
            event = F.when(black, EVENTS["black"]).when(known, F.lit(None)).when(listed, EVENTS["cell_corrected"]).when(some, EVENTS["cell_unknown"]).otherwise(EVENTS["cell_filtered"])
            stays = ~black & (known | listed)
        else:
            event = F.when(known, F.lit(None)).when(true.isNotNull(), EVENTS["umi_corrected"]).when(listed, EVENTS["umi_ambiguous"])
            event = event.when(some, EVENTS["umi_unknown"]).otherwise(EVENTS["umi_filtered"])
            stays = known | true.isNotNull()
        frame = frame.withColumn("note", F.when(F.col("ok"), event)).withColumn("ok", F.col("ok") & stays)
        frame = frame.withColumn("events", F.when(F.col("note").isNotNull(), F.array_append("events", F.col("note"))).otherwise(F.col("events")))
        frame = frame.withColumn(column, F.when(known | true.isNull(), F.col(column)).otherwise(true)).drop("known", "black", "true", "listed", "note")
        if self.kind == "cell" and self.blacklist is not None:
            frame = self._mark(frame, column, self.blacklist, "black")
            frame = frame.withColumn("events", F.when(F.col("ok") & F.col("black"), F.array_append("events", F.lit(EVENTS["corrected_to_black"]))).otherwise(F.col("events")))
            frame = frame.withColumn("ok", F.col("ok") & ~F.col("black")).drop("black")
        return frame


def read_events(extracted: DataFrame) -> DataFrame:
    """(event, n), most common first, ties first seen."""
    each = extracted.select("ord", F.posexplode("events").alias("i", "event"))
    return each.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "i")).alias("first")).orderBy(F.desc("n"), "first").drop("first")


def correction_log(original_umi: DataFrame) -> DataFrame:
    """(umi, count_no_errors, count_errors) from (raw, umi): how often a whitelisted UMI was read right or corrected."""
    right = F.col("raw") == F.col("umi")
    return original_umi.groupBy("umi").agg(F.sum(right.cast("long")).alias("count_no_errors"), F.sum((~right).cast("long")).alias("count_errors"))


def rejected(original: DataFrame, extracted: DataFrame) -> DataFrame:
    """The original reads that were not kept."""
    return original.join(extracted.where(~F.col("kept")).select("ord"), "ord", "left_semi")


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first n input reads; 0 means all."""
    return reads.where(F.col("ord") < n) if n else reads
