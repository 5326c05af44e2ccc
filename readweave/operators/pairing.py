"""Pair alignments for expectation-maximisation tools: first and second reads of each template, next to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import positions as P


def templates(reads: DataFrame) -> DataFrame:
    """reads with template: consecutive reads of one name share it (as the least ord of the run)."""
    from .molecules import gene_runs

    runs = gene_runs(reads.withColumn("gene", F.col("qname"))).drop("gene")
    return runs.withColumnRenamed("run", "template")


def prepare_pairs(reads: DataFrame, tags: Sequence[str] = ("UG", "BX")) -> DataFrame:
    """The output alignments with pair_ord and side (1 or 2). Every read looks for its mate among the reads of the other
    side at its mate's place, first those whose secondary flag differs from what it looks for (as the lookup is
    defined), then the others; of several, the last that points back, else the first. A pair comes out once."""
    t = templates(reads).withColumn("is1", P.has(F.col("flag"), "read1")).withColumn("secondary", P.has(F.col("flag"), "secondary"))
    left, right = t.alias("r"), t.alias("m")
    r, m = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"m.{c}"))
    on = (r("template") == m("template")) & (r("is1") != m("is1")) & r("mate_rname").eqNullSafe(m("rname")) & r("mate_pos").eqNullSafe(m("pos"))
    back = m("mate_rname").eqNullSafe(r("rname")) & m("mate_pos").eqNullSafe(r("pos"))
    wanted = (r("secondary") == ~m("secondary")).cast("int")
    best = F.struct(wanted, back.cast("int"), F.when(back, m("ord")).otherwise(-m("ord")))
    found = left.join(right, on).withColumn("place", F.row_number().over(Window.partitionBy("r.ord").orderBy(best.desc()))).where("place = 1")
    found = found.where(r("is1") | P.has(r("flag"), "read2"))

    def side(x: str, other_secondary) -> F.Column:
        flag = F.when(other_secondary, F.col(f"{x}.flag").bitwiseOR(P.FLAGS["secondary"])).otherwise(F.col(f"{x}.flag"))
        return F.struct(*[(flag if c == "flag" else F.col(f"{x}.{c}")).alias(c) for c in reads.columns])

    pairs = found.select(r("ord").alias("by"), r("is1").alias("first"), side("r", F.lit(False)).alias("read"), side("m", r("secondary")).alias("mate"))
    pairs = pairs.select("by", F.when(F.col("first"), F.col("read")).otherwise(F.col("mate")).alias("one"), F.when(F.col("first"), F.col("mate")).otherwise(F.col("read")).alias("two"))
    copied = F.col("two.tags")
    for tag in tags:
        copied = P.copy_tag(copied, F.col("one.tags"), tag)
    pairs = pairs.withColumn("two", F.col("two").withField("tags", copied))
    key = [F.col("one.ord"), F.col("two.ord"), F.col("one.flag"), F.col("two.flag")]
    pairs = pairs.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct("by", "one", "two"), "by").alias("p"))
    both = pairs.select(F.col("p.by").alias("pair_ord"), F.posexplode(F.array("p.one", "p.two")).alias("i", "a"))
    return both.select("pair_ord", (F.col("i") + 1).alias("side"), "a.*")


def skipped(reads: DataFrame) -> DataFrame:
    """(reason, n) of reads that find no mate or are neither first nor second."""
    t = templates(reads).withColumn("is1", P.has(F.col("flag"), "read1"))
    other = t.select("template", (~F.col("is1")).alias("is1"), F.col("rname").alias("mate_rname"), F.col("pos").alias("mate_pos")).distinct()
    on = (t["template"] == other["template"]) & (t["is1"] == other["is1"]) & t["mate_rname"].eqNullSafe(other["mate_rname"]) & t["mate_pos"].eqNullSafe(other["mate_pos"])
    lone = t.join(other, on, "left_anti").select(F.lit("no mate").alias("reason"))
    neither = t.join(other, on, "left_semi").where(~F.col("is1") & ~P.has(F.col("flag"), "read2")).select(F.lit("not read1 or read2").alias("reason"))
    return lone.unionByName(neither).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
