"""FASTQ reads: (ord, identifier, seq, quals). ord is the place in the file; it orders everything downstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import numbered_lines


def read_fastq(spark: SparkSession, path: str, ignore_suffix: bool = False) -> DataFrame:
    """Reads of a plain or compressed file. A blank first line of a record ends the input; a record that does not begin
    with @, has no + line or no qualities raises an error."""
    lines = numbered_lines(spark, path)
    parts = lines.select(F.expr("line_no div 4").alias("ord"), (F.col("line_no") % 4).alias("i"), "line")
    wide = parts.groupBy("ord").agg(*[F.max(F.when(F.col("i") == i, F.col("line"))).alias(f"l{i}") for i in range(4)])
    end = wide.where(F.trim(F.coalesce("l0", F.lit(""))) == "").agg(F.min("ord").alias("end"))
    wide = wide.crossJoin(F.broadcast(end)).where("end is null or ord < end")
    bad = lambda what: F.raise_error(F.concat(F.lit(f"{what} in FASTQ record "), F.col("ord").cast("string"))).cast("string")
    head = F.trim("l0")
    identifier = F.when(~head.startswith("@"), bad("no @")).when(~F.coalesce("l2", F.lit("")).startswith("+"), bad("no +")).when(F.coalesce(F.rtrim("l3"), F.lit("")) == "", bad("no qualities"))
    identifier = identifier.otherwise(F.substr(head, F.lit(2)))
    reads = wide.select("ord", identifier.alias("identifier"), F.rtrim("l1").alias("seq"), F.rtrim("l3").alias("quals"))
    return reads.withColumn("identifier", strip_pair_suffix(F.col("identifier"))) if ignore_suffix else reads


def strip_pair_suffix(identifier: Column) -> Column:
    """The identifier without /1 or /2 at the end of its first token; it is an error if there is none."""
    bad = F.raise_error(F.concat(F.lit("no /1 or /2 in read name: "), identifier)).cast("string")
    return F.when(identifier.rlike(r"^[^ ]*/[12]( |$)"), F.regexp_replace(identifier, r"^([^ ]*)/[12]( |$)", "$1$2")).otherwise(bad)


def first_token(identifier: Column) -> Column:
    return F.element_at(F.split(identifier, " "), 1)


def join_pairs(read1: DataFrame, read2: DataFrame, check_names: bool = True) -> DataFrame:
    """(ord, read1, read2) of records at the same place; with check_names, names must agree and read2 must not end
    first."""
    a = read1.select("ord", F.struct("identifier", "seq", "quals").alias("read1"))
    b = read2.select("ord", F.struct("identifier", "seq", "quals").alias("read2"))
    if not check_names:
        return a.join(b, "ord")
    both = a.join(b, "ord", "left")
    short = F.raise_error(F.lit("read2 ends before read1")).cast("boolean")
    differ = F.raise_error(F.concat(F.lit("read names differ: "), F.col("read1.identifier"), F.lit(" and "), F.col("read2.identifier"))).cast("boolean")
    fine = F.when(F.col("read2").isNull(), short).when(first_token(F.col("read1.identifier")) != first_token(F.col("read2.identifier")), differ).otherwise(F.lit(True))
    return both.where(fine)


def reconcile_pairs(read1: DataFrame, read2: DataFrame) -> DataFrame:
    """(ord, read1, read2) where read2 may hold records that read1 lacks: each read1 takes the record of its name."""
    a = read1.select("ord", first_token(F.col("identifier")).alias("name"), F.struct("identifier", "seq", "quals").alias("read1"))
    b = read2.groupBy(first_token(F.col("identifier")).alias("name")).agg(F.min_by(F.struct("identifier", "seq", "quals"), "ord").alias("read2"))
    return a.join(b, "name").drop("name")


def fastq_text(identifier: Column, seq: Column, quals: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), identifier), seq, F.lit("+"), quals)
