"""Lines and delimited tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files, from 0, one file after the other in the order of their paths. The parts in which
    Spark reads the files are counted first, and each adds the lines before it. Files that end in .gz are read by Spark;
    other gzip endings (.z) by their content."""
    if path.lower().endswith(".z"):
        import gzip

        raw = spark.read.format("binaryFile").load(path)
        unzip = F.udf(lambda b: gzip.decompress(bytes(b)).decode("utf-8"), T.StringType())
        rows = raw.select(F.posexplode(F.split(F.regexp_replace(unzip("content"), "\n$", ""), "\n")).alias("line_no", "line"))
        return rows.select(F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))
    value = F.regexp_replace("value", "\r$", "").alias("line")
    source = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # the id holds the partition in its upper bits and the place in it in the lower 33. A partition may hold parts of
    # several files, but each part is read in one piece, so a line's place in its part is its id less the part's first
    marked = spark.read.text(path).select(value, source.alias("part"), F.monotonically_increasing_id().alias("id"))
    sizes = marked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect()  # one row per part of a file
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.part.file, r.part.start)):
        before.append((r.part, total - r.first))
        total += r.n
    if len(before) <= 1:
        return marked.select("id", "line").withColumnRenamed("id", "line_no").withColumn("line_no", F.col("line_no") + F.lit(before[0][1] if before else 0))
    base = spark.createDataFrame(before, "part struct<file:string, start:long>, base long")
    return marked.join(F.broadcast(base), "part").select((F.col("base") + F.col("id")).alias("line_no"), "line")


def read_barcode_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, barcode): the first field of every line that is no comment."""
    lines = numbered_lines(spark, path).where(~F.col("line").startswith("#"))
    return lines.select(F.col("line_no").alias("ord"), F.rtrim(F.element_at(F.split("line", "\t"), 1)).alias("barcode"))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(ord, barcode, errors): a whitelist table; errors is the comma list of its second field, null without one."""
    lines = numbered_lines(spark, path).where(~F.col("line").startswith("#"))
    fields = F.split(F.rtrim("line"), "\t")
    return lines.select(F.col("line_no").alias("ord"), F.element_at(fields, 1).alias("barcode"), F.try_element_at(fields, F.lit(2)).alias("errors"))


def read_gene_table(spark: SparkSession, path: str) -> DataFrame:
    """(ord, read_id, gene) of a table of exactly two fields."""
    fields = F.split("line", "\t")
    bad = F.raise_error(F.concat(F.lit("a line must have two fields: "), F.col("line"))).cast("string")
    return numbered_lines(spark, path).select(F.col("line_no").alias("ord"), F.when(F.size(fields) != 2, bad).otherwise(fields[0]).alias("read_id"), F.get(fields, F.lit(1)).alias("gene"))


def read_transcript_map(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """(gene, gene_ord, transcript): # lines are left out, a blank line ends the map, only known contigs stay."""
    lines = numbered_lines(spark, path)
    end = lines.where(F.trim("line") == "").agg(F.min("line_no").alias("end"))
    lines = lines.crossJoin(F.broadcast(end)).where("(end is null or line_no < end) and not startswith(line, '#')")
    fields = F.split(F.rtrim("line"), "\t")
    bad = F.raise_error(F.concat(F.lit("a line must have two fields: "), F.col("line"))).cast("string")
    pairs = lines.select("line_no", F.when(F.size(fields) != 2, bad).otherwise(fields[0]).alias("gene"), F.get(fields, F.lit(1)).alias("transcript"))
    if contigs is not None:
        pairs = pairs.join(contigs.select(F.col("contig").alias("transcript")).distinct(), "transcript", "left_semi")
    first = pairs.groupBy("gene").agg(F.min("line_no").alias("gene_ord"))
    return pairs.join(first, "gene").select("gene", "gene_ord", "transcript")


def write_lines(lines: DataFrame, path: str, ordered_by: str | None = None, compressed: bool = False) -> None:
    """One text column as files under path; ordered_by range-sorts, so the parts in order are the whole."""
    if ordered_by:
        lines = lines.orderBy(ordered_by).drop(ordered_by)
    lines.write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(path)


def write_table(df: DataFrame, path: str, compressed: bool = False) -> None:
    """A tab-separated table with a header."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", compression="gzip" if compressed else "none")
