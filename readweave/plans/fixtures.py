"""Sequencing reads derived from the events table by arithmetic that Spark and DuckDB share.

Each view is one SELECT over events; DIV stands for integer division. The same text feeds a DataFrame here and the WITH
clause of an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

QUALS = "".join(chr(40 + i) for i in range(36)) * 2
GENOME = "ACGTTGCAAGCTTACGGATCCATGCAATTGCCGTAGCTAACGTGGATCCTTAAGCATGCCGATTACGGCAT"


def digits(x: str, n: int) -> str:
    """The last n base-4 digits of x as bases."""
    return " || ".join(f"substr('ACGT', cast(1 + ({x}) DIV {4**i} % 4 as int), 1)" for i in range(n - 1, -1, -1))


H = "((event_id % 100) * (event_id % 100) * (event_id % 100) DIV 10000 + (user_id % 40) * 64) % 1024"

#: UMI reads: 5-base UMIs with many near ones, 40 places on every contig
READS = f"SELECT event_id AS ord, event_type AS contig, user_id % 40 AS pos, {digits(H, 5)} AS umi, {digits('user_id % 16', 2)} AS cell, 'G' || cast(user_id % 40 as varchar(9)) AS gene, cast(floor(value) as bigint) % 61 AS mapq, 1 + event_id % 3 AS nh FROM events"

#: single-end alignments
ALIGNMENTS = f"""SELECT ord, 'r' || cast(ord as varchar(20)) || '_' || cell || '_' || umi AS qname,
 cast(CASE WHEN ord % 97 = 0 THEN 4 WHEN ord % 89 = 0 THEN 4 WHEN ord % 7 = 0 THEN 128 WHEN ord % 3 = 0 THEN 16 ELSE 0 END as int) AS flag,
 CASE WHEN ord % 97 = 0 THEN NULL ELSE contig END AS rname, pos * 10 AS pos, cast(mapq as int) AS mapq,
 CASE ord % 5 WHEN 0 THEN '50M' WHEN 1 THEN '5S45M' WHEN 2 THEN '45M5S' WHEN 3 THEN '20M100N30M' ELSE '10M5I35M' END AS cigar,
 CASE WHEN ord % 97 = 0 THEN NULL ELSE contig END AS mate_rname, pos * 10 + 100 AS mate_pos, 150 + ord % 3 * 10 AS tlen,
 substr('{GENOME}', cast(1 + ord % 20 as int), cast(45 + ord % 5 as int)) AS seq, cast(NULL as varchar(9)) AS qual,
 umi AS t_rx, cell || '-1' AS t_cb, CASE WHEN ord % 31 = 0 THEN NULL WHEN ord % 37 = 0 THEN '' WHEN ord % 41 = 0 THEN 'Unassigned' ELSE gene END AS t_xf,
 cast(nh as varchar(9)) AS t_nh, CASE WHEN ord % 3 = 0 THEN 'U' ELSE 'R' END AS t_xt FROM reads"""

#: paired alignments: records 2k and 2k + 1 are the mates of a pair
PAIRED = """SELECT ord, 'p' || cast(ord DIV 2 as varchar(20)) || '_' || umi AS qname,
 cast(CASE WHEN ord % 52 = 0 THEN 0 WHEN ord % 34 = 0 THEN 73 WHEN ord % 46 = 0 THEN 69 WHEN ord % 46 = 1 THEN 133 WHEN ord % 38 IN (0, 1) THEN 65 + 64 * (ord % 2) + 256 ELSE 65 + 64 * (ord % 2) END as int) AS flag,
 contig AS rname, pos * 10 + 100 * (ord % 2) AS pos, mapq, '50M' AS cigar, CASE WHEN ord % 58 = 0 THEN 'other' ELSE contig END AS mate_rname,
 pos * 10 + 100 * (1 - ord % 2) AS mate_pos, 150 + ord DIV 2 % 3 * 10 AS tlen, t_rx, t_nh
 FROM (SELECT a.ord, b.contig, b.pos, a.umi, cast(a.mapq as int) AS mapq, a.umi AS t_rx, cast(a.nh as varchar(9)) AS t_nh, a.ord DIV 2 AS half
       FROM reads a JOIN reads b ON b.ord = a.ord - a.ord % 2) x"""

#: raw reads: 2 bases of cell, 5 of UMI, then the insert
FASTQ = f"""SELECT ord, 'read' || cast(ord as varchar(20)) || ' lane' || cast(ord % 4 as varchar(9)) AS identifier,
 cell || umi || substr('{GENOME}', cast(1 + ord % 30 as int), 33) AS seq, substr('{QUALS}', cast(1 + ord * 7 % 32 as int), 40) AS quals FROM reads"""

VIEWS = {"reads": READS, "alignments": ALIGNMENTS, "paired": PAIRED, "fastq": FASTQ}
NEEDS = {"reads": (), "alignments": ("reads",), "paired": ("reads",), "fastq": ("reads",)}


def duck(view: str) -> str:
    """The view as members of a WITH clause."""
    parts = [*NEEDS[view], view]
    return ",\n".join(f"{v} AS ({VIEWS[v].replace('DIV', '//')})" for v in parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; alignments and paired have their tags in a map."""
    ctes = ", ".join(f"{v} AS ({VIEWS[v].replace('DIV', 'div').replace('varchar(9)', 'string').replace('varchar(20)', 'string')})" for v in [*NEEDS[name], name])
    df = spark.sql(f"WITH {ctes.replace('FROM events', 'FROM {events}')} SELECT * FROM {name}", events=table(spark, sf_dir, "events"))
    named = [c for c in df.columns if c.startswith("t_")]
    if named:
        entries = F.map_filter(F.create_map(*[x for c in named for x in (F.lit(c[2:].upper()), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
        df = df.withColumn("tags", entries).drop(*named)
    return df
