"""SAM text and BAM. Alignments come out as described in operators/bundles.py, with tid and kinds (types of the tags).

BAM files are decoded in Python behind a data source: a BAM file is a series of independently compressed blocks, but
records run across them, so one file is one partition; many files are many. CRAM is refused.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import positions as P
from .text import numbered_lines

SCHEMA = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("rname", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("mate_rname", T.StringType()),
        T.StructField("mate_pos", T.LongType()),
        T.StructField("tlen", T.LongType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("kinds", T.MapType(T.StringType(), T.StringType())),
    ]
)
# The end block of a BAM file, CIGAR letters, bases by code, and sizes of numeric tag types.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
CIGAR_LETTERS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}


def alignment_format(path: str, sam: bool = False, explicit: str | None = None) -> str:
    """The format: the flag, then the explicit name, then the file's ending, else bam."""
    if sam:
        return "sam"
    if explicit:
        return explicit.lower()
    end = path.lower().rsplit(".", 1)[-1]
    return end if end in ("sam", "bam", "cram") else "bam"


def read_alignments(spark: SparkSession, path: str, sam: bool = False, explicit: str | None = None, contig: str | None = None) -> DataFrame:
    kind = alignment_format(path, sam, explicit)
    if kind == "cram":
        raise ValueError("CRAM needs a reference-based decoder and is not supported")
    reads = read_sam(spark, path) if kind == "sam" else read_bam(spark, path)
    return reads.where(F.col("rname") == contig) if contig else reads


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    f = F.split("line", "\t")
    star = lambda c: F.when(c != "*", c)
    fields = F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.split(x, ":", 3))
    pairs = lambda i: F.map_from_entries(F.transform(fields, lambda x: F.struct(x[0], x[i])))
    mate = F.when(f[6] == "=", star(f[2])).otherwise(star(f[6]))
    return lines.where(~F.col("line").startswith("@")).select(
        F.col("line_no").alias("ord"),
        f[0].alias("qname"),
        f[1].try_cast("int").alias("flag"),
        star(f[2]).alias("rname"),
        (f[3].try_cast("long") - 1).alias("pos"),
        f[4].try_cast("int").alias("mapq"),
        star(f[5]).alias("cigar"),
        mate.alias("mate_rname"),
        (f[7].try_cast("long") - 1).alias("mate_pos"),
        f[8].try_cast("long").alias("tlen"),
        star(f[9]).alias("seq"),
        star(f[10]).alias("qual"),
        pairs(2).alias("tags"),
        pairs(1).alias("kinds"),
    )


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(tid, contig, length) of a SAM header; at least one contig must be there."""
    heads = numbered_lines(spark, path).where(F.col("line").startswith("@SQ"))
    field = lambda tag: F.regexp_extract("line", rf"\t{tag}:([^\t]+)", 1)
    return heads.select(F.col("line_no").alias("tid"), field("SN").alias("contig"), field("LN").cast("long").alias("length"))


def parse_tags(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    tags, kinds, at = {}, {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in NUMBERS:
            (value,) = struct.unpack_from("<" + NUMBERS[kind], data, at)
            at += struct.calcsize(NUMBERS[kind])
            text, kind = (str(value), "i") if kind not in "fd" else (f"{value:g}", "f")
        elif kind == "A":
            text, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            text, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub = chr(data[at])
            (n,) = struct.unpack_from("<I", data, at + 1)
            values = struct.unpack_from(f"<{n}{NUMBERS[sub]}", data, at + 5)
            text, at = ",".join([sub, *map(str, values)]), at + 5 + n * struct.calcsize(NUMBERS[sub])
        else:
            raise ValueError(f"unknown tag type: {kind}")
        tags[name], kinds[name] = text, kind
    return tags, kinds


def bam_records(data: bytes) -> Iterator[tuple]:
    """The alignments of a whole BAM file."""
    if not data.endswith(BGZF_END):
        raise ValueError("the BAM file has no end block: it is cut off")
    raw = gzip.decompress(data)
    if raw[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    (at,) = struct.unpack_from("<i", raw, 4)
    at += 8
    (n,) = struct.unpack_from("<i", raw, at)
    at += 4
    names = []
    for _ in range(n):
        (size,) = struct.unpack_from("<i", raw, at)
        names.append(raw[at + 4 : at + 3 + size].decode())
        at += 8 + size
    if not names:
        raise ValueError("the BAM header names no contig")
    ord_ = 0
    while at < len(raw):
        (size,) = struct.unpack_from("<i", raw, at)
        tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate_tid, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw, at + 4)
        p = at + 36
        qname = raw[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", raw, p)
        p += 4 * n_cigar
        packed = raw[p : p + (l_seq + 1) // 2]
        p += (l_seq + 1) // 2
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
        quals = raw[p : p + l_seq]
        p += l_seq
        tags, kinds = parse_tags(raw[p : at + 4 + size])
        cigar = "".join(f"{x >> 4}{CIGAR_LETTERS[x & 15]}" for x in ops)
        text = None if not l_seq or quals[0] == 255 else "".join(chr(q + 33) for q in quals)
        name = lambda t: names[t] if t >= 0 else None
        yield (ord_, qname, flag, name(tid), pos, mapq, cigar or None, name(mate_tid), mate_pos, tlen, seq or None, text, tags, kinds)
        ord_ += 1
        at += 4 + size


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Files are read by Spark and decoded one per task; ord counts within a file, files in the order of their paths."""
    files = spark.read.format("binaryFile").load(path)
    rank = {p: i for i, p in enumerate(sorted(r.path for r in files.select("path").collect()))}  # one name per file
    rows = files.rdd.flatMap(lambda r: [(x[0] + (rank[r.path] << 40), *x[1:]) for x in bam_records(bytes(r.content))])
    return spark.createDataFrame(rows, SCHEMA)


def sam_text(reads: DataFrame) -> DataFrame:
    """(ord, line): alignments as SAM lines."""
    cols = {c: F.col(c) for c in reads.columns} | {"tags": P.tag_fields(F.col("tags"), F.col("kinds") if "kinds" in reads.columns else F.create_map().cast("map<string,string>"))}
    return reads.select("ord", P.sam_line(cols).alias("line"))


def sorted_header(lines: list[str]) -> list[str]:
    """Header lines with SO:coordinate in @HD, which is made if it is missing."""
    fields = next((x.split("\t") for x in lines if x.startswith("@HD")), ["@HD", "VN:1.6"])
    head = "\t".join([*[f for f in fields if not f.startswith("SO:")], "SO:coordinate"])
    return [head, *[x for x in lines if not x.startswith("@HD")]]
