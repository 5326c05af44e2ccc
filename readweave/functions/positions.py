"""Column builders for alignments: flags, CIGAR strings, and the position that a read is grouped by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the flag of an alignment.
FLAGS = {"paired": 1, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "read1": 64, "read2": 128, "secondary": 256}
CONSUMES_REFERENCE = ("M", "D", "N", "=", "X")


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(FLAGS[name]) != 0


def parse_cigar(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)[A-Z=]"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([A-Z=])"), F.lit(1))
    return F.zip_with(op, n, lambda o, k: F.struct(o.alias("op"), k.cast("int").alias("len")))


def reference_end(pos: Column, cigar: Column) -> Column:
    """The place after the last base of the reference that the alignment covers."""
    used = F.filter(parse_cigar(cigar), lambda c: c["op"].isin(*CONSUMES_REFERENCE))
    return pos + F.aggregate(used, F.lit(0).cast("long"), lambda s, c: s + c["len"])


def splice_offset(ops: Column) -> Column:
    """Reference bases before the first N or S; a leading S counts as an offset. 0 without any."""
    first = F.get(ops, F.lit(0))
    lead = F.when(first["op"] == "S", first["len"]).otherwise(0).cast("long")
    rest = F.when(first["op"] == "S", F.slice(ops, F.lit(2), F.greatest(F.size(ops) - 1, F.lit(0)))).otherwise(ops)

    def step(s: Column, c: Column) -> Column:
        moved = s["n"] + F.when(c["op"].isin("M", "D", "=", "X"), c["len"]).otherwise(0)
        bad = ~c["op"].isin("M", "D", "=", "X", "I", "H", "P", "N", "S")
        n = F.when(bad, F.raise_error(F.concat(F.lit("bad CIGAR operation: "), c["op"])).cast("long")).otherwise(moved)
        stop = s["done"] | c["op"].isin("N", "S")
        return F.struct(F.when(stop, s["n"]).otherwise(n).alias("n"), stop.alias("done"))

    start = F.struct(lead.alias("n"), F.lit(False).alias("done"))
    return F.aggregate(rest, start, step, lambda s: F.when(s["done"], s["n"]).otherwise(F.lit(0).cast("long")))


def read_position(pos: Column, cigar: Column, flag: Column, soft_clip_threshold: float = 4) -> Column:
    """struct<start, pos, is_spliced>: the 5' end of the whole read (soft clips included), on its own strand."""
    ops = parse_cigar(cigar)
    first, last = F.get(ops, F.lit(0)), F.element_at(ops, -1)
    clip = lambda c: F.when(c["op"] == "S", c["len"]).otherwise(0)
    gap = cigar.contains("N")
    forward, back = pos - clip(first), reference_end(pos, cigar) + clip(last)
    zero = F.lit(0).cast("long")
    spliced_f = F.when(gap | (clip(last) > soft_clip_threshold), splice_offset(ops)).otherwise(zero)
    spliced_b = F.when(gap | (clip(first) > soft_clip_threshold), splice_offset(F.reverse(ops))).otherwise(zero)
    rev = has(flag, "reverse")
    pick = lambda a, b: F.when(rev, a).otherwise(b)
    return F.struct(pick(pos, forward).cast("long").alias("start"), pick(back, forward).cast("long").alias("pos"), pick(spliced_b, spliced_f).alias("is_spliced"))


def sam_line(row: dict[str, Column]) -> Column:
    """The SAM text of an alignment; `tags` is an array of finished TAG:TYPE:VALUE strings."""
    text = lambda c, none="*": F.coalesce(c.cast("string"), F.lit(none))
    mate = F.when(row["mate_rname"] == row["rname"], "=").otherwise(text(row["mate_rname"]))
    fields = [text(row["qname"]), text(row["flag"]), text(row["rname"]), text(row["pos"] + 1, "0"), text(row["mapq"], "0"), text(row["cigar"]), mate]
    fields += [text(row["mate_pos"] + 1, "0"), text(row["tlen"], "0"), text(row["seq"]), text(row["qual"])]
    return F.concat_ws("\t", *fields, row["tags"])


def tag_fields(tags: Column, kinds: Column) -> Column:
    """TAG:TYPE:VALUE strings, by tag."""
    entries = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    return F.transform(entries, lambda e: F.concat_ws(":", e["key"], F.coalesce(F.try_element_at(kinds, e["key"]), F.lit("Z")), e["value"]))


def check_tag(name: str) -> str:
    if len(name) != 2:
        raise ValueError(f"a tag name has two characters: {name}")
    return name


def set_tag(tags: Column, name: str, value: Column) -> Column:
    """tags with one tag replaced or added."""
    check_tag(name)
    rest = F.map_filter(tags, lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), value.cast("string")))


def copy_tag(to: Column, source: Column, name: str) -> Column:
    """`to` with the tag of `source`, if that has one."""
    check_tag(name)
    rest = F.map_filter(to, lambda k, _: k != name)
    return F.when(F.map_contains_key(source, name), F.map_concat(rest, F.map_filter(source, lambda k, _: k == name))).otherwise(to)
