"""Column builders for barcodes: where they stand in a read name or tag, distances, blocks and qualities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lowest quality character of each encoding, and one past its highest.
QUALITY_RANGES = {"phred33": (33, 77), "solexa": (59, 106), "phred64": (64, 106)}
# What a base can be read as by mistake, in the order in which errors are listed.
BASE_ERRORS = {"A": "TCGN", "T": "ACGN", "C": "TAGN", "G": "TCAN"}


def name_tokens(qname: Column, separator: str) -> Column:
    return F.split(qname, re.escape(separator))


def barcode_from_name(qname: Column, per_cell: bool = False, separator: str = "_") -> tuple[Column, Column]:
    """(cell, umi): the last token of the name is the UMI, with per_cell the last but one is the cell."""
    tokens = name_tokens(qname, separator)
    return (F.try_element_at(tokens, F.lit(-2)) if per_cell else F.lit(None).cast("string")), F.element_at(tokens, -1)


def barcode_from_labels(qname: Column, per_cell: bool = False) -> tuple[Column, Column]:
    """(cell, umi) from the last tokens that begin with CELL_ and UMI_ in a name of tokens joined by colons."""

    def last(label: str) -> Column:
        found = F.filter(F.split(qname, ":"), lambda t: t.startswith(label))
        return F.substring(F.try_element_at(found, F.lit(-1)), len(label) + 1, 1 << 30)

    return (last("CELL_") if per_cell else F.lit(None).cast("string")), last("UMI_")


def barcode_from_tags(
    tags: Column,
    umi_tag: str = "RX",
    cell_tag: str | None = None,
    per_cell: bool = False,
    umi_split: str | None = None,
    umi_delimiter: str | None = None,
    cell_split: str | None = "-",
    cell_delimiter: str | None = None,
) -> tuple[Column, Column]:
    """(cell, umi) from tags: the part before `split`, or the parts joined across `delimiter`."""

    def clean(value: Column, split: str | None, delimiter: str | None) -> Column:
        if split:
            value = F.element_at(F.split(value, re.escape(split)), 1)
        return F.replace(value, F.lit(delimiter), F.lit("")) if delimiter else value

    cell = clean(tags[cell_tag], cell_split, cell_delimiter) if per_cell and cell_tag else F.lit(None).cast("string")
    return cell, clean(tags[umi_tag], umi_split, umi_delimiter)


def hamming(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ; strings of other lengths raise an error."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("strings have different lengths")).cast("int")).otherwise(differ)


def hamming_or_null(a: Column, b: Column) -> Column:
    """As hamming(), null for strings of different lengths."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)))


def block_slices(length: int, blocks: int) -> list[tuple[int, int]]:
    """(start, stop) of `blocks` near-equal blocks of a string; the first ones take the remainder."""
    if blocks == 0:
        raise ValueError("at least one block is needed")
    if blocks < 0:
        return []
    size, rest = divmod(length, blocks)
    stops = [size * (i + 1) + min(i + 1, rest) for i in range(blocks)]
    return list(zip([0, *stops[:-1]], stops, strict=True))


def block_keys(text: Column, length: int, blocks: int) -> Column:
    """An array of (block, text): strings within blocks - 1 substitutions share at least one entry."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.substring(text, a + 1, b - a).alias("part")) for i, (a, b) in enumerate(block_slices(length, blocks))])


def within_prefix_edits(barcode: Column, other: Column, errors: int) -> Column:
    """Whether some prefix of `other` is within `errors` edits of the barcode."""
    lengths = F.sequence(F.greatest(F.lit(0), F.length(barcode) - errors), F.length(barcode) + errors)
    return F.exists(lengths, lambda k: (k <= F.length(other)) & (F.levenshtein(barcode, F.substr(other, F.lit(1), k)) <= errors))


def qualities(quals: Column, encoding: str) -> Column:
    if encoding not in QUALITY_RANGES:
        raise ValueError(f"unknown quality encoding: {encoding}")
    return F.transform(F.filter(F.split(quals, ""), lambda c: c != ""), lambda c: F.ascii(c) - QUALITY_RANGES[encoding][0])


def any_below(quals: Column, encoding: str, threshold: int) -> Column:
    return F.exists(qualities(quals, encoding), lambda q: q < threshold)


def mask_low(umi: Column, quals: Column, encoding: str, threshold: int) -> Column:
    """The UMI with N for every base of low quality."""
    bases = F.filter(F.split(umi, ""), lambda c: c != "")
    n = F.least(F.length(umi), F.length(quals))
    low = F.zip_with(F.slice(bases, F.lit(1), n), F.slice(qualities(quals, encoding), F.lit(1), n), lambda b, q: F.when(q < threshold, "N").otherwise(b))
    return F.array_join(low, "")


def quality_encodings(quals: Column) -> Column:
    """The encodings that a quality string can be in, in the order of QUALITY_RANGES."""
    codes = F.transform(F.filter(F.split(quals, ""), lambda c: c != ""), F.ascii)
    fits = [F.when((F.array_min(codes) >= lo) & (F.array_max(codes) < hi), F.lit(name)) for name, (lo, hi) in QUALITY_RANGES.items()]
    return F.array_compact(F.array(*fits))


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down, for either sign of b."""
    q = F.try_divide(a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))
    return F.floor(q).cast("long")


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder of floor_div(); it has the sign of b."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def item(text: Column, i: int) -> Column:
    """Character i; a negative i counts from the end; null outside."""
    at = F.lit(i + 1) if i >= 0 else F.length(text) + i + 1
    return F.when((at >= 1) & (at <= F.length(text)), F.substr(text, at, F.lit(1)))


def piece(text: Column, start: int | None = None, stop: int | None = None) -> Column:
    """Characters from start to stop; negative ends count from the end, and ends outside are moved in."""
    n = F.length(text)
    end = lambda v, none: none if v is None else F.least(F.greatest(F.lit(v) if v >= 0 else n + v, F.lit(0)), n)
    a, b = end(start, F.lit(0)), end(stop, n)
    return F.substr(text, a + 1, F.greatest(b - a, F.lit(0)))


def fixed(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))
