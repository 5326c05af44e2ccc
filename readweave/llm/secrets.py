"""Secret scans: Aho-Corasick keywords, anchored expressions at the hits, then embedded checksums.

One automaton pass over a text gives the places of all keywords; an expression is tried only at (or just after) such a
place. Hexadecimal runs have no keyword: the text is mapped to one byte per class and runs are found by substring
search. Kinds with a checksum inside (GitHub and npm tokens: base-62 CRC-32; card numbers: Luhn; IBAN: mod 97) count only
if it holds. Per kind, matches are taken leftmost and do not overlap; a match that is too short or fails its checksum is
dropped but still covers its text.

Edge cases. A null text is empty and has no spans. Offsets are code points, end exclusive. Repeated rows are scanned
each. Extra columns are kept unless named like a result column. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "card", "iban")
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_CARD = re.compile(rb"(?i:card)[^0-9\n]{0,24}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])")
_IBAN = re.compile(rb"(?i:iban)[^A-Za-z0-9\n]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def base62(x: int, width: int = 6) -> bytes:
    out = b""
    while x or len(out) < width:
        x, r = divmod(x, 62)
        out = _DIGITS[r : r + 1] + out
    return out


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits if 48 <= c < 58]
    return len(set(d)) > 1 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(d))) % 10 == 0


def mod97(iban: bytes) -> bool:
    s = iban.replace(b" ", b"").decode()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def crc_ok(m: re.Match) -> bool:
    return base62(zlib.crc32(m[1])) == m[2]


#: kind: expression, test of a match, group that is the span
EXPRESSIONS = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 12, 0),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18, 0),
    "github": (_GITHUB, crc_ok, 0),
    "npm": (_NPM, crc_ok, 0),
    "card": (_CARD, lambda m: luhn(m[1]), 1),
    "iban": (_IBAN, lambda m: mod97(m[1]), 1),
}
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "card": ("card",),
    "iban": ("iban",),
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(data: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, sorted."""
    out, until = [], dict.fromkeys(EXPRESSIONS, 0)
    for last, (kind, size) in words.iter(data.lower().decode("latin-1")):
        at = last + 1 - size
        if at < until[kind]:
            continue
        expression, good, group = EXPRESSIONS[kind]
        if m := expression.match(data, at):
            until[kind] = m.end()
            if good(m):
                out.append((m.start(group), KINDS.index(kind), m.end(group)))
    runs = data.translate(_HEX)
    at = runs.find(b"x" * 16)
    while at >= 0:
        end = runs.find(b" ", at)
        end = len(runs) if end < 0 else end
        out.append((at, 2, end))
        at = runs.find(b"x" * 16, end)
    out.sort()
    return out


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with offsets in code points."""
    if not spans or data.isascii():
        return spans
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(begins[a]), k, int(begins[b])) for a, k, b in spans]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_secrets(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with secrets: array of (kind, start, end), by start, then in the order of KINDS."""
    keep = [c for c in docs.columns if c.lower() != "secrets" and not (drop_text and c == text_col)]
    schema = C.plus(docs.select(*keep).schema, ("secrets", SPAN))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            data, off = C.raw(batch.column(text_col))
            data = data.tobytes()
            found = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = data[a:b]
                found.append([{"kind": KINDS[k], "start": x, "end": y} for x, k, y in code_points(text, scan(text, words))])
            yield C.with_columns(batch, schema.names, {"secrets": pa.array(found, arrow)})

    return docs.mapInArrow(run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_secrets(docs, drop_text=True)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(line(of(*BASE)), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
