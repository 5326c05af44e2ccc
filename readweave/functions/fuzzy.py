"""Barcode patterns. Flat patterns (groups and literals in a row) run as Java expressions with one group per part, so
the spans follow from the lengths; patterns with errors, nesting or alternatives run in an Arrow function.

Errors bind to the element before them: `(?P<umi_1>ACGT){s<=1}` allows one substitution in the group. Counts of
insertions, deletions and errors of any kind allow the same edits.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH = T.MapType(T.StringType(), T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("text", T.StringType())]))
_ERRORS = re.compile(r"\{([seid])<=(\d+)\}")
_REFUSED = re.compile(r"\(\?(?:=|!|<=|<!|>|[aiLmsux-]+[:)])|\\[1-9]|\(\?P=")
_PART = re.compile(r"\(\?P<(?P<name>\w+)>(?P<body>[^()|]*)\)(?P<times>\{\d+(?:,\d*)?\}|[*+?]\??)?|(?P<plain>(?:\\.|\[[^\]]*\]|[^()|\\\[])+)")


def check_pattern(pattern: str) -> list[str]:
    """The names of the groups; raises ValueError for what patterns must not hold."""
    if _REFUSED.search(pattern):
        raise ValueError(f"lookaround, flags, back references and atomic groups are not supported: {pattern}")
    try:
        re.compile(_ERRORS.sub("", pattern))
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern}: {e}") from e
    return re.findall(r"\(\?P<(\w+)>", pattern)


def flat_parts(pattern: str) -> list[tuple[str | None, str]] | None:
    """(group name or None, body) in a row, or None if the pattern is not flat."""
    if _ERRORS.search(pattern):
        return None
    out, at = [], 0
    while at < len(pattern):
        m = _PART.match(pattern, at)
        if not m or m["times"]:
            return None
        out.append((m["name"], m["body"] if m["name"] else m["plain"]))
        at = m.end()
    return out


def match_flat(text: Column, parts: list[tuple[str | None, str]]) -> Column:
    """As match(), by Java expressions."""
    java = "^" + "".join(f"({body})" for _, body in parts)
    got = [F.regexp_extract(text, java, i + 1) for i in range(len(parts))]
    entries, at = [], F.lit(0)
    for (name, _), g in zip(parts, got, strict=True):
        if name:
            entries += [F.lit(name), F.struct(at.cast("int").alias("start"), (at + F.length(g)).cast("int").alias("stop"), g.alias("text"))]
        at = at + F.length(g)
    found = F.create_map(*entries) if entries else F.create_map().cast(MATCH)
    return F.when(text.rlike(java), found)


def compile_fuzzy(pattern: str):
    """The pattern for the regex library, every kind of error spelled out."""
    import regex

    return regex.compile(_ERRORS.sub(lambda m: "{%s<=%s}" % ("s" if m[1] == "s" else "e", m[2]), pattern))


def match(text: Column, pattern: str) -> Column:
    """The named groups of a match at the start of text, null if there is none. A group that takes no part has start
    and stop -1 and no text."""
    check_pattern(pattern)
    parts = flat_parts(pattern)
    if parts is not None:
        return match_flat(text, parts)

    @F.pandas_udf(MATCH)
    def run(texts: pd.Series) -> pd.Series:
        expression = compile_fuzzy(pattern)
        out = []
        for t in texts:
            m = None if t is None else expression.match(t)
            out.append(None if m is None else {k: {"start": m.start(k), "stop": m.end(k), "text": v} for k, v in m.groupdict().items()})
        return pd.Series(out, dtype=object)

    return run(text)


def groups_of(found: Column, prefix: str) -> Column:
    """The spans of the groups with a prefix, by name; a group that takes no part is an error."""
    named = F.array_sort(F.filter(F.map_entries(found), lambda e: e["key"].startswith(prefix)))
    wrong = lambda e: F.raise_error(F.concat(F.lit("group without a match: "), e["key"])).cast("string")
    return F.transform(named, lambda e: F.struct(e["value"]["start"].alias("start"), e["value"]["stop"].alias("stop"), F.when(e["value"]["start"] < 0, wrong(e)).otherwise(e["value"]["text"]).alias("text")))
