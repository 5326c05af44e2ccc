"""Mixing sources to target weights by pivotal rounding over a reduction tree.

Targets: `share` of all words is dealt by weight; no source takes more than `cap` times its size, the excess is dealt
again. A document is expected rate = target / source size times: floor(rate) copies surely, one more with the fractional
part. Two fractional documents play at a time: words move from one to the other, in a direction drawn so that both keep
their expectation, until one of them is integral. The sum of expected words never changes, so a source ends within one
document of its target.

The rows of a source are dealt into fan**depth leaves by a seeded hash of the id. A leaf streams its rows, largest
first, holding one fractional row; what is left of it meets the leavings of fan - 1 neighbours on the next level, until
one row per source is left, which is drawn alone. A hot source is thus many leaves. All draws are seeded hashes.

Edge cases. A null source is a source, last in order. A null text has size 0 and takes floor(rate) copies and no words.
Sources without words have target 0. Repeated rows are rows of their own. An empty table gives an empty table. Columns
named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

RESULT = ("size", "source_size", "target", "copies")
EPS = 1e-9


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Deal total by weight; what exceeds cap * size goes to the others by weight, until none exceeds."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        of = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / of
        full = {i for i in open_ if out[i] > cap * sizes[i]}
        if not full:
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        open_ -= full
    return out


def pivot(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """Move words between two documents until one is integral; expectations and p * s + q * t stay."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    move = up if u * (up + down) < down else -down
    p, q = p + move / s, q - move / t
    snap = lambda x: 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
    return snap(p), snap(q)


def draw(seed: int, level: int, a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(b"%d %d %d %d" % (seed, level, a, b)) / 2.0**64


def play(names: list[str], cols: dict[str, str], seed: int, level: int, last: bool):
    """For mapInArrow: rows of a group (column g) arrive together. Rows come out with extra = 0 or 1, or null and their
    fraction p if they are what is left of the group."""
    g_, h_, p_, x_, s_ = (cols[k] for k in ("g", "h", "p", "x", "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the fractional row of an earlier batch
        group, hp, hs, hh = None, 0.0, 0, 0

        def row(p: float) -> pa.RecordBatch:
            done = p in (0.0, 1.0)
            if last and not done:
                p, done = float(draw(seed, -1, hh, 0) < p), True
            return C.with_columns(held, names, {p_: pa.array([p]), x_: pa.array([int(p) if done else None], pa.int32())})

        for batch in batches:
            gs, hs_, ps, ss = (batch.column(c).to_pylist() for c in (g_, h_, p_, s_))
            p = list(ps)
            out: list[pa.RecordBatch] = []
            at = -1  # where the fractional row is: -1 in `held`, else in this batch
            for i in range(len(p)):
                if gs[i] != group:
                    if at < 0 and held is not None:
                        out.append(row(hp))
                        held = None
                    elif at >= 0:
                        p[at] = hp
                        if last:
                            p[at] = float(draw(seed, -1, hh, 0) < hp)
                    group, at, hs = gs[i], -1, 0
                if ss[i] == 0:
                    p[i] = 0.0
                if p[i] in (0.0, 1.0):
                    continue
                if hs == 0:  # none is held
                    at, hp, hs, hh = i, p[i], ss[i], hs_[i]
                    continue
                hp, q = pivot(hp, hs, p[i], ss[i], draw(seed, level, hh, hs_[i]))
                if hp in (0.0, 1.0):
                    if at < 0:
                        out.append(row(hp))
                        held = None
                    else:
                        p[at] = hp
                    at, hp, hs, hh = (i, q, ss[i], hs_[i]) if q not in (0.0, 1.0) else (-1, 0.0, 0, 0)
                    if hs == 0:
                        p[i] = q
                else:
                    p[i] = q
            keep = [True] * len(p)
            if at >= 0:
                held, keep[at] = batch.slice(at, 1), False
            extra = [int(v) if v in (0.0, 1.0) else None for v in p]
            out.append(C.with_columns(batch, names, {p_: pa.array(p, pa.float64()), x_: pa.array(extra, pa.int32())}).filter(pa.array(keep, pa.bool_())))
            yield from out
        if held is not None:
            yield row(hp)

    return run


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str | None = None,
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    leaf_rows: int = 4096,
    fan: int = 16,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """docs with size, source_size, target and copies (int). Weights go to the sources in code point order, null last,
    and repeat. The source list is a table of weights and must have at most max_sources rows."""
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else word_count(F.col(text_col))
    own = [c for c in docs.columns if c.lower() not in RESULT]
    g, h, p, x, b, key, rate = C.fresh(docs, "g", "h", "p", "extra", "leaf", "source_key", "rate")
    sized = docs.select(*own, size.alias("size"))
    found = sized.groupBy(source_col).agg(F.sum("size"), F.count(F.lit(1))).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] or 0 for r in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), cap)
    spark = docs.sparkSession
    kind = docs.schema[source_col].dataType
    table = spark.createDataFrame(
        [(r[0], n, t, t / n if n else 0.0) for r, n, t in zip(found, sizes, targets, strict=True)],
        T.StructType([T.StructField(key, kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField(rate, T.DoubleType())]),
    )
    depth = 0
    while fan**depth * leaf_rows < sum(r[2] for r in found):
        depth += 1
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col("size"))
    rows = sized.join(F.broadcast(table) if len(found) <= 10_000 else table, sized[source_col].eqNullSafe(F.col(key)))
    part = F.col(rate) - F.floor(rate)
    snapped = F.when(part < EPS, 0.0).when(part > 1 - EPS, 1.0).otherwise(part)
    rows = rows.select(*own, "size", "source_size", "target", F.floor(rate).cast("int").alias("copies"), hashed.alias(h), F.pmod(hashed, F.lit(fan**depth)).alias(b), snapped.alias(p))
    rows = rows.withColumn(x, F.lit(None).cast("int"))
    n = C.n_shuffle(spark)
    done = []
    for level in range(depth + 1):
        where = F.floor(F.col(b) / fan**level).cast("long")
        ready = rows.withColumn(g, F.xxhash64(F.col(source_col), where))
        if level == 0:
            schema = ready.schema
        ready = ready.repartition(n, g).sortWithinPartitions(g, F.col("size").desc(), h)
        played = ready.mapInArrow(play(schema.names, {"g": g, "h": h, "p": p, "x": x, "s": "size"}, seed, level, level == depth), schema)
        if level < depth:
            played = C.materialize(played, f"mix{level}")
            done.append(played.where(F.col(x).isNotNull()))
            rows = played.where(F.col(x).isNull()).drop(g)
        else:
            done.append(played)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*own, "size", "source_size", "target", (F.col("copies") + F.col(x)).alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    out = mix_sources(docs, size_col="words")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
