"""Error-tolerant grouping of UMIs inside bundles.

Input: one row per (bundle, umi) with n (reads) and first_ord (first seen). Output: the same rows with
  rank       place by (n desc, first_ord) in the bundle
  group_ix   order of the group in the bundle
  final_umi  the group's representative, is_top, and group_n, the reads of the group.

Groups in closed form, over the graph of UMIs within `threshold` substitutions:
  unique       every UMI alone
  percentile   UMIs with n over a hundredth of the bundle's median, alone; the others are left out
  cluster      connected components
  directional  an edge from a to b needs n_a >= 2 n_b - 1; a UMI belongs to the first-ranked UMI that reaches it
  adjacency    in a component ranked by (n desc, umi): m(u) is the least rank of u and its neighbours, k the greatest
               m; ranks up to k lead, every other UMI joins lead m(u)
The representative is first by (n desc, umi) in the group (in adjacency: the lead).

Two plans give the same rows. `local` gathers one row per bundle and labels many bundles per Arrow batch: one shuffle,
no iteration. `frames` never gathers a bundle: UMIs meet by equal blocks (threshold + 1 blocks, one of which must be
equal), labels spread by joins until they settle, each round written to the shared folder. `auto` sends bundles of more
than `most_local` UMIs to `frames`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import barcodes as B
from ..plans.tables import written

METHODS = ("unique", "percentile", "cluster", "adjacency", "directional")


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}: {method}")
    return method


def edges(umis: Sequence[str], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (each both ways) of UMIs within threshold substitutions."""
    if len({len(u) for u in umis}) > 1:
        raise ValueError("UMIs of a bundle must have one length")
    m, length = len(umis), len(umis[0])
    if m < 2:
        none = np.zeros(0, np.int64)
        return none, none
    if not length:
        a, b = np.nonzero(~np.eye(m, dtype=bool))
        return a, b
    codes = np.frombuffer("".join(umis).encode("ascii", "replace"), np.uint8).reshape(m, length)
    if m <= 256 or threshold >= length:
        near = (codes[:, None, :] != codes[None, :, :]).sum(2) <= threshold
        np.fill_diagonal(near, False)
        return np.nonzero(near)
    found = []
    for start, stop in B.block_slices(length, threshold + 1):
        _, key = np.unique(codes[:, start:stop], axis=0, return_inverse=True)
        order = np.argsort(key.ravel(), kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(key.ravel()[order])) + 1):
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                near = (codes[part][:, None, :] != codes[rows][None, :, :]).sum(2) <= threshold
                x, y = np.nonzero(near)
                found.append(part[x] * m + rows[y])
    key = np.unique(np.concatenate(found))
    a, b = key // m, key % m
    return a[a != b], b[a != b]


def spread(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least rank that reaches each node along edges a -> b."""
    label = rank.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def group_bundle(umis: Sequence[str], n: np.ndarray, first_ord: np.ndarray, method: str, threshold: int) -> tuple[np.ndarray, ...]:
    """(kept UMIs, and of each: rank, group_ix, its representative, group_n), as indices and numbers."""
    m = len(umis)
    rank = np.empty(m, np.int64)
    rank[np.lexsort((first_ord, -n))] = np.arange(m)
    seen = np.empty(m, np.int64)
    seen[np.argsort(first_ord, kind="stable")] = np.arange(m)
    by_text = np.empty(m, np.int64)  # the order of representatives
    by_text[sorted(range(m), key=lambda i: (-n[i], umis[i]))] = np.arange(m)
    keep = np.ones(m, bool)
    lead: np.ndarray | None = None
    if method in ("unique", "percentile"):
        group = seen
        if method == "percentile" and m > 1:
            keep = n > np.median(n) / 100
    else:
        a, b = edges(umis, threshold)
        if method == "directional":
            strong = n[a] >= 2 * n[b] - 1
            group = spread(rank, a[strong], b[strong])
        else:
            group = spread(rank, a, b)
            if method == "adjacency":
                least = by_text.copy()
                np.minimum.at(least, b, by_text[a])
                order = np.lexsort((by_text, group))
                heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
                most = np.empty(m, np.int64)
                most[order] = np.repeat(np.maximum.reduceat(least[order], heads), np.diff(np.append(heads, m)))
                lead = np.where(by_text <= most, by_text, least)
                group = group * (m + 1) + lead
    _, group_ix = np.unique(group, return_inverse=True)
    top = np.full(m, m)
    np.minimum.at(top, group_ix, by_text if lead is None else np.where(by_text == lead, by_text, m))
    text_at = np.empty(m, np.int64)
    text_at[by_text] = np.arange(m)
    final = text_at[top[group_ix]]
    total = np.bincount(group_ix, n, minlength=m).astype(np.int64)
    at = np.flatnonzero(keep)
    return at, rank[at], group_ix[at], final[at], total[group_ix][at]


def label_bundle(umis: Sequence[str], n: np.ndarray, first_ord: np.ndarray, method: str, threshold: int) -> pd.DataFrame:
    """One bundle as a frame of LABELS."""
    at, rank, group_ix, final, total = group_bundle(umis, n, first_ord, method, threshold)
    text = np.array(umis, dtype=object)
    return pd.DataFrame({"umi": text[at], "n": n[at], "first_ord": first_ord[at], "rank": rank, "group_ix": group_ix, "final_umi": text[final], "is_top": final == at, "group_n": total})


LABELS = "umi string, n long, first_ord long, rank long, group_ix long, final_umi string, is_top boolean, group_n long"


def cluster_local(counts: DataFrame, keys: Sequence[str], method: str, threshold: int) -> DataFrame:
    bundles = counts.groupBy(*keys).agg(F.collect_list(F.struct("umi", "n", "first_ord")).alias("umis"))
    return _label(bundles, keys, method, threshold)


def _label(bundles: DataFrame, keys: Sequence[str], method: str, threshold: int) -> DataFrame:
    schema = T.StructType([bundles.schema[k] for k in keys] + T._parse_datatype_string(LABELS).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("umis")
            ends = np.asarray(lists.offsets).astype(np.int64)
            rows = lists.values
            n, first = np.asarray(rows.field("n")), np.asarray(rows.field("first_ord"))
            size = np.diff(ends)
            lone = ends[:-1][size == 1]  # bundles of one UMI, most of real data, need no graph
            zero = np.zeros(len(lone), np.int64)
            parts = [(np.flatnonzero(size == 1), lone, zero, zero, lone, n[lone])]
            for i in np.flatnonzero(size > 1).tolist():
                a, b = int(ends[i]), int(ends[i + 1])
                at, rank, group_ix, final, total = group_bundle(rows.field("umi")[a:b].to_pylist(), n[a:b], first[a:b], method, threshold)
                parts.append((np.full(len(at), i), at + a, rank, group_ix, final + a, total))
            bundle, at, rank, group_ix, final, total = (np.concatenate(x) for x in zip(*parts, strict=True))
            text = rows.field("umi")
            cols = {k: batch.column(k).take(pa.array(bundle)) for k in keys}
            cols |= {"umi": text.take(pa.array(at)), "n": pa.array(n[at]), "first_ord": pa.array(first[at]), "rank": pa.array(rank), "group_ix": pa.array(group_ix)}
            cols |= {"final_umi": text.take(pa.array(final)), "is_top": pa.array(final == at), "group_n": pa.array(total)}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=schema.names)

    return bundles.select(*keys, "umis").mapInArrow(run, schema)


def _near_pairs(counts: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """(keys, a, b, n_a, n_b): pairs of UMIs within threshold, each both ways."""
    lengths = [r[0] for r in counts.select(F.length("umi")).distinct().collect()]  # a handful
    if not lengths:
        return counts.select(*keys, F.col("umi").alias("a"), F.col("umi").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b")).limit(0)
    # the UMIs of a bundle must have one length; different bundles may differ
    if len(lengths) > 1 and counts.groupBy(*keys).agg((F.min(F.length("umi")) != F.max(F.length("umi"))).alias("differ")).where("differ").limit(1).count():
        raise ValueError("UMIs of a bundle must have one length")
    blocks = None
    for n in sorted(lengths):
        one = counts.where(F.length("umi") == n).select(*keys, "umi", "n", F.inline(B.block_keys(F.col("umi"), n, threshold + 1)))
        blocks = one if blocks is None else blocks.unionByName(one)
    side = lambda x: blocks.select(*keys, "block", "part", F.col("umi").alias(x), F.col("n").alias(f"n_{x}"))
    on = [*keys, "block", "part"]
    pairs = side("a").join(side("b"), on).where((F.col("a") != F.col("b")) & (B.hamming("a", "b") <= threshold))
    return pairs.drop("block", "part").dropDuplicates([*keys, "a", "b"])


def cluster_frames(counts: DataFrame, keys: Sequence[str], method: str, threshold: int) -> DataFrame:
    """As cluster_local(), without gathering a bundle."""
    # a struct joins on all its fields, nulls included
    packed = counts.select(F.struct(*keys).alias("bundle"), "umi", "n", "first_ord")
    return _frames(packed, ["bundle"], method, threshold).select("bundle.*", "umi", "n", "first_ord", "rank", "group_ix", "final_umi", "is_top", "group_n")


def _frames(counts: DataFrame, keys: Sequence[str], method: str, threshold: int) -> DataFrame:
    by = Window.partitionBy(*keys)
    base = counts.select(*keys, "umi", "n", "first_ord", (F.row_number().over(by.orderBy(F.desc("n"), "first_ord")) - 1).cast("long").alias("rank"))
    base = written(base.withColumn("text_rank", (F.row_number().over(by.orderBy(F.desc("n"), "umi")) - 1).cast("long")), "ranks")
    if method in ("unique", "percentile"):
        group = base.withColumn("group", F.row_number().over(by.orderBy("first_ord")).cast("long")).withColumn("lead", F.col("text_rank"))
        if method == "percentile":
            cut = base.groupBy(*keys).agg(F.median("n").alias("half"), F.count(F.lit(1)).alias("m"))
            group = group.join(cut, list(keys)).where("m = 1 or n > half / 100").drop("half", "m")
    else:
        pairs = _near_pairs(counts, keys, threshold)
        if method == "directional":
            pairs = pairs.where("n_a >= 2 * n_b - 1")
        pairs = written(pairs, "pairs")
        label = base.select(*keys, "umi", F.col("rank").alias("label"))
        changed = 1
        while changed:
            come = pairs.join(label.withColumnRenamed("umi", "a"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("umi")).agg(F.min("label").alias("come"))
            step = label.join(come, [*keys, "umi"], "left").select(*keys, "umi", F.least("label", "come").alias("label"), (F.coalesce("come", "label") < F.col("label")).alias("moved"))
            step = written(step, "labels")
            changed = step.where("moved").limit(1).count()
            label = step.drop("moved")
        group = base.join(label.withColumnRenamed("label", "group"), [*keys, "umi"])
        if method == "adjacency":
            others = pairs.join(base.select(*keys, F.col("umi").alias("a"), "text_rank"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("umi")).agg(F.min("text_rank").alias("other"))
            group = group.join(others, [*keys, "umi"], "left").withColumn("least", F.least("text_rank", "other"))
            group = group.withColumn("most", F.max("least").over(Window.partitionBy(*keys, "group")))
            group = group.withColumn("lead", F.when(F.col("text_rank") <= F.col("most"), F.col("text_rank")).otherwise(F.col("least")))
        else:
            group = group.withColumn("lead", F.lit(0).cast("long"))
    whole = Window.partitionBy(*keys, "group", "lead") if method == "adjacency" else Window.partitionBy(*keys, "group")
    rep = F.min(F.struct("text_rank", "umi")).over(whole) if method != "adjacency" else F.min(F.when(F.col("text_rank") == F.col("lead"), F.struct("text_rank", "umi"))).over(whole)
    out = group.select(*keys, "umi", "n", "first_ord", "rank", "group", "lead", rep["umi"].alias("final_umi"), F.sum("n").over(whole).alias("group_n"))
    order = [F.col("group"), F.col("lead")] if method == "adjacency" else [F.col("group")]
    out = out.withColumn("group_ix", (F.dense_rank().over(by.orderBy(*order)) - 1).cast("long"))
    return out.select(*keys, "umi", "n", "first_ord", "rank", "group_ix", "final_umi", (F.col("umi") == F.col("final_umi")).alias("is_top"), "group_n")


def cluster_umis(counts: DataFrame, keys: Sequence[str], method: str = "directional", threshold: int = 1, plan: str = "auto", most_local: int = 20_000) -> DataFrame:
    """Label the UMIs of every bundle; see above."""
    check_method(method)
    own = counts.select(*keys, "umi", "n", "first_ord")
    if plan == "local":
        return cluster_local(own, keys, method, threshold)
    if plan == "frames":
        return cluster_frames(own, keys, method, threshold)
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > most_local).drop("m")
    if large.limit(1).count() == 0:
        return cluster_local(own, keys, method, threshold)
    large = large.select(*[F.col(k).alias(f"large_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"large_{k}")) for k in keys]
    hot = written(own.join(large, same, "left_semi"), "large")
    rest = own.join(large, same, "left_anti")
    return cluster_local(rest, keys, method, threshold).unionByName(cluster_frames(hot, keys, method, threshold))


def counters(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(positions, total_umis, max_umis, mean_umis) over all bundles."""
    per = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("positions"), F.sum("m").alias("total_umis"), F.max("m").alias("max_umis"), F.avg("m").alias("mean_umis"))
