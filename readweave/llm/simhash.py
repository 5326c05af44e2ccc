"""SimHash near-duplicate classes by BK-trees over shards of distinct fingerprints.

1. Each text becomes a 64-bit fingerprint: the majority, bit by bit, of the XXH64 of its word shingles.
2. Equal fingerprints collapse to one row (its smallest id), so groups of exact copies never travel further.
3. Of r + j blocks of bits, fingerprints within radius r agree on at least j. Rows meet by every choice of j blocks; j is
   the least that leaves about `shard` / 2 fingerprints to a value, so it grows with the corpus and no pair is lost. A
   value with more is dealt into shards of bounded size, and each shard's tree is sent to every shard of the value, so
   one dense value is many tasks of bounded memory.
4. Per pair of shards a BK-tree (children keyed by the integer Hamming distance to the parent) is built level by level
   and all queries walk it together, following only edges within [d - r, d + r]. Links are merged at once by union-find
   and leave the task as at most one (member, root) row per fingerprint: no pairs are emitted.
5. Connected components over those rows: of up to a million in one task, of more by alternating large-star and small-star
   rounds, written to the shared folder.

similar_documents() finds all near copies by the similarity of bags of five-word shingles, in which repeats are told apart
(shingle, occurrence), so that a bag is a set. Documents of equal bags are one node; texts decide every other link.
1. SimHash: a 64-bit fingerprint of five-word shingles differs in ten bits at similarity 0.8, too many to search for, so
   `lanes` independent fingerprints of two-word shingles are searched as above. Of each node the link that is nearest by a
   `wide`-word fingerprint, and the one to the least node, are compared by their texts. This joins the bulk of large
   classes and need not find every pair.
2. Prefixes: texts of similarity s share one of the first n - ceil(s n) + 1 of their n shingles in any common order (here:
   rarest first, by a sample). Of the pairs that share one, those whose fingerprints of five-word shingles differ in at
   most 24 of 64 bits go on (at similarity 0.8 they differ in 9.7, standard deviation 2.9: one pair in a million is
   missed).
3. Of these pairs, those that no link joins yet and whose `wide` fingerprints do not rule the similarity out by far are
   compared by their texts: of each node the nearest first, then all that are left apart. Shingles of many nodes are, in
   most cases, those of one large class: first each node meets its nearest ones; then, with the classes known, all pairs
   of different classes. As these may be most pairs of a large group, none of them becomes a row: tasks over shards of a
   shingle's nodes return links that span them, and the texts of what these links join meet in shards of their own, where
   all pairs are compared and spanning links are left. Only pairs compared by their texts are links of a class.

Edge cases. Null, empty and blank texts have fingerprint zero and are linked like any other. A null id is kept, is never
a representative if another member has an id, and gets the class of its fingerprint. Repeated rows stay. An empty table
gives an empty table. Extra columns are ignored by fingerprints(); near_duplicates() returns only its own columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LANES = np.uint64(0x0101010101010101)
STEP = 2048  # queries that walk a forest at a time


def majority(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per document, the bits set in over half of its hashes h[off[d]:off[d + 1]]; zero without hashes."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # segments of at most 255 hashes, so that a byte lane can count them
    parts = -(-n[full] // 255)
    first = np.concatenate([[0], np.cumsum(parts)])[:-1]
    seg = np.repeat(off[:-1][full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, seg).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(lanes, first, axis=0)
        bits = (2 * counts > n[full, None]).astype(np.uint64)
        for lane in range(8):
            out[full] |= bits[:, lane] << np.uint64(8 * lane + k)
    return out


def fingerprint_column(col: pa.Array, shingle: int) -> np.ndarray:
    w = C.Words(col, lower=True)
    first, last, off = C.shingles(w, shingle)
    v8 = C.load8(w.buf)
    return majority(C.xxh64(v8, w.start[first], w.end[last] - w.start[first]), off)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                fp = fingerprint_column(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], names=["id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "id long, fp long")


def forest(fp: np.ndarray, group: np.ndarray) -> dict[str, np.ndarray]:
    """BK-trees of all groups at once. Nodes are indices into fp; node x's children are child[at[x]:at[x + 1]], ordered
    by edge (their distance to x). Equal fingerprints in a group become children at distance 0."""
    n = len(fp)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    rows = np.argsort(group, kind="stable")
    key = group[rows]
    roots = rows[np.concatenate([[True], key[1:] != key[:-1]])] if n else rows
    while len(rows):
        head = np.concatenate([[True], key[1:] != key[:-1]])
        pivot = rows[np.flatnonzero(head)][np.cumsum(head) - 1]
        rest = ~head
        rows, pivot = rows[rest], pivot[rest]
        d = np.bitwise_count(fp[rows] ^ fp[pivot]).astype(np.int64)
        parent[rows], edge[rows] = pivot, d
        # each subtree (pivot, d) is next; its first row becomes the node, which keeps this parent and edge
        key = pivot * 65 + d
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
    kids = np.flatnonzero(parent >= 0)
    order = kids[np.lexsort((edge[kids], parent[kids]))]
    at = np.searchsorted(parent[order], np.arange(n + 1))
    return {"child": order, "at": at, "key": parent[order] * 65 + edge[order], "roots": roots}


def walk(tree: dict[str, np.ndarray], fp: np.ndarray, query: np.ndarray, root: np.ndarray, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query index, node) of all nodes within r of each query, level by level; query i starts at root[i]."""
    q, node = np.arange(len(query)), root
    while len(q):
        d = np.bitwise_count(query[q] ^ fp[node]).astype(np.int64)
        hit = d <= r
        yield q[hit], node[hit]
        lo = np.searchsorted(tree["key"], node * 65 + np.maximum(d - r, 0))
        n = np.searchsorted(tree["key"], node * 65 + np.minimum(d + r, 64), side="right") - lo
        q = np.repeat(q, n)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q))
        node = tree["child"][at]


class Sets:
    """Union-find over 0..n-1 by vectorised hooking; the root is the smallest member."""

    def __init__(self, n: int):
        self.p = np.arange(n)

    @classmethod
    def of(cls, label: np.ndarray) -> Sets:
        """Rows of equal labels are joined."""
        sets = cls(len(label))
        _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
        sets.p = first[inverse]
        return sets

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            live = x != y
            if not live.any():
                return
            a, b, x, y = a[live], b[live], x[live], y[live]
            np.minimum.at(self.p, np.maximum(x, y), np.minimum(x, y))

    def link(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Join by Boruvka rounds, nearest first; the indices of the pairs that joined two sets."""
        used, key = [], d * (1 << 40) + np.arange(len(a))
        top = np.iinfo(np.int64).max
        while len(key):
            at = key & ((1 << 40) - 1)
            x, y = self.root(a[at]), self.root(b[at])
            live = x != y
            key, x, y = key[live], x[live], y[live]
            best = np.full(len(self.p), top)
            np.minimum.at(best, x, key)
            np.minimum.at(best, y, key)
            pick = np.unique(best[best < top]) & ((1 << 40) - 1)
            self.join(a[pick], b[pick])
            used.append(pick)
        return np.concatenate(used) if used else np.zeros(0, np.int64)

    def root(self, a: np.ndarray) -> np.ndarray:
        x = self.p[a]
        while True:
            y = self.p[x]
            if (x == y).all():
                return x
            self.p[a], x = y, y


def shard_links(node: np.ndarray, fp: np.ndarray, group: np.ndarray, query: np.ndarray, r: int, real: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, node) among fingerprints of each group within r. Rows with query False form the group's
    tree; those with True only ask (a group may hold either or both kinds). real: only pairs that lie within r."""
    tree_rows = np.flatnonzero(~query)
    if not len(tree_rows):
        return node[:0], node[:0]
    t = forest(fp[tree_rows], group[tree_rows])
    root_of = np.full(int(group.max()) + 1, -1)
    root_of[group[tree_rows][t["roots"]]] = t["roots"]
    asks = np.flatnonzero(query | ~np.isin(group, group[query]))  # a tree without asking rows asks itself
    start = root_of[group[asks]]
    asks, start = asks[start >= 0], start[start >= 0]
    sets = Sets(len(node))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(asks), STEP):
        for q, x in walk(t, fp[tree_rows], fp[asks[i : i + STEP]], start[i : i + STEP], r):
            a, b = asks[q + i], tree_rows[x]
            other = a != b
            a, b = a[other], b[other]
            if real:
                used = sets.link(a, b, np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64))
                links.append((node[a[used]], node[b[used]]))
            else:
                sets.join(a, b)
    if real:
        return (np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])) if links else (node[:0], node[:0])
    root = sets.root(np.arange(len(node)))
    moved = np.flatnonzero(root != np.arange(len(node)))
    return node[moved], node[root[moved]]


def block_choice(n: int, radius: int, most: int) -> int:
    """The least j for which n fingerprints leave at most `most` to a value of j of radius + j blocks."""
    j = 1
    while j < 12 and n / 2 ** (64 * j / (radius + j)) > most:
        j += 1
    return j


def near_links(reps: DataFrame, radius: int = 4, shard: int = 8192, count: int | None = None, real: bool = False) -> DataFrame:
    """(a, b): links that span all pairs of reps(node, fp, lane) within the radius in a lane, by trees of at most about
    `shard` nodes. Fingerprints are distinct in a lane. count: the number of fingerprints in a lane, if known."""
    chosen = block_choice(count if count is not None else C.key_count(reps), radius, shard // 2)
    blocks = radius + chosen
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    value = [part[c[0]] if chosen == 1 else F.xxhash64(*[part[i] for i in c]) for c in combinations(range(blocks), chosen)]
    rows = reps.select("node", "fp", "lane", F.posexplode(F.array(*value)).alias("block", "value"))
    at = ["lane", "block", "value"]
    sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    k = F.ceil(F.col("n") / shard).cast("int")
    dealt = rows.join(sizes, at).select("node", "fp", *at, k.alias("k"), F.pmod(F.xxhash64("fp"), k).cast("int").alias("own"))
    # tree t of a value is asked by the value's shards t (itself) and above
    trees = dealt.select("node", "fp", *at, F.explode(F.expr("sequence(own, k - 1)")).alias("asker"), F.col("own").alias("tree"), F.lit(False).alias("query"))
    asks = dealt.select("node", "fp", *at, F.col("own").alias("asker"), F.explode(F.expr("sequence(0, own)")).alias("tree"), F.lit(True).alias("query"))
    both = trees.unionByName(asks.where("asker > tree"))
    keys = [*at, "asker", "tree"]
    n = C.n_shuffle(reps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(b: pa.Table) -> pa.RecordBatch:
            cols = {c: np.asarray(b.column(c)) for c in ("node", "fp", *keys, "query")}
            change = np.zeros(b.num_rows, bool)
            for c in keys:
                change[1:] |= cols[c][1:] != cols[c][:-1]
            x, y = shard_links(cols["node"], cols["fp"].view(np.uint64), np.cumsum(change), cols["query"].astype(bool), radius, real)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 4 * shard:
                table = pa.Table.from_batches(held).combine_chunks()
                last = np.ones(table.num_rows, bool)
                for c in keys:
                    last &= np.asarray(table.column(c)) == table.column(c)[-1].as_py()
                cut = int(np.argmax(last))  # the last group may go on
                if cut:
                    yield flush(table.slice(0, cut).combine_chunks())
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if size:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    # a total order, so that a lost task links the same pairs again
    dealt_out = both.repartition(n, *keys).sortWithinPartitions(*keys, "query", "fp")
    return dealt_out.mapInArrow(run, "a long, b long").distinct()


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes that links (a, b) join to a smaller one, the smallest they reach."""
    held = [np.stack([np.asarray(b.column("a")), np.asarray(b.column("b"))]) for b in batches]
    node, row = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1), return_inverse=True)
    sets = Sets(len(node))
    sets.join(*row.reshape(2, -1))
    root = sets.root(np.arange(len(node)))
    moved = np.flatnonzero(root != np.arange(len(node)))
    for i in range(0, len(moved), 1 << 16):
        part = moved[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(node[root[part]])], names=["node", "root"])


def components(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has a link. Up to `most` links (16 MB) are joined in
    one task, without a shuffle; more, by alternating large-star and small-star rounds, each of which is written to the
    shared folder; the loop ends when nothing changes. Rounds are many queries, whose plans, threads and task records stay
    in the driver for a while: with few links they cost more than the links."""
    edges = C.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    if C.key_count(edges) <= most:
        found = C.materialize(edges.coalesce(1).mapInArrow(joined, "node long, root long"), "edges")
        C.drop_table(edges)
        return found
    raw, edges = edges, C.materialize(edges.distinct(), "edges")
    C.drop_table(raw)
    before = None
    while True:
        # large star: every larger neighbour (and the node itself) goes to the smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = C.materialize(small, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        C.drop_table(edges)
        if tuple(state) == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, before = new, tuple(state)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard: int = 8192) -> DataFrame:
    """(id, fp, component): one row per document with the smallest id reachable over links of at most `radius` bits."""
    prints = C.materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # A fingerprint that only rows without an id have still needs a node; such nodes sort after all ids.
    lone = F.coalesce(F.min("id"), F.lit(2**63 - 1) - F.pmod(F.col("fp"), F.lit(2**62)))
    reps = C.materialize(prints.groupBy("fp").agg(lone.alias("node")), "reps")
    roots = components(near_links(reps.withColumn("lane", F.lit(0)), radius, shard))
    classes = reps.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return prints.join(classes, "fp").select("id", "fp", "component")


def numbered(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shingle hashes of documents off[d]:off[d + 1] with repeats told apart, ascending in each document, so that bags
    become sets: (shingle, occurrence)."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    h = h[C.order_by(doc, h)]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    again = np.arange(len(h)) - first[np.cumsum(head) - 1] if len(h) else np.zeros(0, np.int64)
    return C.mix(h + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_names(w: C.Words) -> np.ndarray:
    return C.hash_ranges(C.load8(w.buf), w.start, w.end - w.start)


def shingle_names(w: C.Words, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every k-word shingle by the hashes of its words, and each document's offsets."""
    first, last, off = C.shingles(w, k)
    join = lambda h, x: C.mix(h * np.uint64(0x2545F4914F6CDD1D) + x)
    whole = np.full(w.n, k, np.uint64)
    for j in range(k):
        whole[: w.n - j] = join(whole[: w.n - j], names[j:])
    h = whole[first]
    short = np.flatnonzero(last - first + 1 < k)  # a document of fewer words
    h[short] = (last - first + 1)[short]
    for j in range(k - 1):
        live = short[first[short] + j <= last[short]]
        h[live] = join(h[live], names[first[live] + j])
    return h, off


def bags_of(w: C.Words, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbered k-word shingles of every document, and each document's offsets."""
    h, off = shingle_names(w, names, k)
    return numbered(h, off), off


def bag_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each bag of numbered shingles: equal for texts of similarity 1 only."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(h), dtype=np.uint64)])
    return C.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): what tells rows apart is the id and the hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def many_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, lanes: int, wide_shingle: int, wide: int) -> DataFrame:
    """(id, h, key, lanes, wide): independent fingerprints of numbered shingles, and the key of the bag of
    `wide_shingle`-word shingles."""

    def column(h: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
        return np.stack([majority(C.mix(h + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))), off) for i in range(n)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                w = C.Words(part.column("text"), lower=True)
                names = word_names(w)
                h, off = bags_of(w, names, wide_shingle)
                a, b = column(*bags_of(w, names, shingle), lanes), column(h, off, wide)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(bag_keys(h, off)), *lists], names=["id", "h", "key", "lanes", "wide"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "id long, h long, key long, lanes array<long>, wide array<long>")


def bits_at(similarity: float, bits: int) -> int:
    """The differing bits, of `bits`, that two shingle bags of this Jaccard similarity are expected to have."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_similarity(a: pa.Array, b: pa.Array, shingle: int) -> np.ndarray:
    """Per row, the similarity of the shingle bags of two texts: sum of least over sum of greatest counts."""

    def bags(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = C.Words(col, lower=True)
        return shingle_names(w, word_names(w), shingle)

    (x, at), (y, to) = bags(a), bags(b)
    out = np.zeros(len(a))
    for i in range(len(a)):
        (u, m), (v, n) = (np.unique(h[o[i] : o[i + 1]], return_counts=True) for h, o in ((x, at), (y, to)))
        _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        low = int(np.minimum(m[p], n[q]).sum())
        out[i] = low / max(1, m.sum() + n.sum() - low)
    return out


def verified(links: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The links (a, b), nodes, whose texts have the similarity."""
    links = C.materialize(links, "unsure")
    texts = C.materialize(texts_of(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows), "texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text_a", 1 << 20):
                good = pa.array(shingle_similarity(part.column("text_a"), part.column("text_b"), shingle) >= similarity)
                yield part.select(["a", "b"]).filter(good)

    return links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def texts_of(asked: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """asked(node, ...) with the text of each node. Only rows that may be asked for are shuffled."""
    own = asked.join(nodes.select("node", "row.id", "row.h"), "node")
    may = C.maybe_in(rows, "h", own.select("h"), "may").where("may").drop("may")
    found = may.groupBy("id", "h").agg(F.first("text").alias("text")).join(own, ["id", "h"])
    return found.select(*asked.columns, F.coalesce("text", F.lit("")).alias("text"))


def common_shingles(rows: DataFrame, shingle: int, share: int = 8, bits: int = 23, levels: int = 10) -> np.ndarray:
    """(levels, 2**bits / 8) bitmaps by shingle hash: shingles seen at least 2, 4, 8, ... times in one of `share`
    documents, chosen by a hash of the text. They only set the order of prefixes, for which any order is lossless, so
    their size is bounded whatever the corpus (10 MB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                pick = C.mix(np.asarray(part.column("h")).view(np.uint64)) % np.uint64(share) == 0
                part = part.filter(pa.array(pick))
                w = C.Words(part.column("text"), lower=True)
                h, _ = bags_of(w, word_names(w), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["token"])

    counts = rows.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = F.explode(F.sequence(F.lit(0), F.least(F.lit(levels - 1), F.floor(F.log2("n")).cast("int") - 1))).alias("level")
    return bitmaps(counts.select("token", level), bits, levels)


def bitmaps(tokens: DataFrame, bits: int, levels: int = 1) -> np.ndarray:
    """(levels, 2**bits / 8) bitmaps of tokens(token, level), made where the tokens are."""
    at = (F.pmod("token", F.lit(1 << bits)) + 1).alias("at")  # bit positions count from 1
    marks = tokens.select(at, "level").groupBy("level", F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = np.zeros((levels, 1 << bits - 3), np.uint8)
    # a local iterator runs a job per partition: few, whatever the number of shuffle partitions
    made = C.materialize(marks, "bitmaps")
    for r in made.coalesce(8).toLocalIterator():
        out[r.level, (r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    C.drop_table(made)
    return out


def commonness(bitmaps: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per shingle hash, how many of the bitmaps hold it."""
    at = (h & np.uint64(bitmaps.shape[1] * 8 - 1)).astype(np.int64)
    return ((bitmaps[:, at >> 3] >> (at & 7).astype(np.uint8)) & 1).sum(axis=0, dtype=np.int64)


def prefixes(rows: DataFrame, common: np.ndarray, similarity: float, shingle: int, only: np.ndarray | None = None) -> DataFrame:
    """(token, node, fp): of each text's n numbered shingles, rarest first, the first n - ceil(similarity * n) + 1, and
    the text's fingerprint by all of them. Texts of at least this similarity have one of these in common: each shares all
    but that many less one of its own. only: a bitmap of the tokens asked for."""
    sc = rows.sparkSession.sparkContext
    shared, chosen = sc.broadcast(common), None if only is None else sc.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                w = C.Words(part.column("text"), lower=True)
                h, off = bags_of(w, word_names(w), shingle)
                key = bag_keys(h, off)
                fp = majority(h, off)
                rank = commonness(shared.value, h)
                n = np.diff(off)
                doc = np.repeat(np.arange(len(n)), n)
                h = h[C.order_by(doc, h, rank)]
                at = np.arange(len(h)) - off[:-1][doc]
                take = at <= (n - np.ceil(similarity * n - 1e-9).astype(np.int64))[doc]
                # equal texts of a batch have equal prefixes
                once = np.zeros(len(n), bool)
                once[np.unique(key, return_index=True)[1]] = True
                take &= once[doc]
                if chosen is not None:
                    take &= commonness(chosen.value, h) > 0
                h, doc = h[take], doc[take]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[doc]), pa.array(fp[doc].view(np.int64))], names=["token", "node", "fp"])

    return rows.mapInArrow(run, "token long, node long, fp long")


def near_blocks(fp: np.ndarray, bits: int, root: np.ndarray, side: np.ndarray, wide: np.ndarray, wide_bits: int, sets: Sets | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y), x ascending, of different roots and sides (side 0: any) whose fingerprints differ in at most `bits`
    bits, and whose wide fingerprints (one row each) in at most `wide_bits`. sets: without pairs that it joined before
    their block began."""
    for k in range(0, len(fp), 256):
        a = slice(k, k + 256)
        near = np.bitwise_count(fp[a, None] ^ fp[None, k:]) <= bits
        near &= root[a, None] != root[None, k:]
        near &= (side[a, None] != side[None, k:]) | (side[a, None] == 0)
        if sets is not None:
            part = sets.root(np.arange(k, len(fp)))
            near &= part[:256, None] != part[None]
        x, y = np.nonzero(near)
        x, y = x[y > x] + k, y[y > x] + k
        for j in range(0, len(x), 1 << 17):
            p, q = x[j : j + (1 << 17)], y[j : j + (1 << 17)]
            good = np.bitwise_count(wide[p] ^ wide[q]).sum(axis=1, dtype=np.int64) <= wide_bits
            yield p[good], q[good]


def near_pairs(fp: np.ndarray, bits: int, root: np.ndarray, side: np.ndarray, wide: np.ndarray, wide_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near_blocks()."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near_blocks(fp, bits, root, side, wide, wide_bits)]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def similar_links(blocks: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, off: np.ndarray, similarity: float, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the pairs of rows (x, y) whose bags have the similarity; row i has the distinct shingles
    ids[off[i]:off[i + 1]]. sets holds what is joined before, and is joined further."""
    size = np.diff(off)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for p, q in blocks:
        cut = np.flatnonzero(np.diff(p, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(p)], strict=True):
            x, y = p[a : a + 1], q[a:b]
            n, own = size[y], size[x]
            may = (np.minimum(n, own) >= similarity * np.maximum(n, own) - 1e-6) & (n > 0) & (sets.root(y) != sets.root(x))
            y, n = y[may], n[may]
            if not len(y):
                continue
            start = np.cumsum(n) - n
            bag = ids[off[x[0]] : off[x[0] + 1]]
            mark[bag] = True
            low = np.add.reduceat(mark[ids[np.repeat(off[y] - start, n) + np.arange(n.sum())]], start, dtype=np.int64)
            mark[bag] = False
            y = y[low / (own + n - low) >= similarity]
            y = y[np.unique(sets.root(y), return_index=True)[1]]  # one link to a set
            sets.join(np.repeat(x, len(y)), y)
            out.append((np.repeat(x, len(y)), y))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def nearest(fp: np.ndarray, bits: int, each: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y): of every row, the `each` other rows with the nearest fingerprints, within `bits` bits."""
    out = []
    for k in range(0, len(fp), 256):
        d = np.bitwise_count(fp[k : k + 256, None] ^ fp[None, :])
        d[np.arange(len(d)), np.arange(k, k + len(d))] = 255
        y = np.argpartition(d, min(each, d.shape[1] - 1), axis=1)[:, :each]
        good = np.take_along_axis(d, y, axis=1) <= bits
        out.append((np.nonzero(good)[0] + k, y[good]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], cols: list[str], most: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, int]]:
    """Sorted batches as tables of whole groups: (columns, starts of the groups, 0). A group of more than `most` rows
    comes as its first row and its size."""
    held: list[dict[str, np.ndarray]] = []
    size = beyond = 0

    def column(batch: pa.RecordBatch, c: str) -> np.ndarray:
        x = batch.column(c)
        return np.asarray(x.flatten()).reshape(len(x), -1) if pa.types.is_list(x.type) else np.asarray(x)

    def table() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in keys + cols}

    def starts(t: dict[str, np.ndarray]) -> np.ndarray:
        head = np.ones(len(t[keys[0]]), bool)
        for i, c in enumerate(keys):
            head[1:] = (t[c][1:] != t[c][:-1]) | (head[1:] if i else False)
        return np.flatnonzero(head)

    for batch in batches:
        held.append({c: column(batch, c) for c in keys + cols})
        size += batch.num_rows
        if size < 1 << 17:
            continue
        t = table()
        at = starts(t)
        last = int(at[-1])
        if beyond and last:  # the large group ends
            end = int(at[1])
            yield {c: v[:1] for c, v in t.items()}, at[:1], beyond + end
            t, at, last, beyond = {c: v[end:] for c, v in t.items()}, at[1:] - end, last - end, 0
        if last:
            yield {c: v[:last] for c, v in t.items()}, at[:-1], 0
        rest = {c: v[last:] for c, v in t.items()}
        if len(rest[keys[0]]) > most:
            beyond += len(rest[keys[0]]) - 1
            rest = {c: v[:1] for c, v in rest.items()}
        held, size = [rest], len(rest[keys[0]])
    if size:
        t = table()
        at = starts(t)
        if beyond:
            end = int(at[1]) if len(at) > 1 else len(t[keys[0]])
            yield {c: v[:1] for c, v in t.items()}, at[:1], beyond + end
            t, at = {c: v[end:] for c, v in t.items()}, at[1:] - end
        if len(at):
            yield t, at, 0


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def ordered_pairs(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = np.maximum(node[x], node[y]), np.minimum(node[x], node[y])
    return np.stack([a, b], axis=1)[a != b]


def pair_batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
    found = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(np.zeros(len(found), np.int64))], schema=PAIRS)


def prefix_pairs(tokens: DataFrame, bits: int, most: int = 128) -> DataFrame:
    """(a, b, 0): pairs of nodes that share a token and whose fingerprints differ in at most `bits` bits: all of tokens
    with up to `most` nodes, the nearest of each node of larger ones. (token, null, n): tokens with n > most nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at, large in grouped(batches, ["token"], ["node", "fp"], 1 << 15):
            node, fp = t["node"], t["fp"].view(np.uint64)
            hot, pairs = [(int(t["token"][0]), large)] if large else [], []
            if not large:
                size = np.diff(np.append(at, len(node)))
                for s in np.unique(size[size > 1]).tolist():
                    heads = at[size == s]
                    if s > most:
                        for h in heads.tolist():
                            x, y = nearest(fp[h : h + s], bits)
                            pairs.append(ordered_pairs(node[h : h + s], x, y))
                            hot.append((int(t["token"][h]), s))
                        continue
                    i, j = np.triu_indices(s, 1)
                    step = max(1, (1 << 20) // len(i))
                    for k in range(0, len(heads), step):
                        x, y = (heads[k : k + step, None] + i).ravel(), (heads[k : k + step, None] + j).ravel()
                        near = np.bitwise_count(fp[x] ^ fp[y]) <= bits
                        pairs.append(ordered_pairs(node, x[near], y[near]))
            yield pair_batch(pairs)
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in hot], pa.int64()), pa.array([None] * len(hot), pa.int64()), pa.array([n for _, n in hot], pa.int64())], schema=PAIRS)

    dealt = tokens.repartition(C.n_shuffle(tokens.sparkSession), "token").sortWithinPartitions("token", "node")
    return dealt.mapInArrow(run, "a long, b long, n long").distinct()


def paired_shards(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, node, k, ...), each key dealt into k shards by its node, once for every pair of shards (lo, hi) that its
    own is in. side: 1 in lo, 2 in hi, 0 if they are one."""
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    group = F.explode(F.expr("transform(sequence(0, k - 1), x -> struct(least(x, own) as lo, greatest(x, own) as hi))"))
    side = F.when(F.col("pair.lo") == F.col("pair.hi"), 0).otherwise(F.when(F.col("own") == F.col("pair.lo"), 1).otherwise(2)).alias("side")
    paired = rows.withColumn("own", own).withColumn("pair", group).select(*rows.columns, "pair.lo", "pair.hi", side).drop("k")
    keys = [key, "lo", "hi"]
    return paired.repartition(C.n_shuffle(rows.sparkSession), *keys).sortWithinPartitions(*keys, "node")


def hot_links(tokens: DataFrame, hot: DataFrame, nodes: DataFrame, bits: int, wide_bits: int, shard: int = 1 << 12) -> DataFrame:
    """(a, b): links that span, but need not be, all pairs of nodes(node, root, wide) of different roots that share a token
    of hot(token, n) and whose fingerprints differ in at most `bits` and `wide_bits` bits. A token of many nodes is dealt
    into shards; every pair of shards is a group. A task returns at most one link per node."""
    known = tokens.join(hot.select("token", F.ceil(F.col("n") / shard).cast("int").alias("k")), "token").join(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at, _ in grouped(batches, ["token", "lo", "hi"], ["node", "fp", "root", "side", "wide"], 1 << 62):
            node, row = np.unique(t["node"], return_inverse=True)
            sets = Sets(len(node))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(row)], strict=True):
                own = Sets.of(sets.root(row[a:b]))
                for x, y in near_blocks(t["fp"][a:b].view(np.uint64), bits, t["root"][a:b], t["side"][a:b], t["wide"][a:b].view(np.uint64), wide_bits, own):
                    own.join(x, y)
                    sets.join(row[a:b][x], row[a:b][y])
            root = sets.root(np.arange(len(node)))
            moved = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["a", "b"])

    rows = paired_shards(known.select("token", "node", "fp", "root", "wide", "k"), "token")
    return rows.mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches with a text as tables of whole groups and the starts of these: about `most` bytes, or one group."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        head = np.ones(t.num_rows, bool)
        for i, c in enumerate(keys):
            x = np.asarray(t.column(c))
            head[1:] = (x[1:] != x[:-1]) | (head[1:] if i else False)
        return np.flatnonzero(head)

    for batch in batches:
        for part in C.slices(batch, "text", 1 << 20):
            held.append(part)
            if sum(b.nbytes for b in held) < most:
                continue
            t = pa.Table.from_batches(held)
            at = starts(t)
            last = int(at[-1])  # this group may go on
            if last:
                yield t.slice(0, last), at[:-1]
            held = t.slice(last).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def compared(links: DataFrame, placed: DataFrame, nodes: DataFrame, rows: DataFrame, bits: int, wide_bits: int, similarity: float, shingle: int, shard: int = 1 << 12, shard_bytes: int = 1 << 23) -> DataFrame:
    """(a, b): spanning links among all pairs of placed(node, root, wide) of different roots that links join, directly or
    not, whose fingerprints differ in at most `bits` and `wide_bits` bits and whose texts have the similarity. The texts
    of each component go to its tasks, one for every pair of its shards, and are compared there; pairs do not leave it."""
    found = components(links)
    blobs = found.select("node", F.col("root").alias("blob")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("blob")).distinct())
    texts = C.materialize(texts_of(blobs, nodes, rows), "texts")
    n = F.count(F.lit(1))
    # shards that fit a task; a smaller component is spread over tasks too, by at most eight shards
    room = F.greatest(F.ceil(n / shard), F.ceil(F.sum(F.octet_length("text")) / shard_bytes), F.least(F.lit(8), F.ceil(n / 256)))
    known = texts.join(texts.groupBy("blob").agg(room.cast("int").alias("k")), "blob").join(placed, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["blob", "lo", "hi"], shard_bytes):
            bags, fps = [], []
            for batch in t.to_batches():
                for part in C.slices(batch, "text", 1 << 20):
                    w = C.Words(part.column("text"), lower=True)
                    h, off = bags_of(w, word_names(w), shingle)
                    bags.append((h, np.diff(off)))
                    fps.append(majority(h, off))
            fp = np.concatenate(fps)
            ids = np.unique(np.concatenate([h for h, _ in bags]), return_inverse=True)[1].astype(np.int32)
            off = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in bags]))])
            node, root, side = (np.asarray(t.column(c)) for c in ("node", "root", "side"))
            wide = np.asarray(t.column("wide").combine_chunks().flatten()).reshape(len(node), -1).view(np.uint64)
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(node)], strict=True):
                sets = Sets.of(root[a:b])
                x, y = similar_links(near_blocks(fp[a:b], bits, root[a:b], side[a:b], wide[a:b], wide_bits, sets), ids, off[a : b + 1], similarity, sets)
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b][x]), pa.array(node[a:b][y])], names=["a", "b"])

    return paired_shards(known.select("blob", "node", "root", "wide", "text", "k"), "blob").mapInArrow(run, "a long, b long")


def similar_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    shingle: int = 5,
    candidate_shingle: int = 2,
    lanes: int = 4,
    wide: int = 16,
    margin: float = 0.12,
    prefix_bits: int = 24,
    radius: int = 4,
    shard: int = 8192,
) -> DataFrame:
    """(id, h, root): one row per row of docs with the hash of its text and its class."""
    rows = rows_of(docs, id_col, text_col)
    prints = C.materialize(many_fingerprints(docs, id_col, text_col, candidate_shingle, lanes, shingle, wide), "fingerprints")
    nodes = C.materialize(prints.groupBy(F.col("key").alias("node")).agg(F.min(F.struct("id", "h")).alias("row"), F.first("lanes").alias("lanes"), F.first("wide").alias("wide")), "nodes")
    # SimHash: links that join the bulk of large classes; whatever it misses or thins out is left to the prefixes
    per_lane = nodes.select("node", F.posexplode("lanes").alias("lane", "fp"))
    reps = C.materialize(per_lane.groupBy("lane", "fp").agg(F.min("node").alias("node")), "reps")
    equal = per_lane.join(reps.withColumnRenamed("node", "b"), ["lane", "fp"]).where("node <> b").select(F.col("node").alias("a"), "b")
    near = near_links(reps, radius, shard, count=-(-C.key_count(reps) // lanes), real=True)
    links = equal.unionByName(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    most_bits = bits_at(max(0.0, similarity - margin), 64 * wide)

    def told(pairs: DataFrame) -> DataFrame:
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("wide").alias(f"wide_{c}"))
        differ = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", differ.alias("bits")).where(F.col("bits") <= most_bits)

    def checked(pairs: DataFrame) -> DataFrame:
        """Of each node, the nearest pair and the one with the least node, if the texts agree."""
        best = pairs.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x"), F.min("b").alias("y"))
        return verified(best.select("a", F.explode(F.array_distinct(F.array("x.b", "y"))).alias("b")), nodes, rows, similarity, shingle)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs that no links join yet."""
        root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)

    def decided(pairs: DataFrame, good: DataFrame) -> DataFrame:
        """good with the links of these pairs: the nearest first, then, pair by pair, what these leave apart."""
        near = C.materialize(told(apart(pairs, components(good))), "pairs")
        good = C.materialize(good.unionByName(checked(near)), "good")
        C.let_go(docs.sparkSession)
        left = apart(near.select("a", "b"), components(good))
        return C.materialize(good.unionByName(verified(left, nodes, rows, similarity, shingle)), "good")

    good = C.materialize(checked(told(links)), "good")
    C.let_go(docs.sparkSession)  # after each step, so that the driver holds the queries of one
    # prefixes: every pair of the similarity shares a token
    common = common_shingles(rows, shingle)
    maybe = C.materialize(prefix_pairs(prefixes(rows, common, similarity, shingle), prefix_bits), "maybe")
    C.let_go(docs.sparkSession)
    good = decided(maybe.where("n = 0").select("a", "b"), good)
    C.let_go(docs.sparkSession)
    # tokens of many nodes: most nodes are of one class by now; all pairs of different classes, compared where they meet
    hot = maybe.where("n > 0").groupBy(F.col("a").alias("token")).agg(F.max("n").alias("n"))
    some = prefixes(rows, common, similarity, shingle, bitmaps(hot.select("token", F.lit(0).alias("level")), 23))
    placed = nodes.select("node", "wide").join(components(good), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "wide")
    more = compared(hot_links(some, hot, placed, prefix_bits, most_bits), placed, nodes, rows, prefix_bits, most_bits, similarity, shingle)
    C.let_go(docs.sparkSession)
    final = components(good.unionByName(more))
    return prints.select("id", "h", F.col("key").alias("node")).join(final, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, component): one row per row of docs, with the smallest id of its class; ids are not null. Documents link if
    the similarity of their `shingle`-word shingles is at least `similarity`, as told by the texts."""
    rows = C.materialize(similar_rows(docs, id_col, text_col, **how), "classes")
    return rows.join(rows.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each class of similar_documents(), the one with the smallest id (null: last; of one id,
    the least hash of the text)."""
    key, h = C.fresh(docs, "row_key", "row_hash")
    text = F.col(text_col).cast("string")
    marked = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1) - F.pmod(F.xxhash64(text), F.lit(2**62)))).withColumn(h, F.xxhash64(text))
    classes = C.materialize(similar_rows(marked, key, text_col, **how).groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("n")), "classes")
    roots = C.materialize(classes.groupBy("root").agg(F.min(F.struct("id", "h", "n")).alias("x"), F.sum("n").alias("rows")), "roots")
    # rows alone in their class stay without a shuffle; the others, and few more, meet the list of those that stay. That
    # list grows with the corpus: the join is by key at every size, never a broadcast
    shared = classes.join(roots.where("rows > 1").select("root"), "root", "left_semi").select(F.col("h").alias(h))
    (maybe,) = C.fresh(marked, "row_maybe")
    sieved = C.maybe_in(marked, h, shared, maybe)
    once, more = (roots.select("x.*").where(w).select(F.col("id").alias(key), F.col("h").alias(h)) for w in ("n = 1", "n > 1"))
    met = sieved.where(maybe)
    one = met.join(once.hint("merge"), [key, h], "left_semi")
    several = met.join(more, [key, h], "left_semi").dropDuplicates([key, h])
    return sieved.where(~F.col(maybe)).unionByName(one).unionByName(several).drop(key, h, maybe)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
