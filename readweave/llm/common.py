"""What the operators share: working tables, Arrow text access, tokenising and hashing of whole batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All functions here work on a whole batch of documents
with numpy; none loops over characters in Python.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one if driver
    and executors are one process (local master); an error otherwise, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        base = tempfile.mkdtemp(prefix="readweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


#: working tables that are not deleted yet, oldest first
_TABLES: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. The table stays
    until drop_table() or clear(), as the frames that read it are evaluated later."""
    path = f"{work_dir(df.sparkSession)}/readweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialize(), once nothing reads it any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        name = f.rsplit("/", 1)[0]
        _delete(spark, name)
        _TABLES[:] = [t for t in _TABLES if t.rsplit("/", 1)[1] != name.rsplit("/", 1)[1]]


def tables() -> int:
    """How many working tables there are: a mark for clear()."""
    return len(_TABLES)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the working tables made after the mark `since` (default: all), but keep's. To be called when every result
    that reads them has been written."""
    kept = {f.rsplit("/", 2)[1] for f in keep.inputFiles()[:1]} if keep is not None else set()
    for name in _TABLES[since:]:
        if name.rsplit("/", 1)[1] not in kept:
            _delete(spark, name)
    _TABLES[since:] = [t for t in _TABLES[since:] if t.rsplit("/", 1)[1] in kept]


def let_go(spark: SparkSession) -> None:
    """Let driver and executors drop what only queries that are over hold: plans, broadcasts, shuffle files. Spark drops
    them once the driver's JVM has collected its garbage; while many small queries run it would grow its heap instead."""
    gc.collect()  # frames that Python holds keep their plans alive
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that do not clash with the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def plus(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """schema with fields added; a field of the same name (in any case) is replaced."""
    new = {n.lower() for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + [T.StructField(n, t) for n, t in fields])


def with_columns(batch: pa.RecordBatch, names: list[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    got = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays([got[n] for n in names], names=names)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text; a longer single text is a part of its own."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 64
    part = np.cumsum(size) // most
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), n], strict=True):
        yield batch.slice(a, b - a)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty), and each row's offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = pc.fill_null(col.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[9:14] = 32
_LOWER = _SPACE.copy()
_LOWER[65:91] += 32


class Words:
    """The words of a batch: buf holds them one space apart, word i at buf[start[i]:end[i]]; document d has words
    doc[d] to doc[d + 1]. buf ends with 16 spaces."""

    def __init__(self, col: pa.Array, lower: bool = False):
        data, off = raw(col)
        a = (_LOWER if lower else _SPACE)[data]
        solid = a != 32
        edge = np.zeros(len(a) + 1, bool)
        edge[off] = True
        before = np.ones(len(a), bool)
        before[1:] = ~solid[:-1]
        first = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.ones(len(a), bool)
        after[:-1] = ~solid[1:]
        last = np.flatnonzero(solid & (after | edge[1:]))
        size = last - first + 1
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        total = int(self.end[-1]) + 1 if len(size) else 0
        self.buf = np.full(total + 16, 32, np.uint8)
        room = np.ones(total, bool)
        room[self.end] = False
        self.buf[:total][room] = a[solid]
        self.doc = np.searchsorted(first, off)
        self.n = len(size)

    def size(self) -> np.ndarray:
        return np.diff(self.doc)


def load8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position, little-endian; buf needs 8 bytes of padding."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf), strides=(1,)).astype(U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0x9FB21C651E98DF25)
    return h ^ (h >> U(32))


def hash_ranges(v8: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by v8 = load8(buf)."""
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    live, i = np.arange(len(start)), 0
    while len(live):
        left = size[live] - i
        v = v8[start[live] + i] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.minimum(left, 8).astype(U)))
        h[live] = mix(h[live] * U(0x2545F4914F6CDD1D) ^ v)
        live, i = live[left > 8], i + 8
    return h


P1, P2, P3, P4, P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(v8: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range, by v8 = load8(buf); ranges of equal length are hashed together."""
    out, s = np.empty(len(start), U), U(seed)
    if not len(start):
        return out
    short = size.astype(np.uint16) if size.max() < 65536 else size
    order = np.argsort(short, kind="stable")
    cut = np.flatnonzero(np.diff(short[order])) + 1
    with np.errstate(over="ignore"):
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
            rows = order[a:b]
            at, n = start[rows], int(size[rows[0]])
            i = 0
            if n >= 32:
                v = [np.full(len(at), x, U) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while i + 32 <= n:
                    for j in range(4):
                        v[j] = _rot(v[j] + v8[at + (i + 8 * j)] * P2, 31) * P1
                    i += 32
                h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
                for x in v:
                    h = (h ^ (_rot(x * P2, 31) * P1)) * P1 + P4
            else:
                h = np.full(len(at), s + P5, U)
            h = h + U(n)
            while i + 8 <= n:
                h = _rot(h ^ (_rot(v8[at + i] * P2, 31) * P1), 27) * P1 + P4
                i += 8
            if i + 4 <= n:
                h = _rot(h ^ ((v8[at + i] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
                i += 4
            while i < n:
                h = _rot(h ^ ((v8[at + i] & U(0xFF)) * P5), 11) * P1
                i += 1
            h = (h ^ (h >> U(33))) * P2
            h = (h ^ (h >> U(29))) * P3
            out[rows] = h ^ (h >> U(32))
    return out


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every k-word shingle, and each document's offsets; a document of fewer words (not none)
    has one shingle, all of its words."""
    n = w.size()
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(w.doc[:-1], count) + np.arange(off[-1]) - np.repeat(off[:-1], count)
    last = first + np.repeat(np.minimum(np.maximum(n, 1), k) - 1, count)
    return first, last, off


def ends_with(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.cast(schema) if b.schema != schema else b


def maybe_in(rows: DataFrame, key: str, asked: DataFrame, out: str, bits: int = 25) -> DataFrame:
    """rows with `out`: false only if the long column `key` is not among those of asked (true for some more). The bitmap
    is built where the data are and has at most 2**bits bits (4 MB), which bounds the broadcast; the more keys it holds,
    the less it spares, but no row is lost."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    bucket, bitmap, place = fresh(rows, "sieve_bucket", "sieve_bits", "sieve_at")
    marks = asked.select(at(key).alias(place)).groupBy(F.expr(f"bitmap_bucket_number({place})").alias(bucket)).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias(bitmap))
    placed = rows.withColumn(place, at(key)).withColumn(bucket, F.expr(f"bitmap_bucket_number({place})"))
    byte = f"conv(hex(substring({bitmap}, cast(bitmap_bit_position({place}) div 8 + 1 as int), 1)), 16, 10)"
    bit = F.expr(f"(cast({byte} as int) >> cast(bitmap_bit_position({place}) % 8 as int)) & 1 = 1")
    return placed.join(F.broadcast(marks), bucket, "left").withColumn(out, F.coalesce(bit, F.lit(False))).drop(bucket, bitmap, place)


def order_by(doc: np.ndarray, h: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """The order by (doc, rank, h), by one sort of a packed key; where the packing has ties, by all keys."""
    docs = int(doc[-1] if len(doc) else 0).bit_length()  # doc ascends
    ranks = int(rank.max(initial=0)).bit_length() if rank is not None else 0
    if not 0 < 64 - docs - ranks < 64:
        return np.lexsort((h, doc) if rank is None else (h, rank, doc))
    key = h >> U(docs + ranks)
    if ranks:
        key |= rank.astype(U) << U(64 - docs - ranks)
    key |= doc.astype(U) << U(64 - docs)
    order = np.argsort(key)
    key = key[order]
    tie = np.flatnonzero(key[1:] == key[:-1])
    if len(tie) and (h[order[tie]] != h[order[tie + 1]]).any():
        return np.lexsort((h, doc) if rank is None else (h, rank, doc))
    return order


def key_count(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1))).first()[0]
