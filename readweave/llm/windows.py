"""Repeated windows of a fixed length over a whole corpus, without moving text that repeats nowhere.

Documents are packed into compressed chunks once. Each window is named by something its own content determines (see the
two schemes), so equal windows have equal names; consecutive windows with one name and place form a run. Then:

1. per chunk, the distinct names go to buckets by name, four bytes each; a bucket tells each chunk which names occur
   again. Names that do not cannot belong to a repeated window.
2. a name with more than `hot` runs in all (a passage or a turn of phrase that very many documents hold) is hot: its
   windows are named one by one, by a hash of their whole content, and step 1 is done again for these names.
3. per chunk, the distinct contexts of the names that occur again go to the buckets: the text from the start of a run's
   first window to the end of its last, or the single windows of hot names. Equal contexts merge, and the windows of the
   rest are compared exactly. Each chunk gets back one bit per window.
4. per chunk, the bits are laid over the text.

What surrounds a shared passage differs in every document. Without step 2 all these contexts would meet under the
passage's name; with it only equal windows meet, once per chunk, and a name that is not hot has at most `hot` contexts.
So buckets keep about `bucket_bytes` of text and chunks `chunk_bytes`, however large the corpus and however common a
passage. Everything after packing is a function of the packed table, so lost tasks give the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64


@dataclass
class Runs:
    """Runs of windows of a chunk: name, first window and number of windows (in units of the scheme), row of the
    document, and the context buf[a:b]."""

    name: np.ndarray
    first: np.ndarray
    count: np.ndarray
    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    buf: np.ndarray


class Scheme:
    """What differs between bytes and words."""

    sums = False  # values of equal contexts are added (else: the least counts)
    hot = 4096  # runs of a name in all chunks, beyond which its windows go one by one

    def runs(self, text: pa.Array) -> Runs:
        raise NotImplementedError

    def values(self, ids: pa.Array) -> np.ndarray:
        """One value per row."""
        raise NotImplementedError

    def windows(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context, start and size of every window of the contexts buf[a:b]; windows in order."""
        raise NotImplementedError

    def classes(self, v8: np.ndarray, start: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A class per window: equal if and only if the bytes are, but a window that cannot matter may be alone."""
        raise NotImplementedError


def group_equal(v8: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, class) of byte ranges; equal classes are equal bytes, verified: the class is the index of its first
    member in the order of hashes."""
    h = C.hash_ranges(v8, start, size)
    order = np.lexsort((np.arange(len(h)), size, h))
    hs, ss = h[order], size[order]
    head = np.ones(len(h), bool)
    head[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
    leader = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(h) else order
    cls = np.empty(len(h), np.int64)
    cls[order] = leader
    live, i = np.flatnonzero(cls != np.arange(len(h))), 0
    wrong = []
    while len(live):
        mask = U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.minimum(size[live] - i, 8).astype(U))
        bad = ((v8[start[live] + i] ^ v8[start[cls[live]] + i]) & mask) != 0
        wrong += live[bad].tolist()
        i += 8
        live = live[~bad & (size[live] > i)]
    if wrong:  # a collision of 64-bit hashes: these classes are told apart by their bytes
        text = np.ascontiguousarray(v8).view(np.uint8)[::8].tobytes()
        known: dict[bytes, int] = {}
        for j in wrong:
            cls[j] = known.setdefault(text[start[j] : start[j] + size[j]], j)
    return h, cls


def pack(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, size, blob): documents (id, text) in compressed chunks of about chunk_bytes."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).cast(schema).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_table(table)
            cols = [pa.array([base + seq]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "size", "blob"])

        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                held.append(part)
                size += C.raw(part.column("text"))[1][-1] + 16 * part.num_rows
                if size >= chunk_bytes:
                    yield out()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield out()

    return docs.mapInArrow(run, "chunk long, size long, blob binary")


def unpack(blob: bytes) -> tuple[pa.Array, pa.Array]:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    if not table.num_rows:
        return pa.array([], pa.int64()), pa.array([], pa.large_string())
    return table.column("id").chunk(0), table.column("text").chunk(0)


def _zip(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unzip(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    size = np.frombuffer(data, np.int64, n, 8)
    at = 8 * (n + 1)
    out = []
    for s, k in zip(size.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, k, s // np.dtype(k).itemsize, at))
        at += s
    return out


def _split(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
        if b > a:
            yield int(bucket[a]), a, b


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Layer:
    """Runs by name: the distinct names by bucket and, of those that take() picks, the distinct contexts by bucket.
    value: one per run; times: how often each run occurs in the chunk."""

    def __init__(self, scheme: Scheme, runs: Runs, value: np.ndarray, times: np.ndarray | None, buckets: int):
        self.scheme, self.runs, self.value, self.buckets = scheme, runs, value, buckets
        bucket = (runs.name % U(buckets)).astype(np.int64)
        order = np.lexsort((runs.name, bucket))
        head = np.ones(len(order), bool)
        head[1:] = runs.name[order[1:]] != runs.name[order[:-1]]
        self.name_of = np.empty(len(order), np.int64)
        self.name_of[order] = np.cumsum(head) - 1
        self.first = order[head]
        self.name_bucket = bucket[self.first]
        self.n_runs = np.bincount(self.name_of, times, len(self.first))
        if scheme.sums or times is not None:
            self.multi = self.n_runs > 1
        else:
            v, at = value[order], np.flatnonzero(head)
            self.multi = np.minimum.reduceat(v, at) != np.maximum.reduceat(v, at) if len(at) else np.zeros(0, bool)

    def names(self) -> Iterator[tuple[int, bytes]]:
        key = (self.runs.name[self.first] >> U(32)).astype(np.uint32)
        many = self.n_runs > 1
        runs = np.minimum(self.n_runs, 65535).astype(np.uint16)
        for b, i, j in _split(self.name_bucket):
            bits = np.packbits(np.stack([self.multi[i:j], many[i:j]]), axis=None)
            yield b, np.uint32(j - i).tobytes() + key[i:j].tobytes() + bits.tobytes() + runs[i:j][many[i:j]].tobytes()

    def flags(self, notes: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per name: it occurs again; it is hot."""
        again, hot = np.zeros(len(self.first), bool), np.zeros(len(self.first), bool)
        for b, i, j in _split(self.name_bucket):
            if b in notes:
                again[i:j], hot[i:j] = np.unpackbits(np.frombuffer(notes[b], np.uint8), count=2 * (j - i)).reshape(2, -1)
        return again, hot

    def take(self, names: np.ndarray) -> None:
        """Find the distinct contexts of the runs of these names (True)."""
        r = self.runs
        self.live = live = np.flatnonzero(names[self.name_of])
        h, cls = group_equal(C.load8(r.buf), r.a[live], r.b[live] - r.a[live])
        bucket = (r.name[live] % U(self.buckets)).astype(np.int64)
        lead = np.flatnonzero(cls == np.arange(len(cls)))
        lead = lead[np.lexsort((r.a[live[lead]], h[lead], bucket[lead]))]
        place = np.empty(len(cls), np.int64)
        place[lead] = np.arange(len(lead))
        self.context_of = place[cls]
        self.lead, self.context_bucket = live[lead], bucket[lead]
        self.context_value = self.merged(self.value[live])
        self.off = np.concatenate([[0], np.cumsum(r.count[self.lead])])  # of the windows of all contexts

    def merged(self, value: np.ndarray) -> np.ndarray:
        """The values of live runs, merged by context."""
        out = np.zeros(len(self.lead), np.int64) if self.scheme.sums else np.full(len(self.lead), np.iinfo(np.int64).max)
        (np.add if self.scheme.sums else np.minimum).at(out, self.context_of, value)
        return out

    def contexts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, sizes, values, text)."""
        r = self.runs
        for b, i, j in _split(self.context_bucket):
            at = self.lead[i:j]
            size = r.b[at] - r.a[at]
            yield b, size.astype(np.uint32), self.context_value[i:j], r.buf[_ranges(r.a[at], size)]

    def spread(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From one bit per window of the contexts: (live run, step, True where repeated) of all windows of live runs."""
        n = self.runs.count[self.live]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = bits[np.repeat(self.off[self.context_of], n) + step]
        if not self.scheme.sums:
            hit = hit | np.repeat(self.value[self.live] > self.context_value[self.context_of], n)
        return np.repeat(self.live, n), step, hit


class Chunk:
    """The runs of a chunk, and the windows of its hot names as a second layer."""

    def __init__(self, scheme: Scheme, blob: bytes, buckets: int):
        self.scheme, self.buckets = scheme, buckets
        self.ids, self.text = unpack(blob)
        runs = scheme.runs(self.text)
        self.base = Layer(scheme, runs, scheme.values(self.ids)[runs.row], None, buckets)

    def flag(self, names: dict[int, bytes]) -> None:
        """Take the bits of step 1: contexts of the names that occur again, windows of the hot ones."""
        again, hot = self.base.flags(names)
        self.hot = None
        if hot.any():
            self.hot = Layer(self.scheme, self.base.runs, self.base.value, None, self.buckets)
            self.hot.take(again & hot)
            r, lead = self.base.runs, self.hot.lead
            n = r.b[lead] - r.a[lead]
            buf = np.concatenate([r.buf[_ranges(r.a[lead], n)], np.full(16, 32, np.uint8)])
            of, at, size = self.scheme.windows(buf, np.cumsum(n) - n, np.cumsum(n))
            name = C.mix(C.hash_ranges(C.load8(buf), at, size) + U(0x5851F42D4C957F2D))
            one = np.ones(len(of), np.int64)
            times = np.bincount(self.hot.context_of, minlength=len(lead))[of]
            self.single = Layer(self.scheme, Runs(name, at, one, of, at, at + size, buf), self.hot.context_value[of], times, self.buckets)
        self.base.take(again & ~hot)

    def flag_windows(self, names: dict[int, bytes]) -> None:
        if self.hot is not None:
            self.single.take(self.single.flags(names)[0])

    def layers(self) -> list[Layer]:
        return [self.base] if self.hot is None else [self.base, self.single]

    def contexts(self) -> Iterator[tuple[int, bytes]]:
        by: dict[int, list] = {}
        for layer in self.layers():
            for b, *parts in layer.contexts():
                by.setdefault(b, []).append(parts)
        for b, parts in sorted(by.items()):
            yield b, _zip(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def removed(self, verdicts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first window, True where it is repeated) of all windows of live runs, as flat arrays."""
        layers = self.layers()
        bits = [np.zeros(x.off[-1], bool) for x in layers]
        used: dict[int, int] = {}
        got = {b: np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(v), np.uint8)) for b, v in verdicts.items()}
        for x, y in zip(layers, bits, strict=True):
            for b, i, j in _split(x.context_bucket):
                n, at = int(x.off[j] - x.off[i]), used.get(b, 0)
                y[x.off[i] : x.off[j]] = got[b][at : at + n]
                used[b] = at + n
        run, step, hit = self.base.spread(bits[0])
        first = self.base.runs.first[run] + step
        if self.hot is None:
            return first, hit
        window, _, one = self.single.spread(bits[1])
        repeated = np.zeros(len(self.single.runs.name), bool)
        repeated[window] = one
        run, step, more = self.hot.spread(repeated)
        return np.concatenate([first, self.base.runs.first[run] + step]), np.concatenate([hit, more])


def _find_again(table: pa.Table, kind: int, hot: int) -> pa.Table:
    """Step 1, in a bucket: which names of each chunk occur again, and which are hot."""
    chunks, blobs = table.column("chunk").to_pylist(), table.column("blob").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    keys, multi, runs = [], [], []
    for b in blobs:
        n = int(np.frombuffer(b, np.uint32, 1)[0])
        keys.append(np.frombuffer(b, np.uint32, n, 4))
        bits = -(-2 * n // 8)
        one, many = np.unpackbits(np.frombuffer(b, np.uint8, bits, 4 + 4 * n), count=2 * n).reshape(2, n).astype(bool)
        times = np.ones(n, np.int64)
        times[many] = np.frombuffer(b, np.uint16, offset=4 + 4 * n + bits)
        multi.append(one)
        runs.append(times)
    off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).tolist()
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    again = np.concatenate(multi) | (np.bincount(at, minlength=len(key)) > 1)[at]
    is_hot = (np.bincount(at, np.concatenate(runs), len(key)) > hot)[at] if hot else np.zeros(len(again), bool)
    pairs = list(zip(off[:-1], off[1:], strict=True))
    bits = [np.packbits(np.stack([again[a:b], is_hot[a:b]]), axis=None).tobytes() for a, b in pairs]
    cols = {"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "kind": pa.array([kind] * len(chunks), pa.int32())}
    return pa.table(cols | {"hot": pa.array([bool((again[a:b] & is_hot[a:b]).any()) for a, b in pairs]), "bits": pa.array(bits, pa.binary())})


def _verify(scheme: Scheme, table: pa.Table) -> pa.Table:
    """Step 3, in a bucket: which windows of each chunk's contexts are repeated."""
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    parts = [_unzip(b, np.uint32, np.int64, np.uint8) for b in table.column("blob").to_pylist()]
    size = np.concatenate([p[0] for p in parts]).astype(np.int64)
    value = np.concatenate([p[1] for p in parts])
    entries = [len(p[0]) for p in parts]
    buf = np.concatenate([*[p[2] for p in parts], np.full(16, 32, np.uint8)])
    del parts
    start = np.cumsum(size) - size
    v8 = C.load8(buf)
    _, cls = group_equal(v8, start, size)
    lead = np.flatnonzero(cls == np.arange(len(cls)))
    place = np.empty(len(cls), np.int64)
    place[lead] = np.arange(len(lead))
    context = place[cls]
    merged = np.zeros(len(lead), np.int64) if scheme.sums else np.full(len(lead), np.iinfo(np.int64).max)
    (np.add if scheme.sums else np.minimum).at(merged, context, value)
    of, at, n = scheme.windows(buf, start[lead], start[lead] + size[lead])
    window_class = scheme.classes(v8, at, n, merged[of])
    best = np.zeros(window_class.max(initial=-1) + 1, np.int64) if scheme.sums else np.full(window_class.max(initial=-1) + 1, np.iinfo(np.int64).max)
    (np.add if scheme.sums else np.minimum).at(best, window_class, merged[of])
    result = best[window_class]
    off = np.searchsorted(of, np.arange(len(lead) + 1))
    # back to the entries of each chunk
    count = np.diff(off)[context]
    total = np.concatenate([[0], np.cumsum(count)])
    edge = np.concatenate([[0], np.cumsum(entries)])
    bits = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        c = count[a:b]
        step = np.arange(c.sum()) - np.repeat(total[a:b] - total[a], c)
        got = result[np.repeat(off[context[a:b]], c) + step]
        hit = got >= 2 if scheme.sums else got < np.repeat(value[a:b], c)
        bits.append(zstandard.ZstdCompressor(level=1).compress(np.packbits(hit).tobytes()))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "kind": pa.array([2] * len(chunks), pa.int32()), "hot": pa.array([False] * len(chunks)), "bits": pa.array(bits, pa.binary())})


BITS = "chunk long, bucket int, kind int, hot boolean, bits binary"
SENT = "bucket int, chunk long, blob binary"


def repeated_windows(docs: DataFrame, scheme: Scheme, finish, schema, chunk_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, hot: int | None = None) -> DataFrame:
    """finish(chunk, first, hit) gives the result batch of each chunk, from its windows and which are repeated."""
    spark = docs.sparkSession
    chunks = C.materialize(pack(docs, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    n = C.n_shuffle(spark)
    buckets = max(n, -(-total // bucket_bytes))

    def sent(rows: list[tuple[int, bytes]], chunk: int) -> pa.RecordBatch:
        cols = [pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "chunk", "blob"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list[dict[int, bytes]]]]:
        for batch in batches:
            for i in range(batch.num_rows):
                notes: list[dict[int, bytes]] = [{}, {}, {}]
                if "notes" in batch.schema.names:
                    for x in batch.column("notes")[i].as_py() or []:
                        notes[x["kind"]][x["bucket"]] = x["bits"]
                yield batch.column("chunk")[i].as_py(), Chunk(scheme, batch.column("blob")[i].as_py(), buckets), notes

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c, _ in each(batches):
            yield sent(list(c.base.names()), k)

    def window_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c, notes in each(batches):
            c.flag(notes[0])
            yield sent(list(c.single.names()) if c.hot is not None else [], k)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c, notes in each(batches):
            c.flag(notes[0])
            c.flag_windows(notes[1])
            yield sent(list(c.contexts()), k)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, notes in each(batches):
            c.flag(notes[0])
            c.flag_windows(notes[1])
            yield finish(c, *c.removed(notes[2]))

    def noted(bits: DataFrame, how: str = "left") -> DataFrame:
        per = bits.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("notes"))
        return chunks.drop("size").join(per, "chunk", how)

    def again(sent_names: DataFrame, kind: int, hot: int) -> DataFrame:
        return C.materialize(sent_names.groupBy("bucket").applyInArrow(lambda t: _find_again(t, kind, hot), BITS), "again")

    first = again(chunks.mapInArrow(names, SENT), 0, scheme.hot if hot is None else hot)
    with_hot = first.join(first.where("hot").select("chunk").distinct(), "chunk", "left_semi")
    second = again(noted(with_hot, "inner").mapInArrow(window_names, SENT), 1, 0)
    known = first.unionByName(second)
    verdicts = noted(known).mapInArrow(contexts, SENT).groupBy("bucket").applyInArrow(lambda t: _verify(scheme, t), BITS)
    return noted(known.unionByName(verdicts)).mapInArrow(finished, schema)
