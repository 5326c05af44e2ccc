"""Two-pass external shuffle into shards, with DataFrame functions only.

Law `key`: the shard is the highest of one seeded hash per shard of the id (rendezvous hashing), so the id and the shard
count alone decide, and one more shard takes rows only into itself. Pass one scatters the rows of each shard by a seeded
hash into buckets small enough for memory. Pass two orders each bucket by an inside-out Fisher-Yates shuffle whose draws
are seeded hashes, and numbers it after the buckets before it; the same rows always get the same slots.

A row that occurs very often is counted first, on the map side; its copies are then numbered and dealt by (hash, lump of
copies), so a million equal rows are a million rows of many buckets, in linear time.

Edge cases. A null id is a key of its own; such rows share a shard, and their texts spread them over its buckets. A null
text has 8 bytes. Repeated rows get a slot each. An empty table gives an empty table. Columns of the input named like a
result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

RESULT = ("size", "law", "shard", "slot", "grown_shard")
#: hashes of repeated rows that are broadcast at most; more are joined by key
MOST_BROADCAST = 100_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard, of `shards`, whose seeded hash of the key is highest."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s")))
    return F.array_max(draws)["s"]


def fisher_yates(n: Column, *seed: Column) -> Column:
    """A permutation of 0..n-1: step i puts i at place j = draw(i) and moves what was there to the end."""

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seed, i), (i + 1).cast("long")).cast("int")
        swapped = F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, F.greatest(i - j - 1, F.lit(0))), F.array(F.get(done, j)))
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(swapped)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def _has_map(kind: T.DataType) -> bool:
    """Whether values of this type cannot be hashed."""
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def shuffle_into_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 20, bucket_rows: int = 384, bucket_bytes: int = 4 << 20, lump: int = 32) -> DataFrame:
    """docs with size, law, shard, slot and grown_shard. Buckets hold about bucket_rows rows or bucket_bytes bytes,
    whichever is less; of one repeated row, `lump` copies go together."""
    own = [c for c in docs.columns if c.lower() not in RESULT]
    hashed = [F.col(f"`{c}`") for c in own if not _has_map(docs.schema[c].dataType)]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    row, bucket, mark, copies, no = C.fresh(docs, "row", "bucket", "mark", "copies", "lump")
    placed = docs.select(*[F.col(f"`{c}`") for c in own], size.alias("size"), rendezvous(F.col(id_col), shards, seed).alias("shard"), F.xxhash64(F.lit(seed), *hashed).alias(mark))
    # one row per shard: a shard that a repeated or null id makes large has as many more buckets
    per_shard = {r[0]: max(1, -(-r[1] // bucket_rows), -(-r[2] // bucket_bytes)) for r in placed.groupBy("shard").agg(F.count(F.lit(1)), F.sum("size")).collect()}
    buckets = F.get(F.array(*[F.lit(per_shard.get(i, 1)) for i in range(shards)]), F.col("shard"))
    # marks that many rows share: one row of eight bytes each, counted on the map side first
    marks = placed.groupBy("shard", mark).agg(F.count(F.lit(1)).alias("n"))
    often = marks.where(F.col("n") > lump).select(mark)
    n_often = C.key_count(often)
    box = lambda lumped: F.pmod(F.xxhash64(F.lit(seed), F.col(mark), lumped), buckets).cast("int")
    first = F.lit(0).cast("long")
    single = placed
    if n_often:
        side = F.broadcast(often) if n_often <= MOST_BROADCAST else often
        single = placed.join(side, mark, "left_anti")
        # equal rows collapse before the shuffle; their number is dealt in lumps, so no task ever holds all copies
        packed = placed.join(side, mark, "left_semi").groupBy(*[F.col(f"`{c}`") for c in own], "size", "shard", mark).agg(F.count(F.lit(1)).alias("n"))
        lumps = packed.withColumn(no, F.explode(F.sequence(first, F.expr(f"(n - 1) div {lump}"))))
        lumps = lumps.withColumn(copies, F.least(F.lit(lump), F.col("n") - F.col(no) * lump).cast("int")).drop("n")
        units = single.withColumns({no: first, copies: F.lit(1)}).unionByName(lumps)
    else:
        units = single.withColumns({no: first, copies: F.lit(1)})
    units = units.withColumn(bucket, box(F.col(no)))
    counts = units.groupBy("shard", bucket).agg(F.sum(copies).alias("n"))
    before = F.expr(f"sum(n) over (partition by shard order by `{bucket}` rows between unbounded preceding and 1 preceding)")
    offsets = counts.select("shard", bucket, F.coalesce(before, F.lit(0)).cast("long").alias("first"))
    unit = F.struct(F.col(mark).alias("h"), F.col(no).alias("no"), F.col(copies).alias("copies"), F.struct(*[F.col(f"`{c}`") for c in own], "size").alias("row"))
    boxed = units.groupBy("shard", bucket).agg(F.collect_list(unit).alias("rows"))
    less = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).when(a["no"] < b["no"], -1).when(a["no"] > b["no"], 1).otherwise(0)
    boxed = boxed.select("shard", bucket, F.array_sort("rows", less).alias("rows"))
    every = F.flatten(F.transform("rows", lambda r, i: F.array_repeat(i, r["copies"])))
    boxed = boxed.select("shard", bucket, "rows", every.alias("every"))
    order = fisher_yates(F.size("every"), F.lit(seed), F.col("shard"), F.col(bucket))
    dealt = boxed.join(offsets, ["shard", bucket]).select("shard", "first", "rows", "every", F.posexplode(order).alias("i", "at"))
    out = dealt.select(F.get("rows", F.get("every", F.col("at")))["row"].alias(row), "shard", (F.col("first") + F.col("i")).alias("slot"))
    out = out.select(f"{row}.*", F.lit("key").alias("law"), "shard", "slot")
    return out.withColumn("grown_shard", rendezvous(F.col(id_col), shards + 1, seed))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")
