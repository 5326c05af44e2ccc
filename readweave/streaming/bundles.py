"""Bundles of a stream of alignments sorted by contig and position.

State is kept per contig: the open bundles and the last position. When a read starts more than `window` bases after the
last one, every bundle at or before its start minus `window` is closed and comes out; the last bundles of a contig close
by a closing row or an idle time-out. A read that comes late opens its bundle again, as a second one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.tables import work_dir

WINDOW = 1000
OUT = "contig string, pos long, umi string, n long"
STATE = "last long, pos array<long>, umi array<string>, n array<long>"


def close_bundles(window: int, idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, open_ = 0, {}
        if state.exists:
            last, pos, umi, n = state.get
            open_ = {(int(p), u): int(k) for p, u, k in zip(pos, umi, n, strict=True)}
        closed: list[tuple] = []
        if state.hasTimedOut:
            closed = [(key[0], p, u, k) for (p, u), k in open_.items()]
            open_ = {}
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["pos", "ord"])
            for pos, umi in zip(rows["pos"].tolist(), rows["umi"].tolist(), strict=True):
                if pos > last + window:
                    for k in [k for k in open_ if k[0] <= pos - window]:
                        closed.append((key[0], *k, open_.pop(k)))
                last = pos
                if umi is None:
                    continue
                open_[pos, umi] = open_.get((pos, umi), 0) + 1
            state.update((last, [k[0] for k in open_], [k[1] for k in open_], list(open_.values())))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(closed, columns=["contig", "pos", "umi", "n"])

    return run


def streamed(reads: DataFrame, window: int = WINDOW, idle_ms: int | None = None) -> DataFrame:
    """(contig, pos, umi, n) as bundles close, from a streaming frame (ord, contig, pos, umi). With idle_ms, a contig
    without reads for so long closes its bundles."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return reads.groupBy("contig").applyInPandasWithState(close_bundles(window, idle_ms), OUT, STATE, "append", timeout)


def run_once(reads: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stream a batch of reads through streamed() and give what came out. A last row per contig, far behind its last
    read and without a UMI, closes what is open."""
    spark = reads.sparkSession
    base = f"{work_dir(spark)}/readweave/stream-{uuid.uuid4().hex}"
    ends = reads.groupBy("contig").agg((F.max("pos") + 2 * window + 1).alias("pos")).select(F.lit(1 << 62).alias("ord"), "contig", "pos", F.lit(None).cast("string").alias("umi"))
    reads.unionByName(ends).repartition(4, "contig").sortWithinPartitions("contig", "pos", "ord").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(reads.schema).parquet(f"{base}/in")
    out = streamed(stream, window).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")
