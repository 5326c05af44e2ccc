"""Working tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder; where none is set, a temporary one if driver and executors are one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        base = tempfile.mkdtemp(prefix="readweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: cuts its lineage and survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/readweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
