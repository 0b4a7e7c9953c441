"""Frames written to the folder that the driver and all executors share, and read again from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, prefix: str = "audit") -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, below a local one, on a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once and read again: what follows neither computes it anew nor loses it with an executor."""
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Within it, settings of the session have other values (their names with __ for dots); jobs must run within it, too."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
