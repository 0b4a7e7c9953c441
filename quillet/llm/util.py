"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in these operators.
BLANK = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local one, on a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillet-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Within it, a job's shuffle files go when the job ends: what is written is read from its files, never computed again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark)
    with tidy(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillet_path = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete what materialize() wrote, or one partition of it; df, or that part of it, must not be used afterwards."""
    path = getattr(df, "_quillet_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(*columns: Column) -> Column:
    """A double in (0, 1) that depends on the columns' values only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores put before it until no column in taken clashes (case-insensitive, as Spark resolves)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name
