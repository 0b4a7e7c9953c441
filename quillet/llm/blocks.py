"""Splitting hot keys into pairs of bounded blocks, so that no group of rows outgrows a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, materialize


def with_block_pairs(keyed: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """keyed plus blk, lo, hi (int): groups of equal (key, lo, hi) have about 2 * limit rows at most.

    A key with more than limit rows is dealt by a hash of member into blocks, and each block is sent to its
    pairing with every other, so that any two rows of the key meet in exactly one group: in (b, b) if they share
    a block, else in (lo, hi). Counting is one partially aggregated shuffle of the keys; where no key is hot,
    nothing is joined.
    """
    hot = materialize(keyed.groupBy(key).count().where(F.col("count") > limit).select(
        F.col(key).alias("hot_key"), F.ceil(F.col("count") / limit).cast("int").alias("nb")))
    if hot.isEmpty():
        discard(hot)
        return keyed.select("*", *(F.lit(0).alias(c) for c in ("blk", "lo", "hi")))
    joined = keyed.join(hot, F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    joined = joined.withColumn("nb", F.coalesce("nb", F.lit(1)))
    joined = joined.withColumn("blk", F.pmod(F.xxhash64(member), F.col("nb")).cast("int"))
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return joined.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("nb", "other")
