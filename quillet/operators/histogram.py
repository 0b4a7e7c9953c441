"""The value histogram: how often each value stands in each column of each table, in one shuffle for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_LIKE = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def as_text(df: DataFrame) -> DataFrame:
    """The columns that have a text form, as strings; arrays, maps and structs are left out."""
    return df.select(*[F.col(f"`{f.name.replace('`', '``')}`").cast("string").alias(f.name) for f in df.schema if isinstance(f.dataType, TEXT_LIKE)])


def cells(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """(place, value) of every cell, a frame per text table that has columns; place is the column's place in columns_of(tables)."""
    parts, place = [], 0
    for _, df in sorted(tables.items()):
        if df.columns:
            named = [F.struct(F.lit(place + i).alias("place"), F.col(f"`{c.replace('`', '``')}`").alias("value")) for i, c in enumerate(df.columns)]
            parts.append(df.select(F.inline(F.array(*named))))
            place += len(df.columns)
    return parts


def histogram(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, ordinal, column, value, n); null is a value. Counted before the shuffle, so a hot value costs a row per task.

    Columns are shuffled as numbers and named afterwards. Each table is counted by itself, as no two share a column: so its
    cells go from the scan into the counts without being written as rows for a union.
    """
    names = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(i).alias("ordinal"), F.lit(c).alias("column")) for t, i, c, _ in columns_of(tables)])
    counted = reduce(DataFrame.unionByName, [c.groupBy("place", "value").agg(F.count("*").alias("n")) for c in cells(tables)])
    return counted.withColumn("named", F.get(names, F.col("place"))).select("named.table", "named.ordinal", "named.column", "value", "n")


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """(table, ordinal, name, original header) of every column, in order."""
    return [(n, i, f.name, (f.metadata or {}).get("original", f.name)) for n, d in sorted(tables.items()) for i, f in enumerate(d.schema)]
