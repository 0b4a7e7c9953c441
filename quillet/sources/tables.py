"""Columnar tables as text tables: what the checks and rules read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import predicates as P
from ..operators.histogram import as_text


def read_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Parquet paths by table name, each column as text (nested columns are left out), registered as views."""
    return registered({name: as_text(spark.read.parquet(path)) for name, path in paths.items()})


def registered(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, also as temporary views of their names, which evidence queries select from."""
    for name, df in tables.items():
        df.createOrReplaceTempView(P.ident(name))
    return tables
