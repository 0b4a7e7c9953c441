"""Measurements that users ask for one at a time: queries, keys, references, sample values, claims."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from . import findings as K

MOST_ROWS, MOST_SAMPLES = 10_000, 50


def run_sql(spark: SparkSession, query: str, statistics: tuple[str, ...] = (), limit: int = MOST_ROWS, show_values: bool = False) -> tuple[DataFrame, bool]:
    """The rows of one SELECT over the registered tables, and whether they were cut at limit.

    Columns named in statistics pass if they are numbers; every other cell is shown as its shape. Anything but one
    reading statement over registered views is refused before it runs.
    """
    limit = min(limit, MOST_ROWS)
    if not K.reads_views_only(spark, query):
        raise ValueError("one SELECT at a time, over registered tables")
    found = spark.sql(query)
    got = found.limit(limit + 1).collect()  # run once, so that the rows and the flag agree; limit is at most MOST_ROWS
    limited, cut, shown = spark.createDataFrame(got[:limit], found.schema), len(got) > limit, []
    for f in found.schema:
        c = P.ident(f.name)
        plain = f.name in statistics and isinstance(f.dataType, T.NumericType)
        shown.append(F.col(c) if plain else F.expr(P.redacted(f"cast({c} AS string)", show_values)).alias(f.name))
    return limited.select(*shown), cut


def candidate_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, distinct_keys, rows_in_duplicates, rows_missing_part, is_key) of a tuple of columns; nulls are values."""
    names = [F.col(P.ident(c)) for c in columns]
    gap = F.lit(False)
    for c in columns:
        gap = gap | ~F.expr(P.non_blank(P.ident(c)))
    keys = df.groupBy(F.struct(*names).alias("key")).agg(F.count("*").alias("n"), F.sum(gap.cast("long")).alias("gaps"))
    out = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicates"),
                   F.coalesce(F.sum("gaps"), F.lit(0)).alias("rows_missing_part"))
    return out.withColumn("is_key", (F.col("rows") > 0) & (F.col("rows_in_duplicates") == 0) & (F.col("rows_missing_part") == 0))


def referential_integrity(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """(referencing_rows, orphans, orphan_share): trimmed values of child that parent lacks."""
    c, p = P.ident(column), P.ident(parent_column)
    left = child.where(P.non_blank(c)).groupBy(F.trim(F.col(c)).alias("v")).agg(F.count("*").alias("n"))
    right = parent.where(P.non_blank(p)).select(F.trim(F.col(p)).alias("v"), F.lit(1).alias("known")).distinct()
    sums = left.join(right, "v", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("referencing_rows"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"))
    return sums.withColumn("orphan_share", F.when(F.col("referencing_rows") > 0, F.round(F.col("orphans") / F.col("referencing_rows"), 6)).otherwise(0.0))


def sample_values(df: DataFrame, column: str, k: int = 20, show_values: bool = False) -> DataFrame:
    """The commonest values, redacted, with their share of the values that are not null."""
    c = P.ident(column)
    present = df.where(f"{c} IS NOT NULL").agg(F.count("*").alias("present"))
    top = df.where(P.non_blank(c)).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "v").limit(min(k, MOST_SAMPLES))
    return top.join(F.broadcast(present)).select(F.expr(P.redacted("v", show_values)).alias("value"), "count", (F.col("count") / F.col("present")).alias("share"))


def list_tables(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("table").agg(F.count("*").alias("columns"), F.max("total").alias("rows"))


def describe_table(profiled: DataFrame, table: str) -> DataFrame:
    """A table's columns without cell contents: kind, gaps, distinct values, commonest shape."""
    return profiled.where(F.col("table") == table).orderBy("ordinal").select(
        "column", "kind", "total", "missing", "distinct", "is_unique", F.concat(F.lit("⟨"), F.col("shapes")[0]["value"], F.lit("⟩")).alias("shape"))


def profile_column(profiled: DataFrame, table: str, column: str) -> DataFrame:
    """Everything measured on one column, without cell contents: shapes between brackets, placeholders as they are."""
    one = profiled.where((F.col("table") == table) & (F.col("column") == column)).drop("top_values", "min_value", "max_value")
    shown = F.transform("shapes", lambda s: s.withField("value", F.concat(F.lit("⟨"), s["value"], F.lit("⟩"))))
    one = one.withColumn("shapes", shown)
    return one.withColumn("temporal", F.col("temporal").dropFields("min", "max")) if "temporal" in one.columns else one


def known_at(findings: DataFrame, table: str, column: str | None = None) -> DataFrame:
    """Findings already reported at a place."""
    here = findings.where(F.col("table") == table)
    return here if column is None else here.where(F.col("column") == column)


def verify_claims(claims: DataFrame) -> DataFrame:
    """claims (claim, table, column, count_query, claimed) plus rule, measured, accepted and why.

    A claim stands only if its query reads registered views, runs and gives the number claimed, and that is not zero.
    Claims are what people write, so they pass through the driver; their queries run on the tables.
    """
    spark = claims.sparkSession
    rows = claims.collect()
    told = K.measure(spark, {str(i): r["count_query"] for i, r in enumerate(rows)}, trusted=False)
    out = []
    for i, r in enumerate(rows):
        n = told[str(i)]
        why = "its query gives no number" if n is None else "nothing was found" if n == 0 else "" if n == r["claimed"] else f"{n} rows were found"
        out.append(("claim." + re.sub(r"[^a-z0-9]+", "_", r["claim"].lower()).strip("_")[:60], r["claim"], r["table"], r["column"], r["count_query"], r["claimed"], n, not why, why))
    return spark.createDataFrame(out, "rule string, claim string, table string, column string, count_query string, claimed long, measured long, accepted boolean, why string")
