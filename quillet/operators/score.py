"""Scoring findings against a manifest of defects that are known to be there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import findings as K

PLACE = ["table", "column"]


def _places(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(f"{prefix}_{c}") if c in PLACE else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def score_checks(findings: DataFrame, defects: DataFrame, clean: DataFrame) -> DataFrame:
    """(outcome, rule, table, column): found and missed defects (rule, table, column), and findings at clean places.

    defects whose rule is null are covered by no check: converted if any rule's finding at their place counts one of
    their counts (array<long>), else uncovered.
    """
    f = _places(findings.select("rule", "table", "column", "count", "origin"), "f")
    d = _places(defects, "d")
    same = (F.col("f_table") == F.col("d_table")) & (F.col("f_column") == F.col("d_column"))
    checked = d.where("d_rule IS NOT NULL")
    hit = checked.join(f, same & (F.col("f_rule") == F.col("d_rule")), "left_semi").select(F.lit("found").alias("outcome"), *[F.col(f"d_{c}").alias(c) for c in ("rule", *PLACE)])
    miss = checked.join(f, same & (F.col("f_rule") == F.col("d_rule")), "left_anti").select(F.lit("missed").alias("outcome"), *[F.col(f"d_{c}").alias(c) for c in ("rule", *PLACE)])
    open_ = d.where("d_rule IS NULL")
    credit = same & (F.col("f_origin") == "rule") & F.array_contains("d_counts", F.col("f_count"))
    turned = open_.join(f, credit, "left_semi").select(F.lit("converted").alias("outcome"), *[F.col(f"d_{c}").alias(c) for c in ("rule", *PLACE)])
    left = open_.join(f, credit, "left_anti").select(F.lit("uncovered").alias("outcome"), *[F.col(f"d_{c}").alias(c) for c in ("rule", *PLACE)])
    c = _places(clean.select(*PLACE), "d").distinct()
    false = f.join(c, same, "left_semi").select(F.lit("false positive").alias("outcome"), *[F.col(f"f_{x}").alias(x) for x in ("rule", *PLACE)])
    return hit.unionByName(miss).unionByName(turned).unionByName(left).unionByName(false)


def summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def invalid_targets(defects: DataFrame) -> DataFrame:
    """Defects (id, count_query, counts) whose own query does not give one of their counts."""
    spark = defects.sparkSession
    rows = [r for r in defects.collect() if r["count_query"]]
    told = K.measure(spark, {str(i): r["count_query"] for i, r in enumerate(rows)}, trusted=False)
    bad = [(r["id"], told[str(i)]) for i, r in enumerate(rows) if told[str(i)] not in r["counts"]]
    return spark.createDataFrame(bad, "id string, measured long")


def match_claims(claims: DataFrame, targets: DataFrame, noise: DataFrame) -> DataFrame:
    """claims (run, table, column, count) with target id, or what noise (table, column, why) explains, or neither."""
    c, t, n = _places(claims, "c"), _places(targets.select("id", *PLACE, "counts"), "t"), _places(noise, "n")
    credited = c.join(t, (F.col("c_table") == F.col("t_table")) & (F.col("c_column") == F.col("t_column")) & F.array_contains("t_counts", F.col("c_count")), "left")
    told = credited.join(n, (F.col("c_table") == F.col("n_table")) & (F.col("c_column") == F.col("n_column")), "left")
    return told.select(F.col("c_run").alias("run"), F.col("c_table").alias("table"), F.col("c_column").alias("column"), F.col("c_count").alias("count"), F.col("t_id").alias("target"),
                       F.when(F.col("t_id").isNull(), F.col("n_why")).alias("noise"))


def recall(matched: DataFrame, targets: DataFrame) -> DataFrame:
    """(runs, targets, mean_recall, coverage): the mean share of targets per run, and the share any run found."""
    wanted = targets.agg(F.countDistinct("id").alias("targets"))
    per_run = matched.groupBy("run").agg(F.countDistinct("target").alias("hits"))
    mean = per_run.agg(F.count("*").alias("runs"), F.coalesce(F.avg("hits"), F.lit(0.0)).alias("mean_hits"))
    ever = matched.agg(F.countDistinct("target").alias("ever"))
    one = wanted.join(F.broadcast(mean)).join(F.broadcast(ever))  # single rows
    return one.select("runs", "targets", F.round(F.col("mean_hits") / F.col("targets"), 6).alias("mean_recall"), F.round(F.col("ever") / F.col("targets"), 6).alias("coverage"))


def found_per_target(matched: DataFrame, targets: DataFrame) -> DataFrame:
    """In how many runs each target was found."""
    hits = matched.where("target IS NOT NULL").groupBy(F.col("target").alias("id")).agg(F.countDistinct("run").alias("runs_found"))
    return targets.select("id").join(hits, "id", "left").withColumn("runs_found", F.coalesce("runs_found", F.lit(0)))
