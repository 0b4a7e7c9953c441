"""Rules on streams: row conditions as a filter, and violations per window with a watermark."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import Rule, RuleError, violation


def violating_rows(stream: DataFrame, rules: list[Rule], audit_time: datetime) -> DataFrame:
    """The rows that break any of the rules, with the ids of those they break. Only rules about single rows can stream."""
    broken = []
    for r in rules:
        if r.expect in ("unique", "references"):
            raise RuleError(f"rule {r.id!r} looks at more than one row")
        broken.append(F.when(F.expr(violation(r, r.table, r.column or None, audit_time)), F.lit(r.id)))
    return stream.withColumn("broken_rules", F.array_compact(F.array(*broken))).where(F.size("broken_rules") > 0)


def violations_per_window(stream: DataFrame, rules: list[Rule], time_column: str, audit_time: datetime, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, rule, rows): how many rows break each rule per window of the time column; later rows than late are left out."""
    told = violating_rows(stream.withWatermark(time_column, late), rules, audit_time)
    return told.select(time_column, F.explode("broken_rules").alias("rule")).groupBy(F.window(time_column, window).alias("window"), "rule").agg(F.count("*").alias("rows"))
