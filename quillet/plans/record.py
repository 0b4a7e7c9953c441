"""A run's own record: its findings, counted while they are written, then the run's row; and the document made of an audit.

Every try of a run writes under a name of its own and its row is published last. So a run is complete only once all its
findings are there, one that broke is never shown as complete, and writing an id again takes nothing from who reads it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from contextlib import suppress
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import findings as K
from ..operators.profile import withheld

RUNNING, SUCCEEDED, FAILED, CANCELED = "running", "succeeded", "failed", "canceled"
RUN = ("run_id string, attempt string, status string, started timestamp, finished timestamp, duration_ms long, error long, warning long, info long, message string")
#: What a run keeps of its findings, with their place in order and the two names they are kept under.
KEPT = ("id string, rule string, severity string, origin string, title string, remedy string, `table` string, `column` string, count long, total long, share double, "
        "count_query string, row_query string, verified boolean, level string, place long, run_id string, attempt string")
DOCUMENT = "quillet.audit/v1"


def now() -> datetime:
    return datetime.now(timezone.utc)


def _places(exported: DataFrame) -> Column:
    """The key that exported findings are ordered by: the most severe first, then by where they are."""
    return F.struct((-F.array_position(F.lit(list(K.SEVERITIES)), F.col("severity"))).alias("severity"), "table", "column", "rule")


def _publish(spark: SparkSession, path: str, *row) -> None:
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{path}/runs")


def record(spark: SparkSession, path: str, run_id: str, produce: Callable[[], DataFrame], clock: Callable[[], datetime] = now) -> str:
    """Run produce, keep the findings it gives under run_id, and tell how it went; the name of this try.

    What produce or the writing raises is raised again once the run is marked failed (canceled, if it was interrupted).
    The message names the error only, as texts of errors hold cell contents.
    """
    attempt, began = uuid.uuid4().hex, clock()

    def ended(status: str, counts: dict[str, int] | None = None, message: str | None = None) -> None:
        over = clock()
        _publish(spark, path, run_id, attempt, status, began, over, int((over - began).total_seconds() * 1000), *[(counts or {}).get(s) for s in reversed(K.SEVERITIES)], message)

    _publish(spark, path, run_id, attempt, RUNNING, began, None, None, None, None, None, None)
    try:
        spark.createDataFrame([], KEPT).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/findings")  # the folder is there, whatever comes
        counts = _keep(produce(), f"{path}/findings", run_id, attempt)
    except BaseException as e:
        with suppress(Py4JError, PySparkException):  # a session that is gone can say nothing more: the run stays as running
            ended(CANCELED if isinstance(e, KeyboardInterrupt) else FAILED, message=_named(e))
        raise
    ended(SUCCEEDED, counts)
    return attempt


def _named(e: BaseException) -> str:
    said = re.search(r"\[([A-Z][A-Z0-9_.]+)\]", str(e)) if isinstance(e, (PySparkException, Py4JError)) else None
    return f"{type(e).__name__}: {said[1]}" if said else type(e).__name__


def _keep(found: DataFrame, path: str, run_id: str, attempt: str) -> dict[str, int]:
    """Write findings in their order, observed on the way: how many of each severity there are, without a second run of what makes them."""
    rows = K.export(found)
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(_places(rows))).cast("long"))  # columns and rules: few
    seen = Observation()
    rows = rows.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)}).observe(seen, *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in K.SEVERITIES])
    rows.write.mode("append").partitionBy("run_id", "attempt").parquet(path)
    return {s: seen.get.get(s, 0) for s in K.SEVERITIES}


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The last try of each run, with its status, times and counts. An id that was written again shows the later try only."""
    tries = spark.read.schema(RUN).parquet(f"{path}/runs")
    whole = F.struct(*tries.columns)
    return tries.groupBy("run_id").agg(F.max_by(whole, F.struct("started", "attempt", F.col("status") != RUNNING)).alias("last")).select("last.*")


def findings_of(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The findings of complete runs, or of one: those of the last try of each, if that came to its end."""
    kept = spark.read.schema(KEPT).parquet(f"{path}/findings")
    kept = kept if run_id is None else kept.where(F.col("run_id") == run_id)  # prunes folders
    complete = runs(spark, path).where(F.col("status") == SUCCEEDED).select("run_id", "attempt")
    return kept.join(complete, ["run_id", "attempt"], "left_semi")


def _rounded(c: Column, t: T.DataType) -> Column:
    """c with every fraction in it rounded to 1e-6, however deep it is."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.round(c, 6)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _rounded(x, t.elementType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_rounded(c[f.name], f.dataType).alias(f.name) for f in t]))
    return c


def _list(df: DataFrame, name: str, order: Column | str, *drop: str) -> DataFrame:
    """One row with the rows of df in an order, as an array of structs. For rows about columns, rules and files, which are few."""
    row = F.struct(F.struct(order).alias("order"), F.struct(*[_rounded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if f.name not in drop]).alias("row"))
    return df.agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]).alias(name))


def document(spark: SparkSession, out: dict[str, DataFrame], run: DataFrame | None = None, show_values: bool = False) -> DataFrame:
    """One row: an audit (profile, findings; files, notes and rejects where there are) and its row of runs, nested by block.

    Cell contents (commonest values, extremes, rejected lines) are there only if asked for; redaction tells which it is.
    """
    profiled = out["profile"] if show_values else withheld(out["profile"])
    shown = K.export(out["findings"])
    tables = profiled.select("table", "total", F.struct("ordinal", F.struct(*[_rounded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in profiled.schema if f.name != "table"]).alias("row")).alias("one"))
    tables = tables.groupBy("table").agg(F.max("total").alias("rows"), F.transform(F.array_sort(F.collect_list("one")), lambda x: x["row"]).alias("columns"))
    blocks = [
        out["profile"].groupBy("table").agg(F.max("total").alias("rows"), F.count("*").alias("columns")).agg(
            F.struct(F.count("*").alias("tables"), F.coalesce(F.sum("columns"), F.lit(0)).alias("columns"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).alias("dataset")),
        shown.agg(F.struct(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in reversed(K.SEVERITIES)], F.count(F.when(F.col("verified"), 1)).alias("verified")).alias("finding_summary")),
        _list(shown, "findings", _places(shown)),
        _list(tables, "tables", "table"),
    ]
    if "files" in out:
        blocks.append(_list(out["files"].where("skip_reason IS NOT NULL").select("rel", "kind", "skip_reason"), "skipped_files", "rel"))
    if "notes" in out:
        blocks.append(_list(out["notes"], "warnings", F.struct("table", "code", "message")))
    if "rejects" in out:
        rejects = out["rejects"].groupBy("table", "error_type").agg(F.count("*").alias("rows"), *([F.min_by("raw", F.struct("line", "raw")).alias("first")] if show_values else []))
        blocks.append(_list(rejects, "unreadable_rows", F.struct("table", "error_type")))
    one = spark.range(1).select(F.lit(DOCUMENT).alias("schema"), F.struct(F.lit(show_values).alias("values_shown"), F.lit([] if show_values else ["top_values", "min_value", "max_value", "temporal.min", "temporal.max", "raw"]).cast("array<string>").alias("withheld")).alias("redaction"))
    if run is not None:
        blocks.insert(0, run.select(F.struct(*run.columns).alias("run")).limit(1))
    for block in blocks:  # one row each
        one = one.join(F.broadcast(block))
    return one


def write_document(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").json(path)
