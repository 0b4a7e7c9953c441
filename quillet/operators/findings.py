"""Findings: their identity, order, counts, verification by their own evidence, export and history."""

from __future__ import annotations

import re
from collections.abc import Iterator
from numbers import Number

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, ParseException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INFO, WARNING, ERROR = 0, 1, 2
SEVERITIES = ("info", "warning", "error")
COLUMNS = ("rule", "severity", "origin", "title", "remedy", "table", "column", "count", "total", "count_query", "row_query", "expected", "observed", "verified")
SCHEMA = ("rule string, severity int, origin string, title string, remedy string, table string, column string, count long, total long, "
          "count_query string, row_query string, expected string, observed string, verified boolean")
KEY = ["rule", "table", "column"]
#: Evidence queries in one job.
BATCH = 50


def finding(rule: str, severity: int | Column, title: Column, remedy: str, count: Column, total: Column, count_query: Column | None = None,
            row_query: Column | None = None, expected: str = "", observed: Column | None = None, table: Column | None = None, column: Column | None = None,
            origin: str = "check") -> list[Column]:
    """The columns of a finding, for a select."""
    none = F.lit(None).cast("string")
    severity = F.lit(severity) if isinstance(severity, int) else severity
    values = (F.lit(rule), severity.cast("int"), F.lit(origin), title, F.lit(remedy), F.col("table") if table is None else table, F.col("column") if column is None else column,
              count.cast("long"), total.cast("long"), none if count_query is None else count_query, none if row_query is None else row_query,
              F.lit(expected), none if observed is None else observed, F.lit(False))
    return [v.alias(c) for v, c in zip(values, COLUMNS)]


def identity(line: Column | None = None) -> Column:
    """First 16 hex digits of the SHA-256 of rule, table, column and, for findings about one line of a file, its number: the same finding keeps its id from run to run."""
    parts = [F.col("rule"), F.coalesce("table", F.lit("")), F.coalesce("column", F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts, *([] if line is None else [F.nullif(line.cast("string"), F.lit("0"))])), 256), 1, 16)


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding per rule, table and column: the most severe, ties by count and title."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("severity"), F.desc("count"), "title"))
    return findings.withColumn("rank", rank).where("rank = 1").drop("rank")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity"), "table", "column", "rule")


def ranked(findings: DataFrame) -> DataFrame:
    """findings with their place in order, from 1. They are few (columns and rules), so one task orders them."""
    return findings.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("severity"), "table", "column", "rule")).cast("long"))


def severity_name(severity: Column) -> Column:
    return F.element_at(F.lit(list(SEVERITIES)), severity + 1)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"), F.sum("count").alias("rows"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity == ERROR, "error").when(severity == WARNING, "warning").otherwise("note")


def reaches(findings: DataFrame, threshold: int) -> bool:
    """Whether any finding is as severe as the threshold."""
    return not findings.where(F.col("severity") >= threshold).isEmpty()


def gate(findings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """thresholds (min_severity) with reached: whether any finding is as severe."""
    worst = findings.agg(F.max("severity").alias("worst"))
    return thresholds.join(F.broadcast(worst)).select("min_severity", F.coalesce(F.col("worst") >= F.col("min_severity"), F.lit(False)).alias("reached"))


#: What a query may fail with by its own fault; anything else, as a lost executor, is not the query's and is raised.
FAULTS = (AnalysisException, ParseException, ArithmeticException, NumberFormatException, DateTimeException, ArrayIndexOutOfBoundsException, SparkRuntimeException, Py4JJavaError)


def own_fault(e: Exception) -> Exception:
    """e, if it is the query's own; raised again otherwise. Some faults reach Python as errors of the JVM, told by their SQLSTATE's class."""
    if isinstance(e, Py4JJavaError) and not re.search(r"SQLSTATE: (?:0A|21|22|42)|java.util.regex.PatternSyntaxException", str(e)):
        raise e
    return e


#: Counts of rows of one table under a condition on single rows: these are taken together, in one pass over the table.
ROW_COUNT = re.compile(r"SELECT count\(\*\) FROM (`(?:[^`]|``)+`) WHERE (.*)", re.DOTALL)


#: Functions that run code of the JVM by its name.
REFLECTION = {"reflect", "java_method", "try_reflect"}


def _nodes(spark: SparkSession, query: str, deep: bool) -> Iterator[tuple[str, object]]:
    """(class name, node) of the plan Spark parses a text to; deep: of common table expressions, subqueries and expressions, too."""
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)]
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    commands = [loader.loadClass(logical + name) for name in ("Command", "ParsedStatement")]
    subquery = loader.loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    plans = loader.loadClass(logical + "LogicalPlan")
    items = lambda seq: [seq.apply(i) for i in range(seq.size())]
    while todo:
        node = todo.pop()
        name = "Command" if any(c.isInstance(node) for c in commands) else node.getClass().getSimpleName()
        yield name, node
        todo += items(node.children())
        if deep:
            if plans.isInstance(node):
                todo += items(node.expressions())
            if subquery.isInstance(node):
                todo.append(node.plan())
            if name == "UnresolvedWith":
                todo += [pair._2() for pair in items(node.cteRelations())]


def reads_only(spark: SparkSession, query: str) -> bool:
    """Whether a text is one statement that only reads: no command and no write stands in the plan Spark parses it to."""
    try:
        return all(name != "Command" for name, _ in _nodes(spark, query, deep=False))
    except ParseException:
        return False


def reads_views_only(spark: SparkSession, query: str) -> bool:
    """Whether a text is one reading statement over registered views: no files, no catalog tables, no JVM functions."""
    try:
        nodes = list(_nodes(spark, query, deep=True))
    except ParseException:
        return False
    words = lambda seq: [seq.apply(i) for i in range(seq.size())]
    known = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    known |= {pair.lower() for name, node in nodes if name == "UnresolvedWith" for pair in (words(node.cteRelations())[i]._1() for i in range(node.cteRelations().size()))}
    for name, node in nodes:
        if name == "Command":
            return False
        if name == "UnresolvedRelation" and (node.multipartIdentifier().size() != 1 or node.multipartIdentifier().apply(0).lower() not in known):
            return False
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction") and {w.lower() for w in words(getattr(node, "nameParts" if name == "UnresolvedFunction" else "name")())} & REFLECTION:
            return False
    return True


def measure(spark: SparkSession, queries: dict[str, str], trusted: bool = True) -> dict[str, int | None]:
    """The number each count query gives; null if it cannot run, gives no number, or more than one.

    Counts of one table's rows take one pass over it, other queries run as one union; singly only where that fails.
    Nothing but reading statements runs; queries that users write (not trusted) may read registered views only.
    """
    allowed = reads_only if trusted else reads_views_only
    out: dict[str, int | None] = {k: None for k in queries}
    queries = {k: q for k, q in queries.items() if q and allowed(spark, q)}

    def number(value) -> int | None:
        return value if isinstance(value, Number) and not isinstance(value, bool) else None

    def alone(query: str) -> int | None:
        try:
            found = spark.sql(query)
            rows = found.take(2) if len(found.columns) == 1 else []
            return number(rows[0][0]) if len(rows) == 1 else None
        except FAULTS as e:
            own_fault(e)
            return None

    def batch(keys: list[str], text) -> None:
        try:
            row = spark.sql(text(keys)).first()
            out.update((k, number(row[i])) for i, k in enumerate(keys))
        except FAULTS as e:
            own_fault(e)
            if len(keys) == 1:
                out[keys[0]] = alone(queries[keys[0]])
                return
            half = len(keys) // 2
            batch(keys[:half], text)
            batch(keys[half:], text)

    per_table: dict[str, list[str]] = {}
    for k, q in queries.items():
        m = ROW_COUNT.fullmatch(q)
        per_table.setdefault(m[1] if m and "select" not in m[2].lower() else "", []).append(k)
    for table, keys in per_table.items():
        def sums(some: list[str], table=table) -> str:
            return "SELECT " + ", ".join(f"coalesce(sum(CASE WHEN {ROW_COUNT.fullmatch(queries[k])[2]} THEN 1 END), 0) AS n{i}" for i, k in enumerate(some)) + f" FROM {table}"

        def values(some: list[str]) -> str:
            return "SELECT " + ", ".join(f"({queries[k]}) AS n{i}" for i, k in enumerate(some))

        for at in range(0, len(keys), BATCH):
            batch(keys[at : at + BATCH], sums if table else values)
    return out


def verified(findings: DataFrame) -> DataFrame:
    """Findings whose evidence says the same when run again, with the count it gives now.

    A query that fails, or gives none where some were claimed, drops the finding; one without a query stays, unverified.
    Findings are few (columns and rules), so they pass through the driver; the evidence runs on the tables.
    """
    spark = findings.sparkSession
    rows = [r.asDict() for r in findings.collect()]
    told = measure(spark, {str(i): r["count_query"] for i, r in enumerate(rows) if r["count_query"]})
    kept = []
    for i, r in enumerate(rows):
        if r["count_query"]:
            n = told[str(i)]
            if n is None or (n == 0 and r["count"] != 0):
                continue
            r |= {"count": n, "verified": True}
        kept.append(tuple(r[c] for c in COLUMNS))
    return spark.createDataFrame(kept, SCHEMA)


def offending_rows(spark: SparkSession, row_query: str, limit: int = 100, order: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """The rows a finding's query selects, at most limit (1000 at most; the first in the order of some columns, if given), and whether there are more."""
    limit = min(limit, 1000)
    if not reads_only(spark, row_query):
        raise ValueError("a row query only reads")
    found = spark.sql(re.sub(r" LIMIT \d+$", "", row_query))
    rows = (found.orderBy(*order) if order else found).limit(limit + 1).collect()  # run once: 1001 rows at most
    return spark.createDataFrame(rows[:limit], found.schema), len(rows) > limit


def export(findings: DataFrame) -> DataFrame:
    """One flat row per finding, with id, severity as text and share of the rows, rounded to 1e-6."""
    share = F.round(F.when(F.col("total") > 0, F.col("count") / F.col("total")), 6)
    return findings.select(identity().alias("id"), "rule", severity_name(F.col("severity")).alias("severity"), "origin", "title", "remedy", "table", "column", "count", "total",
                           share.alias("share"), "count_query", "row_query", "verified", sarif_level(F.col("severity")).alias("level"))


def write_history(findings: DataFrame, path: str, run_id: str) -> None:
    """Keep a run's findings under its id; writing an id again replaces that run only."""
    rows = export(findings).withColumn("run_id", F.lit(run_id))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def runs(history: DataFrame) -> DataFrame:
    """Findings per run and severity."""
    return history.groupBy("run_id").agg(F.count("*").alias("findings"), *[F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s) for s in SEVERITIES])


def page(findings: DataFrame, offset: int = 0, limit: int = 50, rule: str | None = None, table: str | None = None, least: int = INFO) -> DataFrame:
    """Some of the findings in their order, filtered by rule, table and severity."""
    out = findings.where(F.col("severity") >= least)
    out = out if rule is None else out.where(F.col("rule") == rule)
    out = out if table is None else out.where(F.col("table") == table)
    return ordered(out).offset(offset).limit(limit)
