"""Column profiles, measured on the value histogram: every probe runs once per distinct value."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from .histogram import columns_of, histogram

KEY = ["table", "column"]
CONFORMANCE = 0.95
SHAPES, SHAPE_CUT, TOP_VALUES = 8, 60, 10
SIGMA = 6.0
EARLIEST = "1900-01-02"
QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
#: Distinct numbers of a column that one task may order, and ranges (a power of two) that more of them are cut into.
ORDERED, RANGES = 200_000, 64


def settled(df: DataFrame) -> DataFrame:
    """df computed once. For frames with a row per column of the data set only: they pass through the driver."""
    df = df.select(*[F.col(P.ident(c)).cast(t).alias(c) for c, t in df.dtypes])  # all fields nullable, as those of a null struct are
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)  # a local relation: later joins need no job to read it


def _sum(condition: str) -> Column:
    return F.sum(F.expr(f"CASE WHEN {condition} THEN n ELSE 0 END"))


def counts(h: DataFrame) -> DataFrame:
    """Counts, lengths, padding and the tallies of each kind, one row per column that has rows.

    Normalised values are told apart in an aggregation of their own, so that the tallies' many sums are not shuffled with each
    of them. Both read the same columns of the histogram, which Spark therefore makes once.
    """
    nb = P.non_blank("value")
    at = ["table", "ordinal", "column"]
    forms = h.groupBy(*at, F.expr(P.normalized("value")).alias("form")).agg(F.sum("n").alias("n")).groupBy(*at).agg(F.sum("n").alias("total"), F.count("form").alias("distinct_normalized"))
    tallies = h.groupBy(*at).agg(
        _sum("value IS NULL").alias("nulls"),
        _sum("trim(value) = ''").alias("blanks"),
        _sum(nb).alias("non_blank"),
        F.count("value").alias("distinct"),
        F.coalesce(F.min(F.length("value")), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(F.length("value")), F.lit(0)).alias("max_length"),
        F.coalesce(F.try_divide(F.sum(F.length("value") * F.col("n")), _sum("value IS NOT NULL")), F.lit(0.0)).alias("avg_length"),
        _sum("value <> ltrim(value)").alias("leading_space"),
        _sum("value <> rtrim(value)").alias("trailing_space"),
        _sum("value <> trim(value)").alias("padded"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        _sum(f"{nb} AND {P.is_sentinel('value')}").alias("sentinel_hits"),
        _sum(f"{nb} AND {P.is_numeric_sentinel('value')}").alias("numeric_sentinel_hits"),
        *[_sum(f"{nb} AND {P.OF_KIND[k]('value')}").alias(f"as_{k}") for k in P.KINDS],
    )
    return tallies.join(F.broadcast(forms), at)  # a row per column


def inferred(tallies: DataFrame) -> DataFrame:
    """tallies plus kind, conformance, nonconforming, best_candidate, best_conformance.

    The first kind, in the order of predicates.KINDS, that all values but a few have is the column's: 5 % may differ,
    or one value. Text placeholders are no values here. The kind that comes nearest is kept as best candidate.
    """
    data = F.col("non_blank") - F.col("sentinel_hits")
    allowed = F.greatest(F.floor(data.cast("double") * F.lit(1 - CONFORMANCE)), F.lit(1))
    tally = {k: F.col(f"as_{k}") for k in P.KINDS}
    kind = F.when(data == 0, "empty")
    for k in P.KINDS:
        kind = kind.when(data - tally[k] <= allowed, k)
    best, best_n = F.lit(None).cast("string"), F.lit(0).cast("long")
    for k in P.KINDS:
        best, best_n = F.when(tally[k] > best_n, k).otherwise(best), F.greatest(best_n, tally[k])
    matched = F.lit(None)
    for k in P.KINDS:
        matched = F.when(F.col("kind") == k, tally[k]).otherwise(matched)
    out = tallies.withColumn("kind", kind.otherwise("text")).withColumn("data_values", data)
    out = out.withColumn("matched", matched)
    return out.withColumns({
        "conformance": F.when(F.col("matched").isNotNull(), F.col("matched") / F.col("data_values")).when(F.col("kind") == "text", 1.0).otherwise(0.0),
        "nonconforming": F.coalesce(F.col("data_values") - F.col("matched"), F.lit(0)),
        "best_candidate": F.when(F.col("data_values") > 0, best),
        "best_conformance": F.when(F.col("data_values") > 0, best_n / F.col("data_values")).otherwise(0.0),
    }).drop("matched")


def _top(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k commonest per column, ties by value, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("n"), value))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def _per_column(df: DataFrame) -> DataFrame:
    """A frame with a row per column of the data set, for joins with values: computed once and sent to them, so values stay where they are."""
    return F.broadcast(settled(df))


def _shared(df: DataFrame, h: DataFrame, value: str) -> DataFrame:
    present = _per_column(h.groupBy(*KEY).agg(_sum("value IS NOT NULL").alias("present")))
    return df.join(present, KEY).select(*KEY, "rank", F.col(value).alias("value"), "n", (F.col("n") / F.col("present")).alias("share"))


def top_values(h: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    return _shared(_top(h.where(P.non_blank("value")), "value", k), h, "value")


def shapes(h: DataFrame, k: int = SHAPES) -> DataFrame:
    each = h.where(P.non_blank("value")).withColumn("shape", F.expr(P.shape("value"))).groupBy(*KEY, "shape").agg(F.sum("n").alias("n"))
    each = _top(each, "shape", k)
    cut = F.when(F.length("shape") > SHAPE_CUT, F.concat(F.substring("shape", 1, SHAPE_CUT), F.lit("…"))).otherwise(F.col("shape"))
    return _shared(each.withColumn("shape", cut), h, "shape")


def sentinels(h: DataFrame) -> DataFrame:
    """Placeholders and magic numbers per column, with counts and share of all rows, commonest first."""
    hits = h.where(f"{P.is_sentinel('value')} OR {P.is_numeric_sentinel('value')}")
    hits = hits.groupBy(*KEY, F.expr(P.normalized("value")).alias("value")).agg(F.sum("n").alias("n"))
    total = _per_column(h.groupBy(*KEY).agg(F.sum("n").alias("total")))
    return hits.join(total, KEY).select(*KEY, "value", "n", (F.col("n") / F.col("total")).alias("share"))


def quantiles(x: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Exact interpolated quartiles of (table, column, x, n), x distinct in a column; no task orders more than ORDERED values about.

    A column with more values is cut at approximate bounds into RANGES ranges; their counts tell which of them hold the
    wanted ranks, and those are cut again until they are small. Only what is left is ordered. sizes holds each
    column's whole (sum of n) and values (rows), if they are known.
    """
    sizes = settled(x.groupBy(*KEY).agg(F.sum("n").alias("whole"), F.count("*").alias("values"))) if sizes is None else sizes
    at = {q: F.lit(p) * (F.col("whole") - 1) for q, p in QUANTILES.items()}
    wanted = [e for a in at.values() for e in (F.floor(a), F.ceil(a))]
    holds = F.lit(False)
    for w in wanted:
        holds = holds | ((w >= F.col("before")) & (w < F.col("before") + F.col("inside")))
    ranges = settled(sizes.select(*KEY, F.lit(0).cast("long").alias("part"), "whole", F.lit(0).cast("long").alias("before"), "values"))
    x = x.select(*KEY, F.lit(0).cast("long").alias("part"), "x", "n")
    bounds = F.percentile_approx("x", F.lit([i / RANGES for i in range(1, RANGES)]), F.lit(2000))
    while not (large := ranges.where(F.col("values") > ORDERED)).isEmpty():
        told = x.join(F.broadcast(large.select(*KEY, "part")), [*KEY, "part"]).groupBy(*KEY, "part").agg(bounds.alias("bounds"))
        # settled: approximate bounds may differ from one evaluation to the next
        cuts = settled(ranges.join(told, [*KEY, "part"], "left").select(*KEY, "part", "whole", F.col("before").alias("start"), F.coalesce("bounds", F.array().cast("array<double>")).alias("bounds")))
        x = x.join(F.broadcast(cuts), [*KEY, "part"]).withColumn("cut", F.lit(0))
        for step in (1 << i for i in reversed(range(RANGES.bit_length() - 1))):  # binary search for the number of bounds below x
            x = x.withColumn("cut", F.col("cut") + F.when(F.get("bounds", F.col("cut") + step - 1) < F.col("x"), step).otherwise(0))
        x = x.drop("bounds").withColumn("own", F.col("part") * RANGES + F.col("cut"))
        sums = x.groupBy(*KEY, "part", "own", "whole", "start").agg(F.sum("n").alias("inside"), F.count("*").alias("values"))
        below = F.sum("inside").over(Window.partitionBy(*KEY, "part").orderBy("own").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.col("start") + F.coalesce(below, F.lit(0)))
        ranges = settled(sums.where(holds).select(*KEY, F.col("own").alias("part"), "whole", "before", "values"))  # six a column at most
        x = x.select(*KEY, F.col("own").alias("part"), "x", "n").join(F.broadcast(ranges.select(*KEY, "part")), [*KEY, "part"])
    few = x.join(F.broadcast(ranges), [*KEY, "part"])
    upto = F.sum("n").over(Window.partitionBy(*KEY, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("stop", F.col("before") + upto).withColumn("start", F.col("stop") - F.col("n"))

    def value(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("start")) & (rank < F.col("stop")), F.col("x")))

    out = few.groupBy(*KEY, "whole").agg(*[e for q, a in at.items() for e in (value(F.floor(a)).alias(f"{q}_low"), value(F.ceil(a)).alias(f"{q}_high"))])
    return out.select(*KEY, *[(F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * (a - F.floor(a))).alias(q) for q, a in at.items()])


def numeric_detail(h: DataFrame) -> DataFrame:
    """Count, range, mean, deviation (mean first, then the squares), quartiles, negatives, zeros and outliers of numbers."""
    x = h.where(P.non_blank("value")).select(*KEY, F.expr(P.number("value")).alias("x"), "n").where("x IS NOT NULL")
    x = x.groupBy(*KEY, "x").agg(F.sum("n").alias("n")).persist()
    first = x.groupBy(*KEY).agg(F.sum("n").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
                                _sum("x < 0").alias("negative"), _sum("x = 0").alias("zero"), F.count("*").alias("values"))
    first = settled(first)
    sizes, first = first.select(*KEY, F.col("count").alias("whole"), "values"), first.drop("values")
    spread = x.join(F.broadcast(first.select(*KEY, "mean", "count")), KEY).groupBy(*KEY).agg(
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)) / F.first(F.nullif(F.col("count") - 1, F.lit(0)))).alias("stddev"))
    stats = settled(F.broadcast(first).join(spread, KEY).withColumn("stddev", F.coalesce("stddev", F.lit(0.0))))
    far = x.join(F.broadcast(stats.select(*KEY, "mean", "stddev", "count")), KEY).groupBy(*KEY).agg(
        _sum(f"stddev > 0 AND count > 2 AND abs(x - mean) > {SIGMA} * stddev").alias("outliers"))
    out = settled(F.broadcast(stats).join(far, KEY).join(quantiles(x, sizes), KEY))
    x.unpersist()
    return out


def temporal_detail(h: DataFrame, audit_time: datetime) -> DataFrame:
    """Values per date format, ambiguous ones, and the range under the commonest format, per column with dates.

    audit_time takes the place of the clock, so that a second run says the same.
    """
    now = f"TIMESTAMP '{audit_time:%Y-%m-%d %H:%M:%S}'"
    dates = h.where(P.non_blank("value")).where(f"{P.is_date('value')} OR {P.is_timestamp('value')}")
    each = [_sum(f"({P.parse_date('value', i)}) IS NOT NULL").alias(f"f{i}") for i in range(len(P.DATE_FORMATS))]
    tallied = dates.groupBy(*KEY).agg(F.sum("n").alias("count"), _sum(P.is_ambiguous_date("value")).alias("ambiguous"), *each)
    best, most = F.lit(None).cast("int"), F.lit(0).cast("long")
    for i in range(len(P.DATE_FORMATS)):
        best, most = F.when(F.col(f"f{i}") > most, i).otherwise(best), F.greatest(most, F.col(f"f{i}"))
    formats = F.filter(F.array(*[F.struct(F.lit(label).alias("format"), F.col(f"f{i}").alias("count")) for i, (label, _, _) in enumerate(P.DATE_FORMATS)]), lambda f: f["count"] > 0)
    told = settled(tallied.select(*KEY, "count", "ambiguous", formats.alias("formats"), best.alias("best")))
    parsed = F.expr("CASE best " + " ".join(f"WHEN {i} THEN {P.parse_date('value', i)}" for i in range(len(P.DATE_FORMATS))) + " END")
    read = dates.join(F.broadcast(told.select(*KEY, "best")), KEY).withColumn("d", parsed).where("d IS NOT NULL")
    ranged = read.groupBy(*KEY).agg(
        F.date_format(F.min("d"), "yyyy-MM-dd HH:mm:ss").alias("min"), F.date_format(F.max("d"), "yyyy-MM-dd HH:mm:ss").alias("max"),
        _sum(f"d > {now}").alias("future"), _sum(f"d < TIMESTAMP '{EARLIEST}' OR d > {now} + INTERVAL 100 YEARS").alias("implausible"))
    return told.join(ranged, KEY, "left").select(*KEY, "count", "formats", "ambiguous", "best", "min", "max", F.coalesce("future", F.lit(0)).alias("future"), F.coalesce("implausible", F.lit(0)).alias("implausible"))


def _nested(df: DataFrame, name: str) -> DataFrame:
    return df.select(*KEY, F.struct(*[F.col(c) for c in df.columns if c not in KEY]).alias(name))


def _listed(df: DataFrame, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n", "share")))
    return df.groupBy(*KEY).agg(F.transform(ordered, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"), x["share"].alias("share"))).alias(name))


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, total, is_unique: not measured, null) of each table that has columns: what table checks of rows and notes read of a profile, without one."""
    each = [df.agg(F.count("*").alias("total")).select(F.lit(name).alias("table"), "total", F.lit(None).cast("boolean").alias("is_unique")) for name, df in sorted(tables.items()) if df.columns]
    return reduce(DataFrame.unionByName, each)


#: The parts of a profile beside its counts, each a further aggregation of the histogram.
PARTS = ("sentinels", "shapes", "top_values", "numeric", "temporal")


def profile(tables: dict[str, DataFrame], audit_time: datetime, h: DataFrame | None = None, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per column of text tables: counts, inferred kind, sentinels, shapes, top values, numbers and dates.

    Only the parts that are asked for are measured and there. Columns of tables without rows are there with total 0 and kind empty. min_value, max_value and top_values are raw
    cell contents: drop them (withheld) before showing the profile to others.
    """
    h = histogram(tables).persist() if h is None else h
    spark = h.sparkSession
    named = spark.createDataFrame(columns_of(tables), "table string, ordinal int, column string, original string")
    out = F.broadcast(named).join(inferred(counts(h)).drop("ordinal"), KEY, "left")  # a row per column
    measured = {"sentinels": lambda: _listed(sentinels(h), "sentinels"), "shapes": lambda: _listed(shapes(h), "shapes"), "top_values": lambda: _listed(top_values(h), "top_values"),
                "numeric": lambda: _nested(numeric_detail(h), "numeric"), "temporal": lambda: _nested(temporal_detail(h, audit_time), "temporal")}
    for part in parts:
        out = out.join(measured[part](), KEY, "left")
    zero = [c for c, t in out.dtypes if t in ("bigint", "int", "double") and c not in ("ordinal",)]
    out = out.fillna(0, zero).fillna({"kind": "empty"})
    missing = F.col("nulls") + F.col("blanks") + F.col("sentinel_hits") + F.col("numeric_sentinel_hits")
    return out.withColumns({"missing": missing, "populated": F.col("total") - missing, "is_unique": (F.col("total") > 0) & (F.col("nulls") == 0) & (F.col("distinct") == F.col("total"))})


def withheld(profiled: DataFrame) -> DataFrame:
    """The profile without cell contents: no top values, no extremes, no earliest and latest dates."""
    kept = profiled.drop("top_values", "min_value", "max_value")
    return kept.withColumn("temporal", F.col("temporal").dropFields("min", "max")) if "temporal" in kept.columns else kept
