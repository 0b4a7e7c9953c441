"""Registered audit queries, each over whole tables as text, with the SQL that gives the same rows in DuckDB.

The given tables are mostly clean, so some columns are spoiled by a fixed CASE on their key, the same in both.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import adhoc, checks, findings, relate, rules, score
from ..operators import profile as prof
from ..operators.histogram import histogram
from ..sources import delimited
from ..sources.tables import registered
from ..sources.written import fresh_path
from .audit import audit

AUDIT_TIME = datetime(2024, 1, 1)

# ---- the inputs: table -> columns as SQL that both engines read alike -------------------------------------------
STATUS = "CASE WHEN {k} % 17 = 0 THEN lower({c}) WHEN {k} % 23 = 0 THEN ' ' || {c} WHEN {k} % 29 = 0 THEN 'N/A' WHEN {k} % 31 = 0 THEN NULL WHEN {k} % 37 = 0 THEN '' ELSE {c} END"
CENTS = "CAST(CAST(round({c} * 100) AS BIGINT) AS STRING)"
DAY = "CAST(CAST({c} AS DATE) AS STRING)"


def plain(*names: str) -> dict[str, str]:
    return {n: f"CAST({n} AS STRING)" for n in names}


#: Every column of each table that has a text form both engines write alike: money in cents, rates in hundredths, moments as days.
INPUTS = {
    "customer": {**plain("c_custkey", "c_name", "c_nationkey"), "c_acctbal": CENTS.format(c="c_acctbal"), "c_mktsegment": STATUS.format(k="c_custkey", c="c_mktsegment")},
    "orders": {"o_orderkey": "CAST(CASE WHEN o_orderkey % 400 = 7 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING)",
               "o_custkey": "CASE WHEN o_orderkey % 41 = 0 THEN 'x' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END",
               "o_orderstatus": "o_orderstatus",
               "o_cents": "CASE WHEN o_orderkey % 97 = 0 THEN 'pending' WHEN o_orderkey % 101 = 0 THEN '-' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) END",
               "o_orderdate": DAY.format(c="o_orderdate"), "o_orderpriority": STATUS.format(k="o_orderkey", c="o_orderpriority")},
    "part": {**plain("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_retailprice": CENTS.format(c="p_retailprice")},
    "nation": {"n_nationkey": "CAST(n_nationkey AS STRING)", "name": "n_name", "n_regionkey": "CAST(n_regionkey AS STRING)"},
    "region": {"r_regionkey": "CAST(r_regionkey AS STRING)", "name": "r_name"},
    "lineitem": {**plain("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_units": "CAST(CAST(l_quantity AS BIGINT) AS STRING)", "l_cents": CENTS.format(c="l_extendedprice"), "l_discount": CENTS.format(c="l_discount"),
                 "l_tax": CENTS.format(c="l_tax"), **plain("l_returnflag", "l_linestatus"), "l_shipdate": DAY.format(c="l_shipdate")},
    "supplier": {**plain("s_suppkey", "s_name", "s_nationkey"), "s_acctbal": CENTS.format(c="s_acctbal")},
    "events": {"event_id": "CAST(event_id AS STRING)", "day": DAY.format(c="ts"), "user_id": "CAST(user_id AS STRING)", "event_type": "event_type", "milli": "CAST(CAST(round(value * 1000) AS BIGINT) AS STRING)", "props": "props"},
    "documents": {**plain("doc_id", "text", "lang", "source", "n_chars")},
    "labels": plain("doc_id", "quality", "toxic"),
    "conversations": {**plain("conv_id", "turn"), "role": STATUS.format(k="conv_id", c="role"), "text": "text"},
}


def texts(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Input tables, registered as views of their names, which evidence queries read."""
    return registered({n: spark.read.parquet(f"{sf_dir}/{n}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in INPUTS[n].items()]) for n in names})


def source_sql(name: str) -> str:
    return "(SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in INPUTS[name].items()) + f" FROM {name})"


# ---- the predicates, in DuckDB's dialect --------------------------------------------------------------------------
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def d_list(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def d_blank(c: str) -> str:
    return f"({c} IS NOT NULL AND trim({c}) <> '')"


def d_number(c: str) -> str:
    return rf"CASE WHEN regexp_full_match(trim({c}), '{P.NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def d_format(c: str, i: int) -> str:
    strp = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y", "%Y%m%d", "%d %b %Y", "%b %d, %Y", "%d/%m/%y", "%m/%d/%y")[i]
    return f"CASE WHEN regexp_full_match(trim({c}), '{P.DATE_FORMATS[i][2]}') THEN try_strptime(trim({c}), '{strp}') END"


def d_kind(c: str, kind: str) -> str:
    if kind == "integer":
        return f"regexp_full_match(trim({c}), '[+-]?[0-9]{{1,18}}')"
    if kind == "decimal":
        return f"({d_number(c)}) IS NOT NULL"
    if kind == "boolean":
        return f"TRY_CAST(trim({c}) AS BOOLEAN) IS NOT NULL"
    if kind == "date":
        return "(" + " OR ".join(f"({d_format(c, i)}) IS NOT NULL" for i in (0, *P.INFERENCE_FORMATS)) + ")"
    return rf"(CASE WHEN regexp_full_match(trim({c}), '{P.TIMESTAMP}') THEN TRY_CAST(trim({c}) AS TIMESTAMP) END) IS NOT NULL"


def d_shape(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '\p{{Nd}}', '9', 'g'), '\p{{L}}', 'X', 'g'), '\s', ' ', 'g')"


def d_count(condition: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f
    return keep


# ---- column profile -------------------------------------------------------------------------------------------------
COUNTS = ("total", "nulls", "blanks", "non_blank", "distinct", "distinct_normalized", "min_length", "max_length", "leading_space", "trailing_space", "padded", "min_value", "max_value", "sentinel_hits", "numeric_sentinel_hits")


def counts_sql(name: str) -> str:
    def one(c: str) -> str:
        nb = d_blank(c)
        kinds = ", ".join(f"{d_count(f'{nb} AND {d_kind(c, k)}')} AS as_{k}" for k in P.KINDS)
        return (f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) AS total, {d_count(f'{c} IS NULL')} AS nulls, {d_count(f'''trim({c}) = '' ''')} AS blanks, {d_count(nb)} AS non_blank, "
                f"count(DISTINCT {c}) AS \"distinct\", count(DISTINCT lower(trim({c}))) AS distinct_normalized, coalesce(min(length({c})), 0) AS min_length, coalesce(max(length({c})), 0) AS max_length, "
                f"round(coalesce(avg(length({c})), 0), 6) AS avg_length, {d_count(f'{c} <> ltrim({c})')} AS leading_space, {d_count(f'{c} <> rtrim({c})')} AS trailing_space, {d_count(f'{c} <> trim({c})')} AS padded, "
                f"min({c}) AS min_value, max({c}) AS max_value, {d_count(f'{nb} AND lower(trim({c})) IN {d_list(P.TEXT_SENTINELS)}')} AS sentinel_hits, "
                f"{d_count(f'{nb} AND lower(trim({c})) IN {d_list(P.NUMERIC_SENTINELS)}')} AS numeric_sentinel_hits, {kinds} FROM {source_sql(name)}")
    return union(one(c) for c in INPUTS[name])


def profile_counts(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = prof.counts(histogram(texts(spark, sf_dir, name)))
        return got.select("table", "column", *COUNTS, F.round("avg_length", 6).alias("avg_length"), *[f"as_{k}" for k in P.KINDS])

    run.__name__ = f"profile_{name}"
    return query(counts_sql(name))(run)


for _name in INPUTS:
    profile_counts(_name)


def kinds_sql(*names: str) -> str:
    data = "non_blank - sentinel_hits"
    first = " ".join(f"WHEN {data} - as_{k} <= greatest(floor(({data}) * 0.050000000000000044), 1) THEN '{k}'" for k in P.KINDS)
    return (f'SELECT "table", "column", CASE WHEN {data} = 0 THEN \'empty\' {first} ELSE \'text\' END AS kind, '
            f"round(CASE WHEN {data} = 0 THEN 0 ELSE greatest({', '.join(f'as_{k}' for k in P.KINDS)})::DOUBLE / ({data}) END, 6) AS best_conformance FROM ({union(counts_sql(n) for n in names)})")


@query(kinds_sql("orders", "labels", "nation"))
def infer_kind(spark, sf_dir):
    got = prof.inferred(prof.counts(histogram(texts(spark, sf_dir, "orders", "labels", "nation"))))
    return got.select("table", "column", "kind", F.round("best_conformance", 6).alias("best_conformance"))


def top_sql(name: str, columns, value, k: int) -> str:
    def one(c: str) -> str:
        return (f"SELECT '{c}' AS \"column\", rank, value, n, round(n::DOUBLE / (SELECT count({c}) FROM {source_sql(name)}), 6) AS share FROM (SELECT {value(c)} AS value, count(*) AS n, "
                f"row_number() OVER (ORDER BY count(*) DESC, {value(c)}) AS rank FROM {source_sql(name)} WHERE {d_blank(c)} GROUP BY {value(c)}) WHERE rank <= {k}")
    return union(one(c) for c in columns)


@query(top_sql("part", INPUTS["part"], lambda c: c, prof.TOP_VALUES))
def top_values(spark, sf_dir):
    return prof.top_values(histogram(texts(spark, sf_dir, "part"))).select("column", "rank", "value", "n", F.round("share", 6).alias("share"))


@query(top_sql("customer", INPUTS["customer"], d_shape, prof.SHAPES))
def shapes_top8(spark, sf_dir):
    return prof.shapes(histogram(texts(spark, sf_dir, "customer"))).select("column", "rank", "value", "n", F.round("share", 6).alias("share"))


@query(union(f"SELECT '{c}' AS \"column\", lower(trim({c})) AS value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM {source_sql('orders')} "
             f"WHERE lower(trim({c})) IN {d_list(P.TEXT_SENTINELS + P.NUMERIC_SENTINELS)} GROUP BY lower(trim({c}))" for c in INPUTS["orders"]))
def sentinel_values(spark, sf_dir):
    return prof.sentinels(histogram(texts(spark, sf_dir, "orders"))).select("column", "value", "n", F.round("share", 6).alias("share"))


def numbers_sql(name: str, columns) -> str:
    def one(c: str) -> str:
        return (f"SELECT '{c}' AS \"column\", count(x) AS count, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS stddev, round(quantile_cont(x, 0.25), 4) AS p25, "
                f"round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS p75, {d_count('x < 0')} AS negative, {d_count('x = 0')} AS zero, "
                f"{d_count('abs(x - m) > 6 * s')} AS outliers FROM (SELECT x, avg(x) OVER () AS m, stddev_samp(x) OVER () AS s FROM (SELECT {d_number(c)} AS x FROM {source_sql(name)} WHERE {d_blank(c)}) WHERE x IS NOT NULL)")
    return union(one(c) for c in columns)


MEASURED = ("lineitem", "events", "orders")


@query("SELECT * FROM (" + union(numbers_sql(n, INPUTS[n]) for n in MEASURED) + ") WHERE count > 0")
def numeric_detail(spark, sf_dir):
    got = prof.numeric_detail(histogram(texts(spark, sf_dir, *MEASURED)))  # which reads it once
    return got.select("column", "count", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "p25", "median", "p75")], "negative", "zero", "outliers")


# ---- dates: rendered in several formats by the key --------------------------------------------------------------
S_DATES = ("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
           "WHEN 3 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE CASE WHEN o_orderkey % 100 = 99 THEN 'soon' ELSE date_format(o_orderdate, 'yyyyMMdd') END END")
D_DATES = ("CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') "
           "WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE CASE WHEN o_orderkey % 100 = 99 THEN 'soon' ELSE strftime(o_orderdate, '%Y%m%d') END END")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{S_DATES} AS o_date")


@query(union(f"SELECT {q(P.DATE_FORMATS[i][0])} AS format, n FROM (SELECT {d_count(f'({d_format(chr(111) + chr(95) + chr(100), i)}) IS NOT NULL')} AS n FROM (SELECT {D_DATES} AS o_d FROM orders)) WHERE n > 0" for i in range(12)))
def date_formats(spark, sf_dir):
    got = prof.temporal_detail(histogram({"orders": dated(spark, sf_dir)}), AUDIT_TIME)
    return got.select(F.explode("formats").alias("f")).select(F.col("f.format").alias("format"), F.col("f.count").alias("n"))


@query(f"SELECT count(*) FILTER ({d_kind('o_d', 'date')}) AS count, count(*) FILTER (({d_format('o_d', 1)}) <> ({d_format('o_d', 2)})) AS ambiguous, strftime(min({d_format('o_d', 0)}), '%Y-%m-%d %H:%M:%S') AS min, "
       f"strftime(max({d_format('o_d', 0)}), '%Y-%m-%d %H:%M:%S') AS max, count(*) FILTER (({d_format('o_d', 0)}) > TIMESTAMP '2000-01-01') AS future FROM (SELECT {D_DATES} AS o_d FROM orders)")
def date_range(spark, sf_dir):
    got = prof.temporal_detail(histogram({"orders": dated(spark, sf_dir)}), datetime(2000, 1, 1))
    return got.select("count", "ambiguous", "min", "max", "future")


# ---- tables, keys and references ----------------------------------------------------------------------------------
def surplus_sql(name: str) -> str:
    return f"SELECT coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS n FROM {source_sql(name)} GROUP BY ALL HAVING count(*) > 1)".replace("SELECT count(*) AS n", f"SELECT {', '.join(INPUTS[name])}, count(*) AS n")


@query(surplus_sql("lineitem"))
def duplicate_rows(spark, sf_dir):
    return checks.duplicate_rows(texts(spark, sf_dir, "lineitem")["lineitem"])


@query(surplus_sql("conversations"))
def duplicate_conversations(spark, sf_dir):
    return checks.duplicate_rows(texts(spark, sf_dir, "conversations")["conversations"])


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS n FROM (SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL SELECT doc_id // 3, text, lang, source, n_chars FROM documents) GROUP BY ALL HAVING count(*) > 1)".replace("count(*) AS n FROM (SELECT", "doc_id, text, lang, source, n_chars, count(*) AS n FROM (SELECT"))
def duplicate_documents(spark, sf_dir):
    """Whole rows of documents that repeat, in two deliveries of which the second numbers them anew."""
    docs = texts(spark, sf_dir, "documents")["documents"]
    return checks.duplicate_rows(docs.unionByName(docs.withColumn("doc_id", F.floor(F.col("doc_id").cast("long") / 3).cast("string"))))


@query('SELECT sum(n)::BIGINT AS "rows", count(*) AS distinct_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_duplicates, 0::BIGINT AS rows_missing_part, coalesce(sum(n) FILTER (n > 1), 0) = 0 AS is_key '
       "FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def candidate_key(spark, sf_dir):
    return adhoc.candidate_key(texts(spark, sf_dir, "lineitem")["lineitem"], ["l_orderkey", "l_linenumber"])


REFERENCES = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
              ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("customer", "c_nationkey", "nation", "n_nationkey"))


def orphan_sql(t: str, c: str, pt: str, p: str) -> str:
    return (f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {d_count(f'lower(trim({c})) NOT IN (SELECT lower(trim({p})) FROM {source_sql(pt)} WHERE {d_blank(p)})')} AS orphans FROM {source_sql(t)} WHERE {d_blank(c)}")


@query(union(orphan_sql(*r) for r in REFERENCES))
def reference_orphans(spark, sf_dir):
    t = texts(spark, sf_dir, *sorted({n for a, _, b, _ in REFERENCES for n in (a, b)}))
    pairs = spark.createDataFrame(REFERENCES, '`table` string, `column` string, parent_table string, parent_column string')
    return relate.orphans(histogram(relate.named_columns(t, list(REFERENCES))), pairs).select("table", "column", "orphans")


@query(f"SELECT count(*) AS referencing_rows, {d_count('v NOT IN (SELECT trim(c_custkey) FROM ' + source_sql('customer') + ')')} AS orphans, "
       f"round({d_count('v NOT IN (SELECT trim(c_custkey) FROM ' + source_sql('customer') + ')')}::DOUBLE / count(*), 6) AS orphan_share FROM (SELECT trim(o_custkey) AS v FROM {source_sql('orders')} WHERE {d_blank('o_custkey')})")
def referential_integrity(spark, sf_dir):
    t = texts(spark, sf_dir, "orders", "customer")
    return adhoc.referential_integrity(t["orders"], "o_custkey", t["customer"], "c_custkey")


KEYED = ("orders", "customer", "part", "supplier", "events", "documents")
IDENTIFIER = f"""regexp_matches(lower("column"), '({"|".join(relate.IDENTIFIER_ENDS)})$')"""
KEYS_SQL = (f'SELECT "table", "column", "distinct" AS d, total - nulls - blanks AS present, kind FROM ({union(counts_sql(n) for n in KEYED)}) JOIN ({kinds_sql(*KEYED)}) USING ("table", "column") '
            f"WHERE total >= 2 AND total - nulls - blanks > 0 AND \"distinct\"::DOUBLE / (total - nulls - blanks) >= 0.9 AND kind <> 'empty' AND (kind <> 'decimal' OR {IDENTIFIER})")


def keys_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.candidate_keys(prof.settled(prof.inferred(prof.counts(histogram(texts(spark, sf_dir, *KEYED))))))


@query(f'SELECT "table", "column", round(d::DOUBLE / present, 6) AS uniqueness FROM ({KEYS_SQL})')
def candidate_keys(spark, sf_dir):
    return keys_of(spark, sf_dir).select("table", "column", F.round("uniqueness", 6).alias("uniqueness"))


@query(f"SELECT 'key.duplicate_values' AS rule, \"table\", \"column\", present - d AS count FROM ({KEYS_SQL}) WHERE present > d AND {IDENTIFIER}")
def duplicate_keys(spark, sf_dir):
    return findings.verified(relate.duplicate_keys(keys_of(spark, sf_dir))).select("rule", "table", "column", "count")


# ---- all checks of columns and tables, on spoiled columns of whole tables ---------------------------------------------
EMPTY, NOW = "CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' WHEN o_orderkey % 3 = 1 THEN '' END", f"TIMESTAMP '{AUDIT_TIME:%Y-%m-%d %H:%M:%S}'"
#: orders and lineitem with columns that each trip a check, the same in both engines but for the dates' rendering.
SPOILED = {
    "orders": {**INPUTS["orders"], "note": EMPTY, "quantity": "CASE WHEN o_orderkey % 50 = 0 THEN '-5' WHEN o_orderkey % 1000 = 1 THEN '99999999' ELSE CAST(o_custkey % 7 AS STRING) END",
               "code_text": "CASE WHEN o_orderkey % 4 = 0 THEN 'abc' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END", "currency": "'usd'", "due_date": "'2031-05-06'"},
    "lineitem": {"returned": "l_returnflag", "state": "l_linestatus", "units": INPUTS["lineitem"]["l_units"]},
}
_MISSING = {c: f"(NOT {d_blank(c)} OR lower(trim({c})) IN {d_list(P.TEXT_SENTINELS)})" for t in SPOILED.values() for c in t}
_MAGIC = {c: f"(NOT {d_blank(c)} OR lower(trim({c})) IN {d_list(P.TEXT_SENTINELS + P.NUMERIC_SENTINELS)})" for t in SPOILED.values() for c in t}


def spoiled_sql(name: str) -> str:
    cols = ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in SPOILED[name].items())
    more = f", {D_DATES} AS ordered_on" if name == "orders" else ""
    return f"(SELECT {cols}{more} FROM {name})"


def spoiled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def one(name: str) -> DataFrame:
        more = [f"{S_DATES} AS ordered_on"] if name == "orders" else []
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in SPOILED[name].items()], *more)
        return df.withMetadata("currency", {"original": "Currency"}) if name == "orders" else df
    return registered({n: one(n) for n in SPOILED} | {"nothing": spark.createDataFrame([], "a string, b string")})


def compact_dates(now: str) -> tuple[str, str]:
    """Conditions of amounts in cents that read as a date later than now, and beyond belief."""
    d = f"({d_format('o_cents', 7)})"
    return f"{d} > {now}", f"({d} < TIMESTAMP '{prof.EARLIEST}' OR {d} > {now} + INTERVAL 100 YEARS)"


def checked_sql() -> str:
    o, ords = spoiled_sql("orders"), [*SPOILED["orders"], "ordered_on"]
    numbers = ("o_custkey", "o_cents", "quantity", "o_orderkey", "code_text")
    every = [(n, c) for n, cs in (("orders", ords), ("lineitem", list(SPOILED["lineitem"]))) for c in cs]
    missing = {**_MISSING, "ordered_on": f"NOT {d_blank('ordered_on')}"}
    magic = {**_MAGIC, "ordered_on": f"NOT {d_blank('ordered_on')}"}

    def out(rule: str, n: str, c: str | None, count: str, where: str, of: str | None = None) -> str:
        return f"SELECT '{rule}' AS rule, '{n}' AS \"table\", {q(c) if c else 'CAST(NULL AS VARCHAR)'} AS \"column\", {count} AS count FROM {of or spoiled_sql(n)} HAVING {where}"

    parts = []
    for n, c in every:
        total, gaps, all_gaps = "count(*)", d_count(missing[c]), d_count(magic[c])
        parts += [out("column.empty", n, c, total, f"count(*) > 0 AND {all_gaps} = count(*)"),
                  out("column.missing_values", n, c, gaps, f"{all_gaps} >= 0.05 * count(*) AND {all_gaps} < count(*)"),
                  out("column.whitespace_padding", n, c, d_count(f"{c} <> trim({c})"), f"{d_count(f'{c} <> trim({c})')} > 0"),
                  out("column.constant", n, c, total, f"count(DISTINCT {c}) = 1 AND count(*) >= 5 AND {all_gaps} < count(*)"),
                  f"SELECT 'column.case_variants', '{n}', '{c}', count(*) FILTER (d > 1) FROM (SELECT lower(trim({c})) AS k, count(DISTINCT {c}) AS d, count(*) AS r FROM {spoiled_sql(n)} WHERE {d_blank(c)} GROUP BY 1) "
                  f"HAVING count(*) FILTER (d > 1) > 0 AND count(*) <= 100 AND count(*) <= 0.5 * (SELECT count(*) - {all_gaps} FROM {spoiled_sql(n)})"]
    for c in numbers:
        x = f"(SELECT ({d_number(c)}) AS x FROM {o} WHERE {d_blank(c)})"
        parts.append(f"SELECT 'column.numeric_outliers', 'orders', '{c}', {d_count('abs(x - m) > 6 * s')} FROM (SELECT x, avg(x) OVER () AS m, stddev_samp(x) OVER () AS s FROM {x} WHERE x IS NOT NULL) HAVING {d_count('abs(x - m) > 6 * s')} > 0")
    bad_int, bad_date = f"{d_blank('o_cents')} AND NOT ({d_kind('o_cents', 'integer')})", f"NOT ({d_kind('ordered_on', 'date')})"
    iso = f"({d_format('ordered_on', 0)}) IS NOT NULL"
    parts += [out("column.type_violation", "orders", "o_cents", d_count(bad_int), "count(*) > 0"), out("column.type_violation", "orders", "o_custkey", d_count(f"NOT ({d_kind('o_custkey', 'integer')})"), "count(*) > 0"),
              out("column.type_violation", "orders", "ordered_on", d_count(bad_date), f"{d_count(bad_date)} > 0"),
              out("column.mostly_typed", "orders", "code_text", d_count(f"NOT ({d_kind('code_text', 'integer')})"), "count(*) > 0"),
              out("column.mixed_date_formats", "orders", "ordered_on", d_count(f"NOT {iso} AND {d_kind('ordered_on', 'date')}"), "count(*) > 0"),
              out("column.ambiguous_dates", "orders", "ordered_on", d_count(f"({d_format('ordered_on', 1)}) <> ({d_format('ordered_on', 2)})"), "count(*) > 0"),
              out("column.unexpected_negative", "orders", "quantity", d_count(f"({d_number('quantity')}) < 0"), "count(*) > 0"),
              # eight digits read as a compact date, too
              *(out(rule, "orders", "o_cents", d_count(w), f"{d_count(w)} > 0") for rule, w in (("column.future_dates", compact_dates(NOW)[0]), ("column.implausible_dates", compact_dates(NOW)[1]))),
              "SELECT 'column.duplicate_header', 'orders', 'currency', 1", "SELECT 'table.empty', 'nothing', CAST(NULL AS VARCHAR), 0",
              "SELECT 'table.no_candidate_key', 'lineitem', CAST(NULL AS VARCHAR), 0", "SELECT 'table.no_candidate_key', 'orders', CAST(NULL AS VARCHAR), 0",
              f"SELECT 'table.duplicate_rows', 'lineitem', CAST(NULL AS VARCHAR), coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {spoiled_sql('lineitem')} GROUP BY returned, state, units HAVING count(*) > 1) HAVING coalesce(sum(n - 1), 0) > 0"]
    return union(parts)


@query(checked_sql())
def all_checks(spark, sf_dir):
    """Findings of all column and table checks that run without files, on spoiled columns of whole tables, each verified by its evidence."""
    t = spoiled(spark, sf_dir)
    p = prof.settled(prof.profile(t, AUDIT_TIME))
    found = checks.column_checks(p, AUDIT_TIME).unionByName(checks.table_checks(spark, t, p))
    return findings.verified(findings.deduplicated(found)).select("rule", "table", "column", "count")


PAST = datetime(1996, 1, 1)
_PAST = "TIMESTAMP '1996-01-01 00:00:00'"


@query(f"SELECT 'column.future_dates' AS rule, '{{}}' AS \"table\", 'o_orderdate' AS \"column\", count(*) AS count FROM orders WHERE CAST(o_orderdate AS DATE) > {_PAST}".replace("{}", "orders")
       + f" UNION ALL SELECT 'column.future_dates', 'lineitem', 'l_shipdate', count(*) FROM lineitem WHERE CAST(l_shipdate AS DATE) > {_PAST}"
       + f" UNION ALL SELECT 'column.future_dates', 'orders', 'o_cents', count(*) FROM {source_sql('orders')} WHERE {compact_dates(_PAST)[0]} HAVING count(*) > 0")
def dates_in_the_future(spark, sf_dir):
    """Dates later than an audit that is set in 1996."""
    t = texts(spark, sf_dir, "orders", "lineitem")
    found = checks.column_checks(prof.settled(prof.profile(t, PAST, parts=("temporal",))), PAST).where("rule = 'column.future_dates'")
    return findings.verified(found).select("rule", "table", "column", "count")


FAR = datetime(1890, 1, 1)


@query("SELECT 'column.implausible_dates' AS rule, 'orders' AS \"table\", 'o_orderdate' AS \"column\", count(*) AS count FROM orders WHERE CAST(o_orderdate AS DATE) > TIMESTAMP '1990-01-01'"
       + f" UNION ALL SELECT 'column.implausible_dates', 'orders', 'o_cents', count(*) FROM {source_sql('orders')} WHERE {compact_dates(chr(39).join(('TIMESTAMP ', '1890-01-01 00:00:00', '')))[1]} HAVING count(*) > 0")
def implausible_dates(spark, sf_dir):
    """Dates more than a century after an audit that is set in 1890."""
    t = texts(spark, sf_dir, "orders")
    found = checks.column_checks(prof.settled(prof.profile(t, FAR, parts=("temporal",))), FAR).where("rule = 'column.implausible_dates'")
    return findings.verified(found).select("rule", "table", "column", "count")


@query(f"SELECT 'domain.inconsistent_values' AS rule, 'nation' AS \"table\", 'name' AS \"column\", count(*) AS count FROM (SELECT DISTINCT lower(trim(n_name)) FROM nation EXCEPT SELECT DISTINCT lower(trim(c_mktsegment)) FROM {source_sql('customer')} WHERE {d_blank('c_mktsegment')}) HAVING count(*) > 0")
def shared_domain(spark, sf_dir):
    """Two tables with a category of one name: customers' segments and nations, each repeated over the customers."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation_rows")
    t = texts(spark, sf_dir, "customer")["customer"]
    both = registered({"customer": t.select(F.col("c_mktsegment").alias("name")), "nation": t.join(spark.table("nation_rows"), F.col("c_nationkey") == F.col("n_nationkey").cast("string"), "right").select(F.col("n_name").alias("name"))})
    h = histogram(both).persist()
    p = prof.inferred(prof.counts(h)).withColumn("populated", F.col("non_blank") - F.col("sentinel_hits"))
    return findings.verified(relate.shared_domains(h, prof.settled(p))).select("rule", "table", "column", "count")


# ---- rules ----------------------------------------------------------------------------------------------------------
RULES = rules.parse([
    {"id": "priority_given", "table": "orders", "column": "o_orderpriority", "expect": "not_null"},
    {"id": "order_once", "table": "orders", "column": "o_orderkey", "expect": "unique"},
    {"id": "cents_positive", "table": "orders", "column": "o_cents", "expect": "positive", "severity": "warning"},
    {"id": "cents_not_negative", "table": "orders", "column": "o_cents", "expect": "non_negative"},
    {"id": "status_known", "table": "orders", "column": "o_orderstatus", "expect": "one_of", "values": ["F", "O"]},
    {"id": "segment_known", "table": "cust*", "column": "c_mktsegment", "expect": "one_of", "values": ["automobile", "building", "furniture"], "ignore_case": True, "allow_missing": True},
    {"id": "custkey_digits", "table": "*", "column": "*_custkey", "expect": "matches", "pattern": "[0-9]+"},
    {"id": "cents_range", "table": "orders", "column": "o_cents", "expect": "range", "min": 1000000, "max": 30000000},
    {"id": "customer_exists", "table": "orders", "column": "o_custkey", "expect": "references", "references": "customer.c_custkey"},
    {"id": "urgent_open", "table": "orders", "expect": "sql", "where": "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"},
])
SENTINEL = f"lower(trim(c_mktsegment)) IN {d_list(P.TEXT_SENTINELS)}"
BROKEN = {
    ("priority_given", "orders", "o_orderpriority"): f"NOT {d_blank('o_orderpriority')}",
    ("order_once", "orders", "o_orderkey"): f"o_orderkey IN (SELECT o_orderkey FROM {source_sql('orders')} GROUP BY 1 HAVING count(*) > 1)",
    ("cents_positive", "orders", "o_cents"): f"{d_blank('o_cents')} AND coalesce({d_number('o_cents')}, 0) <= 0",
    ("cents_not_negative", "orders", "o_cents"): f"{d_blank('o_cents')} AND coalesce({d_number('o_cents')}, 0) < 0",
    ("status_known", "orders", "o_orderstatus"): "o_orderstatus NOT IN ('F', 'O')",
    ("segment_known", "customer", "c_mktsegment"): f"{d_blank('c_mktsegment')} AND lower(trim(c_mktsegment)) NOT IN ('automobile', 'building', 'furniture') AND NOT {SENTINEL}",
    ("custkey_digits", "orders", "o_custkey"): "NOT regexp_full_match(trim(o_custkey), '[0-9]+')",
    ("custkey_digits", "customer", "c_custkey"): "NOT regexp_full_match(trim(c_custkey), '[0-9]+')",
    ("cents_range", "orders", "o_cents"): f"({d_number('o_cents')}) < 1000000 OR ({d_number('o_cents')}) > 30000000",
    ("customer_exists", "orders", "o_custkey"): f"o_custkey NOT IN (SELECT c_custkey FROM {source_sql('customer')} WHERE c_custkey IS NOT NULL)",
    ("urgent_open", "orders", None): "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'",
}


@query("SELECT * FROM (" + union(f"SELECT '{r}' AS rule, '{t}' AS \"table\", {q(c) if c else 'CAST(NULL AS VARCHAR)'} AS \"column\", {d_count(w)} AS count, count(*) AS total FROM {source_sql(t)}" for (r, t, c), w in BROKEN.items()) + ") WHERE count > 0")
def rule_violations(spark, sf_dir):
    return rules.evaluate(spark, texts(spark, sf_dir, "orders", "customer"), RULES, AUDIT_TIME).select("rule", "table", "column", "count", "total")


@query(f"SELECT min(o_orderpriority) AS value FROM {source_sql('orders')} WHERE {d_blank('o_orderpriority')} GROUP BY lower(trim(o_orderpriority))")
def vocabulary(spark, sf_dir):
    rule = rules.Rule("v", "orders", "one_of", "o_orderpriority", values_from="current", ignore_case=True)
    return rules.vocabulary(rule, texts(spark, sf_dir, "orders"))


# ---- redaction --------------------------------------------------------------------------------------------------------
def d_mask(c: str) -> str:
    return (rf"regexp_replace(regexp_replace(regexp_replace({c}, '[\p{{L}}\p{{N}}._%+-]+@[\p{{L}}\p{{N}}.-]+\.\p{{L}}{{2,}}', '[email]', 'g'), "
            rf"'\b\d{{3}}-\d{{2}}-\d{{4}}\b', '[national-id]', 'g'), '\b(?:\d[ -]?){{12,}}\d?\b', '[long-number]', 'g')")


@query(f"SELECT doc_id, sha256({d_mask('text')}) AS masked_sha256, {d_mask('text')} <> text AS changed FROM documents")
def mask_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.expr(P.mask("text")).alias("m"), "text").select("doc_id", F.sha2("m", 256).alias("masked_sha256"), (F.col("m") != F.col("text")).alias("changed"))


@query(f"SELECT '⟨' || CASE WHEN length(s) > 60 THEN left(s, 60) || '…' ELSE s END || '⟩' AS shown, count(*) AS n FROM (SELECT {d_shape('text')} AS s FROM conversations) GROUP BY 1")
def redacted_conversations(spark, sf_dir):
    t = texts(spark, sf_dir, "conversations")["conversations"]
    return t.groupBy(F.expr(P.redacted("text")).alias("shown")).agg(F.count("*").alias("n"))


@query(f"SELECT '⟨' || {d_shape('v')} || '⟩' AS value, n AS count, round(n::DOUBLE / (SELECT count(o_orderpriority) FROM {source_sql('orders')}), 6) AS share FROM (SELECT o_orderpriority AS v, count(*) AS n FROM {source_sql('orders')} "
       f"WHERE {d_blank('o_orderpriority')} GROUP BY 1 ORDER BY n DESC, v LIMIT 20)")
def sample_values(spark, sf_dir):
    return adhoc.sample_values(texts(spark, sf_dir, "orders")["orders"], "o_orderpriority").select("value", "count", F.round("share", 6).alias("share"))


@query(f"SELECT '⟨' || {d_shape('s.o_orderstatus')} || '⟩' AS o_orderstatus, count(*) AS n FROM {source_sql('orders')} AS s GROUP BY s.o_orderstatus")
def run_sql(spark, sf_dir):
    texts(spark, sf_dir, "orders")
    return adhoc.run_sql(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", statistics=("n",))[0]


# ---- findings ---------------------------------------------------------------------------------------------------------
def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir, "orders", "customer")
    return audit(spark, t, AUDIT_TIME, RULES, strip_prefix="^[a-z]_")["findings"]


_BAD_CENTS = f"{d_blank('o_cents')} AND ({d_number('o_cents')}) IS NULL"


@query()
def audit_findings(spark, sf_dir):
    """All findings of two tables, verified: which there are depends on every check, so tests compare parts with SQL."""
    return findings.export(audited(spark, sf_dir)).drop("count_query", "row_query")


@query(union([
    f"SELECT 'column.whitespace_padding' AS rule, 'customer' AS \"table\", 'c_mktsegment' AS \"column\", {d_count('c_mktsegment <> trim(c_mktsegment)')} AS count FROM {source_sql('customer')}",
    f"SELECT 'column.whitespace_padding', 'orders', 'o_orderpriority', {d_count('o_orderpriority <> trim(o_orderpriority)')} FROM {source_sql('orders')}",
    f"SELECT 'column.case_variants', 'customer', 'c_mktsegment', count(*) FROM (SELECT 1 FROM {source_sql('customer')} WHERE {d_blank('c_mktsegment')} GROUP BY lower(trim(c_mktsegment)) HAVING count(DISTINCT c_mktsegment) > 1)",
    f"SELECT 'column.case_variants', 'orders', 'o_orderpriority', count(*) FROM (SELECT 1 FROM {source_sql('orders')} WHERE {d_blank('o_orderpriority')} GROUP BY lower(trim(o_orderpriority)) HAVING count(DISTINCT o_orderpriority) > 1)",
    f"SELECT 'column.type_violation', 'orders', 'o_cents', {d_count(_BAD_CENTS)} FROM {source_sql('orders')}",
    f"SELECT 'column.type_violation', 'orders', 'o_custkey', {d_count('NOT (' + d_kind('o_custkey', 'integer') + ')')} FROM {source_sql('orders')}",
]))
def check_findings(spark, sf_dir):
    t = texts(spark, sf_dir, "orders", "customer")
    found = checks.column_checks(prof.settled(prof.profile(t, AUDIT_TIME, parts=())), AUDIT_TIME)
    return findings.verified(found.where(F.col("rule").isin("column.whitespace_padding", "column.case_variants", "column.type_violation"))).select("rule", "table", "column", "count")


@query("SELECT CASE WHEN rule = 'cents_positive' THEN 1 ELSE 2 END AS severity, count(*) AS findings, sum(count)::BIGINT AS \"rows\" FROM (" + ORACLE_SQL["rule_violations"] + ") GROUP BY 1")
def severity_counts(spark, sf_dir):
    found = rules.evaluate(spark, texts(spark, sf_dir, "orders", "customer"), RULES, AUDIT_TIME)
    return findings.severity_counts(findings.deduplicated(found.unionByName(found)))


_PENDING = f"(SELECT count(*) FROM {source_sql('orders')} WHERE o_cents = 'pending')"
_PEOPLE = f"(SELECT count(*) FROM {source_sql('orders')} WHERE o_custkey IN (SELECT c_custkey FROM {source_sql('customer')}))"


@query(union(f"SELECT 'claim.{rule}' AS rule, CAST({n} AS BIGINT) AS measured, {accepted} AS accepted" for rule, n, accepted in (
    ("pending_orders", _PENDING, "false"), ("right", _PENDING, "true"), ("across_tables", _PEOPLE, "true"), ("none", "0", "false"),
    *((r, "NULL", "false") for r in ("broken", "writes", "drops", "makes_a_table", "sets", "reads_a_file", "calls_the_jvm", "gives_text", "gives_rows", "gives_nothing")))))
def claims(spark, sf_dir):
    """Claims that are right, wrong, or that would do something else than read the registered tables."""
    texts(spark, sf_dir, "orders", "customer")
    count = "SELECT count(*) FROM orders WHERE "
    met = "WITH known AS (SELECT c_custkey FROM customer) " + count + "o_custkey IN (SELECT c_custkey FROM known)"
    true = {q: spark.sql(q).first()[0] for q in (count + "o_cents = 'pending'", met)}
    said = [("Right", count + "o_cents = 'pending'", true[count + "o_cents = 'pending'"]), ("Pending orders!", count + "o_cents = 'pending'", -1), ("across tables", met, true[met]), ("none", count + "o_cents = 'nothing'", 0),
            ("broken", count + "no_such_column = 1", 3), ("writes", "INSERT INTO orders SELECT * FROM orders", 1), ("drops", "DROP VIEW orders", 0), ("makes a table", "CREATE TABLE made AS SELECT 1 AS n", 1), ("sets", "SET spark.sql.ansi.enabled=false", 1),
            ("reads a file", f"SELECT count(*) FROM parquet.`{sf_dir}/orders.parquet`", 1), ("calls the JVM", "SELECT length(reflect('java.lang.System', 'getProperty', 'user.dir'))", 1), ("gives text", "SELECT max(o_cents) FROM orders", 1),
            ("gives rows", "SELECT 1 FROM orders", 1), ("gives nothing", "SELECT 1 WHERE false", 1)]
    return adhoc.verify_claims(spark.createDataFrame([(c, "orders", "o_cents", q, n) for c, q, n in said], "claim string, `table` string, `column` string, count_query string, claimed long")).select("rule", "measured", "accepted")


# ---- rules that fail on some row, and rules over two tables -----------------------------------------------------------
FRAGILE = rules.parse([
    {"id": "bad_cast", "table": "orders", "expect": "sql", "where": "CAST(o_cents AS BIGINT) > 30000000"},
    {"id": "bad_pattern", "table": "orders", "column": "o_custkey", "expect": "matches", "pattern": "([0-9]+"},
    {"id": "bad_division", "table": "orders", "expect": "sql", "where": "1 / (length(o_orderstatus) - 1) > 0"},
    {"id": "priority_given", "table": "orders", "column": "o_orderpriority", "expect": "not_null"},
    {"id": "status_known", "table": "orders", "column": "o_orderstatus", "expect": "one_of", "values": ["F", "O"]},
    {"id": "known_customer", "table": "orders", "expect": "sql", "where": "NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = orders.o_custkey)"},
])


@query("SELECT rule, \"table\", \"column\", count, total FROM (" + union([
    *(f"SELECT 'rule.invalid' AS rule, 'orders' AS \"table\", {c} AS \"column\", 0 AS count, 0 AS total" for c in ("NULL", "'o_custkey'", "NULL")),
    *(f"SELECT '{r}', 'orders', {c}, {d_count(w)}, count(*) FROM {source_sql('orders')} AS o" for r, c, w in (
        ("priority_given", "'o_orderpriority'", f"NOT {d_blank('o_orderpriority')}"), ("status_known", "'o_orderstatus'", "o_orderstatus NOT IN ('F', 'O')"),
        ("known_customer", "NULL", f"o_custkey NOT IN (SELECT c_custkey FROM {source_sql('customer')})")))]) + ")")
def rules_that_fail(spark, sf_dir):
    """Conditions that break on some row become findings of their own; the other rules of the table are counted all the same."""
    return rules.evaluate(spark, texts(spark, sf_dir, "orders", "customer"), FRAGILE, AUDIT_TIME).select("rule", "table", "column", "count", "total")


ACROSS = rules.parse([
    {"id": "shipped_late", "table": "lineitem", "expect": "across", "other": "orders", "on": ["l_orderkey = o_orderkey"], "left": "CAST(l_shipdate AS DATE)", "op": ">", "right": "CAST(o_orderdate AS DATE) + INTERVAL 90 DAY"},
    {"id": "urgent_returned", "table": "orders", "expect": "across", "other": "lineitem", "on": ["o_orderkey = l_orderkey"],
     "where": "orders.o_orderpriority = '1-URGENT' AND lineitem.l_returnflag = 'R' AND CAST(lineitem.l_shipdate AS DATE) > CAST(orders.o_orderdate AS DATE) + INTERVAL 60 DAY"},
    {"id": "after_last_order", "table": "lineitem", "expect": "across", "other": "orders", "left": "CAST(l_shipdate AS DATE)", "op": "<=", "right": "CAST(o_orderdate AS DATE) - INTERVAL 1200 DAY"},
    {"id": "same_day_events", "table": "orders", "expect": "across", "other": "events", "on": ["o_custkey = user_id"], "left": "CAST(o_orderdate AS DATE)", "op": ">=", "right": "CAST(day AS DATE) + INTERVAL 10 DAY"},
])


def across_sql(rule: rules.Rule) -> str:
    keys = [f"{rule.table}.{a.strip()} = {rule.other}.{b.strip()}" for a, b in (k.split("=") for k in rule.on)]
    where = " AND ".join([*keys, rule.where or f"{rule.left} {rule.op} {rule.right}"])
    return (f"SELECT '{rule.id}' AS rule, '{rule.table}' AS \"table\", count(*) AS count, (SELECT count(*) FROM {rule.table}) AS total, true AS verified FROM {source_sql(rule.table)} AS {rule.table} "
            f"WHERE EXISTS (SELECT 1 FROM {source_sql(rule.other)} AS {rule.other} WHERE {where}) HAVING count(*) > 0")


@query(union(across_sql(r) for r in ACROSS))
def rules_across_tables(spark, sf_dir):
    """Rules over two tables, by keys or without, counted as rules and again by their evidence."""
    found = rules.evaluate(spark, texts(spark, sf_dir, "orders", "lineitem", "events"), ACROSS, AUDIT_TIME)
    return findings.verified(found).select("rule", "table", "count", "total", "verified")


# ---- rules about rules, E8 and E13-E21 ------------------------------------------------------------------------------
META_RULES = rules.parse([
    {"id": "no_future", "table": "orders", "column": "o_orderdate", "expect": "not_future"},
    {"id": "nowhere", "table": "absent*", "column": "x", "expect": "unique"},
    {"id": "cannot_run", "table": "orders", "expect": "sql", "where": "no_such_column > 1"},
    {"id": "orphan_parent", "table": "orders", "column": "o_custkey", "expect": "references", "references": "gone.id"},
])


@query(f"SELECT 'no_future' AS rule, 'orders' AS \"table\", 'o_orderdate' AS \"column\", count(*) AS count, (SELECT count(*) FROM orders) AS total FROM orders WHERE CAST(o_orderdate AS DATE) > {_PAST} "
       "UNION ALL SELECT 'rule.never_applied', NULL, NULL, 0, 0 UNION ALL SELECT 'rule.invalid', 'orders', NULL, 0, 0 UNION ALL SELECT 'rule.invalid', 'orders', 'o_custkey', 0, 0")
def rules_about_rules(spark, sf_dir):
    """A rule about the future, and rules that match nothing or cannot run."""
    return rules.evaluate(spark, texts(spark, sf_dir, "orders"), META_RULES, PAST).select("rule", "table", "column", "count", "total")


@query(f"SELECT 'same' AS proposal, false AS accepted, CAST(NULL AS BIGINT) AS violations UNION ALL SELECT 'right', true, count(*) FROM {source_sql('orders')} WHERE NOT {d_blank('o_orderpriority')} "
       f"UNION ALL SELECT 'wrong', false, count(*) FROM {source_sql('orders')} WHERE NOT {d_blank('o_orderpriority')} UNION ALL SELECT 'vocabulary', true, 0 UNION ALL SELECT 'wide', false, NULL UNION ALL SELECT 'nowhere', false, NULL")
def rule_proposals(spark, sf_dir):
    """Proposed rules: one already in force, one that breaks as often as claimed, one that does not, vocabularies, and one that applies nowhere."""
    t = texts(spark, sf_dir, "orders")
    claimed = t["orders"].where(f"NOT {P.non_blank('o_orderpriority')}").count()
    given = rules.Rule("given", "orders", "not_null", "o_orderpriority")
    said = [("same", given, 0, [given]), ("right", given, claimed, []), ("wrong", given, claimed + 1, []), ("vocabulary", rules.Rule("v", "orders", "one_of", "o_orderpriority", values_from="current"), 0, []),
            ("wide", rules.Rule("w", "orders", "one_of", "o_orderkey", values_from="current"), 0, []), ("nowhere", rules.Rule("n", "absent", "not_null", "x"), 0, [])]
    told = [(name, out["accepted"], out["violations"]) for name, rule, n, force in said for out in [rules.propose(spark, t, rule, n, force, AUDIT_TIME)]]
    return spark.createDataFrame(told, "proposal string, accepted boolean, violations long")


# ---- findings: export, order, gate, history, offending rows ---------------------------------------------------------
_ID = "left(sha256(concat_ws(chr(0), rule, \"table\", coalesce(\"column\", ''))), 16)"


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(spark, texts(spark, sf_dir, "orders", "customer"), RULES, AUDIT_TIME)


@query(f"SELECT {_ID} AS id, rule, CASE WHEN rule = 'cents_positive' THEN 'warning' ELSE 'error' END AS severity, CASE WHEN rule = 'cents_positive' THEN 'warning' ELSE 'error' END AS level, count, total, round(count::DOUBLE / total, 6) AS share FROM ({ORACLE_SQL['rule_violations']})")
def findings_export(spark, sf_dir):
    return findings.export(violations(spark, sf_dir)).select("id", "rule", "severity", "level", "count", "total", "share")


@query(f"SELECT rank, rule FROM (SELECT row_number() OVER (ORDER BY CASE WHEN rule = 'cents_positive' THEN 1 ELSE 2 END DESC, \"table\", \"column\" NULLS FIRST, rule) AS rank, rule FROM ({ORACLE_SQL['rule_violations']}))")
def findings_in_order(spark, sf_dir):
    return findings.ranked(violations(spark, sf_dir)).select("rank", "rule")


@query(f"SELECT run_id, findings, error, warning, info FROM (SELECT count(*) AS findings, count(*) FILTER (rule <> 'cents_positive') AS error, count(*) FILTER (rule = 'cents_positive') AS warning, 0::BIGINT AS info FROM ({ORACLE_SQL['rule_violations']})), (VALUES ('first'), ('second')) t(run_id)")
def run_history(spark, sf_dir):
    """Two runs kept, one of them written twice, and read again."""
    path = fresh_path(spark)
    found = prof.settled(violations(spark, sf_dir))
    for run in ("first", "second", "first"):
        findings.write_history(found, path, run)
    return findings.runs(findings.read_history(spark, path)).select("run_id", "findings", "error", "warning", "info")


_NEGATIVE = f"FROM {source_sql('orders')} WHERE {d_blank('o_cents')} AND coalesce({d_number('o_cents')}, 0) < 0"


@query(f"SELECT o_orderkey, o_cents, (SELECT count(*) {_NEGATIVE}) > 1000 AS cut FROM (SELECT o_orderkey, o_cents {_NEGATIVE} ORDER BY o_orderkey, o_cents LIMIT 1000)")
def offending_rows(spark, sf_dir):
    """The rows behind a finding: the first thousand by key, and whether there are more."""
    row = violations(spark, sf_dir).where("rule = 'cents_not_negative'").first()
    rows, cut = findings.offending_rows(spark, row["row_query"], 1000, ("o_orderkey", "o_cents"))
    return rows.select("o_orderkey", "o_cents", F.lit(cut).alias("cut"))


@query(f"SELECT min_severity, EXISTS (SELECT 1 FROM ({ORACLE_SQL['rule_violations']}) WHERE (min_severity = 2 AND rule <> 'cents_positive') OR min_severity < 2) AS reached FROM (VALUES (0), (1), (2), (3)) t(min_severity) WHERE min_severity < 3 UNION ALL SELECT 3, false")
def severity_gate(spark, sf_dir):
    return findings.gate(violations(spark, sf_dir), spark.range(4).select(F.col("id").cast("int").alias("min_severity")))


# ---- scoring against a manifest -----------------------------------------------------------------------------------------
_SCORED = ORACLE_SQL["rule_violations"]


@query(f"SELECT outcome, rule, \"table\", coalesce(\"column\", '') AS \"column\" FROM (SELECT CASE WHEN rule LIKE 'cents%' THEN 'found' END AS outcome, rule, \"table\", \"column\" FROM ({_SCORED})) WHERE outcome IS NOT NULL UNION ALL SELECT 'missed', 'column.empty', 'orders', 'o_cents' "
       f"UNION ALL SELECT 'converted', NULL, 'orders', 'o_orderstatus' FROM ({_SCORED}) WHERE rule = 'status_known' UNION ALL SELECT 'uncovered', NULL, 'orders', 'o_orderkey' UNION ALL SELECT 'false positive', rule, \"table\", \"column\" FROM ({_SCORED}) WHERE rule = 'priority_given'")
def scored_checks(spark, sf_dir):
    """Findings of the rules, held against a manifest of defects and clean places."""
    found = prof.settled(violations(spark, sf_dir))
    n = found.where("rule = 'status_known'").first()["count"]
    known = [(r["rule"], r["table"], r["column"], []) for r in found.where("rule LIKE 'cents%'").collect()]
    defects = spark.createDataFrame([*known, ("column.empty", "orders", "o_cents", []), (None, "orders", "o_orderstatus", [n]), (None, "orders", "o_orderkey", [-1])], "rule string, `table` string, `column` string, counts array<long>")
    return score.score_checks(found, defects, spark.createDataFrame([("orders", "o_orderpriority")], "`table` string, `column` string"))


@query(f"SELECT 'stale' AS id, count(*) AS measured FROM {source_sql('orders')} WHERE o_cents = 'pending'")
def invalid_targets(spark, sf_dir):
    """Targets of a manifest whose own query no longer gives their count."""
    texts(spark, sf_dir, "orders")
    pending = "SELECT count(*) FROM orders WHERE o_cents = 'pending'"
    n = spark.sql(pending).first()[0]
    return score.invalid_targets(spark.createDataFrame([("right", pending, [n]), ("stale", pending, [n + 1])], "id string, count_query string, counts array<long>"))


# ---- delimited files: given tables written out in many parts and read again -------------------------------------------
PARTS = 4


def dealt(lines: DataFrame) -> DataFrame:
    """A frame over PARTS partitions, or as many as its input is read in: so files are many where there is much, and none outgrows a task."""
    return lines.repartition(max(PARTS, lines.rdd.getNumPartitions()))


def stored(spark: SparkSession, folder: str, stem: str, lines: DataFrame, extension: str, form: str = "csv", **options: str) -> None:
    """A frame as stem_N.extension files of a folder, one for each partition that holds rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    lines.write.options(**options).format(form).save(f"{folder}/.{stem}")
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(at(f"{folder}/.{stem}")) if f.getPath().getName().startswith("part-") and f.getLen()]
    for i, part in enumerate(sorted(parts, key=str)):
        fs.rename(part, at(f"{folder}/{stem}_{i}.{extension}"))


def short_orders(spark: SparkSession, sf_dir: str, folder: str) -> dict:
    """orders as .csv, all columns; rows whose customer's key ends in 7 are cut short."""
    t = texts(spark, sf_dir, "orders")["orders"]
    whole, head = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in t.columns]), F.lit(",".join(t.columns))
    body = dealt(t.select(F.when(F.col("o_custkey").rlike("7$"), F.concat_ws(",", "o_orderkey", "o_custkey")).otherwise(whole).alias("value")))
    first = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) == 0  # of its partition: each file begins with the header
    stored(spark, folder, "orders", body.select(F.when(first, F.concat(head, F.lit("\n"), F.col("value"))).otherwise(F.col("value")).alias("value")), "csv", "text")
    return delimited.read_folder(spark, folder)


def together(read: dict, stem: str) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [df for name, df in sorted(read["tables"].items()) if name.startswith(stem)])


_SHORT = "regexp_matches(o_custkey, '7$')"
_ORDERS = ", ".join(f"nullif({c}, '') AS {c}" for c in INPUTS["orders"])


@query(f"SELECT {_ORDERS} FROM {source_sql('orders')} WHERE NOT {_SHORT}")
def delimited_rows(spark, sf_dir):
    """Rows of comma-separated files that fit their headers."""
    return together(short_orders(spark, sf_dir, fresh_path(spark)), "orders")


@query(f"SELECT 'MISSING COLUMNS' AS error_type, o_orderkey || ',' || o_custkey AS raw, true AS numbered FROM {source_sql('orders')} WHERE {_SHORT}")
def delimited_rejects(spark, sf_dir):
    """Rows that do not fit, put aside with their lines' numbers."""
    return short_orders(spark, sf_dir, fresh_path(spark))["rejects"].select("error_type", "raw", (F.col("line") > 1).alias("numbered"))


QUOTED = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true"}


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(lang, '') AS lang, nullif(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars, nullif(text, '') AS text FROM documents")
def delimited_spanning_values(spark, sf_dir):
    """Whole documents as tab-separated files whose quoted texts span lines."""
    folder = fresh_path(spark)
    stored(spark, folder, "docs", dealt(texts(spark, sf_dir, "documents")["documents"]), "tsv", sep="\t", **QUOTED)
    return together(delimited.read_folder(spark, folder), "docs").select("doc_id", "lang", "source", "n_chars", "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, nullif(role, '') AS role, nullif(text, '') AS text FROM conversations")
def delimited_utf16(spark, sf_dir):
    """Conversations in an encoding whose line ends have two bytes."""
    folder = fresh_path(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("CAST(conv_id AS STRING) AS conv_id", "CAST(turn AS STRING) AS turn", "role", "text")
    stored(spark, folder, "talk", dealt(rows), "csv", encoding="UTF-16", **QUOTED)
    return together(delimited.read_folder(spark, folder), "talk")


def nameless_parts(spark: SparkSession, sf_dir: str) -> dict:
    folder = fresh_path(spark)
    stored(spark, folder, "part", dealt(texts(spark, sf_dir, "part")["part"]), "psv", sep="|")
    return delimited.read_folder(spark, folder)


@query("SELECT " + ", ".join(f"{c} AS column_{i}" for i, c in enumerate(INPUTS["part"], 1)) + f" FROM {source_sql('part')}")
def delimited_without_header(spark, sf_dir):
    return together(nameless_parts(spark, sf_dir), "part")


@query(f"SELECT 'csv.no_header' AS code, count(*) AS rows FROM {source_sql('part')}")
def file_notes(spark, sf_dir):
    """Notes on the headers of files, and the rows of the files they are about."""
    read = nameless_parts(spark, sf_dir)
    sizes = together({"tables": {n: df.select(F.lit(n).alias("table")) for n, df in read["tables"].items()}}, "part").groupBy("table").count()
    return read["notes"].where("code LIKE 'csv.%header%'").join(sizes, "table").groupBy("code").agg(F.sum("count").alias("rows"))


@query("SELECT 'folder' AS kind, 'hidden' AS skip_reason, CAST(NULL AS BIGINT) AS rows UNION ALL SELECT 'csv', 'empty file', NULL UNION ALL SELECT 'excel', 'a lock file of an open workbook', NULL UNION ALL SELECT 'other', NULL, NULL "
       f"UNION ALL SELECT 'csv', NULL, count(*) FROM {source_sql('supplier')}")
def discovered_files(spark, sf_dir):
    """Every entry of a folder: files that are read, with their rows, one of them under a name that Spark's readers leave out, and the others with a reason."""
    folder, at = fresh_path(spark), spark._jvm.org.apache.hadoop.fs.Path
    stored(spark, folder, "supplier", dealt(texts(spark, sf_dir, "supplier")["supplier"]), "csv", header="true")
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(at(f"{folder}/supplier_0.csv"), at(f"{folder}/_supplier_0.csv"))
    for name in ("empty.csv", "~$open.xlsx", "notes.md"):
        fs.create(at(f"{folder}/{name}")).close()
    read = delimited.read_folder(spark, folder)
    rows = together(read, "supplier").count()
    files = read["files"].where("rel NOT LIKE '%.crc'").groupBy("kind", "skip_reason").agg(F.count("*").alias("files"))
    return files.select("kind", "skip_reason", F.when((F.col("kind") == "csv") & F.col("skip_reason").isNull(), F.lit(rows)).cast("long").alias("rows"))
