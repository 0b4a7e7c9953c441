"""Registered queries over runs, documents, references that are inferred, and what is asked of an audit afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import adhoc, checks, findings, relate, rules, score
from ..operators import profile as prof
from ..operators.histogram import histogram
from ..sources.written import fresh_path
from . import record
from .audit_queries import (_SHORT, AUDIT_TIME, INPUTS, ORACLE_SQL, counts_sql, d_blank, d_list, d_shape, kinds_sql, nameless_parts, query, short_orders, source_sql, texts, together, union, violations)

_BROKEN = ORACLE_SQL["rule_violations"]
_SEVERITY = "CASE WHEN rule = 'cents_positive' THEN 'warning' ELSE 'error' END"


# ---- a run's own record ---------------------------------------------------------------------------------------------
class Broken(Exception):
    pass


def recorded(spark: SparkSession, sf_dir: str) -> str:
    """A folder with four runs: one that ends, one that breaks, one that is written again and one that breaks when written again."""
    path, found = fresh_path(spark), prof.settled(violations(spark, sf_dir))

    def breaks() -> DataFrame:
        raise Broken("a text that is not kept")

    for run, produce in (("ends", lambda: found), ("breaks", breaks), ("again", breaks), ("again", lambda: found.where("rule LIKE 'cents%'")), ("broken_again", lambda: found), ("broken_again", breaks)):
        try:
            record.record(spark, path, run, produce)
        except Broken:
            pass
    return path


@query(f"SELECT run_id, 'succeeded' AS status, true AS timed, count(*) FILTER ({_SEVERITY} = 'error') AS error, count(*) FILTER ({_SEVERITY} = 'warning') AS warning, 0::BIGINT AS info, NULL AS message "
       f"FROM ({_BROKEN}), (VALUES ('ends'), ('again')) t(run_id) WHERE run_id = 'ends' OR rule LIKE 'cents%' GROUP BY run_id "
       "UNION ALL SELECT run_id, 'failed', true, NULL, NULL, NULL, 'Broken' FROM (VALUES ('breaks'), ('broken_again')) t(run_id)")
def recorded_runs(spark, sf_dir):
    """Status, counts and duration of runs: their last try."""
    return record.runs(spark, recorded(spark, sf_dir)).select("run_id", "status", (F.col("duration_ms") >= 0).alias("timed"), "error", "warning", "info", "message")


@query(f"SELECT run_id, rule, {_SEVERITY} AS severity, count, total, row_number() OVER (PARTITION BY run_id ORDER BY {_SEVERITY}, \"table\", \"column\" NULLS FIRST, rule) AS place "
       f"FROM ({_BROKEN}), (VALUES ('ends'), ('again')) t(run_id) WHERE run_id = 'ends' OR rule LIKE 'cents%'")
def recorded_findings(spark, sf_dir):
    """Findings of complete runs only, each with its place."""
    return record.findings_of(spark, recorded(spark, sf_dir)).select("run_id", "rule", "severity", "count", "total", "place")


_DOCUMENTED = ("orders", "customer")


@query("SELECT * FROM (" + union([
    f"SELECT 'summary' AS block, {_SEVERITY} AS name, count(*) AS n, CAST(NULL AS VARCHAR) AS kind FROM ({_BROKEN}) GROUP BY ALL",
    f"SELECT 'finding', rule, count, {_SEVERITY} FROM ({_BROKEN})",
    *(f"SELECT 'table', '{t}', count(*), NULL FROM {t}" for t in _DOCUMENTED),
    *(f"SELECT 'column', '{t}.' || \"column\", \"distinct\", kind FROM ({counts_sql(t)}) JOIN ({kinds_sql(t)}) USING (\"column\")" for t in _DOCUMENTED),
    f"SELECT 'dataset', 'rows', {' + '.join(f'(SELECT count(*) FROM {t})' for t in _DOCUMENTED)}, NULL", "SELECT 'run', 'succeeded', 1, NULL"]) + ")")
def audit_document(spark, sf_dir):
    """The document of a run, taken apart again: run, dataset, summary, findings, tables and their columns."""
    path, found = fresh_path(spark), prof.settled(violations(spark, sf_dir))
    record.record(spark, path, "only", lambda: found)
    profiled = prof.settled(prof.profile(texts(spark, sf_dir, *_DOCUMENTED), AUDIT_TIME, parts=()))
    written = fresh_path(spark)
    record.write_document(record.document(spark, {"profile": profiled, "findings": found}, record.runs(spark, path)), written)
    doc = spark.read.json(written).persist()
    none = F.lit(None).cast("string")
    tables = doc.select(F.explode("tables").alias("t"))
    blocks = [
        doc.select(F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(f"finding_summary.{s}").alias("n")) for s in findings.SEVERITIES])).alias("x")).where("x.n > 0").select(F.lit("summary").alias("block"), "x.name", "x.n", none.alias("kind")),
        doc.select(F.explode("findings").alias("f")).select(F.lit("finding"), "f.rule", "f.count", "f.severity"),
        tables.select(F.lit("table"), "t.table", "t.rows", none),
        tables.select("t.table", F.explode("t.columns").alias("c")).select(F.lit("column"), F.concat_ws(".", "table", "c.column"), "c.distinct", "c.kind"),
        doc.select(F.lit("dataset"), F.lit("rows"), "dataset.rows", none),
        doc.select(F.lit("run"), "run.status", F.lit(1).cast("long"), none),
    ]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.union(b)
    return out


# ---- references that profiles suggest, R2, R4, R5, J6 -----------------------------------------------------------------
RELATED = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


def _each(make) -> str:
    return union(make(t, i, c) for t in RELATED for i, c in enumerate(INPUTS[t]))


_CUT = f"CASE WHEN length(s) > {prof.SHAPE_CUT} THEN left(s, {prof.SHAPE_CUT}) || '…' ELSE s END"
_SHAPE = (f"SELECT t, c, CASE WHEN n::DOUBLE / present >= {relate.DOMINANT} THEN {_CUT} END AS shape FROM (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY n DESC, s) AS rank FROM ("
          + _each(lambda t, i, c: f"SELECT '{t}' AS t, '{c}' AS c, {d_shape(c)} AS s, count(*) AS n, (SELECT count({c}) FROM {source_sql(t)}) AS present FROM {source_sql(t)} WHERE {d_blank(c)} GROUP BY 3") + ")) WHERE rank = 1")
_ORDINAL = "(VALUES " + ", ".join(f"('{t}', '{c}', {i})" for t in RELATED for i, c in enumerate(INPUTS[t])) + ") o(t, c, ordinal)"
_NO_ID = r"regexp_replace({x}, '_id$', '')"


def _bare(x: str) -> str:
    return f"regexp_replace({_NO_ID.format(x=x)}, '^_+|_+$', '', 'g')"


def _reference_bare(x: str) -> str:
    return f"regexp_replace(regexp_replace({_NO_ID.format(x=x)}, 'id$', ''), '^_+|_+$', '', 'g')"


_OWN = "(name = 'id' OR (bare <> '' AND bare <> name AND (" + " OR ".join(f"t = bare || '{e}' OR starts_with(t, bare || '{e}_')" for e in ("", "s", "es")) + ")))"
_ID_NAME = f"regexp_matches(name, '({'|'.join(relate.IDENTIFIER_ENDS)})$')"
_PROPOSED = f"""
WITH counted AS (SELECT "table" AS t, "column" AS c, * FROM ({union(counts_sql(t) for t in RELATED)})), kinds AS (SELECT "table" AS t, "column" AS c, kind FROM ({kinds_sql(*RELATED)})), shaped AS ({_SHAPE}),
 p0 AS (SELECT t, c, ordinal, kind, shape, total, total - nulls - blanks AS present, "distinct" AS d, total - nulls - blanks - sentinel_hits - numeric_sentinel_hits AS populated, lower(regexp_replace(c, '^[a-z]_', '')) AS name
        FROM counted JOIN kinds USING (t, c) JOIN {_ORDINAL} USING (t, c) LEFT JOIN shaped USING (t, c)),
 p AS (SELECT *, {_bare('name')} AS bare, {_reference_bare('name')} AS rbare FROM p0),
 own AS (SELECT *, {_OWN} AS own, {_ID_NAME} AS idlike, d::DOUBLE / nullif(present, 0) AS uniqueness FROM p),
 keys AS (SELECT * FROM own WHERE total >= 2 AND present > 0 AND kind <> 'empty' AND (uniqueness >= {relate.UNIQUE} OR (uniqueness >= {relate.NAMED_UNIQUE} AND own)) AND (kind <> 'decimal' OR idlike)),
 pairs AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, b.ordinal AS po, b.uniqueness, a.populated, a.shape = b.shape AS alike,
                  a.name = b.name OR (a.rbare <> '' AND starts_with(b.t, a.rbare) AND (b.name = 'id' OR b.name = a.rbare || '_id' OR b.name = a.name)) AS named
           FROM own a JOIN keys b ON a.kind = b.kind AND a.t <> b.t WHERE a.populated > 0 AND a.kind NOT IN ('empty', 'boolean') AND NOT a.own),
 best AS (SELECT t, c, pt, pc, named, populated FROM pairs WHERE named OR alike QUALIFY row_number() OVER (PARTITION BY t, c ORDER BY named DESC, uniqueness DESC, pt, po) = 1),
 v AS ({_each(lambda t, i, c: f"SELECT '{t}' AS t, '{c}' AS c, lower(trim({c})) AS v, count(*) AS n FROM {source_sql(t)} WHERE {d_blank(c)} GROUP BY 3")}),
 told AS (SELECT best.*, (SELECT coalesce(sum(v.n), 0) FROM v WHERE v.t = best.t AND v.c = best.c AND v.v NOT IN (SELECT k.v FROM v k WHERE k.t = best.pt AND k.c = best.pc))::BIGINT AS orphans FROM best)"""
_HELD = "(1.0::DOUBLE - orphans::DOUBLE / populated)"


def inferred_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between seven tables that names, kinds and shapes suggest, and how many rows break each: tables are read once, for the profile and for the orphans."""
    t = texts(spark, sf_dir, *RELATED)
    h = histogram(t).persist()
    profiled = prof.settled(prof.profile(t, AUDIT_TIME, h, parts=("shapes",)))
    proposed = prof.settled(relate.propose_references(profiled, relate.candidate_keys(profiled, "^[a-z]_"), "^[a-z]_"))
    out = prof.settled(relate.orphans(h, proposed))  # a row per column at most
    h.unpersist()
    return out


@query(f'{_PROPOSED} SELECT t AS "table", c AS "column", pt AS parent_table, pc AS parent_column, named, populated, orphans FROM told')
def proposed_references(spark, sf_dir):
    return inferred_references(spark, sf_dir).select("table", "column", "parent_table", "parent_column", "named", "populated", "orphans")


@query(f"""{_PROPOSED} SELECT 'reference.orphan_values' AS rule, t AS "table", c AS "column", orphans AS count, populated AS total, true AS verified FROM told
           WHERE orphans > 0 AND (named OR {_HELD} >= {relate.CONTAINED}) AND {_HELD} >= {relate.LEAST_CONTAINED}""")
def orphan_values(spark, sf_dir):
    """Rows that break inferred references, counted again by their own evidence."""
    return findings.verified(relate.orphan_findings(inferred_references(spark, sf_dir))).select("rule", "table", "column", "count", "total", "verified")


# ---- findings about files, T2 and T5 ------------------------------------------------------------------------------------
@query(f"SELECT 'table.unreadable_rows' AS rule, 2 AS severity, count(*) FILTER ({_SHORT}) AS count, count(*) AS total FROM {source_sql('orders')} HAVING count(*) FILTER ({_SHORT}) > 0")
def unreadable_rows(spark, sf_dir):
    """Findings about rows of files that do not fit, summed over the files."""
    read = short_orders(spark, sf_dir, fresh_path(spark))
    found = checks.table_checks(spark, read["tables"], prof.settled(prof.sizes(read["tables"])), read["notes"], read["rejects"])
    return found.where("rule = 'table.unreadable_rows'").groupBy("rule", "severity").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


@query(f"SELECT rule, severity, count(*) AS rows FROM {source_sql('part')}, (VALUES ('csv.no_header', 0), ('no.such_note', 0)) t(rule, severity) GROUP BY ALL")
def structure_notes(spark, sf_dir):
    """Findings made of notes on files, known ones and one that no list holds, with the rows of the files they are about."""
    read = nameless_parts(spark, sf_dir)
    profiled = prof.settled(prof.sizes(read["tables"]))
    notes = read["notes"].where("code = 'csv.no_header'")
    notes = notes.unionByName(notes.withColumns({"code": F.lit("no.such_note"), "message": F.lit("something else")}))
    found = checks.table_checks(spark, read["tables"], profiled, notes).where("rule IN ('csv.no_header', 'no.such_note')")
    return found.join(profiled.groupBy("table").agg(F.max("total").alias("rows")), "table").groupBy("rule", "severity").agg(F.sum("rows").alias("rows"))


# ---- what is asked of a profile and of findings, Q5 and Q6 --------------------------------------------------------------
_LISTED = ("orders", "customer", "nation")


@query(union(f"SELECT '{t}' AS \"table\", {len(INPUTS[t])}::BIGINT AS columns, count(*) AS \"rows\" FROM {t}" for t in _LISTED))
def listed_tables(spark, sf_dir):
    return adhoc.list_tables(prof.profile(texts(spark, sf_dir, *_LISTED), AUDIT_TIME, parts=()))


@query("SELECT \"column\", kind, total, nulls + blanks + sentinel_hits + numeric_sentinel_hits AS missing, \"distinct\", total > 0 AND nulls = 0 AND \"distinct\" = total AS is_unique, '⟨' || shape || '⟩' AS shape "
       f"FROM ({counts_sql('orders')}) JOIN ({kinds_sql('orders')}) USING (\"column\") LEFT JOIN (SELECT c AS \"column\", s AS shape FROM ("
       + union(f"SELECT '{c}' AS c, {d_shape(c)} AS s, row_number() OVER (ORDER BY count(*) DESC, {d_shape(c)}) AS rank FROM {source_sql('orders')} WHERE {d_blank(c)} GROUP BY {d_shape(c)}" for c in INPUTS["orders"])
       + ") WHERE rank = 1) USING (\"column\")")
def described_table(spark, sf_dir):
    return adhoc.describe_table(prof.profile(texts(spark, sf_dir, "orders"), AUDIT_TIME, parts=("shapes",)), "orders")


def _part_sql(what: str, value: str, where: str, whole: str, shown: str) -> str:
    return (f"SELECT '{what}' AS what, {shown} AS value, n AS count, round(n::DOUBLE / (SELECT {whole} FROM {source_sql('orders')}), 6) AS share FROM (SELECT {value} AS v, count(*) AS n FROM {source_sql('orders')} WHERE {where} GROUP BY 1 "
            f"ORDER BY n DESC, v LIMIT {prof.SHAPES})")


@query(union([_part_sql("shape", d_shape("o_orderpriority"), d_blank("o_orderpriority"), "count(o_orderpriority)", "'⟨' || v || '⟩'"),
              _part_sql("placeholder", "lower(trim(o_orderpriority))", f"lower(trim(o_orderpriority)) IN {d_list(P.TEXT_SENTINELS + P.NUMERIC_SENTINELS)}", "count(*)", "v")]))
def profiled_column(spark, sf_dir):
    """The shapes and placeholders of one column, without its cells."""
    one = adhoc.profile_column(prof.settled(prof.profile(texts(spark, sf_dir, "orders"), AUDIT_TIME, parts=("shapes", "sentinels"))), "orders", "o_orderpriority")
    parts = [one.select(F.lit(what).alias("what"), F.explode(c).alias("x")).select("what", "x.value", "x.count", F.round("x.share", 6).alias("share")) for what, c in (("shape", "shapes"), ("placeholder", "sentinels"))]
    return parts[0].union(parts[1])


@query(f"SELECT rule, count FROM ({_BROKEN}) WHERE \"table\" = 'orders' AND \"column\" = 'o_cents'")
def known_findings(spark, sf_dir):
    """What is already reported of one column."""
    return adhoc.known_at(violations(spark, sf_dir), "orders", "o_cents").select("rule", "count")


# ---- claims of several runs against targets, M3 and M4 --------------------------------------------------------------------
_CLAIMS = ("SELECT 'a' AS run, \"table\", coalesce(\"column\", '') AS \"column\", count FROM f UNION ALL SELECT 'b', \"table\", coalesce(\"column\", ''), count FROM f WHERE rule LIKE 'cents%' "
           "UNION ALL SELECT 'b', \"table\", coalesce(\"column\", ''), count + 1 FROM f WHERE rule IN ('status_known', 'custkey_digits')")
_MATCHED = (f"WITH f AS ({_BROKEN}), c AS ({_CLAIMS}), t AS (SELECT rule AS id, \"table\", coalesce(\"column\", '') AS \"column\", count FROM f WHERE rule <> 'customer_exists'), "
            "m AS (SELECT run, \"table\", \"column\", c.count, t.id AS target, CASE WHEN t.id IS NULL AND \"table\" = 'orders' AND \"column\" = 'o_custkey' THEN 'spoiled on purpose' END AS noise FROM c LEFT JOIN t USING (\"table\", \"column\", count))")


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims of two runs, credited to targets; and the targets, which are what the rules find."""
    found = prof.settled(violations(spark, sf_dir))
    place = ["table", "column", "count"]
    claims = found.select(F.lit("a").alias("run"), *place).unionByName(found.where("rule LIKE 'cents%'").select(F.lit("b").alias("run"), *place)).unionByName(
        found.where("rule IN ('status_known', 'custkey_digits')").select(F.lit("b").alias("run"), "table", "column", (F.col("count") + 1).alias("count")))
    targets = found.where("rule <> 'customer_exists'").select(F.col("rule").alias("id"), "table", "column", F.array("count").alias("counts"))
    noise = spark.createDataFrame([("orders", "o_custkey", "spoiled on purpose")], "`table` string, `column` string, why string")
    return score.match_claims(claims, targets, noise), targets


@query(f'{_MATCHED} SELECT run, "table", "column", count, target, noise FROM m')
def matched_claims(spark, sf_dir):
    return matched(spark, sf_dir)[0]


@query(f"{_MATCHED} SELECT (SELECT count(DISTINCT run) FROM m) AS runs, (SELECT count(DISTINCT id) FROM t) AS targets, round((SELECT avg(hits) FROM (SELECT count(DISTINCT target) AS hits FROM m GROUP BY run)) / (SELECT count(DISTINCT id) FROM t), 6) AS mean_recall, "
       "round((SELECT count(DISTINCT target) FROM m)::DOUBLE / (SELECT count(DISTINCT id) FROM t), 6) AS coverage")
def recall_of_runs(spark, sf_dir):
    return score.recall(*matched(spark, sf_dir))


@query(f"{_MATCHED} SELECT id, (SELECT count(DISTINCT run) FROM m WHERE target = id) AS runs_found FROM t")
def runs_per_target(spark, sf_dir):
    return score.found_per_target(*matched(spark, sf_dir))


# ---- vocabularies over tables, and rules written and read again, W6, K5, E16, E19, E20 ----------------------------------------
_VOCABULARY = f"SELECT min(v) AS value FROM (SELECT o_orderstatus AS v FROM {source_sql('orders')} UNION ALL SELECT l_linestatus FROM {source_sql('lineitem')} UNION ALL SELECT role FROM {source_sql('conversations')}) WHERE {d_blank('v')} GROUP BY lower(trim(v))"


STATES = rules.Rule("states", "*", "one_of", "*", values_from="current", ignore_case=True)


@query(_VOCABULARY)
def vocabulary_of_tables(spark, sf_dir):
    """One vocabulary of three tables' columns."""
    return rules.vocabulary(STATES, states(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = texts(spark, sf_dir, "orders", "lineitem", "conversations")
    return {"orders": t["orders"].select("o_orderstatus"), "lineitem": t["lineitem"].select("l_linestatus"), "conversations": t["conversations"].select("role")}


@query(_VOCABULARY)
def rendered_rule(spark, sf_dir):
    """The same vocabulary, materialised in a rule, written as a rules file and taken out of it again."""
    text = rules.render([rules.materialize(STATES, states(spark, sf_dir))], {"states": "what the columns hold now"})
    lines = spark.createDataFrame([(line,) for line in text.splitlines()], "line string")  # a rule holds 50 values at most
    return lines.select(F.explode(F.from_json(F.regexp_extract("line", r"^ *values: (.*)$", 1), "array<string>")).alias("value"))
