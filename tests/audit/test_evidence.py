"""Evidence that only reads, and rules that outlive each other's faults."""

from datetime import datetime

import pytest

from quillet.operators import adhoc, findings, rules, score
from quillet.sources.tables import registered

NOW = datetime(2024, 6, 1)


@pytest.fixture
def two(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "file"))
    return registered({"o": spark.createDataFrame([("1", "5", "2024-01-05"), ("2", "x", "2024-02-01"), ("3", None, None), ("1", "7", "2024-03-01")], "id string, v string, d string"),
                       "c": spark.createDataFrame([("1", "2024-01-10"), ("1", "2024-01-01"), ("2", "2024-01-01"), (None, "2025-01-01")], "k string, s string")})


WRITES = ["INSERT INTO o VALUES ('1', '2', '3')", "DROP VIEW o", "CREATE TABLE made AS SELECT 1 AS n", "SET spark.sql.ansi.enabled=false", "WITH w AS (SELECT 1) INSERT INTO o SELECT * FROM w", "CACHE TABLE o",
          "FROM o INSERT INTO o SELECT * INSERT INTO o SELECT *", "ADD JAR '/tmp/x.jar'", "SELECT count(*) FROM o; DROP VIEW o", "not a query", ""]
ELSEWHERE = ["SELECT count(*) FROM parquet.`{}/file`", "SELECT (SELECT count(*) FROM parquet.`{}/file`)", "SELECT count(*) FROM o WHERE id IN (SELECT a FROM parquet.`{}/file`)", "WITH w AS (SELECT * FROM parquet.`{}/file`) SELECT count(*) FROM w",
             "SELECT length(reflect('java.lang.System', 'getProperty', 'user.dir'))", "SELECT count(*) FROM default.o", "SELECT count(*) FROM absent"]


def test_measure_only_reads(spark, two, tmp_path):
    queries = WRITES + [q.format(tmp_path) for q in ELSEWHERE]
    assert set(findings.measure(spark, {q: q for q in queries}, trusted=False).values()) == {None}
    assert not any(findings.reads_only(spark, q) for q in WRITES) and not any(findings.reads_views_only(spark, q) for q in queries)
    assert spark.table("o").count() == 4 and spark.conf.get("spark.sql.ansi.enabled") == "true" and not spark.catalog.tableExists("made")
    for q in queries:
        with pytest.raises(ValueError):
            adhoc.run_sql(spark, q)
    told = findings.measure(spark, {"n": "SELECT count(*) FROM O", "w": "WITH w AS (SELECT * FROM o) SELECT count(*) FROM w", "two": "SELECT id FROM o", "text": "SELECT max(id) FROM o", "none": "SELECT 1 WHERE false", "wide": "SELECT 1, 2", "true": "SELECT true"}, trusted=False)
    assert told == {"n": 4, "w": 4, "two": None, "text": None, "none": None, "wide": None, "true": None}


def test_claims_and_targets_only_read(spark, two):
    claims = spark.createDataFrame([("keep", "o", "v", "SELECT count(*) FROM o WHERE v = 'x'", 1), ("drop it", "o", "v", "DROP VIEW o", 0), ("write", "o", "v", "INSERT INTO o SELECT * FROM o", 4), ("nothing", "o", "v", "SELECT 1 WHERE false", 1)],
                                   "claim string, `table` string, `column` string, count_query string, claimed long")
    assert {r["rule"]: (r["measured"], r["accepted"]) for r in adhoc.verify_claims(claims).collect()} == {"claim.keep": (1, True), "claim.drop_it": (None, False), "claim.write": (None, False), "claim.nothing": (None, False)}
    targets = spark.createDataFrame([("a", "DROP VIEW o", [1]), ("b", "SELECT count(*) FROM o", [4])], "id string, count_query string, counts array<long>")
    assert [(r["id"], r["measured"]) for r in score.invalid_targets(targets).collect()] == [("a", None)]
    assert spark.table("o").count() == 4
    with pytest.raises(ValueError):
        findings.offending_rows(spark, "DROP VIEW o")


def test_rules_outlive_faults(spark, two):
    given = rules.parse([
        {"id": "cast", "table": "o", "expect": "sql", "where": "CAST(v AS INT) > 3"}, {"id": "zero", "table": "o", "expect": "sql", "where": "1 / (length(id) - 1) > 0"},
        {"id": "pattern", "table": "o", "column": "id", "expect": "matches", "pattern": "["}, {"id": "given", "table": "o", "column": "v", "expect": "not_null"}, {"id": "once", "table": "o", "column": "id", "expect": "unique"},
        {"id": "own_name", "table": "o", "expect": "sql", "where": "EXISTS (SELECT 1 FROM c WHERE c.k = o.id)"}, {"id": "cast_far", "table": "o", "expect": "across", "other": "c", "on": ["id = k"], "where": "CAST(o.v AS INT) < 9"},
        {"id": "no_table", "table": "o", "expect": "across", "other": "gone", "on": ["id = k"], "where": "true"}])
    found = rules.evaluate(spark, two, given, NOW)
    rows = [r.asDict() for r in found.collect()]
    assert {r["rule"]: (r["count"], r["total"]) for r in rows if r["rule"] != "rule.invalid"} == {"given": (1, 4), "once": (2, 4), "own_name": (3, 4)}
    broken = {r["title"].split(":")[0]: r["title"] for r in rows if r["rule"] == "rule.invalid"}
    assert set(broken) == {"cast", "zero", "pattern", "cast_far", "no_table"}
    assert "CAST_INVALID_INPUT" in broken["cast"] and "'x'" not in broken["cast"] and "DIVIDE_BY_ZERO" in broken["zero"]
    assert {r["rule"]: r["count"] for r in findings.verified(found).collect() if r["verified"]} == {"given": 1, "once": 2, "own_name": 3}


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_rules_across_tables(spark, op):
    own = [(str(i % 7) if i % 5 else None, f"2024-01-{1 + i * 7 % 28:02d}" if i % 11 else None) for i in range(60)]
    far = [(str(i % 9) if i % 4 else None, f"2024-01-{1 + i * 5 % 28:02d}" if i % 6 else None) for i in range(30)]
    t = registered({"own": spark.createDataFrame(own, "a string, d string"), "far": spark.createDataFrame(far, "b string, d string")})
    holds = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]

    def pairs(keyed):
        return sum(any((not keyed or (a is not None and a == b)) and x is not None and y is not None and holds(x, y) for b, y in far) for a, x in own)

    given = rules.parse([
        {"id": "compared", "table": "own", "expect": "across", "other": "far", "on": ["a = b"], "left": "CAST(own.d AS DATE)", "op": op, "right": "CAST(far.d AS DATE)"},
        {"id": "free", "table": "own", "expect": "across", "other": "far", "on": ["a = b"], "where": f"CAST(own.d AS DATE) {op} CAST(far.d AS DATE)"},
        {"id": "keyless", "table": "own", "expect": "across", "other": "far", "left": "CAST(own.d AS DATE)", "op": op, "right": "CAST(far.d AS DATE)"}])
    found = rules.evaluate(spark, t, given, NOW)
    want = {"compared": pairs(True), "free": pairs(True), "keyless": pairs(False)}
    assert {r["rule"]: r["count"] for r in found.collect()} == want
    assert {r["rule"]: r["count"] for r in findings.verified(found).collect()} == want


def test_across_is_validated():
    for bad in ({"other": ""}, {"other": "o"}, {"where": ""}, {"on": []}, {"on": ["a"]}, {"left": "x", "right": "y", "op": "<"}, {"where": "", "left": "x", "right": "y", "op": "="}):
        with pytest.raises(rules.RuleError):
            rules.parse([{"id": "r", "table": "o", "expect": "across", "other": "c", "on": ["a = b"], "where": "true"} | bad])


def test_identity_with_a_line(spark):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([("r", "t", "c", 7)], "rule string, `table` string, `column` string, line long")
    a, b, c, d = row.select(findings.identity(), findings.identity(F.col("line")), findings.identity(F.col("line") + 1), findings.identity(F.lit(0))).first()
    assert len({a, b, c}) == 3 and a == d


def test_offending_rows_beyond_the_limit(spark):
    registered({"many": spark.range(3000).selectExpr("cast(id as string) AS id")})
    rows, cut = findings.offending_rows(spark, "SELECT * FROM `many` WHERE id IS NOT NULL LIMIT 100", 1000, ("id",))
    assert cut and rows.count() == 1000 and rows.first()["id"] == "0"
    rows, cut = findings.offending_rows(spark, "SELECT * FROM `many` WHERE id < '1' LIMIT 100", 1000)
    assert not cut and [r["id"] for r in rows.collect()] == ["0"]
