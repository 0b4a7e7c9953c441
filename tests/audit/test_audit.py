"""The audit library on small tables of invented rows, and its queries against DuckDB."""

import random
import zipfile
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillet.functions import predicates as P
from quillet.operators import adhoc, checks, findings, relate, rules, score
from quillet.operators import profile as prof
from quillet.operators.histogram import histogram
from quillet.plans import audit_queries, record_queries  # noqa: F401  the second registers queries, too
from quillet.plans.audit import audit, audit_folder, write_report
from quillet.sources import delimited
from quillet.sources.tables import registered
from quillet.streaming import monitor

NOW = datetime(2024, 6, 1)
SF = "/root/testdata/sf0.001"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(F.expr(expr)).first()[0]


@pytest.mark.parametrize("kind,yes,no", [
    ("integer", ["12", " -3 ", "+007"], ["1.0", "", "12a", "1" * 19]), ("decimal", ["1.5", ".5", "2.", "1e3", "-7"], ["12d", "1_000", "NaN", "inf", "1,5"]),
    ("boolean", ["true", "F", "yes", "0"], ["on", "maybe"]), ("date", ["2024-01-31", "31/01/2024", "01/31/2024", "31.1.2024", "2024/1/31", "20240131"], ["2024", "2024-02-30", "03/04/24", "soon"]),
    ("timestamp", ["2024-01-31 10:20:30", "2024-01-31T10:20", "2024-01-31"], ["12:00", "2024", "epoch"])])
def test_kinds(spark, kind, yes, no):
    for v in yes:
        assert one(spark, P.OF_KIND[kind]("c"), v), v
    for v in no:
        assert not one(spark, P.OF_KIND[kind]("c"), v), v


def test_kinds_agree_with_duckdb(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("0123456789+-./: eTZtfyn") for _ in range(rng.randint(1, 10))) for _ in range(400)]
    words += [f"{rng.randint(1, 33)}{s}{rng.randint(1, 14)}{s}{rng.randint(1990, 2030)}" for s in "/-." for _ in range(60)] + [f"{rng.randint(1990, 2030)}-{rng.randint(1, 13):02d}-{rng.randint(1, 32):02d}" for _ in range(60)]
    got = spark.createDataFrame([(w,) for w in words], "c string").select("c", *[F.expr(P.OF_KIND[k]("c")).alias(k) for k in P.KINDS]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, c VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(words)))
    want = con.execute("SELECT c, " + ", ".join(f"coalesce({audit_queries.d_kind('c', k)}, false)" for k in P.KINDS) + " FROM t ORDER BY i").fetchall()
    for a, b in zip(got, want):
        assert [bool(x) for x in a[1:]] == list(b[1:]), (a, b)


def test_shape_mask_glob(spark):
    assert one(spark, P.shape("c"), "Ab-12é\t٣") == "XX-99X 9"
    assert one(spark, P.mask("c"), "x@y.org 123-45-6789 4111 1111 1111 1111 éa") == "[email] [national-id] [long-number] éa"
    assert one(spark, P.redacted("c"), "a1") == "⟨X9⟩" and one(spark, P.redacted("c"), "z" * 80) == "⟨" + "X" * 60 + "…⟩"
    assert one(spark, P.redacted("c", show_values=True), "to x@y.org") == "to [email]"
    assert P.glob("*.csv", "A.CSV") and not P.glob("*.csv", "sales.xlsx") and P.glob("sales.xlsx#*", "sales.xlsx#Q1")
    assert one(spark, P.is_ambiguous_date("c"), "03/04/2024") and not one(spark, P.is_ambiguous_date("c"), "03/03/2024") and not one(spark, P.is_ambiguous_date("c"), "13/04/2024")


def people(spark):
    rows = [("1", "Ann", "2023-01-05", "active", "10"), ("2", "Bob ", "2023-02-05", "Active", "20"), ("3", "Cy", "05/03/2023", "active", "-5"), ("4", "N/A", "06.04.2023", "inactive", "x"),
            ("4", None, "2031-01-01", "active", "40"), ("6", "", "not a date", "inactive", "50"), ("7", "Di", "1900-01-01", "active", "60"), ("7", "Di", "1900-01-01", "active", "60")]
    orders = [(str(i), str(i % 9 + 1), "usd", str(100 + i)) for i in range(30)]
    return registered({"persons": spark.createDataFrame(rows, "person_id string, name string, joined string, status string, amount string"),
                       "orders": spark.createDataFrame(orders, "order_id string, person_id string, currency string, price string")})


def test_profile(spark):
    t = people(spark)
    p = {(r["table"], r["column"]): r for r in prof.profile(t, NOW).collect()}
    name, joined, amount = p["persons", "name"], p["persons", "joined"], p["persons", "amount"]
    assert (name["nulls"], name["blanks"], name["sentinel_hits"], name["missing"], name["populated"]) == (1, 1, 1, 3, 5)
    assert (joined["kind"], joined["nonconforming"]) == ("date", 1) and amount["kind"] == "integer"
    assert (joined["temporal"]["future"], joined["temporal"]["implausible"]) == (1, 2)
    n = amount["numeric"]
    assert (n["count"], n["min"], n["max"], n["negative"], n["median"]) == (7, -5, 60, 1, 40)
    assert [(x["value"], x["count"]) for x in p["persons", "status"]["top_values"]] == [("active", 5), ("inactive", 2), ("Active", 1)]
    assert p["orders", "order_id"]["is_unique"] and not p["persons", "person_id"]["is_unique"]
    assert "top_values" not in prof.withheld(prof.profile(t, NOW)).columns


def test_profile_of_empty_table(spark):
    t = registered({"nothing": spark.createDataFrame([], "a string, b string")})
    assert [(r["column"], r["total"], r["kind"]) for r in prof.profile(t, NOW).orderBy("ordinal").collect()] == [("a", 0, "empty"), ("b", 0, "empty")]


def test_quantiles(spark):
    rng = random.Random(1)
    x = [rng.choice([rng.gauss(0, 1), 5.0, rng.expovariate(0.001)]) for _ in range(3001)]
    got = prof.quantiles(spark.createDataFrame([("t", "c", v, 1) for v in x], "`table` string, `column` string, x double, n long").groupBy("table", "column", "x").agg(F.sum("n").alias("n"))).first()
    want = duckdb.connect().execute("SELECT quantile_cont(x, [0.25, 0.5, 0.75]) FROM (SELECT unnest(?) AS x)", [x]).fetchone()[0]
    assert [got["p25"], got["median"], got["p75"]] == pytest.approx(want)


def test_audit_finds_what_is_planted(spark, tmp_path):
    t = people(spark)
    rule_list = rules.parse([{"id": "names", "table": "persons", "column": "name", "expect": "not_null"}, {"id": "gone", "table": "absent", "column": "x", "expect": "unique"},
                             {"id": "broken", "table": "persons", "expect": "sql", "where": "no_such > 1"}])
    out = audit(spark, t, NOW, rule_list)
    found = {(r["rule"], r["table"], r["column"]): r for r in out["findings"].collect()}
    want = {("key.duplicate_values", "persons", "person_id"): 2, ("column.type_violation", "persons", "joined"): 1, ("column.mixed_date_formats", "persons", "joined"): 2, ("column.ambiguous_dates", "persons", "joined"): 1,
            ("column.implausible_dates", "persons", "joined"): 2, ("column.future_dates", "persons", "joined"): 1, ("column.case_variants", "persons", "status"): 1, ("column.whitespace_padding", "persons", "name"): 1,
            ("column.unexpected_negative", "persons", "amount"): 1, ("table.duplicate_rows", "persons", None): 1, ("column.missing_values", "persons", "name"): 3, ("column.constant", "orders", "currency"): 30,
            ("column.type_violation", "persons", "amount"): 1, ("names", "persons", "name"): 2, ("reference.orphan_values", "orders", "person_id"): 9}
    assert {k: found[k]["count"] for k in want if k in found} == want
    assert {r for r, _, _ in found} >= {"rule.never_applied", "rule.invalid"}
    assert all(r["verified"] for r in found.values() if r["count_query"])
    severities = [r["severity"] for r in out["findings"].collect()]
    assert severities == sorted(severities, reverse=True)
    write_report(out, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/findings")).count() == len(found) and "top_values" not in spark.read.json(str(tmp_path / "report/profile")).columns
    assert adhoc.profile_column(out["profile"], "persons", "status").first()["shapes"][0]["value"] == "⟨XXXXXX⟩"
    assert findings.deduplicated(out["findings"]).count() == len(found) and adhoc.known_at(out["findings"], "persons", "joined").count() >= 4
    rows, cut = findings.offending_rows(spark, found["reference.orphan_values", "orders", "person_id"]["row_query"], 5)
    assert rows.count() == 5 and cut


def test_findings_verify_dedupe_history(spark, tmp_path):
    people(spark)
    base = ("r", 1, "check", "t", "", "persons", "name")
    f = spark.createDataFrame([(*base, 999, 8, "SELECT 0", None, "", None, False), ("r2", *base[1:], 3, 8, "SELECT count(*) FROM persons", None, "", None, False), ("r3", *base[1:], 3, 8, "SELECT nonsense FROM persons", None, "", None, False),
                               ("r4", *base[1:], 1, 1, None, None, "", None, False), ("table.empty", *base[1:], 0, 0, "SELECT 0", None, "", None, False), ("r4", 2, *base[2:], 7, 8, None, None, "", None, False)], findings.SCHEMA)
    kept = {r["rule"]: (r["count"], r["verified"]) for r in findings.verified(findings.deduplicated(f)).collect()}
    assert kept == {"r2": (8, True), "r4": (7, False), "table.empty": (0, True)}
    path = str(tmp_path / "history")
    for run in ("a", "b", "a"):
        findings.write_history(f, path, run)
    told = {r["run_id"]: r["findings"] for r in findings.runs(findings.read_history(spark, path)).collect()}
    assert told == {"a": 6, "b": 6}
    assert findings.reaches(f, 2) and not findings.reaches(f.where("severity < 2"), 2)
    assert findings.page(f, 1, 2).count() == 2
    assert {r["level"] for r in findings.export(f).collect()} == {"warning", "error"}


def test_names(spark):
    rows = [("orders_csv", "order_id", True), ("orders_csv", "customer_id", False), ("sales_xlsx_q1", "order_id", False), ("anything", "id", True), ("boxes", "box_id", True)]
    got = spark.createDataFrame(rows, "t string, c string, want boolean").select(relate.names_own_table(F.col("t"), F.col("c")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_vocabulary_and_proposals(spark):
    t = people(spark)
    rule = rules.Rule("status", "persons", "one_of", "status", values_from="current", ignore_case=True)
    made = rules.materialize(rule, t)
    assert made.values == ("Active", "inactive")
    assert rules.propose(spark, t, rule, 0, [], NOW)["accepted"] and not rules.propose(spark, t, rule, 3, [], NOW)["accepted"]
    assert "already" in rules.propose(spark, t, rule, 0, [made], NOW)["why"]
    with pytest.raises(rules.RuleError):
        rules.materialize(rules.Rule("x", "orders", "one_of", "absent", values_from="current"), t)
    text = rules.render([made], {"status": "seen so far"})
    assert "not in force" in text and rules.load(text)[0].values == made.values
    assert made.assertion_id() == rules.Rule(**{**made.__dict__, "message": "other words"}).assertion_id()
    again = rules.load(rules.render(audit_queries.RULES))
    assert [r.assertion_id() for r in again] == [r.assertion_id() for r in audit_queries.RULES]
    with pytest.raises(rules.RuleError):
        rules.load('{"version": 2, "rules": []}')
    for bad in ([{"id": "a", "table": "t", "expect": "odd"}], [{"id": "a", "table": "t", "column": "c", "expect": "unique"}] * 2, [{"id": "a", "table": "t", "column": "c", "expect": "range"}], [{"id": "a", "table": "t", "column": "c", "expect": "unique", "oops": 1}]):
        with pytest.raises(rules.RuleError):
            rules.parse(bad)
    with pytest.raises(rules.RuleError):
        rules.merge([made], [made])


def test_null_parent_does_not_hide_orphans(spark):
    t = registered({"c": spark.createDataFrame([("1",), ("9",)], "k string"), "p": spark.createDataFrame([("1",), (None,)], "k string")})
    out = rules.evaluate(spark, t, rules.parse([{"id": "r", "table": "c", "column": "k", "expect": "references", "references": "p.k"}]), NOW)
    assert [r["count"] for r in findings.verified(out).collect()] == [1]


def test_adhoc(spark):
    people(spark)
    out, cut = adhoc.run_sql(spark, "SELECT name, count(*) AS n FROM persons GROUP BY name", statistics=("n",), limit=3)
    assert cut and out.count() == 3 and all(r["name"] is None or r["name"].startswith("⟨") for r in out.collect())
    spark.sql("CREATE OR REPLACE TEMP VIEW kept AS SELECT 1 AS x")
    for text in ("DROP TABLE persons", "DROP VIEW kept", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x", "SELECT 1; SELECT 2", "SET a=b", "CREATE TABLE z AS SELECT 1", "FROM persons INSERT INTO t SELECT *", "nonsense"):
        with pytest.raises(ValueError):
            adhoc.run_sql(spark, text)
    assert adhoc.run_sql(spark, "SELECT 'a;b' AS v, (SELECT max(x) FROM kept) AS m;", statistics=("m",))[0].collect() == [("⟨X;X⟩", 1)]
    assert adhoc.run_sql(spark, "WITH w AS (SELECT * FROM kept) SELECT x FROM w UNION ALL VALUES (2)", statistics=("x",))[0].count() == 2
    key = adhoc.candidate_key(spark.table("persons"), ["person_id"]).first()
    assert (key["rows"], key["distinct_keys"], key["rows_in_duplicates"], key["is_key"]) == (8, 6, 4, False)
    p = prof.profile({"persons": spark.table("persons")}, NOW)
    assert adhoc.describe_table(p, "persons").count() == 5 and adhoc.list_tables(p).first()["rows"] == 8


def test_score(spark):
    f = spark.createDataFrame([("column.constant", 0, "check", "", "", "t", "a", 5, 5, None, None, "", None, True), ("mine", 2, "rule", "", "", "t", "b", 3, 5, None, None, "", None, True), ("odd", 0, "check", "", "", "t", "z", 1, 5, None, None, "", None, True)], findings.SCHEMA)
    defects = spark.createDataFrame([("column.constant", "t", "a", []), ("column.empty", "t", "a", []), (None, "t", "b", [3]), (None, "t", "c", [1])], "rule string, `table` string, `column` string, counts array<long>")
    out = score.score_checks(f, defects, spark.createDataFrame([("t", "z")], "`table` string, `column` string"))
    assert {r["outcome"]: r["n"] for r in score.summary(out).collect()} == {"found": 1, "missed": 1, "converted": 1, "uncovered": 1, "false positive": 1}
    claims = spark.createDataFrame([("r1", "t", "b", 3), ("r1", "t", "z", 1), ("r2", "t", "b", 4)], "run string, `table` string, `column` string, count long")
    targets = spark.createDataFrame([("d1", "t", "b", [3]), ("d2", "t", "c", [1])], "id string, `table` string, `column` string, counts array<long>")
    matched = score.match_claims(claims, targets, spark.createDataFrame([("t", "z", "noise")], "`table` string, `column` string, why string"))
    r = score.recall(matched, targets).first()
    assert (r["runs"], r["targets"], r["mean_recall"], r["coverage"]) == (2, 2, 0.25, 0.5)
    assert {x["id"]: x["runs_found"] for x in score.found_per_target(matched, targets).collect()} == {"d1": 1, "d2": 0}


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [(1, "", [("A1", "Sales report")]), (3, "", [("A3", "region"), ("B3", "units"), ("C3", "note")]), (4, "", [("A4", "north"), ("B4", "5"), ("C4", "x")]), (5, ' hidden="1"', [("A5", "south"), ("B5", "#REF!"), ("C5", "y")]), (7, "", [("A7", "TOTAL"), ("B7", "9")])]
    sheet = f'<worksheet {ns}><sheetData>' + "".join(f'<row r="{r}"{h}>' + "".join(cell(*c) for c in cs) + "</row>" for r, h, cs in rows) + '</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>'
    old = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row r="2"><c r="A2"><v>1</v></c></row></sheetData></worksheet>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Q1" sheetId="1" r:id="rId1"/><sheet name="Old" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="{rel}/worksheet"/><Relationship Id="rId2" Target="worksheets/sheet2.xml" Type="{rel}/worksheet"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", old)


def test_folder(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,name,region,region\n" + "".join(f"{i},Name {i},north,{i % 2}\n" for i in range(1, 9)))
    (tmp_path / "orders.csv").write_text("order_id,customer_id,amount\n1,1,10.5\n2,2\n3,3,7.5\n4,4,1,50\n5,99,3.5\n6,5,2\n")
    (tmp_path / "products.tsv").write_text("P-001\tTea\t4.50\nP-002\tCoffee\t6.00\nP-003\tCocoa\t5.25\n")
    (tmp_path / "regions.csv").write_bytes("code;city\nZH;Zürich\nMU;München\n".encode("latin-1"))
    (tmp_path / "legacy.xls").write_bytes(b"old")
    (tmp_path / "~$book.xlsx").write_bytes(b"lock")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "notes.md").write_text("not a table")
    workbook(tmp_path / "book.xlsx")
    out = audit_folder(spark, str(tmp_path), NOW)
    t = out["tables"]
    assert set(t) == {"customers_csv", "orders_csv", "products_tsv", "regions_csv", "book_xlsx_q1", "book_xlsx_old"}
    assert t["customers_csv"].columns == ["customer_id", "name", "region", "region_1"] and t["products_tsv"].columns == ["column_1", "column_2", "column_3"]
    assert all(k == "string" for df in t.values() for _, k in df.dtypes)
    assert t["orders_csv"].count() == 4
    assert [(r["line"], r["error_type"]) for r in out["rejects"].orderBy("line").collect()] == [(3, "MISSING COLUMNS"), (5, "TOO MANY COLUMNS")]
    assert sorted(r["city"] for r in t["regions_csv"].collect()) == ["München", "Zürich"]
    assert {r["rel"] for r in out["files"].where("skip_reason IS NOT NULL").collect()} == {"legacy.xls", "~$book.xlsx", "empty.csv"}
    assert t["book_xlsx_q1"].columns == ["region", "units", "note"] and t["book_xlsx_q1"].count() == 3
    codes = {(r["table"], r["code"]) for r in out["notes"].collect()}
    assert {("customers_csv", "csv.header_duplicate"), ("products_tsv", "csv.no_header"), ("regions_csv", "csv.encoding_not_utf8"), ("book_xlsx_q1", "excel.header_offset"), ("book_xlsx_q1", "excel.title_row"), ("book_xlsx_q1", "excel.hidden_rows"),
            ("book_xlsx_q1", "excel.formula_errors"), ("book_xlsx_q1", "excel.stacked_tables"), ("book_xlsx_q1", "excel.merged_cells"), ("book_xlsx_old", "excel.hidden_sheet")} <= codes
    found = {(r["rule"], r["table"]) for r in out["findings"].collect()}
    assert {("table.unreadable_rows", "orders_csv"), ("column.duplicate_header", "customers_csv"), ("reference.orphan_values", "orders_csv"), ("excel.hidden_rows", "book_xlsx_q1")} <= found


def test_values_that_span_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,n\n1,"two\nlines",5\n2,plain,6\n3,short\n4,"x ""y"", z\n\nend",7\n5,a,b,c\n')
    (tmp_path / "b.csv").write_text("id,n\n" + "".join(f"{i},{i}\n" for i in range(50)) + "9\n")
    out = delimited.read_folder(spark, str(tmp_path))
    rows = {r["id"]: (r["note"], r["n"]) for r in out["tables"]["a_csv"].collect()}
    assert rows == {"1": ("two\nlines", "5"), "2": ("plain", "6"), "4": ('x "y", z\n\nend', "7")}
    assert [(r["table"], r["line"], r["error_type"]) for r in out["rejects"].orderBy("table", "line").collect()] == [("a_csv", 5, "MISSING COLUMNS"), ("a_csv", 9, "TOO MANY COLUMNS"), ("b_csv", 52, "MISSING COLUMNS")]


def test_large_heads_and_line_numbers(spark, tmp_path, monkeypatch):
    """Heads of large files come alone; lines are numbered over the parts of a file."""
    monkeypatch.setattr(delimited, "WHOLE_BYTES", 100)
    (tmp_path / "big.csv").write_text("id;n\n" + "".join(f"{i};{i}\n" if i % 500 else f"{i}\n" for i in range(1, 2001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = delimited.read_folder(spark, str(tmp_path))
        assert out["tables"]["big_csv"].columns == ["id", "n"] and out["tables"]["big_csv"].count() == 1996
        assert [r["line"] for r in out["rejects"].orderBy("line").collect()] == [501, 1001, 1501, 2001]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_workbooks_side_by_side(spark, tmp_path):
    """Sheets and files of like names keep a table each, a broken workbook or sheet is noted, dates read as dates."""
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = ["Q 1", "Q-1", "Bad"]
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml" Type="{rel}/worksheet"/>' for i in range(3)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="[Red]0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i in range(2):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet {ns}><sheetData><row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{h}</t></is></c>' for c, h in zip("ABC", ("day", "at", "n"))) + '</row><row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.75</v></c><c r="C2" s="3"><v>45292</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", "<worksheet")
    (tmp_path / "broken.xlsx").write_bytes(b"PK not a workbook")
    (tmp_path / "x_xlsx_q_1.csv").write_text("a,b\n1,2\n3,4\n")
    out = delimited.read_folder(spark, str(tmp_path))
    assert len(out["tables"]) == 3 and {len(df.columns) for df in out["tables"].values()} == {2, 3}
    for name, df in out["tables"].items():
        if len(df.columns) == 3:
            assert df.collect() == [("2024-01-01", "2024-01-01 18:00:00", "45292")], name
    assert sorted(r["table"] for r in out["notes"].where("code = 'excel.sheet_unreadable'").collect()) == ["broken_xlsx", "x_xlsx_bad"]
    found = audit_folder(spark, str(tmp_path), NOW)["findings"].where("rule = 'excel.sheet_unreadable'").collect()
    assert len(found) == 2 and all(r["title"] == "could not be opened" and "could not be read" in r["observed"] for r in found)


def test_measure(spark):
    """Row counts of a table are taken together; a query's own fault gives null, and no other query is lost by it."""
    people(spark)
    told = findings.measure(spark, {"a": "SELECT count(*) FROM `persons` WHERE name = 'Ann'", "b": "SELECT count(*) FROM `persons` WHERE no_such = 1", "c": "SELECT count(*) FROM `persons` WHERE 1 / (length(person_id) - 1) > 0",
                                    "d": "SELECT 1 / 0", "e": "SELECT count(*) FROM `persons` WHERE name IN (SELECT name FROM persons WHERE name = 'Ann')", "f": "SELECT count(*) FROM (SELECT 1)", "g": "SELECT count(*) FROM `persons` WHERE amount = '60'"})
    assert told == {"a": 1, "b": None, "c": None, "d": None, "e": 1, "f": 1, "g": 2}


def test_delimiters():
    assert delimited.delimiter_of(["a;b;c", "1;2,5;3", "4;5,5;6"], "csv")[0] == ";"
    assert delimited.delimiter_of(['x,"a,b",c', "1,2,3"], "csv")[0] == ","
    assert delimited.split_line('1,"a ""b"", c",', ",") == ["1", 'a "b", c', ""]
    assert delimited.column_names(["x", "X", "", " y "]) == [("x", "x"), ("X_1", "X"), ("column_3", ""), ("y", "y")]
    assert delimited.table_names(["a/x.csv", "b/x.csv", "y.csv"]) == {"a/x.csv": "a_x_csv", "b/x.csv": "b_x_csv", "y.csv": "y_csv"}
    assert delimited.encoding_of("é".encode()[:1] + b"")[0] in ("UTF-8", "ISO-8859-1") and delimited.encoding_of(b"\xff\xfea\x00")[0] == "UTF-16"


def test_stream(spark, tmp_path):
    spark.range(100).selectExpr("cast(id AS string) AS k", "timestamp_seconds(1700000000 + id * 60) AS ts").write.parquet(str(tmp_path / "in"))
    rule_list = rules.parse([{"id": "small", "table": "s", "column": "k", "expect": "range", "max": 49}])
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    run = monitor.violations_per_window(stream, rule_list, "ts", NOW).writeStream.outputMode("complete").format("memory").queryName("violations").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("violations").agg(F.sum("rows")).first()[0] == 50


ORACLES = sorted(audit_queries.ORACLE_SQL)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = audit_queries.QUERIES[name](spark, SF)
    cur = con.execute(audit_queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    plain = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in cur.fetchall())
