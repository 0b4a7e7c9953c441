"""Runs, their records, and the document of an audit."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillet.operators import findings
from quillet.operators import profile as prof
from quillet.plans import record
from quillet.plans.audit import audit, audit_folder
from quillet.sources.tables import registered

NOW = datetime(2024, 6, 1)


def found(spark, *said):
    return spark.createDataFrame([(rule, severity, "check", "t", "", table, column, 1, 4, None, None, "", None, False) for rule, severity, table, column in said], findings.SCHEMA)


def ticking():
    """A clock that moves 250 ms whenever it is read."""
    at = [datetime(2024, 1, 1, tzinfo=timezone.utc)]

    def read():
        at[0] += timedelta(milliseconds=250)
        return at[0]

    return read


def test_runs_tell_status_counts_and_time(spark, tmp_path):
    path, clock = str(tmp_path / "runs"), ticking()
    some = found(spark, ("b", 1, "t", "x"), ("a", 2, "t", None), ("c", 1, "s", "x"))
    record.record(spark, path, "7", lambda: some, clock)  # an id of digits stays a text
    record.record(spark, path, "none", lambda: some.where("false"), clock)
    told = {r["run_id"]: r for r in record.runs(spark, path).collect()}
    assert {k: (r["status"], r["error"], r["warning"], r["info"], r["duration_ms"], r["message"]) for k, r in told.items()} == {
        "7": ("succeeded", 1, 2, 0, 250, None), "none": ("succeeded", 0, 0, 0, 250, None)}
    assert [(r["run_id"], r["place"], r["rule"], r["severity"]) for r in record.findings_of(spark, path, "7").orderBy("place").collect()] == [("7", 1, "a", "error"), ("7", 2, "c", "warning"), ("7", 3, "b", "warning")]
    assert record.findings_of(spark, path, "none").count() == 0


def test_a_broken_run_is_never_complete(spark, tmp_path):
    path, clock = str(tmp_path / "runs"), ticking()
    some = found(spark, ("a", 2, "t", None))
    secret = "4111 1111"

    def while_writing():  # breaks in a task, after the run began
        return some.withColumn("title", F.raise_error(F.concat(F.lit(secret), "rule")).cast("string"))

    def interrupted():
        raise KeyboardInterrupt

    for run, produce, error in (("w", while_writing, Exception), ("i", interrupted, KeyboardInterrupt)):
        with pytest.raises(error):
            record.record(spark, path, run, produce, clock)
    told = {r["run_id"]: r for r in record.runs(spark, path).collect()}
    assert (told["w"]["status"], told["w"]["error"]) == ("failed", None) and told["w"]["message"] and secret not in told["w"]["message"]
    assert told["i"]["status"] == "canceled"
    assert record.findings_of(spark, path).count() == 0
    record.record(spark, path, "w", lambda: some, clock)
    assert [r["rule"] for r in record.findings_of(spark, path).collect()] == ["a"]
    with pytest.raises(Exception):
        record.record(spark, path, "w", while_writing, clock)
    assert {r["run_id"]: r["status"] for r in record.runs(spark, path).collect()}["w"] == "failed" and record.findings_of(spark, path).count() == 0


def test_findings_without_an_end_are_not_shown(spark, tmp_path):
    """What a driver leaves that died after its findings were written and before it could say so."""
    path = str(tmp_path / "runs")
    record._publish(spark, path, "r", "one", record.RUNNING, datetime(2024, 1, 1), None, None, None, None, None, None)
    record._keep(found(spark, ("a", 2, "t", None)), f"{path}/findings", "r", "one")
    assert [r["status"] for r in record.runs(spark, path).collect()] == ["running"] and record.findings_of(spark, path).count() == 0


def test_document(spark, tmp_path):
    rows = [(str(i), "Ann" if i % 3 else " bob", "1.00000012345", None) for i in range(12)]
    t = registered({"people": spark.createDataFrame(rows, "id string, name string, weight string, gone string"), "empty": spark.createDataFrame([], "id string")})
    out = audit(spark, t, NOW)
    path = str(tmp_path / "doc")
    record.write_document(record.document(spark, out), path)
    text = spark.read.text(path).first()[0]
    doc = json.loads(text)
    assert doc["schema"] == record.DOCUMENT and "Ann" not in text and not doc["redaction"]["values_shown"]
    assert doc["dataset"] == {"tables": 2, "columns": 5, "rows": 12}
    assert [x["table"] for x in doc["tables"]] == ["empty", "people"] and [c["column"] for c in doc["tables"][1]["columns"]] == ["id", "name", "weight", "gone"]
    n = doc["finding_summary"]
    assert n["error"] + n["warning"] + n["info"] == len(doc["findings"]) == out["findings"].count() and "run" not in doc
    assert [f["rule"] for f in doc["findings"]] == [r["rule"] for r in out["findings"].collect()]
    assert doc["tables"][1]["columns"][2]["numeric"]["mean"] == 1.0
    shown = record.document(spark, out, show_values=True).first()
    assert "Ann" in str(shown["tables"]) and shown["redaction"]["values_shown"]


def test_document_of_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,n\n1,2\n2,3,9\n3,4\n")
    (folder / "b.csv").write_text("")
    doc = record.document(spark, audit_folder(spark, str(folder), NOW)).first()
    assert [(r["rel"], r["skip_reason"]) for r in doc["skipped_files"]] == [("b.csv", "empty file")]
    assert [(r["table"], r["rows"]) for r in doc["unreadable_rows"]] == [("a_csv", 1)] and "first" not in doc["unreadable_rows"][0].asDict()
    assert all(w["code"] for w in doc["warnings"])


def test_parts_of_a_profile(spark):
    t = registered({"t": spark.createDataFrame([("a1",), ("b2",), (None,)], "c string")})
    bare, whole = prof.profile(t, NOW, parts=()), prof.profile(t, NOW)
    assert set(whole.columns) - set(bare.columns) == set(prof.PARTS)
    assert bare.collect() == whole.select(*bare.columns).collect()
    assert "min_value" not in prof.withheld(bare).columns
