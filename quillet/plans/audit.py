"""The whole audit: read, profile, check, evaluate rules, verify."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, findings, relate, rules
from ..operators.histogram import histogram
from ..operators.profile import profile, settled, withheld
from ..sources.delimited import read_folder


def audit(spark: SparkSession, tables: dict[str, DataFrame], audit_time: datetime, rule_list: list[rules.Rule] = (), notes: DataFrame | None = None,
          rejects: DataFrame | None = None, strip_prefix: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """profile and findings (verified, in order) of text tables that are registered as views of their names."""
    h = histogram(tables).persist()
    profiled = settled(profile(tables, audit_time, h))
    keys = relate.candidate_keys(profiled, strip_prefix)
    references = settled(relate.propose_references(profiled, keys, strip_prefix))
    found = checks.column_checks(profiled, audit_time)
    for more in (checks.table_checks(spark, tables, profiled, notes, rejects), relate.duplicate_keys(keys), relate.orphan_findings(relate.orphans(h, references)), relate.shared_domains(h, profiled)):
        found = found.unionByName(more)
    if rule_list:
        found = found.unionByName(rules.evaluate(spark, tables, list(rule_list), audit_time))
    found = findings.deduplicated(found)
    if verify:
        found = findings.verified(found)
    return {"profile": profiled, "findings": findings.ordered(found), "histogram": h, "references": references}


def audit_folder(spark: SparkSession, path: str, audit_time: datetime, rule_list: list[rules.Rule] = (), **kw) -> dict:
    """audit of a folder of files, with its files, notes and rejects."""
    read = read_folder(spark, path)
    return read | audit(spark, read["tables"], audit_time, rule_list, read["notes"], read["rejects"], **kw)


def write_report(out: dict[str, DataFrame], path: str, show_values: bool = False) -> None:
    """An audit's findings and profile as JSON under path; cell contents only if asked for."""
    findings.export(out["findings"]).write.mode("overwrite").json(f"{path}/findings")
    shown = out["profile"] if show_values else withheld(out["profile"])
    rounded = {c: F.round(c, 6) for c, t in shown.dtypes if t == "double"}
    shown.withColumns(rounded).write.mode("overwrite").json(f"{path}/profile")
    for part in ("files", "notes", "rejects"):
        if part in out:
            frame = out[part].drop("raw") if not show_values else out[part]
            frame.write.mode("overwrite").json(f"{path}/{part}")
