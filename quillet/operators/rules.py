"""Rules that users write about their data, evaluated as violations in few jobs."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from .findings import FAULTS, SCHEMA, SEVERITIES, WARNING, own_fault

EXPECTATIONS = ("not_null", "unique", "positive", "non_negative", "one_of", "matches", "range", "not_future", "references", "sql", "across")
COMPARISONS = ("<", "<=", ">", ">=")
MOST_VALUES, LONGEST_VALUE = 50, 120


class RuleError(ValueError):
    """A rules file that cannot be taken as it stands."""


@dataclass(frozen=True)
class Rule:
    id: str
    table: str
    expect: str
    column: str = ""
    description: str = ""
    severity: str = "error"
    values: tuple[str, ...] = ()
    values_from: str = ""
    pattern: str = ""
    min: float | None = None
    max: float | None = None
    references: str = ""
    where: str = ""
    other: str = ""
    on: tuple[str, ...] = ()
    left: str = ""
    op: str = ""
    right: str = ""
    ignore_case: bool = False
    allow_missing: bool = False
    message: str = ""
    remedy: str = ""
    extra: dict = field(default_factory=dict, compare=False, repr=False)

    def problems(self) -> list[str]:
        """Why the rule cannot be evaluated; empty if it can."""
        out = []
        if not self.id:
            out.append("a rule needs an id")
        if not self.table:
            out.append("a rule needs a table")
        if self.expect not in EXPECTATIONS:
            out.append(f"unknown expectation {self.expect!r}")
        if self.expect not in ("sql", "across") and not self.column:
            out.append(f"{self.expect} needs a column")
        if self.expect == "one_of" and not self.values and self.values_from != "current":
            out.append("one_of needs values")
        if self.expect == "matches" and not self.pattern:
            out.append("matches needs a pattern")
        if self.expect == "range" and self.min is None and self.max is None:
            out.append("range needs min or max")
        if self.expect == "references" and "." not in self.references:
            out.append("references is written as table.column")
        if self.expect == "sql" and not self.where:
            out.append("sql needs a where")
        if self.expect == "across":
            compared = bool(self.left and self.right)
            if not self.other or P.glob(self.table, self.other):
                out.append("across needs another table")
            if compared == bool(self.where) or compared and self.op not in COMPARISONS:
                out.append("across needs a where, or left, op (" + " ".join(COMPARISONS) + ") and right")
            if self.where and not self.on:
                out.append("a where across tables needs on: without keys only a comparison can be counted without pairing all rows")
            if any(len(k.split("=")) != 2 or not all(x.strip() for x in k.split("=")) for k in self.on):
                out.append("on is written as column = column of the other table")
        if self.severity not in SEVERITIES:
            out.append(f"unknown severity {self.severity!r}")
        if self.extra:
            out.append(f"unknown fields {sorted(self.extra)}")
        return [f"rule {self.id!r}: {p}" for p in out]

    def assertion_id(self) -> str:
        """A digest of what the rule asserts; wording does not change it."""
        said = {k: v for k, v in asdict(self).items() if k not in ("id", "description", "severity", "message", "remedy", "extra")}
        return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()

    def covers(self, other: Rule) -> bool:
        """Whether this rule asserts the same of the same target."""
        def said(r: Rule) -> tuple:
            return (r.expect, r.where, r.other, r.on, r.left, r.op, r.right)

        return said(self) == said(other) and P.glob(self.table, other.table) and (not other.column or P.glob(self.column, other.column))


def parse(entries: list[dict], version: int = 1) -> list[Rule]:
    """Rules from plain dictionaries, all validated."""
    if version != 1:
        raise RuleError(f"version {version} is not supported")
    known = {f.name for f in fields(Rule)} - {"extra"}
    rules = []
    for e in entries:
        given = {k: tuple(map(str, v)) if k in ("values", "on") else v for k, v in e.items() if k in known}
        rules.append(Rule(**({"id": "", "table": "", "expect": ""} | given), extra={k: v for k, v in e.items() if k not in known}))
    problems = [p for r in rules for p in r.problems()]
    seen = [r.id for r in rules]
    problems += [f"rule {i!r} appears more than once" for i in sorted({i for i in seen if seen.count(i) > 1})]
    if problems:
        raise RuleError("; ".join(problems))
    return rules


def load(text: str) -> list[Rule]:
    """Rules from a YAML document (or JSON, which needs no YAML library): version and rules."""
    try:
        document = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuleError("this file is not JSON, and no YAML library is installed") from e
        document = yaml.safe_load(text)
    return parse(document.get("rules", []), document.get("version", 1))


def merge(*files: list[Rule]) -> list[Rule]:
    """The rules of several files; an id that appears twice is refused."""
    rules = [r for f in files for r in f]
    ids = [r.id for r in rules]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise RuleError(f"ids appear more than once: {', '.join(twice)}")
    return rules


def render(rules: list[Rule], rationale: dict[str, str] | None = None) -> str:
    """A rules document of proposals, with the reasons as comments. It is not in force until someone loads it."""
    lines = ["# Proposed rules, not in force until reviewed and loaded.", "version: 1", "rules:"]
    for r in rules:
        for said in (rationale or {}).get(r.id, "").splitlines():
            lines.append(f"  # {said}")
        shown = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(r).items() if k != "extra" and v not in ("", (), None, False) and not (k == "severity" and v == "error")}
        lines += [f"  {'- ' if n == 0 else '  '}{k}: {json.dumps(v, ensure_ascii=False)}" for n, (k, v) in enumerate(shown.items())]
    return "\n".join(lines) + "\n"


def targets(rule: Rule, tables: dict[str, DataFrame]) -> list[tuple[str, str | None]]:
    """(table, column) pairs a rule applies to; the column is null for sql and across."""
    out: list[tuple[str, str | None]] = []
    for name, df in sorted(tables.items()):
        if P.glob(rule.table, name):
            if rule.expect in ("sql", "across"):
                out.append((name, None))
            else:
                out += [(name, f.name) for f in df.schema if P.glob(rule.column, f.name) or P.glob(rule.column, (f.metadata or {}).get("original", f.name))]
    return out


def violation(rule: Rule, table: str, column: str | None, audit_time: datetime) -> str:
    """The SQL condition of rows that break the rule. Unique, references and across hold a subquery, the others only the row."""
    if rule.expect == "sql":
        return f"({rule.where})"
    if rule.expect == "across":
        o = P.ident(rule.other)
        keys = " AND ".join(f"{P.ident(table)}.{P.ident(a)} = {o}.{P.ident(b)}" for a, b in _keys(rule))
        if rule.where:
            return f"EXISTS (SELECT 1 FROM {o} WHERE {keys} AND ({rule.where}))"
        # the most favourable partner decides, so that no pairs need to be tried
        return f"({rule.left}) {rule.op} (SELECT {'max' if rule.op[0] == '<' else 'min'}({rule.right}) FROM {o}" + (f" WHERE {keys})" if keys else ")")
    c = P.ident(column or "")
    nb, x = P.non_blank(c), f"({P.number(c)})"
    if rule.expect == "not_null":
        bad = f"NOT {nb}"
    elif rule.expect == "unique":
        bad = f"{nb} AND {c} IN (SELECT {c} FROM {P.ident(table)} WHERE {nb} GROUP BY {c} HAVING count(*) > 1)"
    elif rule.expect == "positive":
        bad = f"{nb} AND coalesce({x}, 0) <= 0"
    elif rule.expect == "non_negative":
        bad = f"{nb} AND coalesce({x}, 0) < 0"
    elif rule.expect == "one_of":
        left, values = (P.normalized(c), [v.strip().lower() for v in rule.values]) if rule.ignore_case else (c, rule.values)
        bad = f"{nb} AND {left} NOT IN {P.in_list(values)}"
    elif rule.expect == "matches":
        bad = f"{nb} AND NOT ({P.full_match(f'trim({c})', rule.pattern)})"
    elif rule.expect == "range":
        limits = [f"{x} < {rule.min}D"] * (rule.min is not None) + [f"{x} > {rule.max}D"] * (rule.max is not None)
        bad = f"{nb} AND coalesce({' OR '.join(limits)}, false)"
    elif rule.expect == "not_future":
        bad = f"{nb} AND coalesce(({P.timestamp(c)}) > TIMESTAMP '{audit_time:%Y-%m-%d %H:%M:%S}', false)"
    else:
        parent_table, parent = rule.references.rsplit(".", 1)
        fold = P.normalized if rule.ignore_case else (lambda v: v)
        p = P.ident(parent)
        bad = f"{nb} AND {fold(c)} NOT IN (SELECT {fold(p)} FROM {P.ident(parent_table)} WHERE {p} IS NOT NULL)"
    if rule.allow_missing:
        bad = f"({bad}) AND {nb} AND NOT ({P.is_sentinel(c)})"
    return bad


def _keys(rule: Rule) -> list[tuple[str, str]]:
    return [(a.strip(), b.strip()) for a, b in (k.split("=") for k in rule.on)]


def _paired(tables: dict[str, DataFrame], rule: Rule, table: str) -> DataFrame:
    """(n): rows of table that meet a row of the other one.

    A comparison holds for some partner if it holds for the most favourable one: the other table's greatest or least
    right side per key, so a key that many rows share on both sides costs a row per task. A free condition is tried on
    the distinct combinations of the columns it may name, joined by the keys.
    """
    keys = _keys(rule)
    own, far = tables[table].alias(table), tables[rule.other].alias(rule.other)
    same = [F.col(f"k{i}") == F.col(f"o{i}") for i in range(len(keys))]
    own_keys = [F.col(f"{P.ident(table)}.{P.ident(a)}").alias(f"k{i}") for i, (a, _) in enumerate(keys)]
    far_keys = [F.col(f"{P.ident(rule.other)}.{P.ident(b)}").alias(f"o{i}") for i, (_, b) in enumerate(keys)]
    if rule.left:
        left = own.groupBy(*own_keys, F.expr(rule.left).alias("left__")).agg(F.count("*").alias("n__"))
        best = (F.max if rule.op[0] == "<" else F.min)(F.expr(rule.right)).alias("right__")
        right = far.groupBy(*far_keys).agg(best) if keys else far.agg(best)  # without keys: one row
        met = left.join(right, same) if keys else left.join(F.broadcast(right))
        return met.where(f"left__ {rule.op} right__").agg(F.coalesce(F.sum("n__"), F.lit(0)).alias("n"))
    named = lambda df, t: [F.col(f"{P.ident(t)}.{P.ident(c)}") for c in df.columns if c.lower() in rule.where.lower()]
    left = own.groupBy(*own_keys, *named(tables[table], table)).agg(F.count("*").alias("n__")).alias(table)
    right = far.select(*far_keys, *named(tables[rule.other], rule.other)).distinct().alias(rule.other)
    return left.join(right, [*same, F.expr(rule.where)], "left_semi").agg(F.coalesce(F.sum("n__"), F.lit(0)).alias("n"))


def _repeated(tables: dict[str, DataFrame], table: str, column: str, keep: str | None) -> DataFrame:
    """(n): rows whose value stands on more than one row."""
    c = P.ident(column)
    rows = tables[table].where(P.non_blank(c)).where(keep or "true")
    return rows.groupBy(F.col(c)).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


def _unmatched(tables: dict[str, DataFrame], rule: Rule, table: str, column: str, keep: str | None) -> DataFrame:
    """(n): rows whose value the parent lacks, by an anti join on keys that are not null."""
    parent_table, parent = rule.references.rsplit(".", 1)
    fold = P.normalized if rule.ignore_case else (lambda v: v)
    c, p = P.ident(column), P.ident(parent)
    child = tables[table].where(P.non_blank(c)).where(keep or "true").select(F.expr(fold(c)).alias("v")).groupBy("v").count()
    known = tables[parent_table].where(f"{p} IS NOT NULL").select(F.expr(fold(p)).alias("v")).distinct()
    return child.join(known, "v", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


def cause(e: Exception) -> str:
    """Why a condition failed, without cell contents: the error's name, or the first line of what the analysis says."""
    if isinstance(e, (AnalysisException, RuleError)):
        return str(e).splitlines()[0][:200]
    named = re.search(r"\[([A-Z][A-Z0-9_.]+)\]|java\.util\.regex\.(PatternSyntaxException)", str(e))
    return named[1] or named[2] if named else type(e).__name__


def evaluate(spark: SparkSession, tables: dict[str, DataFrame], rules: list[Rule], audit_time: datetime) -> DataFrame:
    """Findings of rules on text tables (registered as views of their names), and of rules that match nothing or cannot run.

    All conditions on single rows of a table are counted in one pass over it; unique, references and across take
    partially aggregated counts and a join each, conditions with a subquery a pass of their own. A condition that fails
    on some row takes none of the others with it: the pass is halved until the failing one is alone, and that becomes a
    rule.invalid finding. A table goes by its own name in conditions.
    """
    rows: list[tuple] = []
    per_table: dict[str, list[tuple[Rule, str | None, str]]] = {}
    alone: list[tuple[Rule, str, str | None, str, DataFrame]] = []
    counted: list[tuple[Rule, str, str | None, str, int]] = []
    totals: dict[str, int] = {}
    said = lambda r: SEVERITIES.index(r.severity)

    def broken(r: Rule, table: str | None, column: str | None, why: str, rule: str) -> None:
        rows.append((rule, WARNING, "rule", f"{r.id}: {why}", "", table, column, 0, 0, None, None, "", None, False))

    def invalid(r: Rule, table: str, column: str | None, e: Exception) -> None:
        broken(r, table, column, f"the condition cannot run: {cause(e)}", "rule.invalid")

    for r in rules:
        matched = targets(r, tables)
        if not matched:
            broken(r, None, None, f"nothing is named {r.table}" + (f".{r.column}" if r.column else ""), "rule.never_applied")
        for table, column in matched:
            bad = violation(r, table, column, audit_time)
            keep = f"NOT ({P.is_sentinel(P.ident(column))})" if r.allow_missing and column else None
            parent = r.references.rsplit(".", 1)[0] if r.expect == "references" else r.other if r.expect == "across" else None
            try:
                if parent is not None and parent not in tables:
                    raise RuleError(f"no table {parent}")
                if r.expect == "unique":
                    alone.append((r, table, column, bad, _repeated(tables, table, column or "", keep)))
                elif r.expect == "references":
                    alone.append((r, table, column, bad, _unmatched(tables, r, table, column or "", keep)))
                elif r.expect == "across":
                    alone.append((r, table, None, bad, _paired(tables, r, table)))
                else:
                    fits = tables[table].alias(table).where(bad)  # analysed now: an invalid condition is told apart before all are counted
                    if re.search(r"\bselect\b", bad, re.IGNORECASE):
                        alone.append((r, table, column, bad, fits.agg(F.count("*").alias("n"))))
                    else:
                        per_table.setdefault(table, []).append((r, column, bad))
            except (*FAULTS, RuleError) as e:
                invalid(r, table, column, own_fault(e))

    def count(table: str, each: list[tuple[Rule, str | None, str]]) -> None:
        sums = [F.coalesce(F.sum(F.expr(f"CASE WHEN {bad} THEN 1 ELSE 0 END")), F.lit(0)).alias(f"r{i}") for i, (_, _, bad) in enumerate(each)]
        try:
            got = tables[table].alias(table).agg(F.count("*").alias("total"), *sums).first()
        except FAULTS as e:
            own_fault(e)
            if len(each) == 1:
                invalid(each[0][0], table, each[0][1], e)
                return
            half = len(each) // 2
            count(table, each[:half])
            count(table, each[half:])
            return
        totals[table] = got["total"]
        counted.extend((r, table, column, bad, got[f"r{i}"]) for i, (r, column, bad) in enumerate(each))

    for table, each in per_table.items():
        count(table, each)
    for r, table, column, bad, n in alone:
        try:
            counted.append((r, table, column, bad, n.first()["n"]))
        except FAULTS as e:
            invalid(r, table, column, own_fault(e))
    for table in {c[1] for c in counted} - set(totals):
        totals[table] = tables[table].count()
    for r, table, column, bad, n in counted:
        if n:
            title = r.message or f"{n} rows break {r.id}" + (f" on {column}" if column else "")
            t = P.ident(table)
            rows.append((r.id, said(r), "rule", title, r.remedy, table, column, n, totals[table], f"SELECT count(*) FROM {t} WHERE {bad}", f"SELECT * FROM {t} WHERE {bad} LIMIT 100", r.expect, None, False))
    return spark.createDataFrame(rows, SCHEMA)


def vocabulary(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """(value): the distinct values that a one_of rule's targets hold now, one spelling per key, in order."""
    matched = [(t, c) for t, c in targets(rule, tables) if c]
    if not matched:
        raise RuleError(f"rule {rule.id!r} selects no column")
    out = None
    for t, c in matched:
        one = tables[t].where(P.non_blank(P.ident(c))).select(F.col(P.ident(c)).alias("value"))
        out = one if out is None else out.unionByName(one)
    key = F.expr(P.normalized("value")) if rule.ignore_case else F.col("value")
    return out.groupBy(key.alias("key")).agg(F.min("value").alias("value")).select("value")


def materialize(rule: Rule, tables: dict[str, DataFrame]) -> Rule:
    """The rule with its values written out; refused beyond MOST_VALUES values or LONGEST_VALUE characters."""
    if rule.expect != "one_of" or rule.values_from != "current":
        return rule
    found = vocabulary(rule, tables)
    values = [r["value"] for r in found.orderBy("value").limit(MOST_VALUES + 1).collect()]
    if len(values) > MOST_VALUES:
        raise RuleError(f"rule {rule.id!r} reads {found.count()} distinct values; {MOST_VALUES} at most make a vocabulary")
    if not values:
        raise RuleError(f"rule {rule.id!r} reads no value")
    if max(map(len, values)) > LONGEST_VALUE:
        raise RuleError(f"rule {rule.id!r} reads values of {max(map(len, values))} characters")
    return Rule(**{**{f.name: getattr(rule, f.name) for f in fields(Rule)}, "values": tuple(values), "values_from": ""})


def propose(spark: SparkSession, tables: dict[str, DataFrame], rule: Rule, claimed_violations: int, in_force: list[Rule], audit_time: datetime) -> dict:
    """Measure a proposed rule: accepted only if it applies, is new, and breaks as often as claimed."""
    for other in in_force:
        if other.covers(rule):
            return {"accepted": False, "why": f"rule {other.id!r} asserts this already", "violations": None}
    try:
        made = materialize(rule, tables)
    except RuleError as e:
        return {"accepted": False, "why": str(e), "violations": None}
    found = evaluate(spark, tables, [made], audit_time).collect()
    wrong = [r for r in found if r["rule"] in ("rule.never_applied", "rule.invalid")]
    if wrong:
        return {"accepted": False, "why": wrong[0]["title"], "violations": None}
    n = sum(r["count"] for r in found)
    return {"accepted": n == claimed_violations, "why": "" if n == claimed_violations else f"{n} rows break it, not {claimed_violations}", "violations": n, "rule": made, "id": made.assertion_id()}

