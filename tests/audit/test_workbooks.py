"""Workbooks as they stream by: against a brute force, in bounded memory, and what breaks off."""

import io
import random
import time
import tracemalloc
import zipfile

import duckdb
import pytest

from quillet.plans import audit_queries, workbook_queries
from quillet.sources import delimited, sheets, workbook

SF = "/root/testdata/sf0.001"
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letters(n):
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def test_merged_ranges():
    """Overlapping ranges, rows out of order: the same cells as by looking at every range."""
    rnd = random.Random(3)
    boxes = [(x := rnd.randint(1, 30), y := rnd.randint(1, 60), x + rnd.randint(0, 4), y + rnd.randint(0, 9)) for _ in range(80)]
    merged = sheets.Merged([f"{letters(x1)}{y1}:{letters(x2)}{y2}" for x1, y1, x2, y2 in boxes] + ["AZ3"])
    cells = [(r, c) for r in range(1, 72) for c in range(1, 40)]
    rnd.shuffle(cells)
    for r, c in cells + [(3, 52), (4, 52)]:
        assert merged.covers(r, c) == (any(x1 <= c <= x2 and y1 <= r <= y2 for x1, y1, x2, y2 in boxes) or (r, c) == (3, 52)), (r, c)


def test_cells_without_places_and_readings_above():
    strings = sheets.Strings(io.BytesIO(f'<x:sst xmlns:x="{NS[7:-1]}"><x:si><x:r><x:t>a</x:t></x:r><x:r><x:t> b</x:t></x:r><x:rPh><x:t>no</x:t></x:rPh></x:si><x:si/><x:si><x:t>é</x:t></x:si></x:sst>'.encode()))
    assert [strings[i] for i in range(3)] == ["a b", "", "é"]
    with pytest.raises(IndexError):
        strings[3]
    sheet = f'<worksheet {NS}><sheetData><row><c t="s"><v>0</v></c><c><f>1+1</f><v>2</v></c><c t="s"><v>1</v></c></row><row hidden="true"><c t="b"><v>1</v></c><c r="E2" t="inlineStr"><is><r><t>p</t></r><r><t>q</t></r></is></c><c t="str"><v>z</v></c></row></sheetData><mergeCells><mergeCell ref="E2:F3"/></mergeCells></worksheet>'
    text = workbook.written_value(strings, [], False)
    found = list(sheets.Cells(io.BytesIO(sheet.encode()), sheets.merged_ranges(io.BytesIO(sheet.encode())), text))
    assert found == [(1, 1, "a b", False, False), (1, 2, "2", False, False), (2, 1, "TRUE", True, False), (2, 5, "pq", True, True), (2, 6, "z", True, True)]


def test_large_sheet_in_bounded_memory():
    """200,000 cells and 10,000 merged ranges: a few megabytes at most, and no time per pair of cell and range."""
    rows, cols = 20000, 10
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{letters(c)}{r}"><v>{r * c}</v></c>' for c in range(1, cols + 1)) + "</row>" for r in range(1, rows + 1))
    merges = "".join(f'<mergeCell ref="A{r}:B{r + 1}"/>' for r in range(1, rows, 2))
    sheet = f"<worksheet {NS}><sheetData>{body}</sheetData><mergeCells>{merges}</mergeCells></worksheet>".encode()
    began = time.time()
    tracemalloc.start()
    merged = sheets.merged_ranges(io.BytesIO(sheet))
    n = covered = total = 0
    for r, c, v, _, m in sheets.Cells(io.BytesIO(sheet), merged, lambda kind, style, value: value):
        n, covered, total = n + 1, covered + m, total + (int(v) == r * c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, covered, total) == (rows * cols, rows * 2, rows * cols)
    assert peak < 8 << 20 and time.time() - began < 60, peak


def test_sheet_that_breaks_off(spark, tmp_path):
    """Cells before the fault are not taken for a table; the other sheet of the workbook is read."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    good = f'<worksheet {NS}><sheetData><row><c t="inlineStr"><is><t>k</t></is></c></row><row><c><v>1</v></c></row></sheetData></worksheet>'
    bad = f'<worksheet {NS}><sheetData>' + "<row><c><v>1</v></c></row>" * 20000 + '<row><c t="s"><v>9</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets><sheet name="good" r:id="r0"/><sheet name="bad" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships>' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(2)) + "</Relationships>")
        z.writestr("xl/worksheets/s0.xml", good)
        z.writestr("xl/worksheets/s1.xml", bad)
    out = delimited.read_folder(spark, str(tmp_path))
    assert {n: df.collect() for n, df in out["tables"].items()} == {"b_xlsx_good": [("1",)]}
    assert [(r["table"], r["code"]) for r in out["notes"].collect()] == [("b_xlsx_bad", "excel.sheet_unreadable")]


@pytest.mark.parametrize("name", workbook_queries.NAMES)
def test_queries(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    df = audit_queries.QUERIES[name](spark, SF)
    cur = con.execute(audit_queries.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr(list(r)) for r in cur.fetchall())


def test_no_job_for_each_workbook(spark, tmp_path):
    """Rows of many workbooks are one plan, and as many jobs find their headers as for few."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    jobs = []
    for n in (2, 12):
        folder = tmp_path / str(n)
        folder.mkdir()
        for b in range(n):
            with zipfile.ZipFile(folder / f"b{b}.xlsx", "w") as z:
                z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets><sheet name="s" r:id="r0"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r0" Target="worksheets/s0.xml"/></Relationships>')
                z.writestr("xl/worksheets/s0.xml", f'<worksheet {NS}><sheetData><row><c t="inlineStr"><is><t>k</t></is></c></row><row><c><v>{b}</v></c></row></sheetData></worksheet>')
        spark.sparkContext.setJobGroup(f"books {n}", "")
        found = workbook.read_sheets(spark, delimited.discover(spark, str(folder)))
        assert sorted(r["k"] for r in workbook.rows_together(found, ["k"]).collect()) == sorted(str(b) for b in range(n))
        assert workbook.rows_together(found, ["other"]).collect() == [] and workbook.notes_together(found).collect() == []
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"books {n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_merged_ranges_across_chunks(monkeypatch):
    """Elements that chunks cut anywhere, and bytes in which names do not stand as they are written."""
    text = '<?xml version="1.0" encoding="{}"?><worksheet><sheetData><row><c><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="D4"/></mergeCells></worksheet>'
    for chunk in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(sheets, "CHUNK", chunk)
        for encoding in ("utf-8", "utf-16") if chunk > 2 else ("utf-8",):
            merged = sheets.merged_ranges(io.BytesIO(text.format(encoding).encode(encoding)))
            assert list(merged.ranges) == [1, 2, 1, 2, 4, 4, 4, 4]
