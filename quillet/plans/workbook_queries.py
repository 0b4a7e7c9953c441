"""Registered queries over workbooks that tasks write from a table: their rows, and what is noted of their sheets."""

from __future__ import annotations

import os
import zipfile
from urllib.parse import urlsplit
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import delimited, listing, workbook
from ..sources.written import fresh_path, written
from .audit_queries import INPUTS, query, source_sql, texts

#: Keys of a workbook, so a sheet is as long at any size of the table, and the row of its header.
KEYS, HEADER = 20_000, 3
COLUMNS = list(INPUTS["orders"])
_MAIN, _LINKS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _cell(col: int, row: int, value: str, shared: dict[str, int] | None = None) -> str:
    ref = f"{chr(65 + col)}{row}"
    if shared is not None:
        return f'<c r="{ref}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def _writer(folder: str, names: list[str]):
    """A workbook per group: a merged title, a blank row, the header, the rows; hidden where the second column ends in 7."""
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/orders_{rows['book'].iloc[0]}.xlsx"
        if urlsplit(path).scheme in ("", "file"):
            os.makedirs(listing.plain(folder).removeprefix("file:"), exist_ok=True)
            out = open(listing.plain(path).removeprefix("file:"), "wb")
        else:
            system, at = afs.FileSystem.from_uri(path)
            out = system.open_output_stream(at)
        shared: dict[str, int] = {}
        with out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets><sheet name="all" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
                head = "".join(_cell(i, HEADER, n) for i, n in enumerate(names))
                sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{_cell(0, 1, "Orders")}</row><row r="{HEADER}">{head}</row>'.encode())
                for r, values in enumerate(rows[names].itertuples(index=False, name=None), HEADER + 1):
                    cells = "".join(_cell(i, r, v, shared if i == 2 else None) for i, v in enumerate(values) if v is not None)
                    hidden = ' hidden="1"' if (values[1] or "").endswith("7") else ""
                    sheet.write(f'<row r="{r}"{hidden}>{cells}</row>'.encode())
                sheet.write(f'</sheetData><mergeCells><mergeCell ref="A1:{chr(64 + len(names))}1"/></mergeCells></worksheet>'.encode())
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        return pd.DataFrame({"path": [path]})

    return write


def workbooks(spark: SparkSession, sf_dir: str) -> str:
    """The folder of orders' workbooks, one for each range of keys."""
    folder = fresh_path(spark)
    t = texts(spark, sf_dir, "orders")["orders"].withColumn("book", F.expr(f"CAST(o_orderkey AS BIGINT) DIV {KEYS}"))
    t.groupBy("book").applyInPandas(_writer(folder, COLUMNS), "path string").write.format("noop").mode("overwrite").save()
    return folder


def sheets(spark: SparkSession, sf_dir: str) -> workbook.Sheets:
    return workbook.read_sheets(spark, delimited.discover(spark, workbooks(spark, sf_dir)))


@query("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in COLUMNS) + f" FROM {source_sql('orders')}")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders out of workbooks, below the headers that are found in them."""
    return workbook.rows_together(sheets(spark, sf_dir), COLUMNS)


_BOOKS = f"count(DISTINCT CAST(o_orderkey AS BIGINT) // {KEYS})"


@query(f"SELECT 'excel.hidden_rows' AS code, count(*) FILTER (WHERE o_custkey LIKE '%7') AS told FROM {source_sql('orders')} UNION ALL SELECT 'excel.header_offset', {HEADER} * {_BOOKS} FROM {source_sql('orders')} "
       f"UNION ALL SELECT 'excel.title_row', {_BOOKS} FROM {source_sql('orders')} UNION ALL SELECT 'excel.merged_cells', {_BOOKS} FROM {source_sql('orders')} "
       f"UNION ALL SELECT 'excel.ragged_rows', count(*) FROM {source_sql('orders')} WHERE coalesce({COLUMNS[-1]}, '') = '' HAVING count(*) > 0")
def workbook_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is noted of the sheets' structure: the numbers in the notes, summed over the workbooks."""
    notes = workbook.notes_together(sheets(spark, sf_dir))
    return notes.groupBy("code").agg(F.sum(F.regexp_extract("message", r"(\d+)", 1).cast("long")).alias("told"))


@query(f"SELECT CAST(o_orderkey AS BIGINT) // {KEYS} AS book, {HEADER} AS header, {len(COLUMNS)} AS width, count(*) + 2 AS rows, CAST(sum({' + '.join(f'CAST(coalesce({c}, $$$$) <> $$$$ AS INTEGER)' for c in COLUMNS)}) + {len(COLUMNS)} + 1 AS BIGINT) AS cells FROM {source_sql('orders')} GROUP BY 1")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a value per workbook, their rows, and where the header stands."""
    folder = workbooks(spark, sf_dir)
    files = delimited.discover(spark, folder).where("kind = 'excel' AND skip_reason IS NULL")
    sizes = written(workbook.row_sizes(workbook.cells(spark, [r["path"] for r in files.select("path").collect()])))  # workbooks are parsed once
    heads = workbook.headers_of(sizes)
    each = sizes.groupBy("path", "sheet", "sheet_no").agg(F.count("*").alias("rows"), F.sum("cells").alias("cells"))
    return each.join(heads, ["path", "sheet", "sheet_no"]).select(F.regexp_extract("path", r"_(\d+)\.xlsx$", 1).cast("long").alias("book"), "header", "width", "rows", "cells")


NAMES = ("workbook_rows", "workbook_notes", "workbook_cells")
