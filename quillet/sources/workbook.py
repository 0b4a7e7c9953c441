"""Workbooks: cells are read one workbook per task, as they stream by; headers, tables and notes are DataFrame work."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from itertools import islice
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import ident
from . import listing
from .delimited import column_names
from .sheets import Cells, Strings, merged_ranges
from .written import written

HEADER_ROWS = 100
#: Cells that leave a task together.
BATCH = 8192
# The error texts of spreadsheet formulas.
FORMULA_ERRORS = ("#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NULL!", "#NUM!", "#SPILL!", "#CALC!")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, sheet_no int, sheet_hidden boolean, row int, col int, value string, row_hidden boolean, merged boolean"


#: What a damaged workbook or sheet makes the readers say.
BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, ElementTree.ParseError, expat.ExpatError, OSError, KeyError, IndexError, ValueError, AttributeError, TypeError, EOFError, NotImplementedError, RuntimeError)


# Numbers of the built-in formats that show dates, times, or both.
DATE_STYLES, TIME_STYLES = (14, 15, 16, 17, 22), (18, 19, 20, 21, 45, 46, 47)


def date_styles(styles: bytes | None) -> list[str]:
    """For each cell style: "date", "time" or "" by the number format it uses."""
    if styles is None:
        return []
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_NS}numFmt")}

    def kind(number: int) -> str:
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", own.get(number, "")).lower()
        if number in DATE_STYLES or re.search("[yd]", code):
            return "date"
        return "time" if number in TIME_STYLES or re.search("[hs]", code) else ""

    formats = root.find(f"{_NS}cellXfs")
    return [kind(int(x.get("numFmtId", "0"))) for x in formats] if formats is not None else []


def date_text(serial: str, kind: str, from_1904: bool) -> str:
    """A day number as it is meant: YYYY-MM-DD, with the time where there is one; a time alone as HH:MM:SS."""
    try:
        days = float(serial)
        moment = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(seconds=round(days * 86400))
    except (ValueError, OverflowError):
        return serial
    if kind == "time" and days < 1:
        return f"{moment:%H:%M:%S}"
    return f"{moment:%Y-%m-%d}" if days == int(days) else f"{moment:%Y-%m-%d %H:%M:%S}"


def written_value(strings: Strings, styles: list[str], from_1904: bool):
    """What makes a text of a cell's type, style and written value; None where it has none."""
    def text(kind: str, style: str, value: str | None) -> str | None:
        if not value:
            return None
        if kind == "s":
            return strings[int(value)]
        if kind == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(value, value)
        if kind == "n" and int(style) < len(styles) and styles[int(style)]:
            return date_text(value, styles[int(style)], from_1904)
        return value

    return text


def workbook_cells(path: str, file) -> Iterator[tuple]:
    """Rows of CELLS of one workbook, from a seekable file. A sheet that breaks off, whenever, has a row 0 that says why.

    In memory are the shared strings' bytes, four numbers a merged range, and a chunk of a sheet.
    """
    with zipfile.ZipFile(file) as z:
        names = set(z.namelist())
        strings = Strings()
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as part:
                strings = Strings(part)
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        styles = date_styles(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        from_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_NS}workbookPr"))
        for no, sheet in enumerate(book.iter(f"{_NS}sheet")):
            name, hidden = sheet.get("name"), sheet.get("state", "visible") != "visible"
            try:
                target = rels[sheet.get(_REL)].lstrip("/")
                target = target if target.startswith("xl/") else f"xl/{target}"
                with z.open(target) as part:
                    merged = merged_ranges(part)
                with z.open(target) as part:
                    for cell in Cells(part, merged, written_value(strings, styles, from_1904)):
                        yield (path, name, no, hidden, *cell)
            except BROKEN as e:
                yield (path, name, no, False, 0, 0, str(e) or type(e).__name__, False, False)


_TYPES = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("sheet_hidden", pa.bool_()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("row_hidden", pa.bool_()), ("merged", pa.bool_())])


def _batches(path: str, file) -> Iterator[pa.RecordBatch]:
    cells = workbook_cells(path, file)
    while True:
        rows = []
        try:
            rows.extend(islice(cells, BATCH))
            over = len(rows) < BATCH
        except BROKEN as e:
            rows.append((path, None, -1, False, 0, 0, str(e) or type(e).__name__, False, False))
            over = True
        if rows:
            # rows come sheet by sheet, so what stands in the first and the last of them stands in all
            same = 4 if rows[0][:4] == rows[-1][:4] else 0
            fixed = [pa.repeat(pa.scalar(v, t), len(rows)) for v, t in zip(rows[0][:same], _TYPES.types)]
            yield pa.RecordBatch.from_arrays(fixed + [pa.array([r[i] for r in rows], _TYPES.types[i]) for i in range(same, len(_TYPES))], schema=_TYPES)
        if over:
            return


def _of_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                file = listing.opened(path)
            except OSError as e:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, None, -1, False, 0, 0, e.strerror or str(e), False, False), _TYPES.types)], schema=_TYPES)
                continue
            with file:
                yield from _batches(path, file)


def _of_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            yield from _batches(path.as_py(), io.BytesIO(content.as_buffer()))


def _known(path: str) -> bool:
    try:
        return path.startswith("file:") or afs.FileSystem.from_uri(path) is not None
    except Exception:  # noqa: BLE001  whatever it says, Hadoop's file systems are asked next
        return False


def cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CELLS of workbooks, a task each: files are opened where they lie; whole ones come through Spark's reader where only Hadoop knows the file system."""
    own = [p for p in paths if _known(p)]
    found = spark.createDataFrame([(p,) for p in own], "path string").repartition(max(1, len(own))).mapInArrow(_of_paths, CELLS)
    if len(own) < len(paths):
        far = spark.read.format("binaryFile").load([listing.for_reader(p) for p in paths if p not in set(own)])
        found = found.unionByName(far.select(listing.of_metadata_column(F.col("path")).alias("path"), "content").mapInArrow(_of_contents, CELLS))
    return found


SHEET = ["path", "sheet", "sheet_no"]


def row_sizes(cells: DataFrame) -> DataFrame:
    """(path, sheet, sheet_no, row, row_width, cells): a row per row of a sheet that has a value."""
    return cells.groupBy(*SHEET, "row").agg(F.max("col").alias("row_width"), F.count("*").alias("cells"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, sheet_no, header, width): the first of the first 100 rows that has 3/5 of the widest one's columns."""
    return headers_of(row_sizes(cells.where(F.col("row") <= HEADER_ROWS)))


def headers_of(sizes: DataFrame) -> DataFrame:
    """header_rows() from row_sizes()."""
    rows = sizes.where(F.col("row") <= HEADER_ROWS).select(*SHEET, "row", "row_width")
    widest = rows.withColumn("width", F.max("row_width").over(Window.partitionBy(*SHEET)))
    enough = F.when(F.col("width") < 3, F.lit(1)).otherwise(F.col("width") * 0.6)
    return widest.where(F.col("row_width") >= enough).groupBy(*SHEET).agg(F.min("row").alias("header"), F.max("width").alias("width"))


def sheet_notes(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, sheet, sheet_no, code, message) of what a sheet's structure may hide."""
    c = cells.join(F.broadcast(headers), SHEET)  # a row per sheet
    rows = c.groupBy(*SHEET, "header", "width", "row").agg(F.count("*").alias("n"), F.max("col").alias("last"), F.max("row_hidden").alias("hidden"))
    gap = F.lead("row").over(Window.partitionBy(*SHEET).orderBy("row")) - F.col("row")
    body = (F.col("row") > F.col("header")).cast("int")
    sums = rows.withColumn("gap", gap).groupBy(*SHEET, "header").agg(
        F.sum((F.col("row") < F.col("header")).cast("int")).alias("titles"), F.sum(F.col("hidden").cast("int")).alias("hidden"),
        F.sum(body * (F.col("last") != F.col("width")).cast("int")).alias("ragged"), F.sum(body * F.coalesce((F.col("gap") > 1).cast("int"), F.lit(0))).alias("gaps"))
    whole = c.groupBy(*SHEET).agg(F.max("sheet_hidden").alias("sheet_hidden"), F.sum(F.col("merged").cast("int")).alias("merged"), F.sum(F.col("value").isin(*FORMULA_ERRORS).cast("int")).alias("errors"),
                                  (F.first("width") - F.sum((F.col("row") == F.col("header")).cast("int"))).alias("unnamed"))
    told = sums.join(whole, SHEET)

    def note(code: str, when: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))

    def counted(n: str, text: str) -> Column:
        return F.concat(F.col(n).cast("string"), F.lit(text))

    notes = F.array(
        note("excel.header_offset", F.col("header") > 1, F.concat(F.lit("the header stands in row "), F.col("header").cast("string"))),
        note("excel.title_row", F.col("titles") > 0, counted("titles", " rows above the header were left out")),
        note("excel.hidden_rows", F.col("hidden") > 0, counted("hidden", " rows are hidden; they were read")),
        note("excel.ragged_rows", F.col("ragged") > 0, counted("ragged", " rows are wider or narrower than the header")),
        note("excel.stacked_tables", F.col("gaps") > 0, counted("gaps", " blank gaps stand within the data; there may be more than one table")),
        note("excel.formula_errors", F.col("errors") > 0, counted("errors", " cells hold the error text of a formula")),
        note("excel.merged_cells", F.col("merged") > 0, counted("merged", " cells with values are merged with others")),
        note("excel.hidden_sheet", F.col("sheet_hidden"), F.lit("the sheet is hidden; it was read")),
        note("excel.header_blank", F.col("unnamed") > 0, counted("unnamed", " columns have no header")))
    return told.select(*SHEET, F.explode(F.filter(notes, lambda n: n.isNotNull())).alias("n")).select(*SHEET, "n.code", "n.message")


@dataclass(frozen=True)
class Sheets:
    """What is read of workbooks: their cells (written), a header for each sheet (written), and what broke off.

    named holds a sheet's (path, sheet, header, columns) in the order of headers.
    """

    books: dict[str, str]
    cells: DataFrame
    headers: DataFrame
    named: list[tuple[str, str, int, tuple[tuple[str, str], ...]]]
    faults: list[tuple[str, str | None, str]]

    def place(self, path: str, sheet: str | None) -> str:
        return self.books[path] + (f"_{sheet}" if sheet is not None else "")

    def alike(self) -> list[tuple[tuple[tuple[str, str], ...], DataFrame]]:
        """(columns, rows) of all sheets that have the same columns, as one frame: path, sheet and the columns by number, whatever the number of sheets."""
        groups: dict[tuple, list[tuple[str, str, int]]] = {}
        for path, sheet, header, columns in self.named:
            groups.setdefault(columns, []).append((path, sheet, header))
        spark = self.cells.sparkSession
        out = []
        for columns, some in groups.items():
            own = self.cells.join(F.broadcast(spark.createDataFrame(some, "path string, sheet string, header int")), ["path", "sheet"]).where(F.col("row") > F.col("header"))  # a row per sheet
            out.append((columns, own.groupBy("path", "sheet", "row").agg(*[F.first(F.when(F.col("col") == i, F.col("value")), True).alias(str(i)) for i in range(1, len(columns) + 1)]).drop("row")))
        return out


def _columns(wide: DataFrame, columns: tuple[tuple[str, str], ...]) -> DataFrame:
    return wide.select(*[F.col(f"`{i}`").alias(n, metadata={"original": o}) for i, (n, o) in enumerate(columns, 1)])


def sheet_table(cells: DataFrame, path: str, sheet: str, header: int, columns: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows below the header, one column per header cell, all text; blank rows are dropped."""
    own = cells.where((F.col("path") == path) & (F.col("sheet") == sheet) & (F.col("row") > header))
    return _columns(own.groupBy("row").pivot("col", list(range(1, len(columns) + 1))).agg(F.first("value")), columns)


def read_sheets(spark: SparkSession, files: DataFrame) -> Sheets | None:
    """The sheets of the workbooks among discovered files, read once and together; headers of all of them are found by two jobs."""
    books = {r["path"]: r["rel"] for r in files.where("kind = 'excel' AND skip_reason IS NULL").collect()}
    if not books:
        return None
    told = written(cells(spark, list(books)))
    faults = told.where("row = 0").collect()  # a row per workbook or sheet that breaks off; nothing of it is taken for whole
    good = told.where("row > 0")
    if faults:
        good = good.join(F.broadcast(told.where("row = 0 AND sheet IS NOT NULL").select("path", "sheet_no").distinct()), ["path", "sheet_no"], "left_anti")
    headers = written(header_rows(good))
    at = good.join(F.broadcast(headers), SHEET).where(F.col("row") == F.col("header"))  # a row per sheet
    found = headers.join(at.groupBy(*SHEET).agg(F.collect_list(F.struct("col", "value")).alias("names")), SHEET)
    named = []
    for r in found.orderBy("path", "sheet_no").collect():
        names = {c["col"]: c["value"] for c in r["names"]}
        named.append((r["path"], r["sheet"], r["header"], tuple(column_names([names.get(i, "") for i in range(1, r["width"] + 1)]))))
    return Sheets(books, good, headers, named, [(r["path"], r["sheet"], r["value"]) for r in faults])


def rows_together(sheets: Sheets, columns: list[str]) -> DataFrame:
    """The rows of all sheets whose columns have these names, in one frame."""
    fit = [_columns(rows, named) for named, rows in sheets.alike() if [n for n, _ in named] == columns]
    none = sheets.cells.sparkSession.createDataFrame([], ", ".join(f"{ident(c)} string" for c in columns))
    return reduce(DataFrame.unionByName, fit or [none])


def notes_together(sheets: Sheets) -> DataFrame:
    """(path, sheet, code, message) of all sheets, those that broke off among them."""
    broken = [(path, sheet, "excel.sheet_unreadable", f"it could not be read: {why}") for path, sheet, why in sheets.faults]
    return sheet_notes(sheets.cells, sheets.headers).select("path", "sheet", "code", "message").unionByName(
        sheets.cells.sparkSession.createDataFrame(broken, "path string, sheet string, code string, message string"))


def read_workbooks(spark: SparkSession, files: DataFrame) -> tuple[dict[str, DataFrame], list[tuple[str, str, str]]]:
    """(tables, notes) of the workbooks among discovered files, both by place: the file's path and the sheet, "dir/book.xlsx_Sheet".

    A workbook or sheet that cannot be read gets a note; the others are read.
    """
    sheets = read_sheets(spark, files)
    if sheets is None:
        return {}, []
    tables = {sheets.place(path, sheet): sheet_table(sheets.cells, path, sheet, header, columns) for path, sheet, header, columns in sheets.named}
    return tables, [(sheets.place(n["path"], n["sheet"]), n["code"], n["message"]) for n in notes_together(sheets).collect()]
