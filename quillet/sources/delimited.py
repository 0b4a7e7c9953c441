"""Folders of delimited files, every cell as text.

Folders are walked and heads of files looked at by tasks; the dialect of each file (encoding, delimiter, header) is
settled from its first bytes. Rows are read by Spark's CSV reader with an explicit schema, or, where quoted values span
lines or line ends have two bytes, by records.py, in many tasks as well. Rows of another width than the header's are put
aside, not dropped in silence.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import predicates as P
from . import listing
from .records import Form, Found, joined_lines, records

TEXT_KINDS, BOOK_KINDS = ("csv", "tsv", "tab", "psv", "txt"), ("xlsx", "xlsm", "xltx", "xltm")
# Folders that hold no data, besides hidden ones.
SKIPPED_FOLDERS = ("node_modules", "__pycache__", "venv")
DELIMITERS = (",", ";", "\t", "|")
HINTS = {"tsv": "\t", "tab": "\t", "psv": "|"}
HEAD_BYTES, HEAD_LINES = 256 * 1024, 200
#: Where tasks cannot open files themselves: up to this size they are read whole to look at their head; of larger ones the driver fetches it.
WHOLE_BYTES = 8 << 20
BAD = "_bad_row"
FILES = "path string, rel string, kind string, size long, skip_reason string"


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, rel, kind, size, skip_reason) of everything below path: each entry has a kind, a reason to skip it, or is of kind other."""
    root = listing.plain(path.rstrip("/"))

    def hidden(name: str) -> bool:
        return name.startswith(".") or name in SKIPPED_FOLDERS

    def told(at: str, folder: bool, size: int, error: str | None) -> tuple | None:
        name = at.rsplit("/", 1)[-1]
        extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        kind = "folder" if folder else "csv" if extension in TEXT_KINDS else "excel" if extension in BOOK_KINDS else "legacy" if extension == "xls" else "other"
        reason = f"it cannot be read: {error}" if error else "a folder of this name holds no data" if folder and name in SKIPPED_FOLDERS else "hidden" if name.startswith(".") else None
        if reason is None and folder:
            return None
        if reason is None and kind != "other":
            reason = "a lock file of an open workbook" if name.startswith("~$") else "a workbook of the old binary format" if kind == "legacy" else "empty file" if size == 0 else None
        return at, at.removeprefix(root).lstrip("/") or name, kind, size, reason

    rows = [told(*e) for e in listing.walk(spark, path, lambda p: not hidden(p.rsplit("/", 1)[-1]))]
    return spark.createDataFrame([r for r in rows if r], FILES)


def safe_name(rel: str) -> str:
    """A file's name as a view name: lower case, letters and digits, runs of others as one underscore."""
    name = re.sub(r"[^\w]+", "_", rel.lower()).strip("_")
    return f"t_{name}" if not name or name[0].isdigit() else name


def table_names(rels: list[str]) -> dict[str, str]:
    """Names by relative path: the file's, with its folders where two would clash, then numbered."""
    short = Counter(safe_name(r.rsplit("/", 1)[-1]) for r in rels)
    out: dict[str, str] = {}
    for r in sorted(rels):
        name = safe_name(r.rsplit("/", 1)[-1])
        name = safe_name(r) if short[name] > 1 else name
        n, base = 1, name
        while name in out.values():
            n += 1
            name = f"{base}_{n}"
        out[r] = name
    return out


def encoding_of(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """(encoding, notes) from a file's first bytes."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "UTF-8", [("csv.bom", "the file begins with a byte order mark")]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16", [("csv.bom", "the file begins with a byte order mark")]
    for end in range(len(head), max(len(head) - 4, -1), -1):  # the head may end within a character
        try:
            head[:end].decode("utf-8")
            return "UTF-8", []
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1", [("csv.encoding_not_utf8", "the file is not UTF-8; it was read as Latin-1, so other letters may be wrong")]


def split_line(line: str, delimiter: str) -> list[str]:
    """Fields of one line; a delimiter within double quotes does not separate."""
    fields = re.findall(rf'(?:^|(?<={re.escape(delimiter)}))(?:"((?:[^"]|"")*)"|([^{re.escape(delimiter)}]*))(?={re.escape(delimiter)}|$)', line)
    return [a.replace('""', '"') if a else b for a, b in fields]


def delimiter_of(lines: list[str], extension: str) -> tuple[str, list[tuple[str, str]]]:
    """(delimiter, notes): the one that gives most fields on most lines; the extension's own if it separates at all."""
    told = {}
    for d in DELIMITERS:
        rows = joined_lines(lines, d)
        widths = Counter(len(split_line(x, d)) for x in rows)
        width, n = max(widths.items(), key=lambda p: (p[1], p[0])) if widths else (1, 0)
        told[d] = (width, n / max(1, len(rows)))
    best = max(DELIMITERS, key=lambda d: (told[d][0] > 1, told[d][0], told[d][1], -DELIMITERS.index(d)))
    hint = HINTS.get(extension)
    notes = []
    if hint and told[hint][0] > 1:
        if best != hint and told[best][1] >= told[hint][1]:
            notes.append(("csv.delimiter_disagreement", "the extension and the content suggest different separators; the extension's was taken"))
        best = hint
    if told[best][0] > 1 and told[best][1] < 0.95:
        notes.append(("csv.inconsistent_width", f"only {told[best][1]:.0%} of the first lines have {told[best][0]} fields; a separator may stand unquoted within values"))
    if sum(w == told[best][0] and w > 1 and c >= told[best][1] for w, c in told.values()) > 1:
        notes.append(("csv.delimiter_ambiguous", "more than one separator fits"))
    return best, notes


def header_of(rows: list[list[str]]) -> tuple[list[str] | None, list[tuple[str, str]]]:
    """(names, notes); names are null if the first row looks like data: nothing in it but what later rows hold too."""
    if not rows:
        return None, []
    first, rest = rows[0], rows[1:]
    number = re.compile(P.NUMBER)
    plain = [bool(re.search(r"\d", x)) for x in first]
    if rest and any(plain) and all(x.strip() for x in first):
        alike = [sum(bool(re.search(r"\d", r[i])) == p and bool(number.fullmatch(r[i].strip())) == bool(number.fullmatch(x.strip())) for r in rest if len(r) > i) >= 0.5 * len(rest)
                 for i, (x, p) in enumerate(zip(first, plain))]
        if all(alike):
            return None, [("csv.no_header", "the file has no header row; columns are named by position")]
    notes = []
    seen = Counter(x.strip().lower() for x in first if x.strip())
    notes += [("csv.header_duplicate", f"the header {x!r} stands more than once; tools read such files differently") for x, n in seen.items() if n > 1]
    notes += [("csv.header_blank", f"column {i + 1} has no header") for i, x in enumerate(first) if not x.strip()]
    notes += [("csv.header_whitespace", f"the header {x!r} has spaces around it") for x in first if x.strip() and x != x.strip()]
    return first, notes


def column_names(header: list[str]) -> list[tuple[str, str]]:
    """(name, original): repeats are numbered x, x_1, blanks named column_N."""
    out: list[tuple[str, str]] = []
    taken: set[str] = set()
    for i, original in enumerate(header):
        base = name = original.strip() or f"column_{i + 1}"
        n = 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append((name, original.strip()))
    return out


def _look(path: str, head: bytes) -> tuple:
    """A file's dialect from its first bytes."""
    encoding, notes = encoding_of(head)
    if encoding == "UTF-16":
        encoding = "UTF-16LE" if head[:1] == b"\xff" else "UTF-16BE"
    text = head[: len(head) // 2 * 2 if encoding.startswith("UTF-16") else None].decode(encoding, "replace").removeprefix("\ufeff")
    newline = "\r" if "\r" in text and "\n" not in text else "\n"
    lines = [x for x in text.splitlines() if x.strip()]
    lines = (lines[:-1] if len(head) == HEAD_BYTES and len(lines) > 1 else lines)[:HEAD_LINES]  # the last one may be cut
    delimiter, more = delimiter_of(lines, path.rsplit(".", 1)[-1].lower())
    rows = [split_line(x, delimiter) for x in joined_lines(lines, delimiter)]
    header, said = header_of(rows)
    width = Counter(map(len, rows)).most_common(1)[0][0] if rows else 0
    if header is not None and width and len(header) != width:
        said.append(("csv.width_disagreement", f"the header has {len(header)} fields, most rows have {width}"))
    names = header if header is not None else [f"column_{i + 1}" for i in range(width)]
    if not rows:
        said.append(("ingest.no_rows", "the file holds no rows"))
    return path, encoding, delimiter, header is not None, names, [{"code": c, "message": m} for c, m in notes + more + said], newline, None


DIALECT = "path string, encoding string, delimiter string, header boolean, names array<string>, notes array<struct<code:string,message:string>>, newline string, error string"


def _looked(batches):
    """Per (path, content): its dialect; where content is null, the task reads the head itself."""
    for files in batches:
        out = []
        for path, content in zip(files["path"], files["content"]):
            try:
                if content is None:
                    with listing.opened(path) as f:
                        content = f.read(HEAD_BYTES)
                out.append(_look(path, bytes(content)))
            except (OSError, LookupError) as e:
                out.append((path, None, None, None, None, None, None, listing.UNKNOWN if isinstance(e, LookupError) else getattr(e, "strerror", None) or str(e).splitlines()[0]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DIALECT.split(", ")])


def head_of(spark: SparkSession, path: str) -> bytes:
    """The first HEAD_BYTES of a large file, without reading the rest."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD_BYTES)))
    finally:
        stream.close()


def dialects(files: DataFrame) -> DataFrame:
    """(path, encoding, delimiter, header, names, notes, newline, error) of the delimited files that are not skipped.

    Tasks read the heads. Only where they do not know the file system, Spark's reader does it, and for large files the driver.
    """
    spark = files.sparkSession
    sizes = {r["path"]: r["size"] for r in files.where("kind = 'csv' AND skip_reason IS NULL").select("path", "size").collect()}
    if not sizes:
        return spark.createDataFrame([], DIALECT)
    content = F.lit(None).cast("binary").alias("content")
    own = spark.createDataFrame([(p,) for p in sizes], "path string").repartition(min(len(sizes), 4 * spark.sparkContext.defaultParallelism))
    told = own.select("path", content).mapInPandas(_looked, DIALECT).collect()  # a row per file
    rest = [r["path"] for r in told if r["error"] == listing.UNKNOWN]
    shown = [p for p in rest if not p.rsplit("/", 1)[-1].startswith("_")]
    told = [r for r in told if r["error"] != listing.UNKNOWN] + [(p, *[None] * 6, "Spark's readers hide files of such names, and tasks do not know its file system") for p in sorted(set(rest) - set(shown))]
    if rest := shown:
        large = [p for p in rest if sizes[p] > WHOLE_BYTES]
        heads = spark.createDataFrame([(p, bytearray(head_of(spark, p))) for p in large], "path string, content binary")
        if small := sorted(set(rest) - set(large)):
            read = spark.read.format("binaryFile").load([listing.for_reader(p) for p in small])
            heads = heads.unionByName(read.select("path", F.substring("content", 1, HEAD_BYTES).alias("content")))
        told += heads.mapInPandas(_looked, DIALECT).collect()
    return spark.createDataFrame(told, DIALECT)


def with_spanning_values(spark: SparkSession, dialect_rows) -> set[str]:
    """Those of the files in which a quoted value may span lines: some line holds an odd number of quotes. One pass for each encoding, a row per file."""
    out: set[str] = set()
    for encoding in sorted({d["encoding"] for d in dialect_rows}):
        paths = [listing.for_reader(d["path"]) for d in dialect_rows if d["encoding"] == encoding]
        lines = spark.read.option("encoding", encoding).text(paths).select(F.col("_metadata.file_path").alias("path"), (F.regexp_count("value", F.lit('"')) % 2).alias("odd"))
        out |= {listing.of_metadata(r["path"]) for r in lines.where("odd = 1").select("path").distinct().collect()}
    return out


def _named(dialect) -> list[tuple[str, dict]]:
    return [(n, {"original": o} if dialect["header"] else {}) for n, o in column_names(list(dialect["names"]))]


def _options(dialect) -> dict[str, str]:
    return {"sep": dialect["delimiter"], "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "quote": '"', "escape": '"', "enforceSchema": "true", "columnPruning": "false"}


def _kind_of_reject(raw: Column, fields: Column, width: Column) -> list[Column]:
    return [F.when(fields < width, "MISSING COLUMNS").otherwise("TOO MANY COLUMNS").alias("error_type"), raw.alias("raw")]


def _parsed(spark: SparkSession, dialect, multi_line: bool) -> DataFrame:
    named = _named(dialect)
    schema = T.StructType([*(T.StructField(n, T.StringType(), True, m) for n, m in named), T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(schema).options(**_options(dialect)).option("encoding", dialect["encoding"]).option("header", str(dialect["header"]).lower())
    rows = reader.option("multiLine", str(multi_line).lower()).csv(listing.for_reader(dialect["path"]))
    # the reader refuses queries on its column of bad rows alone, so another one is named with it
    return rows.where(F.coalesce(F.length(P.ident(named[0][0])) >= 0, F.lit(True)) if named else F.lit(True))


def load(spark: SparkSession, dialect, multi_line: bool = False) -> DataFrame:
    """The rows of one file that fit its header, all columns text, by Spark's CSV reader.

    multi_line: one task reads the file, whatever lines its values span.
    """
    rows = _parsed(spark, dialect, multi_line).where(F.col(BAD).isNull())
    return rows.select(*[F.col(P.ident(n)).alias(n, metadata=m) for n, m in _named(dialect)])


def _fields_in(raw: Column, delimiter: str) -> Column:
    return F.size(F.split(F.regexp_replace(raw, '"(?:[^"]|"")*"', "q"), re.escape(delimiter)))


def rejects_of_one_task(spark: SparkSession, dialect) -> DataFrame:
    """(path, line: null, error_type, raw) of what load(multi_line=True) leaves out; that reader does not tell lines."""
    named = _named(dialect)
    rows = _parsed(spark, dialect, True).where(F.col(BAD).isNotNull())
    raw = F.when(F.coalesce(F.length(P.ident(named[0][0])) >= 0, F.lit(True)), F.col(BAD))
    told = rows.select(raw.alias("raw"))
    return told.select(F.lit(dialect["path"]).alias("path"), F.lit(None).cast("long").alias("line"), *_kind_of_reject(F.col("raw"), _fields_in(F.col("raw"), dialect["delimiter"]), F.lit(len(named))))


def rejects_of(spark: SparkSession, dialect_rows) -> DataFrame:
    """(path, line, error_type, raw) of the lines that load() leaves out: one scan for all files of an encoding, delimiter and width.

    Lines are parsed by the reader's own parser, so that a row is either in the table or here. A line's number is its place
    in its part of the file after the lines of the parts before: a row per part is joined, no line is shuffled for it.
    """
    out = spark.createDataFrame([], "path string, line long, error_type string, raw string")
    groups: dict[tuple, list] = {}
    for d in dialect_rows:
        groups.setdefault((d["encoding"], d["delimiter"], len(d["names"])), []).append(d)
    for (encoding, delimiter, width), some in sorted(groups.items(), key=lambda g: g[0]):
        read = spark.read.option("encoding", encoding).text([listing.for_reader(d["path"]) for d in some])
        lines = read.select(listing.of_metadata_column(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.decode(F.col("value").cast("binary"), encoding).alias("value") if encoding != "UTF-8" else F.col("value"))
        schema = ", ".join([*(f"c{i} STRING" for i in range(width)), f"{BAD} STRING"])
        bad = lines.where(F.trim("value") != "").withColumn("raw", F.from_csv("value", schema, _options(some[0]))[BAD]).where("raw IS NOT NULL")
        parts = lines.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
        before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select("path", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
        told = bad.join(parts, ["path", "start"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), *_kind_of_reject(F.col("raw"), _fields_in(F.col("raw"), delimiter), F.lit(width)))
        out = out.unionByName(told)
    return out


def from_records(found: Found, dialect) -> DataFrame:
    """The rows of one file among records() that fit its header, all columns text."""
    named = _named(dialect)
    own = found.rows.where((F.col("path") == dialect["path"]) & (F.size("fields") == len(named)))
    return own.select(*[F.get("fields", F.lit(i)).alias(n, metadata=m) for i, (n, m) in enumerate(named)])


def rejects_of_records(spark: SparkSession, found: Found, dialect_rows) -> DataFrame:
    """(path, line, error_type, raw) of records() that do not fit their header: one plan for all files."""
    widths = spark.createDataFrame([(d["path"], len(d["names"])) for d in dialect_rows], "path string, width int")  # a row per file
    bad = found.rows.join(widths, "path").where(F.size("fields") != F.col("width")).join(found.parts, ["path", "start"])
    return bad.select("path", (F.col("before") + F.col("line")).alias("line"), *_kind_of_reject(F.col("text"), F.size("fields"), F.col("width")))


def reject_samples(rejects: DataFrame, k: int = 20) -> DataFrame:
    """At most k rejects per table, in line order."""
    return rejects.withColumn("rank", F.row_number().over(Window.partitionBy("table").orderBy("line"))).where(F.col("rank") <= k).drop("rank")


def declared_types(spark: SparkSession, path: str, dialect, ratio: float = 0.1) -> list[tuple[str, str]]:
    """What an import that guesses types would make of the columns, for contrast."""
    reader = spark.read.option("sep", dialect["delimiter"]).option("encoding", dialect["encoding"]).option("header", str(dialect["header"]).lower())
    return reader.option("inferSchema", "true").option("samplingRatio", str(ratio)).csv(listing.for_reader(path)).dtypes


def read_folder(spark: SparkSession, path: str) -> dict:
    """tables (by name), files, notes (table, code, message) and rejects (table, line, error_type, raw) of a folder.

    A file that cannot be opened is a row of files with the reason; the others are read.
    """
    from .workbook import read_workbooks

    listed = discover(spark, path)
    told, faults = [], {}
    for d in dialects(listed).collect():  # a row per file
        if d["error"] is None:
            told.append(d)
        else:
            faults[d["path"]] = f"it cannot be read: {d['error']}"
    rows = [r.asDict() | {"skip_reason": faults.get(r["path"], r["skip_reason"])} for r in listed.collect()]
    files = spark.createDataFrame([tuple(r.values()) for r in rows], FILES)
    rels, sizes = {r["path"]: r["rel"] for r in rows}, {r["path"]: r["size"] for r in rows}
    sheets, book_notes = read_workbooks(spark, files)
    # files and sheets share one space of names, so that none takes another's place
    names = table_names(list(dict.fromkeys([*(rels[d["path"]] for d in told), *sheets, *(place for place, _, _ in book_notes)])))
    of_path = {d["path"]: names[rels[d["path"]]] for d in told}
    wide = {d["path"] for d in told if d["encoding"].startswith("UTF-16") or d["newline"] == "\r" or d["path"].rsplit("/", 1)[-1].startswith("_")}
    spanning = wide | with_spanning_values(spark, [d for d in told if d["path"] not in wide and d["names"]])
    forms = [Form(d["path"], d["delimiter"], d["encoding"], d["header"], len(d["names"]), d["newline"], sizes[d["path"]]) for d in told if d["path"] in spanning and d["names"]]
    found = records(spark, forms)
    left = {f.path for f in found.left}
    plain = [d for d in told if d["names"] and d["path"] not in spanning]
    cut = {d["path"]: d for d in told if d["names"] and d["path"] in spanning and d["path"] not in left}
    tables, notes = {}, []
    for d in told:
        name = of_path[d["path"]]
        tables[name] = from_records(found, d) if d["path"] in cut else load(spark, d, d["path"] in left)
        notes += [(name, n["code"], n["message"]) for n in d["notes"]]
    named = spark.createDataFrame(list(of_path.items()), "path string, table string")  # a row per file
    rejects = rejects_of(spark, plain).unionByName(rejects_of_records(spark, found, list(cut.values())))
    for d in told:
        if d["path"] in left:
            rejects = rejects.unionByName(rejects_of_one_task(spark, d))
    rejects = rejects.join(named, "path").select("table", "line", "error_type", "raw")
    tables |= {names[place]: df for place, df in sheets.items()}
    notes += [(names[place], code, message) for place, code, message in book_notes]
    for name, df in tables.items():
        df.createOrReplaceTempView(P.ident(name))
    return {"tables": tables, "files": files, "notes": spark.createDataFrame(notes, "table string, code string, message string"), "rejects": rejects}
