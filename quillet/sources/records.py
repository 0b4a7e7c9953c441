"""Records of delimited files whose quoted values span lines, or whose encoding has line ends of two bytes, read by many tasks.

Nobody can tell in the middle of a file whether a place lies inside quotes. So each part of a file is read twice: first
it is asked, for both answers, whether it ends inside quotes; the answers of all parts, one after the other, tell where
each really begins; then each part cuts its records, and only those that cross parts are put together by a shuffle.
Both looks run at once and with the same settings, so that parts are the same; what they cut is written and read again.
"""

from __future__ import annotations

from bisect import bisect_left
from urllib.parse import quote
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import listing
from .written import settings, written

#: Bytes of a part.
PART = 64 << 20
_PIECE = ["path", "start", "value"]


@dataclass(frozen=True)
class Form:
    """How a file is written: path, delimiter, encoding, whether it has a header, and how many columns."""

    path: str
    delimiter: str
    encoding: str
    header: bool
    width: int
    newline: str = "\n"
    size: int = 0

    @property
    def hidden(self) -> bool:
        """Whether Spark's readers leave the file out for its name."""
        return self.path.rsplit("/", 1)[-1].startswith("_")


def fields_of(record: str, d: str) -> list[str | None]:
    """A record's fields; empty ones, quoted or not, are null, as Spark's reader has them. A quote that does not close right before a delimiter is plain text."""
    out: list[str | None] = []
    at, n = 0, len(record)
    while True:
        if at < n and record[at] == '"':
            shut = _closing(record, at + 1)
            after = shut + 1
            while 0 <= shut and after < n and record[after] != d and record[after] in " \t":
                after += 1
            if shut >= 0 and (after >= n or record[after] == d):
                out.append(record[at + 1 : shut].replace('""', '"') or None)
                if after >= n:
                    return out
                at = after + 1
                continue
            if shut < 0:
                out.append(record[at + 1 :].replace('""', '"') or None)
                return out
            end = record.find(d, shut)
        else:
            end = record.find(d, at)
        out.append((record[at:] if end < 0 else record[at:end]) or None)
        if end < 0:
            return out
        at = end + 1


def _closing(text: str, at: int) -> int:
    """The next quote that is not doubled, -1 if there is none."""
    while (at := text.find('"', at)) >= 0:
        if text[at + 1 : at + 2] != '"':
            return at
        at += 2
    return -1


def ends_inside(line: str, inside: bool, d: str) -> bool:
    """Whether a line that begins inside a quoted value, or not, ends inside one."""
    line = line.removesuffix("\r")
    at, n = 0, len(line)
    while True:
        if not inside:
            while at < n and line[at] != '"':
                at = line.find(d, at) + 1
                if not at:
                    return False
            if at >= n:
                return False
            at += 1
        shut = _closing(line, at)
        if shut < 0:
            return True
        at = shut + 1
        while at < n and line[at] != d and line[at] in " \t":
            at += 1
        if at >= n:
            return False
        if line[at] != d:  # plain text up to the next delimiter
            at = line.find(d, at)
            if at < 0:
                return False
        at += 1
        inside = False


@dataclass(frozen=True)
class Found:
    """rows: (path, start of the part, line in it, text, fields) of all records but headers; parts: (path, start, before: lines in the parts before); left: files for a reader in one task."""

    rows: DataFrame
    parts: DataFrame
    left: list[Form]


def joined_lines(lines: list[str], d: str) -> list[str]:
    """Lines as records: those that a quoted value spans are one."""
    out, inside = [], False
    for line in lines:
        if inside:
            out[-1] += "\n" + line
        else:
            out.append(line)
        inside = ends_inside(line, inside, d) if '"' in line else inside
    return out


def _separator(form: Form) -> bytes:
    return form.newline.encode(form.encoding)


def pieces(spark: SparkSession, forms: list[Form]) -> DataFrame:
    """(path, start of the part, value: the bytes between two line ends), in the order of the file within a part."""
    shown = [listing.for_reader(f.path) for f in forms if not f.hidden]
    ranges = [(f.path, start) for f in forms if f.hidden for start in range(0, f.size, PART)]
    out = None
    if shown:
        read = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _separator(forms[0]).decode("latin-1")).text(shown)
        out = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    if ranges:
        tasks = spark.createDataFrame(ranges, "path string, start long").repartition(len(ranges), "path", "start")
        own = tasks.mapInArrow(_ranged(_separator(forms[0]), PART), "path string, start long, value binary")
        out = own if out is None else out.unionByName(own)
    return out


def _ranged(separator: bytes, part: int):
    """Lines that begin in a range of a file, for files that Spark's readers leave out."""
    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                lines: list[bytes] = []
                with listing.opened(path) as f:
                    at = max(0, start - len(separator))  # of the buffer's first byte
                    f.seek(at)
                    buffer, begin, over = b"", None if start else 0, False
                    while not over:
                        more = f.read(1 << 20)
                        buffer += more
                        if begin is None:
                            found = buffer.find(separator)
                            if found < 0:
                                keep = len(separator) - 1
                                at, buffer = at + len(buffer) - keep, buffer[len(buffer) - keep :]
                                over = not more
                                continue
                            begin = found + len(separator)
                        while at + begin < start + part and (end := buffer.find(separator, begin)) >= 0:
                            lines.append(buffer[begin:end])
                            begin = end + len(separator)
                        over = at + begin >= start + part
                        if not over and not more:
                            lines += [buffer[begin:]] if begin < len(buffer) else []
                            over = True
                        at, buffer, begin = at + begin, buffer[begin:], 0
                        if len(lines) >= 4096 or over:
                            yield pa.RecordBatch.from_arrays([pa.array([quote(path, safe="/:")] * len(lines), pa.string()), pa.array([start] * len(lines), pa.int64()), pa.array(lines, pa.binary())], names=_PIECE)
                            lines = []
    return run


def _lines(batches: Iterator[pa.RecordBatch], by_path: dict[str, Form], part: int) -> Iterator[tuple[Form, int, str | None, bool]]:
    """(form, start, line, whole) of each line, None where a part ends. whole is false if the part ends within a character.

    In a two-byte encoding the bytes of a line end may also stand across two characters: what is cut there is joined.
    """
    last, kept, form = None, b"", None
    for batch in batches:
        for path, start, value in zip(*(batch.column(c).to_pylist() for c in _PIECE)):
            if (path, start) != last:
                if last is not None:
                    yield form, last[1], None, not kept
                last, kept, form = (path, start), b"", by_path[listing.of_metadata(path)]
                if start % part:
                    raise RuntimeError(f"a part begins at {start}: the parts of files have changed between two looks")
            if form.encoding.startswith("UTF-16"):
                kept += value
                if len(kept) % 2:
                    kept += _separator(form)
                    continue
                value, kept = kept, b""
            line = value.decode(form.encoding, "replace")
            yield form, start, line.removeprefix("\ufeff") if start == 0 else line, True
    if last is not None:
        yield form, last[1], None, not kept


def _looked(by_path: dict[str, Form], part: int):
    """Per part: whether it ends inside quotes if it begins outside, or inside; whether a value closes in it if it begins inside; whether it is whole; its lines."""
    def run(batches):
        outside, inside, closes, n, rows = False, True, False, 0, []
        for form, start, line, whole in _lines(batches, by_path, part):
            if line is None:
                rows.append((form.path, start, outside, inside, closes, whole, n))
                outside, inside, closes, n = False, True, False, 0
                continue
            n += 1
            if '"' in line:
                outside, inside = ends_inside(line, outside, form.delimiter), ends_inside(line, inside, form.delimiter)
                closes = closes or not inside
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), *[pa.bool_()] * 4, pa.int64()))], names=["path", "start", "outside", "inside", "closes", "whole", "n"])
    return run


LOOK = "path string, start long, outside boolean, inside boolean, closes boolean, whole boolean, n long"


def beginnings(looks: list[tuple]) -> dict[str, list[tuple[int, int | None]]]:
    """Per path, in order: (start of a part, the part in which the value open at its end began, None if none is)."""
    out: dict[str, list[tuple[int, int | None]]] = {}
    for path, start, outside, inside, closes, *_ in sorted(looks):
        parts = out.setdefault(path, [])
        opener = parts[-1][1] if parts else None
        if opener is None:
            opener = start if outside else None
        elif not inside:
            opener = None
        elif closes:
            opener = start
        parts.append((start, opener))
    return out


def _cut(by_path: dict[str, Form], states: dict[str, list[tuple[int, int | None]]], part: int):
    """Per record, or piece of one that crosses parts: path, start, line (its place in the part), opener (of a piece), text."""
    def run(batches):
        rows: list[tuple] = []
        record: list[str] = []
        opener, line_no, first, begins, here = None, 0, False, 0, None
        for form, start, line, _ in _lines(batches, by_path, part):
            if here != (form.path, start):
                here = (form.path, start)
                parts = states[form.path]
                at = bisect_left(parts, (start,))
                opener = parts[at - 1][1] if at else None
                record, line_no, begins, inside, first = [], 0, 0, opener is not None, form.header and start == 0
            if line is None:
                if record or inside:
                    # what is open at the end belongs to the value's first part, this one or an earlier one
                    rows.append((form.path, start, begins, start if opener is None else opener, "\n".join(record)))
                here = None
                continue
            line_no += 1
            if not record and not inside:
                if not line.strip():
                    continue
                begins = line_no
            record.append(line.removesuffix("\r"))  # line ends within values become \n, as in Spark's reader
            inside = ends_inside(line, inside, form.delimiter) if '"' in line else inside
            if not inside:
                text = "\n".join(record)
                if not first:
                    rows.append((form.path, start, begins, opener, text))
                record, opener, first = [], None, False
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        yield _batch(rows)
    return run


CUT = "path string, start long, line long, opener long, text string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["path", "start", "line", "opener", "text"])


def _split(by_path: dict[str, Form]):
    def run(paths: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([fields_of(t, by_path[p].delimiter) for p, t in zip(paths.to_pylist(), texts.to_pylist())], pa.list_(pa.string()))
    return F.arrow_udf(run, "array<string>")


def records(spark: SparkSession, forms: list[Form]) -> Found:
    """All records of the files, written once.

    Left are UTF-16 files in which a part ends within a character, as the parts' line ends lie askew there.
    """
    out, left, parts = None, [], []
    for separator in sorted({_separator(f) for f in forms}):
        some = [f for f in forms if _separator(f) == separator]
        by_path = {f.path: f for f in some}
        with settings(spark, spark__sql__files__maxPartitionBytes=str(PART), spark__sql__files__minPartitionNum="1", spark__sql__files__openCostInBytes="4194304"):
            looks = [tuple(r) for r in pieces(spark, some).mapInArrow(_looked(by_path, PART), LOOK).collect()]  # a row per part
            askew = {path for path, *_, whole, _ in looks if not whole}
            left += [f for f in some if f.path in askew]
            some = [f for f in some if f.path not in askew]
            if not some:
                continue
            by_path = {f.path: f for f in some}
            cut = written(pieces(spark, some).mapInArrow(_cut(by_path, beginnings(looks), PART), CUT))
        before: dict[str, int] = {}
        for path, start, *_, n in sorted(looks):
            parts.append((path, start, before.get(path, 0)))
            before[path] = before.get(path, 0) + n
        crossing = cut.where("opener IS NOT NULL").groupBy("path", "opener").agg(F.sort_array(F.collect_list(F.struct("start", "line", "text"))).alias("parts"))  # one record a group
        joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
        crossed = crossing.select("path", F.col("opener").alias("start"), F.col("parts")[0]["line"].alias("line"), joined.alias("text"))
        whole = cut.where("opener IS NULL").select("path", "start", "line", "text").unionByName(crossed)
        whole = whole.withColumn("fields", _split(by_path)("path", "text"))
        out = whole if out is None else out.unionByName(whole)
    rows = written(out) if out is not None else spark.createDataFrame([], "path string, start long, line long, text string, fields array<string>")
    return Found(rows, spark.createDataFrame(parts, "path string, start long, before long"), left)
