"""What lies in a folder: a walk by tasks, one folder a row, level by level. Nothing is left out of the listing.

Tasks open files through the file systems that pyarrow knows; a scheme it does not know is left to the driver's Hadoop
file system, folder by folder.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyarrow import fs as afs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Levels below the given folder; links between folders are not followed, so a tree this deep is a fault.
DEEPEST = 64
ENTRY = "path string, folder boolean, size long, error string"
#: What tasks say of a scheme they cannot open.
UNKNOWN = "unknown file system"


def plain(path: str) -> str:
    """One form of a path for all who name it: not percent-encoded, local ones as file:/x."""
    return "file:" + path if path.startswith("/") else re.sub("^file:/+", "file:/", path)


def of_metadata(path: str) -> str:
    """plain() of a path as _metadata.file_path writes it, percent-encoded."""
    return plain(unquote(path))


def of_metadata_column(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def for_reader(path: str) -> str:
    """A path as Spark's readers take it: its own brackets, braces and stars are no patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def opened(path: str):
    """A seekable input file in a task. LookupError if its file system is not one that tasks know."""
    if path.startswith("file:"):
        return open(path.removeprefix("file:"), "rb")
    try:
        system, at = afs.FileSystem.from_uri(path)
    except Exception as e:
        raise LookupError(UNKNOWN) from e
    return system.open_input_file(at)


def _local(folder: str) -> Iterator[tuple[str, bool, int, str | None]]:
    with os.scandir(folder.removeprefix("file:") or "/") as entries:
        for e in entries:
            try:
                if e.is_symlink() and e.is_dir():
                    yield f"{folder}/{e.name}", True, 0, "a link to a folder"
                else:
                    yield f"{folder}/{e.name}", e.is_dir(follow_symlinks=False), e.stat().st_size, None
            except OSError as bad:
                yield f"{folder}/{e.name}", False, 0, bad.strerror or str(bad)


def _remote(folder: str) -> Iterator[tuple[str, bool, int, str | None]]:
    try:
        system, at = afs.FileSystem.from_uri(folder)
    except Exception as e:
        raise LookupError(UNKNOWN) from e
    for info in system.get_file_info(afs.FileSelector(at)):
        yield f"{folder}/{info.base_name}", info.type == afs.FileType.Directory, info.size or 0, None


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for folder in batch["path"]:
            try:
                out += list((_local if folder.startswith("file:") else _remote)(folder))
            except LookupError:
                out.append((folder, True, 0, UNKNOWN))
            except OSError as e:
                out.append((folder, True, 0, getattr(e, "strerror", None) or str(e).splitlines()[0]))
        yield pd.DataFrame(out, columns=["path", "folder", "size", "error"])


def by_driver(spark: SparkSession, folder: str) -> list[tuple[str, bool, int, str | None]]:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    try:
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
        return [(f"{folder}/{f.getPath().getName()}", f.isDirectory(), f.getLen(), None) for f in found]
    except Exception as e:  # noqa: BLE001  whatever a file system says, it is about this folder alone
        return [(folder, True, 0, str(e).splitlines()[0][:200])]


def walk(spark: SparkSession, path: str, enter) -> list[tuple[str, bool, int, str | None]]:
    """(path, is a folder, size, error) of all entries below path, a row per entry; enter(path) says whether a folder is walked."""
    root = plain(path.rstrip("/") or "/")
    if urlsplit(root).scheme in ("", "file") and os.path.isfile(root.removeprefix("file:")):
        return [(root, False, os.path.getsize(root.removeprefix("file:")), None)]
    todo, out = [root], []
    for _ in range(DEEPEST):
        if not todo:
            break
        parts = min(len(todo), 4 * spark.sparkContext.defaultParallelism)
        rows = spark.createDataFrame([(f,) for f in todo], "path string").repartition(parts).mapInPandas(_entries, ENTRY).collect()
        found = [tuple(r) for r in rows if r["error"] != UNKNOWN] + [e for r in rows if r["error"] == UNKNOWN for e in by_driver(spark, r["path"])]
        out += found
        todo = [p for p, folder, _, error in found if folder and error is None and enter(p)]
    else:
        out += [(p, True, 0, f"deeper than {DEEPEST} folders") for p in todo]
    return sorted(out, key=lambda e: e[0])
