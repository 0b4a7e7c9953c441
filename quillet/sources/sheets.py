"""The parts of a workbook as they stream by: shared strings, merged ranges and cells, none of them a tree in memory."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from xml.parsers import expat

CHUNK = 1 << 18


def column_number(ref: str) -> int:
    """3 of C7."""
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def row_number(ref: str) -> int:
    """7 of C7."""
    return int(re.sub(r"\D", "", ref))


class _Local(dict):
    """Local names by full ones."""

    def __missing__(self, name: str) -> str:
        self[name] = name[name.rfind(" ") + 1 :]
        return self[name]


def _parser(stream, opens: Callable[[str, dict], None], closes: Callable[[str], None] | None = None, text: Callable[[str], None] | None = None, since: bytes = b"") -> Iterator[None]:
    """Parse a stream of XML by chunks, a step per chunk; elements go by their local names, whatever their prefix.

    since: part of a name; elements that stand in chunks before it first stands in the bytes are parsed, but not told of.
    """
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True
    local, before, told = _Local(), b"", False
    while chunk := stream.read(CHUNK):
        # in encodings with more than a byte a letter the name cannot be seen, so all is told
        if not told and (since in before + chunk or not before and (b"\0" in chunk[:4] or chunk[:2] in (b"\xff\xfe", b"\xfe\xff"))):
            told = True
            p.StartElementHandler = lambda name, attrs: opens(local[name], attrs)
            if closes:
                p.EndElementHandler = lambda name: closes(local[name])
            if text:
                p.CharacterDataHandler = text
        before = b"" if told else (before + chunk)[-len(since) :]
        p.Parse(chunk, False)
        yield
    p.Parse(b"", True)
    yield


class Strings:
    """A workbook's shared strings: their bytes one after the other and where each ends. Readings above a text are left out."""

    def __init__(self, stream=None):
        self.data, self.ends = bytearray(), array("q", [0])
        self.inside = self.above = 0
        if stream is not None:
            for _ in _parser(stream, self._opens, self._closes, self._text):
                pass

    def _opens(self, name: str, attrs: dict) -> None:
        self.inside += name == "t"
        self.above += name == "rPh"

    def _text(self, text: str) -> None:
        if self.inside and not self.above:
            self.data += text.encode()

    def _closes(self, name: str) -> None:
        self.inside -= name == "t"
        self.above -= name == "rPh"
        if name == "si":
            self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends) - 1:
            raise IndexError(f"there is no shared string {i}")
        return self.data[self.ends[i] : self.ends[i + 1]].decode()


class Merged:
    """Which cells merged ranges cover, asked in the order of rows: only ranges that reach the row in hand are looked at."""

    def __init__(self, refs: list[str] = ()):
        self.ranges = array("q")
        found = []
        for ref in refs:
            a, _, b = ref.partition(":")
            (y1, y2), (x1, x2) = sorted((row_number(a), row_number(b or a))), sorted((column_number(a), column_number(b or a)))
            found.append((y1, y2, x1, x2))
        for r in sorted(found):
            self.ranges.extend(r)
        self._begin()

    def _begin(self) -> None:
        self.row, self.next, self.live, self.starts, self.reach = -1, 0, [], [], []

    def _move(self, row: int) -> None:
        if row < self.row:  # rows out of order
            self._begin()
        self.row, changed = row, False
        while self.next < len(self.ranges) and self.ranges[self.next] <= row:
            _, y2, x1, x2 = self.ranges[self.next : self.next + 4]
            heappush(self.live, (y2, x1, x2))
            self.next, changed = self.next + 4, True
        while self.live and self.live[0][0] < row:
            heappop(self.live)
            changed = True
        if changed:
            self.starts, self.reach, furthest = [], [], 0
            for x1, x2 in sorted((x1, x2) for _, x1, x2 in self.live):
                furthest = max(furthest, x2)
                self.starts.append(x1)
                self.reach.append(furthest)

    def covers(self, row: int, col: int) -> bool:
        if not self.ranges:
            return False
        if row != self.row:
            self._move(row)
        if not self.starts:
            return False
        i = bisect_right(self.starts, col)
        return i > 0 and self.reach[i - 1] >= col


def merged_ranges(stream) -> Merged:
    """The merged ranges of a sheet; they stand after its cells, so a sheet is gone through once for them."""
    refs = []
    for _ in _parser(stream, lambda name, attrs: refs.append(attrs["ref"]) if name == "mergeCell" else None, since=b"mergeCell"):
        pass
    return Merged(refs)


class Cells:
    """(row, col, value, row_hidden, merged) of the cells of a sheet that have a value.

    text makes a value of a cell's type, style and written value. A row or cell that does not say where it stands
    follows the one before it.
    """

    def __init__(self, stream, merged: Merged, text: Callable[[str, str, str | None], str | None]):
        self.stream, self.merged, self.text = stream, merged, text
        self.row = self.col = self.above = 0
        self.hidden = self.reading = False
        self.kind, self.style, self.value, self.found, self.columns = "n", "0", None, [], {}

    def __iter__(self) -> Iterator[tuple]:
        for _ in _parser(self.stream, self._opens, self._closes, self._data):
            yield from self.found
            self.found.clear()

    def _opens(self, name: str, attrs: dict) -> None:
        if name == "c":
            ref = attrs.get("r")
            if ref:
                letters = ref.rstrip("0123456789")
                if letters in self.columns and len(letters) < len(ref):
                    self.col, self.row = self.columns[letters], int(ref[len(letters) :])
                else:
                    self.col, self.row = column_number(ref), row_number(ref)
                    if letters.isascii() and letters.isalpha() and letters.isupper():
                        self.columns[letters] = self.col
            else:
                self.col += 1
            self.kind, self.style, self.value = attrs.get("t", "n"), attrs.get("s", "0"), None
        elif name == "row":
            self.row, self.col = int(attrs["r"]) if "r" in attrs else self.row + 1, 0
            self.hidden = attrs.get("hidden") in ("1", "true")
        elif name == "rPh":
            self.above += 1
        elif name == ("t" if self.kind == "inlineStr" else "v") and not self.above:
            self.reading, self.value = True, self.value or ""

    def _data(self, text: str) -> None:
        if self.reading:
            self.value += text

    def _closes(self, name: str) -> None:
        if name in ("v", "t"):
            self.reading = False
        elif name == "rPh":
            self.above -= 1
        elif name == "c":
            value = self.text(self.kind, self.style, self.value)
            if value:
                self.found.append((self.row, self.col, value, self.hidden, self.merged.covers(self.row, self.col)))
