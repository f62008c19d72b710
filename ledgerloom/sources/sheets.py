"""The first sheet of a zipped workbook, row by row, with the standard library alone.

A workbook is an archive of XML parts: one names the sheets, one holds the texts that cells share, one the number
formats, and one part a sheet its cells, of which empty ones are left out. Parts are read as streams and dropped as they are
read. Cells come out as text: days as YYYY-MM-DD, points in time with their hour, numbers with 15 digits, as they are shown.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: A part may unpack to this many bytes: small archives can hold very large ones.
MOST_UNPACKED = 1 << 30
# The numbers of the formats for days and times that need no definition in a workbook.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_NOT_CODE = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')
_REF = re.compile(r"([A-Za-z]*)(\d*)")


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


class _Workbook:
    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.names = {n.lower().lstrip("/"): n for n in self.archive.namelist()}

    def part(self, name: str):
        info = self.archive.getinfo(self.names[name.lower()])
        if info.file_size > MOST_UNPACKED:
            raise ValueError("a part of the workbook is too large")
        return self.archive.open(info)

    def elements(self, name: str, *tags: str) -> Iterator[ElementTree.Element]:
        """The elements of a part with these names as they end; none if there is no such part. What is given out is emptied afterwards."""
        if name.lower() not in self.names:
            return
        with self.part(name) as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e.tag) in tags:
                    yield e
                    e.clear()

    def first_sheet(self) -> tuple[str, bool]:
        """The part of the first sheet, and whether days count from 1904."""
        first, late = None, False
        for e in self.elements("xl/workbook.xml", "sheet", "workbookPr"):
            if _name(e.tag) == "workbookPr":
                late = e.get("date1904") in ("1", "true")
            elif first is None:
                first = next((v for k, v in e.attrib.items() if _name(k) == "id" and "}" in k), "")
        if first is None:
            raise ValueError("no sheet in the workbook")
        for e in self.elements("xl/_rels/workbook.xml.rels", "Relationship"):
            if e.get("Id") == first:
                target = e.get("Target", "")
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}", late
        raise ValueError("no sheet in the workbook")

    def shared(self) -> list[str]:
        return [_text(e) for e in self.elements("xl/sharedStrings.xml", "si")]

    def date_styles(self) -> list[bool]:
        """Of each cell style whether it shows days or times."""
        codes, out = {}, []
        for e in self.elements("xl/styles.xml", "numFmt", "cellXfs"):
            if _name(e.tag) == "numFmt":
                codes[e.get("numFmtId")] = e.get("formatCode", "")
            else:
                out = [_shows_time(x.get("numFmtId", "0"), codes) for x in e]
        return out


def _shows_time(number: str, codes: dict[str, str]) -> bool:
    if number in codes:
        return bool(re.search("[dmyhs]", _NOT_CODE.sub("", codes[number]).lower()))
    return number.isdigit() and int(number) in DATE_FORMATS


def _text(e: ElementTree.Element) -> str:
    """The runs of a text, without the readings that stand beside it."""
    out = []
    for x in e:
        if _name(x.tag) == "t":
            out.append(x.text or "")
        elif _name(x.tag) == "r":
            out += [t.text or "" for t in x if _name(t.tag) == "t"]
    return "".join(out)


def _column(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def day_text(serial: float, late: bool) -> str:
    """A serial number as a day, or as a point in time if it has an hour. Serials under 60 count a 29 February 1900 that there wasn't."""
    start = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30 if serial >= 60 else 31)
    at = start + datetime.timedelta(seconds=round(serial * 86_400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


def _value(cell: ElementTree.Element, shared: list[str], dates: list[bool], late: bool) -> str | None:
    kind = cell.get("t", "n")
    parts = {_name(x.tag): x for x in cell}
    if kind == "inlineStr":
        return _text(parts["is"]) if "is" in parts else None
    raw = parts["v"].text if "v" in parts else None
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "TRUE" if raw.strip() == "1" else "FALSE"
    if kind in ("str", "d"):
        return raw.replace("T00:00:00", "").replace("T", " ") if kind == "d" else raw
    number, style = float(raw), cell.get("s", "0")
    if style.isdigit() and int(style) < len(dates) and dates[int(style)] and 0 <= number < 2_958_466:
        return day_text(number, late)
    return f"{number:.15g}" if abs(number) >= 1e15 or number != int(number) else str(int(number))


def first_sheet(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row from 0, cells) of the rows of the first sheet that hold anything."""
    book = _Workbook(content)
    part, late = book.first_sheet()
    if part.lower() not in book.names:
        raise ValueError("no sheet in the workbook")
    shared, dates, at = book.shared(), book.date_styles(), -1
    for row in book.elements(part, "row"):
        number = row.get("r", "")
        at = int(number) - 1 if number.isdigit() else at + 1
        cells: list[str | None] = []
        for cell in row:
            if _name(cell.tag) != "c":
                continue
            letters = _REF.match(cell.get("r", ""))[1]
            place = _column(letters) if letters else len(cells)
            cells += [None] * (place + 1 - len(cells))
            cells[place] = _value(cell, shared, dates, late)
        if any(c and c.strip() for c in cells):
            yield at, cells
