"""Tables as documents: one JSON array in parts, and workbooks, as Spark data sources ``json_array`` and ``xlsx``.

The parts of a JSON array, one after another in the order of their names, are one array: the commit, which knows the tasks that had rows, puts brackets
and commas into small parts between them. A record is a line.

Each task with rows writes a workbook of its own, streamed into its zip file row by row, and begins a further sheet where the format's rows end; one
partition makes one workbook. Sheets have the column names in the first row. Nulls are empty cells, numbers cells of numbers, all else text. A
workbook is read back by a streaming parser of sheets, with inline and shared strings, from a given schema; columns are found by their names. No library besides the standard one is used.
"""

from __future__ import annotations

import datetime
import io
import json
import math
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, Row, ShortType, StringType, StructType

from .formats import FileSource, Split, _Reader, batches, lines_body, listed, opened

#: The most rows of a sheet, and the names of the format.
SHEET_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Bytes of a sheet that are compressed at once.
BUFFER = 1 << 16

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]|_x[0-9A-Fa-f]{4}_")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


# --- one JSON array -----------------------------------------------------------------------------


def plain(value):
    """A value as JSON has it; numbers that are none are null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return value


def json_record(row: Row) -> str:
    return "  " + json.dumps(plain(row), ensure_ascii=False)


def json_rows(split: Split, schema: StructType) -> Iterator[tuple]:
    from .formats import _own

    for line in _own(split):
        if (text := line.strip().rstrip(",")) and text not in "[]":
            record = json.loads(text)
            yield tuple(record.get(f.name) for f in schema)


class JsonArraySource(FileSource):
    """Records of one array. Reading needs a schema; records must be a line each, as they are written."""

    suffix = ".json"

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def reader(self, schema: StructType) -> _Reader:
        self.rows = _Rows(json_rows, schema)
        return _Reader(self, schema)

    def frame(self) -> tuple[str, str, str]:
        return "[\n", ",\n", "\n]\n"

    def body(self, schema: StructType):
        return lines_body(json_record, ",\n")


class _Rows:
    """Rows of a split by a function that needs the schema."""

    def __init__(self, of, schema: StructType):
        self.of, self.schema = of, schema

    def __call__(self, split: Split, wanted) -> Iterator[tuple]:
        return self.of(split, self.schema)


# --- workbooks ----------------------------------------------------------------------------------


def column_letters(k: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def column_number(letters: str) -> int:
    n = 0
    for x in letters:
        n = 26 * n + ord(x) - 64
    return n - 1


def _text(value: str) -> str:
    return escape(_CONTROL.sub(lambda m: "".join(f"_x{ord(c):04X}_" for c in m[0]) if len(m[0]) == 1 else f"_x005F{m[0]}", value))


def cell(value, at: str) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f'<c r="{at}"><v>{value!r}</v></c>' if not isinstance(value, Decimal) else f'<c r="{at}"><v>{value}</v></c>'
    text = value if isinstance(value, str) else json.dumps(plain(value), ensure_ascii=False)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_text(text)}</t></is></c>'


class Workbook:
    """The body of a task: rows into sheets of a zip stream, and the workbook's index last."""

    def __init__(self, names: list[str], sheet: str, rows: int = SHEET_ROWS):
        self.names, self.sheet, self.rows = names, sheet, rows

    def __call__(self, out, rows) -> None:
        letters, n, row = [column_letters(k) for k in range(len(self.names))], 0, None
        rows = iter(rows)
        row = next(rows, None)
        with zipfile.ZipFile(_Onward(out), "w", zipfile.ZIP_DEFLATED) as book:
            while row is not None or not n:
                n += 1
                with book.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as sheet:
                    held = [f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN}"><sheetData>', self._row(self.names, letters, 1)]
                    size = at = 1
                    while row is not None and at < self.rows:
                        at += 1
                        held.append(self._row(row, letters, at))
                        size += len(held[-1])
                        if size > BUFFER:
                            sheet.write("".join(held).encode())
                            held, size = [], 0
                        row = next(rows, None)
                    sheet.write(("".join(held) + "</sheetData></worksheet>").encode())
            for name, text in self._index(n):
                book.writestr(name, text)

    def _row(self, values, letters: list[str], at: int) -> str:
        return f'<row r="{at}">' + "".join(cell(v, f"{x}{at}") for v, x in zip(values, letters)) + "</row>"

    def _index(self, n: int) -> list[tuple[str, str]]:
        head, sheets = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n', range(1, n + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in sheets)
        names = "".join(f'<sheet name="{escape(self.sheet)[:25]}{k if k > 1 else ""}" sheetId="{k}" r:id="rId{k}"/>' for k in sheets)
        links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in sheets)
        return [
            ("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{names}</sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>'),
            ("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
            ("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>'),
        ]


class _Onward(io.RawIOBase):
    """A stream that is only written onwards."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def sheet_rows(book: zipfile.ZipFile, path: str, shared: list[str]) -> Iterator[dict[int, tuple[str, str]]]:
    """Each row of a sheet: kind and text of the cells by column. Rows are dropped from memory as they are read."""
    tag = f"{{{MAIN}}}"
    with book.open(path) as file:
        top = None
        for event, x in ElementTree.iterparse(file, ("start", "end")):
            if event == "start":
                top = x if x.tag == f"{tag}sheetData" else top
            elif x.tag == f"{tag}row":
                cells = {}
                for k, c in enumerate(x.iterfind(f"{tag}c")):
                    at, kind = c.get("r"), c.get("t", "n")
                    place = column_number(at.rstrip("0123456789")) if at else k
                    text = "".join(t.text or "" for t in c.iter(f"{tag}t")) if kind == "inlineStr" else c.findtext(f"{tag}v")
                    if text is not None:
                        cells[place] = ("str", shared[int(text)]) if kind == "s" else ("str" if kind == "inlineStr" else kind, text)
                yield cells
                if top is not None:
                    top.clear()


def book_rows(split: Split, schema: StructType) -> Iterator[tuple]:
    """The rows of all sheets of a workbook, in order."""
    store, at = opened(split.path)
    tag, rel = f"{{{MAIN}}}", f"{{{OFFICE}}}id"
    with store.open_input_file(at) as raw, zipfile.ZipFile(raw) as book:
        names = set(book.namelist())
        shared = ["".join(t.text or "" for t in x.iter(f"{tag}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind(f"{tag}si")] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{tag}sheet"):
            target = links[sheet.get(rel)]
            rows = sheet_rows(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared)
            head = {_plain_text(text): k for k, (_, text) in next(rows, {}).items()}
            for cells in rows:
                yield tuple(_value(cells.get(head.get(f.name, -1)), f.dataType) for f in schema)


def _plain_text(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def _value(told: tuple[str, str] | None, kind):
    if told is None:
        return None
    _, text = told
    if isinstance(kind, StringType):
        return _plain_text(text)
    if isinstance(kind, BooleanType):
        return text in ("1", "true", "TRUE")
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return int(text) if text.lstrip("-").isdigit() else int(float(text))
    return float(text) if isinstance(kind, (DoubleType, FloatType)) else Decimal(text)


class _Books(_Reader):
    """A workbook is one task's."""

    def partitions(self) -> list[Split]:
        return [Split(path, 0, n) for path, n, _ in listed(self.path)] or [Split("", 0, 0)]

    def read(self, partition: Split):
        return batches(self.rows(partition, None), self.schema) if partition.path else iter(())


class XlsxSource(FileSource):
    """Workbooks. Options: sheetName; sheetRows, the rows of a sheet with its header. Reading needs a schema."""

    suffix = ".xlsx"

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def reader(self, schema: StructType) -> _Books:
        self.rows = _Rows(book_rows, schema)
        return _Books(self, schema)

    def body(self, schema: StructType):
        return Workbook(schema.names, self.options.get("sheetName", "Sheet"), min(SHEET_ROWS, int(self.options.get("sheetRows", SHEET_ROWS))))
