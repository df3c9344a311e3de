"""Workbooks (.xlsx) as a data source: `spark.read.format("workbook")` and `df.write.format("workbook")`.

Reading: the option `path` is a workbook or a folder of them; each sheet of each workbook (or those that the option `sheets`
names, separated by `|`) is one partition, read row by row from the zip. The first row is the header and is skipped; columns
go by position, as the schema given says. Texts are trimmed; blank cells are null; rows of nulls only are dropped. A number in
a text column reads as a double is shown (123 as 123.0); times are numbers of milliseconds since 1970, dates too.

Writing: each task writes workbooks of its own, of `rows` (1,048,575, as many as a sheet holds) rows at most, streamed into
the zip; the driver moves them to `path` when all tasks are done, and drops them if one fails. The header is the column names,
nulls and empty texts have no cell, numbers are numbers.

Files are opened through pyarrow's file systems, so `path` may be any address that those know. A workbook's table of shared
texts is held whole by each task that reads the workbook.
"""

from __future__ import annotations

import datetime
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .publisher import _file_system

# Names of the file format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Rows of a sheet below its header.
ROWS = 1_048_575
#: Rows of a task, about, and so of a workbook, where a frame is written by `write`.
TASK = 50_000
_UTC = datetime.timezone.utc
_EPOCH = datetime.datetime(1970, 1, 1)
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Characters that XML can't hold, and texts that look like their escape, are written as _xHHHH_.
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x((?![Dd][89A-Fa-f])[0-9A-Fa-f]{4})_")


def double_text(v: float) -> str:
    """A double as Spark casts it to text: digits with a point from 0.001 up to ten million, else with an exponent (shortest digits always)."""
    if v != v or v in (float("inf"), float("-inf")):
        return {True: "Infinity", False: "-Infinity"}[v > 0] if v == v else "NaN"
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return format(Decimal(repr(v)), "f")
    sign, digits, exponent = Decimal(repr(v)).normalize().as_tuple()
    shown = "".join(map(str, digits))
    return f"{'-' * sign}{shown[0]}.{shown[1:] or '0'}E{exponent + len(shown) - 1}"


def column_name(i: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def column_number(cell: str) -> int:
    n = 0
    for c in cell.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


# --- Reading --------------------------------------------------------------------------------------------------------


def _text(element: ElementTree.Element) -> str:
    """All text of a string item, its runs joined; phonetic hints are no text."""
    parts = [e.text or "" for e in element.findall(f"{{{_MAIN}}}t")] + [e.text or "" for e in element.findall(f"{{{_MAIN}}}r/{{{_MAIN}}}t")]
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), "".join(parts))


def _ended(stream, *tags: str) -> Iterator[ElementTree.Element]:
    """Elements of the tags as they end; what was read is let go."""
    wanted, inside = {f"{{{_MAIN}}}{t}" for t in tags}, []
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            inside.append(e)
            continue
        inside.pop()
        if e.tag in wanted:
            yield e
            inside[-1].remove(e)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of a workbook's sheets and of their parts, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
    found = [(s.get("name"), targets[s.get(f"{{{_REL}}}id")]) for s in listed]
    return [(name, target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")) for name, target in found]


def cells(book: zipfile.ZipFile, part: str) -> Iterator[dict[int, object]]:
    """Rows of a sheet as cells by column: texts as str, numbers as the text inside a tuple, truth values as bool."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            shared = [_text(e) for e in _ended(f, "si")]
    with book.open(part) as f:
        for row in _ended(f, "row"):
            out: dict[int, object] = {}
            at = -1
            for c in row.findall(f"{{{_MAIN}}}c"):
                at = column_number(c.get("r")) if c.get("r") else at + 1
                kind, value = c.get("t", "n"), c.findtext(f"{{{_MAIN}}}v")
                if kind == "inlineStr":
                    inside = c.find(f"{{{_MAIN}}}is")
                    out[at] = _text(inside) if inside is not None else ""
                elif value is None or kind == "e":
                    continue
                else:
                    out[at] = shared[int(value)] if kind == "s" else value if kind in ("str", "d") else value.strip() == "1" if kind == "b" else (value.strip(),)
            yield out


def _number(text: str, kind: T.DataType):
    if isinstance(kind, T.DecimalType):
        return Decimal(text).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.IntegralType):
        return int(Decimal(text))
    if isinstance(kind, T.FractionalType):
        return float(text)
    at = _EPOCH + datetime.timedelta(milliseconds=int(Decimal(text)))
    return at.date() if isinstance(kind, T.DateType) else at.replace(tzinfo=_UTC) if isinstance(kind, T.TimestampType) else at


def value(cell, kind: T.DataType):
    """A cell as a column's type has it; null where it is blank or can't be read so."""
    if isinstance(cell, str):
        cell = cell.strip()
        if cell == "" or isinstance(kind, T.StringType):
            return cell or None
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(cell.lower())
        cell = (cell,)
    if cell is None or isinstance(cell, bool):
        shown = None if cell is None else str(cell).lower()
        return shown if isinstance(kind, T.StringType) else cell if isinstance(kind, T.BooleanType) else None if cell is None else _number(str(int(cell)), kind)
    try:
        if isinstance(kind, T.StringType):
            return double_text(float(cell[0]))
        if isinstance(kind, T.BooleanType):
            return float(cell[0]) != 0
        return _number(cell[0], kind)
    except (ArithmeticError, ValueError):
        return None


@dataclass
class Sheet(InputPartition):
    path: str
    part: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.wanted = options["sheets"].split("|") if "sheets" in options else None

    def partitions(self) -> list[Sheet]:
        system, path = _file_system(self.path.rstrip("/"))
        if system.get_file_info(path).type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".xlsx") and not f.base_name.startswith(("_", "."))]
        else:
            found = [path]
        out = []
        for file in sorted(found):
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                out += [Sheet(file, part) for name, part in sheets(book) if self.wanted is None or name in self.wanted]
        return out

    def read(self, sheet: Sheet | None) -> Iterator[tuple]:
        if sheet is None:  # there are no sheets
            return
        system, _ = _file_system(self.path)
        kinds = [f.dataType for f in self.schema.fields]
        with system.open_input_file(sheet.path) as f, zipfile.ZipFile(f) as book:
            for i, row in enumerate(cells(book, sheet.part)):
                out = tuple(value(row.get(at), kind) for at, kind in enumerate(kinds))
                if i and any(v is not None for v in out):
                    yield out


# --- Writing --------------------------------------------------------------------------------------------------------


def _cell(at: str, v) -> str:
    if v is None or v == "":
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (datetime.date, datetime.datetime)):
        full = v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day)
        if full.tzinfo is not None:
            full = full.astimezone(_UTC).replace(tzinfo=None)
        v = (full - _EPOCH) // datetime.timedelta(milliseconds=1)
    if isinstance(v, (int, float, Decimal)) and v == v and abs(v) != float("inf"):
        return f'<c r="{at}"><v>{v!r}</v></c>' if not isinstance(v, Decimal) else f'<c r="{at}"><v>{v:f}</v></c>'
    shown = _UNSAFE.sub(lambda m: f"_x{ord(m.group()):04X}_", str(v))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(shown)}</t></is></c>'


def write_book(out, names: list[str], rows: Iterator[tuple], limit: int = ROWS, sheet: str = "Sheet1") -> int:
    """One workbook of up to `limit` rows to a binary stream; how many rows there were."""
    letters, n = [column_name(i) for i in range(len(names))], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, text)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            line = lambda at, row: f.write(f'<row r="{at}">{"".join(_cell(f"{c}{at}", v) for c, v in zip(letters, row, strict=True))}</row>'.encode())
            f.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            line(1, names)
            while n < limit and (row := next(rows, None)) is not None:
                n += 1
                line(n + 1, row)
            f.write(b"</sheetData></worksheet>")
    return n


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    suffix = ".xlsx"

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.names, overwrite
        self.zoned = [isinstance(f.dataType, T.TimestampType) for f in schema.fields]
        self.rows, self.sheet = min(int(options.get("rows", ROWS)), ROWS), options.get("sheet", "Sheet1")
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, path = _file_system(self.path.rstrip("/"))
        system.create_dir(f"{path}/{self.staged}", recursive=True)
        # Points in time come in the worker's own time zone, without its name.
        utc = lambda row: tuple(v.astimezone(_UTC) if zoned and v is not None else v for v, zoned in zip(row, self.zoned, strict=True))
        rows, names = map(utc, iterator), []
        while (row := next(rows, None)) is not None:
            names.append(f"{uuid.uuid4().hex}{self.suffix}")  # an attempt that fails leaves files that nothing names
            rows = chain([row], rows)
            with system.open_output_stream(f"{path}/{self.staged}/{names[-1]}") as out:
                write_book(out, self.names, rows, self.rows, self.sheet)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _file_system(self.path.rstrip("/"))
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(self.suffix)] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{path}/{self.staged}/{name}", f"{path}/{name}")
        for file in old:
            system.delete_file(file)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _file_system(self.path.rstrip("/"))
        if system.get_file_info(f"{path}/{self.staged}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staged}")


class WorkbookSource(DataSource):
    """The data source `workbook`: register it with `spark.dataSource.register`."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        raise ValueError("a workbook's columns go by position: give a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)


def read(spark: SparkSession, path: str, schema: T.StructType | str, sheets: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").schema(schema)
    return (reader.option("sheets", "|".join(sheets)) if sheets else reader).load(path)


def write(df: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """Replace the workbooks of a folder by the rows of a frame, with shown names: as many as make about TASK rows each."""
    df.sparkSession.dataSource.register(WorkbookSource)
    tasks = -(-df.count() // TASK)
    # Few files or row groups of the input would be few tasks, and large workbooks that are read by one task each.
    df = df.repartition(tasks) if tasks > 1 else df
    df.withColumnsRenamed(headers or {}).write.format("workbook").mode("overwrite").save(path)
