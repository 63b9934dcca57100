"""A3: workbook (xlsx) sheets as a Python Data Source.

``spark.read.format("xlsx").schema(S).option("path", glob).option("sheet", name).load()``
plans one input partition per (workbook file, sheet), so many workbooks are read in
parallel by executors; the first row is the header (``headerRows=1``) and cells are
cast to the declared schema.  The writer side (``df.write.format("xlsx")``) writes
single-sheet workbooks of at most ``MAX_ROWS`` rows, one after the other in a task.  Both sides go
row by row, so a task holds one row whatever the sheet's size (and, reading, the shared strings).  Only the standard library is used (zip + XML).
"""

from __future__ import annotations

import datetime as _dt
import decimal as _dec
import glob as _glob
import itertools
import os
import re
import uuid
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import (BooleanType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType,
                               StructType)

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
_TAG = f"{{{_NS['m']}}}"
MAX_ROWS = 250_000  # in one workbook; a spreadsheet ends at 1,048,576


def local_path(path: str) -> str:
    """Filesystem path of a ``file:`` URI (or a plain path).  The stdlib reader/writer needs
    a mounted filesystem; other schemes are rejected explicitly."""
    if path.startswith("file:"):
        rest = path[len("file:"):]
        return "/" + rest.lstrip("/")
    if "://" in path:
        raise ValueError(f"xlsx source needs a mounted filesystem path, got {path!r}")
    return path


def _col_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _col_name(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def sheet_rows(path: str, sheet: str):
    """Yield rows (lists of cell strings, None for empty) of one sheet."""
    with zipfile.ZipFile(path) as z:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = None
        for s in wb.find("m:sheets", _NS):
            if s.get("name") == sheet:
                rid = s.get(f"{{{_NS['r']}}}id")
                for rel in rels:
                    if rel.get("Id") == rid:
                        target = rel.get("Target")
        if target is None:
            return
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(_TAG + "t")) for si in _elements(f, "si")]
        with z.open("xl/" + target.lstrip("/").removeprefix("xl/")) as f:
            for row in _elements(f, "row"):
                cells = {}
                for c in row.findall("m:c", _NS):
                    t = c.get("t")
                    if t == "inlineStr":
                        val = "".join(x.text or "" for x in c.iter(_TAG + "t"))
                    else:
                        v = c.find("m:v", _NS)
                        val = None if v is None else v.text
                        if t == "s" and val is not None:
                            val = shared[int(val)]
                    cells[_col_index(c.get("r"))] = val
                width = max(cells) + 1 if cells else 0
                yield [cells.get(i) for i in range(width)]


def _elements(f, name: str):
    """The elements ``name`` of an XML file one after the other; each is gone from memory when the next is asked for."""
    open_elements = []
    for event, e in ET.iterparse(f, ("start", "end")):
        if event == "start":
            open_elements.append(e)
            continue
        open_elements.pop()
        if e.tag == _TAG + name:
            yield e
            if open_elements:
                open_elements[-1].clear()


def _convert(v, dt):
    if v is None or v == "":
        return None
    if isinstance(dt, StringType):
        return v
    if isinstance(dt, (IntegerType, LongType)):
        return int(float(v))
    if isinstance(dt, DoubleType):
        return float(v)
    if isinstance(dt, DecimalType):
        return _dec.Decimal(v).quantize(_dec.Decimal(1).scaleb(-dt.scale))
    if isinstance(dt, DateType):
        return _dt.date.fromisoformat(v[:10])
    if isinstance(dt, BooleanType):
        return v.strip().lower() in ("1", "true")
    return v


class _SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__((path, sheet))
        self.path = path
        self.sheet = sheet


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.paths = sorted(_glob.glob(local_path(options["path"])))
        self.sheets = [s.strip() for s in options.get("sheet", "Sheet1").split(",")]
        self.header_rows = int(options.get("headerRows", "1"))

    def partitions(self):
        return [_SheetPartition(p, s) for p in self.paths for s in self.sheets]

    def read(self, partition):
        rows = sheet_rows(partition.path, partition.sheet)
        header = None
        for i, r in enumerate(rows):
            if i < self.header_rows:
                header = r
                continue
            pos = {name: j for j, name in enumerate(header or [])}
            out = []
            for f in self.schema.fields:
                j = pos.get(f.name)
                out.append(_convert(r[j] if j is not None and j < len(r) else None, f.dataType))
            yield tuple(out)


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="inlineStr"><is><t>{"true" if v else "false"}</t></is></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def write_workbook(path: str, sheet: str, header: list[str], rows) -> int:
    """A workbook of one sheet, written row by row; how many rows it has."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                   '</Types>')
        z.writestr("_rels/.rels",
                   f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["p"]}">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                   '</Relationships>')
        z.writestr("xl/workbook.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}">'
                   f'<sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["p"]}">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
                   '</Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            def put(text):
                f.write(text.encode("utf-8"))
            put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>')
            put('<row r="1">' + "".join(_cell(f"{_col_name(i)}1", h) for i, h in enumerate(header)) + "</row>")
            for r_i, row in enumerate(rows, start=2):
                put(f'<row r="{r_i}">' + "".join(_cell(f"{_col_name(i)}{r_i}", v) for i, v in enumerate(row)) + "</row>")
                n += 1
            put("</sheetData></worksheet>")
    return n


class _Commit(WriterCommitMessage):
    def __init__(self, paths: list[str], rows: int):
        self.paths = paths
        self.rows = rows


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.dir = local_path(options["path"])
        self.sheet = options.get("sheet", "Sheet1")

    def write(self, iterator):
        os.makedirs(self.dir, exist_ok=True)

        def plain(v):
            if isinstance(v, _dec.Decimal):
                return str(v)
            if isinstance(v, (_dt.date, _dt.datetime)):
                return v.isoformat()
            return v
        rows, paths, n = ([plain(v) for v in r] for r in iterator), [], 0
        while not paths or n == len(paths) * MAX_ROWS:  # the one before is full
            paths.append(os.path.join(self.dir, f"part-{uuid.uuid4().hex}.xlsx"))
            n += write_workbook(paths[-1], self.sheet, self.schema.fieldNames(), itertools.islice(rows, MAX_ROWS))
        return _Commit(paths, n)


class WorkbookDataSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        raise ValueError("declare the sheet schema with .schema(...)")

    def reader(self, schema: StructType):
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(schema, self.options)


def register(spark) -> None:
    spark.dataSource.register(WorkbookDataSource)
