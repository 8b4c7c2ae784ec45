"""Excel workbooks, read and written with the standard library.

Files come through Spark's binary reader, so any store that Spark knows will do; each is
taken apart by the task that read it, and each of its sheets is parsed by a task of its own. Cells arrive as text (numbers in plain
notation, dates in ISO form); types are settled afterwards over whole columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.profiling import coerce, dropna_all, strip_cells
from gristmill.functions.numbers import read_numbers
from gristmill.columns import is_text
from gristmill.sources.grids import SCAN_ROWS, clean_names, filled, is_degenerate, is_header_like, recover_header, skip_sheet, split_regions

MAX_ROWS = 250_000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
GRID = "file string, sheet string, row long, cells array<string>"
# Built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.parse(z.open("xl/sharedStrings.xml")).getroot().iter(f"{MAIN}si")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.parse(z.open("xl/styles.xml")).getroot()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{MAIN}numFmt")}
    formats = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, n in enumerate(ids) if n in DATE_FORMATS or re.search(r"[dyhs]|mm", own.get(n, ""), re.I)}


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {r.get("Id"): r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
    out = []
    for s in ET.parse(z.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet"):
        target = targets.get(s.get(LINK), "")
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _value(cell: ET.Element, shared: list[str], dates: set[int]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "e":
        return None
    if kind in (None, "n"):
        number = float(v.text)
        if int(cell.get("s", 0)) in dates:
            return (datetime(1899, 12, 30) + timedelta(days=number)).isoformat(sep=" ", timespec="seconds").removesuffix(" 00:00:00")
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)
    return v.text


def sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str], dates: set[int], most: int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells) of a sheet, at most ``most`` rows (0: all), parsed as a stream.

    Merged cells of the first rows, where headers are, all get their first cell's value.
    """
    raw = z.read(part)
    merged: dict[tuple[int, int], tuple[int, int]] = {}
    tail = raw.rfind(b"<mergeCells")
    if tail >= 0:
        for a, b in re.findall(rb'ref="([A-Z]+\d+):([A-Z]+\d+)"', raw[tail:]):
            (r0, c0), (r1, c1) = ((int(re.search(rb"\d+", x)[0]) - 1, column_number(x.decode())) for x in (a, b))
            for r in range(r0, min(r1, SCAN_ROWS - 1) + 1):
                for c in range(c0, c1 + 1):
                    merged[r, c] = (r0, c0)
    seen: dict[tuple[int, int], str | None] = {}
    count = 0
    for _, e in ET.iterparse(io.BytesIO(raw)):
        if e.tag != f"{MAIN}row":
            continue
        at = int(e.get("r", count + 1)) - 1
        cells: list[str | None] = []
        for i, c in enumerate(e.iter(f"{MAIN}c")):
            place = column_number(c.get("r")) if c.get("r") else i
            cells += [None] * (place + 1 - len(cells))
            cells[place] = _value(c, shared, dates)
        if at < SCAN_ROWS:
            for (r, c), first in merged.items():
                if r == at:
                    cells += [None] * (c + 1 - len(cells))
                    if (r, c) == first:
                        seen[first] = cells[c]
                    elif not filled(cells[c]):
                        cells[c] = seen.get(first)
        yield at, cells
        e.clear()
        count += 1
        if most and count >= most:
            return


def _opened(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("not an .xlsx workbook; older formats are not supported") from e


def parse(content: bytes, most: int = MAX_ROWS) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of all sheets that hold data."""
    for name, part, own in sheets_of(content):
        for row, cells in rows_of(own, part, most):
            yield name, row, cells


def sheets_of(content: bytes, only: Sequence[str] | None = None) -> Iterator[tuple[str, str, bytes]]:
    """(sheet, part, archive) of the sheets that hold data, of those in ``only`` if it is given: each
    with the strings and styles that it needs and no other sheet. The others are not unpacked."""
    z = _opened(content)
    shared = [n for n in ("xl/sharedStrings.xml", "xl/styles.xml") if n in z.namelist()]
    for name, part in _sheets(z):
        if not skip_sheet(name) and part in z.namelist() and (only is None or name in only):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as own:
                for n in (*shared, part):
                    own.writestr(n, z.read(n))
            yield name, part, out.getvalue()


def rows_of(archive: bytes, part: str, most: int = MAX_ROWS) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells) of one sheet's archive."""
    z = _opened(archive)
    yield from sheet_rows(z, part, _shared(z), _date_styles(z), most)


def read_grids(spark: SparkSession, paths: list[str] | str, max_rows: int = MAX_ROWS, only: Sequence[str] | None = None) -> DataFrame:
    """``(file, sheet, row, cells)`` of workbooks, ``max_rows`` of a sheet at most (0: all).

    A file is taken apart where it is read, and its sheets are dealt out, so that each is
    parsed by itself; sheets that hold no data or are not in ``only`` are not unpacked.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name, part, archive in sheets_of(content.as_py(), only):
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([name]), pa.array([part]), pa.array([archive], pa.binary())], names=["file", "sheet", "part", "archive"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, sheet, part, archive in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                rows = []
                for row, cells in rows_of(archive.as_py(), part, max_rows):
                    rows.append((file, sheet, row, cells))
                    if len(rows) >= 5000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    sheets = files.mapInArrow(split, "file string, sheet string, part string, archive binary")
    return sheets.repartition("file", "sheet").mapInArrow(run, GRID)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "sheet", "row", "cells"])


def tables_of(grids: DataFrame, split: bool = False) -> dict[str, DataFrame]:
    """Tables named ``file:sheet`` (later regions of a sheet ``#2``, ``#3``) from stored grids.

    ``grids`` should be stored (parquet) or cached, for each table reads it again. Headers
    are found from each sheet's first rows, which come to the driver; with ``split``, so
    do the numbers of its blank rows.
    """
    tops = grids.where(F.col("row") < SCAN_ROWS).groupBy("file", "sheet").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("top"), F.max(F.size("cells")).alias("width")).orderBy("file", "sheet").collect()
    out = {}
    for t in tops:
        mine = grids.where((F.col("file") == t["file"]) & (F.col("sheet") == t["sheet"]))
        spans = [(0, None)]
        if split:
            spans = _spans(mine)
        for k, (first, end) in enumerate(spans):
            if k:
                top = [list(r["cells"]) for r in mine.where(F.col("row").between(first, first + SCAN_ROWS - 1)).orderBy("row").collect()]
            else:
                top = _dense(t["top"])
            df = table_from(mine.where((F.col("row") >= first) & (F.col("row") < (end if end is not None else 1 << 40))), top, first)
            if df is not None:
                out[f"{t['file']}:{t['sheet']}" + (f"#{k + 1}" if k else "")] = df
    return out


def _dense(top) -> list[list[str | None]]:
    """Rows by their numbers; what the file leaves out is blank."""
    rows = {r["row"]: list(r["cells"]) for r in top}
    return [rows.get(i, []) for i in range(max(rows, default=-1) + 1)]


def _spans(rows: DataFrame) -> list[tuple[int, int | None]]:
    some = F.exists("cells", lambda c: c.isNotNull() & (F.trim(c) != ""))
    full = {r["row"]: r["cells"] for r in rows.where(some).select("row", F.slice("cells", 1, 40).alias("cells")).collect()}
    last = max(full, default=-1)
    return split_regions([i not in full for i in range(last + 1)], lambda a: is_header_like(list(full[a])))


def table_from(rows: DataFrame, top: list[list[str | None]], first: int = 0) -> DataFrame | None:
    """A typed table from grid rows, or None for a blank or degenerate grid."""
    width = max(map(len, top), default=0)
    names, body = recover_header([r + [None] * (width - len(r)) for r in top])
    names = clean_names(names)
    if not names or is_degenerate(names):
        return None
    cells = rows.where(F.col("row") >= first + body).orderBy("row").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return typed(cells)


def typed(cells: DataFrame) -> DataFrame:
    """A table of text cells with blanks at the ends gone, empty rows and columns left out, and
    numbers and dates read where whole columns hold them."""
    clean = dropna_all(strip_cells(cells))
    return coerce(read_numbers(clean, [f.name for f in clean.schema if is_text(f.dataType)]))


def write_workbook(rows: list[dict] | DataFrame, path: str, sheet: str = "Report", most: int = 1_000_000) -> None:
    """Write rows to an .xlsx file on the driver; more than ``most`` rows are a ValueError."""
    if isinstance(rows, DataFrame):
        names = rows.columns
        data = [r.asDict() for r in rows.limit(most + 1).collect()]
    else:
        data, names = rows, list(rows[0]) if rows else []
    if len(data) > most:
        raise ValueError(f"over {most} rows; write CSV or Parquet instead")

    def cell(v: object) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    lines = ["<row>" + "".join(map(cell, names)) + "</row>"] + ["<row>" + "".join(cell(r[n]) for n in names) + "</row>" for r in data]
    main, rel = MAIN[1:-1], LINK[1:].split("}")[0]
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
