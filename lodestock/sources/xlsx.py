"""Workbooks without a spreadsheet library: sheets as rows of text, and a plain writer.

A workbook is one zip archive and so one task; many workbooks are read in parallel, a file to a task, and rows leave in batches.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from itertools import chain, islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = "path string, sheet string, sheet_place int, row long, cells map<string,string>"
BATCH = 4096


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in e.iter(f"{MAIN}t")) for _, e in ET.iterparse(f) if e.tag == f"{MAIN}si"]


def _dates(z: zipfile.ZipFile) -> set[int]:
    """Cell formats that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")) for e in root.iter(f"{MAIN}numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")))}
    formats = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in own | set(range(14, 23)) | {45, 46, 47}}


def sheets(content: bytes) -> Iterator[tuple[str, Iterator[tuple[int, list[str | None]]]]]:
    """(name, rows) of each sheet in workbook order; rows are (number, cells). What a sheet declares as its dimension is not looked at."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared, dates = _strings(z), _dates(z)
    targets = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for e in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = targets[e.get(LINK)]
        yield e.get("name"), _rows(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared, dates)


def _value(c: ET.Element, shared: list[str], dates: set[int]) -> str | None:
    kind, v = c.get("t"), c.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind in ("str", "e"):
        return v.text
    if int(c.get("s", 0)) in dates:
        at = datetime(1899, 12, 30) + timedelta(days=float(v.text))
        return (at + timedelta(microseconds=500_000)).replace(microsecond=0).isoformat()
    number = float(v.text)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def _rows(z: zipfile.ZipFile, path: str, shared: list[str], dates: set[int]) -> Iterator[tuple[int, list[str | None]]]:
    number = 0
    with z.open(path) as f:
        for _, e in ET.iterparse(f):
            if e.tag != f"{MAIN}row":
                continue
            number = int(e.get("r", number + 1))
            cells: list[str | None] = []
            for c in e:
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(c, shared, dates)
            yield number, cells
            e.clear()


def table_rows(content: bytes, required: tuple[str, ...], sheet: str | None = None, header_rows: int = 1) -> Iterator[tuple[str, int, int, dict[str, str]]]:
    """(sheet, its place, row, cells by header) of the sheets that have the required headers, each once, in one of their first rows; or of the one named.

    Missing cells are "", rows without a value are left out. No matching sheet, or a named one that is missing or doesn't match, is an error.
    """
    seen, used = [], 0
    for place, (name, rows) in enumerate(sheets(content)):
        seen.append(name)
        if sheet is not None and name != sheet:
            continue
        head = None
        for number, cells in rows:
            if head is None:
                titles = [(c or "").strip() for c in cells]
                if all(titles.count(h) == 1 for h in required):
                    head = titles
                    used += 1
                elif number >= header_rows:
                    break
            elif any(c is not None and c.strip() for c in cells):
                yield name, place, number, {h: (cells[i] if i < len(cells) else None) or "" for i, h in enumerate(head) if h}
    if not used:
        raise ValueError(f"no sheet {sheet or ''} with headers {', '.join(required)} among {', '.join(seen)}")


def read_tables(spark: SparkSession, path: str | DataFrame, required: tuple[str, ...], *, sheet: str | None = None, header_rows: int = 1) -> DataFrame:
    """(path, sheet, sheet_place, row, cells) of every workbook at `path`, or of a table of workbooks (path, content)."""
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_place", pa.int32()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])

    def parse(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for s, place, number, cells in table_rows(content, required, sheet, header_rows):
                    rows.append({"path": name, "sheet": s, "sheet_place": place, "row": number, "cells": list(cells.items())})
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(parse, ROWS)


def workbooks(rows: DataFrame, sheets: Callable[[list[tuple]], Iterable[tuple[str, list[str], Iterable[Iterable[object]]]]], most_rows: int = 50_000) -> DataFrame:
    """(path, content): a workbook for each `most_rows` rows of a task, whose `sheets` are made of their tuples. No rows come to the driver."""

    def write(batches):
        def made(held):
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.xlsx"]), pa.array([write_workbook(sheets(held))], pa.binary())], names=["path", "content"])

        held: list[tuple] = []
        for b in batches:
            held += zip(*[c.to_pylist() for c in b.columns])
            while len(held) >= most_rows:
                yield made(held[:most_rows])
                held = held[most_rows:]
        if held:
            yield made(held)

    return rows.mapInArrow(write, "path string, content binary")


def columns(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Cells as columns: `names` maps header to column; ord orders rows as the workbook has them."""
    order = F.col("sheet_place").cast("long") * (1 << 40) + F.col("row")
    return rows.select(order.alias("ord"), "sheet", "row", *[F.coalesce(F.try_element_at("cells", F.lit(h)), F.lit("")).alias(c) for h, c in names.items()])


def write_workbook(named: Iterable[tuple[str, list[str], Iterable[Iterable[object]]]]) -> bytes:
    """A workbook of (sheet, headers, rows); strings inline, numbers as numbers, None empty."""
    out, names = io.BytesIO(), []

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, headers, rows) in enumerate(named, start=1):
            names.append(name)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for row in (headers, *rows):
                    f.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                f.write(b"</sheetData></worksheet>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})[:31]}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(names, start=1)) + "</sheets></workbook>")
    return out.getvalue()


def paged(name: str, headers: list[str], rows: Iterable[Iterable[object]], most_rows: int = 1_000_000) -> Iterator[tuple[str, list[str], Iterable[Iterable[object]]]]:
    """Sheets of at most `most_rows` rows each, one at least, for write_workbook, which must take each sheet's rows before the next sheet."""
    left = iter(rows)
    first = next(left, None)
    yield name, headers, [] if first is None else chain([first], islice(left, most_rows - 1))
    for n, row in enumerate(left, start=2):
        yield f"{name} {n}", headers, chain([row], islice(left, most_rows - 1))


def write_report(path: str, named: list[tuple[str, DataFrame]], most_rows: int = 1_000_000) -> None:
    """Result tables as sheets of one workbook, which a spreadsheet bounds at about a million rows each; a larger one is an error, to be written as Parquet."""
    parts = []
    for name, df in named:
        rows = df.limit(most_rows + 1).toArrow().to_pylist()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        parts.append((name, df.columns, [list(r.values()) for r in rows]))
    with open(path, "wb") as f:
        f.write(write_workbook(parts))
