"""Spreadsheets (xlsx: a zip of XML tables), read by the executors, written as one small file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(ref: str) -> int:
    """Column of a cell such as AB12, from 0."""
    out = 0
    for c in re.match(r"[A-Z]+", ref).group():
        out = out * 26 + ord(c) - 64
    return out - 1


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """Cells of a sheet's rows as text, empty ones as None; numbers and dates as they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        one = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[one.get(_LINK)].lstrip("/")
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            out: list[str | None] = []
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _place(c.get("r")) if c.get("r") else i
                out += [None] * (at + 1 - len(out))
                if c.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif (v := c.find(f"{_MAIN}v")) is not None and v.text is not None:
                    out[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield out


def spreadsheet(spark: SparkSession, path: str, columns: list[str], skip: int = 0, header: bool = False, sheet: str | int = 0) -> DataFrame:
    """Rows after ``skip`` ones, as text: by place, or with header by the names of the next row. Blank rows are left out.

    Each workbook is opened by one task; a name that its header lacks gives nulls.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for content in df["content"]:
                rows = list(sheet_rows(content, sheet))[skip:]
                places = list(range(len(columns)))
                if header:
                    names = {(n or "").strip(): i for i, n in reversed(list(enumerate(rows[0] if rows else [])))}
                    places, rows = [names.get(c) for c in columns], rows[1:]
                cut = [[r[i] if i is not None and i < len(r) else None for i in places] for r in rows if any(r)]
                yield pd.DataFrame(cut, columns=columns, dtype="object")

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def from_serial(s: Column) -> Column:
    """Date of a spreadsheet's day number, counted from 30 December 1899."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(s.try_cast("double")).cast("int"))


def workbook(names: list[str], rows: list[tuple], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with a bold header that stays in view."""
    style = ' s="1"'
    cell = lambda v, s="": f"<c{s}/>" if v is None else f"<c{s}><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"{s}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    body = "".join(f"<row>{''.join(cell(v) for v in r)}</row>" for r in rows)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    head = "".join(cell(n, style) for n in names)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData><row>{head}</row>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def write_sheet(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report of at most ``most`` rows as one workbook, in any store that Spark writes; a larger table fails."""
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows for one sheet")
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).create(where, True)
    try:
        stream.write(bytearray(workbook(df.columns, rows)))
    finally:
        stream.close()
