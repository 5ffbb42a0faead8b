"""Spreadsheets (Office Open XML) with the standard library: one sheet of rows in, one out. A workbook is read and written on the driver, so it is bounded."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 10_000  # rows that a reference workbook may have, by the format's own rule
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out = chr(65 + n % 26) + out
        n = n // 26 - 1
    return out


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def write(path: str, header: list[str], rows: Iterable[tuple]) -> int:
    """Writes a sheet with a header; numbers stay numbers, null cells are left out. Returns the number of rows."""

    def cell(r: int, c: int, v) -> str:
        if v is None:
            return ""
        at = f"{_letters(c)}{r}"
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>'

    count = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for r, row in enumerate([tuple(header), *rows], 1):
                f.write(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>'.encode())
                count = r - 1
            f.write(b"</sheetData></worksheet>")
    return count


def read(path: str) -> tuple[list[str], list[list]]:
    """The header and rows of the first sheet: results of formulas, texts of links and of runs in several formats."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheet = ET.fromstring(z.read(sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells: list = []
        for c in row.findall("m:c", _NS):
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, value = c.get("t"), c.find("m:v", _NS)
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if kind == "s" else value.text == "1" if kind == "b" else value.text if kind in ("str", "e") else float(value.text)
        rows.append(cells)
    header = [str(h) if h is not None else "" for h in (rows[0] if rows else [])]
    return header, [r + [None] * (len(header) - len(r)) for r in rows[1:]]


def reference_rows(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A workbook's rows by field (texts), headers matched by label or alias; blank rows and rows that name neither country, project nor month drop out."""
    from ampora.sources.files import rename_by_alias

    header, rows = read(path)
    text = lambda v: None if v is None or v == "" else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    data = [tuple(map(text, r[: len(header)])) for r in rows[:MAX_ROWS] if any(v not in (None, "") for v in r)]
    fields = rename_by_alias(spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in header)), aliases)
    known = [c for c in ("country", "project_name", "published_month") if c in fields.columns]
    return fields.dropna("all", subset=known) if known else fields
