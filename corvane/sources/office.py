"""Office files (as Spark's binaryFile reader gives them) to blocks and cells, with the standard library's readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _words(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{W}t")).strip()


def document_blocks(content: bytes) -> list[tuple[str, int | None, str]]:
    """(type, level, text) of a word-processor file's paragraphs and tables: headings, lists and code by style."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    out: list[tuple[str, int | None, str]] = []
    for element in body:
        if element.tag == f"{W}tbl":
            rows = [[" ".join(_words(c).split()).replace("|", "\\|") for c in r.findall(f"{W}tc")] for r in element.findall(f"{W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                width = max(map(len, rows))
                lines = [rows[0], ["---"] * width, *rows[1:]]
                out.append(("TABLE", None, "\n".join("| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in lines)))
        elif element.tag == f"{W}p" and (text := _words(element)):
            style = element.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            level = re.fullmatch(r"(?i)heading\s*(\d)", name)
            if name.lower() == "title":
                out.append(("TITLE", 1, text))
            elif level:
                out.append(("HEADING", int(level[1]), text))
            elif element.find(f"{W}pPr/{W}numPr") is not None or name.lower().startswith("list"):
                out.append(("LIST", None, f"- {text}"))
            else:
                out.append(("CODE" if "code" in name.lower() else "PARAGRAPH", None, text))
    return out


def workbook_cells(content: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of a workbook's visible sheets, rows and columns from 1."""
    files = zipfile.ZipFile(io.BytesIO(content))
    names = set(files.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(files.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(files.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(files.read("xl/workbook.xml")).iter(f"{S}sheet"):
        if sheet.get("state", "visible") != "visible":
            continue
        target = targets[sheet.get(f"{R}id")].lstrip("/")
        for cell in ElementTree.fromstring(files.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{S}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            column = 0
            for c in letters:
                column = 26 * column + ord(c) - 64
            value = cell.find(f"{S}v")
            text = "".join(t.text or "" for t in cell.iter(f"{S}t")) if cell.get("t") == "inlineStr" else "" if value is None else value.text or ""
            if cell.get("t") == "s":
                text = shared[int(text)]
            elif cell.get("t") == "b":
                text = "true" if text == "1" else "false"
            out.append((sheet.get("name"), int(row), column, text))
    return out


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of word-processor files (document_id, content): document_id, order_index, type, level, text; broken files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, *b) for d, c in zip(pdf["document_id"], pdf["content"], strict=True) for i, b in enumerate(_safely(document_blocks, c))]
            yield pd.DataFrame(rows, columns=["document_id", "order_index", "type", "level", "text"]).astype({"level": "Int32"})

    return files.select("document_id", "content").mapInPandas(run, "document_id long, order_index int, type string, level int, text string")


def xlsx_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks (document_id, content): document_id, sheet, row, col, value; broken files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *x) for d, c in zip(pdf["document_id"], pdf["content"], strict=True) for x in _safely(workbook_cells, c)]
            yield pd.DataFrame(rows, columns=["document_id", "sheet", "row", "col", "value"])

    return files.select("document_id", "content").mapInPandas(run, "document_id long, sheet string, row long, col long, value string")


def _safely(parse, content: bytes) -> list:
    try:
        return parse(bytes(content))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
        return []
