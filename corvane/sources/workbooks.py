"""Workbooks as a Spark data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

A large file is split into runs of sheets of about as many bytes, small ones are read several to a partition. Sheets are
parsed in blocks of rows, so that a task holds one block and the file's shared strings; plain rows as columns of Arrow,
others element by element. Paths go to pyarrow's file systems, so executors read what they could reach by it (a shared folder, S3, HDFS).
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "workbook"
SCHEMA = "document string, sheet string, sheet_no int, row int, col int, kind string, value string, span_rows int, span_cols int, truncated boolean"
ROWS = "document string, sheet string, sheet_no int, row int, cells array<struct<col: int, kind: string, value: string, span_rows: int, span_cols: int>>, truncated boolean"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
S, R = f"{{{MAIN}}}", f"{{{LINKS}}}"
#: Built-in number formats that show dates or times (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
#: Bytes of a sheet that are parsed at once.
BLOCK = 4 << 20
#: Bytes of small files that are read in one partition.
MOST_SMALL = 16 << 20
#: What stands before a sheet's plain rows, and a plain cell up to its end tag, with the row that it begins.
HEAD = re.compile(rb"""^(?:\xef\xbb\xbf)?(?:<\?xml(?: version="1.0")?(?: encoding="(?:UTF|utf)-8")?(?: standalone="\w+")?\s*\?>)?\s*<worksheet (?:[^<>]*\s)?xmlns="%s"[^<>]*>(?s:.*?)<sheetData>""" % re.escape(MAIN).encode())
CELL = r'^(?:</row>)?(?:<row r="(?P<row>\d+)"[^<>/]*>)?<c r="(?P<col>[A-Z]+)\d+"(?: s="(?P<style>\d+)")?(?: t="(?P<type>\w+)")?>(?:<v>(?P<v>[^<]*)</v>|<is><t(?: xml:space="preserve")?>(?P<text>[^<]*)</t></is>)$'
KINDS = {"s": "text", "inlineStr": "text", "str": "text", "b": "boolean", "e": "error", "d": "date"}
FIELDS = {"row": pa.int32(), "col": pa.int32(), "kind": pa.string(), "value": pa.string(), "span_rows": pa.int32(), "span_cols": pa.int32()}


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def shows_date(code: str) -> bool:
    """Whether a number format has a day, month, year or time outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\[(?![hms]+\])[^\]]*\]|\\.|_.|\*.', "", code.lower())
    return bool(re.search(r"[dmyhs]", bare.replace("general", ""))) and "0.00e" not in bare


def as_date(serial: float, from_1904: bool) -> str:
    """A serial number's time: the hour for less than a day, else date and time. The year 1900 counts a 29 February that wasn't."""
    if 0 <= serial < 1:
        return (datetime(2000, 1, 1) + timedelta(milliseconds=round(serial * 86_400_000))).time().isoformat("auto")
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    return (start + timedelta(milliseconds=round(serial * 86_400_000))).isoformat(sep=" ")


@lru_cache(1 << 16)
def date_of(raw: str, from_1904: bool) -> str | None:
    """A cell's text as a date; null for one that is none."""
    try:
        return as_date(float(raw), from_1904)
    except (OverflowError, ValueError):
        return None


@dataclass
class Workbook:
    """An open file: its sheets' names, states and parts, and what cells refer to."""

    files: zipfile.ZipFile

    def __post_init__(self):
        book = ElementTree.fromstring(self.files.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(self.files.read("xl/_rels/workbook.xml.rels"))}
        part = lambda t: t if t.startswith("xl/") else f"xl/{t}"
        self.sheets = [(s.get("name"), s.get("state", "visible"), part(targets[s.get(f"{R}id")])) for s in book.iter(f"{S}sheet") if s.get(f"{R}id") in targets]
        properties = book.find(f"{S}workbookPr")
        self.from_1904 = properties is not None and properties.get("date1904") in ("1", "true")

    def shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.files.namelist():
            return []
        out = []
        with self.files.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{S}si":
                    out.append("".join(t.text or "" for r in (e, *e.findall(f"{S}r")) for t in r.findall(f"{S}t")))  # phonetic runs aside
                    e.clear()
        return out

    def date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.files.namelist():
            return set()
        root = ElementTree.fromstring(self.files.read("xl/styles.xml"))
        own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{S}numFmt")}
        cells = root.find(f"{S}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in (cells if cells is not None else [])]
        return {i for i, n in enumerate(ids) if (shows_date(own[n]) if n in own else n in DATE_FORMATS)}

    def blocks(self, part: str) -> Iterator[bytes]:
        with self.files.open(part) as f:
            while block := f.read(BLOCK):
                yield block

    def merged(self, blocks: Iterable[bytes]) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, col) of each merged range's first cell: its rows and columns. They stand after a sheet's rows, and only a sheet that names them is parsed for them."""
        out, parser = {}, ElementTree.XMLPullParser()
        for block in blocks:
            parser.feed(block)
            for _, e in parser.read_events():
                if e.tag == f"{S}mergeCell" and (m := re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", e.get("ref", ""))):
                    c0, r0, c1, r1 = column_number(m[1]), int(m[2]), column_number(m[3]), int(m[4])
                    out[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
                if e.tag in (f"{S}row", f"{S}c"):
                    e.clear()
        return out

    def cells(self, part: str, shared: list[str], dates: set[int], max_rows: int, max_columns: int) -> Iterator[pa.Table]:
        """A sheet's cells with a value, up to the caps, in tables of FIELDS of whole rows. A sheet that has more says so in a
        last line of kind ``warning``, whose value names the caps."""
        blocks, names, last = self.blocks(part), False, b""
        if self.files.getinfo(part).file_size <= BLOCK:
            blocks = list(blocks)
        for block in blocks if isinstance(blocks, list) else self.blocks(part):
            names, last = names or b"mergeCell" in last + block, block[-8:]
        spans = self.merged(blocks if isinstance(blocks, list) else self.blocks(part)) if names else {}
        over = yield from self._rows(iter(blocks), spans, shared, dates, max_rows, max_columns)
        if over:
            yield table([(0, 0, "warning", f"more than {max_rows} rows or {max_columns} columns", 1, 1)])

    def _rows(self, blocks: Iterator[bytes], spans: dict, shared: list[str], dates: set[int], max_rows: int, max_columns: int) -> Iterator[pa.Table]:
        """Plain rows as columns, from the first other ones on by elements; whether a cap is passed."""
        rest, over, row_at = next(blocks, b""), False, 0
        caps = (max_rows, max_columns)
        head = HEAD.match(rest)
        if not head:
            return (yield from self._elements(chain([rest], blocks), 0, spans, shared, dates, *caps))
        rest = rest[head.end() :]
        while True:
            end = rest.rfind(b"</row>") + 6
            if end > 5:
                found = self._plain(rest[:end], shared, dates)
                if found is None or rest.find(b"</sheetData>", 0, end) >= 0:
                    return (yield from self._elements(chain([head[0], rest], blocks), row_at, spans, shared, dates, *caps)) or over
                rows = found["row"].to_numpy()
                row_at, rest = int(rows[-1]), rest[end:]
                beyond = rows > max_rows
                if beyond.any():
                    found = found.slice(0, int(beyond.argmax()))
                wide = pc.greater(found["col"], max_columns)
                over = over or bool(beyond.any()) or pc.any(pc.and_(wide, pc.not_equal(found["value"], ""))).as_py() is True
                found = found.filter(pc.and_(pc.invert(wide), pc.not_equal(found["value"], "")))
                if spans:
                    own = [spans.get(x, (1, 1)) for x in zip(found["row"].to_pylist(), found["col"].to_pylist(), strict=True)]
                    for n, name in enumerate(("span_rows", "span_cols")):
                        found = found.set_column(4 + n, name, pa.array([x[n] for x in own], pa.int32()))
                yield found
                if beyond.any():
                    return True
            elif not rest.startswith(b"</sheetData>"):
                block = next(blocks, b"")
                if not block:
                    return (yield from self._elements([head[0], rest], row_at, spans, shared, dates, *caps)) or over
                rest += block
                continue
            if rest.startswith(b"</sheetData>"):
                for _ in blocks:  # to the end, where the archive tells a broken part
                    pass
                return over

    def _plain(self, rows: bytes, shared: list[str], dates: set[int]) -> pa.Table | None:
        """Whole rows, if each cell is a plain one, with blank values."""
        try:
            pieces = pc.split_pattern(pa.array([rows.decode()], pa.large_string()), "</c>").values
        except UnicodeDecodeError:
            return None
        if b"\r" in rows or len(pieces) < 2 or pieces[-1].as_py() != "</row>":
            return None
        x = pc.extract_regex(pieces.slice(0, len(pieces) - 1), CELL)
        if x.null_count:
            return None
        row, col, style, kind, v, text = x.flatten()
        begins = np.flatnonzero(pc.not_equal(row, ""))
        if begins[0] != 0:
            return None
        numbers = pc.cast(row.take(pa.array(begins)), pa.int32()).to_numpy()
        letters, kinds, styles = (c.dictionary_encode() for c in (col, kind, style))
        types = kinds.dictionary.to_pylist()
        dated = pa.array([int(s or 0) in dates for s in styles.dictionary.to_pylist()]).take(styles.indices)
        of = lambda *names: pa.array([t in names for t in types]).take(kinds.indices)
        value = pc.if_else(of("inlineStr"), text, v)
        if pc.any(pc.match_substring(value, "&")).as_py():
            own = value.dictionary_encode()
            try:
                value = pa.array([ElementTree.fromstring(f"<a>{s}</a>").text if "&" in s else s for s in own.dictionary.to_pylist()], pa.large_string()).take(own.indices)
            except ElementTree.ParseError:
                return None
        known = pa.array([KINDS.get(t, "number") for t in types], pa.string()).take(kinds.indices)
        filled = pc.not_equal(value, "")

        def changed(mask, f):
            """``value`` with ``f`` of each distinct one where ``mask`` holds."""
            own = value.filter(mask).dictionary_encode()
            return pc.replace_with_mask(value, mask, pa.array([f(s) for s in own.dictionary.to_pylist()], pa.large_string()).take(own.indices))

        if "s" in types:
            value = changed(pc.and_(of("s"), filled), lambda s: shared[int(s)])
        if "b" in types:
            value = changed(pc.and_(of("b"), filled), lambda s: "true" if s == "1" else "false")
        if pc.any(mask := pc.and_(pc.and_(pc.equal(known, "number"), dated), filled)).as_py():
            own = value.filter(mask).dictionary_encode()
            shown = [date_of(s, self.from_1904) for s in own.dictionary.to_pylist()]
            known = pc.replace_with_mask(known, mask, pa.array(["number" if d is None else "date" for d in shown], pa.string()).take(own.indices))
            value = changed(mask, lambda s: date_of(s, self.from_1904) or s)
        one = pa.array(np.ones(len(col), np.int32))
        at = pa.array([column_number(c) for c in letters.dictionary.to_pylist()], pa.int32()).take(letters.indices)
        return pa.table([pa.array(np.repeat(numbers, np.diff(begins, append=len(col)))), at, known, pc.cast(value, pa.string()), one, one], names=list(FIELDS))

    def _elements(self, blocks: Iterable[bytes], row_at: int, spans: dict, shared: list[str], dates: set[int], max_rows: int, max_columns: int) -> Iterator[pa.Table]:
        """Any rows, after ``row_at``, by elements; whether a cap is passed."""
        parser, over, own = ElementTree.XMLPullParser(("start", "end")), False, []
        col_at = 0
        for block in chain(blocks, [None]):
            parser.close() if block is None else parser.feed(block)
            for event, e in parser.read_events():
                if event == "start":
                    if e.tag == f"{S}row":
                        row_at, col_at = int(e.get("r", row_at + 1)), 0
                        if len(own) >= 10_000 or row_at > max_rows:
                            yield table(own)
                            own = []
                        if row_at > max_rows:
                            return True
                    continue
                if e.tag == f"{S}row":
                    e.clear()
                elif e.tag == f"{S}c":
                    m = re.fullmatch(r"([A-Z]+)(\d+)", e.get("r", ""))
                    col_at = column_number(m[1]) if m else col_at + 1
                    kind, value = self._value(e, shared, dates)
                    if value == "":
                        continue
                    if col_at > max_columns:
                        over = True
                        continue
                    own.append((row_at, col_at, kind, value, *spans.get((row_at, col_at), (1, 1))))
        yield table(own)
        return over

    def _value(self, cell, shared: list[str], dates: set[int]) -> tuple[str, str]:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "text", "".join(t.text or "" for t in cell.iter(f"{S}t"))
        raw = cell.findtext(f"{S}v") or ""
        if raw == "":
            return "text", ""
        if kind == "s":
            return "text", shared[int(raw)]
        if kind == "b":
            return "boolean", "true" if raw == "1" else "false"
        if kind in ("str", "e", "d"):
            return {"str": "text", "e": "error", "d": "date"}[kind], raw
        if int(cell.get("s", 0)) in dates and (date := date_of(raw, self.from_1904)) is not None:
            return "date", date
        return "number", raw


def table(cells: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*cells, strict=True) if cells else [[]] * len(FIELDS), FIELDS.values(), strict=True)], names=list(FIELDS))


@dataclass
class Files(InputPartition):
    """Files to read whole, or a run of sheets of one file: the first one's number and the one after the last."""

    paths: list[str]
    sheets: tuple[int, int] | None = None


@contextmanager
def opened(path: str, whole: bool = True) -> Iterator:
    """A file's bytes, or a file of which only what is asked for is read."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_file(at) as f:
        yield io.BytesIO(f.read()) if whole else f


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.hidden, self.rows = (str(options.get(x, "false")).lower() == "true" for x in ("includeHidden", "rows"))
        self.max_rows, self.max_columns = int(options.get("maxRows", 10_000)), int(options.get("maxColumns", 256))
        self.split, self.together = int(options.get("splitBytes", 4_000_000)), int(options.get("filesPerPartition", 64))
        if not 1 <= self.max_rows <= 1_048_576 or not 1 <= self.max_columns <= 16_384:
            raise ValueError("maxRows is 1 to 1048576, maxColumns 1 to 16384")

    def partitions(self) -> list[Files]:
        """Only files beyond ``splitBytes`` are opened here, to list their sheets and what these take; the sheets themselves aren't read."""
        uri = "://" in self.path or self.path.startswith("file:")
        system, at = fs.FileSystem.from_uri(self.path) if uri else (fs.LocalFileSystem(), self.path)
        top = system.get_file_info(at)
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".xlsx", ".xlsm")) and "/_temporary/" not in f.path)
        named = lambda p: f"{self.path[: len(self.path) - len(at)]}{p}" if uri else p
        out, small, held = [], [], 0
        for path, size in files:
            if size > self.split:
                try:
                    with opened(named(path), whole=False) as f:
                        book = Workbook(zipfile.ZipFile(f))
                        sizes = [book.files.getinfo(p).compress_size if p in book.files.NameToInfo else 0 for _, _, p in book.sheets]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    sizes = [0]
                out += [Files([named(path)], run) for run in runs(sizes, self.split)]
            else:
                if not small or len(small[-1].paths) >= self.together or held + size > max(self.split, MOST_SMALL):
                    small.append(Files([]))
                    held = 0
                small[-1].paths.append(named(path))
                held += size
        return out + small

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        own, n = [], 0
        for lines in self._lines(partition):
            own.append(lines)
            n += lines.num_rows
            if n >= 10_000:
                yield from pa.concat_tables(own).combine_chunks().to_batches()
                own, n = [], 0
        yield from (pa.concat_tables(own) if own else self._shown(table([]), "", None, None)).combine_chunks().to_batches()

    def _lines(self, partition: Files) -> Iterator[pa.Table]:
        for path in partition.paths:
            at = None
            try:
                with opened(path, partition.sheets is None) as f:
                    book = Workbook(zipfile.ZipFile(f))
                    first, end = partition.sheets or (0, len(book.sheets))
                    wanted = [(i, s) for i, s in enumerate(book.sheets) if first <= i < end and (self.hidden or s[1] == "visible")]
                    shared, dates = (book.shared(), book.date_styles()) if wanted else ([], set())
                    for at, (name, _, part) in wanted:
                        for cells in book.cells(part, shared, dates, self.max_rows, self.max_columns):
                            yield self._shown(cells, path, name, at)
            except (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, IndexError, ValueError) as error:
                if at is not None or partition.sheets is None or partition.sheets[0] == 0:
                    yield self._shown(table([(0, 0, "error", f"unreadable workbook: {type(error).__name__}", 1, 1)]), path, None, None)

    def _shown(self, cells: pa.Table, path: str, name: str | None, sheet: int | None) -> pa.Table:
        """A table's lines: its cells, or, with ``rows``, its rows."""
        cells = cells.combine_chunks()
        row, *fields = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells.columns)
        lines = [row, *fields, pc.equal(fields[1], "warning")]
        if self.rows:
            at = row.to_numpy()
            begins = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)), pa.int32()), pa.StructArray.from_arrays(fields, fields=[pa.field(n, t) for n, t in list(FIELDS.items())[1:]]))
            lines = [row.take(pa.array(begins)), lists, lines[-1].take(pa.array(begins))]
        n = len(lines[0])
        of = [pa.repeat(pa.scalar(x, t), n) for x, t in ((path, pa.string()), (name, pa.string()), (sheet, pa.int32()))]
        return pa.table([*of, *lines], names=["document", "sheet", "sheet_no", "row", *(["cells"] if self.rows else list(FIELDS)[1:]), "truncated"])


def runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Neighbours together, as long as they take at most ``most``."""
    out, held = [], 0
    for i, size in enumerate(sizes):
        if out and held + size <= most:
            out[-1], held = (out[-1][0], i + 1), held + size
        else:
            out.append((i, i + 1))
            held = size
    return out


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    """Each task's rows as a workbook. Tasks write beside the folder's files and a commit moves them in, so a task that is run again leaves nothing twice."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, names = options["path"], overwrite, schema.fieldNames()
        if missing := {"sheet", "row"} - set(names):
            raise ValueError(f"a workbook needs columns {sorted(missing)}")
        own = schema["cells"].dataType.elementType.fieldNames() if "cells" in names else names
        if missing := {"col", "value"} - set(own):
            raise ValueError(f"a workbook needs columns {sorted(missing)}")

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = self._system()
        batches = (x for b in iterator if (x := listed(b)).num_rows)
        first = next(batches, None)
        if first is None:
            return Written(None)
        system.create_dir(f"{at}/_temporary", recursive=True)
        path = f"{at}/_temporary/part-{uuid.uuid4().hex}.xlsx"
        with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            names = write_sheets(z, chain([first], batches))
            write_book(z, names)
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = self._system()
        kept = [m.path for m in messages if m is not None and m.path]
        system.create_dir(at, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and f.path.endswith(".xlsx"):
                    system.delete_file(f.path)
        for path in kept:
            system.move(path, f"{at}/{path.rsplit('/', 1)[1]}")
        if kept:
            system.delete_dir(f"{at}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = self._system()
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


def listed(batch: pa.RecordBatch) -> pa.Table:
    """A batch's cells, a line for each: sheet, row, col, kind, value, span_rows, span_cols."""
    held = {n: batch.column(n) for n in batch.schema.names}
    if "cells" in held:
        of = pc.list_parent_indices(held["cells"])
        cells = pc.list_flatten(held["cells"])
        held = {n: held[n].take(of) for n in ("sheet", "row")} | {f.name: x for f, x in zip(cells.type, cells.flatten(), strict=True)}
    kinds = {"sheet": pa.string()} | FIELDS | {"value": pa.large_string()}
    filled = lambda n, t: pa.scalar("text", t) if n == "kind" else pa.scalar(1, t)
    n = len(held["sheet"])
    columns = {c: pc.cast(held[c], t) if c in held else pa.repeat(filled(c, t), n) for c, t in kinds.items()}
    return pa.table({c: pc.fill_null(x, filled(c, x.type)) if c in ("kind", "span_rows", "span_cols") else x for c, x in columns.items()})


def write_sheets(z: zipfile.ZipFile, batches: Iterable[pa.Table]) -> list[str]:
    """Cells in the order of sheet, row and col as sheets, one after another, a batch at a time; their names."""
    names: list[str] = []
    part, merged, at = None, [], None

    def end() -> None:
        part.write(f'</row></sheetData>{"<mergeCells>" + "".join(merged) + "</mergeCells>" if merged else ""}</worksheet>'.encode())
        part.close()

    for batch in batches:
        sheet, row, col, _, _, down, across = (c.combine_chunks() for c in batch.columns)
        rows, n, own = row.to_numpy(), len(row), sheet.dictionary_encode()
        codes, listed_names = own.indices.to_numpy(), own.dictionary.to_pylist()
        begins = np.append(True, codes[1:] != codes[:-1])
        begins[0] = not names or listed_names[codes[0]] != names[-1]
        new = np.append(True, rows[1:] != rows[:-1]) | begins
        new[0] = begins[0] or rows[0] != at
        at = rows[-1]
        numbers = pc.cast(pa.array(rows[new]), pa.large_string())
        before = pc.if_else(pa.array(begins[new]), '<row r="', '</row><row r="')
        opening = pc.replace_with_mask(pa.repeat(pa.scalar("", pa.large_string()), n), pa.array(new), joined(before, numbers, '">'))
        lines = joined(opening, cell_xml(batch))
        offsets, data = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :], lines.buffers()[2]
        wide = np.flatnonzero((down.to_numpy() > 1) | (across.to_numpy() > 1))
        for first, last in runs_of(np.flatnonzero(begins), n):
            if begins[first]:
                if part:
                    end()
                names.append(listed_names[codes[first]])
                part, merged = z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True), []
                part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
            part.write(memoryview(data)[offsets[first] : offsets[last]])
            for i in wide[(wide >= first) & (wide < last)]:
                c, r = col[i].as_py(), int(rows[i])
                merged.append(f'<mergeCell ref="{column_letters(c)}{r}:{column_letters(c + across[i].as_py() - 1)}{r + down[i].as_py() - 1}"/>')
    end()
    return names


def runs_of(begins: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """First and end of each run of ``n`` lines, given where new ones begin."""
    edges = [*([] if len(begins) and begins[0] == 0 else [0]), *begins.tolist(), n]
    yield from zip(edges, edges[1:], strict=False)


def joined(*parts) -> pa.Array:
    """Strings side by side, element by element."""
    large = pa.large_string()
    return pc.binary_join_element_wise(*[pa.scalar(p, large) if isinstance(p, str) else pc.cast(p, large) for p in parts], pa.scalar("", large))


def cell_xml(cells: pa.Table) -> pa.Array:
    """Cells by their kinds: a number, date (as a serial number with a date's format), boolean or text (the default); nothing for a null value."""
    row, col, kind, value = (cells[n].combine_chunks() for n in ("row", "col", "kind", "value"))
    columns, kinds = col.dictionary_encode(), kind.dictionary_encode()
    letters = pa.array([column_letters(c) for c in columns.dictionary.to_pylist()], pa.large_string()).take(columns.indices)
    shown = value
    if pc.any(pc.match_substring_regex(value, "[&<>]")).as_py():
        for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            shown = pc.replace_substring(shown, raw, name)
    for name, form in (("date", serial), ("boolean", lambda v: str(int(v == "true")))):
        if name in kinds.dictionary.to_pylist():
            mask = pc.and_(pc.equal(kind, name), pc.is_valid(value))
            own = value.filter(mask).dictionary_encode()
            shown = pc.replace_with_mask(shown, mask, pa.array([form(v) for v in own.dictionary.to_pylist()], pa.large_string()).take(own.indices))
    plain = {"number": '"><v>', "date": '" s="1"><v>', "boolean": '" t="b"><v>'}
    start = [plain.get(k, '" t="inlineStr"><is><t xml:space="preserve">') for k in kinds.dictionary.to_pylist()]
    stop = ["</v></c>" if k in plain else "</t></is></c>" for k in kinds.dictionary.to_pylist()]
    start, stop = (pa.array(x, pa.large_string()).take(kinds.indices) for x in (start, stop))
    return pc.fill_null(joined('<c r="', letters, row, start, shown, stop), "")


@lru_cache(1 << 16)
def serial(date: str) -> str:
    return repr((datetime.fromisoformat(date) - datetime(1899, 12, 30)) / timedelta(days=1))


def write_book(z: zipfile.ZipFile, names: list[str]) -> None:
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    package = "http://schemas.openxmlformats.org/package/2006"
    z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{sheets}</sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}<Relationship Id="r0" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>')
    z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
    z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(names) + 1))
    z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{parts}</Types>')


class WorkbookSource(DataSource):
    """Options of a read: path (a file or folder), includeHidden, maxRows, maxColumns, splitBytes, filesPerPartition, and
    rows: a line is a row with its cells, not a cell.

    A sheet that passes the caps gives what is within them and a line of kind ``warning`` with ``truncated``; a
    file that can't be read gives a line of kind ``error``. A write takes rows of sheet, row, col and value (and kind, span_rows, span_cols),
    or of sheet, row and cells, sorted within each task, and makes a file of each task's rows.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS if str(self.options.get("rows", "false")).lower() == "true" else SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def row_windows(cells: DataFrame, size: int = 50) -> DataFrame:
    """Sheets in windows of ``size`` rows with a value, as Markdown tables: document, sheet, window, first_row, last_row, width, text.

    ``cells``: lines of cells, or of rows with their cells. Every row of a sheet has as many columns as its widest; rows without a value take no place.
    """
    shown = lambda v: F.replace(F.trim(F.regexp_replace(v, r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    if "cells" in cells.columns:
        filled = F.filter("cells", lambda c: ~c["kind"].isin("warning", "error") & (F.trim(c["value"]) != ""))
        rows = cells.select("document", "sheet", "row", F.transform(filled, lambda c: F.struct(c["col"].alias("col"), shown(c["value"]).alias("v"))).alias("e")).where(F.size("e") > 0)
    else:
        filled = cells.where(~F.col("kind").isin("warning", "error") & (F.trim("value") != ""))
        rows = filled.groupBy("document", "sheet", "row").agg(F.collect_list(F.struct("col", shown(F.col("value")).alias("v"))).alias("e"))
    rows = rows.select("document", "sheet", "row", F.map_from_entries("e").alias("m"), F.array_max(F.transform("e", lambda x: x["col"])).alias("width"))
    sheet = Window.partitionBy("document", "sheet")
    lines = rows.withColumns({"window": F.floor((F.row_number().over(sheet.orderBy("row")) - 1) / size).cast("int"), "width": F.max("width").over(sheet)})
    text = F.transform(F.sequence(F.lit(1), "width"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    lines = lines.withColumn("line", F.concat(F.lit("| "), F.array_join(text, " | "), F.lit(" |")))
    body = F.array_sort(F.collect_list(F.struct("row", "line")))  # ``size`` of them
    out = lines.groupBy("document", "sheet", "window", "width").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.transform(body, lambda x: x["line"]).alias("lines"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    joined = F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", F.lit(2), F.size("lines"))), "\n")
    return out.select("document", "sheet", "window", "first_row", "last_row", "width", joined.alias("text"))
