import io
import os
import zipfile

import pytest

from corvane.sources import workbooks
from corvane.sources.folders import workspace

MAIN, LINKS = f'xmlns="{workbooks.MAIN}"', f'xmlns:r="{workbooks.LINKS}"'


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def book(sheets, styles="", shared=(), properties=""):
    """A file of (name, state, inner XML of the sheet)."""
    listed = "".join(f'<sheet name="{n}" state="{s}" r:id="r{i}"/>' for i, (n, s, _) in enumerate(sheets))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    files = {"xl/workbook.xml": f"<workbook {MAIN} {LINKS}>{properties}<sheets>{listed}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>"}
    if styles:
        files["xl/styles.xml"] = f"<styleSheet {MAIN}>{styles}</styleSheet>"
    if shared:
        files["xl/sharedStrings.xml"] = f"<sst {MAIN}>{''.join(f'<si>{x}</si>' for x in shared)}</sst>"
    return packed(files | {f"xl/worksheets/s{i}.xml": f"<worksheet {MAIN}>{x}</worksheet>" for i, (_, _, x) in enumerate(sheets)})


@pytest.fixture()
def folder(spark):
    workbooks.register(spark)
    path = workspace(spark, "books").removeprefix("file:")
    os.makedirs(path)
    return path


def save(folder, name, content):
    with open(f"{folder}/{name}", "wb") as f:
        f.write(content)


def read(spark, folder, **options):
    df = spark.read.format("workbook").options(**options).load(folder)
    return sorted((r.document.rsplit("/", 1)[1], r.sheet, r.row, r.col, r.kind, r.value, r.span_rows, r.span_cols, r.truncated) for r in df.collect())


def test_kinds_dates_and_merged_cells(spark, folder):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="[$-409]d/m/yy;@"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    rows = """<sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1" s="1"><v>45292</v></c><c r="D1" s="2"><v>45292.75</v></c><c r="E1" s="1"><v>0.5</v></c></row>
      <row><c t="b"><v>0</v></c><c s="3"><v>3</v></c><c t="str"><v>f</v></c><c t="e"><v>#N/A</v></c><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c/></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells>"""
    save(folder, "a.xlsx", book([("One", "visible", rows)], styles, ["<t>zero</t>", "<r><t>o</t></r><r><t>ne</t></r><rPh><t>no</t></rPh>"]))
    cells = [x[2:8] for x in read(spark, folder)]
    assert cells == [
        (1, 1, "text", "one", 2, 2), (1, 3, "date", "2024-01-01 00:00:00", 1, 1), (1, 4, "date", "2024-01-01 18:00:00", 1, 1), (1, 5, "date", "12:00:00", 1, 1),
        (2, 1, "boolean", "false", 1, 1), (2, 2, "number", "3", 1, 1), (2, 3, "text", "f", 1, 1), (2, 4, "error", "#N/A", 1, 1), (2, 5, "text", "inline", 1, 1),
    ]
    save(folder, "b.xlsx", book([("One", "visible", '<sheetData><row r="1"><c r="A1" s="1"><v>1</v></c></row></sheetData>')], styles, properties='<workbookPr date1904="1"/>'))
    assert [x[5] for x in read(spark, f"{folder}/b.xlsx")] == ["1904-01-02 00:00:00"]


def test_hidden_sheets_caps_and_broken_files(spark, folder):
    grid = lambda n, m: f"<sheetData>{''.join(f'<row r={chr(34)}{i}{chr(34)}>' + ''.join(f'<c><v>{j}</v></c>' for j in range(m)) + '</row>' for i in range(1, n + 1))}</sheetData>"
    save(folder, "a.xlsx", book([("seen", "visible", grid(5, 4)), ("unseen", "hidden", grid(1, 1))]))
    save(folder, "b.xlsx", b"not a workbook")
    save(folder, "c.txt", b"other")
    got = read(spark, folder, maxRows=3, maxColumns=2)
    assert [x[:4] for x in got if x[4] == "number"] == [("a.xlsx", "seen", i, j) for i in (1, 2, 3) for j in (1, 2)]
    assert [x for x in got if x[4] == "warning"] == [("a.xlsx", "seen", 0, 0, "warning", "more than 3 rows or 2 columns", 1, 1, True)]
    assert [(x[0], x[5]) for x in got if x[4] == "error"] == [("b.xlsx", "unreadable workbook: BadZipFile")]
    assert {x[1] for x in read(spark, folder, includeHidden="true") if x[1]} == {"seen", "unseen"}
    with pytest.raises(Exception, match="maxRows"):
        read(spark, folder, maxRows=0)


def test_large_files_are_split_by_sheet(spark, folder):
    sheets = [(f"s{i}", "visible", f'<sheetData><row r="1"><c r="A1"><v>{i}</v></c></row></sheetData>') for i in range(5)]
    save(folder, "a.xlsx", book(sheets))
    save(folder, "b.xlsx", book(sheets))
    whole, split = (spark.read.format("workbook").option("splitBytes", n).load(folder) for n in (10**6, 1))
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and split.count() == 10


def test_what_is_written_is_read(spark, folder):
    rows = [("Q&A <1>", 1, 1, "text", ' "x" | y ', 1, 2), ("Q&A <1>", 7, 30, "number", "1.5", 1, 1), ("b", 2, 2, "date", "2024-02-29 06:00:00", 3, 1), ("b", 2, 3, "boolean", "true", 1, 1)]
    schema = "sheet string, row int, col int, kind string, value string, span_rows int, span_cols int"
    df = spark.createDataFrame(rows, schema).repartition("sheet").sortWithinPartitions("sheet", "row", "col")
    path = f"{folder}/new"
    for mode in ("append", "overwrite"):
        df.write.format("workbook").mode(mode).save(path)
        assert [x[1:8] for x in sorted(read(spark, path), key=lambda x: x[1:])] == sorted(rows)
    df.write.format("workbook").mode("append").save(path)
    assert len(read(spark, path)) == 8 and "_temporary" not in os.listdir(path)
    df.limit(0).write.format("workbook").mode("append").save(path)
    assert len(read(spark, path)) == 8
    with pytest.raises(Exception, match="needs columns"):
        df.drop("value").write.format("workbook").mode("append").save(path)


def test_windows_of_rows(spark, folder):
    cells = [("d", "s", i, c, "text", f"{i}|{c}") for i in range(2, 124, 2) for c in (1, 3)] + [("d", "s", 0, 0, "warning", "more"), ("d", "t", 4, 2, "text", "x"), ("d", "t", 5, 1, "text", " ")]
    got = {(r.sheet, r.window): r for r in workbooks.row_windows(spark.createDataFrame(cells, "document string, sheet string, row int, col int, kind string, value string"), 50).collect()}
    assert {k: (r.first_row, r.last_row) for k, r in got.items()} == {("s", 0): (2, 100), ("s", 1): (102, 122), ("t", 0): (4, 4)}
    assert got["s", 1].text.split("\n")[:3] == ["| 102\\|1 |  | 102\\|3 |", "| --- | --- | --- |", "| 104\\|1 |  | 104\\|3 |"] and got["t", 0].text == "|  | x |\n| --- | --- |"


def test_large_files_are_read_in_runs_of_sheets(spark, folder):
    save(folder, "a.xlsx", book([(f"s{i}", "visible", f'<sheetData><row r="1"><c r="A1"><v>{i}</v></c></row></sheetData>') for i in range(40)]))
    size = os.path.getsize(f"{folder}/a.xlsx")
    df = spark.read.format("workbook").option("splitBytes", size // 10).load(folder)
    assert 2 <= df.rdd.getNumPartitions() <= 20 and sorted(r.value for r in df.collect()) == sorted(map(str, range(40)))


def test_rows_of_cells_are_written_and_read(spark, folder):
    cell = "struct<col: int, kind: string, value: string>"
    df = spark.createDataFrame([("a", 1, [(1, "text", "x & <y>"), (3, "date", "2024-02-29 06:00:00")]), ("a", 9, [(2, "number", None), (4, "boolean", "false")]), ("b", 2, [])], f"sheet string, row int, cells array<{cell}>").coalesce(1)
    df.write.format("workbook").mode("append").save(f"{folder}/new")
    got = spark.read.format("workbook").option("rows", "true").load(f"{folder}/new").collect()
    assert sorted((r.sheet, r.row, [tuple(c)[:3] for c in r.cells]) for r in got) == [("a", 1, [(1, "text", "x & <y>"), (3, "date", "2024-02-29 06:00:00")]), ("a", 9, [(4, "boolean", "false")])]


def test_plain_and_other_rows_read_alike(monkeypatch, tmp_path):
    monkeypatch.setattr(workbooks, "BLOCK", 200)
    plain = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i % 2}</v></c><c r="C{i}" s="1"><v>{45000 + i}</v></c><c r="D{i}" t="b"><v>1</v></c><c r="E{i}"><v></v></c><c r="F{i}" t="inlineStr"><is><t>a &amp; b</t></is></c></row>' for i in range(1, 40))
    odd = '<row r="50"><c r="A50"/><c r="B50" t="str"><f>1&lt;2</f><v>y</v></c></row><!-- </row> --><row><c><v><![CDATA[7]]></v></c></row>'
    merged = '</sheetData><mergeCells><mergeCell ref="C3:D5"/></mergeCells>'
    sheets = [("p", "visible", f"<sheetData>{plain}{merged}"), ("o", "visible", f"<sheetData>{plain}{odd}{plain.replace('r=\"1\"', 'r=\"61\"', 1)}{merged}")]
    content = book(sheets, '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>', ["<t>zero</t>", "<t>one</t>"])
    for rows, columns in ((100, 256), (20, 256), (100, 3)):
        b = workbooks.Workbook(zipfile.ZipFile(io.BytesIO(content)))
        for _, _, part in b.sheets:
            def lines(): return [tuple(c.values()) for t in b.cells(part, b.shared(), b.date_styles(), rows, columns) for c in t.to_pylist()]
            fast = lines()
            with monkeypatch.context() as m:
                m.setattr(workbooks.Workbook, "_plain", lambda *_: None)
                assert fast == lines()
            assert (3, 3, "date", "2023-03-18 00:00:00", 3, 2) in fast and (fast[-1][2] == "warning") == ((rows, columns) != (100, 256))


def test_windows_of_rows_with_their_cells_are_those_of_cells(spark, folder):
    cells = [("d", "s", i, c, "text", f"{i}|{c}") for i in range(2, 124, 2) for c in (1, 3)] + [("d", "s", 0, 0, "warning", "more"), ("d", "t", 4, 2, "text", "x"), ("d", "t", 5, 1, "text", " ")]
    lines = spark.createDataFrame(cells, "document string, sheet string, row int, col int, kind string, value string")
    rows = lines.selectExpr("document", "sheet", "row", "struct(col, kind, value) AS c").groupBy("document", "sheet", "row").agg({"c": "collect_list"}).withColumnRenamed("collect_list(c)", "cells")
    assert sorted(map(tuple, workbooks.row_windows(rows).collect())) == sorted(map(tuple, workbooks.row_windows(lines).collect()))
