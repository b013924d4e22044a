import io
import zipfile

from corvane.operators import packing
from corvane.sources import office, parsers


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_word_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="", more="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Top", "Title") + p("Part", "Heading2") + p("one", "", "<w:numPr/>") + p("x = 1", "SourceCode") + p("plain") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('a|b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('d')}</w:tc></w:tr></w:tbl>"
    content = packed(**{"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    got = office.docx_blocks(spark.createDataFrame([(1, content), (2, b"broken")], "document_id long, content binary")).orderBy("order_index").collect()
    assert [(r.type, r.level, r.text) for r in got] == [("TITLE", 1, "Top"), ("HEADING", 2, "Part"), ("LIST", None, "- one"), ("CODE", None, "x = 1"), ("PARAGRAPH", None, "plain"), ("TABLE", None, "| a\\|b | c |\n| --- | --- |\n| d |  |")]


def test_workbooks(spark):
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    content = packed(**{
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="A" r:id="r1"/><sheet name="B" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>head</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="AA2"><v>1.5</v></c></row><row><c r="B3" t="b"><v>1</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })
    cells = office.xlsx_cells(spark.createDataFrame([(1, content)], "document_id long, content binary"))
    assert sorted(tuple(c)[1:] for c in cells.collect()) == [("A", 2, 2, "head"), ("A", 2, 27, "1.5"), ("A", 3, 2, "true"), ("A", 3, 3, "in")]
    assert parsers.sheet_regions(cells.where("col < 9")).first().text == "| head |  |\n| --- | --- |\n| true | in |"


def test_trimming_keeps_what_only_one_item_covers(spark):
    rows = [(1, 1, 1, 10, 0.9, 60), (1, 1, 2, 11, 0.8, 60), (1, 1, 1, 12, 0.7, 60), (1, 2, 1, 13, 0.1, 60)]
    e = spark.createDataFrame(rows, "run_id long, goal_id long, requirement_id long, parent_id long, score double, tokens long")
    assert [r.parent_id for r in packing.trim_packs(e, 190).orderBy("position").collect()] == [10, 11, 13]
    assert [r.parent_id for r in packing.trim_packs(e, 10).orderBy("position").collect()] == [10, 11, 13]
