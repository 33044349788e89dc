"""Workbooks read like the CSV form of the same rows."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from rankloom.plans.evaluate import train_queries
from rankloom.sources import files, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write(path, sheets, strings=()):
    """A workbook of {name: inside of sheetData}."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for i, inside in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{inside}</sheetData></worksheet>')


def inline(rows):
    return "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in r) + "</row>" for r in rows)


def test_kinds_of_cells(spark, tmp_path):
    strings = ["<t>Query</t>", "<t>Assessment_url</t>", "<r><t>two </t></r><r><rPr><b/></rPr><t>runs</t></r><rPh><t>no</t></rPh>",
               '<t xml:space="preserve"> line\none &amp; two </t>']
    first = ('<row r="1"><c r="C1" t="s"><v>0</v></c><c r="A1" t="s"><v>1</v></c><c r="AB1" t="inlineStr"><is><t>N</t></is></c></row>'
             '<row r="3"><c r="A3" t="str"><f>x</f><v>u1</v></c><c r="C3" t="s"><v>2</v></c><c r="AB3"><v>4.5</v></c></row>'
             '<row r="4"><c r="B4"><v>9</v></c></row><row r="5"><c r="C5" t="s"><v>3</v></c><c r="AB5" t="b"><v>1</v></c></row>')
    write(tmp_path / "a.xlsx", {"One": first, "Two": inline([["Query"], ["q2"]])}, strings)
    got = workbooks.read_workbooks(spark, str(tmp_path), ["Query", "N", "Assessment_url", "None"]).orderBy("row").collect()
    assert [tuple(r)[1:] for r in got] == [(3, "two runs", "4.5", "u1", None), (5, " line\none & two ", "1", None, None)]
    two = workbooks.read_workbooks(spark, str(tmp_path), ["Query"], sheet="Two").collect()
    assert [(r.row, r.Query) for r in two] == [(2, "q2")]


def test_a_folder_equals_the_csv_form(spark, tmp_path):
    rows = [(f"query {i % 7},\nwith \"quotes\" & <marks>", f"https://h/item-{i}/") for i in range(9000)]
    (tmp_path / "x").mkdir()
    write(tmp_path / "a.xlsx", {"S": inline([("Query", "Assessment_url"), *rows[:5000]])})
    write(tmp_path / "x" / "b.xlsx", {"S": inline([("Assessment_url", "Query"), *((u, q) for q, u in rows[5000:])])})
    (tmp_path / "notes.txt").write_text("no workbook")
    files.write_csv(spark.createDataFrame(rows, "Query string, Assessment_url string").coalesce(1), str(tmp_path / "csv"))
    got = workbooks.read_labelled_workbooks(spark, str(tmp_path))
    want = files.read_labelled_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, got.select("Query", "Assessment_url").collect())) == sorted(map(tuple, want.select("Query", "Assessment_url").collect()))
    first = lambda df: [r.query_text for r in train_queries(df, 3).orderBy("query_id").collect()]
    assert first(got) == first(want)


def test_files_that_are_no_workbooks_are_named(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="bad.xlsx"):
        workbooks.read_workbooks(spark, str(tmp_path), ["Query"]).collect()


def test_an_empty_sheet(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"S": ""})
    assert workbooks.read_workbooks(spark, str(tmp_path), ["Query"]).collect() == []
