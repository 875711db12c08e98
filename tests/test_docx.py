"""Reading and writing Word documents."""

import io
import zipfile

import pytest

from veilspark.operators.entities import exploded, with_entities
from veilspark.operators.mapping import build, with_replacements
from veilspark.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
NAME, MAIL, PHONE = "Asha Example", "info@sample-corp.example", "+91 98765 43210"


def run(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def para(*runs, style=""):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}{''.join(runs)}</w:p>"


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{para(run(text))}</w:tc>"


def fixture() -> bytes:
    body = (
        para(run("Contact person: "), run(NAME, "<w:b/>"), run(" for further information."), style="H1")
        + para()
        + para(run("Email: "), run("info@", "<w:i/>"), run("sample-corp.example", "<w:i/>"), run("."))
        + para(run("Twice 10.1.2.3"), "<w:r><w:tab/><w:t>10.1.2.3</w:t><w:br/><w:t>end</w:t></w:r>")
        + f"<w:tbl><w:tr>{cell('Name')}{cell('Promoter: ' + NAME)}</w:tr><w:tr>{cell('Email')}{cell(MAIL)}</w:tr>"
        + f"<w:tr>{cell('wide', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}</w:tr>"
        + f"<w:tr>{cell('tall', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}{cell('p')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('q')}</w:tr></w:tbl>"
        + '<w:sectPr><w:headerReference w:type="default" r:id="r1"/><w:footerReference w:type="default" r:id="r2"/></w:sectPr>'
    )
    parts = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr {NS}>{para(run('Director: ' + NAME))}</w:hdr>",
        "word/footer1.xml": f"<w:ftr {NS}>{para(run('Contact: ' + PHONE))}</w:ftr>",
        "word/styles.xml": f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="header1.xml"/><Relationship Id="r2" Target="footer1.xml"/></Relationships>',
        "word/media/x.bin": "\x00raw",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(fixture())
    (tmp_path / "in/b.DOCX").write_bytes(fixture())
    (tmp_path / "in/c.txt").write_text("no")
    return tmp_path


def test_blocks(spark, folder):
    rows = [tuple(r)[1:] for r in docx.read_blocks(spark, f"{folder}/in").filter("doc_id like '%a.docx'").orderBy("block_index").collect()]
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert [(r[1], r[2]) for r in rows] == [
        ("paragraph", "body.p_0"), ("paragraph", "body.p_2"), ("paragraph", "body.p_3"), ("table_cell", "table_0.row_0.cell_0.p_0"), ("table_cell", "table_0.row_0.cell_1.p_0"),
        ("table_cell", "table_0.row_1.cell_0.p_0"), ("table_cell", "table_0.row_1.cell_1.p_0"), ("table_cell", "table_0.row_2.cell_0.p_0"), ("table_cell", "table_0.row_3.cell_0.p_0"),
        ("table_cell", "table_0.row_3.cell_1.p_0"), ("table_cell", "table_0.row_4.cell_1.p_0"), ("header", "section_0.header.p_0"), ("footer", "section_0.footer.p_0"),
    ]
    assert rows[2][3] == "Twice 10.1.2.3\t10.1.2.3\nend" and rows[0][4] == "heading 1" and rows[1][4] == "Normal"


def test_source_and_errors(spark, folder):
    docx.register(spark)
    assert spark.read.format("docx").load(f"{folder}/in").count() == docx.read_blocks(spark, f"{folder}/in").count() == 26
    assert docx.read_blocks(spark, f"{folder}/in", max_bytes=10).count() == 0
    with pytest.raises(FileNotFoundError):
        docx.files(spark, f"{folder}/none.docx")
    with pytest.raises(ValueError):
        docx.files(spark, f"{folder}/in/c.txt")


def test_tables(spark, folder):
    rows = docx.read_tables(spark, f"{folder}/in/a.docx").orderBy("row", "cell").collect()
    assert [r.text for r in rows] == ["Name", "Promoter: " + NAME, "Email", MAIL, "wide", "wide", "tall", "p", "tall", "q"]


def test_redacted_copy(spark, folder):
    tagged = with_entities(docx.read_blocks(spark, f"{folder}/in"))
    found = exploded(tagged)
    edits = with_replacements(found, build(found))
    target = docx.save(docx.redacted_files(spark, f"{folder}/in", edits), f"file://{folder}/out").collect()
    assert sorted(r.target.rpartition("/")[2] for r in target) == ["REDACTED_a.docx", "REDACTED_b.DOCX"]
    text = "\n".join(r.text for r in docx.read_blocks(spark, f"{folder}/out").collect())
    assert not any(x in text for x in (NAME, MAIL, PHONE, "10.1.2.3"))
    want = {r.entity_type: r.replacement for r in edits.collect()}
    assert all(text.count(want[k]) == n for k, n in (("PERSON", 6), ("EMAIL_ADDRESS", 4), ("PHONE_NUMBER", 2), ("IP_ADDRESS", 4)))
    assert docx.structure(spark, f"{folder}/in").select("tables", "body_paragraphs").collect() == docx.structure(spark, f"{folder}/out").select("tables", "body_paragraphs").collect()
    raw = zipfile.ZipFile(folder / "out/REDACTED_a.docx")
    assert raw.read("word/media/x.bin") == b"\x00raw" and b"<w:b" in raw.read("word/document.xml")


def test_first_existing(spark, folder):
    have, gone = f"{folder}/in/a.docx", f"{folder}/in/gone.docx"
    assert docx.first_existing(spark, [gone, have]) == have and docx.first_existing(spark, [have, gone]) == have
    with pytest.raises(FileNotFoundError):
        docx.files(spark, docx.first_existing(spark, [gone, gone]))
