import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.plans import evaluate, report
from lectern.sources import corpus, ooxml, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
AP = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def make(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda runs, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}{runs}</w:p>"
    r = lambda t, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{t}</w:t></w:r>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{r(t)}</w:p></w:tc>"
    body = (
        p(r("Title", "<w:b/>"), "h1") + p(r("plain ") + r("bold", "<w:b/>") + r(" more", "<w:b/>") + r("gone", "<w:strike/>") + r("off", '<w:b w:val="0"/>')) + p("") + p(r("item"), "lb")
        + "<w:tbl><w:tr>" + cell("wide", '<w:gridSpan w:val="2"/>') + cell("c", '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + cell("1") + cell("2") + cell("", "<w:vMerge/>") + "</w:tr></w:tbl>"
        + "<w:p><w:r><w:pict><w:txbxContent>" + p(r("boxed")) + "</w:txbxContent></w:pict></w:r></w:p>"
    )
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="h1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="lb"><w:name w:val="List Bullet"/></w:style></w:styles>'
    return make({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/comments.xml": f"<w:comments {W}><w:comment>{p(r('note'))}</w:comment></w:comments>"})


def pptx():
    run = lambda t, a="": f"<a:r><a:rPr {a}/><a:t>{t}</a:t></a:r>"
    shape = lambda paras, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{paras}</p:txBody></p:sp>"
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p>" + run("k") + "</a:p></a:txBody></a:tc><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    one = shape(f"<a:p>{run('body', 'b=' + chr(34) + '1' + chr(34))}</a:p><a:p><a:pPr lvl='1'/>{run('sub')}</a:p>") + shape(f"<a:p>{run('Title', 'b=' + chr(34) + '1' + chr(34))}</a:p>", '<p:ph type="title"/>') + table
    two = shape(f"<a:p>{run('small', 'sz=' + chr(34) + '1200' + chr(34))}</a:p><a:p>{run('big', 'sz=' + chr(34) + '2400' + chr(34))}</a:p>")
    slide = lambda s: f"<p:sld {AP}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>"
    return make({
        "ppt/presentation.xml": f'<p:presentation {AP} {R}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="/ppt/slides/s2.xml"/>'),
        "ppt/slides/s1.xml": slide(two), "ppt/slides/s2.xml": slide(one),
    })


def xlsx():
    sheet = f'<worksheet {S}><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c><c r="D2"/></row><row r="4" hidden="1"><c r="B4"><v>5</v></c><c r="C4"><v>2.50</v></c><c r="D4" s="1"><v>45292</v></c></row></sheetData><mergeCells><mergeCell ref="B2:B3"/></mergeCells></worksheet>'
    return make({
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="one" r:id="a"/><sheet name="secret" state="hidden" r:id="b"/><sheet name="blank" r:id="c"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format("".join(f'<Relationship Id="{i}" Target="worksheets/{i}.xml"/>' for i in "abc")),
        "xl/worksheets/a.xml": sheet, "xl/worksheets/b.xml": sheet, "xl/worksheets/c.xml": f"<worksheet {S}><sheetData/></worksheet>",
        "xl/sharedStrings.xml": f"<sst {S}><si><r><t>he</t></r><r><t>ad</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })


def test_docx():
    x = ooxml.read_docx(docx())
    assert x["text"].split("\n") == ["# Title", "plain **bold more**~~gone~~off", "- item", "[텍스트박스] boxed", "[메모] note"]
    assert x["tables"] == [[["wide", "wide", "c"], ["1", "2", "c"]]]
    assert "boxed" not in ooxml.read_docx(docx(), textboxes=False)["text"]


def test_pptx():
    x = ooxml.read_pptx(pptx())
    assert x["slides"] == ["## Title\n**body**\n- sub", "## big\nsmall"] and x["tables"] == [[["k", ""]]]


def test_xlsx():
    x = ooxml.read_xlsx(xlsx())
    assert x["text"] == "## one" and x["tables"] == [[["head", "in", ""], ["head", "", ""], ["5", "2.5", "2024-01-01 00:00:00"]]]
    assert ooxml.read_xlsx(xlsx(), include_hidden=False)["tables"] == [[["head"], ["head"]]]
    assert len(ooxml.read_xlsx(xlsx(), skip_hidden_sheets=False)["tables"]) == 2
    with pytest.raises(ValueError):
        ooxml.extract(b"", "pdf")


def test_names(spark):
    names = ["/d/a_before_gt.DOCX", "/d/a_gt.txt", "/d/a_before.docx", "/d/1-1_before.txt", "/d/b_x_after_gt.pptx", "/d/plain.txt", "/d/_gt.xlsx"]
    got = corpus.classified(spark.createDataFrame([(n,) for n in names], "path string")).select("doc_id", "role").collect()
    assert sorted(map(tuple, got)) == [("", "gt"), ("1-1", "before"), ("a", "before_gt"), ("b_x", "after_gt")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "w_gt.docx").write_bytes(docx())
    (d / "w_before.txt").write_text("# Title\nplain **bold more** ~~gone~~off\n\n<table><tr><td>wide</td><td>wide</td><td>c</td></tr><tr><td>1</td><td>2</td><td>c</td></tr></table>", encoding="utf-8")
    (d / "w_after.txt").write_text(ooxml.read_docx(docx())["text"], encoding="utf-8")
    (d / "p_after_gt.pptx").write_bytes(pptx())
    (d / "p_after.txt").write_text("## Title\n**body**\n- sub\n## big\nsmall\n|k| |\n", encoding="utf-8")
    (d / "x_gt.xlsx").write_bytes(xlsx())
    (d / "x_before.txt").write_text("## one\n\n| head | in | null |\n| --- | --- | --- |\n| head | null | null |\n| 5 | 2.5 | 2024-01-01 00:00:00 |\n", encoding="utf-8")
    (d / "lost_before.txt").write_text("no ground truth")
    return str(d)


def test_whole_corpus(spark, folder, tmp_path):
    gt, pred = corpus.scan(spark, folder)
    wide, summary = evaluate.run(gt, pred)
    got = {r["doc_id"]: r for r in wide.collect()}
    assert set(got) == {"w", "p", "x"}
    assert got["w"]["wer_after"] == 0.0 and got["w"]["wer_before"] > 0 and got["w"]["teds_before"] == 1.0 and got["w"]["teds_after"] is None
    assert got["p"]["dual_gt"] and got["p"]["wer_before"] is None and got["p"]["wer_after"] == 0.0 and got["p"]["teds_after"] == 1.0
    assert got["x"]["teds_before"] == 1.0 and got["x"]["wer_before"] == 0.0 and got["x"]["type"] == "xlsx"
    assert [r["metric"] for r in summary.collect()] == ["wer", "teds_content"]
    assert evaluate.sheet_units(gt, pred).collect()[0]["teds"] == 1.0
    assert {r["kind"] for r in evaluate.slide_units(gt, pred).collect()} == {"match"}
    profiles = {(r["doc_id"], r["stage"], r["profile"]): r for r in evaluate.by_profile(gt, pred).collect()}
    assert profiles["w", "after", "content_only"]["wer"] == 0.0 and profiles["w", "after", "spacing_robust"]["skipped"]
    page = {r["doc_id"]: r["html"] for r in report.pages(gt, pred, wide).collect()}
    assert "<td" in page["w"] and page["x"].startswith("<!doctype html>")
    d = evaluate.diagnosis(gt, pred, "w", "before")
    assert d["tokens"].count() > 0 and d["grid"].where("class = 'match'").count() == 6 and d["score"].count() == 1 and d["paragraphs"].count() > 0
    sinks.write_csv(summary, str(tmp_path / "csv"))
    head = "".join(x[0] for x in spark.read.text(str(tmp_path / "csv")).collect())
    assert "metric" in head


def test_stream(spark, folder, tmp_path):
    from lectern.streaming import evaluate as stream

    gt, _ = corpus.scan(spark, folder)
    q = stream.score_stream(gt, stream.outputs(spark, folder), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    wide, _ = stream.current(spark, str(tmp_path / "t"))
    assert {r["doc_id"]: r["wer_after"] for r in wide.collect()}["w"] == 0.0


def test_summary_rules(spark):
    rows = [("a", 0.0, 0.5, None, None), ("b", 0.0, None, None, None)]
    got = evaluate.summary(spark.createDataFrame(rows, "doc_id string, wer_before double, wer_after double, teds_before double, teds_after double")).collect()
    assert len(got) == 1 and got[0]["improvement_pct"] is None and got[0]["absolute_change"] == 0.5


def test_writers(spark, tmp_path, capsys):
    """A mark and a header in each CSV file, nulls as nothing; a page per document; two tables on the console."""
    df = spark.createDataFrame([("a", 0.5, None), ("b,c", None, 'q"x')], "doc_id string, wer double, note string").repartition(2)
    sinks.write_csv(df, str(tmp_path / "csv"))
    files = [f.read_bytes() for f in (tmp_path / "csv").glob("part-*.csv")]
    assert files and all(f.startswith(b"\xef\xbb\xbfdoc_id,wer,note\n") for f in files)
    assert sorted(line for f in files for line in f.decode("utf-8-sig").splitlines()[1:]) == ['"b,c",,"q\\"x"', "a,0.5,"]
    sinks.write_csv(df, str(tmp_path / "plain"), bom=False)
    assert all(f.read_bytes().startswith(b"doc_id,") for f in (tmp_path / "plain").glob("part-*.csv"))
    sinks.write_html(spark.createDataFrame([("d1", "<p>one\ntwo</p>"), ("d2", "<p>x</p>")], "doc_id string, html string"), str(tmp_path / "pages"))
    got = {p.name: "".join(f.read_text() for f in p.glob("part-*")) for p in (tmp_path / "pages").glob("doc_id=*")}
    assert got == {"doc_id=d1": "<p>one\ntwo</p>\n", "doc_id=d2": "<p>x</p>\n"}
    sinks.print_report(df, df.select("doc_id"))
    assert "b,c" in capsys.readouterr().out
