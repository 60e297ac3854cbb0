"""Small office files from text and tables, for round trips through the readers: the inverse of :mod:`.ooxml` for the marks it gives."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ooxml import COMMENT, TEXTBOX

_NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
}
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_MARKS = re.compile(r"\*\*(?P<bold>.+?)\*\*|~~(?P<strike>.+?)~~|(?P<plain>(?:(?!\*\*|~~).)+)", re.S)


def _ns(*names: str) -> str:
    return " ".join(f'xmlns:{n}="{_NS[n]}"' for n in names)


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)  # without the time of day
    return out.getvalue()


def _runs(line: str) -> list[tuple[str, str]]:
    """(style, text) of a line with bold and strike marks."""
    return [(m.lastgroup, m[m.lastgroup]) for m in _MARKS.finditer(line)]


def docx(text: str, tables: list) -> bytes:
    """A Word file: lines with heading and list marks, bold and struck runs, text boxes, comments, and then the tables."""
    props = {"bold": "<w:b/>", "strike": "<w:strike/>", "plain": ""}
    run = lambda style, t: f'<w:r><w:rPr>{props[style]}</w:rPr><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    para = lambda inner, style="": "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + inner + "</w:p>"
    body, boxes, notes = [], [], []
    for line in text.split("\n") if text else []:
        if m := re.match(r"(#{1,6}) (.*)", line):
            body.append(para(run("plain", m[2]), f"h{len(m[1])}"))
        elif line.startswith("- "):
            body.append(para("".join(run(*r) for r in _runs(line[2:])), "li"))
        elif line.startswith(TEXTBOX):
            boxes.append(f"<w:p><w:r><w:pict><w:txbxContent>{para(run('plain', line.removeprefix(TEXTBOX)))}</w:txbxContent></w:pict></w:r></w:p>")
        elif line.startswith(COMMENT):
            notes.append(f"<w:comment>{para(run('plain', line.removeprefix(COMMENT)))}</w:comment>")
        else:
            body.append(para("".join(run(*r) for r in _runs(line))))
    for t in tables:
        body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(run('plain', c))}</w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="h{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    styles += '<w:style w:type="paragraph" w:styleId="li"><w:name w:val="List Bullet"/></w:style>'
    return _zip({
        "word/document.xml": f"<w:document {_ns('w')}><w:body>{''.join(body + boxes)}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {_ns('w')}>{styles}</w:styles>", "word/comments.xml": f"<w:comments {_ns('w')}>{''.join(notes)}</w:comments>",
    })


def pptx(slides: list[str], tables: list) -> bytes:
    """A deck: a slide's first line with a heading mark is its title, lines with a list mark are one level down; tables go to the last slide."""
    props = {"bold": ' b="1"', "strike": ' strike="sngStrike"', "plain": ""}
    line = lambda t, level="": f"<a:p>{level}" + "".join(f"<a:r><a:rPr{props[s]}/><a:t>{escape(x)}</a:t></a:r>" for s, x in _runs(t)) + "</a:p>"
    shape = lambda paras, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{paras}</p:txBody></p:sp>"
    grid = lambda t: "<p:graphicFrame><a:graphic><a:graphicData><a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{line(c)}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in t) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    files, refs, links = {}, [], []
    for i, s in enumerate(slides):
        lines = s.split("\n")
        title = lines.pop(0)[3:] if lines[0].startswith("## ") else None
        shapes = shape(line(title), '<p:ph type="title"/>') if title is not None else ""
        shapes += shape("".join(line(t[2:], '<a:pPr lvl="1"/>') if t.startswith("- ") else line(t) for t in lines))
        shapes += "".join(map(grid, tables)) if i == len(slides) - 1 else ""
        files[f"ppt/slides/slide{i + 1}.xml"] = f"<p:sld {_ns('a', 'p')}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        refs.append(f'<p:sldId r:id="s{i + 1}"/>')
        links.append(f'<Relationship Id="s{i + 1}" Target="slides/slide{i + 1}.xml"/>')
    return _zip(files | {
        "ppt/presentation.xml": f"<p:presentation {_ns('p', 'r')}><p:sldIdLst>{''.join(refs)}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _LINKS.format("".join(links)),
    })


def xlsx(text: str, tables: list) -> bytes:
    """A workbook: a sheet per table, named by the lines of ``text`` with a heading mark."""
    names = [t[3:] for t in text.split("\n") if t.startswith("## ")]
    ref = lambda r, c: (chr(65 + c) if c < 26 else chr(64 + c // 26) + chr(65 + c % 26)) + str(r + 1)
    files, sheets, links = {}, [], []
    for i, (name, t) in enumerate(zip(names, tables, strict=True)):
        rows = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{ref(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(t))
        files[f"xl/worksheets/sheet{i + 1}.xml"] = f'<worksheet xmlns="{_SHEET}"><sheetData>{rows}</sheetData></worksheet>'
        sheets.append(f'<sheet name="{escape(name)}" sheetId="{i + 1}" r:id="s{i + 1}"/>')
        links.append(f'<Relationship Id="s{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>')
    return _zip(files | {
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" {_ns("r")}><sheets>{"".join(sheets)}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _LINKS.format("".join(links)),
    })


def file(kind: str, text: str, slides: list[str] | None, tables: list) -> bytes:
    return pptx(slides or [], tables) if kind == "pptx" else {"docx": docx, "xlsx": xlsx}[kind](text, tables)


def rendered(kind: Column, text: Column, slides: Column, tables: Column) -> Column:
    """:func:`file` as a column."""
    @F.pandas_udf("binary")
    def run(k: pd.Series, t: pd.Series, s: pd.Series, m: pd.Series) -> pd.Series:
        plain = lambda x: [[[c or "" for c in r] for r in y] for y in (x if x is not None else [])]
        return pd.Series([file(a, b or "", None if c is None else list(c), plain(d)) for a, b, c, d in zip(k, t, s, m, strict=True)])

    return run(kind, text, slides, tables)
