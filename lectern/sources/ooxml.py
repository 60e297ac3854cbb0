"""Word, PowerPoint and Excel files as text, slides and table matrices, with the standard library only."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

# Namespaces, style names, labels of text boxes and comments.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADING = re.compile(r"(?:Heading|제목)\s*(\d+)", re.I)
LIST = re.compile(r"List|Bullet|Number|목록|글머리", re.I)
TEXTBOX, COMMENT = "[텍스트박스] ", "[메모] "
OFF = ("0", "false", "off", "none", "noStrike")

EXTRACTED = "struct<text:string,slides:array<string>,tables:array<array<array<string>>>>"


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _links(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    base = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {} if root is None else {r.get("Id"): base(r.get("Target")) for r in root}


def marked(runs: list[tuple[str, bool, bool]]) -> str:
    """Runs of (text, bold, strike) as text; neighbours of one style share their marks."""
    groups: list[list] = []
    for text, bold, strike in runs:
        if text and groups and groups[-1][1:] == [bold, strike]:
            groups[-1][0] += text
        elif text:
            groups.append([text, bold, strike])
    out = ""
    for text, bold, strike in groups:
        text = f"~~{text}~~" if strike else text
        out += f"**{text}**" if bold else text
    return out


# Word


def _w_text(run) -> str:
    out = ""
    for e in run:
        if e.tag == W + "t":
            out += e.text or ""
        elif e.tag == W + "tab":
            out += "\t"
        elif e.tag in (W + "br", W + "cr"):
            out += "\n" if e.get(W + "type") in (None, "textWrapping") else ""
        elif e.tag == W + "noBreakHyphen":
            out += "-"
    return out


def _w_on(run, name: str) -> bool:
    e = run.find(f"{W}rPr/{W}{name}")
    return e is not None and e.get(W + "val", "1") not in OFF


def _w_paragraph(p) -> str:
    """All text of a paragraph, hyperlinks included."""
    return "".join(_w_text(r) for e in p for r in ([e] if e.tag == W + "r" else e.findall(W + "r") if e.tag == W + "hyperlink" else []))


def _w_rows(table) -> list[list[str]]:
    rows, above = [], {}
    for tr in table.findall(W + "tr"):
        row, col = [], 0
        skip = tr.find(f"{W}trPr/{W}gridBefore")
        col += int(skip.get(W + "val", "0")) if skip is not None else 0
        for tc in tr.findall(W + "tc"):
            props = tc.find(W + "tcPr")
            get = lambda n: props.find(W + n) if props is not None else None  # noqa: B023, E731
            span = int(get("gridSpan").get(W + "val", "1")) if get("gridSpan") is not None else 1
            merge = get("vMerge")
            text = "\n".join(_w_paragraph(p) for p in tc.findall(W + "p")).strip()
            if merge is not None and merge.get(W + "val", "continue") == "continue" and col in above:
                text = above[col]
            for k in range(span):
                above[col + k] = text
            row += [text] * span  # a merged cell repeats in every position that it spans
            col += span
        rows.append(row)
    return rows


def read_docx(data: bytes, textboxes: bool = True, comments: bool = True) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(W + "body")
        styles = _xml(z, "word/styles.xml")
        notes = _xml(z, "word/comments.xml") if comments else None
    names, default = {}, ""
    for s in styles if styles is not None else ():
        name = s.find(W + "name")
        if s.tag == W + "style" and name is not None:
            names[s.get(W + "styleId")] = name.get(W + "val", "")
            if s.get(W + "type") == "paragraph" and s.get(W + "default") == "1":
                default = name.get(W + "val", "")
    lines, tables = [], []
    for e in body:
        if e.tag == W + "tbl":
            tables.append(_w_rows(e))
        elif e.tag == W + "p" and (plain := _w_paragraph(e)).strip():
            style = e.find(f"{W}pPr/{W}pStyle")
            style = names.get(style.get(W + "val"), default) if style is not None else default
            if m := HEADING.match(style):
                lines.append("#" * min(int(m[1]), 6) + " " + plain.strip())
                continue
            text = marked([(_w_text(r), _w_on(r, "b"), _w_on(r, "strike")) for r in e.findall(W + "r")]).strip()
            lines.append(f"- {text}" if LIST.search(style) else text)
    if textboxes:
        for box in body.iter():
            if box.tag.endswith("}txbxContent") and (t := "".join(x.text for x in box.iter() if x.tag.endswith("}t") and x.text).strip()):
                lines.append(TEXTBOX + t)
    for c in notes if notes is not None else ():
        if t := "\n".join(_w_paragraph(p) for p in c.findall(W + "p")).strip():
            lines.append(COMMENT + t)
    return {"text": "\n".join(lines), "slides": None, "tables": tables}


# PowerPoint


def _size(props) -> float | None:
    return int(props.get("sz")) / 100 if props is not None and props.get("sz") else None


def _a_text(p) -> str:
    return "".join(e.findtext(A + "t") or "" if e.tag in (A + "r", A + "fld") else "\v" if e.tag == A + "br" else "" for e in p)


def read_pptx(data: bytes) -> dict:
    slides, tables = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck, links = _xml(z, "ppt/presentation.xml"), _links(z, "ppt/presentation.xml")
        for ref in deck.iterfind(f"{P}sldIdLst/{P}sldId"):
            shapes = _xml(z, links[ref.get(R + "id")]).find(f"{P}cSld/{P}spTree")
            lines, has_title = [], False  # (is in the title, size, plain, marked, level)
            for shape in shapes:
                table = shape.find(f"{A}graphic/{A}graphicData/{A}tbl")
                if table is not None:
                    tables.append([["\n".join(_a_text(p).replace("\v", "\n") for p in c.iterfind(f"{A}txBody/{A}p")).strip() for c in tr.findall(A + "tc")] for tr in table.findall(A + "tr")])
                    continue
                kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                title = shape.tag == P + "sp" and kind is not None and (kind.get("type") in ("title", "ctrTitle") or kind.get("type") is None and kind.get("idx") == "0") and not has_title
                has_title |= title
                for p in shape.iterfind(f"{P}txBody/{A}p") if shape.tag == P + "sp" else ():
                    runs = [(r.findtext(A + "t") or "", r.find(A + "rPr")) for r in p.findall(A + "r")]
                    plain = "".join(t for t, _ in runs)
                    if not plain.strip():
                        continue
                    props = p.find(A + "pPr")
                    sizes = [x for _, q in runs if (x := _size(q)) is not None]
                    size = max(sizes) if sizes else _size(props.find(A + "defRPr") if props is not None else None)
                    on = lambda q, n: q is not None and q.get(n, "0") not in OFF
                    level = int(props.get("lvl", "0")) if props is not None else 0
                    lines.append((title, size, plain.strip(), marked([(t, on(q, "b"), on(q, "strike")) for t, q in runs]).strip(), level))
            known = [x[1] for x in lines if x[1] is not None]
            big = lambda x: x[1] is not None and abs(x[1] - max(known)) < 0.01 if known else x[0]  # noqa: B023, E731
            titles = [f"## {x[2]}" for x in lines if big(x)]
            slides.append("\n".join(titles + [f"- {x[3]}" if x[4] > 0 else x[3] for x in lines if not big(x)]))
    return {"text": "\n".join(s for s in slides if s.strip()), "slides": slides, "tables": tables}


# Excel


def _spot(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0], flags=re.I)
    return bool(re.search("[dmhysDMHYS]", bare)) and bare.lower() != "general"


def _moment(x: float, code: str, epoch: dt.datetime) -> str:
    whole = epoch + dt.timedelta(days=x + (epoch.year == 1899 and 0 < x < 60))
    whole = (whole + dt.timedelta(microseconds=500)).replace(microsecond=0)
    return str(whole.time()) if 0 <= x < 1 else str(whole)


def read_xlsx(data: bytes, include_hidden: bool = True, skip_hidden_sheets: bool = True) -> dict:
    from ..functions.markup import cell_text

    names, tables = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, links = _xml(z, "xl/workbook.xml"), _links(z, "xl/workbook.xml")
        shared, styles = _xml(z, "xl/sharedStrings.xml"), _xml(z, "xl/styles.xml")
        words = ["".join(t.text or "" for e in si if e.tag in (S + "t", S + "r") for t in ([e] if e.tag == S + "t" else e.findall(S + "t"))) for si in (shared if shared is not None else ())]
        props = book.find(S + "workbookPr")
        epoch = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        # Number formats 14 to 22 and 45 to 47 are dates and times.
        dated = {str(i) for i in (*range(14, 23), *range(45, 48))}
        formats = []
        if styles is not None:
            dated |= {f.get("numFmtId") for f in styles.iterfind(f"{S}numFmts/{S}numFmt") if _is_date(f.get("formatCode", ""))}
            formats = [x.get("numFmtId", "0") in dated for x in styles.iterfind(f"{S}cellXfs/{S}xf")]
        for sheet in book.iterfind(f"{S}sheets/{S}sheet"):
            if skip_hidden_sheets and sheet.get("state", "visible") != "visible":
                continue
            root = _xml(z, links[sheet.get(R + "id")])
            if root is None or root.tag != S + "worksheet":
                continue
            grid: dict[tuple[int, int], str] = {}
            hidden_rows, hidden_cols, last_row = set(), set(), 0
            for row in root.iterfind(f"{S}sheetData/{S}row"):
                last_row = int(row.get("r", last_row + 1))
                if row.get("hidden") in ("1", "true"):
                    hidden_rows.add(last_row)
                col = 0
                for c in row.findall(S + "c"):
                    r, col = _spot(c.get("r")) if c.get("r") else (last_row, col + 1)
                    v, kind = c.findtext(S + "v"), c.get("t", "n")
                    if kind == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter(S + "t"))
                    elif v is None:
                        continue
                    elif kind == "s":
                        v = words[int(v)]
                    elif kind == "b":
                        v = str(v == "1")
                    elif kind == "n":
                        style = int(c.get("s", "0"))
                        if style < len(formats) and formats[style]:
                            v = _moment(float(v), "", epoch)
                        else:
                            v = str(float(v)) if re.search("[.eE]", v) else str(int(v))
                    grid[r, col] = v.strip()
            for m in root.iterfind(f"{S}mergeCells/{S}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                (r1, c1), (r2, c2) = _spot(a), _spot(b or a)
                grid.update({(r, c): grid.get((r1, c1), "") for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)})
            for c in root.iterfind(f"{S}cols/{S}col"):
                if c.get("hidden") in ("1", "true"):
                    hidden_cols |= set(range(int(c.get("min")), int(c.get("max")) + 1))
            if not include_hidden:
                grid = {k: v for k, v in grid.items() if k[0] not in hidden_rows and k[1] not in hidden_cols}
            rows, cols = (sorted({k[i] for k, v in grid.items() if v != ""}) for i in (0, 1))
            if rows:
                names.append("## " + sheet.get("name"))
                tables.append([[cell_text(grid.get((r, c), "")) for c in cols] for r in rows])
    return {"text": "\n\n".join(names), "slides": None, "tables": tables}


READERS = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx}


def extract(content: bytes, ext: str) -> dict:
    """Text, slides and tables of a file by its extension."""
    from ..functions.markup import cell_text

    if ext.lower() not in READERS:
        raise ValueError(f"unsupported ground truth format: {ext} (supported: {', '.join(READERS)})")
    out = READERS[ext.lower()](content)
    return out | {"tables": [[[cell_text(c) for c in r] for r in t] for t in out["tables"]]}
