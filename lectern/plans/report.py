"""HTML pages that compare ground truth and both parser outputs, one per document, rendered by executors."""

from __future__ import annotations

import difflib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.markup import clean_matrix, split_output
from ..functions.text import normalize
from ..operators.align import line_pairs, relaxed, three_way
from ..operators.dups import repeated_of
from ..operators.tables import similarity
from .evaluate import _rows

# How white space shows inside a difference, and the texts of labels.
VISIBLE = {" ": "·", "　": "⬚", "\xa0": "␣", "\t": "→", "\n": "↵\n"}
ABSENT, LOST, REPEATED = "(해당 없음)", "(누락됨)", "표 내용 중복"

STYLE = """body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;margin:.6em 0}td,th{border:1px solid #bbb;padding:.3em .5em;vertical-align:top;white-space:pre-wrap}
.sub{background:#fff3a0}.gt .sub,.gone{text-decoration:line-through}.gone{background:#ffc9c9}.new{background:#c9f2c9;text-decoration:underline}.none{color:#999}
.dup{background:#cfe3ff}.dup b{font-size:.7em;margin-left:.5em}.divider td{background:#eee;text-align:center;font-weight:bold}.match{background:#e5f7e5}.partial{background:#fff8cc}.mismatch{background:#ffdcdc}.missing{background:#ffc9c9}.extra{background:#cfe3ff}
.cards span{display:inline-block;border:1px solid #bbb;padding:.5em 1em;margin-right:.5em}"""


def _show(tokens: list[str]) -> str:
    return html.escape("".join("".join(VISIBLE.get(c, c) for c in t) if t.isspace() else t for t in tokens))


#: Class of a piece of the ground truth and of the parser's text, by kind of difference.
MARKS = {"replace": ("sub", "sub"), "delete": ("gone", None), "insert": (None, "new")}


class _Pieces(difflib.SequenceMatcher):
    """The same blocks, found by words: white space, which is every second piece and mostly the same one, is compared only beside equal words."""

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        a, b, places = self.a, self.b, self.b2j
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        best, ends, before = (0, 0, 0), {}, {}
        for i in range(alo + (alo < ahi and a[alo].isspace()), ahi, 2):
            # ends: length of the longest block that ends with this word and the j-th piece; before: the same of the word before
            before, ends = ends, {}
            for j in places.get(a[i], ()):
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = 1
                if i > alo and j > blo and a[i - 1] == b[j - 1]:
                    k = 2 + before.get(j - 2, 0)
                ends[j] = k
                n = k + (i + 1 < ahi and j + 1 < bhi and a[i + 1] == b[j + 1])
                if n >= best[0]:
                    best = max(best, (n, k - i - 1, k - j - 1))
        if best[0] > 1:
            return difflib.Match(-best[1], -best[2], best[0])
        for i in range(alo, ahi):  # no two pieces in common: the first one is as long as any, white space too
            for j in places.get(a[i], ()):
                if blo <= j < bhi:
                    return difflib.Match(i, j, 1)
        return difflib.Match(alo, blo, 0)


def pair_html(gt: str, pred: str) -> tuple[str, str]:
    """Both texts with their differences marked, white space within a difference made visible."""
    if gt == pred:
        return html.escape(gt), html.escape(pred)
    words = [re.findall(r"\S+|\s+", t) for t in (gt, pred)]
    shown: tuple[list[str], list[str]] = ([], [])
    for tag, *ends in _Pieces(None, *words, autojunk=False).get_opcodes():
        for side, mark in enumerate(MARKS.get(tag, (None, None))):
            piece = words[side][ends[2 * side] : ends[2 * side + 1]]
            if piece:
                shown[side].append(f'<span class="{mark}">{_show(piece)}</span>' if mark else html.escape("".join(piece)))
    return "".join(shown[0]), "".join(shown[1])


def _dup(shown: str, line: str | None, repeated: set[str]) -> str:
    if line is None or normalize(line).strip() not in repeated:
        return shown
    inner = re.sub(r'<span class="new">(.*?)</span>', r"\1", shown, flags=re.S)
    return f'<span class="dup">{inner}<b>{REPEATED}</b></span>'


def _divider(gt: str | None, columns: int) -> str:
    if gt is None or not gt.lstrip().startswith("## "):
        return ""
    return f'<tr class="divider"><td colspan="{columns}">{html.escape(gt.lstrip()[3:].strip())}</td></tr>'


def _table(head: list[str], rows: list[str]) -> str:
    return "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" + "".join(rows) + "</table>"


def three_way_html(gt: list[str], before: list[str], after: list[str], repeated: dict[str, set[str]]) -> str:
    rows = []
    for r in three_way(gt, before, after):
        cells, own = {}, r["gt"]
        shown = f'<span class="none">{ABSENT}</span>' if own is None else html.escape(own)
        for side in ("after", "before"):  # the ground truth shows its differences from before, if there is one
            line = r[side]
            if own is None:
                cells[side] = f'<span class="new">{html.escape(line)}</span>' if line else f'<span class="none">{ABSENT}</span>'
            elif line is None:
                cells[side] = f'<span class="gone">{LOST}</span>'
            else:
                shown, cells[side] = pair_html(own, line)
            cells[side] = _dup(cells[side], line, repeated[side])
        rows.append(_divider(own, 3) + f'<tr><td class="gt">{shown}</td><td>{cells["before"]}</td><td>{cells["after"]}</td></tr>')
    return _table(["GT", "Before", "After"], rows)


def two_way_html(gt: list[str], pred: list[str], repeated: set[str], label: str) -> str:
    rows = []
    for g, p, _ in line_pairs(gt, pred):
        own, line = gt[g] if g is not None else None, pred[p] if p is not None else None
        if own is None:
            a, b = f'<span class="none">{ABSENT}</span>', f'<span class="new">{html.escape(line)}</span>'
        elif line is None:
            a, b = html.escape(own), f'<span class="gone">{LOST}</span>'
        else:
            a, b = pair_html(own, line)
        rows.append(_divider(own, 2) + f'<tr><td class="gt">{a}</td><td>{_dup(b, line, repeated)}</td></tr>')
    return _table([f"GT ({label})", label], rows)


def matrix_html(m: list[list[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in m) + "</table>" if m else f'<p class="none">{ABSENT}</p>'


def grid_html(gt: list[list[str]], pred: list[list[str]]) -> str:
    """Cells at equal positions, coloured by how much they agree."""
    rows = []
    for r in range(max(len(gt), len(pred))):
        a, b, cells = gt[r] if r < len(gt) else [], pred[r] if r < len(pred) else [], []
        for c in range(max(len(a), len(b))):
            if c >= len(a):
                cells.append(f'<td class="extra">{html.escape(b[c])}</td>')
            elif c >= len(b):
                cells.append(f'<td class="missing">{html.escape(a[c])}</td>')
            else:
                s = similarity(a[c], b[c])
                kind = "match" if s >= 0.999 else "partial" if s >= 0.6 else "mismatch"
                cells.append(f'<td class="{kind}" title="{s:.2f}">{html.escape(a[c])}<br>{html.escape(b[c])}</td>')
        rows.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "".join(rows) + "</table>" if rows else f'<p class="none">{ABSENT}</p>'


def page(doc_id: str, kind: str, sides: dict[str, dict], scores: dict[str, float | None]) -> str:
    """``sides[stage]``: gt, gt_tables, pred, tables, sheets, repeated; a stage that is missing is left out."""
    out = [f"<h1>{html.escape(doc_id)}</h1>", '<p class="cards">' + "".join(f"<span>{k}: {'-' if v is None else f'{v:.4f}'}</span>" for k, v in scores.items()) + "</p>"]
    first = sides.get("before") or sides.get("after") or {}
    if kind == "xlsx":
        out.append("<h2>GT</h2>" + matrix_html(clean_matrix([r for t in (sides.get("after") or first).get("gt_tables", []) for r in t])))
        out += [f"<h2>{s}</h2>" + matrix_html(clean_matrix([r for t in x["sheets"] for r in t])) for s, x in sides.items()]
        return _whole(doc_id, out)
    texts, logs, repeated = {}, {}, {}
    for s in ("before", "after"):
        x = sides.get(s)
        texts[s], logs[s], repeated[s] = "", [], set()
        if x:
            texts[s], logs[s] = relaxed(x["pred"], x["gt"]) if kind == "docx" else (x["pred"], [])
            repeated[s] = {normalize(t).strip() for t in x["repeated"]}
    lines = {s: [t for t in texts[s].split("\n") if t.strip()] for s in texts}
    gts = {s: [t for t in x["gt"].split("\n") if t.strip()] for s, x in sides.items()}
    if len({x["gt"] for x in sides.values()}) > 1:
        out += [f"<h2>{s}</h2>" + two_way_html(gts[s], lines[s], repeated[s], s) for s in sides]
    else:
        out.append("<h2>Text</h2>" + three_way_html(next(iter(gts.values()), []), lines["before"], lines["after"], repeated))
    tables = (sides.get("after") or first).get("gt_tables", [])
    most = max([len(tables), *(len(x["tables"]) for x in sides.values())], default=0)
    for i in range(most):
        g = tables[i] if i < len(tables) else []
        out.append(f"<h2>Table {i + 1}</h2>" + matrix_html(g))
        out += [f"<h3>{s}</h3>" + grid_html(g, x["tables"][i] if i < len(x["tables"]) else []) for s, x in sides.items()]
    for s in sides:
        if repeated[s]:
            out.append(f"<h2>{REPEATED}: {s}</h2><ul>" + "".join(f"<li>{html.escape(t)}</li>" for t in sorted(repeated[s])) + "</ul>")
        if logs[s]:
            out.append(f"<h2>Line breaks: {s}</h2><ul>" + "".join(f"<li>{x['kind']}: {html.escape(' / '.join(x['from']))} → {html.escape(' / '.join(x['to']))}</li>" for x in logs[s]) + "</ul>")
    return _whole(doc_id, out)


def _whole(title: str, parts: list[str]) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body>{"".join(parts)}</body></html>'


def pages(gt: DataFrame, pred: DataFrame, wide: DataFrame) -> DataFrame:
    """``doc_id, html`` of every document of ``wide`` (see :func:`.evaluate.per_document`)."""
    small_batches(gt.sparkSession)
    both = gt.where("text is not null").join(pred.where("raw is not null"), ["doc_id", "stage"])
    side = F.struct("stage", F.col("text").alias("gt"), F.col("tables").alias("gt_tables"), "raw")
    docs = both.groupBy("doc_id", "type").agg(F.sort_array(F.collect_list(side)).alias("sides"))  # two stages at most
    docs = docs.join(wide.select("doc_id", F.struct(*[c for c in wide.columns if re.match("(wer|teds)_", c)]).alias("s")), "doc_id")

    def side_of(kind: str, e: dict) -> dict:
        pred, found, sheets = split_output(e["raw"])
        repeated = [line for _, line in repeated_of(pred, found)] if kind != "xlsx" else []
        return {"gt": e["gt"] or "", "pred": pred, "gt_tables": _rows(e["gt_tables"]), "tables": found, "sheets": sheets, "repeated": repeated}

    @F.arrow_udf("string")
    def run(doc: pa.Array, kind: pa.Array, sides: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for d, k, x, values in zip(doc.to_pylist(), kind.to_pylist(), sides.to_pylist(), s.to_pylist(), strict=True):
            by = {e["stage"]: side_of(k, e) for e in x}
            out.append(page(d, k, {n: by[n] for n in ("before", "after") if n in by}, {c: v if v == v else None for c, v in values.items()}))
        return pa.array(out, pa.string())

    return docs.select("doc_id", run("doc_id", "type", "sides", "s").alias("html"))
