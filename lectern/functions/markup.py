"""Markup: run markup, tables in HTML and pipes, sections. Native columns, and Python for broken HTML."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip

# What an HTML table, a separator row of a pipe table and a section's first line look like.
HTML_TABLE = r"<S*table[^>]*>.*?<S*/S*tableS*>"
SEPARATOR_ROW = r"^S*\|?S*:?-{2,}:?S*(\|S*:?-{2,}:?S*)*\|?S*$"
SECTION = r"^S*##S"
# Cells that count as blank.
BLANK_CELLS = ("", "null", "none", "nan", "n/a")
UNNAMED = r"^unnamed:?S*[0-9]*$"

MATRIX = "array<array<string>>"


def _java(pattern: str) -> str:
    return pattern.replace("S", f"[{WS}]")


_PY = {k: re.compile(v.replace("S", r"\s"), f) for k, v, f in (("table", HTML_TABLE, re.S | re.I), ("sep", SEPARATOR_ROW, 0), ("section", SECTION, 0), ("unnamed", UNNAMED.replace("[0-9]", r"\d"), re.I))}


def wrap_run(text: Column, bold: Column, strike: Column) -> Column:
    """Strike marks inside bold marks; an empty run has none."""
    inner = F.when(F.coalesce(strike, F.lit(False)), F.concat(F.lit("~~"), text, F.lit("~~"))).otherwise(text)
    return F.when(text == "", F.lit("")).when(F.coalesce(bold, F.lit(False)), F.concat(F.lit("**"), inner, F.lit("**"))).otherwise(inner)


def coalesced_runs(runs: Column) -> Column:
    """``array<struct<text,bold,strike>>`` of a paragraph, as text: neighbours with one style share their marks."""
    kind = "array<struct<text:string,bold:boolean,strike:boolean>>"
    full = F.filter(runs, lambda r: F.coalesce(r["text"], F.lit("")) != "")
    norm = F.transform(full, lambda r: F.struct(r["text"].alias("text"), F.coalesce(r["bold"], F.lit(False)).alias("bold"), F.coalesce(r["strike"], F.lit(False)).alias("strike")))

    def add(done, r):
        n = F.size(done)
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, n - 1), F.array(F.struct(F.concat(last["text"], r["text"]).alias("text"), r["bold"].alias("bold"), r["strike"].alias("strike"))))
        same = F.when(n > 0, (last["bold"] == r["bold"]) & (last["strike"] == r["strike"])).otherwise(False)
        return F.when(same, joined).otherwise(F.concat(done, F.array(r)))

    merged = F.aggregate(norm, F.expr(f"cast(array() as {kind})"), add)
    return F.array_join(F.transform(merged, lambda r: wrap_run(r["text"], r["bold"], r["strike"])), "")


def normalized_cell(cell: Column) -> Column:
    t = strip(F.coalesce(cell, F.lit("")))
    return F.when(F.lower(t).isin(*BLANK_CELLS) | t.rlike("(?i)" + _java(UNNAMED)), F.lit("")).otherwise(t)


def html_tables(raw: Column) -> Column:
    """All ``<table>...</table>`` segments, shortest first match."""
    return F.regexp_extract_all(raw, F.lit("(?is)" + _java(HTML_TABLE)), F.lit(0))


def without_html_tables(raw: Column) -> Column:
    return F.regexp_replace(raw, "(?is)" + _java(HTML_TABLE), "\n")


def is_pipe_row(line: Column) -> Column:
    t = strip(line)
    return t.startswith("|") & (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 2)


def pipe_cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), strip)


def _between(breaks: Column, n: Column, f) -> Column:
    """``f(first, length)`` of each run of elements between neighbours of ``breaks``, a rising array of positions to leave out."""
    def runs(edges):
        m = F.size(edges)
        return F.zip_with(F.slice(edges, F.lit(1), m - 1), F.slice(edges, F.lit(2), m - 1), f)

    # one-element arrays stand for a let: each value is computed once
    return F.element_at(F.transform(F.array(F.concat(F.array(F.lit(-1)), breaks, F.array(n))), runs), 1)


def pipe_tables(text: Column) -> Column:
    """Matrices of pipe tables, in order, in linear time: tables are what lies between lines that are no row."""
    rows = F.transform(F.split(text, "\n", -1), lambda t: F.struct(is_pipe_row(t).alias("row"), t.rlike(_java(SEPARATOR_ROW)).alias("sep"), t.alias("line")))

    def tables(x):
        other = F.filter(F.transform(x, lambda r, i: F.when(~r["row"], i)), lambda i: i.isNotNull())

        def table(a, b):
            own = F.filter(F.slice(x, a + 2, b - a - 1), lambda r: ~r["sep"])
            return F.transform(own, lambda r: pipe_cells(r["line"]))

        return F.filter(_between(other, F.size(x), table), lambda t: F.size(t) > 0)

    return F.element_at(F.transform(F.array(rows), tables), 1)


def without_pipe_rows(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda t: ~is_pipe_row(t)), "\n")


def body_text(raw: Column) -> Column:
    """A parser's output without its tables; runs of line feeds are one, ends are stripped."""
    return strip(F.regexp_replace(without_pipe_rows(without_html_tables(raw)), "\n{2,}", "\n"))


def html_matrix(html: Column) -> Column:
    """Rows of the first table of a segment. Broken markup needs a parser: an Arrow UDF."""
    @F.pandas_udf(MATRIX)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else matrix_of_html(t))

    return run(html)


def trimmed(matrix: Column) -> Column:
    """Without blank rows and columns, inner ones too; ragged rows are filled with blanks.

    One-element arrays carry the kept rows and columns from step to step, so that each is computed once.
    """
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    blank = F.lit("")

    def width(rows):
        return F.struct(rows.alias("rows"), F.array_max(F.transform(rows, lambda r: F.size(r))).alias("width"))

    def columns(s):
        keep = F.filter(F.sequence(F.lit(0), F.greatest(s["width"], F.lit(1)) - 1), lambda i: F.exists(s["rows"], lambda r: cell(r, i) != blank))
        return F.struct(s["rows"].alias("rows"), keep.alias("keep"))

    state = F.array(F.filter(matrix, lambda r: F.exists(r, lambda c: c != blank)))
    for step in (width, columns, lambda s: F.transform(s["rows"], lambda r: F.transform(s["keep"], lambda i: cell(r, i)))):
        state = F.transform(state, step)
    return F.element_at(state, 1)


def cleaned(matrix: Column) -> Column:
    """Blank tokens unified, then :func:`trimmed`."""
    return trimmed(F.transform(matrix, lambda r: F.transform(r, normalized_cell)))


def merged(matrices: Column) -> Column:
    """All tables below each other, cleaned."""
    return cleaned(F.flatten(matrices))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def matrix_html(matrix: Column) -> Column:
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(matrix, row), ""), F.lit("</table>"))


def sections(text: Column) -> Column:
    """Slices that start at a second-level heading, in linear time; blank ones go."""
    def cut(lines):
        opens = F.filter(F.transform(lines, lambda t, i: F.when((i == 0) | t.rlike("(?d)" + _java(SECTION)), i)), lambda i: i.isNotNull())
        edges = F.concat(opens, F.array(F.size(lines)))

        def slices(e):
            m = F.size(e)
            return F.zip_with(F.slice(e, F.lit(1), m - 1), F.slice(e, F.lit(2), m - 1), lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), "\n"))

        return F.element_at(F.transform(F.array(edges), slices), 1)

    return F.filter(F.element_at(F.transform(F.array(F.split(text, "\n", -1)), cut), 1), lambda s: strip(s) != "")


# Python forms, for the scoring kernels


def cell_text(text: str | None) -> str:
    t = (text or "").strip()
    # most cells are neither as short as a blank token nor begin like an unnamed column
    return "" if (len(t) <= _LONGEST_BLANK and t.lower() in BLANK_CELLS) or (t[:1] in ("u", "U") and _PY["unnamed"].match(t)) else t


_LONGEST_BLANK = max(map(len, BLANK_CELLS))


class _Rows(HTMLParser):
    """Cells of the first table: rows nearest to it, their direct cells, all text below those.

    A cell that is not closed stays open: rows and cells that follow are inside of it, and their text is its text too.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None]] = []  # open tags, and the text of a tag that is a cell
        self.texts: list[list[list[str]]] = []
        self.depth_of_first: int | None = None
        self.over = False

    def handle_starttag(self, tag, attrs):
        cell = None
        if tag == "table" and self.depth_of_first is None:
            self.depth_of_first = len(self.stack)
        elif self.depth_of_first is not None and not self.over:
            nested = any(t == "table" for t, _ in self.stack[self.depth_of_first + 1 :])
            if tag == "tr" and not nested:
                self.texts.append([])
            elif tag in ("td", "th") and self.stack[-1][0] == "tr" and not nested and self.texts:
                cell = []
                self.texts[-1].append(cell)
        if tag not in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"):
            self.stack.append((tag, cell))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                if self.depth_of_first is not None and len(self.stack) <= self.depth_of_first:
                    self.over = True
                return

    def handle_data(self, data):
        if not self.over:
            for _, cell in self.stack:
                if cell is not None:
                    cell.append(data)


#: A table of bare tags, each closed in its place.
_BARE = re.compile(r"<table>\s*(?:<tr>\s*(?:(?:<td>[^<]*</td>|<th>[^<]*</th>)\s*)*</tr>\s*)*</table>")


def matrix_of_html(html: str) -> list[list[str]]:
    if _BARE.fullmatch(html):  # needs no parser
        return [[cell_text(unescape(c)) for c in re.findall(r"<t[dh]>([^<]*)", row)] for row in html.split("<tr>")[1:]]
    p = _Rows()
    p.feed(html)
    p.close()
    return [[cell_text("".join(c)) for c in row] for row in p.texts]


def pipe_matrices_of(text: str) -> tuple[str, list[list[list[str]]]]:
    """The lines that are no row, joined, and a matrix for each run of rows that has more than separators."""
    def is_row(line: str) -> bool:
        return (t := line.strip()).startswith("|") and t.count("|") >= 2

    def cells(line: str) -> list[str]:
        return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]

    runs = [(row, list(lines)) for row, lines in groupby(text.split("\n"), key=is_row)]
    matrices = [[cells(t) for t in lines if not _PY["sep"].match(t)] for row, lines in runs if row]
    return "\n".join(t for row, lines in runs if not row for t in lines), [m for m in matrices if m]


def split_output(raw: str) -> tuple[str, list[list[list[str]]], list[list[list[str]]]]:
    """(text, tables for pairing, tables for sheets): HTML before pipes; the latter leave out tables without rows."""
    raw = raw.replace("\r\n", "\n").replace("\r", "\n")
    html = [matrix_of_html(t) for t in (m.group(0) for m in _PY["table"].finditer(raw))]
    text, pipes = pipe_matrices_of(_PY["table"].sub("\n", raw))
    shown = [[[cell_text(c) for c in r] for r in t] for t in pipes]
    return re.sub(r"\n{2,}", "\n", text).strip(), html + shown, [t for t in html if t] + pipes


def clean_matrix(rows: list[list[str]]) -> list[list[str]]:
    rows = [r for r in ([cell_text(c) for c in r] for r in rows) if any(r)]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) if len(r) < width else r for r in rows]
    keep = [i for i in range(width) if any(r[i] for r in rows)]
    return rows if len(keep) == width else [[r[i] for i in keep] for r in rows]


def sections_of(text: str) -> list[str]:
    out: list[list[str]] = []
    for line in text.split("\n"):
        if not out or _PY["section"].match(line):
            out.append([line])
        else:
            out[-1].append(line)
    return [s for s in map("\n".join, out) if s.strip()]
