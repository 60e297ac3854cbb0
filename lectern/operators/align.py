"""Edit distances and alignments of token and line sequences.

The edit matrix is computed row by row, a row's differences as bits of whole numbers. Where the split into
substitutions, deletions and insertions or the alignment itself is asked for, every ``KEEP``-th row is kept and the rows
between are computed again on the way back, so memory grows with a row and the KEEP-th part of the product in bits. Ties go
to a match, then a substitution, then an insertion, then a deletion.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import nested
from ..functions.text import Options, normalize, tokenizer

KEEP = 256
WER = "struct<wer:double,S:int,D:int,I:int,N:int,tokenizer:string>"
_WER = pa.struct([("wer", pa.float64()), *((k, pa.int32()) for k in "SDIN"), ("tokenizer", pa.string())])
OPS = ("match", "sub", "ins", "del")


def _trim(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Without the common start and end, which match in every best alignment."""
    n, start, end = min(len(a), len(b)), 0, 0
    while start < n and a[start : start + 64] == b[start : start + 64]:
        start += 64
    start = min(start, n)
    while start < n and a[start] == b[start]:
        start += 1
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start : len(a) - end], b[start : len(b) - end]


def _places(b: list[str]) -> dict[str, int]:
    """Of each token a number with a bit for every place in ``b``."""
    out: dict[str, int] = {}
    for j, t in enumerate(b):
        out[t] = out.get(t, 0) | 1 << j
    return out


def _step(up: int, down: int, at: int, mask: int) -> tuple[int, int, int, int]:
    """The next row of the edit matrix, as bits of where it rises and falls along the row; and where it rises and falls against this one.

    ``at`` are the places of the row's token.
    """
    if at:
        diagonal = ((((at & up) + up) ^ up) | at | down) & mask
        more, less = down | (mask & ~(diagonal | up)), diagonal & up
        shifted = (more << 1 | 1) & mask
        return (less << 1 | ~(diagonal | shifted)) & mask, shifted & diagonal, more, less
    more = mask & ~up
    shifted = (more << 1 | 1) & mask
    return mask & ~(down | shifted), shifted & down, more, 0


def distance(pred: list[str], gt: list[str]) -> int:
    """Total edit distance."""
    a, b = _trim(pred, gt)
    if len(a) > len(b):
        a, b = b, a
    if not a or set(a).isdisjoint(b):
        return len(b)
    places, mask = _places(b), (1 << len(b)) - 1
    up, down = mask, 0
    for t in a:
        up, down, _, _ = _step(up, down, places.get(t, 0), mask)
    return len(a) + up.bit_count() - down.bit_count()


def _walk(a: list[str], b: list[str]) -> Iterator[tuple[int, int, int]]:
    """Steps of the alignment from its end: (op, index in a, index in b)."""
    n, m = len(a), len(b)
    places, mask = _places(b), (1 << m) - 1
    kept, row = {0: (mask, 0)}, (mask, 0)
    for i in range(1, n + 1):
        row = _step(*row, places.get(a[i - 1], 0), mask)[:2]
        if i % KEEP == 0:
            kept[i] = row
    i, j, base, block = n, m, None, []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            yield 0, i, j
            continue
        low = (i - 1) // KEEP * KEEP
        if base != low:
            base, block, row = low, [], kept[low]
            for k in range(low, min(low + KEEP, n)):
                after = _step(*row, places.get(a[k], 0), mask)
                block.append((*row, *after[2:]))
                row = after[:2]
        up, down, more, less = block[i - 1 - base]
        against = (more >> j - 1 & 1) - (less >> j - 1 & 1)  # this row less the one before, at j
        if against + (up >> j - 1 & 1) - (down >> j - 1 & 1) == 1:
            i, j = i - 1, j - 1
            yield 1, i, j
        elif against == 1:
            i -= 1
            yield 2, i, j
        else:
            j -= 1
            yield 3, i, j
    while i:
        i -= 1
        yield 2, i, j
    while j:
        j -= 1
        yield 3, i, j


def sdi(pred: list[str], gt: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions (only in gt) and insertions (only in pred)."""
    more = len(gt) - len(pred)
    a, b = _trim(pred, gt)
    if not a or not b or more and distance(a, b) == abs(more):  # as few edits as the lengths ask for: nothing else
        return 0, max(more, 0), max(-more, 0)
    n = [0, 0, 0, 0]
    for op, _, _ in _walk(a, b):
        n[op] += 1
    return n[1], n[3], n[2]


def alignment(pred: list[str], gt: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(op, token of gt, token of pred) in order."""
    out = [(OPS[op], gt[j] if op != 2 else None, pred[i] if op != 3 else None) for op, i, j in _walk(pred, gt)]
    return out[::-1]


def error_rate(pred: str, gt: str, profile_tokenizer: str = "eojeol", options: Options | None = Options()) -> dict:
    """Token error rate of two texts; 0 where the ground truth has no token. ``options`` None: texts as they are."""
    cut = tokenizer(profile_tokenizer)
    g = cut(normalize(gt, options) if options else gt)
    p = g if pred == gt else cut(normalize(pred, options) if options else pred)
    s, d, i = sdi(p, g)
    return {"wer": (s + d + i) / len(g) if g else 0.0, "S": s, "D": d, "I": i, "N": len(g), "tokenizer": profile_tokenizer}


def wer(pred: Column, gt: Column, profile_tokenizer: str = "eojeol", options: Options | None = Options()) -> Column:
    """The same as a column: null where either text is null."""
    tokenizer(profile_tokenizer)

    @F.arrow_udf(WER)
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else error_rate(a, b, profile_tokenizer, options) for a, b in zip(p.to_pylist(), g.to_pylist(), strict=True)], _WER)

    return run(pred, gt)


def native_distance(a: Column, b: Column) -> Column:
    """Total edit distance of two token arrays without Python: each distinct token of the pair becomes one character."""
    char = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 65536), 8, "0")), "UTF-32")

    def named(s):
        words = F.array_distinct(F.concat(s["a"], s["b"]))
        codes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), char)
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), F.map_from_arrays(words, F.slice(codes, F.lit(1), F.size(words))).alias("names"))

    def compared(s):
        text = lambda t: F.array_join(F.transform(t, lambda w: F.element_at(s["names"], w)), "")
        return F.levenshtein(text(s["a"]), text(s["b"]))

    # a one-element array carries the names, so that they are computed once and not for every token
    return F.element_at(F.transform(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), named), compared), 1)


# lines


def _line(s: str) -> str:
    return normalize(s).strip()


def relaxed(pred: str, gt: str) -> tuple[str, list[dict]]:
    """The parser's line breaks fitted to the ground truth's, one line up or down, and a log of the changes."""
    lines, theirs = pred.split("\n"), gt.split("\n")
    known: dict[str, str] = {}

    def normal(line: str) -> str:
        if (n := known.get(line)) is None:
            n = known[line] = _line(line)
        return n

    single = {n for n in map(normal, theirs) if n}
    double = None
    out, log, i = [], [], 0
    while i < len(lines):
        own = normal(lines[i])
        if own not in single:
            if i + 1 < len(lines) and (both := f"{lines[i]} {lines[i + 1]}") and (n := _line(both)) and n in single:
                log.append({"kind": "merge", "from": lines[i : i + 2], "to": [both]})
                out.append(both)
                i += 2
                continue
            if own and double is None:
                double = {n: (x, y) for x, y in zip(theirs, theirs[1:]) if (n := _line(f"{x} {y}"))}
            if own and own in double:
                log.append({"kind": "split", "from": [lines[i]], "to": list(double[own])})
                out += double[own]
                i += 1
                continue
        out.append(lines[i])
        i += 1
    return "\n".join(out), log


def relaxed_lines(pred: Column, gt: Column) -> Column:
    """:func:`relaxed` as a struct of the text and the log."""
    @F.pandas_udf("struct<text:string,log:array<struct<kind:string,`from`:array<string>,`to`:array<string>>>>")
    def run(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if a is None or b is None else relaxed(a, b) for a, b in zip(p, g, strict=True)]
        return pd.DataFrame(rows, columns=["text", "log"])

    return run(pred, gt)


def line_diff(gt: str, pred: str) -> list[tuple[str, str | None, str | None]]:
    """(tag, line of gt, line of pred) over the lines that are not blank; a replaced block pairs its lines in order."""
    a, b = ([t for t in s.split("\n") if t.strip()] for s in (gt, pred))
    out = []
    for tag, i, ii, j, jj in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        for k in range(max(ii - i, jj - j)):
            out.append((tag, a[i + k] if i + k < ii else None, b[j + k] if j + k < jj else None))
    return out


def line_pairs(gt: list[str], pred: list[str]) -> list[tuple[int | None, int | None, int | None]]:
    """(line of gt, line of pred, anchor): a line that only pred has is anchored before a line of gt."""
    out = []
    for tag, i, ii, j, jj in difflib.SequenceMatcher(None, gt, pred, autojunk=False).get_opcodes():
        for k in range(max(ii - i, jj - j)):
            x, y = (i + k if i + k < ii else None), (j + k if j + k < jj else None)
            out.append((x, y, None if x is not None else ii if tag == "replace" else i))
    return out


def three_way(gt: list[str], before: list[str], after: list[str]) -> list[dict]:
    """Rows of gt with their partners; lines that gt lacks stand before the line they are anchored to."""
    sides = {}
    for name, lines in (("before", before), ("after", after)):
        at, extra = {}, {}
        for g, p, anchor in line_pairs(gt, lines):
            if p is not None and g is not None:
                at[g] = lines[p]
            elif p is not None:
                extra.setdefault(anchor, []).append(lines[p])
        sides[name] = at, extra
    out = []
    for i in range(len(gt) + 1):
        for name, (_, extra) in sides.items():
            out += [{"gt": None, "before": None, "after": None} | {name: t} for t in extra.get(i, [])]
        if i < len(gt):
            out.append({"gt": gt[i]} | {name: at.get(i) for name, (at, _) in sides.items()})
    return out


# slides


def _slide_cost(pred: list[str], gt: list[str], common: set[str]) -> int:
    """:func:`distance`, at once where slides have no word in common, or only in their first words, such as a heading's."""
    k = 0
    for x, y in zip(pred, gt):
        if x != y:
            break
        k += 1
    a, b = pred[k:], gt[k:]
    return max(len(a), len(b)) if common.isdisjoint(a) or common.isdisjoint(b) else distance(a, b)


def aligned_slides(gt: list[str], pred: list[str], profile_tokenizer: str = "eojeol", options: Options = Options()) -> dict:
    """Slides and sections aligned so that the sum of their edits is least; ties go to a match, then to a slide left out."""
    cut = tokenizer(profile_tokenizer)
    g, p = ([cut(normalize(s, options)) for s in side] for side in (gt, pred))
    n, m = len(g), len(p)
    words = [set(t) for t in p]
    cost, total = [], [[0]]
    for t in p:
        total[0].append(total[0][-1] + len(t))
    for a in g:
        own = set(a)
        cost.append([_slide_cost(b, a, own & w) for b, w in zip(p, words)])
        last, row = total[-1], [total[-1][0] + len(a)]
        for j, c in enumerate(cost[-1]):
            row.append(min(last[j] + c, last[j + 1] + len(a), row[j] + len(p[j])))
        total.append(row)
    way, i, j = [], n, m
    while i or j:
        if i and j and total[i][j] == total[i - 1][j - 1] + cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
            way.append((i, j))
        elif i and total[i][j] == total[i - 1][j] + len(g[i - 1]):
            i -= 1
            way.append((i, None))
        else:
            j -= 1
            way.append((None, j))
    pairs = []
    for i, j in reversed(way):
        size = len(g[i]) if i is not None else 0
        if i is None:
            s, d, ins, kind = 0, 0, len(p[j]), "pred_only"
        elif j is None:
            s, d, ins, kind = 0, size, 0, "gt_only"
        else:
            fitted = relaxed(pred[j], gt[i])[0]
            (s, d, ins), kind = sdi(p[j] if fitted == pred[j] else cut(normalize(fitted, options)), g[i]), "match"
        rate = (s + d + ins) / size if size else float(ins > 0)
        pairs.append({"gt_idx": i, "pred_idx": j, "wer": rate, "S": s, "D": d, "I": ins, "N": size, "kind": kind})
    tokens = sum(x["N"] for x in pairs)
    return {"wer": sum(x["S"] + x["D"] + x["I"] for x in pairs) / tokens if tokens else 0.0, "pairs": pairs, "aligned": True}


def slide_error_rate(gt: list[str], pred: str, profile_tokenizer: str = "eojeol", options: Options = Options()) -> dict:
    """Error rate by aligned slides; a parser's text of one section or none is compared as a whole."""
    from ..functions.markup import sections_of

    found = sections_of(pred)
    if len(found) > 1:
        return aligned_slides(gt, found, profile_tokenizer, options)
    return {"wer": error_rate(pred, "\n".join(gt), profile_tokenizer, options)["wer"], "pairs": None, "aligned": False}


SLIDES = "struct<wer:double,aligned:boolean,pairs:array<struct<gt_idx:int,pred_idx:int,wer:double,S:int,D:int,I:int,N:int,kind:string>>>"

_PAIR = pa.struct([("gt_idx", pa.int32()), ("pred_idx", pa.int32()), ("wer", pa.float64()), *((k, pa.int32()) for k in "SDIN"), ("kind", pa.string())])
_SLIDES = pa.struct([("wer", pa.float64()), ("aligned", pa.bool_()), ("pairs", pa.list_(_PAIR))])


def slide_wer(gt: Column, pred: Column, profile_tokenizer: str = "eojeol", options: Options = Options()) -> Column:
    """:func:`slide_error_rate` of an array of slides and a text."""
    @F.arrow_udf(SLIDES)
    def run(g: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else slide_error_rate(a, b, profile_tokenizer, options) for a, b in zip(nested(g), p.to_pylist(), strict=True)], _SLIDES)

    return run(gt, pred)


# rows of alignments, as arrays to explode

TOKEN_ROWS = "array<struct<op:string,gt_token:string,pred_token:string>>"
LINE_ROWS = "array<struct<tag:string,gt_line:string,pred_line:string>>"
THREE_ROWS = "array<struct<gt:string,before:string,after:string>>"


def _lines(text: str | None) -> list[str]:
    return [t for t in (text or "").split("\n") if t.strip()]


def token_rows(pred: Column, gt: Column) -> Column:
    """:func:`alignment` of the white-space tokens of two texts; null where either is."""
    names = ["op", "gt_token", "pred_token"]

    @F.arrow_udf(TOKEN_ROWS)
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        parts, ends, absent = [], [0], []
        for a, b in zip(p.to_pylist(), g.to_pylist(), strict=True):
            absent.append(a is None or b is None)
            columns = list(zip(*alignment(a.split(), b.split()))) if not absent[-1] else []
            if columns:  # in Arrow's form at once: a row's strings live no longer than the row
                parts.append(pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names))
            ends.append(ends[-1] + (len(columns[0]) if columns else 0))
        values = pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.string()) for n in names]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(absent, pa.bool_()))

    return run(pred, gt)


def line_rows(pred: Column, gt: Column) -> Column:
    """:func:`line_diff` of two texts; null where either is."""
    @F.pandas_udf(LINE_ROWS)
    def run(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else [dict(zip(("tag", "gt_line", "pred_line"), r)) for r in line_diff(b, a)] for a, b in zip(p, g, strict=True)])

    return run(pred, gt)


def three_way_rows(gt: Column, before: Column, after: Column) -> Column:
    """:func:`three_way` of the lines of three texts; a null text has none."""
    @F.pandas_udf(THREE_ROWS)
    def run(g: pd.Series, b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([three_way(*map(_lines, x)) for x in zip(g, b, a, strict=True)])

    return run(gt, before, after)


def exploded(df: DataFrame, keys: list[str], rows: Column, seq: str = "seq") -> DataFrame:
    """``keys``, the number of a row in its array, and its fields."""
    return df.select(*keys, F.posexplode(rows).alias(seq, "x")).select(*keys, seq, "x.*")


# the same as table functions of SQL, in Arrow batches


class TokenAlignment:
    def eval(self, pred: str, gt: str):
        if pred is not None and gt is not None:
            for seq, (op, g, p) in enumerate(alignment(pred.split(), gt.split())):
                yield seq, op, g, p


class LineDiff:
    def eval(self, pred: str, gt: str):
        if pred is not None and gt is not None:
            for seq, (tag, g, p) in enumerate(line_diff(gt, pred)):
                yield seq, tag, g, p


class ThreeWay:
    def eval(self, gt: str, before: str, after: str):
        for seq, r in enumerate(three_way(_lines(gt), _lines(before), _lines(after))):
            yield seq, r["gt"], r["before"], r["after"]


def register(spark) -> None:
    """Make the table functions known to SQL: token_alignment, line_diff, three_way."""
    for name, cls, schema in (
        ("token_alignment", TokenAlignment, "seq int, op string, gt_token string, pred_token string"),
        ("line_diff", LineDiff, "seq int, tag string, gt_line string, pred_line string"),
        ("three_way", ThreeWay, "seq int, gt string, before string, after string"),
    ):
        spark.udtf.register(name, F.udtf(cls, returnType=schema, useArrow=True))
