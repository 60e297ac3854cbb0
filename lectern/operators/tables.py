"""Scores of table matrices: structure-aware similarity, cell overlap, positional comparison."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import nested
from ..functions.markup import normalized_cell

TEDS = "struct<teds_content:double,edit_distance:double,max_nodes:int>"
_TEDS = pa.struct([("teds_content", pa.float64()), ("edit_distance", pa.float64()), ("max_nodes", pa.int32())])


@lru_cache(maxsize=100_000)
def similarity(gt: str, pred: str) -> float:
    """Share of matching characters; the order of the two matters. Two blanks are equal."""
    return 1.0 if gt == pred else SequenceMatcher(None, gt, pred).ratio() if gt and pred else 0.0


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal elements that both sides have once, as many as rise on both."""
    def once(s):
        at: dict = {}
        for i, x in enumerate(map(tuple, s)):
            at[x] = None if x in at else i
        return at

    at = once(b)
    pairs = [(i, j) for x, i in once(a).items() if i is not None and (j := at.get(x)) is not None]
    tails, ends, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        tails[n:n + 1], ends[n:n + 1] = [j], [k]
        before.append(ends[n - 1] if n else None)
    out, k = [], ends[-1] if ends else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _bound(a: list, b: list, drop, add, change) -> float:
    """The cost of one way from ``a`` to ``b``: anchors matched, what lies between them changed one by one."""
    cost, i, j = 0.0, 0, 0
    for x, y in (*_anchors(a, b), (len(a), len(b))):
        n = min(x - i, y - j)
        cost += sum(min(change(a[i + k], b[j + k]), drop(a[i + k]) + add(b[j + k])) for k in range(n))
        cost += sum(map(drop, a[i + n : x])) + sum(map(add, b[j + n : y]))
        i, j = x + 1, y + 1
    return cost


def _longest(row: list[str]) -> int:
    return max(map(len, row), default=0)


def _fold(a: list, b: list, drop, add, change, bounded: bool = False) -> float:
    """Least cost of turning sequence ``a`` into ``b``, two rows at a time.

    Equal ends are matched outright: leaving one out instead costs at least as much, since changing an
    element costs at least the difference of the two weights. ``change`` is only asked where it can still win.
    ``bounded``, for rows of cells: by that difference, prefixes and suffixes of different weights cost something too; places where
    both together exceed the cost of a known way are left out, since no best way goes through them.
    """
    start, n = 0, min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return sum(map(add, b), 0.0) + sum(map(drop, a), 0.0)
    if len(a) == 1 == len(b):
        return min(drop(a[0]) + add(b[0]), change(a[0], b[0]))
    grow = [add(y) for y in b]
    row = [0.0]
    for g in grow:
        row.append(row[-1] + g)
    if bounded:
        return _banded(a, b, [drop(x) for x in a], grow, change, _bound(a, b, drop, add, change) + 1e-6)
    for x in a:
        gone = drop(x)
        new = [row[0] + gone]
        for j, y in enumerate(b):
            best = min(row[j + 1] + gone, new[j] + grow[j])
            if row[j] < best:
                best = min(best, row[j] + change(x, y))
            new.append(best)
        row = new
    return row[-1]


def _banded(a: list, b: list, shrink: list[float], grow: list[float], change, most: float) -> float:
    """:func:`_fold` over the places that a way of cost ``most`` can reach.

    Rows that differ cost at least what two cells cost that differ by one character, so most pairs need no comparison.
    """
    never = float("inf")
    left = [0.0, *accumulate(shrink)]
    right = [0.0, *accumulate(grow)]
    rest = left[-1] - right[-1]
    longest = [_longest(y) for y in b]

    def reach(done: float) -> tuple[int, int]:
        """Places j where |done - right[j]| + |what is left| is ``most`` at the utmost: an interval, since right rises."""
        low, high = min(0.0, rest), max(0.0, rest)
        slack = (most - (high - low)) / 2
        return bisect_left(right, done - high - slack), bisect_right(right, done - low + slack)

    lo, hi = reach(0.0)
    row = [right[j] if lo <= j < hi else never for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        gone, own = shrink[i], _longest(x)
        lo, hi = reach(left[i + 1])
        new = [never] * (len(b) + 1)
        for j in range(lo, hi):
            best = row[j] + gone
            if j:
                best = min(best, new[j - 1] + grow[j - 1])
                if row[j - 1] < best:
                    least = 0.0 if x == b[j - 1] else 0.5 / max(own, longest[j - 1], 1)
                    if row[j - 1] + least + abs(rest - left[i + 1] + right[j]) <= most:
                        best = min(best, row[j - 1] + change(x, b[j - 1]))
            new[j] = best
        row = new
    return row[-1]


def table_distance(gt: list[list[str]], pred: list[list[str]]) -> float:
    """Row by row, and cell by cell within rows. Equal rows cost nothing; similarities of cells are remembered."""
    one = lambda _: 1.0

    def cells(a, b):
        return 1.0 - similarity(a, b)

    def rows(a, b):
        return 0.0 if a == b else _fold(a, b, one, one, cells)

    weight = lambda r: 1.0 + len(r)
    return _fold(gt, pred, weight, weight, rows, bounded=True)


def nodes(matrix: list[list[str]]) -> int:
    return 1 + len(matrix) + sum(map(len, matrix))


def teds(pred: list[list[str]], gt: list[list[str]]) -> dict:
    far, most = table_distance(gt, pred), max(nodes(gt), nodes(pred))
    return {"teds_content": max(0.0, 1.0 - far / most), "edit_distance": far, "max_nodes": most}


def average_teds(pred: list, gt: list) -> float | None:
    """Mean over tables paired in order; tables without a partner don't count, no pair gives none."""
    scores = [teds(p, g)["teds_content"] for p, g in zip(pred, gt)]
    return sum(scores) / len(scores) if scores else None


def _lists(m) -> list[list[str]]:
    return [[c or "" for c in r] for r in m]


def table_similarity(pred: Column, gt: Column) -> Column:
    """:func:`teds` of two matrix columns."""
    @F.arrow_udf(TEDS)
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else teds(_lists(a), _lists(b)) for a, b in zip(nested(p), nested(g), strict=True)], _TEDS)

    return run(pred, gt)


def mean_table_similarity(pred: Column, gt: Column) -> Column:
    """:func:`average_teds` of two columns of tables."""
    @F.arrow_udf("double")
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else average_teds([_lists(t) for t in a], [_lists(t) for t in b]) for a, b in zip(nested(p), nested(g), strict=True)], pa.float64())

    return run(pred, gt)


def cell_similarity(gt: Column, pred: Column) -> Column:
    """:func:`similarity`; equal cells never reach Python's matcher."""
    @F.pandas_udf("double")
    def run(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([similarity(a or "", b or "") for a, b in zip(g, p, strict=True)], dtype="float64")

    return run(gt, pred)


def cell_f1(df: DataFrame, keys: list[str], pred: str, gt: str) -> DataFrame:
    """Overlap of the multisets of cells that are not blank; ``pred`` and ``gt`` are arrays of matrices.

    Cells are counted per key and value on both sides at once: one shuffle for values, one for keys.
    """
    side = lambda c, s: df.select(*keys, F.explode(F.flatten(F.flatten(F.col(c)))).alias("cell"), F.lit(s).alias("side"))
    cells = side(pred, 1).union(side(gt, 0)).withColumn("cell", normalized_cell(F.col("cell"))).where("cell <> ''")
    counts = cells.groupBy(*keys, "cell").agg(F.sum("side").alias("p"), F.sum(1 - F.col("side")).alias("g"))
    sums = counts.groupBy(*keys).agg(F.sum(F.least("p", "g")).alias("both"), F.sum("p").alias("n_pred_cells"), F.sum("g").alias("n_gt_cells"))
    out = df.select(*keys).distinct().join(sums, keys, "left").fillna(0, ["both", "n_pred_cells", "n_gt_cells"])
    empty = (F.col("n_pred_cells") == 0) & (F.col("n_gt_cells") == 0)
    share = lambda n: F.when(empty, 1.0).when(F.col(n) > 0, F.col("both") / F.col(n)).otherwise(0.0)
    out = out.withColumns({"cell_precision": share("n_pred_cells"), "cell_recall": share("n_gt_cells")})
    p, r = F.col("cell_precision"), F.col("cell_recall")
    return out.withColumn("cell_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).select(*keys, "cell_f1", "cell_precision", "cell_recall", "n_pred_cells", "n_gt_cells")


def cell_grid(df: DataFrame, keys: list[str], pred: str, gt: str) -> DataFrame:
    """Cells at equal positions next to each other, with their similarity rounded to three digits and a class."""
    def cells(c, name):
        rows = df.select(*keys, F.posexplode(c).alias("row", "r"))
        return rows.select(*keys, "row", F.posexplode("r").alias("col", name))

    both = cells(gt, "gt_cell").join(cells(pred, "pred_cell"), [*keys, "row", "col"], "full")
    both = both.withColumn("raw", cell_similarity(F.coalesce("gt_cell", F.lit("")), F.coalesce("pred_cell", F.lit(""))))
    kind = F.when(F.col("gt_cell").isNull(), "extra").when(F.col("pred_cell").isNull(), "missing").when(F.col("raw") >= 0.999, "match").when(F.col("raw") >= 0.6, "partial").otherwise("mismatch")
    return both.select(*keys, "row", "col", "gt_cell", "pred_cell", F.bround("raw", 3).alias("similarity"), kind.alias("class"))
