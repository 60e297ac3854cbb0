"""Lines of a text that repeat a table's contents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import nested
from ..functions.text import Options, normalize

LINES = pa.list_(pa.struct([("line_no", pa.int32()), ("line", pa.string())]))


def repeated_of(text: str | None, tables: list | None, ratio: float = 0.9, options: Options = Options()) -> list[tuple[int, str]]:
    """``(line_no, line)`` of one text, in time linear in its parts, the cells, and their hits."""
    if text is None:
        return []
    known: dict[str | None, str] = {None: ""}

    def part(raw: str | None) -> str:
        if (p := known.get(raw)) is None:
            p = known[raw] = normalize(raw, options).strip()
        return p

    owners: dict[str, list[int]] = {}
    sizes = []
    for k, m in enumerate(tables or ()):
        cells = {p for r in m or () for c in r or () if (p := part(c))}
        sizes.append(len(cells))
        for p in cells:
            owners.setdefault(p, []).append(k)
    good: list[list[int]] = [[] for _ in sizes]
    covered: list[set[str]] = [set() for _ in sizes]
    lines = text.split("\n") if owners else []
    for no, line in enumerate(lines):
        t = line.strip()
        parts = [p for x in (t.strip("|").split("|") if "|" in t else t.split()) if (p := part(x))]
        hits: dict[int, list[str]] = {}
        for p in parts:
            for k in owners.get(p, ()):
                hits.setdefault(k, []).append(p)
        for k, own in hits.items():
            if len(own) >= max(1, len(parts) // 2):
                good[k].append(no)
                covered[k].update(own)
    marked = {no for k, n in enumerate(sizes) if n and len(covered[k]) / n >= ratio for no in good[k]}
    return [(no, lines[no]) for no in sorted(marked)]


def repeated_lines(df: DataFrame, keys: list[str], text: str = "text", tables: str = "tables", ratio: float = 0.9, options: Options = Options()) -> DataFrame:
    """``keys, line_no, line`` of the lines made of a table's cells, where ``ratio`` of its cells are covered.

    A line matches a table if its hits are at least half of its parts, rounded down, and at least one.
    Lines are split into parts at bars, or else at white space; cells and parts are normalised alike.
    All of it happens where a row is: nothing is shuffled.
    """
    @F.arrow_udf("array<struct<line_no:int,line:string>>")
    def run(t: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([repeated_of(a, b, ratio, options) for a, b in zip(t.to_pylist(), nested(m), strict=True)], LINES)

    return df.select(*keys, F.explode(run(F.col(text), F.col(tables))).alias("x")).select(*keys, "x.*")
