"""Sharding by Hilbert-curve order, for file pruning on several metadata columns. DataFrame operations only.

Each dimension is quantised to 16 equi-depth steps that keep its order, the cell's index on the Hilbert
curve is computed, rows are numbered along the curve, and the numbering is cut into runs: shard counts are
at most one apart, and each file covers a compact box of the dimensions.

The scan reads texts once, to measure them; ids, sizes, checksums and dimensions are written to the shared
folder with a number for each row, and everything after reads that table. The steps' cuts are exact quantiles
of all rows: distinct values are counted and their counts summed in order, in ranges of values if there are
many. Numbering is distributed: a cell with many rows is split by the row numbers into parts of about
``SPLIT_ROWS``, so that a hot source, rows all in one cell, and rows that repeat an id or are equal throughout
still spread over tasks. Cells, 4096 at most, get offsets from their counts, parts get theirs within a cell,
and rows are numbered within their part.

Defined cases: null metadata come first in a dimension's order; null text has no bytes; repeated
rows each get a slot; nulls in the id are kept; columns that are not named are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import discard, materialise, scratch

BITS = 4
SHARDS = 40
SPLIT_ROWS = 100_000
OVERHEAD = 16
DIMENSIONS = ("lang", "source", "n_chars")
#: Rows in a file that :func:`write_shards` writes.
FILE_ROWS = 50_000


def ordinal(col: Column, kind: T.DataType) -> Column:
    """A value that keeps the order of a column: a number (null: -1), or whole text (null comes first)."""
    if isinstance(kind, T.NumericType):
        x = col.cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        x = F.unix_micros(col.cast("timestamp")).cast("double")
    else:
        return col.cast("string")
    return F.coalesce(x, F.lit(-1.0))


def quantised(x: Column, cuts: list[float] | list[str | None]) -> Column:
    """The number of cuts below ``x``; null is below all others."""
    out = F.lit(0)
    for c in set(cuts):
        out = out + (x.isNotNull() if c is None else F.coalesce(x > F.lit(c), F.lit(False))).cast("int")
    return out


def exact_cuts(base: DataFrame, names: list[str], steps: int, split_rows: int) -> tuple[int, list[list[float] | list[str | None]]]:
    """The number of rows, and for each of the columns the values at ranks ``ceil(rows * k / steps)`` of all rows in its order.

    The columns' values with their counts are one sequence, ordered by column and value. It is summed in ranges of about
    ``split_rows`` values: the ranges' sums, few, tell which ranges hold the ranks, and only these are summed value by value.
    """
    texts = {a for a, kind in base.dtypes if kind == "string"}
    order = ["__d", "__x", "__t"]

    def value(i, a):
        x, t = (F.lit(None), F.col(a)) if a in texts else (F.col(a), F.lit(None))
        return F.struct(F.lit(i).alias("__d"), x.cast("double").alias("__x"), t.cast("string").alias("__t"))

    with scratch(base.sparkSession):
        each = base.select(F.explode(F.array(*(value(i, a) for i, a in enumerate(names)))).alias("__v")).select("__v.*")
        counts, _ = materialise(each.groupBy(*order).agg(F.count(F.lit(1)).alias("__n")), "values")
        values, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
        parts = -(-values // split_rows)
        if parts > 1:
            counts, _ = materialise(counts.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
        else:
            counts = counts.withColumn("__part", F.lit(0))
        n = total // len(names)
        ranks = [d * n + -(-n * k // steps) for d in range(len(names)) for k in range(1, steps)] if n else []
        before, at = {}, 0
        for part, size in counts.groupBy("__part").agg(F.sum("__n")).orderBy("__part").collect():
            if any(at < r <= at + size for r in ranks):
                before[part] = at
            at += size
        if not ranks:
            return 0, [[] for _ in names]
        starts = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))
        own = W.Window.partitionBy("__part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        to = F.sum("__n").over(own) + F.element_at(starts, F.col("__part").cast("long"))
        met = F.filter(F.array(*(F.lit(r).cast("long") for r in ranks)), lambda r: (r > F.col("__to") - F.col("__n")) & (r <= F.col("__to")))
        held = counts.where(F.col("__part").isin(list(before))).withColumn("__to", to).select(*order, F.explode(met).alias("__r")).collect()
    at_rank = {r["__r"]: r["__t"] if names[r["__d"]] in texts else r["__x"] for r in held}
    found = [at_rank[r] for r in ranks]
    return n, [found[d * (steps - 1) : (d + 1) * (steps - 1)] for d in range(len(names))]


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The Hilbert-curve index of integers in 0..2**bits-1, by Skilling's transposition.

    A one-element array carries the axes from step to step, so that each step's values are computed once.
    """
    d = range(len(dims))

    def axes(x):
        return F.array(*x)

    def undo(i, b):
        def step(s):
            x, p = [s[k] for k in d], (1 << b) - 1
            on, t = F.shiftright(x[i], b).bitwiseAND(1) == 1, x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            first = F.when(on, x[0].bitwiseXOR(F.lit(p))).otherwise(x[0].bitwiseXOR(t))
            if i == 0:
                return axes([F.when(on, x[0].bitwiseXOR(F.lit(p))).otherwise(x[0]), *x[1:]])
            return axes([first if k == 0 else F.when(on, x[k]).otherwise(x[k].bitwiseXOR(t)) if k == i else x[k] for k in d])

        return step

    def gray(i):
        return lambda s: axes([s[k].bitwiseXOR(s[k - 1]) if k == i else s[k] for k in d])

    def last(s):
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.shiftright(s[d[-1]], b).bitwiseAND(1) * ((1 << b) - 1))
        return F.array(*(s[k] for k in d), t)

    def index(s):
        out = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for k in d:
                out = out * 2 + F.shiftright(s[k].bitwiseXOR(s[len(dims)]), b).bitwiseAND(1)
        return out

    state = F.array(axes([c.cast("int") for c in dims]))
    for step in [*(undo(i, b) for b in range(bits - 1, 0, -1) for i in d), *(gray(i) for i in d if i), last, index]:
        state = F.transform(state, step)
    return F.element_at(state, 1)


def measured(df: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...], *more: Column) -> DataFrame:
    """Id, size, checksum and dimensions (``__o0``, ``__o1``, ...) of each row."""
    kinds = {f.name: f.dataType for f in df.schema}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(ordinal(F.col(f"`{d}`"), kinds[d]).alias(f"__o{i}") for i, d in enumerate(dims)),
        *more,
    )


def numbered(base: DataFrame, dims: int, shards: int, split_rows: int) -> DataFrame:
    """``base``, which has a number ``__row`` for each row, with ``curve``, ``shard`` and ``slot``."""
    q = [f"__q{i}" for i in range(dims)]
    n, cuts = exact_cuts(base, [f"__o{i}" for i in range(dims)], 1 << BITS, split_rows)
    rows = base.withColumns({a: quantised(F.col(f"__o{i}"), cuts[i]) for i, a in enumerate(q)})

    cells = rows.groupBy(*q).agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.select(*q, hilbert_index([F.col(a) for a in q]).alias("curve"), F.ceil(F.col("__n") / split_rows).cast("int").alias("__parts"), "__n")
    before = W.Window.orderBy("curve").rowsBetween(W.Window.unboundedPreceding, -1)
    cells = cells.select(*q, "curve", "__parts", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__cell_at"))  # at most 2**(BITS * dims) cells
    part = F.pmod(F.xxhash64("__row"), F.col("__parts")).cast("int")
    rows = rows.join(F.broadcast(cells), q).select("__row", "doc_id", "size", "text_crc32", "curve", "__cell_at", part.alias("__part"))
    counts = rows.groupBy("curve", "__part", "__cell_at").agg(F.count(F.lit(1)).alias("__n"))
    before = W.Window.partitionBy("curve").orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select("curve", "__part", (F.col("__cell_at") + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__at"))
    own = W.Window.partitionBy("curve", "__part").orderBy("doc_id", "text_crc32", "size", "__row")
    placed = rows.select("__row", "doc_id", "size", "text_crc32", "curve", "__part", (F.row_number().over(own) - 1).cast("long").alias("__i"))
    placed = placed.join(offsets, ["curve", "__part"]).withColumn("__r", F.col("__at") + F.col("__i"))
    total = max(1, n)
    return placed.withColumn("__s", F.expr(f"(__r * {shards}) div {total}").cast("long")).select(
        "__row", "doc_id", "size", "text_crc32", F.col("curve").cast("int").alias("curve"), F.col("__s").cast("int").alias("shard"),
        F.expr(f"__r - ((__s * {total} + {shards - 1}) div {shards})").cast("long").alias("slot"),
    )


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, curve, shard, slot)`` of every row."""
    base, _ = materialise(measured(df, id_col, text_col, dims, F.monotonically_increasing_id().alias("__row")), "measures")
    return numbered(base, len(dims), shards, split_rows).drop("__row")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, split_rows: int = SPLIT_ROWS, file_rows: int = FILE_ROWS) -> None:
    """Write all rows of ``df``, those that repeat an id or have none too, as one folder per shard, in files of ``file_rows`` rows in curve order.

    Rows are numbered in a copy in the shared folder, which is deleted at the end.
    """
    rows, copy = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    base, measures = materialise(measured(rows, id_col, text_col, dims, F.col("__row")), "measures")
    placed = numbered(base, len(dims), shards, split_rows).select("__row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), F.expr(f"slot div {file_rows}").alias("__file"))
    files = max(1, -(-base.count() // file_rows)) + shards
    out = rows.join(placed, "__row").repartition(files, "__shard", "__file").sortWithinPartitions("__shard", "__slot")
    out.drop("__row", "__slot", "__file").withColumnRenamed("__shard", "shard").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
    for p in (copy, measures):
        discard(df.sparkSession, p)
