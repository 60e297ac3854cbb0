"""Scores per document and stage, and their summary.

Everything stays a DataFrame: ``gt(doc_id, stage, type, dual_gt, text, slides, tables)`` and
``pred(doc_id, stage, raw)`` are joined once; rows without both sides are neither parsed nor scored.
Cost grows with the product of both lengths, so rows are dealt by hash of document and stage before scoring.
"""

from __future__ import annotations

from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import nested, small_batches
from ..functions.markup import clean_matrix, split_output
from ..functions.text import PROFILES, Profile, tokenizer
from ..operators import align, tables
from ..sources.corpus import STAGES, parsed

METRICS = (("wer", True), ("teds", False))
# Names in the summary.
METRIC_NAMES = {"wer": "wer", "teds": "teds_content"}
DIRECTIONS = {True: "감소(개선)", False: "증가(개선)"}
SCORES = "struct<wer:double,teds:double>"
#: Parts of a parser's output, as :func:`split_output` gives them.
OUTPUT = ("text", "tables", "sheets")
UNITS = "array<struct<unit:int,teds:double,n_gt_rows:int,n_pred_rows:int>>"
_UNITS = pa.list_(pa.struct([("unit", pa.int32()), ("teds", pa.float64()), ("n_gt_rows", pa.int32()), ("n_pred_rows", pa.int32())]))


def _rows(x) -> list:
    return [[[c or "" for c in r or ()] for r in t or ()] for t in x or ()]


def score(kind: str, text: str, slides, gt_tables, pred: dict, profile: Profile) -> tuple[float | None, float | None]:
    """(error rate, table similarity) of one document and stage."""
    name, options = profile.tokenizer, profile.options
    if kind == "xlsx":
        g, p = (clean_matrix([r for t in side for r in t]) for side in (gt_tables, pred["sheets"]))
        same = tables.teds(p, g)["teds_content"] if g or p else 1.0
        wer = align.error_rate(pred["text"], text, name, options)["wer"] if text.strip() or pred["text"].strip() else None
        return wer, same
    same = tables.average_teds(pred["tables"], gt_tables)
    if kind == "pptx":
        return align.slide_error_rate(slides, pred["text"], name, options)["wer"], same
    return align.error_rate(align.relaxed(pred["text"], text)[0], text, name, options)["wer"], same


def scores(gt: DataFrame, pred: DataFrame, profile: str = "default") -> DataFrame:
    """``doc_id, stage, type, dual_gt, wer, teds``: both null where a stage has no output or no ground truth."""
    p = PROFILES[profile]
    tokenizer(p.tokenizer)

    @F.arrow_udf(SCORES)
    def run(kind: pa.Array, text: pa.Array, slides: pa.Array, tabs: pa.Array, raw: pa.Array) -> pa.Array:
        rows = [
            score(k, t, s or [], _rows(m), dict(zip(OUTPUT, split_output(o))), p) if t is not None and o is not None else (None, None)
            for k, t, s, m, o in zip(kind.to_pylist(), text.to_pylist(), nested(slides), nested(tabs), raw.to_pylist(), strict=True)
        ]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(2)], ["wer", "teds"])

    small_batches(gt.sparkSession)
    both = gt.join(pred, ["doc_id", "stage"], "left").repartition("doc_id", "stage")
    return both.select("doc_id", "stage", "type", "dual_gt", run("type", "text", "slides", "tables", "raw").alias("s")).select("doc_id", "stage", "type", "dual_gt", "s.*")


def per_document(long: DataFrame) -> DataFrame:
    """One row per document, a column per metric and stage."""
    value = lambda m, s: F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"{m}_{s}")
    return long.groupBy("doc_id", "type", "dual_gt").agg(*(value(m, s) for s in STAGES for m, _ in METRICS))


def summary(wide: DataFrame, extra: tuple[tuple[str, bool], ...] = ()) -> DataFrame:
    """Mean of each metric before and after, change, and improvement in percent; metrics without any value go.

    ``extra`` names further ``(metric, lower is better)`` with columns ``{metric}_before`` and ``{metric}_after``.
    """
    specs = (*METRICS, *extra)
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(METRIC_NAMES.get(m, m)).alias("metric"), F.lit(low).alias("low"), F.col(f"{m}_before").alias("b"), F.col(f"{m}_after").alias("a")) for i, (m, low) in enumerate(specs)))).alias("x")).select("x.*")
    means = long.groupBy("i", "metric", "low").agg(F.avg("b").alias("b"), F.avg("a").alias("a")).where("b is not null or a is not null")
    gain = F.when(F.col("low"), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    half_even = lambda c, n: F.bround(c, n)
    return means.orderBy("i").select(
        "metric", half_even(F.col("b"), 4).alias("before_mean"), half_even(F.col("a"), 4).alias("after_mean"), half_even(F.col("a") - F.col("b"), 4).alias("absolute_change"),
        F.when(F.col("b") != 0, half_even(gain / F.col("b") * 100, 2)).alias("improvement_pct"),
        F.when(F.col("low"), DIRECTIONS[True]).otherwise(DIRECTIONS[False]).alias("direction"),
    )


def run(gt: DataFrame, pred: DataFrame, profile: str = "default") -> tuple[DataFrame, DataFrame]:
    wide = per_document(scores(gt, pred, profile))
    return wide, summary(wide)


def slide_units(gt: DataFrame, pred: DataFrame, profile: str = "default") -> DataFrame:
    """Decks by slide: which slide met which section, and its errors."""
    p = PROFILES[profile]
    small_batches(gt.sparkSession)
    both = gt.where("type = 'pptx' and slides is not null").join(pred, ["doc_id", "stage"]).repartition("doc_id", "stage")
    s = align.slide_wer(F.col("slides"), parsed(F.col("raw"))["text"], p.tokenizer, p.options)
    return both.select("doc_id", "stage", s.alias("s")).select("doc_id", "stage", "s.aligned", F.posexplode_outer("s.pairs").alias("seq", "x")).select("doc_id", "stage", "aligned", "seq", "x.*")


def sheet_units(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Workbooks by sheet: sheets and tables paired by position, missing ones empty, pairs of empty ones left out."""
    @F.arrow_udf(UNITS)
    def run(tabs: pa.Array, raw: pa.Array) -> pa.Array:
        out = []
        for m, o in zip(nested(tabs), raw.to_pylist(), strict=True):
            sides = zip_longest(_rows(m), split_output(o)[2] if o is not None else (), fillvalue=())
            pairs = [(i, clean_matrix(g), clean_matrix(p)) for i, (g, p) in enumerate(sides)]
            out.append([{"unit": i, "teds": tables.teds(p, g)["teds_content"], "n_gt_rows": len(g), "n_pred_rows": len(p)} for i, g, p in pairs if g or p])
        return pa.array(out, _UNITS)

    small_batches(gt.sparkSession)
    both = gt.where("type = 'xlsx'").join(pred, ["doc_id", "stage"]).repartition("doc_id", "stage")
    return both.select("doc_id", "stage", F.explode(run("tables", "raw")).alias("x")).select("doc_id", "stage", "x.*")


def by_profile(gt: DataFrame, pred: DataFrame, names: tuple[str, ...] = tuple(PROFILES)) -> DataFrame:
    """Plain error rates of texts and decks under several profiles; those whose tokenizer is missing give null and say why."""
    both = gt.where("type <> 'xlsx' and text is not null").join(pred, ["doc_id", "stage"]).select("doc_id", "stage", "text", parsed(F.col("raw"))["text"].alias("pred"))
    out = None
    for name in names:
        p = PROFILES[name]
        try:
            tokenizer(p.tokenizer)("")
            rate, skipped = align.wer(F.col("pred"), F.col("text"), p.tokenizer, p.options)["wer"], F.lit(None).cast("string")
        except ImportError as e:
            rate, skipped = F.lit(None).cast("double"), F.lit(str(e))
        part = both.select("doc_id", "stage", F.lit(name).alias("profile"), F.lit(p.tokenizer).alias("tokenizer"), rate.alias("wer"), skipped.alias("skipped"))
        out = part if out is None else out.union(part)
    return out


def diagnosis(gt: DataFrame, pred: DataFrame, doc_id: str, stage: str, max_lines: int = 300, max_paragraphs: int = 200, max_rows: int = 8) -> dict[str, DataFrame]:
    """What is behind one document's score, as tables: score, tokens, paragraphs, repeated lines, first table's grid.

    A workbook has ``rows`` instead of tokens and paragraphs: the first cleaned rows of both sides.
    """
    from ..functions.markup import merged
    from ..functions.text import normalized
    from ..operators.dups import repeated_lines

    one = (F.col("doc_id") == doc_id) & (F.col("stage") == stage)
    g, p = gt.where(one), pred.where(one)
    both = g.join(p, ["doc_id", "stage"]).withColumn("out", parsed(F.col("raw")))
    texts = both.where("type <> 'xlsx'").select("doc_id", F.col("text").alias("gt"), F.col("out.text").alias("pred"), "type")
    relaxed = F.when(F.col("type") == "docx", align.relaxed_lines(F.col("pred"), F.col("gt"))["text"]).otherwise(F.col("pred"))
    token_rows = align.exploded(texts, ["doc_id"], align.token_rows(normalized(relaxed), normalized(F.col("gt")))).where("op <> 'match'")
    lines = align.exploded(texts, ["doc_id"], align.line_rows(F.col("pred"), F.col("gt")))
    grid = tables.cell_grid(both.select("doc_id", F.get("tables", F.lit(0)).alias("g"), F.get("out.tables", F.lit(0)).alias("p")), ["doc_id"], "p", "g")
    dups = repeated_lines(both.select("doc_id", F.col("out.text").alias("text"), F.col("out.tables").alias("tables")), ["doc_id"])
    sheets = both.where("type = 'xlsx'").select("doc_id", F.explode(F.array(F.struct(F.lit("gt").alias("side"), merged(F.col("tables")).alias("m")), F.struct(F.lit("pred").alias("side"), merged(F.col("out.sheets")).alias("m")))).alias("x"))
    sheets = sheets.select("doc_id", "x.side", F.posexplode("x.m").alias("row", "cells")).where(F.col("row") < max_rows)
    return {"score": scores(g, p), "tokens": token_rows.orderBy("seq").limit(max_lines), "paragraphs": lines.orderBy("seq").limit(max_paragraphs), "repeated": dups, "grid": grid, "rows": sheets}
