"""The corpus of files: names to roles, bundles per document, contents."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ooxml

# Roles and their extensions.
ROLES = ("gt", "before_gt", "after_gt", "before", "after")
GT_EXTENSIONS = ("docx", "pptx", "xlsx")
STAGES = ("before", "after")
NAME = r"(?s)^(.*?)_(before_gt|after_gt|gt|before|after)$"


def doc_and_role(stem: Column) -> tuple[Column, Column]:
    """(document id, role) of a file name without extension; null where it has no role."""
    part = lambda k: F.when(stem.rlike(NAME), F.regexp_extract(stem, NAME, k))
    return part(1), part(2)


def classified(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``name, ext, doc_id, role``; files without a role or with the wrong extension for it go."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    out = files.withColumn("name", name)
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    doc, role = doc_and_role(F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""))
    out = out.withColumns({"ext": ext, "doc_id": doc, "role": role})
    fits = F.when(F.col("role").isin("before", "after"), F.col("ext") == "txt").otherwise(F.col("ext").isin(*GT_EXTENSIONS))
    return out.where(F.col("role").isNotNull() & fits)


def bundles(files: DataFrame, path: str = "path", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: a struct, or null, for each role. Of several files in a role the last name wins."""
    rows = classified(files, path)
    file = F.struct(F.col(path).alias("path"), F.col("ext"), *(F.col(c) for c in extra))
    return rows.groupBy("doc_id").agg(*(F.max_by(F.when(F.col("role") == r, file), F.when(F.col("role") == r, F.col("name"))).alias(r) for r in ROLES))


def gt_for(stage: str) -> Column:
    """The ground truth of a stage: its own, or else the common one."""
    return F.coalesce(F.col(f"{stage}_gt"), F.col("gt"))


def document_type() -> Column:
    return F.coalesce(gt_for("before")["ext"], gt_for("after")["ext"])


def dual_gt() -> Column:
    return F.col("before_gt").isNotNull() | F.col("after_gt").isNotNull()


def units(bundled: DataFrame) -> DataFrame:
    """One row per document and stage; documents without any ground truth go."""
    out = bundled.where(document_type().isNotNull())
    stage = lambda s: F.struct(F.lit(s).alias("stage"), gt_for(s).alias("gt_file"), F.col(s).alias("pred_file"))
    out = out.select("doc_id", document_type().alias("type"), dual_gt().alias("dual_gt"), F.explode(F.array(*map(stage, STAGES))).alias("u"))
    return out.select("doc_id", "type", "dual_gt", "u.*")


def extracted(content: Column, ext: Column) -> Column:
    """Text, slides and tables of office files."""
    @F.pandas_udf(ooxml.EXTRACTED)
    def run(c: pd.Series, e: pd.Series) -> pd.DataFrame:
        none = {"text": None, "slides": None, "tables": None}
        return pd.DataFrame([none if a is None else ooxml.extract(a, b) for a, b in zip(c, e, strict=True)], columns=list(none))

    return run(content, ext)


def parsed(raw: Column) -> Column:
    """A parser's output as its text and its tables (``tables`` for pairing, ``sheets`` without empty ones)."""
    from ..functions.markup import split_output

    m, kind = "array<array<array<string>>>", pa.list_(pa.list_(pa.list_(pa.string())))

    @F.arrow_udf(f"struct<text:string,tables:{m},sheets:{m}>")
    def run(s: pa.Array) -> pa.Array:
        columns = zip(*((None, None, None) if t is None else split_output(t) for t in s.to_pylist()))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(list(columns) or [[]] * 3, (pa.string(), kind, kind))], ["text", "tables", "sheets"])

    return run(raw)


def scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``gt(doc_id, stage, type, dual_gt, text, slides, tables)`` and ``pred(doc_id, stage, raw)`` of a flat folder.

    Office files are extracted where they are read, each once, and only their text and tables meet the list of names:
    no file's bytes are shuffled. Outputs know their document and stage by their name.
    """
    files = spark.read.format("binaryFile").load(folder)
    u = units(bundles(files.select("path")))
    named = classified(files)
    read = named.where(F.col("ext") != "txt").select("path", extracted(F.col("content"), F.col("ext")).alias("x")).select("path", "x.*")
    gt = u.select("doc_id", "stage", "type", "dual_gt", F.col("gt_file.path").alias("path")).join(read, "path", "left").drop("path")
    raw = named.where(F.col("ext") == "txt").select("doc_id", F.col("role").alias("stage"), "name", F.decode("content", "UTF-8").alias("raw"))
    pred = raw.groupBy("doc_id", "stage").agg(F.max_by("raw", "name").alias("raw"))  # of several files the last name wins
    return gt, pred.join(u.select("doc_id", "stage"), ["doc_id", "stage"], "left_semi")
