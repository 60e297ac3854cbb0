"""Writers: CSV with a byte order mark, console, HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """A folder of CSV files with a header; the mark stands before the first column's name."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, BOM + first) if bom else df
    out.write.mode("overwrite").option("header", True).option("quoteAll", False).option("nullValue", "").csv(path)


def print_report(per_document: DataFrame, summary: DataFrame, rows: int = 1000) -> None:
    per_document.orderBy("doc_id").show(rows, truncate=False)
    summary.show(rows, truncate=False)


def write_html(pages: DataFrame, path: str) -> None:
    """``pages(doc_id, html)``: one text file per document, below a folder named after it."""
    pages.select("doc_id", F.col("html").alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(path)
