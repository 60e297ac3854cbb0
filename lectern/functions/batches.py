"""Arrow batches: how much one holds, and nested lists out of its columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes in a batch of texts or tables: both bound what a Python worker holds, whatever the session's defaults are.
ROWS = 1000
BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = ROWS, size: int = BYTES) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows and about ``size`` bytes from here on."""
    for key, most, given in (("maxRecordsPerBatch", rows, 10_000), ("maxBytesPerBatch", size, (1 << 31) - 1)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, str(given)).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def nested(a: pa.Array) -> list:
    """Lists of lists, to any depth: all values at once, then cut by their offsets."""
    if not (pa.types.is_list(a.type) or pa.types.is_large_list(a.type)):
        return a.to_pylist()
    if not len(a):
        return []
    ends = a.offsets.to_pylist()
    first = ends[0]
    values = nested(a.values.slice(first, ends[-1] - first))
    out = [values[i - first : j - first] for i, j in zip(ends, ends[1:])]
    return [x if k else None for x, k in zip(out, a.is_valid().to_pylist())] if a.null_count else out
