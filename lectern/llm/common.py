"""Helpers shared by the training-data operators.

Everything that must outlive an executor goes through :func:`materialise`, which writes Parquet
below the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch of documents: both bound what a Python worker holds when texts are very long.
DOC_BATCH_ROWS = 512
DOC_BATCH_BYTES = 16 << 20
#: Longest chunk of text, in characters, that a worker memoises: texts without spaces would fill the memory.
MEMO_CHARS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one only for a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="lectern-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Paths of the tables that :func:`materialise` writes inside; they are deleted at the end, but for those that were taken out of the list."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.remove(paths)
        for p in paths:
            discard(spark, p)


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`materialise` wrote and nothing will read again."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = DOC_BATCH_ROWS, size: int = DOC_BATCH_BYTES) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows and about ``size`` bytes from here on."""
    for key, most, given in (("maxRecordsPerBatch", rows, 10_000), ("maxBytesPerBatch", size, (1 << 31) - 1)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, str(given)).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def held_out(doc_id: str | Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 5, is 0 (null id: empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def batches(fn: Callable, out_schema):
    """An Arrow map over batches: ``fn(batch) -> dict of columns``."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch), schema=out_schema)

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that an edge names; root is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round only groups and joins on nodes, its
    result goes to the shared folder, and nothing but an edge count and a checksum reaches the driver.
    Edges with a null end and loops are ignored. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
    e = e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e, path = materialise(e, "edges")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # (v, m) of a node's other neighbours, and (u, m) of the node itself
        e2 = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        e2, path2 = materialise(e2, "edges")
        discard(spark, path)
        e, path = e2, path2
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
