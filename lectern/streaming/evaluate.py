"""Scores for a stream of parser outputs against a fixed ground truth.

New files are scored as they arrive (stateless), and appended to a table; the newest file of a document
and stage wins when the table is read, so late and replaced files need no state in the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..plans import evaluate
from ..sources.corpus import classified

FILES = "path string, modificationTime timestamp, length long, content binary"


def outputs(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """``doc_id, stage, raw, arrived`` of parser outputs that appear in a folder."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return classified(files).select("doc_id", F.col("role").alias("stage"), F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").alias("arrived"))


def score_stream(gt: DataFrame, stream: DataFrame, table: str, checkpoint: str, profile: str = "default") -> StreamingQuery:
    """Append the scores of each micro-batch to a Parquet table; a batch that is run again replaces its own part."""
    def add(batch: DataFrame, number: int) -> None:
        known = gt.join(batch.select("doc_id", "stage").distinct(), ["doc_id", "stage"], "left_semi")
        latest = newest(batch)
        done = evaluate.scores(known, latest.select("doc_id", "stage", "raw"), profile)
        done.join(latest.select("doc_id", "stage", "arrived"), ["doc_id", "stage"]).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(df: DataFrame) -> DataFrame:
    """The last row of each document and stage."""
    w = Window.partitionBy("doc_id", "stage").orderBy(F.desc("arrived"))
    return df.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


def current(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    """Per-document scores and summary of what has arrived so far."""
    wide = evaluate.per_document(newest(spark.read.parquet(table)))
    return wide, evaluate.summary(wide)
