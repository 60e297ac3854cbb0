"""Hashed words of whole texts, and the bounded training sample, for the two text classifiers."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_CHARS, held_out, small_batches

MEMO_ENTRIES = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_memo: dict[str, bytes] = {}


def word_hashes(texts: list[str]):
    """32-bit hashes of all words and punctuation runs of ``texts``, lower-cased, and the number in each text."""
    import array

    import numpy as np

    if len(_memo) > MEMO_ENTRIES:
        _memo.clear()
    get, out, sizes = _memo.get, [], []
    for text in texts:
        n = 0
        for chunk in text.split():
            x = get(chunk)
            if x is None:
                x = array.array("I", [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in _TOKEN.findall(chunk.lower())]).tobytes()
                if len(chunk) <= MEMO_CHARS:
                    _memo[chunk] = x
            out.append(x)
            n += len(x)
        sizes.append(n // 4)
    return np.frombuffer(b"".join(out), np.uint32), np.array(sizes, np.int64)


def spread(h, bits: int):
    """Mix 32-bit hashes and keep ``bits`` bits."""
    import numpy as np

    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def row_sums(values, sizes):
    """Sum of each row's share of ``values``; rows may be empty."""
    import numpy as np

    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def text_runs(texts: list[str], most: int = 1_000_000):
    """Slices of a batch with about ``most`` characters each, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, label, order)`` of about ``bound`` labelled documents outside the held-out fold, chosen by a hash.

    The bound holds for ids and for rows: of an id that repeats with many texts a share is taken, and rows
    that repeat id and text teach once. Repeated labels of an id count once, as the largest; null ids and labels teach nothing.
    """
    def share(of: int):
        taken = min(1.0, bound / max(of, 1))
        return lambda h: F.pmod(h, F.lit(1_000_000)) < int(taken * 1_000_000) + (taken >= 1)

    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label is not null")
    known = known.where(~held_out("__id")).groupBy("__id").agg(F.max("label").alias("label"))
    known = known.where(share(known.count())(F.xxhash64("__id")))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "__id").withColumn("order", F.xxhash64("__id", "text"))  # about `bound` rows of an id and a label
    several = rows.select("order").distinct().count()
    return rows.where(share(several)(F.xxhash64("order", F.lit(1)))).dropDuplicates(["order"]).select("text", "label", "order")


def train(sample: DataFrame, extract, fit) -> bytes:
    """Extract features in parallel, fit in one executor task, and return the model's bytes.

    ``extract(texts) -> list of bytes`` per text; ``fit(list of bytes, labels) -> bytes``. The sample is bounded,
    so the task and the model, which alone reaches the driver, do not grow with the corpus.
    """
    import pyarrow as pa

    small_batches(sample.sparkSession)

    def features(it):
        for b in it:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(extract(texts), pa.binary()), b.column(1), b.column(2)], names=["x", "label", "order"])

    def learn(it):
        xs, ys = [], []
        for b in it:
            xs += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(xs, ys)], pa.binary())], names=["model"])

    x = sample.mapInArrow(features, "x binary, label int, order long")
    row = x.repartition(1).sortWithinPartitions("order", "label").mapInArrow(learn, "model binary").first()
    return bytes(row["model"]) if row else fit([], [])  # an empty sample may never reach a task


def scored(df: DataFrame, model: bytes, score, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; ``score(model, texts) -> array``. Narrow."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of hash buckets

    def run(it):
        import numpy as np

        for b in it:
            texts = [t or "" for t in b.column(2).to_pylist()]
            s = np.concatenate([score(shared.value, texts[x:y]) for x, y in text_runs(texts)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def kept(df: DataFrame, model: bytes, score, keep, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``keep(scores)`` holds. Narrow."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the number of hash buckets
    at = df.columns.index(text_col)

    def run(it):
        import numpy as np

        for b in it:
            texts = [t or "" for t in b.column(at).to_pylist()]
            if texts:
                yield b.filter(pa.array(keep(np.concatenate([score(shared.value, texts[x:y]) for x, y in text_runs(texts)]))))

    return df.mapInArrow(run, df.schema)
