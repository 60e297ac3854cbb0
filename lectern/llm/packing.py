"""Packing documents into fixed windows by best-fit decreasing.

Documents are tokenised in the scan and cut into pieces of at most one window; full windows are
windows of their own and leave the task at once. What is left of a document, less than a window, waits
until a task holds ``GROUP_ROWS`` such pieces; they are placed longest first, and a segment tree indexed by
remaining capacity finds the tightest open window in ``log2(window)`` steps. Nothing is shuffled, so neither a
hot source, nor a very long document, nor a row that repeats very often gathers in one task, and a lost
task is packed again from its own part of the scan. Partitions with fewer rows than a group are read together.

Defined cases: a null text is an empty one and packs as the end token alone; repeated rows are
packed once each; a null id is kept; an empty table gives no pieces; ties in length go by
the order of rows; other columns of the input, whatever their names, are not read; sequences are
numbered by partition, and by order within it.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 2048
END_ID = 1
#: Pieces shorter than a window that are packed at once: a task holds their ids, at most a window each.
GROUP_ROWS = 4096
#: Full windows in a batch that leaves a task.
FULL_ROWS = 1024

_SPECIAL = "<|endoftext|>"
_encoders: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """Whole-text ids of the byte-level BPE, as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str = "byte_bpe_50k.tiktoken", special_id: int = 50256):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: special_id})

    def ids(self, text: str) -> bytes:
        return self._enc.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""


def encoder(name: str) -> ByteBpe:
    if name not in _encoders:
        _encoders[name] = ByteBpe(name)
    return _encoders[name]


class CapacityTree:
    """Open windows by remaining capacity: a segment tree of counts over capacities 0..window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest open window with room for ``need``."""
        count, i = self.count, need + self.size
        while not count[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i <<= 1
            if not count[i]:
                i += 1
        capacity = i - self.size
        window_id = self.open[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, window_id


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` must be in falling order."""
    tree, windows, offsets, opened = CapacityTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n) if n < window else None
        if found is None:
            capacity, w = window, opened
            opened += 1
        else:
            capacity, w = found
        windows.append(w)
        offsets.append(window - capacity)
        if capacity > n:
            tree.add(capacity - n, w)
    return windows, offsets


def packed(rows, window: int, end: bytes, vocabulary: str, group_rows: int, first_id: int):
    """Lists of ``(row key, start, ids, tokens of the document, sequence, offset)`` from ``(row key, text)`` pairs.

    Holds at most ``group_rows`` pieces that are shorter than a window, and one document.
    """
    enc, step, opened = encoder(vocabulary), 4 * window, first_id
    full, waiting = [], []

    def place():
        waiting.sort(key=lambda p: -len(p[2]))
        windows, offsets = best_fit_decreasing([len(p[2]) // 4 for p in waiting], window)
        return [(*p, opened + w, o) for p, w, o in zip(waiting, windows, offsets, strict=True)], opened + max(windows) + 1

    for key, text in rows:
        ids = enc.ids(text or "") + end
        for at in range(0, len(ids), step):
            piece = (key, at // 4, ids[at : at + step], len(ids) // 4)
            if len(piece[2]) < step:
                waiting.append(piece)
            else:
                full.append((*piece, opened, 0))
                opened += 1
                if len(full) >= FULL_ROWS:
                    yield full
                    full = []
        if len(waiting) >= group_rows:
            done, opened = place()
            waiting = []
            yield done
    if full:
        yield full
    if waiting:
        yield place()[0]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, group_rows: int = GROUP_ROWS, vocabulary: str = "byte_bpe_50k.tiktoken", with_ids: bool = True) -> DataFrame:
    """Pack every text of ``df``: ``(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset)`` per piece.

    With ``with_ids`` each piece carries its token ids: binary, little-endian unsigned 32-bit. Narrow: no shuffle.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    fields = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"

    def run(it):
        from pyspark import TaskContext

        kind = None

        def rows():
            nonlocal kind
            for b in it:
                kind = b.schema.field(0).type
                yield from zip(b.column(0), b.column(1).to_pylist())

        first = TaskContext.get().partitionId() << 32
        for done in packed(rows(), window, end_id.to_bytes(4, "little"), vocabulary, group_rows, first):
            keys, start, raw, total, sequence, offset = zip(*done)
            cols = {"doc_id": pa.array([k.as_py() for k in keys], kind), "start": pa.array(start, pa.int64()), "length": pa.array([len(r) // 4 for r in raw], pa.int64())}
            cols |= {"ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()), "doc_tokens": pa.array(total, pa.int64())}
            cols |= {"ids": pa.array(raw, pa.binary())} if with_ids else {}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.coalesce(max(1, -(-df.count() // group_rows))).mapInArrow(run, fields)
