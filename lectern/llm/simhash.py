"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are 64-bit. They are cut into five blocks; two that differ in at most three bits
agree on at least two blocks, so each distinct fingerprint is keyed by its ten pairs of blocks and
only fingerprints with an equal key are compared. Above some billions of distinct fingerprints there are more blocks, of which more
must agree (:func:`blocks_for`), so that a run of even fingerprints stays short. Copies collapse to one fingerprint first. Keys
are read as sorted runs: short runs are compared by shifting, longer ones as a matrix of which only
a spanning forest of the links leaves the task. A run over ``RUN_LIMIT`` is never compared as a
whole: its members are keyed again by finer blocks (fourteen, of which eleven must agree, so that a
run has at most 2**15 members whatever the data are) and compared there; nothing is dropped.
Links form components over distinct fingerprints.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and link like
any other; a text with fewer words than a shingle counts as one shingle; repeated rows are returned
once each; rows with a null id are returned and their ids don't count in components; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, scratch, small_batches

BITS = 64
SEED = 42
DISTANCE = 3
RUN_LIMIT = 1024
_SHORT = 24


def shingle_hashes(text: str | None, words: int):
    """XXH64 of every shingle of ``words`` words, repeats included, as unsigned 64-bit."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(w) - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of a text: bit b is 1 if over half of the shingle hashes have it."""
    import numpy as np

    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` with the fingerprint as a signed long. Narrow."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(it):
        for batch in it:
            fp = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x - (1 << 64) if x >> 63 else x for x in fp], pa.int64())], names=["doc_id", "text_hash", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long")


def block_masks(blocks: int, distance: int = DISTANCE, bits: int = BITS) -> list[int]:
    """A mask for each choice of blocks on which two fingerprints within ``distance`` may agree."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [reduce(int.__or__, c) for c in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, masks: list[int], parent: Column | None = None) -> Column:
    """The rows to emit for a fingerprint: a 64-bit hash for each mask's blocks. A clash only adds a comparison."""
    seed = [] if parent is None else [parent]
    return F.explode(F.array(*[F.xxhash64(*seed, F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]))


def _spanning(x, distance: int):
    """Edges, as index pairs, of a spanning forest of the links within one run. Row by row: memory is linear."""
    import numpy as np

    left, edges = np.arange(len(x)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = np.bitwise_count(x[left] ^ x[u]) <= distance
            hit = left[near]
            left = left[~near]
            edges += [(u, v) for v in hit]
            front += hit.tolist()
    return edges


def _compare(distance: int, limit: int | None):
    """Over partitions sorted by key: links of runs up to ``limit``, and the members of longer runs as they are."""
    import numpy as np
    import pandas as pd

    def frame(kind, a, b, key):
        return pd.DataFrame({"kind": kind, "a": a, "b": b, "key": key})

    def links(key, fp):
        x = fp.view(np.uint64)
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(bounds)
        at = np.repeat(size, size)
        out_a, out_b = [], []
        keep = np.flatnonzero((at > 1) & (at <= _SHORT))
        k, y, f = key[keep], x[keep], fp[keep]
        for s in range(1, _SHORT):
            same = np.flatnonzero(k[s:] == k[:-s])
            if not len(same):
                break
            same = same[np.bitwise_count(y[same] ^ y[same + s]) <= distance]
            out_a.append(f[same])
            out_b.append(f[same + s])
        for i in np.flatnonzero(size > _SHORT):
            run = slice(bounds[i], bounds[i + 1])
            edges = _spanning(x[run], distance)
            if edges:
                e = np.array(edges)
                out_a.append(fp[run][e[:, 0]])
                out_b.append(fp[run][e[:, 1]])
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return frame(0, a, b, 0) if len(a) else None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for pdf in it:
            key = np.concatenate((held_key, pdf["key"].to_numpy()))
            fp = np.concatenate((held, pdf["fp"].to_numpy()))
            if over is not None:  # the rest of a run that is already known to be too long
                n = int(np.searchsorted(key != over, True)) if key[0] == over else 0
                if n:
                    yield frame(1, fp[:n], fp[:n], key[:n])
                    key, fp = key[n:], fp[n:]
                if len(key):
                    over = None
            if not len(key):
                held_key = held = np.zeros(0, np.int64)
                continue
            last = int(len(key) - np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            held_key, held = key[last:], fp[last:]
            if limit and len(held) > limit:
                over = int(held_key[0])
                yield frame(1, held, held, held_key)
                held_key = held = np.zeros(0, np.int64)
            yield from done(key[:last], fp[:last])
        yield from done(held_key, held)

    def done(key, fp):
        if not len(key):
            return
        if limit:
            bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(bounds)
            if size.max() > limit:
                long = np.repeat(size, size) > limit
                yield frame(1, fp[long], fp[long], key[long])
                key, fp = key[~long], fp[~long]
        found = links(key, fp) if len(key) else None
        if found is not None:
            yield found

    return run


def blocks_for(n: int, distance: int = DISTANCE, run_limit: int = RUN_LIMIT, bits: int = BITS) -> int:
    """The fewest blocks of which the agreeing ones leave runs of ``n`` even fingerprints an eighth of the limit at most."""
    blocks = distance + 2
    while blocks < 14 and n * 8 > run_limit * 2.0 ** (bits * (blocks - distance) / blocks):
        blocks += 1
    return blocks


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that have the components of all links."""
    schema = "kind int, a long, b long, key long"

    def compare(keyed, limit):
        return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_compare(distance, limit), schema)

    distinct, _ = materialise(distinct, "distinct")
    keyed = distinct.select("fp", _keys(F.col("fp"), block_masks(blocks_for(distinct.count(), distance), distance)).alias("key"))
    first, _ = materialise(compare(keyed, run_limit), "runs")
    out = first.where("kind = 0").select("a", "b")
    if first.where("kind = 1").limit(1).count():
        fine = first.where("kind = 1").select(F.col("a").alias("fp"), _keys(F.col("a"), block_masks(14, distance), F.col("key")).alias("key"))
        out = out.union(compare(fine, None).select("a", "b"))
    return out


def components_of(prints: DataFrame, links: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` of every fingerprint in ``prints``, from the links ``(a, b)`` between them."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots, _ = materialise(connected_components(links), "roots")
    linked = roots.join(first, roots["node"] == first["fp"]).select("fp", "root", "first_id")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("low"))
    moved = linked.join(lowest, "root").select("fp", "root", "low")
    component = first.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("low", "first_id").alias("component_id"))
    # read back, the join of documents with it has a plain scan on both sides, and a fingerprint with very many copies can be split
    return materialise(component, "components")[0]


def representatives(df: DataFrame, prints: DataFrame, component: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest (id, text hash), with all columns as they are.

    Of rows that repeat both id and text one is kept.
    """
    same = prints.groupBy("doc_id", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n"))
    best = same.join(component, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"), F.col("k.n").alias("__n"))
    hit = df.join(best, df[id_col].eqNullSafe(best["__id"]) & (F.xxhash64(df[text_col]) == best["__hash"]))
    rows = [df[c] for c in df.columns]
    once = hit.where("__n = 1").select(*rows)
    return once.union(hit.where("__n > 1").dropDuplicates(["__id", "__hash"]).select(*rows))


def _components(df: DataFrame, id_col: str, text_col: str, words: int, distance: int, run_limit: int) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and ``(fp, root, component_id)`` of every fingerprint."""
    prints, _ = materialise(fingerprints(df, id_col, text_col, words), "fingerprints")
    with scratch(df.sparkSession) as made:
        component = components_of(prints, fingerprint_links(prints.select("fp").distinct(), distance, run_limit))
        made.pop()  # the components, which come last, are read on
    return prints, component


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``df``.

    The smallest id reachable stands for a component (null if none of its rows has an id).
    """
    prints, component = _components(df, id_col, text_col, words, distance, run_limit)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(component, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row of each component: see :func:`representatives`."""
    return representatives(df, *_components(df, id_col, text_col, words, distance, run_limit), id_col, text_col)
