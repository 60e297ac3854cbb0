"""Near-duplicates at a similarity: pigeonhole blocks of shingle sets, wide SimHash fingerprints, exact similarity.

A 64-bit fingerprint tells a similarity of 0.8 from one of 0.5 badly, and pairs at 0.8 differ in ten of its bits. Here the
fingerprint whose blocks are joined is the widest there is, one bit for every possible shingle of ``WORDS`` words. Two sets of
similarity 0.8 or more differ in at most ``k``, a ninth of their sizes' sum, of these bits. The bits are dealt into blocks by
a hash, more than ``k`` of them, so some block is equal in both: no pair is lost. A block's key is a hash of the shingles in it.
Both sets must be dealt into the same number of blocks: sizes fall into levels that grow by ``RATIO``, a level's number
of blocks follows from its largest size, and a set is dealt for its own level and, if a set a quarter larger may be there, the next one.
An equal block must not be an empty one, which very many sets share. A set with more than ``k`` blocks that are not empty has an
equal block that is not; a set without is dealt again by another hash, as often as needed. Of two similar sets both are dealt
up to the first time that one of them has enough, so empty blocks need no key.

Sets that share a key are verified by SimHash: ``BITS`` bits, of which a pair of similarity J differs in a share of at
most acos(2J / (1 + J)) / pi, 15.2 % at 0.8 (18.8 % for sets of four and five). Runs of a key are compared by the first 128
bits; short runs give the pairs that are close there, longer ones their members with such a pair, of which a minimum spanning tree
by all bits follows. A candidate has at most ``DISTANCE`` differing bits, which lies eight standard deviations beyond a pair at
0.8 (four to five for the smallest sets; ``FIRST_DISTANCE`` six, and five). An eighth of the keys goes first; what it joins counts as joined in the
runs of the others, which only give candidates between different families: so candidates grow with the members of a
family, not with members times keys. A run over ``RUN_LIMIT`` is compared in pairs of blocks of members, each a task of its own; nothing is capped.

Candidates only tell families, the components of candidate pairs. Within a family all distinct texts are compared by
their sets of shingles, and a link is a pair whose Jaccard similarity is ``SIMILARITY`` or more. A family over
``RUN_LIMIT`` texts or ``SHINGLES`` shingles is compared in pairs of blocks. Components are those of the links.

Defined cases: null, empty and white-space texts have no shingle and link with each other; texts with fewer
words than a shingle count as one; repeated rows and null ids are treated as in :mod:`simhash`; other columns are kept.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, scratch, small_batches
from .simhash import components_of, representatives, shingle_hashes

WORDS = 5
BITS = 1024
SIMILARITY = 0.8
#: Largest over smallest size, about, of a level.
RATIO = 1.4
#: Blocks per block that may differ, so that enough of them are not empty.
SPARE = 1.3
#: For candidates. The share at similarity 0.8 is 155 bits with a standard deviation of 11.5.
DISTANCE = 250
#: The same in the first 128 bits: 19.5 with a standard deviation of 4.1.
FIRST_DISTANCE = 46
#: One in so many keys goes first.
FIRST = 8
RUN_LIMIT = 2048
#: Of a family's block.
SHINGLES = 1 << 20
_SHORT = 8
_LANES = BITS // 64


def _lanes():
    import numpy as np

    return np.random.default_rng(64).integers(1, 1 << 63, _LANES, dtype=np.uint64) | np.uint64(1)


def ones(h):
    """How often each of 64 bits per lane is set in the rows of ``h``: carry-save adders, then counting."""
    import numpy as np

    total, level, weight = np.zeros(h.shape[1] * 64, np.int64), h, 1
    while True:
        carried = []
        while len(level) > 24:
            k = len(level) // 3
            a, b, c, rest = level[:k], level[k : 2 * k], level[2 * k : 3 * k], level[3 * k :]
            x = a ^ b
            carried.append((a & b) | (x & c))
            level = np.concatenate((x ^ c, rest)) if len(rest) else x ^ c
        total += weight * np.unpackbits(level.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.int64)
        if not carried:
            return total
        level, weight = np.concatenate(carried), 2 * weight


def distinct_shingles(text: str | None, words: int = WORDS):
    import numpy as np

    return np.unique(shingle_hashes(text, words))


def sketch_of(h):
    """``BITS`` bits as unsigned 64-bit lanes: a bit is 1 if over half of the hashes of distinct shingles have it."""
    import numpy as np

    if not len(h):
        return np.zeros(_LANES, np.uint64)
    total, mult = np.zeros(BITS, np.int64), _lanes()
    for at in range(0, len(h), 16_384):
        x = h[at : at + 16_384, None] * mult
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        total += ones(x ^ (x >> np.uint64(29)))
    return np.packbits(total * 2 > len(h)).view(">u8").astype(np.uint64)


def sketch(text: str | None, words: int = WORDS):
    return sketch_of(distinct_shingles(text, words))


@cache
def levels(size: int, similarity: float = SIMILARITY) -> tuple[tuple[int, int, int], ...]:
    """``(level, bits that may differ, blocks)`` for each level in which a set of ``size`` may meet a similar one that is not smaller."""
    out, level, low = [], 0, 1
    while low <= size / similarity + 1e-9:
        high = max(low, int(low * RATIO) - 1)
        if size <= high:
            differ = int((1 - similarity) / (1 + similarity) * 2 * high + 1e-9)
            out.append((level, differ, differ and int(SPARE * (differ + 1)) + 1 or 1))
        level, low = level + 1, high + 1
    return tuple(out)


def block_keys(sets, similarity: float = SIMILARITY):
    """Keys of the blocks, not empty ones, of each set (arrays of distinct hashes): one array of all keys, and the number of each set's."""
    import numpy as np

    rng = np.random.default_rng(31)
    value, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    todo = [(i, *level) for i, x in enumerate(sets) if len(x) for level in levels(len(x), similarity)]
    keys, owners, turn = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while todo:
        deal, mark = rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
        row, level, differ, blocks = (np.array(c, np.int64) for c in zip(*todo))
        sizes = np.array([len(sets[i]) for i in row])
        h = np.concatenate([sets[i] for i in row]).view(np.uint64)
        at = np.cumsum(blocks) - blocks  # a number for each block of each set
        spread = ((h * deal) >> np.uint64(32)) * np.repeat(blocks.astype(np.uint64), sizes) >> np.uint64(32)
        place = np.repeat(at, sizes) + spread.astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, mixed = place[order], (h * value) ^ (h >> np.uint64(31))
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        total, place = np.add.reduceat(mixed[order], first), place[first]
        of = np.searchsorted(at, place, "right") - 1
        number = ((level[of] << 40) + (place - at[of])).astype(np.uint64)
        key = (total + number * odd) * mark
        keys.append(key ^ (key >> np.uint64(29)))
        owners.append(row[of])
        filled = np.bincount(of, minlength=len(todo))
        todo = [t for t, n, d in zip(todo, filled.tolist(), differ.tolist()) if n <= d]
        turn += 1
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order].view(np.int64), np.bincount(owner, minlength=len(sets))


def set_hash(h) -> int:
    """A hash of a set of hashes, as a signed long; 0 for the empty one."""
    import numpy as np

    x = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return int((x ^ (x >> np.uint64(32))).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0


def _runs(texts: list, most: int = 1_000_000):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, text_hash, fp, lanes array<long>)``; ``fp`` is a hash of the set of shingles. Narrow.

    A task gives ``lanes`` once for each set that it meets, and null with its copies.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(it):
        seen: set[int] = set()
        for b in it:
            fp, lanes = [], []
            for t in b.column(1):
                h = distinct_shingles(t.as_py(), words)
                fp.append(set_hash(h))
                lanes.append(None if fp[-1] in seen else sketch_of(h).view("int64"))
                seen.add(fp[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64()), pa.array(lanes, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp", "lanes"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long, lanes array<long>")


def keyed(df: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(key, fp)`` of every block of every set of shingles, once for each task that meets the set. Narrow."""
    import pyarrow as pa

    small_batches(df.sparkSession)

    def run(it):
        import numpy as np

        seen: set[int] = set()
        for b in it:
            texts = b.column(0).to_pylist()
            for x, y in _runs(texts):
                new = {fp: h for h in (distinct_shingles(t, words) for t in texts[x:y]) if (fp := set_hash(h)) not in seen}
                seen.update(new)
                key, n = block_keys(list(new.values()))
                fp = np.repeat(np.array(list(new), np.int64), n)
                for at in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 18)]), pa.array(fp[at : at + (1 << 18)])], names=["key", "fp"])

    return df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, fp long")


def shared_keys(blocks: DataFrame) -> DataFrame:
    """The rows of ``(key, fp)``, without repeats, whose key several sets have: most keys go here."""
    import pyarrow as pa

    def run(it):
        import numpy as np

        last, held, open_key = None, None, None  # the last row; it, if it waits for a second of its key; a key that has several
        for b in it:
            x = np.stack([b.column(i).to_numpy() for i in (0, 1)], 1)
            before = np.concatenate(([last if last is not None else x[0] + 1], x[:-1]))
            last = x[-1]
            x = x[(x != before).any(1)]
            if held is not None:
                x = np.concatenate((held, x))
            if not len(x):
                continue
            k = x[:, 0]
            same = np.concatenate(([False], k[1:] == k[:-1], [False]))
            several = same[1:] | same[:-1]
            if open_key is not None:
                several |= k == open_key
            held = None if several[-1] else x[-1:]
            open_key = int(k[-1]) if several[-1] else None
            out = x[several]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["key", "fp"])

    return blocks.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "key long, fp long")


def _near_tree(x, group, distance: int):
    """The links of a minimum spanning forest of ``x`` (rows of lanes), as index pairs; equal ``group``: joined already.

    Row by row: memory is linear.
    """
    import numpy as np

    n = len(x)
    best, via, left = np.full(n, 1 << 20), np.zeros(n, np.int64), np.ones(n, bool)
    edges, u = [], 0
    for _ in range(n - 1):
        left[u] = False
        d = np.bitwise_count(x ^ x[u]).sum(1, dtype=np.int64)
        d[group == group[u]] = -1
        closer = left & (d < best)
        best[closer], via[closer] = d[closer], u
        u = int(np.argmin(np.where(left, best, 1 << 21)))
        if 0 <= best[u] <= distance:
            edges.append((int(via[u]), u))
    return edges


def _run_links(key, x, group, distance: int):
    """Index pairs of close rows of different groups within runs of up to ``_SHORT`` equal, sorted keys, and the rows of longer runs that have such a pair."""
    import numpy as np

    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(bounds)
    each = np.repeat(size, size)
    keep = np.flatnonzero((each > 1) & (each <= _SHORT))
    k, y, g = key[keep], x[keep], group[keep]
    out, rest = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, _SHORT):
        same = np.flatnonzero(k[s:] == k[:-s])
        if not len(same):
            break
        same = same[g[same] != g[same + s]]
        same = same[np.bitwise_count(y[same] ^ y[same + s]).sum(1) <= distance]
        out.append(np.stack((keep[same], keep[same + s]), 1))
    for i in np.flatnonzero(size > _SHORT):
        y, g = x[bounds[i] : bounds[i + 1]], group[bounds[i] : bounds[i + 1]]
        if (g != g[0]).any():
            rest.append(bounds[i] + np.flatnonzero([((np.bitwise_count(y ^ y[u]).sum(1) <= distance) & (g != g[u])).any() for u in range(len(y))]))
    return np.concatenate(out), np.concatenate(rest)


def candidates(met: DataFrame, nodes: DataFrame, distance: int = DISTANCE, first_distance: int = FIRST_DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different groups that share a key and are close in their first lanes.

    Those of long runs are close in all lanes and span the run's components. ``met`` has ``key``, ``fp``, the first
    two lanes ``x`` and ``y``, and ``g``, a number that nodes of one group have in common; ``nodes`` has ``fp`` and ``lanes``.
    """
    import pyarrow as pa

    def rows(kind, key, p, q):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(p), pa.int32()), pa.array(key), *(pa.array(c) for c in (p[:, 0], q[:, 0], p[:, 3]))], names=["kind", "key", "a", "b", "g"])

    def done(key, x):
        import numpy as np

        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        long = np.repeat(np.diff(bounds) > run_limit, np.diff(bounds))
        if long.any():
            yield rows(1, key[long], x[long], x[long])
            key, x = key[~long], x[~long]
        if len(key):
            e, rest = _run_links(key, x[:, 1:3].view(np.uint64), x[:, 3], first_distance)
            if len(e):
                yield rows(0, key[e[:, 0]], x[e[:, 0]], x[e[:, 1]])
            if len(rest):
                yield rows(1, key[rest], x[rest], x[rest])

    def compare(it):
        import numpy as np

        key, x, over = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), None
        for b in it:
            key = np.concatenate((key, b.column(0).to_numpy()))
            x = np.concatenate((x, np.stack([b.column(i).to_numpy() for i in (1, 2, 3, 4)], 1)))
            if over is not None:  # the rest of a run that is already known to be too long
                n = int(np.searchsorted(key, over, "right"))
                if n:
                    yield rows(1, key[:n], x[:n], x[:n])
                    key, x = key[n:], x[n:]
                if len(key):
                    over = None
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from done(key[:last], x[:last])
                key, x = key[last:], x[last:]
            if len(key) > run_limit:
                over = int(key[0])
                yield rows(1, key, x, x)
                key, x = key[:0], x[:0]
        if len(key):
            yield from done(key, x)

    def across(key, pdf):
        import numpy as np
        import pandas as pd

        own = pdf["fp"].to_numpy()
        e = np.array(_near_tree(np.stack(pdf["lanes"].to_numpy()).view(np.uint64), pdf["g"].to_numpy(), distance), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": own[e[:, 0]], "b": own[e[:, 1]]})

    met = met.select("key", "fp", "x", "y", "g").repartition("key").sortWithinPartitions("key", "fp")
    first, _ = materialise(met.mapInArrow(compare, "kind int, key long, a long, b long, g long"), "candidates")
    found = first.where("kind = 0").select("a", "b")
    long = first.where("kind = 1").select("key", F.col("a").alias("fp"), "g")
    if long.limit(1).count():
        blocks = long.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / run_limit).cast("int").alias("blocks"))
        own = long.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "g")
        found = found.union(pairs.join(nodes, "fp").groupBy("key", "i", "j").applyInPandas(across, "a long, b long"))
    return found.distinct()


def links(prints: DataFrame, shared: DataFrame, distance: int = DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Links ``(a, b)`` by all bits between sets of ``shared`` that have a key in common, which have the components of all such links."""
    nodes = prints.groupBy("fp").agg(F.min("lanes").alias("lanes"))
    nodes, _ = materialise(nodes.join(shared.select("fp").distinct(), "fp", "left_semi"), "nodes")
    one = nodes.select(F.col("fp").alias("a"), F.col("lanes").alias("x"))
    two = nodes.select(F.col("fp").alias("b"), F.col("lanes").alias("y"))
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    early = F.pmod(F.xxhash64("key"), F.lit(FIRST)) == 0

    def verified(keys, groups):
        near = candidates(keys.join(groups, "fp"), nodes, distance, run_limit=run_limit)
        return near.join(one, "a").join(two, "b").where(bits <= distance).select("a", "b")

    first_lanes = (F.col("lanes")[0].alias("x"), F.col("lanes")[1].alias("y"))
    joined, _ = materialise(connected_components(verified(shared.where(early), nodes.select("fp", *first_lanes, F.xxhash64("fp").alias("g")))), "joined")
    known = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", *first_lanes, F.xxhash64(F.coalesce("root", "fp")).alias("g"))
    return joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(shared.where(~early), known))


def _similar(sets, similarity: float):
    """The links of a spanning forest of ``sets`` (arrays without repeats) by Jaccard similarity, as index pairs; empty sets are equal."""
    import numpy as np

    n, size = len(sets), np.array([len(s) for s in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(n), size)[np.argsort(number, kind="stable")]
    often = np.bincount(number)
    start = np.cumsum(often) - often
    left, edges = np.arange(n), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            mine = number[at[u] : at[u + 1]]
            runs = often[mine]
            where = np.repeat(start[mine] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            both = np.bincount(owner[where], minlength=n)[left]
            near = both / np.maximum(size[left] + size[u] - both, 1) >= similarity
            if not size[u]:
                near |= size[left] == 0
            edges += [(u, v) for v in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return edges


def similar(df: DataFrame, prints: DataFrame, near: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: float = SIMILARITY, run_limit: int = RUN_LIMIT, shingles: int = SHINGLES) -> DataFrame:
    """Links ``(a, b)`` between text hashes, which have the components of all pairs of ``similarity`` within components of ``near``."""
    import pyarrow as pa

    def run(it):
        import numpy as np

        for b in it:
            sets = [distinct_shingles(t.as_py(), words).view(np.int64) for t in b.column(2)]
            ends = np.cumsum([0, *map(len, sets)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column], names=["family", "text_hash", "shingles"])

    def compare(key, pdf):
        import numpy as np
        import pandas as pd

        own = pdf["text_hash"].to_numpy()
        e = np.array(_similar(pdf["shingles"].tolist(), similarity), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": own[e[:, 0]], "b": own[e[:, 1]]})

    roots, _ = materialise(connected_components(near), "families")
    texts = prints.groupBy("text_hash", "fp").agg(F.min("doc_id").alias("first_id"))
    texts = texts.join(roots, texts["fp"] == roots["node"], "left").select("text_hash", "first_id", F.xxhash64(F.coalesce("root", "fp")).alias("family"))
    texts, _ = materialise(texts, "texts")
    texts = texts.join(texts.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "family").select("family", "text_hash", "first_id")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash"))
    rows = rows.join(texts, rows["doc_id"].eqNullSafe(texts["first_id"]) & (rows["hash"] == texts["text_hash"])).dropDuplicates(["text_hash"])
    sets, _ = materialise(rows.select("family", "text_hash", "text").mapInArrow(run, "family long, text_hash long, shingles array<long>"), "shingles")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / run_limit), F.ceil(F.sum(F.size("shingles")) / shingles)).cast("int")
    own = sets.join(sets.groupBy("family").agg(blocks.alias("blocks")), "family").withColumn("own", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = own.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "text_hash", "shingles")
    return pairs.groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def _components(df: DataFrame, id_col: str, text_col: str, words: int, distance: int, run_limit: int) -> tuple[DataFrame, DataFrame]:
    prints, _ = materialise(sketches(df, id_col, text_col, words), "sketches")
    with scratch(df.sparkSession) as made:
        shared, _ = materialise(shared_keys(keyed(df, text_col, words)), "shared-keys")
        found = similar(df, prints, links(prints, shared, distance, run_limit), id_col, text_col, words, run_limit=run_limit)
        prints = prints.select("doc_id", "text_hash", F.col("text_hash").alias("fp"))
        component = components_of(prints, found)
        made.pop()  # the components, which come last, are read on
    return prints, component


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``df``; the smallest id reachable stands for a component."""
    prints, component = _components(df, id_col, text_col, words, distance, run_limit)
    return prints.join(component, "fp").select("doc_id", "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row of each component: see :func:`simhash.representatives`."""
    return representatives(df, *_components(df, id_col, text_col, words, distance, run_limit), id_col, text_col)
