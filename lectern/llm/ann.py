"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is hashed by ``TABLES`` tables of ``HASHES`` Gaussian projections, quantised to a width that
follows the data's tenth-neighbour distance. A query visits, in each table, its own bucket and the
perturbed buckets in falling estimated success: perturbation sets are generated in the order of the
squared distances from the query's projections to the bucket walls. The number of probes is the smallest
of ``PROBES`` that reaches ``TARGET`` recall on a sample of at most ``SAMPLE`` vectors (the documented
bound; it only fits the width and the probes: every vector is indexed). Candidates are reranked by exact
distance in double precision.

Queries that the buckets do not serve are answered exactly, against all vectors in blocks: those with fewer than ``K``
results, and those whose last result is farther than the distance up to which neighbours of the sample were found
at a rate of ``LEAST``. If no number of probes reaches the target on the sample, all queries are answered so.

Buckets and probes meet in sorted partitions; a bucket over ``BUCKET`` vectors is salted and its probes
go to every salt. A task keeps the ten nearest per query over all its buckets, so rows grow with queries
and not with candidates. Copies of a vector collapse to their smallest ids, as many as a result can show.

Vectors of different lengths are in different spaces: a query's candidates are those of its own length. The ``INDEXED``
commonest lengths have an index each; the vectors of all others are searched exactly, in blocks.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null ids take no part; with fewer candidates all are returned; ties go
to the smaller id; rows that repeat an id are one candidate; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .vectors import matrix, usable

K = 10
EVERY = 100
TABLES = 4
HASHES = 8
WIDTH = 2.25
PROBES = (30, 60, 100, 160, 250, 400, 700)
TARGET = 0.96
LEAST = 0.9
#: Neighbours of the sample whose rate counts together.
BAND = 128
#: Of queries in a block of the exact search.
QUERIES = 4096
SAMPLE = 4096
SAMPLE_QUERIES = 256
BUCKET = 8192
SALTS = 64
#: Lengths of vectors, commonest first, that get an index of their own.
INDEXED = 4

_LAYOUT = ("key", "salt", "kind", "ids", "v")


class Hasher:
    """The tables' projections, the same in every process."""

    def __init__(self, dim: int, width: float, tables: int = TABLES, hashes: int = HASHES, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng([seed, dim])
        self.a = rng.normal(size=(tables, dim, hashes)) / width
        self.b = rng.uniform(size=(tables, hashes))
        self.mult = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64) | 1
        self.tables, self.hashes = tables, hashes

    def places(self, x, t: int):
        """Quantised projections and, as fractions, how far into its cell each one is."""
        import numpy as np

        f = x @ self.a[t] + self.b[t]
        h = np.floor(f)
        return h.astype(np.int64), f - h

    def keys(self, h, t: int):
        """64-bit bucket numbers; the table is part of them."""
        import numpy as np

        with np.errstate(over="ignore"):
            k = (h * self.mult[t]).sum(-1) * np.int64(self.tables) + np.int64(t)
        return k

    def probes(self, x, t: int, most: int):
        """Bucket numbers to visit for each row of ``x``, in falling estimated success: own one first."""
        import numpy as np

        h, f = self.places(x, t)
        out = []
        for cell, frac in zip(h, f, strict=True):
            # walls by distance: below is number j, above is number j + hashes
            wall = np.concatenate((frac, 1 - frac))
            order = np.argsort(wall, kind="stable")
            cost = (wall[order] ** 2).tolist()
            way = [(int(j) % self.hashes, -1 if j < self.hashes else 1) for j in order]
            visit, heap = [cell], [(cost[0], (0,))]
            while heap and len(visit) <= most:
                c, s = heapq.heappop(heap)
                dims = [way[i][0] for i in s]
                if len(set(dims)) == len(dims):
                    moved = cell.copy()
                    for i in s:
                        moved[way[i][0]] += way[i][1]
                    visit.append(moved)
                last = s[-1] + 1
                if last < len(cost):
                    heapq.heappush(heap, (c - cost[last - 1] + cost[last], (*s[:-1], last)))
                    heapq.heappush(heap, (c + cost[last], (*s, last)))
            out.append(self.keys(np.array(visit), t))
        return out


def _distances(q, x):
    """Exact Euclidean distances, in double precision, of each row of ``q`` to each row of ``x``."""
    import numpy as np

    out = np.empty((len(q), len(x)))
    step = max(1, 2_000_000 // max(1, x.size))
    for i in range(0, len(q), step):
        d = x[None, :, :] - q[i : i + step, None, :]
        out[i : i + step] = np.sqrt((d * d).sum(-1))
    return out


def fit(x, k: int = K, probes: tuple[int, ...] = PROBES, target: float = TARGET) -> tuple[float, int, float]:
    """Width and number of probes for data of which ``x`` is a sample, and the distance up to which they find neighbours; below 0 if the target is missed."""
    import numpy as np

    n = len(x)
    if n < 2:
        return 1.0, probes[0], -1.0
    q = np.arange(min(n, SAMPLE_QUERIES))
    d = _distances(x[q], x)
    d[q, q] = np.inf
    k = min(k, n - 1)
    near = np.argpartition(d, k - 1, 1)[:, :k]
    radius = float(np.median(np.take_along_axis(d, near, 1).max(1)))
    width = WIDTH * radius if radius > 0 else 1.0
    hasher = Hasher(x.shape[1], width)
    keys = [hasher.keys(hasher.places(x, t)[0], t) for t in range(TABLES)]
    visits = [hasher.probes(x[q], t, probes[-1]) for t in range(TABLES)]
    for most in probes:
        hit = np.array([any(keys[t][c] in seen[t] for t in range(TABLES)) for i in q for seen in [[set(visits[t][i][: most + 1].tolist()) for t in range(TABLES)]] for c in near[i]])
        if hit.sum() >= target * near.size:
            far = np.take_along_axis(d, near, 1).ravel()
            order, reach = np.argsort(far, kind="stable"), -1.0
            for at in range(0, len(order), BAND):
                band = order[at : at + BAND]
                if hit[band].mean() < LEAST:
                    break
                reach = float(far[band[-1]])
            return width, most, reach
    return width, probes[-1], -1.0


def _merge(best: dict, qid: int, ids, dist, k: int) -> None:
    import numpy as np

    if qid in best:
        ids, dist = np.concatenate((best[qid][0], ids)), np.concatenate((best[qid][1], dist))
    order = np.lexsort((ids, dist))
    ids, dist = ids[order], dist[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    best[qid] = ids[first], dist[first]


def _collapsed(rows: DataFrame, k: int) -> DataFrame:
    """``(ids, v)``: the k + 1 smallest ids of each vector, in two steps, so that one with very many copies is no single task."""
    some = Window.partitionBy("v", "salt").orderBy("vec_id")
    all_ = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("i", F.row_number().over(some)).where(F.col("i") <= k + 1)
    return ids.withColumn("i", F.row_number().over(all_)).where(F.col("i") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v")


def _by_blocks(ids: DataFrame, queries: DataFrame, n: int, many: int, bucket: int) -> DataFrame:
    """All vectors against ``many`` queries: every block of queries meets every block of vectors of its length."""
    asks, salts = -(-many // QUERIES), -(-n // bucket)
    numbers = lambda size, kind: F.explode(F.sequence(F.lit(0).cast(kind), F.lit(size - 1).cast(kind)))
    place = F.size("v").cast("long") * asks
    data = ids.withColumn("ask", numbers(asks, "long")).select((place + F.col("ask")).alias("key"), F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"), F.lit(0).alias("kind"), "ids", "v")
    queries = queries.select((place + F.pmod(F.xxhash64("ids"), F.lit(asks))).alias("key"), numbers(salts, "int").alias("salt"), F.lit(1).alias("kind"), "ids", "v")
    return data.select(*_LAYOUT).union(queries.select(*_LAYOUT))


def _ranked(met: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query among the vectors that it meets at one key and salt."""
    import pyarrow as pa

    def search(it):
        import numpy as np

        best: dict = {}

        def give():
            q = [i for i, (a, _) in best.items() for _ in a]
            out = pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([a for a, _ in best.values()]), pa.int64()), pa.array(np.concatenate([d for _, d in best.values()]), pa.float64())], names=["query_id", "vec_id", "score"])
            best.clear()
            return out

        place, x, owners, mine = None, [], [], None
        for b in it:
            key, salt, kind = (b.column(i).to_numpy() for i in range(3))
            own, v = b.column(3), b.column(4)
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1]))))
            for s, e in zip(cut, np.append(cut[1:], len(key))):
                here = int(key[s]), int(salt[s])
                flat = v.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)  # of one length at one key
                if here != place:
                    place, x, owners, mine = here, [], [], None
                if kind[s] == 0:  # vectors come first; salts bound how many there are
                    x.append(flat)
                    owners += own.slice(s, e - s).to_pylist()
                    continue
                if not x:
                    continue
                if mine is None:
                    mine = np.concatenate(x)
                qids = [i[0] for i in own.slice(s, e - s).to_pylist()]
                for at in range(0, len(qids), 512):
                    d = _distances(flat[at : at + 512], mine)
                    for i, qid in enumerate(qids[at : at + 512]):
                        take = min(k + 1, d.shape[1])
                        edge = np.partition(d[i], take - 1)[take - 1]
                        near = np.flatnonzero(d[i] <= edge)
                        got = [(o, d[i, j]) for j in near for o in owners[j] if o != qid]
                        if got:
                            _merge(best, qid, np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got]), k)
            if len(best) > 100_000:
                yield give()
        if best:
            yield give()

    met = met.repartition("key", "salt").sortWithinPartitions("key", "salt", "kind")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, bucket: int = BUCKET, indexed: int = INDEXED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id ``every`` divides."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(indexed + 1).collect()
    if not dims:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = None
    for d in dims[:indexed]:
        own = _of_length(rows.where(F.size("v") == d["dim"]), d["dim"], d["n"], every, k, bucket)
        out = own if out is None else out.unionByName(own)
    if len(dims) > indexed:  # rarer lengths: exactly
        rest, _ = materialise(rows.where(~F.size("v").isin([d["dim"] for d in dims[:indexed]])), "rare-lengths")
        asked = rest.where(F.col("vec_id") % every == 0).distinct().select(F.array("vec_id").alias("ids"), "v")
        own = _ranked(_by_blocks(_collapsed(rest, k), asked, rest.count(), max(1, asked.count()), bucket), k)
        out = own if out is None else out.unionByName(own)
    return out


def _of_length(rows: DataFrame, dim: int, n: int, every: int, k: int, bucket: int) -> DataFrame:
    """:func:`nearest` over the ``n`` vectors of one length."""
    import pyarrow as pa

    share = min(1.0, 0.9 * SAMPLE / n)
    # a sample of bounded size: the driver fits two numbers on it
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    width, most, reach = fit(matrix([r["v"] for r in sample]) if sample else matrix([[0.0] * dim]), k)
    ids = _collapsed(rows, k)

    def index(it):
        h = Hasher(dim, width)
        for b in it:
            v = b.column("v")
            x = matrix(v.to_pylist())
            for t in range(TABLES):
                keys = h.keys(h.places(x, t)[0], t)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([0] * len(x), pa.int32()), b.column("ids"), v], names=["key", "kind", "ids", "v"])

    def ask(it):
        h = Hasher(dim, width)
        for b in it:
            x, own = matrix(b.column("v").to_pylist()), b.column("ids")
            for t in range(TABLES):
                for at in range(0, len(x), 64):
                    visits = h.probes(x[at : at + 64], t, most)
                    row = pa.array([at + i for i, keys in enumerate(visits) for _ in keys], pa.int64())
                    keys = [int(y) for z in visits for y in z]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([1] * len(keys), pa.int32()), own.take(row), b.column("v").take(row)], names=["key", "kind", "ids", "v"])

    layout = "key long, kind int, ids array<long>, v array<double>"
    asked = rows.where(F.col("vec_id") % every == 0).distinct().select(F.array("vec_id").alias("ids"), "v")

    def by_buckets():
        data, _ = materialise(ids.mapInArrow(index, layout), "buckets")
        queries = asked.mapInArrow(ask, layout)
        salts = data.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("salts")).where("salts > 1")
        data = data.join(salts, "key", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("ids"), F.col("salts"))).cast("int"))
        queries = queries.join(salts, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
        return data.select(*_LAYOUT).union(queries.select(*_LAYOUT))

    asked, _ = materialise(asked, "queries")
    if reach < 0:
        return _ranked(_by_blocks(ids, asked, n, max(1, asked.count()), bucket), k)
    found, _ = materialise(_ranked(by_buckets(), k), "found")
    served = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("last")).where((F.col("n") == k) & (F.col("last") <= reach)).select("query_id")
    left, _ = materialise(asked.join(served, F.col("ids")[0] == served["query_id"], "left_anti"), "unserved")
    many = left.count()
    if not many:
        return found
    return found.join(served, "query_id", "left_semi").unionByName(_ranked(_by_blocks(ids, left, n, many, bucket), k))
