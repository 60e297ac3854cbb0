import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import ann, common, forest, simhash

from .conftest import prose


def roots(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = roots(400, [e for e in edges if None not in e])
    assert got == {i: want[i] for e in edges if None not in e and e[0] != e[1] for i in e}


def plain_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute(rows, prints):
    n = len(rows)
    links = [(a, b) for a in range(n) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    group = collections.defaultdict(list)
    for i, r in enumerate(roots(n, links)):
        group[r].append(i)
    out = {}
    for g in group.values():
        low = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out |= {i: low for i in g}
    return [out[i] for i in range(n)]


@pytest.mark.parametrize("limit", [1024, 2])
def test_simhash(spark, docs, rows, empty, limit):
    prints = [plain_print(r[1]) for r in rows]
    want = collections.Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute(rows, prints)))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs, run_limit=limit).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limit", [1024, 3])
def test_dense_fingerprints_lose_no_link(spark, limit):
    rng = random.Random(6)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    n = len(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), run_limit=limit).collect()
    at = {p: i for i, p in enumerate(signed)}
    links = [(at[a], at[b]) for a, b in got]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 3 for a, b in links)
    assert roots(n, links) == roots(n, [(a, b) for a in range(n) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3])


def test_deduplicated(docs, rows):
    prints = [plain_print(r[1]) for r in rows]
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    groups = brute(rows, prints)
    assert len(kept) == len(set(groups)) and {k for k in kept if k is not None} == {g for g in groups if g is not None}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(260, 16))
    out = [(i, base[i].tolist(), int(i % 3)) for i in range(260)]
    for i in range(300, 380):  # near copies of one vector
        out.append((i, (base[0] + rng.normal(size=16) * 0.05).tolist(), 0))
    out += [(400 + i, base[3].tolist(), 0) for i in range(8)] + [(400, base[3].tolist(), 0)]
    out += [(500, None, 0), (501, [], 0), (502, [0.0] * 16, 0), (503, [float("nan")] + [1.0] * 15, 0), (504, [None] + [1.0] * 15, 0), (505, base[5].tolist(), None), (None, base[6].tolist(), 0), (506, [float("inf")] + [1.0] * 15, 1), (507, [1.0, 2.0], 1)]
    return out


@pytest.mark.parametrize("block,sample,most", [(2048, forest.SAMPLE, forest.MOST), (20, forest.SAMPLE, 16), (2048, 48, 20)])
def test_forest(spark, vectors, block, sample, most):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("rep", "v", "key", "leaves", "n", "share")})
    got = collections.defaultdict(list)
    for r in forest.near_duplicates(df, leaf=32, block=block, sample=sample, most=most).collect():
        got[r["vec_id"]].append(tuple(r)[1:])
    good = [(i, v, l) for i, v, l in vectors if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v) and l is not None]
    x = np.array([v for _, v, _ in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([l for *_, l in good])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    order = sorted(range(len(good)), key=lambda k: good[k][0])
    rank = {k: r for r, k in enumerate(order)}
    top = roots(len(good), [(rank[a], rank[b]) for a, b in np.argwhere(link)])
    for k, (i, _, _) in enumerate(good):
        low = good[order[top[rank[k]]]][0]
        assert (int(link[k].sum()), low, low == i) in got[i]
    assert got[500] == [(0, 500, True)] and got[None] == [(0, None, None)] and got[505] == [(0, 505, True)]
    assert sum(map(len, got.values())) == len(vectors)
    assert forest.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [8192, 16])
def test_nearest(spark, vectors, bucket):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, every=20, bucket=bucket).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: v for i, v, _ in vectors if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids, x = np.array(list(good)), np.array(list(good.values()))
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        d = np.sqrt(((x - np.array(good[q])) ** 2).sum(1))
        want = [(d[k], ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        assert all(s == d[np.flatnonzero(ids == v)[0]] for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for _, v in want})
        total += 10
    assert hits / total >= 0.9 and set(got) == {i for i in good if i % 20 == 0}
    assert ann.nearest(df.limit(0)).count() == 0


def test_copies_rank_by_id(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(0, 300)] + [(1000, [5.0, 5.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).where("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and {r["score"] for r in got} == {0.0}
    few = ann.nearest(spark.createDataFrame(rows[:1] + rows[-1:], "vec_id long, embedding array<float>, label int")).collect()
    assert len(few) == 2


def test_long_text_fingerprint():
    t = prose(random.Random(1), 70000)
    assert simhash.fingerprint(t, 3) == plain_print(t)


@pytest.mark.parametrize("kind", ["clusters", "lengths", "far"])
def test_unserved_queries_are_answered_exactly(spark, kind):
    """Tight groups beside even vectors; lengths of very different size; and a few vectors far from all others."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "clusters":
        x[:1800] = x[np.arange(1800) % 20] + rng.normal(size=(1800, 32)) * 0.01
    if kind == "lengths":
        x *= rng.lognormal(sigma=0.7, size=3000)[:, None]
    if kind == "far":
        x[[0, 500, 1000]] *= 50
    order = rng.permutation(3000) if kind == "clusters" else np.arange(3000)
    x = x[order]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, every=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.argsort(d, kind="stable")[:10].tolist()
        assert len(got[q]) == 10
        if kind == "far" and q in (0, 500, 1000):
            assert got[q] == want
        hits += len(set(got[q]) & set(want))
    assert hits >= 0.9 * 600


@pytest.mark.parametrize("indexed", [4, 1])
def test_lengths_are_spaces_of_their_own(spark, indexed):
    """Vectors of a rarer length meet their own kind; groups of uneven density lose no query."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=5).tolist()) for i in range(20)] + [(2000 + i, rng.normal(size=3).tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "salt", "kind", "ids", "n")})
    got = collections.defaultdict(list)
    for r in ann.nearest(df, indexed=indexed).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    of = dict(rows)
    for q, length in ((1000, 5), (2000, 3)):
        want = sorted((np.sqrt(sum((a - b) ** 2 for a, b in zip(v, of[q]))), i) for i, v in rows if len(v) == length and i != q)[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want]
    assert all(len(got[q]) == 10 for q in (0, 100, 200, 300, 1000)) and len(got[2000]) == 3


def test_large_leaves_are_split_further(spark):
    """A sample far smaller than the table leaves large leaves; they end up small, and no link of the tight groups is lost."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12))
    x[1400:] = x[:100] + rng.normal(size=(100, 12)) * 0.01
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicates(df, leaf=32, sample=64, most=64).collect()}
    assert got == dict(enumerate(link.sum(1).tolist()))
    rows = [(0, 12, (t << forest._NODE_BITS) | 1, i, 1, v) for t in range(3) for i, v in enumerate(x.tolist())]
    sent, path = common.materialise(spark.createDataFrame(rows, "label int, dim int, key long, rep long, mult long, v array<double>").withColumn("leaves", F.lit(None).cast("array<long>")), "test")
    small, _ = forest.refined(sent, path, 32, 0.01, 64, 64)
    assert small.groupBy("key").count().agg(F.max("count")).first()[0] <= 64
    held = {r["rep"]: r["leaves"] for r in small.select("rep", "leaves").distinct().collect()}
    assert {(r["rep"], r["key"]) for r in small.select("rep", "key").collect()} == {(i, k) for i, ks in held.items() for k in ks}


def test_more_fingerprints_take_more_blocks():
    assert simhash.blocks_for(10**6) == 5
    sizes = [simhash.blocks_for(10**k) for k in range(6, 15)]
    assert sizes == sorted(sizes) and sizes[-1] > 5
    for b in (5, 6, 7, 8):  # two fingerprints three bits apart agree on one mask at least
        masks = simhash.block_masks(b)
        rng = random.Random(b)
        for _ in range(300):
            flips = 0
            for k in rng.sample(range(64), 3):
                flips |= 1 << k
            assert any(not flips & m for m in masks)
