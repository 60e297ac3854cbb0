import collections
import random

import numpy as np
import pytest

from lectern.llm import simhash, sketch

from .conftest import prose
from .test_dedup import roots


def plain(text):
    h = {int(x) for x in simhash.shingle_hashes(text, 5)}
    out = []
    for m in map(int, sketch._lanes()):
        mixed = []
        for x in h:
            x = x * m % 2**64
            x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 % 2**64
            mixed.append(x ^ x >> 29)
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in mixed) * 2 > len(h)))
    return out


def apart(x, y):
    return int(np.bitwise_count(x ^ y).sum())


@pytest.fixture(scope="module")
def copies():
    """Texts, copies of which a share of the shingles is changed, and others."""
    rng = random.Random(12)
    out = []
    for i in range(40):
        words = prose(rng, 300).split()
        out.append(" ".join(words))
        for share in (0.01, 0.04, 0.4):
            n = int(300 * share)
            at = rng.randrange(300 - n)
            out.append(" ".join([*words[:at], *(f"new{rng.randrange(10**6)}" for _ in range(n)), *words[at + n :]]))
    words = prose(rng, 400).split()
    for i in range(150):  # a large group
        mine = list(words)
        mine[rng.randrange(400)] = f"other{i}"
        out.append(" ".join(mine))
    return out


def test_sketch_equals_plain(rows):
    for r in rows[:5] + rows[60:63]:
        assert [int(x) for x in sketch.sketch(r[1])] == plain(r[1])


@pytest.mark.parametrize("limit", [2048, 12])
def test_components_equal_brute_force(spark, copies, limit):
    n, want = len(copies), jaccard_roots(copies)
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(3)
    got = dict(sketch.near_duplicates(df, run_limit=limit).collect())
    assert got == dict(enumerate(want))
    for i in range(0, 160, 4):  # the changed copies of a text, and not the one that is mostly new
        assert got[i] == got[i + 1] == got[i + 2] == i and got[i + 3] == i + 3
    assert {got[i] for i in range(160, n)} == {160}


def test_deduplicated(docs, rows, empty):
    got = sketch.deduplicated(docs)
    assert got.columns == docs.columns
    top = jaccard_roots([r[1] for r in rows])
    groups = collections.defaultdict(list)
    for i, r in enumerate(top):
        groups[r].append(rows[i][0])
    want = collections.Counter(min((i for i in g if i is not None), default=None) for g in groups.values())
    assert collections.Counter(r["doc_id"] for r in got.collect()) == want
    assert sketch.deduplicated(empty).count() == 0 == sketch.near_duplicates(empty).count()


def jaccard_roots(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    n = len(sets)
    return roots(n, [(a, b) for a in range(n) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


@pytest.mark.parametrize("limit", [2048, 12])
def test_links_are_exact(spark, limit):
    """A family that shares a passage, every pair at about 0.75, and one at about 0.85: only the second is near copies."""
    rng = random.Random(5)
    texts = []
    for own, members in ((43, 90), (20, 60)):
        passage = prose(rng, 260)
        texts += [f"{passage} " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(own)) for _ in range(members)]
    x = [sketch.sketch(t) for t in texts[:90]]
    by_bits = set(roots(90, [(a, b) for a in range(90) for b in range(a) if apart(x[a], x[b]) <= 166]))
    assert len(by_bits) < 5  # fingerprints alone would join nearly all of the first family
    want = jaccard_roots(texts)
    assert want == [*range(90), *[90] * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert dict(sketch.near_duplicates(df, run_limit=limit).collect()) == dict(enumerate(want))
    assert sketch.deduplicated(df).count() == 91


def test_spanning_forest_of_sets():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(24), rng.randrange(25))), np.int64) for _ in range(200)]
    sets += [np.zeros(0, np.int64)] * 2
    want = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if len(u := set(sets[a]) | set(sets[b])) == 0 or len(set(sets[a]) & set(sets[b])) / len(u) >= 0.8])
    assert roots(len(sets), sketch._similar(sets, 0.8)) == want


def test_similar_sets_always_share_a_key():
    """Pairs at 0.8 and just above, of all small sizes and some large ones, and what is different dealt by chance."""
    rng = np.random.default_rng(1)
    for n in [*range(1, 130), 400, 1500, 6000]:
        sets = []
        for _ in range(40 if n < 200 else 4):
            x = np.unique(rng.integers(1, 1 << 63, 2 * n + 2, dtype=np.uint64))
            rng.shuffle(x)
            gone = int(rng.integers(0, n // 5 + 1))
            new = max(0, int((n - gone) / 0.8 + 1e-9) - n)  # as many as similarity 0.8 allows
            new = int(rng.integers(0, new + 1)) if rng.random() < 0.3 else new
            a, b = x[:n], np.concatenate((x[: n - gone], x[n : n + new]))
            assert not len(b) or 5 * (n - gone) >= 4 * (n + new)
            sets += [np.unique(a), np.unique(b)]
        keys, count = sketch.block_keys(sets)
        at = np.concatenate(([0], np.cumsum(count)))
        for i in range(0, len(sets), 2):
            assert not len(sets[i + 1]) or len(np.intersect1d(keys[at[i] : at[i + 1]], keys[at[i + 1] : at[i + 2]])), n
    keys, count = sketch.block_keys([np.zeros(0, np.uint64), np.array([5], np.uint64)])
    assert count.tolist() == [0, 1]
    assert len(sketch.block_keys([])[0]) == 0


@pytest.mark.parametrize("batch", [3, 10_000])
def test_only_shared_keys_stay(spark, batch):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(40)) for _ in range(90)] + [(500 + i, 1) for i in range(30)] + [(7, i) for i in range(200)] + [(900, 3)] * 5
    sets = collections.defaultdict(set)
    for k, f in rows:
        sets[k].add(f)
    want = sorted((k, f) for k, s in sets.items() if len(s) > 1 for f in s)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert sorted(map(tuple, sketch.shared_keys(spark.createDataFrame(rows, "key long, fp long")).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_no_link_is_lost(spark):
    """Families at every similarity about 0.8, of texts of five to four hundred words, beside a passage that many texts share."""
    rng = random.Random(17)
    texts, passage = [], prose(rng, 60)
    for n in [*range(5, 40, 3), 60, 120, 400]:
        for _ in range(5):
            words = [f"w{rng.randrange(10**7)}" for _ in range(n)]
            for changed in (1, max(1, n // 50), max(1, n // 25)):
                mine = list(words)
                for _ in range(changed):
                    mine[rng.randrange(n)] = f"x{rng.randrange(10**7)}"
                texts.append(" ".join(mine))
            texts.append(" ".join([*words, *(f"y{rng.randrange(10**7)}" for _ in range(n // 5))]))
    texts += [f"{passage} {prose(rng, rng.randint(5, 60))}" for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert dict(sketch.near_duplicates(df).collect()) == dict(enumerate(jaccard_roots(texts)))
