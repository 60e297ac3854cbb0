import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import secrets, sharding


def test_hilbert_curve_visits_neighbours(spark):
    bit = lambda k: F.shiftright("id", k).bitwiseAND(15).cast("int")
    rows = spark.range(4096).select(bit(8).alias("a"), bit(4).alias("b"), bit(0).alias("c"))
    got = rows.select("a", "b", "c", sharding.hilbert_index([F.col(x) for x in "abc"]).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(4096))
    assert all(sum(abs(x[k] - y[k]) for k in range(3)) == 1 for x, y in zip(got, got[1:]))


def check_shards(got, rows, shards):
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    last = {s: max(r["curve"] for r in got if r["shard"] == s) for s in slots}
    assert all(last[a] <= min(r["curve"] for r in got if r["shard"] == b) for a, b in zip(sorted(slots), sorted(slots)[1:]))


def test_shards(docs, rows, empty):
    check_shards(sharding.shard(docs).collect(), rows, 40)
    check_shards(sharding.shard(docs, shards=7, split_rows=5).collect(), rows, 7)
    assert sharding.shard(empty).count() == 0


def test_rows_that_are_equal_spread_over_parts(spark):
    """Null and repeated ids with equal metadata: no part of a cell holds much more than its share."""
    df = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(4).alias("n_chars"))
    got = sharding.shard(df, shards=3, split_rows=100).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(3) for k in range(300)]
    base = sharding.measured(df, "doc_id", "text", sharding.DIMENSIONS, F.monotonically_increasing_id().alias("__row"))
    part = F.pmod(F.xxhash64("__row"), F.lit(9))
    assert base.groupBy(part).count().agg(F.max("count")).first()[0] < 200


def test_written_shards(spark, docs, rows, tmp_path):
    """Every row is there, null and repeated ids too; shards have several files."""
    sharding.write_shards(docs.withColumnRenamed("part", "shard_of"), str(tmp_path / "s"), shards=4, file_rows=8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((r[0], r[1]) for r in rows)
    files = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "s").glob("shard=*")]
    assert len(files) == 4 and min(files) > 1


def test_files_can_be_pruned(spark, tmp_path):
    """A filter on any dimension meets fewer files than after a split by chance."""
    import pyarrow.parquet as pq

    rng = random.Random(3)
    rows = [(i, "t" * rng.randint(1, 9), rng.choice("abcdefgh"), f"source{rng.randint(0, 31):02d}", rng.randint(0, 9999)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sharding.write_shards(df, str(tmp_path / "curve"))
    df.repartition(40).write.parquet(str(tmp_path / "chance"))

    def met(folder, column, value):
        n = 0
        for f in folder.rglob("*.parquet"):
            m = pq.ParquetFile(f).metadata
            at = m.schema.names.index(column)
            s = [m.row_group(g).column(at).statistics for g in range(m.num_row_groups)]
            n += min(x.min for x in s) <= value <= max(x.max for x in s)
        return n

    asked = (("lang", "c"), ("source", "source17"), ("n_chars", 5000))
    curve, chance = ([met(tmp_path / at, *a) for a in asked] for at in ("curve", "chance"))
    assert all(a <= 0.75 * b for a, b in zip(curve, chance)) and sum(curve) <= 0.6 * sum(chance)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, empty):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n, a=letters: "".join(rng.choice(a) for _ in range(n))
    texts = [None, "", "Password: hunter22 and secret=token:abcdefgh", "🙂🙂 API_KEY = 'abc.def-12' é AKIA" + key(16, "ABCDEFGH12345678") + " AKIA12", "x " + key(40, "0123456789abcdef") + " y token=" + key(30)]
    texts += [f"blob {key(40)} end" for _ in range(30)] + ["aaaaaaaaaaaaaaaaaaaa1111111111111111111111 abcdefghijklmnopqrstuvwxyz0123456789", "averyveryverylongwordwithoutanydigits " * 3]
    texts += ["".join(rng.choice(["token", "=", ":", " ", '"', "api", "_key", "AKIA", "0a1b2c3d4e5f", "ZZZZ9999", "x", "é", "🙂"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    names = ("assign", "access", "hex")
    for i, t in enumerate(texts):
        want = base(t or "")
        line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), t
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(filter(None, line.split(","))) <= set(filter(None, r["spans"].split(",")))
    random_found = sum("random:" in got[i]["spans"] for i in range(5, 35))
    assert random_found >= 24 and "random:" not in got[35]["spans"] and "random:" not in got[36]["spans"]
    assert secrets.digest(secrets.scan(empty)).count() == 0


def test_redaction(spark):
    rows = [(1, "a password=abcdefgh b", "s", 21), (2, None, None, None), (3, "clean", "x", 5), (4, "password=" + "0a" * 15 + "!", "y", 0)]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "a [secret] b", "s", 12), (2, None, None, None), (3, "clean", "x", 5), (4, "[secret]!", "y", 9)]


def test_sources_with_a_long_common_prefix_differ_on_the_curve(spark):
    rows = [(i, "text", "en", f"https://example.org/source_{i % 20:03d}" if i % 25 else None, 4) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard(df).join(df.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == 800 and len({r["curve"] for r in got}) >= 10
    of = {s: {r["curve"] for r in got if r["source"] == s} for s in {r["source"] for r in got}}
    assert all(len(c) == 1 for c in of.values())


ENCODED = {"base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "HEX": "0123456789ABCDEF"}
PARTS = "get set user account manager factory handler request response list total index value config service client server update delete create find load save parse build stream reader writer token-less cache queue thread worker session profile".split()


def natural_names(rng, n):
    """Identifiers, paths, slugs, compounds and numbers of 20 or more characters."""
    out = []
    while len(out) < n:
        w = [rng.choice(PARTS).replace("-", "") for _ in range(rng.randint(3, 6))]
        t = rng.choice(["_".join(w), "-".join(w), "/".join(w), "".join(x.title() for x in w), "".join(w), "".join(w) + str(rng.randint(1, 2030)), f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-" + "-".join(w), str(rng.randrange(10**21, 10**24))])
        if len(t) >= 20:
            out.append(t)
    return out


def plain_examined(token):
    """The battery and the natural null, symbol by symbol."""
    core = token.rstrip("=")
    name, alphabet = next(((n, a) for n, p, a in secrets.ENCODINGS if re.match(p, core)), (None, None))
    if name is None:
        return None
    if name in ("hex", "base32", "base36"):
        core = core.upper()
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    x, n, a = [alphabet.index(c) for c in core], len(core), len(alphabet)
    g = min(a, max(2, n // 5))
    cells, width = [0] * g, [0] * g
    for i in range(a):
        width[i * g // a] += 1
    for v in x:
        cells[v * g // a] += 1
    chi = sum((o - n * w / a) ** 2 / (n * w / a) for o, w in zip(cells, width))
    df = g - 1
    ps = [tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    high = [v >= a / 2 for v in x]
    one = sum(high)
    mean = 2 * one * (n - one) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(u != v for u, v in zip(high, high[1:]))
    ps.append(2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0)
    m = sum(x) / n
    power = sum((v - m) ** 2 for v in x)
    r = sum((u - m) * (v - m) for u, v in zip(x, x[1:])) / power if power else None
    ps.append(2 * tail(abs(r * math.sqrt(n) + 1 / math.sqrt(n))) if power else 0)
    half = -sum(math.log(min(1, max(p, 1e-20))) for p in ps)
    ratios, null, deviation = secrets.log_ratios(name, alphabet)
    far = (sum(ratios[v] for v in x) - n * null) / (secrets.WIDER * deviation * math.sqrt(n))
    return math.exp(-half) * (1 + half + half * half / 2), tail(far)


def test_examinations_equal_plain_ones(spark):
    rng = random.Random(21)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(6, 120))) for a in ENCODED.values() for _ in range(30)] + natural_names(rng, 60) + ["a" * 30, "01" * 20, "x.y", "AAAAAAAAAABBBBBBBBBB=="]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.examined(F.col("t")).alias("p")).collect()
    for r in got:
        want = plain_examined(r["t"])
        assert (r["p"] is None) == (want is None)
        if want:
            assert abs(r["p"]["battery"] - want[0]) < 2e-5 and abs(r["p"]["natural"] - want[1]) < 2e-5, (r, want)


def test_natural_models_are_distributions():
    for name, _, alphabet in secrets.ENCODINGS:
        p = secrets.natural_model(name, alphabet)
        assert len(p) == len(alphabet) and min(p) > 0 and abs(sum(p) - 1) < 1e-9
        _, mean, deviation = secrets.log_ratios(name, alphabet)
        assert mean < 0 < deviation


def test_discoveries_are_benjamini_and_hochberg():
    rng = random.Random(5)
    for _ in range(200):
        steps = [rng.choice([0, 1, rng.randint(0, 60), rng.randint(0, 400)]) for _ in range(rng.randint(0, 40))]
        first = secrets.discoveries([(1, s, n) for s, n in collections.Counter(steps).items()])[1]
        p = sorted(10 ** (-s / 20) for s in steps)
        most = max((k for k in range(1, len(p) + 1) if p[k - 1] <= secrets.RATE * k / len(p)), default=0)
        assert sum(s >= first for s in steps) == most


@pytest.mark.parametrize("share", [0.5, 0.03])
def test_false_discoveries_and_recall(spark, share):
    """Planted keys are found and natural strings left alone, whichever of them is rare."""
    rng = random.Random(8)
    n = 1200
    keys = int(n * share)
    planted = ["".join(rng.choice(a) for _ in range(rng.choice([20, 24, 32, 40, 64]))) for a in (list(ENCODED.values())[k % 4] for k in range(keys))]
    rows = [(i, f"see {t} there") for i, t in enumerate(planted + natural_names(rng, n - keys))]
    got = [r["spans"] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).orderBy("doc_id").collect()]
    found, false = sum("random" in s for s in got[:keys]), sum("random" in s for s in got[keys:])
    assert found >= 0.85 * keys and false <= max(1, 2 * secrets.RATE * (found + false)), (found, keys, false)


def test_rest_of_a_covered_run_and_base_values(spark):
    rng = random.Random(3)
    key = "".join(rng.choice(ENCODED["base62"]) for _ in range(40))
    rows = [(1, f"{key}_0123456789abcdef01234567"), (None, "x" * 100_000 + f" {key} "), (3, f"token = '{rng.getrandbits(160):040x}' password=aaaaaaaaaaaaaaaaaaaa"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("base", "found", "p", "candidates", "row")})
    got = {(r["doc_id"], r["n_assign"]): r for r in secrets.digest(secrets.scan(df)).collect()}
    assert got[1, 0]["spans"] == "random:0:41,hex:41:65" and got[None, 0]["spans"].startswith("random:100001:")
    assert got[3, 2]["n_random_base"] == 2 and got[3, 0]["spans"] == ""


def plain_hilbert(x, bits):
    """Position on the curve of a point, by Skilling's method on plain integers."""
    x, n, q = list(x), len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def test_shards_equal_plain_ones(spark):
    """Every row's shard and slot: steps by sorted values, the curve on integers, one sort, and cuts."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["", "é", "word " * rng.randint(1, 30)]), rng.choice(["de", "en", "fr", None]), rng.choice([None, *(f"source/{k:03d}" for k in range(30))]), rng.choice([None, rng.randint(0, 500)])) for i in range(700)]
    rng.shuffle(rows)
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    raw = lambda v: (v is not None, (v or "").encode())
    number = lambda v: -1.0 if v is None else float(v)
    steps = []
    for column, order in ((2, raw), (3, raw), (4, number)):
        values = sorted(order(r[column]) for r in rows)
        cuts = {values[math.ceil(len(values) * k / 16) - 1] for k in range(1, 16)}
        steps.append([sum(order(r[column]) > c for c in cuts) for r in rows])
    keyed = sorted((plain_hilbert(s, 4), r[0], zlib.crc32((r[1]).encode()), len(r[1].encode()) + 16) for r, s in zip(rows, zip(*steps)))
    want = {}
    for at, (curve, i, crc, size) in enumerate(keyed):
        s = at * 40 // len(rows)
        want[i] = (size, crc, curve, s, at - -(-s * len(rows) // 40))
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["curve"], r["shard"], r["slot"]) for r in got} == want


@pytest.mark.parametrize("split_rows", [sharding.SPLIT_ROWS, 700])
def test_steps_are_exact_on_many_rows(spark, split_rows):
    """Cuts are quantiles of all rows, however many values there are; those of a sample or a sketch differ."""
    rng = random.Random(21)
    n = 9000
    names, numbers = list(range(n)), list(range(n))
    rng.shuffle(names)
    rng.shuffle(numbers)
    rows = [(i, None if names[i] < 100 else f"é/{names[i]:05d}", rng.choice(["de", "en", "en", None]), numbers[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long").withColumn("text", F.lit("x"))
    got = {r["doc_id"]: (r["curve"], r["shard"], r["slot"]) for r in sharding.shard(df, split_rows=split_rows).collect()}
    steps = []
    for column, order in ((2, lambda v: (v is not None, v or "")), (1, lambda v: (v is not None, v or "")), (3, float)):
        values = sorted(order(r[column]) for r in rows)
        cuts = {values[math.ceil(n * k / 16) - 1] for k in range(1, 16)}
        steps.append([sum(order(r[column]) > c for c in cuts) for r in rows])
    keyed = sorted((plain_hilbert(s, 4), r[0]) for r, s in zip(rows, zip(*steps)))
    assert got == {i: (curve, s, at - -(-s * n // 40)) for at, (curve, i) in enumerate(keyed) for s in [at * 40 // n]}


def test_cuts_count_every_row(spark):
    """Rare values count, a value of most rows takes most steps, and values on the edges of ranges are found."""
    rows = spark.range(7001).select(F.when(F.col("id") < 6000, F.lit(5.0)).otherwise(F.col("id") + 0.5).alias("__o0"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("__o1"))
    data = rows.collect()
    n, cuts = sharding.exact_cuts(rows.repartition(5), ["__o0", "__o1"], 16, 50)
    assert n == 7001
    for got, column, order in ((cuts[0], "__o0", float), (cuts[1], "__o1", lambda v: (v is not None, v or ""))):
        values = sorted((r[column] for r in data), key=order)
        assert got == [values[math.ceil(n * k / 16) - 1] for k in range(1, 16)]
    assert sharding.exact_cuts(rows.limit(0), ["__o0", "__o1"], 16, 50) == (0, [[], []])
