import collections
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import features, quality, toxicity

from .conftest import prose


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        bad, rude = i % 6 == 0, i % 5 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if rude:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"]))
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 12 else [rng.choice(words)] * 40
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude and not bad)))
    docs += [(1000, None), (1001, ""), (None, "some text"), (0, docs[0][1])]
    labels += [(None, 0, 1), (5, None, None), (1, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels[:700])


@pytest.mark.parametrize("model,col,threshold", [(quality, 0, 0.3), (toxicity, 1, 0.5)])
def test_held_out_accuracy(labelled, model, col, threshold):
    docs, labels, truth = labelled
    got = model.classify(docs, labels).collect()
    assert len(got) == docs.count()
    right = total = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) and r["held_out"] == held(r["doc_id"])
        if r["held_out"] and r["doc_id"] in truth:
            total += 1
            right += r["predicted"] == truth[r["doc_id"]][col]
    assert right / total > 0.9, (right, total)


@pytest.mark.parametrize("model", [quality, toxicity])
def test_held_out_labels_teach_nothing(labelled, model):
    docs, labels, _ = labelled
    name = "quality" if model is quality else "toxic"
    flipped = labels.withColumn(name, F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0, 1 - F.col(name)).otherwise(F.col(name)))
    assert model.fit(docs, labels) == model.fit(docs, flipped)


@pytest.mark.parametrize("model", [quality, toxicity])
def test_no_labels(spark, labelled, empty, model):
    docs, labels, _ = labelled
    none = labels.limit(0)
    assert {r["score"] for r in model.classify(docs.limit(5), none).collect()} == {0.5}
    assert model.classify(empty, none).count() == 0


def test_pairs_matter():
    """Label 1 needs both terms: linear weights alone cannot tell it."""
    rng = random.Random(1)
    xs, ys = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        xs.append(" ".join(rng.sample("k l m n o p q r s t".split(), 4) + ["insult"] * a + ["group"] * b))
        ys.append(int(a and b))
    model = toxicity.learn(toxicity._extract(xs), ys, epochs=6)
    s = toxicity.score(model, ["k l insult group", "k l insult", "k l group", "k l"])
    assert s[0] > 0.5 > max(s[1:])


@pytest.mark.parametrize("rule", ["xor", "same"])
def test_pairs_of_terms_that_are_neutral_alone(rule):
    """The label depends on the pair only: each term alone is at the base rate."""
    rng = random.Random(2)
    xs, ys = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        xs.append(" ".join(rng.sample("k l m n o p q r s t".split(), 4) + ["insult"] * a + ["group"] * b))
        ys.append(int((a != b) == (rule == "xor")))
    s = toxicity.score(toxicity.learn(toxicity._extract(xs), ys), ["k l insult group", "k l insult", "k l group", "k l"])
    assert [bool(x > 0.5) for x in s] == [rule == "same", rule == "xor", rule == "xor", rule == "same"]


def test_factorisation_machine_equals_all_pairs(labelled):
    """Scores in linear time against the sum over all pairs of a text's distinct terms."""
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    m = np.load(io.BytesIO(model))
    slot = {int(a): i for i, a in enumerate(m["at"])}
    texts = [r["text"] or "" for r in docs.limit(60).collect()] + ["idiot idiot scum", "x " * 30_000]
    for t, got in zip(texts, toxicity.score(model, texts)):
        own = [slot[b] for b in np.frombuffer(toxicity._extract([t])[0], np.int32).tolist() if b in slot]
        s = float(m["bias"]) + sum(float(m["w"][i]) for i in own) + sum(float(m["v"][i].astype(float) @ m["v"][j].astype(float)) for k, i in enumerate(own) for j in own[:k])
        assert abs(got - 1 / (1 + math.exp(-max(-35, min(35, s))))) < 1e-6


def test_quality_equals_plain_ftrl():
    """Follow the regularised leader over dictionaries, one weight at a time, and a plain dot product."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 30)) + " BAD!!" * (i % 3 == 0) for i in range(120)]
    ys = [int(i % 3 > 0) for i in range(120)]

    def grams(t):
        h = [zlib.crc32(x.encode()) for c in t.split() for x in re.findall(r"\w+|[^\w\s]+", c.lower())]
        mix = lambda x: (x * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.BITS)
        out = [mix(x) for x in h]
        for a, b in zip(h, h[1:]):
            f = (a * 0x85EBCA77 + b) % 2**64
            out.append(quality.REPEATED if a == b else mix(f ^ f >> 29))
        n = collections.Counter(out)
        return {k: c * quality.SCALE / len(out) for k, c in n.items()}

    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else quality.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for t, y in zip(texts, ys):
            x = grams(t) | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.score(quality.ftrl(quality._extract(texts), ys), texts)
    for t, s in zip(texts, got):
        want = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in (grams(t) | {"bias": 1.0}).items())))
        assert abs(s - want) < 1e-4


def test_sample_is_bounded_in_rows(spark):
    """Twenty labels, of which one belongs to very many rows: ids and rows keep to the bound."""
    rows = [(1, f"text {i}") for i in range(4000)] + [(1, "same")] * 3000 + [(i, f"other {i}") for i in range(2, 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("label", "order", "__n")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)], "doc_id long, toxic int")
    for bound in (100, 400):
        n = features.labelled_sample(docs, labels, "toxic", bound).count()
        assert 0 < n <= 1.5 * bound


@pytest.mark.parametrize("model", [quality, toxicity])
def test_long_texts_and_clashing_names(spark, labelled, model):
    docs, labels, _ = labelled
    long = spark.createDataFrame([(9000, "word idiot " * 200_000), (9000, "word idiot " * 200_000)], "doc_id long, text string").withColumn("label", F.lit("x"))
    names = ("score", "predicted", "held_out", "order", "toxic", "quality", "model", "x")
    got = model.classify(docs.union(long).withColumns({c: F.lit(None).cast("string") for c in names}), labels)
    assert got.count() == docs.count() + 2 and got.where("doc_id = 9000").distinct().count() == 1
