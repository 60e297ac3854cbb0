"""Quality classifier: logistic regression on hashed word n-grams, by follow the regularised leader.

Features are words and punctuation runs and their bigrams, hashed into ``2**BITS`` buckets, as shares
of the text's n-grams; bigrams of a word with itself share one bucket. FTRL-proximal visits a sample of about ``SAMPLE_ROWS`` labelled documents
(the documented bound; all labelled documents if there are fewer) in hash order, ``EPOCHS`` times;
its L1 term leaves a sparse weight vector. A score is one sparse dot product over the whole text.

Defined cases: null and empty texts score the bias; without labels of both kinds every text scores the
share of label 1 (one half if there are none); repeated rows are scored once each; nulls in the id are
kept; labels, lang, source and ids are no features; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import features

BITS = 18
SAMPLE_ROWS = 10_000
EPOCHS = 2
THRESHOLD = 0.3
SCALE = 20.0
#: The bucket of all bigrams of a word with itself.
REPEATED = 0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

_models: dict[int, tuple] = {}


def ngrams(texts: list[str], bits: int = BITS):
    """Bucket of every unigram and bigram of each text, in two arrays, with the unigrams' and bigrams' numbers."""
    import numpy as np

    h, sizes = features.word_hashes(texts)
    one = features.spread(h, bits)
    if not len(h):
        return one, sizes, one, np.zeros_like(sizes)
    first = h[:-1].astype(np.uint64) * np.uint64(0x85EBCA77) + h[1:]
    ends = np.cumsum(sizes)
    inner = np.ones(len(h), bool)
    inner[ends[sizes > 0] - 1] = False  # a text's last word starts no bigram
    two = features.spread(first ^ (first >> np.uint64(29)), bits)
    two[h[:-1] == h[1:]] = REPEATED
    two = two[inner[:-1]]
    return one, sizes, two, np.maximum(sizes - 1, 0)


def _extract(texts: list[str]) -> list[bytes]:
    import numpy as np

    out = []
    for t in texts:
        one, _, two, _ = ngrams([t])
        x, n = np.unique(np.concatenate((one, two)), return_counts=True)
        out.append(x.astype(np.int32).tobytes() + (n * (SCALE / max(1, n.sum()))).astype(np.float32).tobytes())
    return out


def ftrl(xs: list[bytes], ys: list[int], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> bytes:
    """Weights and, last, the bias, as 32-bit floats."""
    import numpy as np

    size, ones = 1 << bits, sum(ys)
    if not ones or ones == len(ys):
        w = np.zeros(size + 1, np.float32)
        w[-1] = np.log((ones + 0.5) / (len(ys) - ones + 0.5))
        return w.tobytes()
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[-1] = 0.0

    def weights(i):
        a = z[i]
        return np.where(np.abs(a) <= penalty[i], 0.0, -(a - np.sign(a) * penalty[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for x, y in zip(xs, ys, strict=True):
            k = len(x) // 8
            i = np.append(np.frombuffer(x, np.int32, k), size)
            v = np.append(np.frombuffer(x, np.float32, k, 4 * k), 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(size + 1)).astype(np.float32).tobytes()


def score(model: bytes, texts: list[str]):
    import numpy as np

    key = hash(model)
    if key not in _models:
        _models.clear()
        _models[key] = np.frombuffer(model, np.float32)
    w = _models[key]
    one, n1, two, n2 = ngrams(texts)
    s = (features.row_sums(w[one], n1) + features.row_sums(w[two], n2)) * SCALE / np.maximum(n1 + n2, 1) + float(w[-1])
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    return features.train(features.labelled_sample(docs, labels, "quality", sample_rows), _extract, ftrl)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    return features.scored(docs, fit(docs, labels, sample_rows), score, threshold)
