"""Toxicity: a factorisation machine over hashed terms.

A text's terms are its distinct words and punctuation runs, hashed into ``2**BITS`` buckets. Every bucket
that ``LEAST_DOCS`` documents of the sample hold (the ``ACTIVE`` commonest, if there are more) has a weight and a
factor vector of rank ``RANK``; products of factors are the weights of term pairs (an insult with a group mention,
say). Weights are learnt by FTRL with an L1 term, factors by AdaGrad, together. Training goes in two parts. In the
first all those buckets learn, so that a term which is neutral alone can show what it is worth beside another.
The second starts anew with the buckets that count: those whose share of label 1 is ``LEAST_Z`` standard errors from the
base rate, and those in a pair whose share is ``PAIR_Z`` standard errors from what its terms have alone; pairs are
looked for among the ``LOUDEST`` buckets by the length of their factors. The sample is about ``SAMPLE_ROWS``
labelled documents outside the held-out fold (the documented bound); every whole text is scored, in time
linear in its terms.

Defined cases: null and empty texts score the bias; without labels of both kinds every text scores the
share of label 1 (one half if there are none); repeated rows are scored once each; nulls in the id are
kept; labels, lang, source and ids are no features; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import features

BITS = 20
RANK = 4
SAMPLE_ROWS = 12_000
ACTIVE = 1 << 16
LEAST_DOCS = 4
#: Standard errors from the base rate that a term must be to count as associated.
LEAST_Z = 3.0
#: Standard errors that a pair of terms must be from the shares of its terms alone: there are many pairs.
PAIR_Z = 6.0
LOUDEST = 512
EPOCHS = 3
#: Examples visited at least: small samples are gone through more often.
STEPS = 30_000
THRESHOLD = 0.5
#: Weight of a toxic example in training: they are few.
POSITIVE_WEIGHT = 8.0

_models: dict[int, tuple] = {}


def _extract(texts: list[str]) -> list[bytes]:
    import numpy as np

    return [np.unique(features.spread(features.word_hashes([t])[0], BITS)).astype(np.int32).tobytes() for t in texts]


def _descend(rows, ys, k: int, prior: float, rank: int, epochs: int, seed: int, linear: int = 0):
    """Bias, weights and factors of ``k`` slots after ``epochs`` passes over ``rows`` (arrays of slots), the first ``linear`` without pairs."""
    import numpy as np

    bias, gb = prior, 1.0
    lz, ln, w = np.zeros(k), np.zeros(k), np.zeros(k)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.5, 0.1
    v = np.random.default_rng(seed).normal(0, 0.02, (k, rank))
    gv = np.ones((k, rank))
    order = np.random.default_rng(seed + 1)
    for epoch in range(epochs):
        for j in order.permutation(len(rows)):
            r, y = rows[j], ys[j]
            s = bias + w[r].sum()
            if epoch >= linear:
                f = v[r]
                sums = f.sum(0)
                s += 0.5 * float((sums * sums - (f * f).sum(0)).sum())
            g = 1 / (1 + np.exp(-min(35.0, max(-35.0, s)))) - y
            if y:
                g *= POSITIVE_WEIGHT
            if abs(g) < 1e-4:
                continue
            gb += g * g
            bias -= 0.1 * g / np.sqrt(gb)
            if len(r):
                lz[r] += g - (np.sqrt(ln[r] + g * g) - np.sqrt(ln[r])) / alpha * w[r]
                ln[r] += g * g
                a = lz[r]
                w[r] = np.where(np.abs(a) <= l1, 0.0, -(a - np.sign(a) * l1) / ((beta + np.sqrt(ln[r])) / alpha + l2))
                if epoch >= linear:
                    d = g * (sums - f) + 0.02 * f
                    gv[r] += d * d
                    v[r] = f - 0.05 * d / np.sqrt(gv[r])
    return bias, w, v


def _telling_pairs(rows, ys, loud, k: int):
    """Slots of ``loud`` in a pair whose share of label 1 is far from what the shares of its two terms let expect."""
    import numpy as np

    at = np.full(k, -1)
    at[loud] = np.arange(len(loud))
    has = np.zeros((len(rows), len(loud)), np.float32)
    for i, r in enumerate(rows):
        c = at[r]
        has[i, c[c >= 0]] = 1
    y = np.asarray(ys, np.float32)
    n, pos = has.T @ has, (has * y[:, None]).T @ has
    base = min(1 - 1e-6, max(1e-6, float(y.mean())))
    alone_n, alone = np.diag(n), (np.diag(pos) + base) / (np.diag(n) + 1)
    odds = lambda p: p / (1 - p)
    p = odds(np.clip(alone, 1e-4, 1 - 1e-4))
    both = p[:, None] * p[None, :] / odds(base)  # terms that act apart multiply the odds
    both = both / (1 + both)
    z = np.abs(pos - n * both) / np.sqrt(np.maximum(n * both * (1 - both), 0.25))
    enough = (n >= LEAST_DOCS) & (n < np.minimum(alone_n[:, None], alone_n[None, :]))  # a term that only comes with another tells nothing more
    np.fill_diagonal(enough, False)
    return loud[((z >= PAIR_Z) & enough).any(1)]


def learn(xs: list[bytes], ys: list[int], rank: int = RANK, active: int = ACTIVE, epochs: int = EPOCHS, seed: int = 7) -> bytes:
    """The bias, the buckets that have weights or factors, their weights and factors."""
    import io

    import numpy as np

    def pack(bias, at, w, v):
        out = io.BytesIO()
        np.savez(out, bias=np.float64(bias), at=at.astype(np.int32), w=w.astype(np.float32), v=v.astype(np.float32))
        return out.getvalue()

    total, ones = len(ys), sum(ys)
    none = np.zeros(0)
    prior = float(np.log((ones + 0.5) / (total - ones + 0.5)))
    if not ones or ones == total:
        return pack(prior, none, none, np.zeros((0, rank)))
    rows = [np.frombuffer(x, np.int32) for x in xs]
    df, pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, y in zip(rows, ys, strict=True):
        df[r] += 1
        if y:
            pos[r] += 1

    def only(at, among):
        slot = np.full(1 << BITS, -1)
        slot[at] = np.arange(len(at))
        return [s[s >= 0] for s in (slot[r] for r in among)]

    at = np.sort(np.argsort(-df, kind="stable")[:active])
    at = at[(df[at] >= LEAST_DOCS) & (df[at] < total)]
    epochs = max(epochs, -(-STEPS // total))
    inner = only(at, rows)
    _, _, v = _descend(inner, ys, len(at), prior, rank, epochs, seed)
    # how far a term's share of label 1 is from the base rate, in standard errors
    base = ones / total
    z = np.abs(pos[at] - df[at] * base) / np.sqrt(df[at] * base * (1 - base))
    loud = np.argsort(-(v * v).sum(1) * df[at], kind="stable")[:LOUDEST]
    counts = z >= LEAST_Z
    counts[_telling_pairs(inner, ys, loud, len(at))] = True
    at = at[counts]
    bias, w, v = _descend(only(at, rows), ys, len(at), prior, rank, epochs + 1, seed, 1)
    use = (w != 0) | ((v * v).sum(1) > 0.04 * 0.04 * rank)
    return pack(bias, at[use], w[use], v[use])


def score(model: bytes, texts: list[str]):
    import io

    import numpy as np

    key = hash(model)
    if key not in _models:
        _models.clear()
        m = np.load(io.BytesIO(model))
        slot = np.full(1 << BITS, -1, np.int32)
        slot[m["at"]] = np.arange(len(m["at"]))
        _models[key] = float(m["bias"]), slot, m["w"].astype(float), m["v"].astype(float)
    bias, slot, w, v = _models[key]
    h, sizes = features.word_hashes(texts)
    term = slot[features.spread(h, BITS)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    used = term >= 0
    pair = np.unique(doc[used] * np.int64(1 << BITS) + term[used])  # each term once per text
    doc, term = pair >> BITS, pair & ((1 << BITS) - 1)
    s = bias + np.bincount(doc, w[term], len(texts))
    for k in range(v.shape[1]):
        f = v[term, k]
        s = s + 0.5 * (np.bincount(doc, f, len(texts)) ** 2 - np.bincount(doc, f * f, len(texts)))
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes:
    return features.train(features.labelled_sample(docs, labels, "toxic", sample_rows), _extract, learn)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    return features.scored(docs, fit(docs, labels, sample_rows), score, threshold)
