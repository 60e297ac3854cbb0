import collections
import hashlib
import random
import zlib

import public_tokenizers
import sentencepiece
import tokenizers

from lectern.llm import bpe, packing, token_counts

ALPHABET = "ab '!\n\t é́Σİ①<|>1\x1c\x85　語🙂▁"


def odd(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", "  a  b ", "a\n b\n\nc \n", "x <|endoftext|> y <|startoftext|>z", "İstanbul ǅ ﬁ ①", "\0a \0!!", "a" * 3000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_byte_bpe_equals_library():
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder("byte_bpe_50k.tiktoken")
    for t in odd(800):
        want = lib.encode(t, add_special_tokens=False).ids
        assert enc.ids(t) == b"".join(i.to_bytes(4, "little") for i in want), repr(t)


def test_capacity_tree_is_best_fit():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    windows, offsets = packing.best_fit_decreasing(lengths, 100)
    free = []
    for n, w, o in zip(lengths, windows, offsets):
        room = [f for f in free if f >= n]
        if room:
            assert free[w] == min(room)
        else:
            assert w == len(free)
            free.append(100)
        assert o == 100 - free[w]
        free[w] -= n
    assert len(free) <= 11 / 9 * -(-sum(lengths) // 100) + 1


def test_packing(docs, rows):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, window=256, group_rows=20).collect()
    want = collections.Counter((i, b"".join(x.to_bytes(4, "little") for x in [*lib.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    parts = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] <= 256
        parts[r["doc_id"], r["doc_tokens"]].append(r)
    tokens = sum(r["length"] for r in got)
    assert tokens == sum(len(k[1]) // 4 * n for k, n in want.items())
    for (i, raw), n in want.items():
        if n == 1 and i is not None:
            assert b"".join(bytes(r["ids"]) for r in sorted(parts[i, len(raw) // 4], key=lambda r: r["start"])) == raw
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 256


def test_packing_is_narrow_and_fills_windows(spark):
    """Rows that repeat one document, and a very long one, are packed where they are read; little is padded."""
    rng = random.Random(11)
    rows = [(7, "the same words again and again " * 9)] * 400 + [(i, "word " * rng.randint(1, 300)) for i in range(100, 500)] + [(600, "long text " * 40_000)]
    df = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=512, group_rows=100, with_ids=False)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    got = df.collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == 400 * next(r["doc_tokens"] for r in got if r["doc_id"] == 7)
    assert all(r["length"] == 512 and r["offset"] == 0 for r in got if r["doc_id"] == 600 and r["start"] + 512 <= r["doc_tokens"])
    windows = len({r["sequence_id"] for r in got})
    assert windows * 512 <= 1.05 * sum(r["length"] for r in got)
    most = max(n for _, n in collections.Counter(r["sequence_id"] >> 32 for r in got if r["length"] < 512).items())
    assert most <= 400  # each of three tasks packs its own


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_pair_index_equals_library():
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mine = bpe.codec("word_bpe_49k.json")
    texts = odd(800, 2)
    for t, ids in zip(texts, mine.encode_batch(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == want, repr(t)
        assert mine.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_bpe_operators(docs, rows, empty):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.round_trip_digest(docs).collect())) == want
    both = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(hashlib.sha256(r["decoded"].encode()).hexdigest() for r in both) == sorted(k[3] for k, n in want.items() for _ in range(n))
    assert bpe.encode(empty).count() == 0 == bpe.round_trip_digest(empty).count()


def test_token_counts(docs, rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    c = token_counts.counter("piece_bpe_32k.model")
    for t in odd(400, 3):
        n = len(sp.encode(t))
        for chunk, overlap in ((10**9, 1), (1, 1), (7, 2), (50, 10), (300, 80)):
            if chunk > 1 or len(t) < 100:
                assert c.count(t, chunk, overlap) == n, (t, chunk)
    want = collections.Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in rows)
    assert collections.Counter(map(tuple, token_counts.count_tokens(docs, chunk=2000, overlap=50).collect())) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_memo_leaves_long_chunks_out():
    from lectern.llm import features
    from lectern.llm.common import MEMO_CHARS

    long = "語" * 5000 + " " + "x9" * 4000 + " short"
    mine, c = bpe.codec("word_bpe_49k.json"), token_counts.counter("piece_bpe_32k.model")
    mine.encode_batch([long, long])
    c.count(long)
    features.word_hashes([long])
    for memo in (mine._chunks, mine._words, c._memo, features._memo):
        assert memo and max(len(k[0]) if isinstance(k, tuple) else len(k) for k in memo) <= MEMO_CHARS
