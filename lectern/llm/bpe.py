"""BPE encoding and decoding by a pair occurrence index.

The words of a batch that are not known yet are laid out in one symbol array with links to the
previous and next live symbol. An index maps each adjacent pair to all its positions in the array;
a heap of active ranks yields the lowest one, whose positions are merged from left to right, and
the index lists of the neighbouring pairs are updated. Words never touch each other, so this gives
each word the merges that a word-by-word encoder gives it. Encoded words are memoised per worker.

Defined cases: a null or empty text has no tokens and decodes to the empty text; repeated rows are
returned once each; nulls in the id are kept; other columns are not read; very long texts are
encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_CHARS, small_batches

MEMO_ENTRIES = 400_000
#: Below this code point, Python, the `regex` module and the tokenizers library agree on case and classes.
_PLAIN_LIMIT = "\u0250"

_codecs: dict[str, "PairIndexBpe"] = {}


def merge_by_pair_index(words: list[list[int]], merges: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """Merge all ``words`` (lists of symbol ids) at once; ``merges`` maps a pair to (rank, merged id)."""
    symbol: list[int] = []
    prev: list[int] = []
    nxt: list[int] = []
    starts = []
    places: dict[int, list[int]] = {}
    merged_of: dict[int, tuple[int, int, int]] = {}
    active: list[int] = []
    look = merges.get

    for word in words:
        at, last = len(symbol), len(symbol) + len(word) - 1
        starts.append(at if word else -1)
        symbol.extend(word)
        prev.extend(range(at - 1, last))
        nxt.extend(range(at + 1, last + 2))
        if word:
            prev[at] = -1
            nxt[last] = -1
        for i in range(at, last):
            hit = look((symbol[i], symbol[i + 1]))
            if hit is not None:
                rank = hit[0]
                if rank in places:
                    places[rank].append(i)
                else:
                    places[rank] = [i]
                    merged_of[rank] = (symbol[i], symbol[i + 1], hit[1])
                    active.append(rank)
    heapq.heapify(active)

    while active:
        rank = heapq.heappop(active)
        at = places.pop(rank)
        left, right, new = merged_of[rank]
        at.sort()
        for i in at:
            j = nxt[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # an earlier merge took one of the two
            symbol[i] = new
            symbol[j] = -1
            k = nxt[j]
            nxt[i] = k
            if k >= 0:
                prev[k] = i
                hit = look((new, symbol[k]))
                if hit is not None:
                    r = hit[0]
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
                        merged_of[r] = (new, symbol[k], hit[1])
                        heapq.heappush(active, r)
            h = prev[i]
            if h >= 0:
                hit = look((symbol[h], new))
                if hit is not None:
                    r = hit[0]
                    if r in places:
                        places[r].append(h)
                    else:
                        places[r] = [h]
                        merged_of[r] = (symbol[h], new, hit[1])
                        heapq.heappush(active, r)

    out = []
    for i in starts:
        ids = []
        while i >= 0:
            ids.append(symbol[i])
            i = nxt[i]
        out.append(ids)
    return out


class PairIndexBpe:
    """The lower-casing word BPE with word-end marks, read from a tokenizers file."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        import tokenizers

        path = public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # byte-level symbols: printable bytes stand for themselves, the others for the code points from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in keep}
        shown.update({b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)})
        self._inner = [vocab[shown[b]] for b in range(256)]
        self._final = [vocab[shown[b] + spec["model"]["end_of_word_suffix"]] for b in range(256)]
        self._shown_id = {c: vocab[c] for c in shown.values()}
        self._shown_final = {c: vocab[c + spec["model"]["end_of_word_suffix"]] for c in shown.values()}
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self._white = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self._odd = regex.compile(r"[\x1c-\x1f]")  # white space to str.split, not to the pattern
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._library = tokenizers.Tokenizer.from_file(path)
        self._words: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        self.id_text = {i: str(i) for i in self.token}

    def _chunk_words(self, chunk: str) -> list:
        """Pre-tokens of a text without white space: as they are, or in a tuple as byte-level strings."""
        if max(chunk) < _PLAIN_LIMIT:
            if not chunk.isascii():
                chunk = unicodedata.normalize("NFC", chunk)
            return self._split.findall(chunk.lower())
        norm = self._library.normalizer.normalize_str(chunk)
        return [(w,) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(norm)]

    def _symbols(self, word) -> list[int]:
        if isinstance(word, tuple):
            ids = [self._shown_id[c] for c in word[0]]
            ids[-1] = self._shown_final[word[0][-1]]
            return ids
        raw = word.encode()
        ids = [self._inner[b] for b in raw]
        ids[-1] = self._final[raw[-1]]
        return ids

    def _learn(self, chunks) -> None:
        """Encode all words of ``chunks`` that are not known, by one pair occurrence index over them."""
        split = {c: self._chunk_words(c) for c in chunks}
        new = list({w for ws in split.values() for w in ws if w not in self._words})
        if new:
            for w, ids in zip(new, merge_by_pair_index([self._symbols(w) for w in new], self.merges), strict=True):
                self._words[w] = tuple(ids)
        words = self._words
        for c, ws in split.items():
            self._chunks[c] = words[ws[0]] if len(ws) == 1 else tuple(i for w in ws for i in words[w])
        for w in new:
            if len(w[0] if isinstance(w, tuple) else w) > MEMO_CHARS:
                del words[w]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        if len(self._chunks) > MEMO_ENTRIES:
            self._chunks.clear()
        if len(self._words) > MEMO_ENTRIES:
            self._words.clear()
        parts = []  # a text: its segments, each a special id or a list of chunks
        known, fresh = self._chunks, set()
        for text in texts:
            segments = []
            for piece in self._specials.split(text) if "<|" in text else (text,):
                if piece in self.special:
                    segments.append(self.special[piece])
                    continue
                chunks = [c for c in self._white.split(piece) if c] if self._odd.search(piece) else piece.split()
                fresh.update(c for c in chunks if c not in known)
                segments.append(chunks)
            parts.append(segments)
        if fresh:
            self._learn(fresh)
        out = []
        for segments in parts:
            ids: list[int] = []
            for s in segments:
                if isinstance(s, int):
                    ids.append(s)
                else:
                    for t in map(known.__getitem__, s):
                        ids += t
            out.append(ids)
        for c in fresh:  # what is too long to be met again often
            if len(c) > MEMO_CHARS:
                del known[c]
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: the file names no decoder. Special tokens stay; unknown ids are skipped."""
        try:
            return " ".join(map(self.token.__getitem__, ids))
        except KeyError:
            return " ".join(self.token[i] for i in ids if i in self.token)


def codec(vocabulary: str) -> PairIndexBpe:
    if vocabulary not in _codecs:
        _codecs[vocabulary] = PairIndexBpe(vocabulary)
    return _codecs[vocabulary]


def _slices(texts: list, most: int = 2_000_000):
    """Runs of a batch with about ``most`` characters each, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row. Narrow."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(it):
        bpe = codec(vocabulary)
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                ids = bpe.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``(doc_id, decoded string)`` from a column of ids; null ids decode to the empty text. Narrow."""
    import pyarrow as pa

    id_type = df.schema[id_col].dataType.simpleString()

    def run(it):
        bpe = codec(vocabulary)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {id_type}, decoded string")


def round_trip_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Encode, then decode the ids, in one pass; only digests leave the worker."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(it):
        bpe = codec(vocabulary)
        text_of, sha = bpe.id_text, hashlib.sha256
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                n, h, d = [], [], []
                for ids in bpe.encode_batch(texts[a:b]):
                    n.append(len(ids))
                    h.append(sha(" ".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                    d.append(sha(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
