"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in chunks that overlap, each with the offsets at which its tokens
end. The count follows one chunk's tokens up to, and the next chunk's from, an offset in the overlap at which both
encodings end a token and which is proven stable: the text goes from a non-space to a space there, and no piece of the
vocabulary holds a space after a non-space (checked against the whole vocabulary when the model is loaded), so no merge
can ever cross it. If an overlap has no such offset, it is widened to twice its length, backwards as far as the chunk
goes and then forwards, and both chunks' encodings of it are compared again. The count equals that of encoding the text in
one go. A worker holds one chunk and its overlap; a stretch without a stable offset (a text without spaces) is held whole.

Texts of one chunk are counted by their runs between proven boundaries, memoised per worker.

Defined cases: null and empty texts have no tokens; nulls in the id are kept; repeated rows are
counted once each; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_CHARS, small_batches

CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
MEMO_ENTRIES = 600_000

_SPACE = "▁"
_RUN = re.compile(r" *[^ ]+| +\Z")
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        crossing = re.compile(f"[^{_SPACE}]{_SPACE}")
        pieces = (self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size()))
        if any(crossing.search(p) for p in pieces):
            raise ValueError("a piece spans the end of a word: no boundary of this vocabulary is proven stable")
        for probe in ("ﬁ ①", "é", "a  b"):  # the proof also needs a normaliser that leaves texts alone
            if self._sp.normalize(probe).replace(_SPACE, " ").lstrip(" ") != probe:
                raise ValueError("the model normalises texts")
        import numpy as np

        names = [self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size())]
        self._size = np.array([len(p) for p in names])
        self._byte = np.array([int(p[3:5], 16) if _BYTE.fullmatch(p) else -1 for p in names])
        self._memo: dict[str, int] = {}

    def _runs(self, text: str) -> list[str]:
        """The runs between proven boundaries, each without the one space that the model puts before it."""
        if _SPACE in text:
            text = text.replace(_SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [r[1:] for r in _RUN.findall(" " + text)]

    def _one(self, run: str) -> int:
        n = len(self._sp.encode(run)) if run else 1  # a space alone
        if len(run) <= MEMO_CHARS:
            self._memo[run] = n
        return n

    def whole(self, text: str) -> int:
        """Tokens of a text in one go."""
        if not text:
            return 0
        if len(self._memo) > MEMO_ENTRIES:
            self._memo.clear()
        get, one, n = self._memo.get, self._one, 0
        for r in self._runs(text):
            x = get(r)
            n += one(r) if x is None else x
        return n

    def ends(self, text: str):
        """Offset in ``text`` at which each token of its own encoding ends, and whether a character ends there too."""
        import numpy as np

        ids = np.array(self._sp.encode(text), np.int64)
        lead = self._byte[ids]
        inside = np.append((lead[1:] >= 0x80) & (lead[1:] < 0xC0), False)  # more bytes of the same character follow
        return np.cumsum(np.where(lead < 0, self._size[ids], (lead < 0x80) | (lead >= 0xC0))) - 1, ~inside  # the model puts a space in front

    def stable(self, text: str, at: int) -> bool:
        """No merge crosses this offset, whatever stands further left or right."""
        return 0 < at < len(text) and text[at] in (" ", _SPACE) and text[at - 1] not in (" ", _SPACE)

    def resynchronised(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text, spliced from overlapping chunks."""
        import numpy as np

        n, total, start, end = len(text), 0, 0, min(len(text), chunk)
        here, whole = self.ends(text[start:end])  # of the chunk from start to end
        counted = 0  # tokens of it that are counted already
        while end < n:
            wide = max(1, min(overlap, chunk // 2))
            while True:
                left = max(start + 1, end - wide)
                stop = min(n, max(end, left + chunk))
                there, sound = self.ends(text[left:stop])
                both = np.intersect1d(start + here[whole], left + there[sound])
                cut = next((int(x) for x in both[::-1] if left < x < end and self.stable(text, int(x))), None)
                if cut is not None or end == n:
                    break
                if left == start + 1:  # nothing further back: the chunk grows
                    end = min(n, end + wide)
                    here, whole = self.ends(text[start:end])
                wide *= 2
            if cut is None:
                break
            total += int(np.searchsorted(start + here, cut, "right")) - counted
            counted = int(np.searchsorted(left + there, cut, "right"))
            start, end, here, whole = left, stop, there, sound
        return total + len(here) - counted

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return self.whole(text) if len(text) <= chunk else self.resynchronised(text, chunk, overlap)


def counter(vocabulary: str) -> PieceCounter:
    if vocabulary not in _counters:
        _counters[vocabulary] = PieceCounter(vocabulary)
    return _counters[vocabulary]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row. Narrow."""
    import pyarrow as pa

    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(it):
        c = counter(vocabulary)
        for batch in it:
            n = [c.count(t or "", chunk, overlap) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"), size.alias("n_bytes")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
