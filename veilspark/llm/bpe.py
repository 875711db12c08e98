"""Operator 8, BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a run of texts form one partition of symbols. An index maps every mergeable pair to all its
positions there. Active ranks are applied in ascending order, each at all its positions from left to right, and a merge
moves only the neighbouring pairs between lists. Ranks only rise, since a pair with a new symbol ranks after the
symbol's own merge, so one pass over the ranks encodes every pre-token. Encoded pre-tokens are remembered by a worker, up
to a bound at which the memory is emptied.

Results: null text is encoded as the empty text. Special strings inside texts become their single id, as in the
library's default. decoded text of a whole text equals that text. Repeated rows are encoded row by row.
"""

import heapq
import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspark.llm.bytebpe import LATER_SET, PATTERN, PATTERN_LATER, Vocabulary, load
from veilspark.llm.common import batch_pieces, doc_texts, lean, per_text

#: Encoded pre-tokens that a worker remembers, and letters of a pre-token beyond which it is not remembered.
MEMO, LONG = 1_000_000, 256


def encode_partition(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each word, all words encoded together."""
    single = [v.ids[bytes([b])] for b in range(256)]
    sym: list[int] = []
    ends = []
    for w in words:
        sym.extend(map(single.__getitem__, w))
        ends.append(len(sym))
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    a = 0
    for b in ends:
        if b > a:
            before[a], after[b - 1] = -1, -1
        a = b
    ranks, index = v.ranks, {}
    for i in range(n):
        if (j := after[i]) >= 0 and (r := ranks.get((sym[i], sym[j]))) is not None:
            index.setdefault(r[0], (sym[i], sym[j], r[1], []))[3].append(i)
    active = list(index)
    heapq.heapify(active)
    while active:
        left, right, new, places = index.pop(heapq.heappop(active))
        places.sort()
        for i in places:
            j = after[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            p = before[i]
            if k >= 0:
                before[k] = i
            for x, y in ((p, i), (i, k)):
                if x >= 0 and y >= 0 and (r := ranks.get((sym[x], sym[y]))) is not None:
                    entry = index.get(r[0])
                    if entry is None:
                        entry = index[r[0]] = (sym[x], sym[y], r[1], [])
                        heapq.heappush(active, r[0])
                    entry[3].append(x)
    out, a = [], 0
    for b in ends:
        out.append([s for s in sym[a:b] if s >= 0])
        a = b
    return out


class Codec:
    """Encodes and decodes texts."""

    def __init__(self, vocabulary: Vocabulary, remember: int | None = None):
        self.v, self.remember = vocabulary, remember or MEMO
        self.find, self.find_later = regex.compile(PATTERN).findall, regex.compile(PATTERN_LATER).findall
        self.later = regex.compile(LATER_SET).search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")") if vocabulary.specials else None
        self.memo: dict[str, bytes] = {}

    def common(self, text: str) -> bool:
        """Whether a text has no letter that the library's tables lack; Latin-1 has none."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.later(text)
        return True

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            words: list = []
            for i, part in enumerate(self.special.split(t) if t and any(map(t.__contains__, self.v.specials)) else [t or ""]):
                if i % 2:
                    words.append(self.v.specials[part])
                else:
                    words.extend(self.find(part) if self.common(part) else self.find_later(part))
            split.append(words)
        if len(self.memo) > self.remember:
            self.memo.clear()
        new = list(set(chain.from_iterable(split)).difference(self.memo))
        for w, ids in zip(new, encode_partition([w.encode() if isinstance(w, str) else b"" for w in new], self.v), strict=True):
            self.memo[w] = np.array([w] if isinstance(w, int) else ids, "<u4").tobytes()
        out = [b"".join(map(self.memo.__getitem__, words)) for words in split]
        for w in new:
            if isinstance(w, str) and len(w) > LONG:
                del self.memo[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character, as in the library."""
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encoded(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded: the real outputs of the codec for docs(doc_id, text).

    Results are several times as large as their texts, so they leave the worker in batches of about half a million characters.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))

    def run(batches):
        codec = Codec(held.value, 250_000)
        for batch in batches:
            at = 0
            for texts in batch_pieces(batch.column(1), 500_000):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([np.frombuffer(e, "<i4") for e in ids], pa.list_(pa.int32())), pa.array(map(codec.decode, ids), pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )
                at += len(texts)
            pa.default_memory_pool().release_unused()

    return doc_texts(docs).mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, decoded, and only digests leave the worker."""
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))

    def make():
        codec = Codec(held.value)
        return lambda texts: [(len(e) // 4, sha256(e).hexdigest(), sha256(codec.decode(e).encode()).hexdigest()) for e in codec.encode(texts)]

    return doc_texts(docs).select("doc_id", per_text(make, DIGEST)("text").alias("c")).select("doc_id", "c.*")
