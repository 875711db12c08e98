"""Operator 5, token counts: finite-state tokenizer compilation.

Two deterministic transducers are compiled from the tokenizer.

* The segmenter reads code points and marks where pre-tokens begin. It has eleven states. A text is cut into chunks of
  fixed length; every chunk yields its state map (exit state for each entry state), the maps of a text's chunks compose
  by a parallel prefix scan, and each chunk is then read once from its known entry state.
* The counter reads the bytes of a pre-token. Each transition is annotated with the change of the number of emitted
  tokens, so the sum along the path is the pre-token's token count. A state is what matters of the bytes read so far:
  the longest suffix that a token may continue, with the last token and relative count at each of its positions.
  States are compiled when first reached; their number is finite as tokens are, whatever a pre-token's length.

Results: null text counts as empty (0 bytes, 0 tokens). Special strings inside texts are one token each, as in the
library's default. No truncation, no padding. Repeated rows are counted row by row; a table without rows gives none.
"""

import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.bytebpe import LATER_RANGES, Vocabulary, load
from veilspark.llm.common import doc_texts, per_text

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, STMD, RV, L, E, PAD = range(11)
# States of the segmenter.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, SPACE_1, SPACE_N, WHITE_1, WHITE_N, APOS, APOS_RV, APOS_L = range(11)
#: Outputs: a pre-token begins at this code point, at the one before.
HERE, BEFORE = 1, 2
CHUNK = 256
#: A worker forgets counted pre-tokens beyond so many, compiled states beyond so many, tested pairs of tokens beyond so many.
MEMO, STATES, FITS = 1_000_000, 400_000, 400_000


def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    all_chars = "".join(map(chr, points))
    at = np.array(points, np.int32)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, all_chars):
            out[at[m.start() : m.end()]] = kind
    for a, b in LATER_RANGES:
        out[a : b + 1] = OTHER
    out[0x1C:0x20] = OTHER  # separators that are white space to Python alone
    for chars, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
        for c in chars:
            out[ord(c)] = kind
    return out


def segmenter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state and output by class * 11 + state; output at the end of a text by state."""
    letters = {LETTER, STMD, RV, L, E}
    step, say = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)

    def begin(c: int) -> tuple[int, int]:
        if c in letters:
            return IN_LETTERS, HERE
        return {NUMBER: IN_NUMBERS, SPACE: SPACE_1, WHITE: WHITE_1, APOSTROPHE: APOS, OTHER: IN_OTHER}[c], HERE

    def joined(c: int) -> int:
        return IN_LETTERS if c in letters else IN_NUMBERS if c == NUMBER else IN_OTHER

    def move(s: int, c: int) -> tuple[int, int]:
        white = {SPACE: SPACE_N, WHITE: WHITE_N}
        if s == IN_LETTERS and c in letters or s == IN_NUMBERS and c == NUMBER or s == IN_OTHER and c in (OTHER, APOSTROPHE):
            return s, 0
        if s in (SPACE_1, SPACE_N, WHITE_1, WHITE_N):
            if c in white:
                return white[c], 0
            if s in (SPACE_1, SPACE_N):  # a last space belongs to what follows
                return joined(c), BEFORE * (s == SPACE_N)
            to, out = begin(c)
            return to, out | BEFORE * (s == WHITE_N)
        if s == APOS:
            if c == STMD:
                return START, 0
            if c in (RV, L):
                return (APOS_RV if c == RV else APOS_L), 0
            if c in (OTHER, APOSTROPHE):
                return IN_OTHER, 0
        if s in (APOS_RV, APOS_L):
            if c == (E if s == APOS_RV else L):
                return START, 0
            if c in letters:
                return IN_LETTERS, BEFORE
            to, out = begin(c)
            return to, out | BEFORE
        return begin(c)

    for c in range(10):
        for s in range(11):
            step[c, s], say[c, s] = move(s, c)
    step[PAD] = np.arange(11)
    end = np.zeros(11, np.uint8)
    end[[APOS_RV, APOS_L]] = BEFORE
    return step.ravel(), say.ravel(), end


class Segmenter:
    """Finds where the pre-tokens of texts begin."""

    def __init__(self, chunk: int = CHUNK):
        self.kind, self.chunk = classes(), chunk
        self.step, self.say, self.end = segmenter()

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the positions at which its pre-tokens begin, then its length."""
        w = self.chunk
        sizes = np.array([len(t) for t in texts])
        parts = -(-sizes // w)
        first = np.concatenate([[0], np.cumsum(parts)])
        lanes = np.full(first[-1] * w, PAD, np.uint8)
        flat = self.kind[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(first[:-1] * w - begin[:-1], sizes)
        lanes[np.arange(len(flat)) + shift] = flat
        lanes = np.ascontiguousarray(lanes.reshape(-1, w).T).astype(np.intp) * 11
        entry = self.entries(lanes, parts)
        marks = np.zeros((len(entry), w + 1), np.uint8)
        state = entry
        for i in range(w):
            at = lanes[i] + state
            out = self.say[at]
            marks[:, i + 1] |= out & HERE
            marks[:, i] |= out >> 1
            state = self.step[at]
        # Column i + 1 is position i of the chunk; column 0 is the last position of the chunk before.
        flags = np.zeros(len(entry) * w + 1, np.uint8)
        flags[1:] = marks[:, 1:].ravel()
        flags[0:-1:w] |= marks[:, 0]
        flags = flags[1:]
        last = np.flatnonzero(parts)
        for k in last[self.end[state[first[1:][last] - 1]] > 0]:  # a text that ends within a possible contraction
            flags[first[k] * w + sizes[k] - 1] = 1
        found = np.flatnonzero(flags)
        cut = np.searchsorted(found, first * w)
        return [np.append(found[cut[k] : cut[k + 1]] - first[k] * w, sizes[k]) for k in range(len(texts))]

    def entries(self, lanes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The entry state of each chunk: the chunks' state maps, composed by a prefix scan within each text."""
        n = lanes.shape[1]
        if n == len(parts) and (parts <= 1).all():
            return np.full(n, START, np.uint8)
        text = np.repeat(np.arange(len(parts)), parts)
        maps = np.tile(np.arange(11, dtype=np.uint8), (n, 1))
        need = np.flatnonzero(np.append(text[1:] == text[:-1], False)) if n else np.array([], int)
        some = maps[need]
        for i in range(lanes.shape[0]):
            some = self.step[lanes[i][need][:, None] + some]
        maps[need] = some
        d = 1
        while d < parts.max():
            same = np.flatnonzero(text[d:] == text[:-d]) + d
            maps[same] = np.take_along_axis(maps[same], maps[same - d], 1)
            d *= 2
        entry = np.full(n, START, np.uint8)
        inner = np.flatnonzero(text[1:] == text[:-1]) + 1
        entry[inner] = maps[inner - 1, START]
        return entry


class Counter:
    """The transducer over the bytes of one pre-token, compiled where it is reached."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.prefixes = {t[:i] for t in vocabulary.ids for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.memo: dict[str, int] = {}
        self.known: dict[tuple, int] = {}
        self.of: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.state((b"", (None,), (0,)))

    def forget(self, s: int) -> int:
        """Drops all states but the first and s; the new number of s."""
        key = self.of[s]
        for held in (self.known, self.of, self.moves):
            held.clear()
        self.state((b"", (None,), (0,)))
        return self.state(key)

    def state(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.of)
            self.of.append(key)
            self.moves.append({})
        return self.known[key]

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a short byte string by its definition: join the pair of lowest rank, again and again."""
        ids = [self.v.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            (_, to), i = min((self.v.ranks.get((a, b), (1 << 60, 0)), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if not to and (ids[i], ids[i + 1]) not in self.v.ranks:
                break
            ids[i : i + 2] = [to]
        return [self.v.tokens[i] for i in ids]

    def adjacent(self, a: bytes | None, b: bytes) -> bool:
        """Whether token b may follow token a: the two together are encoded as just these two."""
        if a is None:
            return True
        if (a, b) not in self.fits:
            if len(self.fits) >= FITS:
                self.fits.clear()
            self.fits[a, b] = self.merged(a + b) == [a, b]
        return self.fits[a, b]

    def compile(self, s: int, byte: int) -> tuple[int, int]:
        """The transition of state s on a byte: (next state, change of the token count)."""
        if len(self.of) >= STATES:  # also within a pre-token, whatever its length
            s = self.forget(s)
        suffix, last, count = self.of[s]
        grown = suffix + bytes([byte])
        for j in range(len(grown)):
            if (t := grown[j:]) in self.v.ids and self.adjacent(last[j], t):
                break
        else:
            raise AssertionError("every byte is a token")
        more = count[j] + 1 - count[-1]
        keep = next(i for i in range(len(grown) + 1) if i == len(grown) or grown[i:] in self.prefixes)
        counts = [c - count[-1] - more for c in count] + [0]
        to = self.state((grown[keep:], (*last, t)[keep:], tuple(counts[keep:])))
        self.moves[s][byte] = to, more
        return to, more

    def __call__(self, pretoken: str) -> int:
        if (n := self.memo.get(pretoken)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            s, n, moves = 0, 0, self.moves
            for byte in pretoken.encode():
                s, more = moves[s].get(byte) or self.compile(s, byte)
                n += more
            if len(pretoken) <= 64:
                self.memo[pretoken] = n
        return n


class TokenCounts:
    """Counts the tokens of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.segmenter, self.counter = Segmenter(), Counter(vocabulary)
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True)))) if vocabulary.specials else None

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(bytes, tokens) of each text."""
        parts, owner, extra = [], [], []
        for k, t in enumerate(texts):
            t = t or ""
            own = self.special.split(t) if self.special else [t]
            extra.append(len(own) - 1)
            for p in own:
                if p:
                    parts.append(p)
                    owner.append(k)
        counts = extra
        count, get = self.counter, self.counter.memo.get
        for p, at, k in zip(parts, self.segmenter.starts(parts) if parts else [], owner, strict=True):
            at = at.tolist()
            tokens = [p[a:b] for a, b in zip(at, at[1:], strict=False)]
            got = list(map(get, tokens))
            if None in got:
                got = [count(t) if n is None else n for t, n in zip(tokens, got, strict=True)]
            counts[k] += sum(got)
        return [(len((t or "").encode()), n) for t, n in zip(texts, counts, strict=True)]


FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))
    count = per_text(lambda: TokenCounts(held.value), FIELDS)
    out = doc_texts(docs).select("doc_id", count("text").alias("c"))
    return out.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))
