"""Operator 2, language identification: a linear-chain conditional random field over the words of a text.

A word's emission scores come from hashed affixes, character n-grams and the word itself (the lexicon); transitions
between the languages of neighbouring words are learned. Posteriors of words come from forward-backward, so
code-switched text is labelled word by word; a text's language is the one with most expected words.

Forward-backward runs exactly on whole texts: words are cut into blocks whose transition products are formed side by
side, block products are chained within each text, and the blocks are then swept side by side.

Training takes at most `limit` documents of at most `chars` characters (whole texts) with a language outside the
held-out fold, by smallest hash of the id; some are joined in pairs so that switches occur. Results: texts that are null
or have no letter give `und` with score 0. Without training rows everything is `und`. Repeated rows: row by row.
"""

import re
from itertools import chain
from zlib import crc32

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import doc_texts, held_out, per_text

#: Signs that Python counts as word characters though they are neither letters nor decimal digits, such as fractions.
SIGNS = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(rf"[^\W\d_{SIGNS}]+")
#: Words and signs together: tested at each character, this short set costs an eighth of WORD's.
RUN = re.compile(r"[^\W\d_]+")
BITS, BLOCK = 15, 64
#: Words whose emissions a worker remembers; letters of a word beyond which it is hashed on its own.
MEMO, GRID = 300_000, 40
MANY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """What WORD finds in a text in lower case; only runs that hold a sign are searched by WORD itself."""
    found = RUN.findall(text.lower())
    return found if "".join(found).isalpha() else [w for run in found for w in ([run] if run.isalpha() else WORD.findall(run))]


def hashed(n: int, kind: int, *letters: np.ndarray) -> np.ndarray:
    """n features of a kind from letters that stand side by side."""
    h = np.full(n, kind + 1, np.uint64) * MANY
    for x in letters:
        h = (h ^ x) * MANY
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def long_features(word: str) -> np.ndarray:
    """What features() gives a word, for one of many letters: n-grams of all letters, affixes from both ends."""
    x = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x)
    out = [np.array([xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> (64 - BITS)], np.int64)]
    out.append(hashed(1, 1, np.full(1, min(n, 12), np.uint64)))
    for j in range(4):
        out.append(hashed(1, 2 + j, *(x[i : i + 1] for i in range(j + 1))))
        out.append(hashed(1, 6 + j, *(x[n - 1 - i : n - i] for i in range(j + 1))))
    for k in (1, 2):
        out.append(hashed(n - k, 10 + k, *(x[i : n - k + i] for i in range(k + 1))))
    return np.concatenate(out)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words as (index of the word, feature): the word itself, its length, affixes of up to
    four letters, n-grams of two and three. All letters count, however long a word is."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-size, kind="stable")
    longer = order[: int((size > GRID).sum())]
    order = order[len(longer) :]
    size = size[order]
    grid = np.array([words[i] for i in order], f"U{GRID}").view(np.uint32).reshape(len(order), GRID).astype(np.uint64)
    at, found = [], []
    for i in longer:
        found.append(long_features(words[i]))
        at.append(np.full(len(found[-1]), i))

    def add(n: int, kind: int, *letters: np.ndarray) -> None:
        at.append(order[:n])
        found.append(hashed(n, kind, *letters))

    n = len(order)
    add(n, 0, *(grid[:, j] for j in range(int(size.max(initial=0)))))
    add(n, 1, np.minimum(size, 12).astype(np.uint64))
    for j in range(int(size.max(initial=0))):
        m = int((size > j).sum())
        rows = np.arange(m)
        if j < 4:
            add(m, 2 + j, *(grid[:m, i] for i in range(j + 1)))
            add(m, 6 + j, *(grid[rows, size[:m] - 1 - i] for i in range(j + 1)))
        for k in (1, 2):
            if m := int((size > j + k).sum()):
                add(m, 10 + k, *(grid[:m, j + i] for i in range(k + 1)))
    return np.concatenate(at), np.concatenate(found)


def posteriors(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Label posteriors of each word, expected transitions (k x k; zeros without pairs), log likelihood of the normaliser.

    emit: words x k scores, texts one after another with sizes (all > 0) words. trans, start: scores.
    """
    k = emit.shape[1]
    top = emit.max(1, keepdims=True)
    e = np.exp(emit - top)
    t, s = np.exp(trans), np.exp(start)
    parts = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(parts)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    nb = first[-1]
    text = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(nb) - first[text]
    length = np.minimum(BLOCK, sizes[text] - nth * BLOCK)
    at = begin[text] + nth * BLOCK
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(BLOCK), "left")  # blocks longer than i
    at, length_o = at[order], length[order]
    place = np.empty(nb, np.int64)
    place[order] = np.arange(nb)
    inner = (nth < parts[text] - 1)[order]  # whose product is needed
    # Products of whole blocks, scaled; only blocks that another one of the text follows.
    full = np.flatnonzero(inner)
    prod = np.tile(np.eye(k), (len(full), 1, 1))
    is_first = nth == 0
    for i in range(BLOCK if len(full) else 0):
        # A text begins with the start scores, whatever stands before its first word.
        m = np.where(is_first[order[full]][:, None, None], s[None, None] / k, t[None]) if i == 0 else t
        prod = (prod @ m) * e[at[full] + i][:, None, :]
        prod /= prod.max((1, 2))[:, None, None]
    spot = np.full(nb, -1)
    spot[order[full]] = np.arange(len(full))
    alpha0 = np.ones((nb, k))  # forward vector before each block's first word
    beta0 = np.ones((nb, k))  # backward vector after each block's last word
    for r in range(1, int(parts.max())):
        b = np.flatnonzero(nth == r)
        v = np.einsum("nk,nkj->nj", alpha0[b - 1], prod[spot[b - 1]])
        alpha0[b] = v / v.sum(1, keepdims=True)  # as the sweep scales, whose sums make the normaliser
    # Forward.
    a = np.empty_like(e)
    cur = alpha0[order]
    lead = is_first[order]
    logz = float(top.sum())
    norm = np.zeros(len(e))
    for i in range(BLOCK):
        m = alive[i]
        if not m:
            break
        v = cur[:m] @ t
        if i == 0:
            v[lead[:m]] = s
        v = v * e[at[:m] + i]
        c = v.sum(1, keepdims=True)
        cur = v / c
        a[at[:m] + i] = cur
        norm[at[:m] + i] = c[:, 0]
    # Backward across blocks: a text's last block is swept, the others are applied as products.
    last_of = parts - 1
    tail = np.flatnonzero((nth == last_of[text]) & (nth > 0))
    tail = tail[np.argsort(-length[tail], kind="stable")]
    lo = begin[text[tail]] + nth[tail] * BLOCK
    v = np.ones((len(tail), k))
    for i in range(BLOCK - 1, -1, -1):
        if m := int((length[tail] > i).sum()):
            w = (v[:m] * e[lo[:m] + i]) @ t.T
            v[:m] = w / w.max(1, keepdims=True)
    beta0[tail - 1] = v
    for r in range(int(parts.max()) - 3, -1, -1):
        b = np.flatnonzero((nth == r) & (r < last_of[text] - 1))
        v = np.einsum("nkj,nj->nk", prod[spot[b + 1]], beta0[b + 1])
        beta0[b] = v / v.max(1, keepdims=True)
    back = beta0[order]
    post = np.empty_like(e)
    pair = np.zeros((k, k))
    ended = length_o
    cur = back.copy()
    for i in range(BLOCK - 1, -1, -1):
        m = alive[i]
        if not m:
            continue
        own = ended[:m] == i + 1
        cur[:m][own] = back[:m][own]
        g = a[at[:m] + i] * cur[:m]
        post[at[:m] + i] = g / g.sum(1, keepdims=True)
        w = e[at[:m] + i] * cur[:m]
        has = np.flatnonzero(~(lead[:m] & (i == 0)))
        if pairs and len(has):
            prev = a[at[has] + i - 1]
            x = prev[:, :, None] * t[None] * w[has][:, None, :]
            pair += (x / x.sum((1, 2), keepdims=True)).sum(0)
        v = w @ t.T
        cur[:m] = v / v.max(1, keepdims=True)
    return post, pair, logz + float(np.log(np.maximum(norm, 1e-300)).sum())


class Field:
    """A trained field; labels in the order of its columns."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.trans, self.start = labels, weights, trans, start
        self.memo: dict[str, int] = {}
        self.rows = np.empty((1024, len(labels)))

    def indices(self, words: list[str]) -> list[int]:
        get = self.memo.get
        out = list(map(get, words))
        if None in out:
            new = [w for w in dict.fromkeys(words) if w not in self.memo]
            n = len(self.memo)
            self.memo.update(zip(new, range(n, n + len(new)), strict=True))
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            at, found = features(new)
            for j in range(len(self.labels)):
                self.rows[n : n + len(new), j] = np.bincount(at, self.weights[found, j], len(new))
            out = list(map(get, words))
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of expected words) of each text."""
        if len(self.memo) > MEMO:
            self.memo = {}
        words = [words_of(t) if t and self.labels else [] for t in texts]
        sizes = np.array([len(w) for w in words])
        keep = np.flatnonzero(sizes)
        out = [("und", 0.0)] * len(texts)
        if len(keep):
            ids = np.array(self.indices(list(chain.from_iterable(words))), np.int64)
            post, _, _ = posteriors(self.rows[ids], sizes[keep], self.trans, self.start, False)
            total = np.add.reduceat(post, np.concatenate([[0], np.cumsum(sizes[keep])[:-1]]), 0)
            best = total.argmax(1)
            for k, b, row, n in zip(keep, best, total, sizes[keep], strict=True):
                out[k] = (self.labels[b], float(min(1.0, row[b] / n)))
        return out

    def word_labels(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, posterior) of each word of one text."""
        words = words_of(text)
        if not words or not self.labels:
            return []
        post, _, _ = posteriors(self.rows_of(words), np.array([len(words)]), self.trans, self.start)
        return [(w, self.labels[p.argmax()], float(p.max())) for w, p in zip(words, post, strict=True)]

    def rows_of(self, words: list[str]) -> np.ndarray:
        ids = self.indices(words)
        return self.rows[ids]


def fit(texts: list[str], langs: list[str], rounds: int = 16, l2: float = 2e-4, words_limit: int = 250_000) -> Field:
    """Maximum likelihood by adaptive gradient steps over all training words. Texts beyond words_limit words are left out."""
    labels = sorted(set(langs))
    k = len(labels)
    if not k:
        return Field([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)), np.zeros(0))
    known: dict[str, int] = {}
    seqs, golds, total = [], [], 0
    for t, g in zip(texts, langs, strict=True):
        w = [known.setdefault(x, len(known)) for x in words_of(t)]
        if w and (total := total + len(w)) <= words_limit:
            seqs.append(w)
            golds.append([labels.index(g)] * len(w))
    if not seqs:
        return Field([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)), np.zeros(0))
    third = len(seqs) // 3
    for i in range(0, third - 1, 2):  # switches
        seqs[i], golds[i] = seqs[i] + seqs[i + 1], golds[i] + golds[i + 1]
        seqs[i + 1], golds[i + 1] = None, None
    seqs, golds = [s for s in seqs if s], [g for g in golds if g]
    ids, gold, sizes = np.concatenate(seqs), np.concatenate(golds), np.array([len(s) for s in seqs])
    of, flat = features(list(known))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inner = np.ones(len(ids), bool)
    inner[first] = False
    true_pair = np.bincount(gold[:-1][inner[1:]] * k + gold[1:][inner[1:]], minlength=k * k).reshape(k, k)
    true_start = np.bincount(gold[first], minlength=k)
    once = np.zeros((len(ids), k))
    once[np.arange(len(ids)), gold] = 1
    weights, trans, start = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(v, 1e-8) for v in (weights, trans, start)]
    n = len(ids)
    for _ in range(rounds):
        emit = np.stack([np.bincount(of, weights[flat, j], len(known)) for j in range(k)], 1)
        post, pair, _ = posteriors(emit[ids], sizes, trans, start)
        diff = once - post
        by_word = np.stack([np.bincount(ids, diff[:, j], len(known)) for j in range(k)], 1)
        g_w = np.stack([np.bincount(flat, by_word[of, j], 1 << BITS) for j in range(k)], 1) / n - l2 * weights / 100
        g_t = (true_pair - pair) / n - l2 * trans
        g_s = (true_start - post[first].sum(0)) / n - l2 * start
        for v, s, g, rate in ((weights, sums[0], g_w, 0.25), (trans, sums[1], g_t, 0.25), (start, sums[2], g_s, 0.25)):
            s += g * g
            v += rate * g / np.sqrt(s)
    return Field(labels, weights, trans, start)


def train(docs: DataFrame, limit: int = 1_500, chars: int = 20_000) -> Field:
    """A field from at most limit whole texts of at most chars characters each."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= chars))
    ids = own.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(limit)
    # Of the rows of an id the one with the smallest hash: limit rows at most.
    rows = own.join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("t")).select("doc_id", "t.*").collect()
    rows.sort(key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"], r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def languages(docs: DataFrame, limit: int = 1_500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text, lang)."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, limit))
    label = per_text(lambda: held.value, FIELDS, 1_500_000)
    out = doc_texts(docs).select("doc_id", label("text").alias("c"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "c.lang_pred", "c.score")
