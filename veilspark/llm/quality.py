"""Operator 1, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (never of labels, lang, source or ids) go into trees that are grown on binned features.
A forest is flattened into arrays of features, thresholds and leaves, and numpy walks all trees of a run of texts at once.

Training takes at most `limit` labelled rows outside the held-out fold, those with the smallest hash of their id; nothing
else is bounded. Results: null and empty texts have all-zero statistics and get the score those lead to. Repeated rows are
scored row by row; several labels of one id count as their largest. Without labelled rows every score is 0.5.
"""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import doc_texts, free_name, held_out, per_text

FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "distinct_words", "top_word", "distinct_pairs", "distinct_triples", "top_triple",
    "upper", "lower", "digits", "marks", "symbols", "white", "non_ascii", "exclaim", "pipes", "repeated_mark", "lines", "distinct_lines",
    "top_line", "mean_line", "sentence_words", "end_marked_lines", "adjacent_equal", "word_entropy", "short_words", "plain_words", "marked_words", "packed", "braces",
)
REPEATED = re.compile(r"([^\w\s])\1")
PLAIN = re.compile(r"[^\W\d_]+[.,]?")
SENTENCE = re.compile(r"[.!?]+(?:\s|$)")


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    count = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    pairs = Counter(zip(words, words[1:], strict=False))
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    line_count = Counter(lines)
    freq = np.fromiter(count.values(), np.float64, len(count)) / n
    upper, lower, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    marks = by[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    printed = by[33:127].sum()
    white = by[[9, 10, 11, 12, 13, 32]].sum()
    plain = sum(c for w, c in count.items() if PLAIN.fullmatch(w))
    return [
        math.log1p(len(text)), math.log1p(n), sizes.mean(), math.log1p(sizes.max()), len(count) / n, freq.max(), len(pairs) / max(1, n - 1), len(triples) / max(1, n - 2),
        max(triples.values(), default=0) / max(1, n - 2), upper / size, lower / size, digits / size, marks / size, (printed - upper - lower - digits - marks) / size, white / size, by[128:].sum() / size,
        by[33] / n, by[124] / n, len(REPEATED.findall(text)) / n, math.log1p(len(lines)), len(line_count) / len(lines), max(line_count.values()) / len(lines), math.log1p(n / len(lines)),
        math.log1p(n / (1 + len(SENTENCE.findall(text)))), sum(x[-1] in ".!?:;\"'" for x in lines) / len(lines), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        -(freq * np.log(freq)).sum() / max(1.0, math.log(n)), (sizes <= 3).mean(), plain / n, sum(c for w, c in count.items() if not w[-1].isalnum() and w[-1] not in ".,") / n,
        len(zlib.compress(raw, 1)) / size, by[[60, 62, 91, 93, 123, 125]].sum() / n,
    ]


class Forest:
    """Trees as arrays: node i of a tree has children 2i + 1 and 2i + 2; the walk takes `depth` steps."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float, depth: int):
        self.feature, self.threshold, self.leaf, self.base, self.depth = feature, threshold, leaf, base, depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + math.exp(-self.base)))
        out = np.empty(len(x))
        tree = np.arange(len(self.feature))
        for a in range(0, len(x), 2048):
            rows = x[a : a + 2048]
            at = np.zeros((len(rows), len(tree)), np.int64)
            i = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[i, self.feature[tree, at]] > self.threshold[tree, at])
            out[a : a + 2048] = self.base + self.leaf[tree, at - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 48, rate: float = 0.12, l2: float = 2.0, least: int = 12) -> Forest:
    """Boosted trees for labels y (0 or 1) by second-order splits on histograms of binned features."""
    rate_of_ones = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = math.log(rate_of_ones / (1 - rate_of_ones))
    inner = 2**depth - 1
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)), base, depth)
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    n, f = binned.shape
    flat = binned + np.arange(f) * bins
    margin = np.full(n, base)
    feature, threshold, leaf = (np.zeros((trees, k), d) for k, d in ((inner, np.int64), (inner, np.float64), (2**depth, np.float64)))
    threshold[:] = np.inf
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            k = 2**d
            at = (node[:, None] * (f * bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, f), k * f * bins).reshape(k, f, bins).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = hist, [v[:, :1, -1:] for v in hist]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(k, -1).argmax(1)
            bf, bb = best // bins, best % bins
            ok = (gain.reshape(k, -1)[np.arange(k), best] > 1e-6) & (bb < np.array([len(c) for c in cuts])[bf])
            for j in np.flatnonzero(ok):
                feature[t, k - 1 + j], threshold[t, k - 1 + j] = bf[j], cuts[bf[j]][bb[j]]
            right = ok[node] & (binned[np.arange(n), bf[node]] > bb[node])
            node = 2 * node + right
        sums = [np.bincount(node, v, 2**depth) for v in (g, h)]
        leaf[t] = -rate * sums[0] / (sums[1] + l2)
        margin += leaf[t][node]
    return Forest(feature, threshold, leaf, base, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text, label of at most limit labelled documents outside the held-out fold, by smallest hash of the id.

    The ids that are broadcast number at most limit. Of the texts of an id the one with the smallest hash is taken.
    """
    ids = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("double").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(limit)
    )
    rows = doc_texts(docs).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("t")).select("doc_id", "t.text", "label")


def train(docs: DataFrame, labels: DataFrame, limit: int = 12_000) -> Forest:
    """A forest from at most limit labelled documents (one row of features each reaches the driver)."""
    fields = T.StructType([T.StructField("x", T.ArrayType(T.FloatType()))])
    stats = per_text(lambda: lambda texts: [(statistics(t),) for t in texts], fields)
    rows = labelled_sample(docs, labels, "quality", limit).select("doc_id", "label", stats("text")["x"].alias("x")).collect()  # limit rows at most
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.array([r[2] for r in rows], np.float32).astype(np.float64).reshape(-1, len(FEATURES))
    return grow(x, np.array([r[1] for r in rows]))


def quality_score(docs: DataFrame, forest: Forest) -> Column:
    """The score of column `text`, between 0 and 1."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        def work(texts):
            x = np.array([statistics(t) for t in texts], np.float32).astype(np.float64)
            return [(float(s),) for s in held.value.scores(x)]

        return work

    return per_text(make, T.StructType([T.StructField("score", T.DoubleType())]))("text")["score"]


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    forest = train(docs, labels, limit)
    own = doc_texts(docs)
    out = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(own, forest).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = 12_000) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least threshold."""
    forest = train(docs, labels, limit)
    name = free_name(docs, "quality_score")
    return docs.withColumn(name, quality_score(docs, forest)).filter(F.col(name) >= threshold).drop(name)
