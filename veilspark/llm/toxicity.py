"""Operator 9, toxicity by weak supervision.

1. Lexemes (words, word beginnings, word endings) are counted in labelled texts outside the held-out fold; those that go
   with toxic texts become lexicons and patterns. Together with a short general list they form many voters.
2. A generative label model is fitted to all votes by expectation-maximisation: each voter has an accuracy, and so has
   the given label, which is one voter among them. Correlations between lexemes given the class are parameters too;
   lexemes that move together (a word, its beginning, its ending) weigh like one voter.
3. A linear classifier on the presence of lexemes is trained on the model's posterior labels and scores whole texts.

Training takes at most `limit` labelled texts, by smallest hash of the id; at most `lexemes` lexemes are kept as features.
Results: null and empty texts have no lexeme and get the score of that, near 0. One toxic word marks a text of any length.
Repeated rows are scored row by row; several labels of one id count as their largest. Without labelled toxic rows only the
general list votes.
"""

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import doc_texts, held_out, lean, per_text
from veilspark.llm.quality import labelled_sample
from veilspark.llm.scratch import kept

WORD = re.compile(r"[^\W\d_]+")
#: General insults (fixed values).
GENERAL = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")
#: A worker remembers the lexemes of so many words.
MEMO = 400_000


def lexemes(word: str) -> list[str]:
    """The word and, where it is longer, its beginnings of 4 to 8 and endings of 4 and 5 letters."""
    n = len(word)
    return [word] + [f"{word[:k]}*" for k in (4, 5, 6, 7, 8) if n > k] + [f"*{word[-k:]}" for k in (4, 5) if n > k]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class LabelModel:
    """Voters that vote toxic (1), clean (-1) or abstain, with the accuracy of each and the correlations between them.

    rows: for each text the lexemes that vote toxic. A text where none votes gets a clean vote from one more voter, and the
    given label is the vote of another. Expectation-maximisation: the hidden class follows from the votes' log odds, a voter's
    accuracy is its expected agreement with the class, and the correlation of two lexemes is that of their votes given the
    class, the larger one of the two classes'. A lexeme's log odds are divided by its redundancy, one and its
    correlations with others as far as they are at least `least`: k lexemes that move together weigh like one.
    """

    def __init__(self, rows: list[list[int]], label: np.ndarray, size: int, prior: float, rounds: int = 25, least: float = 0.3):
        n = len(rows)
        at = np.concatenate([np.repeat(np.arange(n), [max(1, len(r)) for r in rows]), np.arange(n)]).astype(np.int64)
        who = np.concatenate([[x for r in rows for x in r or [size]], np.full(n, size + 1)]).astype(np.int64)
        vote = np.concatenate([np.repeat([1.0 if r else -1.0 for r in rows], [max(1, len(r)) for r in rows]), np.where(label > 0, 1.0, -1.0)])
        self.rows, self.size, self.least = rows, size, least
        self.accuracy, self.redundancy = np.full(size + 2, 0.85), np.ones(size + 2)
        votes = np.bincount(who, minlength=size + 2)
        self.posterior = np.where(label > 0, 1 - prior, prior).astype(float)
        for i in range(rounds):
            if i % 10 == 0:
                self.redundancy[:size] = self.redundant()
            z = math.log(prior / (1 - prior)) + np.bincount(at, vote * (np.log(self.accuracy / (1 - self.accuracy)) / self.redundancy)[who], n)
            self.posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            right = np.where(vote > 0, self.posterior[at], 1 - self.posterior[at])
            self.accuracy = np.clip((np.bincount(who, right, size + 2) + 3.4) / (votes + 4), 0.05, 0.995)

    def redundant(self) -> np.ndarray:
        """1 + the sum of a lexeme's correlations with others given the class, as far as they are at least `least`."""
        found = np.zeros((self.size, self.size), np.float32)
        some = [k for k, r in enumerate(self.rows) if r]
        for weight in (self.posterior, 1 - self.posterior):
            both = np.zeros_like(found)
            for s in range(0, len(some), 512):  # all texts take part, a few at a time
                x = np.zeros((len(some[s : s + 512]), self.size), np.float32)
                for i, k in enumerate(some[s : s + 512]):
                    x[i, self.rows[k]] = 1
                both += (x * weight[some[s : s + 512], None].astype(np.float32)).T @ x
            total = max(float(weight.sum()), 1e-9)
            p = np.diag(both) / total
            scale = np.sqrt(np.maximum(p * (1 - p), 1e-9))
            np.maximum(found, (both / np.float32(total) - p[:, None] * p[None, :]) / scale[:, None] / scale[None, :], out=found)
        np.fill_diagonal(found, 0)
        return 1 + np.where(found >= self.least, found, 0).sum(1)


def linear(rows: list[list[int]], soft: np.ndarray, size: int, l2: float = 0.002, rounds: int = 300, rate: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier on sets of feature ids for soft labels; the last weight is the intercept."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.array([x for r in rows for x in r], np.int64)
    w, sums = np.zeros(size + 1), np.full(size + 1, 1e-6)
    w[-1] = -4.0
    for _ in range(rounds):
        z = np.bincount(at, w[flat], len(rows)) + w[-1]
        d = soft - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.append(np.bincount(flat, d[at], size), d.sum())
        g[:-1] -= l2 * w[:-1]
        sums += g * g
        w += rate * 0.5 * g / np.sqrt(sums)
    return w


def cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The score between the classes: the middle of the gap that leaves fewest texts on the wrong side."""
    order = np.argsort(z, kind="stable")
    z, t = z[order], toxic[order]
    wrong = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((~t)[::-1])[::-1], [0]])
    gap = np.concatenate([[0.0], np.diff(z), [0.0]])
    wrong = np.where(gap > 0, wrong, len(z) + 1)  # texts with equal scores stay together
    k = int(wrong.argmin())
    return float((z[k - 1] + z[k]) / 2) if 0 < k < len(z) and wrong[k] <= len(z) else 0.0


class Toxicity:
    """Scores of texts from lexeme weights."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.memo: dict[str, tuple[str, ...]] = {}

    def __call__(self, texts: list[str | None]) -> list[tuple[float]]:
        out = []
        memo, weights = self.memo, self.weights
        for t in texts:
            words = words_of(t)
            found = list(map(memo.get, words))
            if None in found:
                if len(memo) > MEMO:
                    memo.clear()
                found = [x if x is not None else memo.setdefault(w, tuple(f for f in lexemes(w) if f in weights)) for w, x in zip(words, found, strict=True)]
            hits = {f for x in found if x for f in x}
            z = self.intercept + sum(weights[f] for f in sorted(hits))
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))),))
        return out


def chosen(docs: DataFrame, rate: float, limit_features: int) -> list[tuple[str, int, int]]:
    """Lexemes of docs(text, label) that go with toxic texts, as (lexeme, toxic texts, other texts), best first."""
    schema = "lexeme string, toxic long, clean long"

    def count(batches):
        import pandas as pd

        for pdf in batches:
            n: dict[str, list[int]] = {}
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                for f in {f for w in words_of(text) for f in lexemes(w)}:
                    n.setdefault(f, [0, 0])[0 if label > 0 else 1] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in n.items()], columns=["lexeme", "toxic", "clean"])

    c = docs.select("text", "label").mapInPandas(lean(count), schema).groupBy("lexeme").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    c = kept(c.filter(F.col("toxic") + F.col("clean") >= 3), "lexemes")
    tests = max(1, c.count())
    # Of so many lexemes, fewer than one may go with toxic texts this well by chance.
    by_chance = F.col("toxic") * math.log(max(1e-3, rate)) + F.col("clean") * F.log(F.col("toxic") + F.col("clean") + 1) + math.log(tests)
    best = c.filter((F.col("toxic") >= 3) & (F.col("clean") * 6 <= F.col("toxic")) & (by_chance < 0)).orderBy(F.desc("toxic"), "clean", "lexeme").limit(limit_features)
    return [tuple(r) for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, limit: int = 12_000, limit_features: int = 6_000) -> Toxicity:
    sample = kept(labelled_sample(docs, labels, "toxic", limit), "sample")
    share = sample.agg(F.avg((F.col("label") > 0).cast("int"))).first()[0]
    found = chosen(sample, share or 0.1, limit_features)
    names = list(dict.fromkeys([f for f, _, _ in found] + list(GENERAL)))
    number = {f: i for i, f in enumerate(names)}
    held = sample.sparkSession.sparkContext.broadcast(number)
    fields = T.StructType([T.StructField("x", T.ArrayType(T.LongType()))])
    hits = per_text(lambda: lambda texts: [(sorted({held.value[f] for w in words_of(t) for f in lexemes(w) if f in held.value}),) for t in texts], fields)
    rows = sample.select("doc_id", "label", hits("text")["x"].alias("x")).collect()  # limit rows at most
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    prior = float(np.clip(share or 0.05, 0.01, 0.5))
    model = LabelModel([r[2] for r in rows], np.array([r[1] for r in rows]), len(names), prior)
    w = linear([r[2] for r in rows], model.posterior, len(names)) if rows else np.append(np.full(len(names), 6.0), -4.0)
    if rows:
        z = np.array([w[-1] + sum(w[i] for i in r[2]) for r in rows])
        w[-1] -= cut(z, model.posterior > 0.5)
    return Toxicity({f: float(x) for f, x in zip(names, w, strict=False)}, float(w[-1]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, limit))
    score = per_text(lambda: held.value, T.StructType([T.StructField("score", T.DoubleType())]))
    out = doc_texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text")["score"].alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
