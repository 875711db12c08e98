"""Operators on single texts: quality, language, tokens, BPE, toxicity."""

import random
import re
import struct
import time
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import AWKWARD
from tokenizers import Tokenizer

from veilspark.llm import bpe, bytebpe, common, langid, quality, tokencount, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.load(PATH)


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["a", "b", "'", "'s", "'re", "'r", "'ll", "e", " ", "  ", "\n", "\t", "1", "é", "漢", "!", "<|endoftext|>", "　", "the", " the", "😀", "\x1c", "\x85", "\r\n", "ʼ", "\U00010940"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counts_and_codec_match_the_library(spark, awkward, library):
    want = {}
    for r in AWKWARD:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.setdefault(r[0], []).append((len((r[1] or "").encode()), len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got: dict = {}
    for r in tokencount.token_counts(awkward, PATH).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_tokens))
        assert r.over_limit == (r.n_tokens > 512)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(x[:2] for x in v) for k, v in want.items()}
    got = {}
    for r in bpe.encoding_digests(awkward, PATH).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(x[1:] for x in v) for k, v in want.items()}
    assert {(r.doc_id, r.decoded) for r in bpe.encoded(awkward, PATH).collect()} == {(r[0], r[1] or "") for r in AWKWARD}


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_counts_on_random_texts_for_any_chunk(vocabulary, library, chunk):
    texts = [*random_texts(600, chunk), "a" * 3000, "=" * 900 + " " * 900 + "x", "\n" * 700 + "'re" * 300, None, ""]
    counts = tokencount.TokenCounts(vocabulary)
    counts.segmenter = tokencount.Segmenter(chunk)
    assert [n for _, n in counts(texts)] == [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counter_survives_forgetting(vocabulary, library, monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 20)
    monkeypatch.setattr(tokencount, "STATES", 50)
    monkeypatch.setattr(bpe, "MEMO", 20)
    counts, codec = tokencount.TokenCounts(vocabulary), bpe.Codec(vocabulary)
    for text in random_texts(80, 5):
        ids = library.encode(text, add_special_tokens=False).ids
        assert counts([text])[0][1] == len(ids)
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == ids


def test_classes_agree_with_the_library(library):
    kind, pre = tokencount.classes(), library.pre_tokenizer
    rng = random.Random(1)
    points = [*range(0x20, 0x600), *(rng.choice([*range(0x600, 0xD800), *range(0xE000, 0x20000)]) for _ in range(5000)), *(a for a, _ in bytebpe.LATER_RANGES)]
    for c in points:
        if c == 0x27:
            continue
        joins = [len(pre.pre_tokenize_str(x + chr(c))) == 1 for x in "a1!"]
        k = int(kind[c])
        assert joins == [k in (1, 6, 7, 8, 9), k == 2, k == 0], hex(c)


def test_other_tokenizers_are_refused():
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        with pytest.raises(ValueError):
            bytebpe.load(public_tokenizers.path(name))


def test_empty_tables(spark, nothing, labels):
    for df in (tokencount.token_counts(nothing, PATH), bpe.encoding_digests(nothing, PATH), quality.scored(nothing, labels), langid.languages(nothing), toxicity.scored(nothing, labels)):
        assert df.count() == 0


def test_awkward_rows(spark, awkward, labels, nothing):
    empty = labels.limit(0)
    for scored in (quality.scored, toxicity.scored):
        for own in (labels, empty):
            rows = scored(awkward, own).collect()
            assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
            assert {r.doc_id: r.held_out for r in rows if r.doc_id} == {i: crc32(str(i).encode()) % 5 == 0 for i in range(1, 12)}
    rows = {r.doc_id: r for r in langid.languages(awkward).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 11))
    assert rows[7].lang_pred in ("en", "de", "fr", "es")
    assert {r.lang_pred for r in langid.languages(awkward.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_scores_ignore_labels_lang_source_and_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'zz' AS source", "n_chars"))
    for scored in (quality.scored, toxicity.scored):
        rows = {r.doc_id: r.score for r in scored(twice, labels).collect()}
        assert all(rows[i] == rows[i + 1_000_000] for i in rows if i < 1_000_000)


@pytest.mark.parametrize(("rows", "limit"), [(1, 1), (2, 3), (1024, 5), (1024, 8_000_000)])
def test_pieces_of_a_batch_are_all_its_rows_in_order(monkeypatch, rows, limit):
    monkeypatch.setattr(common, "ROWS", rows)
    texts = ["a", None, "", "bcdefgh", "é", None, "x" * 9]
    for own in (texts, []):
        got = list(common.batch_pieces(pa.array(own, pa.string()), limit))
        assert [t for run in got for t in run] == own and all(got)
        assert all(len(run) <= rows and (len(run) == 1 or sum(len(t or "") for t in run) <= limit) for run in got)


def test_lean_passes_batches_and_errors_on():
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // b for b in batches))(iter([1, 0])))


def test_forward_backward_matches_brute_force():
    rng = np.random.default_rng(0)
    sizes, k = np.array([1, 3, 64, 65, 128, 200, 129]), 3
    emit, trans, start = rng.normal(size=(sizes.sum(), k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    post, pair, logz = langid.posteriors(emit, sizes, trans, start)
    at, want_pair, want_z = 0, np.zeros((k, k)), 0.0
    lse = lambda x, ax: np.log(np.exp(x - x.max()).sum(ax)) + x.max()
    for n in sizes:
        e, a, b = emit[at : at + n], np.zeros((n, k)), np.zeros((n, k))
        a[0] = start + e[0]
        for i in range(1, n):
            a[i] = e[i] + lse(a[i - 1][:, None] + trans, 0)
        for i in range(n - 2, -1, -1):
            b[i] = lse(trans + (e[i + 1] + b[i + 1])[None], 1)
        z = lse(a[-1], 0)
        want_z += z
        assert np.allclose(np.exp(a + b - z), post[at : at + n])
        want_pair += sum(np.exp(a[i - 1][:, None] + trans + (e[i] + b[i])[None] - z) for i in range(1, n))
        at += n
    assert np.allclose(pair, want_pair) and np.isclose(logz, want_z)


def test_code_switched_words():
    en = ["the house is with the other and this from that"] * 20
    es = ["la casa con los otros para que esta desde donde"] * 20
    field = langid.fit(en + es, ["en"] * 20 + ["es"] * 20)
    got = [lang for _, lang, _ in field.word_labels("the house is with la casa con los otros")]
    assert got == ["en"] * 4 + ["es"] * 5


def test_letters_of_long_runs_count():
    def bag(word):
        at, found = langid.features(["the", word, "casa"])
        return sorted(found[at == 1].tolist())

    run = "abcdefghij" * 5
    assert bag(run + "xyz") != bag(run + "uvw") and bag(run + "q" * 3000 + "r") != bag(run + "q" * 3000 + "s")
    assert len(bag(run)) == 2 + 8 + 49 + 48 and len(bag(run[:40])) == 2 + 8 + 39 + 38
    assert set(langid.long_features(run[:40])[1:]) <= set(bag(run[:40]))  # one and the same feature, whatever a word's length
    en, es = "the house is with the other and this from that", "la casa con los otros para que esta desde donde"
    field = langid.fit([en] * 20 + [es] * 20, ["en"] * 20 + ["es"] * 20)
    glued = lambda a, b: (a * 2).replace(" ", "")[:40] + (b * 30).replace(" ", "")
    assert [lang for lang, _ in field([glued(en, es), glued(es, en)])] == ["es", "en"]
    assert field([en.replace(" ", "") * 20_000])[0][0] == "en"


def test_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ", None), (2, "12 ①", None), (3, "the house ½", None), *((10 + i, "the house is with the other", "en") for i in range(20))], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(docs).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"


def test_words_cost_little_more_than_a_plain_search():
    every = "".join(f"a{chr(i)}b " for i in range(0x110000))
    assert langid.words_of(every) == langid.WORD.findall(every.lower())
    text, plain = "Ein Wort, zwei Wörter, élan vital 12 " * 20_000, re.compile(r"[^\W\d_]+")

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: langid.words_of(text)) < 3 * least(lambda: plain.findall(text.lower()))


def test_label_model_matches_plain_expectation_maximisation():
    rng = random.Random(4)
    label = np.array([int(rng.random() < 0.3) for _ in range(60)])
    rows = [sorted({v for v in range(6) if rng.random() < (0.5 if y else 0.05)} | ({4, 5} if y and rng.random() < 0.6 else set())) for y in label]
    size, prior = 6, 0.3
    got = toxicity.LabelModel(rows, label, size, prior)
    accuracy, redundancy = [0.85] * 8, [1.0] * 8
    post = [1 - prior if y else prior for y in label]
    votes = [[(v, 1) for v in r] or [(6, -1)] for r in rows]
    votes = [v + [(7, 1 if y else -1)] for v, y in zip(votes, label, strict=True)]
    for k in range(25):
        if k % 10 == 0:
            for i in range(size):
                redundancy[i] = 1.0
                for j in range(size):
                    best = 0.0
                    for w in (post, [1 - x for x in post]):
                        t = sum(w)
                        pi, pj, pij = (sum(x for x, r in zip(w, rows, strict=True) if has <= set(r)) / t for has in ({i}, {j}, {i, j}))
                        best = max(best, (pij - pi * pj) / np.sqrt(max(pi * (1 - pi), 1e-9) * max(pj * (1 - pj), 1e-9)))
                    redundancy[i] += best if i != j and best >= 0.3 else 0
        z = [np.log(prior / (1 - prior)) + sum(s * np.log(accuracy[v] / (1 - accuracy[v])) / redundancy[v] for v, s in vs) for vs in votes]
        post = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z]
        for v in range(8):
            right = [p if s > 0 else 1 - p for p, vs in zip(post, votes, strict=True) for u, s in vs if u == v]
            accuracy[v] = min(max((sum(right) + 3.4) / (len(right) + 4), 0.05), 0.995)
    assert np.allclose(got.posterior, post, atol=1e-4) and np.allclose(got.accuracy, accuracy, atol=1e-4) and np.allclose(got.redundancy, redundancy, atol=1e-3)
    assert got.redundancy[4] > 1.3 and got.redundancy[5] > 1.3


def test_all_lexemes_of_long_texts_count_in_correlations():
    rows = [list(range(500))] * 6 + [[0], [1], []] * 6
    model = toxicity.LabelModel(rows, np.array([1] * 6 + [0] * 18), 500, 0.3)
    assert model.redundancy[2:500].min() > 400


def test_long_pretokens(vocabulary, library, monkeypatch):
    rng = random.Random(11)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    want = library.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(tokencount, "STATES", 3000)
    monkeypatch.setattr(tokencount, "FITS", 3000)
    counts, codec = tokencount.TokenCounts(vocabulary), bpe.Codec(vocabulary)
    assert counts([word])[0][1] == len(want)
    assert len(counts.counter.of) <= 3002 and len(counts.counter.fits) <= 3000 and len(counts.counter.known) == len(counts.counter.of)
    assert np.frombuffer(codec.encode([word, "a " + word[:300], "some words"])[0], "<u4").tolist() == want
    assert max(map(len, codec.memo)) <= bpe.LONG


def test_forest_walk_matches_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = quality.grow(x, y, trees=30)
    for row, s in zip(x[:50], f.scores(x[:50]), strict=True):
        z = f.base
        for t in range(len(f.feature)):
            i = 0
            while i < len(f.feature[t]):
                i = 2 * i + 1 + (row[f.feature[t, i]] > f.threshold[t, i])
            z += f.leaf[t, i - len(f.feature[t])]
        assert np.isclose(s, 1 / (1 + np.exp(-z)))
    assert (((f.scores(x) > 0.5) == y).mean()) > 0.95


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="the driver's tables are absent")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = quality.scored(docs, labels).join(labels, "doc_id").filter("held_out")
    assert q.filter("predicted = quality").count() / q.count() > 0.97
    t = toxicity.scored(docs, labels).join(labels, "doc_id").filter("held_out")
    assert t.filter("toxic = 1 and predicted = 1").count() / t.filter("toxic = 1").count() > 0.85
    assert t.filter("toxic = 0 and predicted = 0").count() / t.filter("toxic = 0").count() > 0.98
    lang = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert lang.filter("lang = lang_pred").count() / lang.count() > 0.98
