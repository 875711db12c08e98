"""The corpus pipeline against stages computed by plain code, and the registration of its queries."""

import re
from collections import Counter

import numpy as np
import pytest
from test_groups import near_rows
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from veilspark.llm import mixture, quality
from veilspark.llm.queries import QUERIES, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, with its input."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = corpus_pipeline.scratch.kept(stage(spark, docs, SF), "stage")
        out.append((name, docs, new))
        docs = new
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [new.columns for _, _, new in stages[:-1]] == [want] * 4


def test_quality(spark, stages):
    _, docs, new = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.train(docs, labels)
    kept = Counter(tuple(r) for r in docs.collect() if forest.scores(np.array([quality.statistics(r.text)], np.float32).astype(float))[0] >= 0.3)
    assert rows(new) == kept
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in new.collect()}
    assert len(good & after) >= 0.97 * len(good & before)


def test_exact(stages):
    _, docs, new = stages[1]
    first = {}
    for r in docs.collect():
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[t] = min(first.get(t, r), r, key=lambda x: x.doc_id)
    assert rows(new) == Counter(map(tuple, first.values()))


def test_near(stages):
    _, docs, new = stages[2]
    found = near_rows([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert Counter(r.doc_id for r in new.collect()) == Counter(d for d, _, c in found.elements() if d == c)


def test_mix(stages):
    _, docs, new = stages[3]
    copies = {r.doc_id: r.copies for r in mixture.mixed(docs).collect()}
    assert rows(new) == Counter({tuple(r): copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]})


def test_bpe(stages):
    _, docs, new = stages[4]
    library = Tokenizer.from_file(vocabulary_path())
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in new.collect()) == want


def test_run_is_the_stages(spark, stages):
    key = lambda df: Counter((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1][2])


def test_registered():
    found = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in found)] == []
    assert found["pipeline"] is corpus_pipeline.run and set(QUERIES) <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
