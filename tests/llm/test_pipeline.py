"""The pipeline, stage by stage, each against a brute-force version on what its predecessor kept."""

from collections import Counter

import pytest

import corpus_pipeline
from corpusrank.llm import mixing, piece_codec, quality, queries
from corpusrank.llm.common import materialize

from .test_models import classes
from .test_simple import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), name.split()[0]))
    return out


def test_names_and_columns(tables):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(t.columns == COLUMNS for t in tables[:-1])


def test_classifier_rejects_by_its_score(spark, sf_dir, tables):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score(tables[0], quality.fit(tables[0], labels)).collect()}
    kept = {r.doc_id for r in tables[1].collect()}
    assert kept == {i for i, s in scores.items() if s >= queries.QUALITY_LEAST}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_exact_copies_go(tables):
    best = {}
    for r in tables[1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted(best.values())


def test_near_copies_go(tables):
    want = {c for _, c in classes([(r.doc_id, r.text) for r in tables[2].collect()]).values()}
    assert {r.doc_id for r in tables[3].collect()} == want


def test_mix_takes_what_it_says(tables):
    taken = {r.doc_id: r.taken for r in mixing.Mix(tables[3]).taken().collect()}
    rows = tables[4].collect()
    count = Counter(r.doc_id for r in rows)
    size = {r.doc_id: words(r.text) for r in rows}
    assert all(count[i] * size[i] == taken[i] for i in count) and max(count.values()) <= 2
    assert sum(size[i] * n for i, n in count.items()) == sum(taken.values())


def test_ids_are_the_library_s(tables):
    sp = piece_codec._processor(queries.piece_model())
    rows = tables[5].collect()
    assert len(rows) == tables[4].count()
    for r in rows:
        assert r.ids == sp.encode(r.text, add_eos=True) and r.n_tokens == len(r.ids) and r.round_trip


def test_pipeline_takes_an_empty_table(spark, sf_dir, tables):
    docs = tables[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
