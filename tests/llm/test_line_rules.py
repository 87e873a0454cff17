"""op13: figures and labels against brute force, the field against all labellings, decisions on held-out labels."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusrank.llm import line_rules as lr
from corpusrank.llm import queries
from corpusrank.llm.quality import fold_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts, inside, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def texts(rng, n):
    words = ["a", "bé", "C", "d#", "漢", "<|>", "x1", "end.", "no!", "\xa0q", "\x1cr"]
    gaps = [" ", " ", " ", "\n", "\n\n", "\t", "\r\n", "  \n "]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 90))).strip() + rng.choice(["", "\n", " "]) for _ in range(n)]


ODD = [None, "", "\n", " \n\t", "word", "word\n", "\nword", "a a a", "a a a a", "é" * 100_000, "x y z\n" * 3000, "A!! " * 60, "same line here\n\nsame line here\nSame line here"]


def test_figures_of_slices_equal_brute_force():
    all_texts = [*ODD, *texts(random.Random(4), 300)]
    got = lr.lines_of(pa.array(["before", *all_texts], pa.string()).slice(1))
    for i, t in enumerate(all_texts):
        assert tuple(int(got.rows[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == figures(t)[:5]
        lines = (t or "").split("\n")
        numbers = got.number[got.row == i].tolist()
        assert numbers == [k for k, x in enumerate(lines) if WORD.search(x)]
        assert got.chars[got.row == i].tolist() == [sum(map(len, WORD.findall(lines[k]))) for k in numbers]
    alone = [lr.lines_of(pa.array([t])).bins for t in all_texts]
    assert np.array_equal(np.concatenate(alone), got.bins)  # neighbours in a slice do not matter


def test_features_of_a_line():
    names, edges = list(lr.FEATURES), list(lr.FEATURES.values())
    got = lr.lines_of(pa.array(["Ab, cd 12 12 x#!"])).bins[0]
    want = {"words": 5, "chars a word": 12 / 5, "capitals": 1 / 12, "digits": 4 / 12, "symbols a word": 1 / 5, "exclamations a word": 1 / 5, "stops a word": 1 / 5, "equal neighbours": 1 / 5, "repeated windows": 0, "distinct words": 4 / 5, "repeats a line": 0, "begins with": 1, "ends with": 3}
    assert got.tolist() == [int(np.searchsorted(edges[i], want[n])) for i, n in enumerate(names)]


def test_windows_of_many_words():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, 400)
    assert lr.repeated_windows(ids, 5).tolist() == lr.repeated_windows(ids, 1 << 21).tolist()


def field_of(rng):
    return lr.LineField(rng.normal(size=(len(lr.FEATURES), lr.WIDTH)), rng.normal(size=(2, 2)), rng.normal(size=2))


def score(field, scores, labels):
    return field.begin[labels[0]] + sum(scores[i] * y for i, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))


def test_field_equals_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, field = int(rng.integers(1, 8)), field_of(rng)
        scores = rng.normal(size=n)
        every = list(itertools.product((0, 1), repeat=n))
        weights = np.array([score(field, scores, y) for y in every])
        assert field.decode(scores.tolist()) == list(every[int(weights.argmax())])
        total, marginal, moved = lr.chain_marginals(field, np.pad(scores, (0, 3))[None], np.array([n]))
        p = np.exp(weights - total[0])
        assert p.sum() == pytest.approx(1)
        assert marginal[0, :n, 1] == pytest.approx(p @ np.array(every))
        for a, b in itertools.product((0, 1), repeat=2):
            assert moved[a, b] == pytest.approx(sum(q * sum((y[i], y[i + 1]) == (a, b) for i in range(n - 1)) for q, y in zip(p, every, strict=True)))
    assert field.decode([]) == []


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    size = np.array([5, 1, 3])
    bins = rng.integers(0, 4, (3, 5, len(lr.FEATURES))).astype(np.uint8)
    labels, field = rng.integers(0, 2, (3, 5)), field_of(rng)
    _, slope, _ = lr.gradient(field, bins, labels, size)
    for name in ("weights", "moves", "begin"):
        x = getattr(field, name)
        for at in [(0, 1), (3, 2), (5, 0)] if name == "weights" else [(0, 1), (1, 1)] if name == "moves" else [(0,), (1,)]:
            was = x[at]
            x[at] = was + 1e-5
            up = lr.gradient(field, bins, labels, size)[0]
            x[at] = was - 1e-5
            down = lr.gradient(field, bins, labels, size)[0]
            x[at] = was
            assert (up - down) / 2e-5 == pytest.approx(getattr(slope, name)[at], abs=1e-4)


def test_odd_rows_and_labels(spark):
    rows = [(i, t, "mine") for i, t in enumerate([*ODD, "x y z\n" * 3000])] + [(None, "a", "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    field = lr.fit(df, none)
    got = lr.content_only(lr.judge(df, field)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == figures(r.text)
        assert r.kept == (not r.base_failed) and r.content_share == (1.0 if r.n_words else 0.0)  # nothing learned: all is content
        assert r.content == (r.text or "") and len(r.line_labels) == len((r.text or "").split("\n"))
    assert lr.judge(df.limit(0), field).count() == 0 == lr.judge(df.limit(0), lr.fit(df.limit(0), none.limit(0))).count()
    one_label = spark.createDataFrame([(4, 1), (9, 1)], "doc_id long, quality int")
    assert not lr.fit(df, one_label).weights.any()


def test_lines_of_junk_are_marked(spark):
    """Documents whose label the field did not see; and junk inside a document."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = lr.fit(docs, labels)
    again = lr.fit(docs.repartition(7), labels)
    assert np.allclose(field.weights, again.weights) and np.allclose(field.moves, again.moves)
    rows = lr.judge(docs.where(fold_of("doc_id") == 0).join(labels, "doc_id"), field).collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert len(good) > 50 and len(bad) > 10
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.1
    text = next(r.text for r in good if 4 <= r.text.count("\n") <= 12 and set(r.line_labels) == {"C"})
    mixed = spark.createDataFrame([(1, text.rstrip("\n") + "\n" + "THE!! OF!! AND!! ING!! ER!! ON!! " * 5)], "doc_id long, text string")
    got = lr.content_only(lr.judge(mixed, field)).first()
    assert re.fullmatch("C+B", got.line_labels) and got.content == text.rstrip("\n")


def test_query(spark, sf_dir):
    got = queries.op13_quality_rules(spark, sf_dir)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == figures(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.content_share >= lr.CONTENT_LEAST)
    assert got.where(F.col("kept")).count() > 0
