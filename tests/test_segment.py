"""Word segmentation: paths against all cuts of a run, learned words against counts, and runs of other letters."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusrank.functions.profiles import ZH
from corpusrank.operators import lexical, segment


def every_cut(run):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(run)]
        yield [run[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@pytest.mark.parametrize("seed", range(5))
def test_path_is_the_least_of_all_cuts(seed):
    rng = random.Random(seed)
    chars = "甲乙丙丁"
    words = {"".join(rng.choices(chars, k=rng.randint(1, 4))): rng.randint(0, 20) for _ in range(25)} | {"": 30}
    for _ in range(60):
        run = "".join(rng.choices(chars + "戊", k=rng.randint(1, 9)))
        cost = lambda ws: sum(words.get(w, 30 if len(w) == 1 else 10**9) for w in ws)
        got = segment.best_path(run, words, 4)
        assert "".join(got) == run and cost(got) == min(cost(ws) for ws in every_cut(run))
        least = [ws for ws in every_cut(run) if cost(ws) == cost(got)]
        assert got == max(least, key=lambda ws: [len(w) for w in ws])  # of equal ones the longer first word


def test_learned_words_equal_counts(spark):
    rng = random.Random(1)
    parts = ["管理", "组织文化", "员工", "的", "与", "激励理论", "OKR", "。", " "]
    texts = ["".join(rng.choices(parts, k=30)) for _ in range(40)] + [None, "", "abc 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = Counter()
    for t in texts:
        runs = "".join(c if "一" <= c <= "鿿" else " " for c in t or "").split()
        counts.update(r[i : i + m] for r in runs for i in range(len(r)) for m in range(1, 5) if i + m <= len(r))
    assert {r.gram: r.n for r in segment.grams(df).collect()} == counts
    total = sum(n for g, n in counts.items() if len(g) == 1)
    want = {g for g, n in counts.items() if len(g) == 1 or (n >= segment.LEAST and min(n * total / (counts[g[:i]] * counts[g[i:]]) for i in range(1, len(g))) >= segment.COHESION)}
    words = segment.learn(df, known=("管理", "灰度", "SWOT分析"))
    assert {r.word for r in words.collect()} == want | {"管理", "灰度", ""}
    assert {r.word for r in segment.learn(df, most=2).collect() if len(r.word) > 1} == set(sorted((g for g in want if len(g) > 1), key=lambda g: (-counts[g], g))[:2])
    cut = lexical.tokenizer(ZH, words=words)
    rows = spark.createDataFrame([(0, "组织文化与员工。OKR激励理论"), (1, None), (2, "灰度管理龘"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in rows.select("doc_id", cut(F.col("text")).alias("t")).collect()}
    assert got == {0: [w for w in ["组织文化", "与", "员工", "okr", "激励理论"] if w not in ZH.stop_words], 1: [], 2: ["灰度", "管理", "龘"], 3: []}
    assert segment.learn(df.limit(0)).count() == 1


@pytest.mark.parametrize("seed", range(5))
def test_paths_of_pieces_are_the_path_of_the_run(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("甲乙丙丁戊己", k=rng.randint(1, 4))): rng.randint(0, 20) for _ in range(14)} | {"": 30}
    inner = segment.inner_pairs(words)
    for _ in range(60):
        run = "".join(rng.choices("甲乙丙丁戊己庚", k=rng.randint(1, 30)))
        assert [w for p in segment.pieces(run, inner) for w in segment.best_path(p, words, 4)] == segment.best_path(run, words, 4)


def test_sequences_are_counted_in_tasks(spark):
    """No row for each place of a text; one shuffle, of sums. Characters beyond the first plane and repeated rows count too."""
    rows = [(1, "管理𠀀管理ab管"), (1, "管理"), (2, None), (3, "x\x00管\x00管x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = segment.grams(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {r.gram: r.n for r in found.collect() if len(r.gram) != 2} == {"管": 6, "理": 3, "𠀀": 1, "管理𠀀": 1, "理𠀀管": 1, "𠀀管理": 1, "管理𠀀管": 1, "理𠀀管理": 1}
    cut = lexical.tokenizer(ZH, words=spark.createDataFrame([("管理", 1), ("管", 3), ("", 9)], "word string, cost long"))
    got = {(r.doc_id, r.term): r.tf for r in lexical.term_counts(df, cut(F.col("text")), "doc_id").collect()}
    assert got == {(1, "管理"): 3, (1, "𠀀"): 1, (1, "ab"): 1, (1, "管"): 1, (3, "x"): 2, (3, "管"): 2}
