"""Work on lines and chapters: no shuffle where a document is cut, steps computed once, quick patterns equal to plain ones."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusrank import queries_zh
from corpusrank.functions import text as T
from corpusrank.functions.profiles import LATIN, ZH
from corpusrank.operators import dedup, lines, refine

LINES = ["书 号：ISBN 1", "出版社=甲", "table  of contents", "第三章 组织", "1.2 激励", "一、目标", "主要包括", "分为：", "由，计划与控制组成", "三大。", "三大甲", "是指 甲", "是指甲", "因此，", "版权所有，翻印必究",
         "", " ", "甲出版社=乙", "微信号：1", "甲微信号：1", "责任编辑：甲", "(1) 甲", "ISBN", "[General Information]", "本质是", "定价：12元", "Chapter 2", "chapter", "HTTP://甲", "加小编微信或QQ："]


@pytest.mark.parametrize("name", ["noise", "chapter", "chapter_in_text", "section", "definition", "framework", "conclusion", "lead_in", "case"])
def test_quick_patterns_find_the_same(spark, name):
    df = spark.createDataFrame([(x + y,) for x in LINES for y in ("", "甲", " 12", "\n第三章")], "s string")
    for profile in (ZH, LATIN):
        pattern = getattr(profile, name)
        assert df.where(F.col("s").rlike(pattern) != F.col("s").rlike(T.quick(pattern))).count() == 0
    assert T.quick(ZH.noise) != ZH.noise and T.quick(LATIN.noise) == LATIN.noise


def test_strip_of_values(spark):
    rows = [(a + m + b,) for a in ("", " ", "　\t") for m in ("", "甲 乙", "a\nb") for b in ("", "\n", " ", "  ")]
    df = spark.createDataFrame(rows, "s string")
    assert df.where(T.strip_value(F.col("s")) != T.strip(F.col("s"))).count() == 0


def test_chapters_are_cut_without_a_shuffle(spark):
    rows = [(1, "前\n第一章 甲\n第二章 乙\n体\n\n"), (2, "1.1 甲\n体"), (3, "1.1 甲\n1.2 乙"), (4, None), (5, "第一章 甲"), (6, "体\n第一章 甲")]
    parts = refine.split_chapters(spark.createDataFrame(rows, "doc_id long, text string"), ZH)
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, parts.collect()))
    assert got == [(1, 0, "", "前"), (1, 2, "第二章 乙", "体\n\n"), (2, 1, "1.1 甲", "体"), (3, 0, "", "1.1 甲\n1.2 乙"), (4, 0, "", ""), (6, 0, "", "体")]


def test_refinement_computes_a_chapter_once(spark):
    text = "\n".join(f"Paragraph number {i} of a long chapter that is defined as a test and so on." for i in range(300))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    refine.refine(df, LATIN, 3000).collect()  # compiles
    began = time.perf_counter()
    assert refine.refine(df, LATIN, 3000).first().refined.startswith("Paragraph number 0 ")
    assert time.perf_counter() - began < 20  # minutes where each paragraph chose again


def test_content_cleans_only_what_is_cut(spark):
    rows = [(1, "短"), (2, None), (3, "甲\n" + "第一章 乙\n" + "正文" * 40 + "\n" + "出版社=丙\n" + "尾。" * 400), (4, "\n" * 900)]
    got = dict(map(tuple, lines.extract_content(spark.createDataFrame(rows, "doc_id long, text string"), 800, ZH).collect()))
    assert got[1] == "短" and got[2] == "" and got[4] == "" and len(got) == 4
    assert got[3].startswith("第一章 乙\n正文") and "丙" not in got[3] and len(got[3]) <= 800


def test_derived_texts_by_word(spark):
    df = spark.createDataFrame([(1, "a bb\ta"), (2, None), (3, ""), (4, "\xa0x")], "doc_id long, text string")
    out = [r.t for r in df.orderBy("doc_id").select(queries_zh.derived(F.col("text")).alias("t")).collect()]
    at = lambda w: queries_zh.PHRASES[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % len(queries_zh.PHRASES)]
    assert out == [at("a") + at("bb") + at("a"), "", "", at("\xa0x")]  # a no-break space belongs to the word


def test_sets_are_compared_in_slices(spark, monkeypatch):
    rows = [(i, "abcdefghij"[i % 5 :] * 3 + str(i % 7) * (i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, dedup.similar_pairs(df).collect()))
    monkeypatch.setattr(dedup, "VISIT_GRAMS", 30)
    monkeypatch.setattr(dedup, "SLICE_GRAMS", 40)
    assert sorted(map(tuple, dedup.similar_pairs(df).collect())) == want and want
    assert [(s.start, s.stop) for s in dedup._slices(np.array([30, 20, 50, 5, 5]))] == [(0, 1), (1, 2), (2, 3), (3, 5)]
