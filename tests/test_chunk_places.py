"""Chunks get chapter and parent where their text is read."""

from pyspark.sql import functions as F

from corpusrank.functions import text as T
from corpusrank.functions.profiles import LATIN
from corpusrank.operators import chunk, lines


def test_white_space_is_what_java_matches(spark):
    points = [p for p in range(1, 0x10000) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    assert {r.p for r in rows.where(F.col("c").rlike(r"(?U)^\s$")).collect()} == set(map(ord, T.WHITE_SPACE))


def test_texts_are_cut_once_and_chunks_are_not_shuffled(spark):
    body = "The plan of the team is written down and then read again by others. "
    text = "Opening words " + body * 12 + "\nChapter 1 Aims.\n" + body * 40 + "\nChapter 2 Means.\n" + body * 30 + "\x1c　"
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "Chapter 1 Alone", None), (4, body * 9, None), (5, "7 " * 400, "c")], "doc_id long, text string, source string")
    found = chunk.both_granularities(df, LATIN)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1
    got = {(r.doc_id, r.granularity): [] for r in found.collect()}
    for r in found.orderBy("position").collect():
        got[r.doc_id, r.granularity].append(r)
    assert set(got) == {(1, "small"), (1, "large"), (4, "small"), (4, "large")}
    clean = df.select(T.clean_text(F.col("text"))).first()[0]
    heads = [(x.start, x.title) for x in lines.chapters(df.select("doc_id", T.clean_text(F.col("text")).alias("text")), LATIN).where("doc_id = 1").orderBy("start").collect()]
    assert len(heads) == 2
    for r in got[1, "small"]:
        assert clean[r.position :].startswith(r.content) and r.parent_content in clean
        before = [title for start, title in heads if start <= r.position]
        assert r.chapter == (before[-1] if before else "") and r.chunk_id == f"a_1_small_chunk_{r.chunk_index}"
    assert got[4, "small"][0].chunk_id == "4_small_chunk_0"
