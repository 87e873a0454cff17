"""What the flow from documents to results does once, and what it leaves out."""

import numpy as np
from pyspark.sql import functions as F

from corpusrank.functions import text as T
from corpusrank.functions.profiles import LATIN, ZH
from corpusrank.operators import vectors
from corpusrank.plans import engine


def test_a_search_sorts_only_what_reaches_the_best_so_far(monkeypatch):
    rng = np.random.default_rng(2)
    x, q, ids = rng.random((4000, 8)), rng.random((7, 8)), np.array([f"{i % 97}-{i}" for i in range(4000)], object)
    widths, sort = [], np.lexsort
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: widths.append(keys[0].shape[1]) or sort(keys, axis=axis))
    row, found, scores = vectors._running_best(np.arange(7), q, [(ids, x, None)], 10)
    assert sum(widths) < 40 * 20 * 0.8 and widths[-1] < 20
    for i, s in enumerate(x @ q.T[:, i] for i in range(7)):
        want = sorted(zip((-s).round(9), ids))[:10]
        assert sorted(zip((-scores[row == i]).round(9), found[row == i])) == want


def test_texts_are_cut_into_tokens_once_for_index_and_vectors(spark):
    docs = spark.createDataFrame([(i, f"The planning of step{i} sets goals for the team and names what leads to them. " * 12, "book") for i in range(5)], "doc_id long, text string, source string")
    kb = engine.build(docs, LATIN)
    assert kb.index.by_document._scratch_path in kb.vectors.inputFiles()[0]
    want = {r.chunk_id: r.e for r in kb.chunks.select("chunk_id", engine.default_embed(LATIN)(F.col("content")).alias("e")).collect()}
    assert {r.chunk_id: r.embedding for r in kb.vectors.collect()} == want and want


def test_cleaning_and_counts_equal_the_patterns(spark):
    odd = [f"{chr(i)}a{chr(i)}  b{chr(i)}" for i in [*range(0x300), *range(0x1680, 0x1690), *range(0x180B, 0x1810), *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0xFEFF, 0x4E00, 0x20000]]
    df = spark.createDataFrame([(x,) for x in [*odd, "", "  ", " \n\n\n\n a   b\r\n\t c \x85 \n", None]], "c string")
    c, ends = F.col("c"), r"(?U)^\s+|\s+$"
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\t]", ""), r"\n{3,}", "\n\n"), " +", " ")
    same = [T.strip(c).eqNullSafe(F.regexp_replace(c, ends, "")), T.clean_text(c).eqNullSafe(F.regexp_replace(clean, ends, ""))]
    same += [T.characters_of(c, p).eqNullSafe(F.regexp_count(c, F.lit(p))) for p in (LATIN.script, ZH.script)]
    for x in same:
        assert df.where(~x).count() == 0
