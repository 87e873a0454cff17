"""BM25 by block maxima against scores of all documents; names and boosts against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from corpusrank.operators import lexical


def corpus(rng, topics, size, words=40, own=12):
    common = [f"c{i}" for i in range(30)]
    rows = []
    for t in range(topics):
        mine = [f"t{t}w{i}" for i in range(own)]
        for _ in range(size):
            rows.append((len(rows), " ".join(rng.choices(mine, k=words // 2) + rng.choices(common, k=rng.randint(2, words)) + [f"r{rng.randint(0, 400)}"]), f"topic{t} book{rng.randint(0, 3)}"))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    rows = corpus(rng, 12, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    asked = [(i, " ".join(rng.choices(rows[rng.randrange(len(rows))][1].split(), k=rng.choice([1, 3, 9, 30])))) for i in range(25)] + [(90, "unknown words"), (91, ""), (92, "c1 c1 c2"), (93, "topic3 t4w1 topic5")]
    return docs, spark.createDataFrame(asked, "query_id long, query string")


def cut(c):
    return F.filter(F.split(c, " "), lambda x: x != "")


@pytest.mark.parametrize("size", [1, 8, 64])
def test_top_documents_equal_all_scores(spark, made, size, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", size)
    docs, queries = made
    index = lexical.build_index(docs, cut(F.col("text")))
    every = {}
    for r in lexical.bm25(index, queries, cut(F.col("query")), ["query_id"]).collect():
        every.setdefault(r.query_id, {})[r.doc_id] = r.score
    for k in (1, 10, 50):
        got = {}
        found, stats = lexical.bm25_top(index, queries, cut(F.col("query")), ["query_id"], k)
        for r in found.collect():
            assert r.doc_id not in got.setdefault(r.query_id, {})
            got[r.query_id][r.doc_id] = r.score
        for q, scores in every.items():
            want = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
            assert got[q] == {d: pytest.approx(s) for d, s in want}
        assert set(got) == set(every)
    # a question about one topic: blocks of the others are skipped
    if size == 8:
        monkeypatch.setattr(lexical, "CHUNK_BLOCKS", 1)
        one = lexical.bm25_top(index, spark.createDataFrame([(1, "t3w1 t3w2 t3w5 c1")], "query_id long, query string"), cut(F.col("query")), ["query_id"], 3)[1]
        read, all_, skipped, blocks = one.agg(F.sum("postings_read"), F.sum("postings"), F.sum("skipped"), F.sum("blocks")).first()
        assert 0 < read < all_ / 2 and skipped > blocks / 2
    monkeypatch.setattr(lexical, "QUERY_ROWS", 7)  # several rounds of queries
    again, _ = lexical.bm25_top(index, queries, cut(F.col("query")), ["query_id"], 50)
    assert {(r.query_id, r.doc_id) for r in again.collect()} == {(q, d) for q, found in got.items() for d in found}
    assert lexical.bm25_top(index, queries.limit(0), cut(F.col("query")), ["query_id"])[0].count() == 0


def test_search_with_names_equals_the_loop(spark, made, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 8)
    docs, queries = made
    index = lexical.build_index(docs, cut(F.col("text")))
    got = {}
    for r in lexical.search(index, queries, cut(F.col("query")), ["query_id"], 12, docs, cut(F.col("name"))).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, round(r.score, 7))
    score = {}
    for r in lexical.bm25(index, queries, cut(F.col("query")), ["query_id"]).collect():
        score.setdefault(r.query_id, {})[r.doc_id] = r.score
    names = {r.doc_id: set(r.name.split()) for r in docs.collect()}
    for q in queries.collect():
        base = score.get(q.query_id, {})
        most = max(base.values(), default=0)
        final = {}
        for d, name in names.items():
            s = base.get(d, 0) / most if most > 0 else base.get(d, 0)
            shared = len(name & set(q.query.split()))
            s = min(s + 0.3 * shared / len(name), 1.5) if shared else s
            if s > 0:
                final[d] = s
        want = sorted(final.items(), key=lambda x: (-round(x[1], 9), x[0]))[:12]
        assert got.get(q.query_id, {}) == {i: (d, round(s, 7)) for i, (d, s) in enumerate(want, 1)}


def test_empty_index(spark, made):
    docs, queries = made
    index = lexical.build_index(docs.limit(0), cut(F.col("text")))
    assert lexical.search(index, queries, cut(F.col("query")), ["query_id"]).count() == 0


def test_documents_are_counted_in_place(spark, made):
    """A document's terms come in one row, without a shuffle, and an index of stored postings alone finds the same."""
    rows = [(0, ["b", "a", "b"]), (1, []), (2, None), (3, ["知识", "a", "知识", "知识"])]
    counted = spark.createDataFrame(rows, "doc_id long, t array<string>").coalesce(1).select("doc_id", lexical._counted(F.col("t")).alias("c"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.c.dl, dict(zip(r.c.terms, r.c.tfs, strict=True))) for r in counted.collect()}
    assert got == {0: (3, {"a": 1, "b": 2}), 1: (0, {}), 2: (0, {}), 3: (4, {"知识": 3, "a": 1})}
    docs, queries = made
    index = lexical.build_index(docs, cut(F.col("text")))
    again = lexical.index_of(index.postings, index.documents)
    assert index.by_document is not None and again.by_document is None
    best = lambda i: {(r.query_id, r.doc_id, round(r.score, 9)) for r in lexical.bm25_top(i, queries, cut(F.col("query")), ["query_id"], 10)[0].collect()}
    assert best(index) == best(again)
