"""Saved bases that grow and shrink: equal to a base built of what is left; readers and writers at once."""

import pytest
from pyspark.sql import functions as F

from corpusrank.functions.profiles import LATIN, ZH
from corpusrank.operators import segment
from corpusrank.plans import engine, versions
from corpusrank.plans.session import ship

TOPICS = ["Planning sets goals for a team and names the steps that lead to them", "Leadership means that people follow a person", "Culture is what a group does when nobody looks", "Money moves from buyers to sellers of goods"]
HAN = ["管理是指通过计划与组织达成目标的过程。团队的绩效来自激励员工。", "竞争战略包括成本与差异。市场细分决定顾客的价值。", "组织文化影响流程与标准化。领导力应该授权。"]


def documents(spark, ids, texts=TOPICS):
    rows = [(i, "".join(f"{texts[(i + j) % len(texts)]}{'' if texts is HAN else f' in part {j * i % 7}. '}" for j in range(3 + i % 4)) * 3, f"book{i % 3}") for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def answers(kb, queries):
    found = engine.search(kb, queries).select("query_id", "rank", "chunk_id", F.round("score", 6), F.round("rrf", 9))
    return sorted(tuple(map(str, r)) for r in found.collect())


@pytest.mark.parametrize("profile", [LATIN, ZH], ids=["latin", "zh"])
def test_changes_equal_a_rebuild(spark, tmp_path, profile):
    ship(spark)
    texts, path = (TOPICS, HAN)[profile is ZH], f"file://{tmp_path}/base"
    asked = spark.createDataFrame([("q1", "goals of planning 计划与目标"), ("q2", "culture and leadership 组织文化"), ("q3", "money 竞争战略")], "query_id string, query string")
    words = segment.learn(documents(spark, range(12), texts), known=profile.dictionary) if profile is ZH else None
    engine.save(engine.build(documents(spark, range(6), texts), profile, words=words), path)
    before = engine.load(spark, path, profile=profile)
    first = before.chunks.count()
    engine.add(spark, path, documents(spark, range(6, 9), texts), profile=profile)
    engine.remove(spark, path, spark.createDataFrame([(1,), (7,), (99,)], "doc_id long"))
    engine.add(spark, path, documents(spark, [1, 10], texts), profile=profile)  # 1 comes back
    engine.remove(spark, path, spark.createDataFrame([(2,)], "doc_id long"))
    left = [0, 1, 3, 4, 5, 6, 8, 10]
    kb, again = engine.load(spark, path, profile=profile), engine.build(documents(spark, left, texts), profile, words=words)
    assert kb.index.documents == again.index.documents and kb.index.average == pytest.approx(again.index.average)
    terms = lambda x: {r.term: (r.df, round(r.idf, 9)) for r in x.index.terms.collect()}
    assert terms(kb) == terms(again)
    assert {r.chunk_id for r in kb.chunks.collect()} == {r.chunk_id for r in again.chunks.collect()} == {r.chunk_id for r in kb.vectors.collect()}
    if profile is LATIN:
        assert answers(kb, asked) == answers(again, asked) != []
    assert before.chunks.count() == first and before.index.documents == first  # who reads an old version goes on with it
    if profile is ZH:
        return
    engine.save(kb, path)  # one part again
    assert versions.numbers(spark, path) == [1, 2, 3, 4, 5, 6]
    assert len(engine.vacuum(spark, path, keep=1)) >= 5 and terms(engine.load(spark, path, profile=profile)) == terms(again)


def test_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    versions.commit(spark, path, {"version": 1, "x": "a"})
    with pytest.raises(versions.CommitConflict):
        versions.commit(spark, path, {"version": 1, "x": "b"})
    assert versions.read(spark, path) == {"version": 1, "x": "a"}
    seen = []

    def change(last):
        seen.append(last["version"])
        if len(seen) == 1:  # another writer commits meanwhile
            versions.commit(spark, path, {"version": 2, "x": "other"})
        return {"x": last["x"] + "+"}

    engine._commit(spark, path, change)
    assert seen == [1, 2] and versions.read(spark, path) == {"version": 3, "x": "other+"}
    assert versions.read(spark, f"file://{tmp_path}/none") is None


def test_a_save_that_fails_leaves_the_old_base(spark, tmp_path, monkeypatch):
    ship(spark)
    path = f"file://{tmp_path}/base"
    kb = engine.build(documents(spark, range(3)), LATIN)
    engine.save(kb, path)
    monkeypatch.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        engine.save(engine.build(documents(spark, range(2)), LATIN), path)
    assert versions.numbers(spark, path) == [1] and engine.load(spark, path, profile=LATIN).index.documents == kb.index.documents
