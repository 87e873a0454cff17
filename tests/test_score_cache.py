"""Kept reranker scores: equal to a dictionary, only buckets that hold a key are read, writers at once lose nothing."""

import threading

from pyspark.sql import functions as F

from corpusrank.operators import rank
from corpusrank.plans import score_cache

KINDS = "cache_key string, chunk_id string, ce_score double"


def scores(spark, names, chunks=3):
    return spark.createDataFrame([(n, str(c), hash((n, c)) % 1000 / 7) for n in names for c in range(chunks)], KINDS)


def asked(spark, names):
    return spark.createDataFrame([(n,) for n in names], "cache_key string")


def as_dict(df):
    rows = df.collect()
    out = {(r.cache_key, r.chunk_id): r.ce_score for r in rows}
    assert len(out) == len(rows)
    return out


def test_lookup_equals_a_dictionary(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert score_cache.lookup(asked(spark, ["a"]), path).count() == 0 == score_cache.load(spark, path).count()
    score_cache.append(scores(spark, []), path)  # no row, no version
    all_rows = {}
    for at in range(0, 180, 60):
        part = scores(spark, [f"k{i}" for i in range(at, at + 70)])  # ten keys are in two parts
        all_rows |= as_dict(part)
        score_cache.append(part.unionByName(spark.createDataFrame([(None, "0", 1.0)], KINDS)), path)
    names = ["k3", "k65", "k189", "k190", "other", None, "k3"]
    want = {k: v for k, v in all_rows.items() if k[0] in names}
    assert as_dict(score_cache.lookup(asked(spark, names), path)) == want and len(want) == 9
    assert as_dict(score_cache.load(spark, path)) == all_rows
    assert score_cache.compact(spark, path, least=3) and not score_cache.compact(spark, path)
    assert as_dict(score_cache.lookup(asked(spark, names), path)) == want
    assert len(score_cache.vacuum(spark, path, keep=1)) == 3
    assert as_dict(score_cache.load(spark, path)) == all_rows
    assert score_cache.lookup(asked(spark, []), path).count() == 0


def test_only_hit_buckets_are_read(spark, tmp_path, monkeypatch):
    path, names = f"file://{tmp_path}/cache", [f"k{i}" for i in range(2000)]
    score_cache.append(scores(spark, names, chunks=1), path)
    some = asked(spark, ["k7", "k8", "missing"])
    assert {r.cache_key for r in score_cache.hits(some, path).collect()} == {"k7", "k8"}
    out = score_cache.lookup(some, path)
    assert {r.cache_key for r in out.collect()} == {"k7", "k8"}
    assert 1 <= len({f.split("/bucket=")[1].split("/")[0] for f in out.inputFiles() if "/scores/" in f}) <= 2
    assert spark.read.parquet(f"{path}/scores").select("bucket").distinct().count() == score_cache.BUCKETS
    wanted = as_dict(score_cache.lookup(asked(spark, names[:50]), path))
    monkeypatch.setattr(score_cache, "BROADCAST_KEYS", 10)
    assert as_dict(score_cache.lookup(asked(spark, names[:50]), path)) == wanted


def test_two_writers_and_a_compaction_lose_nothing(spark, tmp_path):
    path, errors = f"file://{tmp_path}/cache", []
    for n in range(2):
        score_cache.append(scores(spark, [f"first{n}"]), path)

    def run(f):
        try:
            f()
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=run, args=(lambda w=w: [score_cache.append(scores(spark, [f"w{w}-{n}"]), path) for n in range(2)],)) for w in range(2)]
    writers.append(threading.Thread(target=run, args=(lambda: score_cache.compact(spark, path, least=2),)))
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not errors
    assert {k for k, _ in as_dict(score_cache.load(spark, path))} == {f"first{n}" for n in range(2)} | {f"w{w}-{n}" for w in range(2) for n in range(2)}


def test_rerank_takes_scores_from_the_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([(q, f"query {q}", str(c), c + 1) for q in range(4) for c in range(5)], "query_id long, query string, chunk_id string, final_rank int")
    known = lambda keys: score_cache.lookup(keys, path)
    _, new, _ = rank.rerank_cached(rows.where("query_id < 2"), F.lit(0.25), known)
    score_cache.append(new, path)
    ranked, new, stats = rank.rerank_cached(rows, F.lit(0.75), known)
    assert {(r.query_id, r.ce_score) for r in ranked.collect()} == {(0, 0.25), (1, 0.25), (2, 0.75), (3, 0.75)}
    assert new.count() == 10 and stats.first().asDict() == {"hits": 2, "misses": 2, "hit_rate": 0.5}
