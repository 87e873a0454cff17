"""Queries against their SQL on rows that only larger tables have."""

import duckdb

from corpusrank import registry


def by_sql(name, d, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    return sorted(map(repr, con.execute(registry.SQL[name]).fetchall()))


def by_spark(name, spark, d):
    return sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, f"file://{d}").collect())


def test_values_that_round_to_zero_keep_their_sign(spark, tmp_path):
    rows = [(0, [-1e-7, 1.0]), (1, [1e-7, -1.0]), (2, [0.6, -0.8]), (3, [0.0, 0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert by_spark("vec_normalize", spark, tmp_path) == by_sql("vec_normalize", tmp_path, "embeddings")


def test_conversations_that_begin_alike_share_no_cached_scores(spark, tmp_path):
    rows = [(c, t, "user", x) for c, xs in {0: ["alpha beta", "alpha"], 1: ["alpha beta", "gamma"], 2: ["alpha beta", "alpha beta"]}.items() for t, x in enumerate(xs)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert by_spark("rnk_rerank_cached", spark, tmp_path) == by_sql("rnk_rerank_cached", tmp_path, "conversations")
