"""Matched pairs where scores tie or where a shared token lowers them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusrank import registry
from corpusrank.functions.profiles import LATIN
from corpusrank.operators import lexical, qa


def test_products_that_differ_in_their_last_digits_tie_by_id(spark):
    rows = [("b", "one", "", "case", [0.6 + 1e-15]), ("a", "two", "", "case", [0.6]), ("c", "three", "", "case", [0.6])]
    pairs = spark.createDataFrame(rows, "qa_id string, question string, answer string, qa_type string, e array<double>")
    table = F.create_map(*[x for r in rows for x in (F.lit(r[1]), F.array(*map(F.lit, r[4])))], F.lit("ask"), F.array(F.lit(1.0)))
    asked = spark.createDataFrame([("q", "ask", "case", [])], "query_id string, query string, query_type string, entities array<string>")
    for kind in (None, "qa_type"):
        got = qa.search(pairs, asked, lexical.tokenizer(LATIN, 2), lambda c: table[c], k=1, type_col=kind).collect()
        assert sorted((r["rank"], r.qa_id) for r in got) == [(1, "a")]


@pytest.mark.parametrize("name", ["rnk_qa", "rnk_qa_typed"])
def test_pairs_without_a_shared_token_pass_those_that_common_terms_lower(spark, tmp_path, name):
    questions = ["alpha alpha alpha beta beta beta"] * 36 + ["x"] * 3
    turns = [(i, t, role, text) for i, q in enumerate(questions) for t, role, text in ((0, "user", q), (1, "assistant", "alpha"))]
    tables = {"conversations": (turns, "conv_id long, turn int, role string, text string"), "benchmark": ([(0, "alpha beta x"), (1, "alpha beta x")], "item_id long, text string")}
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(registry.SQL[name]).fetchall()
    assert any(q in ("36-0", "37-0", "38-0") for _, q, _, _ in want)
    got = registry.QUERIES[name](spark, f"file://{tmp_path}").select("query_id", "qa_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
