"""Evaluation metrics over a table of evaluations: query_id, query_type, difficulty, context_relevance_score, is_sufficient, chunks.

Each query is reduced to a few figures in its row; what is shuffled is one partial sum for each group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (3, 5, 8, 10, 15)
GRADES = (("A", 0.80, 0.80, 0.90), ("B+", 0.65, 0.65, 0.75), ("B", 0.50, 0.50, 0.60))
FAILURES = ("F1_zero_relevant", "F2_low_precision", "F3_insufficient", "F4_poor_ranking", "F5_low_relevance")


def _top(k: int | None) -> Column:
    return F.slice("chunks", 1, k) if k else F.col("chunks")


def _relevant(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: x["is_relevant"]))


def precision_of(k: int | None) -> Column:
    """Share of relevant chunks among a query's first k; null for a query without chunks."""
    top = _top(k)
    return F.when(F.size("chunks") > 0, _relevant(top) / F.size(top))


def first_relevant() -> Column:
    """Position of a query's first relevant chunk, from 1, or null."""
    at = F.array_position(F.transform("chunks", lambda x: x["is_relevant"]), F.lit(True))
    return F.when(at > 0, at)


def reciprocal_rank(k: int) -> Column:
    first = first_relevant()
    return F.when(first <= k, 1 / first).otherwise(0.0)


def rounded(c: Column) -> Column:
    """Four digits, ties up: nine digits first, so that the order in which doubles were added never decides."""
    return F.round(F.round(c, 9) + 1e-10, 4)


def _mean(c: Column) -> Column:
    return rounded(F.coalesce(F.avg(c), F.lit(0.0)))


def _columns(ks=KS) -> dict[str, Column]:
    out = {f"context_precision@{k}": _mean(precision_of(k)) for k in ks}
    out |= {f"ranking_quality@{k}": _mean(reciprocal_rank(k)) for k in ks}
    out["hit_rate@10"] = _mean((F.coalesce(first_relevant(), F.lit(99)) <= 10).cast("double"))
    out["context_relevance"] = _mean(F.coalesce("context_relevance_score", F.lit(0)) / 5)
    out["context_sufficiency"] = _mean(F.coalesce("is_sufficient", F.lit(False)).cast("double"))
    out["context_utilization"] = _mean(precision_of(None))
    return out


def metrics(evaluations: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(metric, value)."""
    cols = _columns(ks)
    one = evaluations.agg(*[c.alias(n) for n, c in cols.items()])
    return one.select(F.explode(F.create_map(*[x for n in cols for x in (F.lit(n), F.col(f"`{n}`"))])).alias("metric", "value"))


def group_metrics(evaluations: DataFrame, k: int = 10) -> DataFrame:
    """(grouping, value, n, precision, relevance, sufficiency, ranking_quality) by type and by difficulty in one pass."""
    figures = evaluations.select(
        "query_type", "difficulty", precision_of(k).alias("p"), (F.coalesce("context_relevance_score", F.lit(0)) / 5).alias("r"),
        F.coalesce("is_sufficient", F.lit(False)).cast("double").alias("s"), reciprocal_rank(k).alias("q"),
    )
    grouped = figures.groupingSets([["query_type"], ["difficulty"]], "query_type", "difficulty").agg(
        F.grouping("query_type").alias("_g"), F.count("*").alias("n"), _mean(F.col("p")).alias("context_precision"), _mean(F.col("r")).alias("context_relevance"),
        _mean(F.col("s")).alias("context_sufficiency"), _mean(F.col("q")).alias("ranking_quality"),
    )
    by_type = F.col("_g") == 0
    return grouped.select(
        F.when(by_type, "query_type").otherwise("difficulty").alias("grouping"), F.when(by_type, F.col("query_type")).otherwise(F.col("difficulty")).alias("value"),
        "n", "context_precision", "context_relevance", "context_sufficiency", F.when(by_type, F.col("ranking_quality")).alias("ranking_quality"),
    )


def failures(evaluations: DataFrame) -> DataFrame:
    """(failure, n): none relevant (and nothing else), low precision, insufficient, first relevant late, low score."""
    some = _relevant(F.col("chunks")) > 0
    tests = (
        ~some, some & (precision_of(None) < 0.3), some & ~F.coalesce("is_sufficient", F.lit(False)), some & (first_relevant() > 5),
        some & (F.coalesce("context_relevance_score", F.lit(0)) < 3),
    )
    one = evaluations.agg(*[F.count(F.when(t, 1)).alias(n) for n, t in zip(FAILURES, tests, strict=True)])
    return one.select(F.explode(F.create_map(*[x for n in FAILURES for x in (F.lit(n), F.col(n))])).alias("failure", "n"))


def details(evaluations: DataFrame) -> DataFrame:
    """One row for each query."""
    return evaluations.select(
        "query_id", "query", "query_type", "difficulty", F.size("chunks").alias("total_chunks"), _relevant(F.col("chunks")).alias("relevant_chunks"),
        F.round(F.coalesce(precision_of(None), F.lit(0.0)), 4).alias("precision"), "context_relevance_score", "is_sufficient", first_relevant().alias("first_relevant_rank"),
    )


def grade(precision: Column, relevance: Column, sufficiency: Column) -> Column:
    out = F.lit("C")
    for name, p, r, s in reversed(GRADES):
        out = F.when((precision >= p) & (relevance >= r) & (sufficiency >= s), name).otherwise(out)
    return out


def report(evaluations: DataFrame, share_insufficient: float | None = 0.3) -> DataFrame:
    """One row: the metrics, the grade and the bottleneck. share_insufficient: None leaves out that bottleneck (the quick report)."""
    cols = _columns()
    some = _relevant(F.col("chunks")) > 0
    lacking = some & ~F.coalesce("is_sufficient", F.lit(False))
    one = evaluations.agg(
        F.count("*").alias("n"), F.count(F.when(~some, 1)).alias("_f1"), F.count(F.when(lacking, 1)).alias("_f3"), *[c.alias(n) for n, c in cols.items()]
    )
    weak = group_metrics(evaluations).where((F.col("grouping") == "query_type") & (F.col("context_precision") < 0.5))
    weak = weak.agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("weak_types"))
    one = one.join(weak)  # two rows of one
    none_found = F.col("_f1") > F.col("n") * 0.1
    short = F.col("_f3") > F.col("n") * share_insufficient if share_insufficient is not None else F.lit(False)
    bottleneck = F.when(none_found, "no relevant chunk").when(short, "insufficient context").when(F.col("weak_types") != "", F.concat(F.lit("low precision: "), "weak_types"))
    advice = F.when(none_found, "widen recall").when(short, "raise top-k or chunk size").when(F.col("weak_types") != "", "improve expansion and reranking")
    return one.select(
        "n", *[F.col(f"`{c}`") for c in cols], grade(F.col("`context_precision@10`"), F.col("context_relevance"), F.col("context_sufficiency")).alias("grade"),
        F.coalesce(bottleneck, F.lit("none")).alias("bottleneck"), F.coalesce(advice, F.lit("none")).alias("suggestion"),
    )


def qa_statistics(pairs: DataFrame, type_col: str = "qa_type", doc_col: str = "source_doc") -> DataFrame:
    """(grouping, value, n) of stored pairs by type and by document."""
    g = pairs.groupingSets([[type_col], [doc_col]], type_col, doc_col).agg(F.grouping(type_col).alias("_g"), F.count("*").alias("n"))
    return g.select(F.when(F.col("_g") == 0, type_col).otherwise(doc_col).alias("grouping"), F.when(F.col("_g") == 0, F.col(type_col)).otherwise(F.col(doc_col)).alias("value"), "n")


def qa_documents(pairs: DataFrame, doc_col: str = "source_doc") -> DataFrame:
    """One row: how many documents have pairs, and the fewest and most that one has."""
    per = pairs.groupBy(F.coalesce(doc_col, F.lit("unknown")).alias("d")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("documents"), F.min("n").alias("least"), F.max("n").alias("most"))


def collection(results: DataFrame) -> DataFrame:
    """One row about collected results (query_id, retrieved_chunks, retrieval_time_ms): queries, chunks, chunks a query, mean time."""
    n = F.count("*")
    return results.agg(
        n.alias("queries"), F.coalesce(F.sum(F.size("retrieved_chunks")), F.lit(0)).alias("chunks"),
        F.round(F.avg(F.size("retrieved_chunks")), 1).alias("chunks_per_query"), F.round(F.avg("retrieval_time_ms"), 0).alias("mean_ms"),
    )


def collected(results: DataFrame) -> DataFrame:
    """(query_id, chunks, documents): chunks and distinct source documents of each collected result."""
    docs = F.size(F.array_distinct(F.transform("retrieved_chunks", lambda c: c["source_doc"])))
    return results.select("query_id", F.size("retrieved_chunks").alias("chunks"), docs.alias("documents"))
