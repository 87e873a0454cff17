"""The corpus pipeline: five stages over documents, each a table that the next one reads.

quality classifier -> exact dedup -> n-gram Jaccard join -> mixing to target weights -> SentencePiece encoding and decoding
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.llm import exact_dedup, jaccard_join, mixing, piece_codec, quality
from corpusrank.llm.common import materialize, table, unused_names
from corpusrank.llm.queries import QUALITY_LEAST, piece_model


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of these documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (own,) = unused_names(docs, "quality")
    return quality.score(docs, model, score_col=own).where(F.col(own) >= QUALITY_LEAST).drop(own)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (whole, up to twice), dealt to shards and shuffled within them."""
    return mixing.Mix(docs).rows(docs, shard_col=None)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, their ids, and whether decoding gives the text back."""
    coded = piece_codec.round_trip(docs, piece_model())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": same}).drop("decoded")


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenize),
]

#: No stage but the second can be said in SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
