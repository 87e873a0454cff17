"""Clean-up of a stream: any split equals the batch result, restarts and replays add nothing twice, old sets expire."""

import random

import pytest
from pyspark.sql import functions as F

from corpusrank.operators import dedup
from corpusrank.plans import versions
from corpusrank.streaming import dedup as stream_dedup

KIND = "doc_id long, text string, at timestamp, id string"


def documents(n=60):
    """Chains of edited texts, exact copies, parts of others, empty and null texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    out: list[str | None] = []
    for i in range(n):
        if i % 10 == 8:
            out.append([None, "", "ab"][i // 10 % 3])
        elif i < 5 or rng.random() < 0.3:
            out.append(" ".join(word() for _ in range(40)))
        else:
            words = (out[rng.choice([k for k in range(i) if out[k] and len(out[k]) > 9])] or "").split()
            for _ in range(rng.choice([0, 1, 4, 8])):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words[: rng.choice([20, 40, 40])]))
    return out


def arrive(spark, rows, folder, number):
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{folder}/file={number}")


def run(spark, tmp_path, **how):
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    stream_dedup.drop_similar(source, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", **how).awaitTermination(240)
    return sorted(r.doc_id for r in stream_dedup.kept(spark, f"file://{tmp_path}/out").collect())


@pytest.fixture(scope="module")
def rows():
    return [(i, t, None, "x") for i, t in enumerate(documents())]


@pytest.mark.parametrize("cuts", [(25,), (3, 4, 40)])
def test_any_split_equals_the_batch(spark, tmp_path, rows, cuts, monkeypatch):
    monkeypatch.setattr(dedup, "BATCH_ROWS", 16)  # several portions
    want = sorted(r.doc_id for r in dedup.content_dedup(spark.createDataFrame(rows, KIND)).collect())
    assert 15 < len(want) < 50
    edges = [0, *cuts, len(rows)]
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        arrive(spark, rows[a:b], tmp_path / "in", n)
        if n == 0:
            run(spark, tmp_path)  # and again after a restart
    assert run(spark, tmp_path) == want == run(spark, tmp_path)
    assert stream_dedup.kept(spark, f"file://{tmp_path}/out").columns == ["doc_id", "text", "at", "id"]


def test_a_failed_commit_is_run_again(spark, tmp_path, rows, monkeypatch):
    arrive(spark, rows[:12], tmp_path / "in", 0)
    commit = versions.commit

    def fails(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "commit", fails)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path)
    monkeypatch.setattr(versions, "commit", commit)
    want = sorted(r.doc_id for r in dedup.content_dedup(spark.createDataFrame(rows[:12], KIND)).collect())
    assert run(spark, tmp_path) == want


def test_horizon(spark, tmp_path, rows):
    text = rows[0][1]
    for n, day in enumerate([1, 2, 20]):
        made = spark.createDataFrame([(n, text)], "doc_id long, text string").select("*", F.to_timestamp(F.lit(f"2024-01-{day:02d}")).alias("at"), F.lit("x").alias("id"))
        made.write.parquet(f"file://{tmp_path}/in/file={n}")
        run(spark, tmp_path, time_col="at", horizon=5 * 86400.0)
    assert run(spark, tmp_path, time_col="at", horizon=5 * 86400.0) == [0, 2]
    with pytest.raises(ValueError):
        run(spark, tmp_path, horizon=1.0)
