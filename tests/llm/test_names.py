"""Every operator gives back user columns that are named like its own columns."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from corpusrank.llm import exact_dedup, fill_middle, jaccard_join, line_rules, lm_scoring, media, mixing, piece_codec, quality, queries, secret_scan, sharding, url_filter
from corpusrank.llm.common import scratch_path

TEXTS = ["", None, "one two three four five six", "one two three four five six", "a " * 6000, "token=abcdefgh1 0123456789abcdef0123456789abcdef", "é漢字"]
REPLACED = {"text", "doc_id", "source", "lang", "n_chars", "url"}


def internal_names(*modules):
    """Every quoted name in the modules' source that could be a column."""
    found = {}
    for m in (*modules, __import__("corpusrank.llm.common", fromlist=["x"])):
        for name in re.findall(r"[\"'`. (](_?[a-zA-Z]\w*)", Path(m.__file__).read_text()):
            if name.startswith("_") or re.search(rf"[\"']{name}[\"']", Path(m.__file__).read_text()):
                found.setdefault(name.lower(), name)
    return sorted(v for k, v in found.items() if k not in REPLACED and not k.startswith("__"))


def table(spark, names):
    rows = [(i, t, "en", f"s{i % 2}", 1, "http://a.org/x", *[f"{n} {i}" for n in names]) for i, t in enumerate(TEXTS)]
    kinds = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "url string", *(f"`{n}` string" for n in names)]
    return spark.createDataFrame(rows, ", ".join(kinds)).repartition(2)


def store(df):
    s = sharding.ShardStore(df.sparkSession, scratch_path(df.sparkSession, "store"))
    s.append(df)
    return s.read()


def scored(df):
    labels = df.sparkSession.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    return quality.score(df, quality.fit(df, labels))


def coded(df):
    return piece_codec.decode(piece_codec.encode(df, queries.piece_model()), queries.piece_model())


CASES = {
    "sharding": (store, (sharding,), set()),
    "quality": (scored, (quality,), {"score"}),
    "urls": (lambda df: url_filter.judge_urls(df, queries.URL_RULES), (url_filter,), {"host", "path", "rule", "verdict"}),
    "codec": (coded, (piece_codec,), {"ids", "decoded"}),
    "round trip": (lambda df: piece_codec.round_trip(df, queries.piece_model()), (piece_codec,), {"ids", "decoded"}),
    "jaccard": (jaccard_join.keep_one, (jaccard_join,), set()),
    "secrets": (secret_scan.find_secrets, (secret_scan,), {"secrets"}),
    "exact": (exact_dedup.drop_copies, (exact_dedup,), set()),
    "mixing": (lambda df: mixing.Mix(df).rows(df), (mixing,), {"shard"}),
    "fill": (lambda df: fill_middle.restore(fill_middle.fill_in_middle(df)), (fill_middle,), {*fill_middle.RESULT, "restored"}),
    "lines": (lambda df: line_rules.content_only(line_rules.judge(df, line_rules.LineField.blank())), (line_rules,), {*line_rules.RESULT, "content"}),
    "media": (lambda df: media.with_feature(media.MediaStore.write(df).payloads()), (media,), {"n_bytes", "payload", "media", "n_chunks", "feature"}),
}


@pytest.mark.parametrize("case", CASES)
def test_user_columns_stay(spark, case):
    run, modules, results = CASES[case]
    names = [n for n in internal_names(*modules) if n.lower() not in results]
    df = table(spark, names)
    got = run(df).collect()
    assert got and len(names) > 5 and set(df.columns) - {"text"} - results <= set(got[0].asDict())
    for r in got:
        assert all(r[n] == f"{n} {r.doc_id}" for n in names)
    df = table(spark, sorted(results))  # columns named like the result's are replaced
    assert set(run(df).columns) >= results


def test_lm_scores_beside_any_column(spark):
    df = table(spark, internal_names(lm_scoring))
    got = lm_scoring.WordModel(df, queries.piece_model()).score(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(TEXTS)))


def test_pipeline_keeps_user_columns(spark, sf_dir):
    modules = (corpus_pipeline, quality, exact_dedup, jaccard_join, mixing, piece_codec)
    names = [n for n in internal_names(*modules) if n not in ("ids", "decoded", "n_tokens", "round_trip")]
    docs = table(spark, names)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    for r in docs.collect():
        assert all(r[n] == f"{n} {r.doc_id}" for n in names)
