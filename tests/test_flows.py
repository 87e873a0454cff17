"""Saved knowledge bases, envelopes, reports, counters, and searches in blocks against plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusrank.functions import text as T
from corpusrank.functions.profiles import LATIN, ZH
from corpusrank.operators import formatting, lexical, metrics, qa, vectors
from corpusrank.plans import engine
from corpusrank.plans.session import ship
from corpusrank.sources import files

TEXTS = ["Planning sets goals for a team and names the steps that lead to them. ", "Leadership means that people follow a person and trust the choices of that person. "]


@pytest.fixture(scope="module")
def base(spark):
    ship(spark)
    docs = spark.createDataFrame([(i, t * 9, f"book{i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    pairs = spark.createDataFrame([(f"p{i}", f"How does planning {w} work?", f"answer {i}", "method", "book0") for i, w in enumerate("abcdefg")] + [(f"x{i}", f"unrelated matter{i}", "none", "case", "book1") for i in range(30)], "qa_id string, question string, answer string, qa_type string, source_doc string")
    return engine.build(docs, LATIN, pairs=pairs)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "How does planning work with goals?"), ("q2", "leadership and trust"), ("q3", "zzz")], "query_id string, query string")


def rows_of(df):
    return sorted(tuple(str(x) for x in r) for r in df.select("query_id", "rank", "chunk_id", F.round("score", 6)).collect())


def test_a_saved_base_answers_alike_and_is_not_built_again(spark, base, asked, tmp_path):
    path = f"file://{tmp_path}/base"
    assert not engine.is_saved(spark, path)
    with pytest.raises(FileNotFoundError):
        engine.load(spark, path)
    engine.save(base, path)
    loaded = engine.open_or_build(spark, path, lambda: pytest.fail("built again"), profile=LATIN)
    assert loaded.profile is LATIN and loaded.index.documents == base.index.documents and loaded.pairs.count() == 37
    assert rows_of(engine.search(loaded, asked)) == rows_of(engine.search(base, asked)) != []
    files.remove(spark, f"{path}/_versions")  # a base without a manifest is not whole
    assert not engine.is_saved(spark, path)


def test_counters_envelopes_and_reports(spark, base, asked, tmp_path):
    found, counters = engine.search_counted(base, asked)
    counts = {r.query_id: r for r in counters.collect()}
    assert set(counts) == {"q1", "q2", "q3"} and counts["q1"].small_candidates > 0 and counts["q1"].fused_candidates >= counts["q1"].deduped_candidates
    assert sum(r.results for r in counts.values()) == found.count()
    hits, answers = engine.qa_hits(base, asked), engine.answer(base, asked)
    queries = asked.withColumns({"query_type": F.lit("framework"), "difficulty": F.when(F.col("query_id") == "q1", "hard").otherwise("easy")})
    path = f"file://{tmp_path}/results"
    files.save_results_envelope(files.results_of(found, queries, answers, hits, 12.0), path, config={"reranker": True})
    whole = json.loads("".join(r.value for r in spark.read.text(path).collect()))
    assert whole["total_queries"] == 3 and whole["system_config"] == {"reranker": True} and len(whole["results"]) == 3
    back = files.envelope_results(spark, path)
    assert [r.query_id for r in files.pick(back, difficulty="hard").collect()] == ["q1"] and files.pick(back, query_id="q3").first().retrieved_chunks == []
    assert files.pick(back, query_type="definition").count() == 0
    about = metrics.collection(back).first()
    assert (about.queries, about.mean_ms) == (3, 12.0) and about.chunks == found.count()
    judged = engine.evaluate(found, queries, LATIN)
    files.save_evaluations_envelope(judged, f"file://{tmp_path}/evaluations")
    again = files.envelope_evaluations(spark, f"file://{tmp_path}/evaluations")
    assert {r.query_id: len(r.chunks) for r in again.collect()} == {r.query_id: len(r.chunks) for r in judged.collect()}
    text = {r.query_id: r.report for r in formatting.full_reports(found, asked, answers, counters, hits).collect()}
    assert "How does planning work" in text["q1"] and "book0" in text["q1"] and formatting.REPORT[4] in text["q1"] and "[1]" in text["q1"]
    report = metrics.report(judged).first().asDict()
    console = formatting.console_report(report, [r.asDict() for r in metrics.group_metrics(judged).collect()], [r.asDict() for r in metrics.failures(judged).collect()])
    assert f"grade: {report['grade']}" in console and "framework (n=3)" in console and "F1_zero_relevant" in console
    files.save_report(metrics.report(judged), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first().grade == report["grade"]


def test_empty_envelope(spark, tmp_path):
    none = spark.createDataFrame([], files.RESULTS_SCHEMA)
    files.save_results_envelope(none, f"file://{tmp_path}/none")
    assert files.envelope_results(spark, f"file://{tmp_path}/none").count() == 0


def test_paths(spark, tmp_path):
    assert files.check_path("/a/b/c", root="/a/b") == "/a/b/c"
    with pytest.raises(ValueError):
        files.check_path("/a/bc", root="/a/b")
    with pytest.raises(FileNotFoundError):
        files.check_path(f"file://{tmp_path}/none", spark=spark)


def test_word_files_need_enough_text(monkeypatch):
    scanned = {"s": False}
    monkeypatch.setattr(files, "is_scanned", lambda data: scanned["s"])
    table = files.PARSERS | {".docx": lambda d: "x" * 101, ".docx:scanned": lambda d: "o" * 501}
    assert files.parse_word(b"", table)[0] == "x"
    scanned["s"] = True
    assert files.parse_word(b"", table)[0] == "o"
    assert files.parse_word(b"", table | {".docx:scanned": lambda d: "o" * 500})[0] == "x"  # too little: the plain parser is tried
    with pytest.raises(ValueError, match="100 characters"):
        files.parse_word(b"", files.PARSERS | {".docx": lambda d: "x" * 100})


def test_query_instruction_and_dimension(spark, base, asked):
    marked = engine.KnowledgeBase(base.profile, base.chunks, base.vectors, None, base.index, base.embed, "find this ")
    got = asked.limit(1).select(marked.embed_query(F.col("query")).alias("a"), base.embed(F.concat(F.lit("find this "), "query")).alias("b"), base.embed_query(F.col("query")).alias("c")).first()
    assert got.a == got.b != got.c and engine.dimension(spark, base.embed) == 64
    assert ZH.query_instruction and len(ZH.synonyms) > 50


def test_dictionary_words_stay_whole(spark):
    df = spark.createDataFrame([("目标管理与OKR，德鲁克的管理",)], "t string")
    got = df.select(lexical.tokenizer(ZH, 1, ZH.dictionary)(F.col("t")).alias("a"), lexical.tokenizer(ZH)(F.col("t")).alias("b")).first()
    assert got.a == ["目标管理", "okr", "德鲁克", "的管", "管理"] and "标管" in got.b


def test_simplify_takes_the_longest_match_from_the_left(spark):
    singles, phrases = {"乙": "B", "丙": "甲"}, {"甲乙": "1", "乙丙丁": "2", "丙甲": "3"}

    def plain(t):
        table, out, i = singles | phrases, "", 0
        while i < len(t):
            n = next((n for n in (3, 2, 1) if t[i : i + n] in table and len(t[i : i + n]) == n), 0)
            out += table[t[i : i + n]] if n else t[i]
            i += n or 1
        return out

    texts = ["甲乙丙丁", "乙丙丁", "丙甲乙", "x甲\n乙乙丙", "", "丁丁"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.to_simplified(F.col("t"), singles, phrases)).collect()] == [plain(t) for t in texts]


@pytest.mark.parametrize("rows", [5000, 3])
def test_top_k_in_blocks_with_ties_and_tags(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", rows)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    v, q = rng.integers(-2, 3, (90, 3)).astype(float), rng.integers(-2, 3, (8, 3)).astype(float)
    kinds, wanted = [f"k{i % 3}" for i in range(90)], [f"k{i % 4}" for i in range(8)]
    vs = spark.createDataFrame([(i, x.tolist(), kinds[i]) for i, x in enumerate(v)], "vec_id long, embedding array<double>, kind string").repartition(3)
    qs = spark.createDataFrame([(i, x.tolist(), wanted[i]) for i, x in enumerate(q)], "query_id long, embedding array<double>, want string")
    want, tagged = set(), set()
    for i, x in enumerate(q):
        for name, pick in (("all", lambda j: True), ("same", lambda j: kinds[j] == wanted[i]), ("other", lambda j: kinds[j] != wanted[i])):
            best = sorted((-float(x @ v[j]), j) for j in range(90) if x @ v[j] > 0 and pick(j))[:7]
            out = {(i, j, r + 1) for r, (_, j) in enumerate(best)}
            want |= out if name == "all" else set()
            tagged |= set() if name == "all" else {(*o, name == "same") for o in out}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in vectors.top_k(qs, vs, 7).collect()} == want
    assert {(r.query_id, r.vec_id, r["rank"], r.same_tag) for r in vectors.top_k(qs, vs, 7, tags=("want", "kind")).collect()} == tagged


@pytest.mark.parametrize("few", [0, lexical.BROADCAST_TERMS])
def test_bm25_with_common_terms_spread(spark, few, monkeypatch):
    texts = ["a b c", "a a b", "a d", "a", "e f g a", "b b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    qs = spark.createDataFrame([(0, "a b"), (1, "d d e"), (2, "zz")], "query_id long, query string")
    cut = lambda c: F.split(c, " ")
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", few)
    monkeypatch.setattr(lexical, "HOT_TERM", 3)
    index = lexical.build_index(docs, cut(F.col("text")))
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25(index, qs, cut(F.col("query")), ["query_id"]).collect()}
    toks = [t.split() for t in texts]
    n, mean = len(toks), sum(map(len, toks)) / len(toks)
    raw = {w: np.log((n - sum(w in t for t in toks) + 0.5) / (sum(w in t for t in toks) + 0.5)) for t in toks for w in t}
    idf = {w: x if x >= 0 else 0.25 * np.mean(list(raw.values())) for w, x in raw.items()}
    want = {}
    for i, query in enumerate(["a b", "d d e", "zz"]):
        for j, t in enumerate(toks):
            if set(query.split()) & set(t):
                want[i, j] = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.split() if w in idf)
    assert got == pytest.approx(want)


def test_pairs_of_many_types(spark):
    rows = [(f"x{i:02d}", f"word{i}", "a", f"type{i}", [1.0 - i / 100, 0.0]) for i in range(30)]
    pairs = spark.createDataFrame(rows, "qa_id string, question string, answer string, qa_type string, e array<double>")
    table = F.create_map(*[x for r in rows for x in (F.lit(r[1]), F.array(*map(F.lit, r[4])))], F.lit("ask"), F.array(F.lit(1.0), F.lit(0.0)))
    asked = spark.createDataFrame([("q", "ask", "type29", None)], "query_id string, query string, query_type string, entities array<string>")
    got = qa.search(pairs, asked, lexical.tokenizer(LATIN, 2), lambda c: table[c], k=3, type_col="qa_type").orderBy("rank").collect()
    best = sorted(((-(1 - i / 100) * 0.7 * (1.2 if i == 29 else 1), f"x{i:02d}") for i in range(30)))[:3]
    assert [r.qa_id for r in got] == [x for _, x in best]
