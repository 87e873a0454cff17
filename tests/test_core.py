"""Operators outside llm: reference semantics in the zh profile on inline texts, properties, and DuckDB on the smallest tables."""

import io
import json
import random
import zipfile
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusrank import registry
from corpusrank.functions import text as T
from corpusrank.functions.profiles import LATIN, ZH
from corpusrank.operators import chunk, clustered, dedup, filters, judge, lines, query, rank, refine, vectors
from corpusrank.plans.session import ship
from corpusrank.sources import files
from corpusrank.streaming import ingest


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def value(spark, c, *texts):
    return [r[0] for r in frame(spark, *texts).orderBy("doc_id").select(c(F.col("text"))).collect()]


def test_clean_and_simplify(spark):
    assert value(spark, T.clean_text, "a\r\tb   c\n\n\n\nd　", None, "") == ["ab c\n\nd", "", ""]
    table = {"運": "运", "營": "营", "銷": "销"}
    assert value(spark, lambda c: T.to_simplified(c, table, {"運營": "运营", "營銷": "营销"}), "運營銷") == ["运营销"]


def test_cues_need_no_word_character_after_them(spark):
    assert value(spark, lambda c: c.rlike(ZH.definition), "所谓，管理", "所谓管理", "这是指 甲") == [True, False, True]


def test_preprocess_quirks(spark):
    text = "前言部分内容\n\n\n第二行文字\n\n第二行文字\n12\n\n12\n\n管理\nab\nISBN 978-7\n 末行文字 \n中信出版社"
    got = lines.preprocess(frame(spark, text, "", "a"), ZH).orderBy("doc_id").collect()
    assert [r.clean_text for r in got] == ["前言部分内容\n\n第二行文字\n\n管理\n末行文字", "", ""]


def test_chapters_and_asof(spark):
    text = "引子\n第一章 管理\n内容甲\n第二章 组织\n内容乙"
    heads = lines.chapters(frame(spark, text, "无标题"), ZH)
    assert [(r.start, r.end, r.title) for r in heads.orderBy("start").collect()] == [(3, 14, "第一章 管理"), (14, 24, "第二章 组织")]
    at = spark.createDataFrame([(0, 0), (0, 3), (0, 13), (0, 14), (1, 0)], "doc_id long, position long")
    assert [r.chapter for r in chunk.with_chapter(at, heads).orderBy("doc_id", "position").collect()] == ["", "第一章 管理", "第一章 管理", "第二章 组织", ""]


def test_names(spark):
    names = ["管理学 - z-library.pdf", "战略__地图(第二版).txt", "a(b).md", "[x].docx", ".pdf"]
    assert value(spark, lines.clean_doc_name, *names) == ["管理学", "战略-地图", "a(b)", "[x]", ".pdf"]
    f = spark.createDataFrame([("书.pdf",), ("书.md",), ("别.docx",), ("别.doc",)], "filename string")
    assert sorted(r.filename for r in lines.pick_variants(f).collect()) == ["书.md", "别.docx"]


def test_split_text_partitions_and_bounds():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("甲乙丙。；，\n a.", k=rng.randint(0, 400)))
        size = rng.randint(1, 60)
        got = chunk.split_text(text, size, ZH.separators)
        assert "".join(got) == text and all(0 < len(c) <= size for c in got)
    assert chunk.split_text("一。二。三三三三。四", 4, ZH.separators) == ["一。二。", "三三三三", "。", "四"]


def test_chunks_of_chinese_text(spark):
    text = "第一章 管理\n" + "".join("".join(chr(0x4E00 + (37 * i + 11 * j) % 3000) for j in range(30)) + "。" for i in range(60))
    df = frame(spark, text).withColumn("source", F.lit("书"))
    got = chunk.chunks_with_parents(df, "small").orderBy("chunk_index").collect()
    assert got and {r.chapter for r in got} == {"第一章 管理"} and all(len(r.content) <= 600 for r in got)
    assert all(r.content[:20] in r.parent_content or r.position > 0 for r in got)
    assert chunk.chunks_with_parents(df.limit(0)).count() == 0


def test_filters(spark):
    good = "管理是指，通过计划与组织来协调资源。战略分为，总体战略与竞争战略。因此，目标很重要。"
    case = "例如, 某公司在当年进行了一次改组，员工普遍感到满意并且留了下来，此后销售额逐年上升了不少。"
    rows = spark.createDataFrame([(1, good), (2, case), (3, "短"), (4, "abc " * 20)], "id long, content string")
    assert {r.id: r.quality_weight for r in filters.filter_chunks(rows).collect()} == {1: 1.0, 2: 0.7}
    assert value(spark, lambda c: filters.is_low_quality(c), "管理组织", "1234567管", "abc", "", "好" * 21) == [False, True, True, True, True]


def test_stratified_equals_the_loop(spark):
    rng = random.Random(2)
    rows = [(i, f"d{rng.randint(0, 3)}", rng.choice(["", "a", "b", "c"])) for i in range(300)]
    got = {r.i for r in filters.stratified(spark.createDataFrame(rows, "i long, d string, g string"), 60, "d", "g", ["i"]).collect()}
    want, docs = set(), {}
    for r in rows:
        docs.setdefault(r[1], []).append(r)
    for rs in docs.values():
        b = max(1, 60 * len(rs) // 300)
        groups = {}
        for r in rs:
            groups.setdefault(r[2], []).append(r[0])
        order = [g for k, g in groups.items() if k] + ([groups[""]] if "" in groups else [])
        each = max(1, b // len(order))
        for i, g in enumerate(order):
            k = each + (i < b - each * len(order))
            want |= set(g) if len(g) <= k else {g[int(j * (len(g) / k))] for j in range(k)}
    assert got == want


def test_refine_keeps_head_tail_and_best(spark):
    paras = [f"段落{i}的内容文字，长度超过十个字符。" for i in range(20)]
    paras[10] = "管理是指，协调他人完成目标的活动过程。"
    text = "\n\n".join(paras)
    out = refine.refine(frame(spark, text, "短文"), ZH, 200).orderBy("doc_id").collect()
    assert out[1].refined == "短文" and paras[0] in out[0].refined and paras[19] in out[0].refined and paras[10] in out[0].refined
    assert len(out[0].refined) < len(text)
    heads = "第一章 空\n第二章 实\n正文一行\n第三章 末\n正文二行"
    parts = refine.split_chapters(frame(spark, heads)).orderBy("part_no").collect()
    assert [(p.title, p.content) for p in parts] == [("第二章 实", "正文一行"), ("第三章 末", "正文二行")]


def test_pack_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, ["x" * rng.randint(1, 9) for _ in range(rng.randint(0, 12))]) for i in range(80)]
    got = spark.createDataFrame(rows, "i long, p array<string>").select("i", refine.pack(F.col("p"), 10).alias("o")).collect()
    for r in got:
        want, cur = [], ""
        for p in dict(rows)[r.i]:
            if len(cur) + len(p) <= 10:
                cur += p
            else:
                want, cur = want + [cur] * bool(cur), p
        assert r.o == want + [cur] * bool(cur)


@pytest.mark.parametrize("last", [0, 20, dedup.LAST_EDGES])
def test_greedy_drop_equals_the_loop(spark, last, monkeypatch):
    monkeypatch.setattr(dedup, "LAST_EDGES", last)
    rng = random.Random(4)
    edges = {(a, b) for a, b in ((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)) if a < b}
    kept, gone = [], set()
    for v in range(61):
        if any((u, v) in edges for u in kept):
            gone.add(v)
        else:
            kept.append(v)
    got = dedup.greedy_drop(spark.createDataFrame(sorted(edges), "first long, second long"))
    assert {r.id for r in got.collect()} == gone


def test_similar_pairs_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcd", k=60)) for _ in range(12)]
    texts += [t[: rng.randint(30, 60)] + "".join(rng.choices("abcd", k=4)) for t in texts] + ["", "ab", texts[0]]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    want = set()
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if a and b:
                s = 0.85 if len(a & b) / min(len(a), len(b)) > 0.8 else len(a & b) / len(a | b)
                want |= {(j, i)} if s > 0.7 else set()
    pairs, members = dedup.similar_sets(frame(spark, *texts))
    of = {r.id: r.rep for r in members.collect()}
    assert of == {i: min(j for j, b in enumerate(grams) if b == a) for i, a in enumerate(grams) if a}
    similar = {(r.a, r.b) for r in pairs.collect()}
    assert all(of[a] == a and of[b] == b for a, b in similar)
    assert {(j, i) for i in of for j in of if j < i and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in similar)} == want
    got = {(r.a, r.b) for r in dedup.similar_pairs(frame(spark, *texts)).collect()}
    assert got == similar | {(rep, i) for i, rep in of.items() if i != rep}
    kept = []
    for i in range(len(texts)):
        if not any((j, i) in want for j in kept):
            kept.append(i)
    assert [r.doc_id for r in dedup.content_dedup(frame(spark, *texts)).orderBy("doc_id").collect()] == kept
    monkeypatch.setattr(dedup, "MATRIX_COLUMNS", 7)
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 5)
    monkeypatch.setattr(dedup, "BATCH_ROWS", 3)
    assert {(r.a, r.b) for r in dedup.similar_sets(frame(spark, *texts))[0].collect()} == similar
    assert [r.doc_id for r in dedup.content_dedup(frame(spark, *texts)).orderBy("doc_id").collect()] == kept
    named = frame(spark, *texts).selectExpr("format_string('%03d', doc_id) AS doc_id", "text")  # keys of another kind
    assert {(int(r.a), int(r.b)) for r in dedup.similar_sets(named)[0].collect()} == similar
    assert [int(r.doc_id) for r in dedup.content_dedup(named).orderBy("doc_id").collect()] == kept
    assert dedup.content_dedup(frame(spark, *texts).limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.7, 0.82, 0.85, 0.9])
def test_similar_sets_at_any_threshold(spark, threshold, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 9)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcde", k=rng.randint(4, 80))) for _ in range(14)]
    texts += ["".join(c if rng.random() > 0.05 else "z" for c in t) + "q" * (i % 3) for i, t in enumerate(texts)]
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    want = {}
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            s = 0.85 if len(a & b) / min(len(a), len(b)) > 0.8 else len(a & b) / len(a | b)
            if s > threshold and a != b:
                want[j, i] = pytest.approx(s)
    first = {i: min(j for j, b in enumerate(grams) if b == a) for i, a in enumerate(grams)}
    want = {k: v for k, v in want.items() if all(first[x] == x for x in k)}
    assert {(r.a, r.b): r.similarity for r in dedup.similar_sets(frame(spark, *texts), threshold)[0].collect()} == want


def test_sets_of_other_scripts_are_never_compared(spark, monkeypatch):
    """Bounds of blocks: most pairs of blocks of unlike sets are not built, and no pair is lost."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 12)
    rng = random.Random(9)
    scripts = ["abcdefgh", "αβγδεζηθ", "бвгджзик", "管理团队计划目标"]
    texts = ["".join(rng.choices(s, k=200)) for s in scripts for _ in range(30)]
    texts += [t[:150] for t in texts[::5]]
    pairs, _, done = dedup.compare_sets(frame(spark, *texts))
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    want = {(j, i) for i, a in enumerate(grams) for j, b in enumerate(grams[:i]) if len(a & b) / min(len(a), len(b)) > 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) >= 24
    assert done.sets == len(texts) and done.blocks > 8
    assert done.block_pairs < 0.8 * done.blocks**2 and done.counted < done.sets * (done.sets - 1) / 2 / 3


def test_grams_are_exact():
    for n in (1, 2, 3, 4):
        for t in (None, "", "a", "ab", "abcabc", "漢字😀漢字😀x", "\U0010ffff" * 9):
            want = {t[i : i + n] for i in range(len(t or "") - n + 1)} if t else set()
            assert len(dedup.grams_of(t, n)) == len(want)
    assert len(dedup.grams_of("abcdef", 3, head=4)) == 2


def test_vector_dedup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustered, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    s = v @ v.T - np.eye(50)
    order, kept = sorted(range(50), key=lambda i: (-round(s[i].max(), 9), i)), []
    for i in order:
        if not any(s[i, j] > 0.8 for j in kept):
            kept.append(i)
    assert {r.vec_id for r in vectors.dedup(df, 0.8).collect()} == set(kept)
    assert vectors.quality_filter(df.limit(10)).count() == 10


def test_query_understanding(spark):
    qs = ["什么是目标管理", "A和B的区别是什么", "泰勒与法约尔的异同", "如何激励员工", "天气"]
    q = spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")
    got = query.understand(q).orderBy("query_id").collect()
    assert [r.query_type for r in got] == [None, "definition", "comparison", "method", None]
    assert [r.is_comparison for r in got] == [False, True, True, False, False]
    assert got[2].entities == ["泰勒", "法约尔"] and got[1].mmr_lambda == 0.3
    made = query.variants(q).orderBy("query_id", "variant_no").collect()
    first = [r.text for r in made if r.query_id == 3]
    assert first[0] == "如何激励员工" and "如何动机员工" in first and len(set(first)) == len(first) <= 8  # 动机 is a synonym of 激励
    plain = query.variants(q, replace(ZH, synonyms={})).where("query_id = 3").collect()
    assert "如何激励员工 步骤 流程 方法" in {r.text for r in plain}


def test_mmr_order():
    v = np.eye(3)[[0, 0, 1, 2]]
    assert rank.mmr_order(np.array([0.9, 0.8, 0.5, 0.1]), v, 0.5, 3) == [0, 2, 3]
    assert rank.mmr_order(np.array([0.1, 0.9]), np.eye(2), 0.5, 2) == [0, 1]


def test_rrf_and_islands(spark):
    hits = spark.createDataFrame(
        [(1, "small", 0, 1, "a", 0.9), (1, "small", 1, 1, "b", 0.95), (1, "bm25", 0, 1, "b", 1.0), (1, "qa", 0, 1, "c", 0.3)],
        "query_id long, arm string, variant_no int, rank int, chunk_id string, score double",
    )
    got = {r.chunk_id: r for r in rank.rrf(rank.merge_variants(hits)).collect()}
    assert got["a"].rrf == pytest.approx(1.5 / 61) and got["b"].rrf == pytest.approx(1.5 / 62 + 1 / 61) and got["b"].match_type == "small+bm25"
    rows = spark.createDataFrame(
        [(1, "s", "a", 4, 1, "x", "pp"), (1, "t", "b", 1, 2, "y", "q"), (1, "s", "c", 2, 3, "z", "ppp"), (1, "s", "d", 9, 4, "w", "p")],
        "query_id long, source_doc string, chunk_id string, chunk_index int, ce_rank int, content string, parent_content string",
    )
    out = rank.merge_adjacent(rows).orderBy("final_place").collect()
    assert [(r.chunk_id, r.content, r.parent_content, r.chunk_indices) for r in out] == [("c", "z\nx", "ppp", [2, 4]), ("d", "w", "p", [9]), ("b", "y", "q", [1])]


def test_judge(spark):
    body = "目标管理是指，由上下级共同制定目标的方法。" * 4
    rows = spark.createDataFrame(
        [("q", "什么是目标管理", "definition", 1, "c1", body, "", ""), ("q", "什么是目标管理", "definition", 2, "c2", "天气很好" * 20, "", ""), ("q", "什么是目标管理", "definition", 3, "c3", "版权信息" * 20, "", "")],
        "query_id string, query string, query_type string, rank int, chunk_id string, content string, chapter string, source_doc string",
    )
    judged = judge.judge(rows, lambda c: T.han_tokens(c, ZH.stop_words, 2))
    assert [r.relevance_score for r in judged.orderBy("rank").collect()] == [5, 1, 1]
    asked = spark.createDataFrame([("q", "什么是目标管理", "definition", "easy"), ("z", "无", "framework", "hard")], "query_id string, query string, query_type string, difficulty string")
    got = {r.query_id: (r.context_relevance_score, r.is_sufficient) for r in judge.evaluate(judged, asked).collect()}
    assert got == {"q": (2, True), "z": (1, False)}


def test_files(spark, tmp_path):
    def docx(*paragraphs):
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        return out.getvalue()

    ship(spark)
    folder = tmp_path / "kb"
    folder.mkdir()
    (folder / "a.txt").write_bytes("管理学内容。".encode() * 120)
    (folder / "a.pdf").write_bytes(b"%PDF")
    (folder / "b.docx").write_bytes(docx(*["组织行为学的一段话。" * 60]))
    (folder / "c.pdf").write_bytes(b"broken")
    (folder / "d.doc").write_bytes(b"x")
    parsed = {r.filename: (r.text, r.error) for r in files.parse_files(files.list_files(spark, str(folder))).collect()}
    assert "甲 | 乙" in parsed["b.docx"][0] and parsed["c.pdf"][1] and set(parsed) == {"a.txt", "a.pdf", "b.docx", "c.pdf"}
    assert {r.doc_name for r in files.load_documents(spark, f"file://{folder}").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        files.check_path("../x")


def test_json_round_trips(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"evaluations": [{"query_id": "1", "is_sufficient": True, "chunk_evaluations": [{"rank": 1, "is_relevant": True}]}]}))
    assert files.envelope_evaluations(spark, str(tmp_path / "e.json")).first().chunks[0].is_relevant
    assert files.envelope_evaluations(spark, str(tmp_path / "none.json")).count() == 0
    pairs = spark.createDataFrame([("1", "q", "a", "t", "d")], "qa_id string, question string, answer string, qa_type string, source_doc string")
    files.save_qa_pairs(pairs, str(tmp_path / "qa"))
    assert files.load_qa_pairs(spark, str(tmp_path / "qa")).first().gold_source == "d"
    v = spark.createDataFrame([("c", "small", [1.0])], "chunk_id string, granularity string, embedding array<double>")
    files.save_vectors(v, str(tmp_path / "v"))
    assert files.load_vectors(spark, str(tmp_path / "v"), "small").count() == 1
    with pytest.raises(FileNotFoundError):
        files.load_vectors(spark, str(tmp_path / "w"))


def test_stream(spark, tmp_path):
    docs = frame(spark, " ".join(f"Word {i} is here, or {chr(97 + i % 26) * 3}." for i in range(40)), "short")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.clean(ingest.read(spark, str(tmp_path / "in"), docs.schema), LATIN, least=100)
    ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [0]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_duckdb(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](ship(spark), sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(tuple(map(plain, r)) for r in duck.execute(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall())
