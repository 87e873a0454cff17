"""Registered queries with the profile for Chinese, over texts that Spark derives from the tables: every word becomes a Chinese phrase by its md5."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .functions import text as T
from .functions.profiles import LATIN, ZH
from .operators import chunk, filters, judge, lexical, lines, query, refine, segment
from .plans.scratch import materialize
from .queries import SQL, _count, _query, _strip, _t, _terms
from .queries_more import content_sql, noise_sql, parts_sql, preprocessed_sql, re2, scored_sql, understood

#: Phrases with cues, headings, noise lines, sentence ends and traditional characters; none has a quote.
PHRASES = (
    "管理是指通过计划与组织达成目标的过程", "领导力", "竞争战略", "团队的绩效", "组织文化", "激励员工", "知识管理", "流程与标准化", "。", "。", "。", "，", "，", "；", "！", "？",
    "\n", "\n\n", "\n第三章 组织结构\n", "\n模块二 团队协作\n", "\n1.2 激励理论\n", "\n一、目标的设定\n", "因此，", "总之，", "这表明", "由此可见", "主要包括", "包括以下几个方面", "三大。", "分为：",
    "由，计划与控制组成", "所谓，", "本质是：", "\n比如， 一家公司", "\n例如， 某个部门", "\n案例：华为的灰度", "\n出版社=某某\n", "\nISBN 9787\n", "\n12\n", "\n甲\n", "\n高等教育出版社\n",
    "2019", "OKR", "SWOT分析", "德鲁克", "马斯洛的需求层次", "科学管理", "人际关系", "學習與創新", "領導風格", "可以提高效率", "员工", "顾客的价值", "市场细分", "质量", "应该授权",
)
QUESTIONS = (
    ("什么是领导力", "definition"), ("泰勒和法约尔有何异同", "comparison"), ("OKR的步骤和方法", "framework"), ("如何提高团队效能", "application"), ("马斯洛的需求层次是什么", "definition"),
    ("科学管理与人际关系的区别", "comparison"), ("华为的灰度管理如何实践", "application"), ("绩效下降的原因", "other"), ("SWOT、波特的差异是什么", "comparison"), ("赋能的原则", "framework"), ("知识管理", "definition"),
)
SINGLES = {"學": "学", "習": "习", "與": "与", "創": "创", "領": "领", "導": "导", "風": "风"}
WORDS = {"學習": "学习", "領導風格": "领导风格", "組織": "组织"}


def _array(xs) -> Column:
    return F.array(*map(F.lit, xs))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@F.arrow_udf(StringType())
def derived(c: pa.Array) -> pa.Array:
    """A text with a phrase for each of its words; phrases of the words of a batch are looked up once."""
    known: dict[str, str] = {}

    def phrase(w: str) -> str:
        if (p := known.get(w)) is None:
            p = known[w] = PHRASES[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % len(PHRASES)]
        return p

    return pa.array(["".join(map(phrase, _WORD.findall(t or ""))) for t in c.to_pylist()], pa.string())


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _derived_sql(x: str) -> str:
    words = rf"regexp_extract_all(coalesce({x}, ''), '[^\x20\x09-\x0D]+')"
    return f"array_to_string(list_transform({words}, lambda w: ({_list(PHRASES)})[1 + ('0x' || substr(md5(w), 1, 8))::BIGINT % {len(PHRASES)}]), '')"


_ZH = f"zh AS MATERIALIZED (SELECT doc_id, {_derived_sql('text')} AS text FROM documents)"


def _zh(spark, d):
    # one shuffle of the raw texts: however few row groups the table has, every core derives and reads some
    return _t(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", derived(F.col("text")).alias("text"))


@_query(f"WITH {_ZH} SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM zh")
def zh_texts(spark, d):
    return _zh(spark, d).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


_TABLE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (SINGLES | WORDS).items()) + "}"
_KEYS = "|".join(sorted(SINGLES | WORDS, key=len, reverse=True)) + f"|[^{''.join({w[0]: 0 for w in SINGLES | WORDS})}]+|."
_SIMPLE = f"array_to_string(list_transform(regexp_extract_all(text, '(?s){_KEYS}'), lambda w: coalesce(({_TABLE})[w], w)), '')"


@_query(f"WITH {_ZH} SELECT doc_id, md5({_SIMPLE}) AS digest FROM zh")
def zh_simplified(spark, d):
    return _zh(spark, d).select("doc_id", F.md5(T.to_simplified(F.col("text"), SINGLES, WORDS)).alias("digest"))


@_query(f"WITH {_ZH}, {preprocessed_sql('zh', ZH)} SELECT doc_id, text AS clean_text FROM pre")
def zh_preprocess(spark, d):
    return lines.preprocess(_zh(spark, d), ZH)


_ZH_LINES = f"zl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM zh), zs AS (SELECT doc_id, {_strip('raw')} AS line FROM zl)"


@_query(f"WITH {_ZH}, {_ZH_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line <> '' AND {noise_sql(ZH)}) AS n_noise FROM zs GROUP BY doc_id")
def zh_noise_lines(spark, d):
    return lines.noise_lines(_zh(spark, d), ZH)


@_query(content_sql("zh", ZH, 800, ("chr(10)", "'。'", "'；'", "'！'", "'？'"), f"{_ZH}, "))
def zh_extract_content(spark, d):
    return lines.extract_content(_zh(spark, d), 800, ZH)


@_query(scored_sql("zh", ZH, f"{_ZH}, "))
def zh_score_paragraphs(spark, d):
    return refine.score_paragraphs(_zh(spark, d), ZH)


@_query(parts_sql("zh", ZH, f"{_ZH}, "))
def zh_chapters(spark, d):
    return refine.split_chapters(_zh(spark, d), ZH).withColumn("part_no", F.col("part_no").cast("long"))


_PIECES = "pi AS (SELECT doc_id, (pos // 500)::INT AS window_no, substr(text, pos + 1, 500) AS c FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 500)) AS pos FROM zh WHERE length(text) > 0))"
_LOW = rf"""(c = '' OR (length(s) > 0 AND {_count('c', ZH.script)} / greatest(length(s), 1) < 0.2) OR {_count('c', '[0-9]')} / greatest(length(s), 1) > 0.6
    OR (length(s) > 20 AND len(list_distinct(string_split(c, ''))) / greatest(length(s), 1) < {ZH.distinct_share}))"""


@_query(f"WITH {_ZH}, {_PIECES} SELECT doc_id, window_no, {_LOW} AS low FROM (SELECT *, {_strip('c')} AS s FROM pi)")
def zh_low_quality(spark, d):
    return chunk.fixed_windows(_zh(spark, d), 500, 500).select("doc_id", "window_no", filters.is_low_quality(F.col("content"), ZH).alias("low"))


_THEORY = " OR ".join(f"regexp_matches(c, '{re2(p)}')" for p in (ZH.filter_definition, ZH.filter_framework, ZH.filter_conclusion))
_PAGE = "(contains(c, '版权所有') AND (contains(c, '目录') OR contains(c, '版权信息')) AND length(c) < 2000)"


@_query(
    rf"""WITH {_ZH}, {_PIECES}, p AS (SELECT *, {_strip('c')} AS s, list_filter(list_transform(string_split(c, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM pi),
    q AS (SELECT *, ({_THEORY}) AS theory, greatest(len(ls), 1) AS n, len(list_filter(ls, lambda line: {noise_sql(ZH)})) AS noisy, len(list_filter(ls, lambda x: length(x) < 22)) AS short FROM p),
    r AS (SELECT *, regexp_matches(s, '{re2(ZH.case)}') AND NOT theory AS pure FROM q WHERE NOT (length(s) < 30 OR noisy / n > 0.35 OR {_PAGE} OR (short >= 8 AND short / n > 0.55)))
    SELECT doc_id, window_no, CASE WHEN pure THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS quality_weight FROM r
    WHERE pure OR ((theory OR {_terms('c', ZH.filter_terms)} / greatest(length(c) / 100.0, 1.0) >= 0.005)
      AND ({_count('c', ZH.sentence)} >= 2 OR {_count('c', ZH.script)} / greatest(length(c), 1) >= 0.3))"""
)
def zh_chunk_quality(spark, d):
    return filters.filter_chunks(chunk.fixed_windows(_zh(spark, d), 500, 500), ZH).select("doc_id", "window_no", "quality_weight")


def _tokens_sql(x: str, least: int = 1) -> str:
    """Adjacent pairs of Han characters, and lower-case runs of other letters and digits."""
    runs = rf"regexp_extract_all(lower({x}), '\p{{Han}}+|[\p{{Latin}}\p{{N}}]+')"
    pairs = r"CASE WHEN regexp_matches(r, '^\p{Han}{2,}$') THEN list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, i, 2)) ELSE [r] END"
    return f"list_filter(flatten(list_transform({runs}, lambda r: {pairs})), lambda w: length(w) >= {least} AND NOT list_contains({_list(ZH.stop_words)}, w))"


_KNOWN = sorted({w.lower() for w in ZH.dictionary if len(w) > 1 and all("一" <= x <= "鿿" for x in w)})
#: Words of the corpus, then the least cost of each run's suffixes from the end, then the words of its path.
_WORDS_SQL = rf"""zr AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{Han}}+')) AS r FROM zh),
    rc AS MATERIALIZED (SELECT r, count(*) AS c FROM zr GROUP BY r),
    gc AS MATERIALIZED (SELECT substr(r, i, m) AS gram, sum(c)::BIGINT AS n FROM (SELECT r, c, unnest(generate_series(1, length(r))) AS i FROM rc), generate_series(1, {segment.LONGEST}) AS s(m)
        WHERE i + m - 1 <= length(r) GROUP BY 1),
    nn AS (SELECT sum(n) AS total FROM gc WHERE length(gram) = 1),
    ct AS (SELECT gram, n, unnest(generate_series(1, length(gram) - 1)) AS k FROM gc WHERE length(gram) > 1 AND n >= {segment.LEAST}),
    ok AS (SELECT ct.gram, ct.n FROM ct JOIN gc a ON a.gram = substr(ct.gram, 1, k) JOIN gc b ON b.gram = substr(ct.gram, k + 1), nn
        GROUP BY ct.gram, ct.n HAVING min(ct.n::DOUBLE * total / (a.n::DOUBLE * b.n::DOUBLE)) >= {segment.COHESION} ORDER BY ct.n DESC, ct.gram LIMIT {segment.MOST_WORDS}),
    kn AS (SELECT unnest({_list(_KNOWN)}) AS gram),
    wc AS (SELECT * FROM ok WHERE gram NOT IN (SELECT gram FROM kn) UNION ALL SELECT gram, n FROM gc WHERE length(gram) = 1 UNION ALL SELECT gram, coalesce(n, 1) FROM kn LEFT JOIN gc USING (gram)),
    wd AS MATERIALIZED (SELECT gram AS word, round(1000 * (ln(total::DOUBLE) - ln(n::DOUBLE)))::BIGINT AS cost FROM wc, nn)"""
_PATHS_SQL = """op AS (
        SELECT r, length(r) AS i, [0::BIGINT] AS best, []::INT[] AS steps FROM rc
        UNION ALL
        SELECT r, i - 1, list_prepend(least(v1, v2, v3, v4), best)[1:4], list_prepend(CASE least(v1, v2, v3, v4) WHEN v4 THEN 4 WHEN v3 THEN 3 WHEN v2 THEN 2 ELSE 1 END, steps)
        FROM (SELECT r, i, best, steps, w1.cost + best[1] AS v1, w2.cost + best[2] AS v2, w3.cost + best[3] AS v3, w4.cost + best[4] AS v4
              FROM op LEFT JOIN wd w1 ON w1.word = substr(r, i, 1) LEFT JOIN wd w2 ON w2.word = substr(r, i, 2) AND i + 1 <= length(r)
              LEFT JOIN wd w3 ON w3.word = substr(r, i, 3) AND i + 2 <= length(r) LEFT JOIN wd w4 ON w4.word = substr(r, i, 4) AND i + 3 <= length(r) WHERE i > 0)),
    fi AS MATERIALIZED (SELECT r, steps FROM op WHERE i = 0),
    tk AS (SELECT r, steps, 1 + steps[1] AS i, substr(r, 1, steps[1]) AS term FROM fi UNION ALL SELECT r, steps, i + steps[i], substr(r, i, steps[i]) FROM tk WHERE i <= length(r))"""


@_query(f"WITH {_ZH}, {_WORDS_SQL} SELECT word, cost FROM wd")
def zh_words(spark, d):
    """The dictionary learned from the texts."""
    return segment.learn(_zh(spark, d), known=ZH.dictionary).where("word <> ''")


@_query(
    rf"""WITH RECURSIVE {_ZH}, {_WORDS_SQL}, {_PATHS_SQL},
    al AS (SELECT doc_id, term FROM zr JOIN tk USING (r) UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{Latin}}\p{{N}}]+')) FROM zh)
    SELECT doc_id, term, count(*) AS tf FROM al WHERE NOT list_contains({_list(ZH.stop_words)}, term) GROUP BY ALL"""
)
def zh_tokens(spark, d):
    rows = materialize(_zh(spark, d), "zh")
    words = segment.learn(rows, known=ZH.dictionary)
    return lexical.term_counts(rows, lexical.tokenizer(ZH, words=words)(F.col("text")), "doc_id")


_ASK = f"({_list([q for q, _ in QUESTIONS])})[1 + conv_id % {len(QUESTIONS)}]"
_CONV = f"cq AS (SELECT conv_id, turn, {_ASK} || coalesce('，' || left({_derived_sql('text')}, 9), '') AS asked FROM conversations)"
_KIND, _ENTITIES = understood(ZH, "asked")


def _asked(spark, d):
    """A question for each turn of a conversation, with the start of its derived text."""
    rows = _t(spark, d, "conversations")
    ask = _array([q for q, _ in QUESTIONS])[(F.col("conv_id") % len(QUESTIONS)).cast("int")]
    return rows.select("conv_id", "turn", F.concat(ask, F.lit("，"), F.left(derived(F.col("text")), F.lit(9))).alias("query"))


@_query(
    f"""WITH {_CONV} SELECT conv_id, turn, {_KIND} AS query_type, {' OR '.join(f"contains(asked, '{w}')" for w in ZH.question_types['comparison'])} AS is_comparison, {_ENTITIES} AS entities FROM cq"""
)
def zh_understand(spark, d):
    return query.understand(_asked(spark, d), ZH).select("conv_id", "turn", "query_type", "is_comparison", "entities")


def variants_sql(profile, conv: str, tokens: str, kind: str, entities: str) -> str:
    """The variants of questions cq (conv_id, turn, asked), which conv makes."""
    words = list(profile.synonyms.items())
    expansions = f"list_filter([{', '.join(f'{{s: {chr(39)}{s}{chr(39)}, w: {chr(39)}{w}{chr(39)}}}' for w, ss in words for s in ss[:3])}], lambda p: contains(asked, p.w) AND NOT contains(asked, p.s))"
    suffix = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in profile.type_suffix.items())
    pairs = "MAP {" + ", ".join(f"'{w}': {_list(ss[:2])}" for w, ss in words) + "}"
    return f"""WITH {conv}, va AS (SELECT conv_id, turn, asked, {tokens} AS k, {expansions} AS e0, {kind} AS kind, {entities} AS en,
      {' OR '.join(f"contains(asked, '{w}')" for w in profile.question_types['comparison'])} AS compares FROM cq),
    vb AS (SELECT *, list_filter(e0, lambda p, i: list_position(list_transform(e0, lambda h: h.s), p.s) = i) AS e FROM va),
    vc AS (SELECT *, list_distinct_in_order AS every FROM (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS list_distinct_in_order FROM (SELECT *,
      [asked] || CASE WHEN len(k) >= 2 THEN [array_to_string(k, ' ')] ELSE [] END
      || CASE WHEN len(e) > 0 THEN [asked || ' ' || array_to_string(list_transform(e, lambda x: x.s)[1:4], ' ')] ELSE [] END
      || list_transform(e[1:3], lambda x: replace(asked, x.w, x.s))
      || CASE WHEN len(k) >= 3 THEN [array_to_string(k[1:len(k) // 2 + 1], ' ')] ELSE [] END
      || flatten(list_transform(k[1:3], lambda w: list_transform(list_filter(coalesce(({pairs})[w], []), lambda s: NOT contains(asked, s)), lambda s: w || ' ' || s)))
      || CASE WHEN NOT ({' OR '.join(f"contains(asked, '{w}')" for w in profile.domain_words)}) THEN [asked || ' {profile.domain_suffix}'] ELSE [] END
      || CASE WHEN CASE kind {suffix} END IS NOT NULL THEN [asked || ' ' || CASE kind {suffix} END] ELSE [] END AS raw FROM vb))),
    vd AS (SELECT *, every[1:6] || CASE WHEN compares THEN en ELSE [] END AS withen FROM vc),
    ve AS (SELECT *, list_filter(withen, lambda x, i: list_position(withen, x) = i)[1:8] AS out FROM vd)
    SELECT conv_id, turn, unnest(out) AS text, (generate_subscripts(out, 1) - 1)::INT AS variant_no FROM ve"""


@_query(variants_sql(ZH, _CONV, _tokens_sql("asked", 2), _KIND, _ENTITIES))
def zh_variants(spark, d):
    return query.variants(_asked(spark, d), ZH, ("conv_id", "turn"))


_LATIN_TOKENS = rf"list_filter(regexp_extract_all(lower(asked), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2 AND NOT list_contains({_list(LATIN.stop_words)}, w))"
SQL["qry_variants"] = variants_sql(LATIN, "cq AS (SELECT conv_id, turn, text AS asked FROM conversations WHERE text IS NOT NULL)", _LATIN_TOKENS, *understood(LATIN, "asked"))


# -- judging: the turns of a conversation are the passages of its question -----------------------------------------

_R = judge.ZH_RULES
_any = lambda ws, x="tx": "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"
_TRIGGERS = " || ".join(f"CASE WHEN regexp_matches(query, '(?i){p}') THEN {_list(ws)} ELSE [] END" for p, ws in _R.triggers)
_graded = lambda high, low, ws: f"CASE WHEN ratio >= {high} AND {_any(ws)} THEN 5 WHEN ratio >= {high} THEN 4 WHEN ratio >= {low} THEN 3 ELSE 1 END"
_SIDE = f"regexp_replace(p, '{_R.side_noise}', '', 'g')"
_JUDGED = f"""ju AS (SELECT conv_id::VARCHAR AS query_id, turn AS rank, conv_id::VARCHAR || '-' || turn::VARCHAR AS chunk_id, {_ASK} AS query, ({_list([k for _, k in QUESTIONS])})[1 + conv_id % {len(QUESTIONS)}] AS kind,
      role, {_derived_sql('text')} AS c FROM conversations),
    jw AS (SELECT *, list_distinct({_tokens_sql("regexp_replace(query, '[？?。，,！!、；;：:[:space:]]+', ' ', 'g')", 2)} || {_TRIGGERS}) AS ws, c || '  ' || role AS tx FROM ju),
    jr AS (SELECT *, len(list_filter(ws, lambda w: contains(lower(tx), lower(w)) OR contains(tx, w))) / greatest(len(ws), 1) AS ratio,
      list_filter(list_transform(string_split(c, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls,
      list_transform(list_filter(list_transform(string_split_regex(query, '{_R.split}'), lambda p: {_strip('p')}), lambda p: length(p) >= 2)[1:2], lambda p: {_strip(_SIDE)}) AS sides,
      {_strip(f"regexp_replace(query, '{_R.question_lead}', '')")} AS core FROM jw),
    jp AS (SELECT *, contains(tx, core) OR ratio > 0 AS near, len(sides) >= 2 AS two, len(list_filter(sides, lambda p: p <> '' AND (contains(tx, p) OR contains(tx, left(p, 3))))) AS present,
      (length({_strip('c')}) < {_R.least} OR regexp_matches(c, '{_R.noise}') OR (len(regexp_extract_all(c, '章')) > 5 AND length(c) < 800 AND NOT contains(left(c, 200), '原则') AND len(ls) > 8
        AND len(list_filter(ls, lambda x: length(x) < 20)) / greatest(len(ls), 1) > 0.6)) AS noise FROM jr),
    js AS (SELECT *, CASE WHEN noise THEN 1 ELSE CASE kind
      WHEN 'definition' THEN CASE WHEN near AND {_any(_R.definition)} THEN 5 WHEN near AND ratio >= 0.4 THEN 4 WHEN near AND ratio >= 0.2 THEN 3 WHEN ratio >= 0.3 THEN 3 ELSE 1 END
      WHEN 'framework' THEN {_graded(0.4, 0.2, _R.framework)} WHEN 'application' THEN {_graded(0.35, 0.15, _R.application)}
      WHEN 'comparison' THEN CASE WHEN two AND present >= 2 AND {_any(_R.comparison)} THEN 5 WHEN two AND present >= 2 THEN 4 WHEN two AND present = 1 THEN 3 WHEN ratio >= 0.3 THEN 3 ELSE 1 END
      ELSE CASE WHEN ratio >= 0.3 THEN 3 ELSE 1 END END END::INT AS score FROM jp)"""


def _judged(spark, d):
    at = (F.col("conv_id") % len(QUESTIONS)).cast("int")
    rows = _t(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), _array([q for q, _ in QUESTIONS])[at].alias("query"),
        _array([k for _, k in QUESTIONS])[at].alias("query_type"), F.col("role").alias("source_doc"), F.lit(None).cast("string").alias("chapter"), derived(F.col("text")).alias("content"),
    )
    return judge.judge(rows, lexical.tokenizer(ZH, 2), _R)


@_query(f"WITH {_JUDGED} SELECT query_id, chunk_id, score AS relevance_score, score >= 3 AS is_relevant FROM js")
def zh_judge(spark, d):
    return _judged(spark, d).select("query_id", "chunk_id", "relevance_score", "is_relevant")


@_query(
    f"""WITH {_JUDGED}, ev AS (SELECT query_id, any_value(kind) AS kind, list(score ORDER BY rank, chunk_id) AS ss FROM js GROUP BY query_id),
    ex AS (SELECT *, len(list_filter(ss, lambda s: s >= 4)) AS high, len(list_filter(ss, lambda s: s >= 3)) AS relevant, list_sum(ss[1:5]) / len(ss[1:5]) AS mean FROM ev),
    es AS (SELECT *, CASE WHEN high > 0 THEN least(5, round_even(mean, 0)::INT) WHEN relevant > 0 THEN 3 ELSE 1 END AS score FROM ex)
    SELECT query_id, kind AS query_type, score::INT AS context_relevance_score, CASE kind WHEN 'comparison' THEN high >= 1 AND relevant >= 2 WHEN 'definition' THEN len(list_filter(ss[1:5], lambda s: s >= 4)) > 0
      ELSE high >= 1 OR (relevant >= 2 AND score >= 3) END AS is_sufficient FROM es"""
)
def zh_evaluate(spark, d):
    judged = materialize(_judged(spark, d), "judged")
    queries = judged.select("query_id", "query", "query_type").distinct().withColumn("difficulty", F.lit("easy"))
    return judge.evaluate(judged, queries).select("query_id", "query_type", "context_relevance_score", "is_sufficient")
