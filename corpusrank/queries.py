"""Registered queries of the operators, over the whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.profiles import LATIN as P
from .functions.profiles import MIRROR_SITES
from .operators import chunk, clustered, dedup, filters, formatting, lexical, lines, metrics, qa, query, rank, refine, vectors
from .plans import engine
from .plans.scratch import materialize, scratch_path

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text", "lang", "source")


_WS = r"[\s\x0b\x{85}\x{a0}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_clean = lambda x: _strip(rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '[\r\t]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')")
_split = "string_split(coalesce(text, ''), chr(10))"
_LINES = f"l AS (SELECT doc_id, unnest({_split}) AS raw, generate_subscripts({_split}, 1) - 1 AS line_no FROM documents), s AS (SELECT *, {_strip('raw')} AS line FROM l)"
_NOISE = f"regexp_matches(line, '{P.noise}')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _terms(x: str, terms) -> str:
    return "(" + " + ".join(f"contains({x}, '{t}')::INT" for t in terms) + ")"


# -- text ----------------------------------------------------------------------------------------------------


@_query(f"SELECT doc_id, {_clean('text')} AS clean_text FROM documents")
def txt_clean(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("clean_text"))


@_query(
    f"""SELECT doc_id, {_strip("regexp_replace(regexp_replace(text, '[，。！？；：、（）《》“”‘’【】…—·,.!?;:()\"''\\[\\]<>{{}}\\-]', '', 'g'), '" + _WS + "+', ' ', 'g')")} AS normal FROM documents"""
)
def txt_normalize(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@_query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line <> '' AND {_NOISE}) AS n_noise FROM s GROUP BY doc_id")
def txt_noise_lines(spark, d):
    return lines.noise_lines(_docs(spark, d), P)


@_query(
    rf"""WITH {_LINES},
    a AS (SELECT *, lag(line, 1, '') OVER w AS b, lead(line, 1, '') OVER w AS n FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    k AS (SELECT * FROM a WHERE line = '' OR NOT ({_NOISE} OR length(line) = 1 OR (length(line) = 2 AND NOT regexp_matches(line, '{P.short_line}'))
          OR (regexp_matches(line, '^\d{{1,4}}$') AND b = '' AND n = ''))),
    p AS (SELECT *, last_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k),
    q AS (SELECT * FROM p WHERE line = '' OR line IS DISTINCT FROM prev),
    r AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM q),
    j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM r WHERE NOT (line = '' AND coalesce(before = '', false)) GROUP BY doc_id)
    SELECT d.doc_id, {_strip("regexp_replace(coalesce(t, ''), ' {2,}', ' ', 'g')")} AS clean_text FROM documents d LEFT JOIN j USING (doc_id)"""
)
def txt_preprocess(spark, d):
    return lines.preprocess(_docs(spark, d), P)


_CHAPTERS = rf"""c0 AS (SELECT doc_id, line_no, {_strip('raw')} AS line,
      coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
      sum(length(raw) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM l),
    c1 AS (SELECT * FROM c0 WHERE length(line) < 80 AND regexp_matches(line, '{P.chapter_in_text}')),
    ch AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS chapter_no, start::BIGINT AS start, coalesce(lead(start) OVER w, total)::BIGINT AS "end", left(line, 60) AS title
           FROM c1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


@_query(f"WITH {_LINES}, {_CHAPTERS} SELECT * FROM ch")
def txt_chapters(spark, d):
    return lines.chapters(_docs(spark, d), P)


@_query(
    rf"""WITH {_LINES}, h AS (SELECT *, length(line) < 80 AND regexp_matches(line, '{P.chapter_in_text}') AS head, {_NOISE} AS noise FROM s),
    g AS (SELECT *, (length(line) > 50 AND NOT noise) OR (length(line) > 30 AND NOT head AND NOT noise) AS solid FROM h),
    n AS (SELECT *, bool_or(solid) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS near FROM g)
    SELECT doc_id, coalesce(min(line_no) FILTER (head AND near), min(line_no) FILTER (length(line) > 20 AND NOT noise), 0) AS line_no FROM n GROUP BY doc_id"""
)
def txt_first_chapter(spark, d):
    return lines.first_chapter(_docs(spark, d), P)


_MARKS = ("\n", ".", "!", "?")


@_query(
    "WITH h AS (SELECT doc_id, text, left(text, 1500) AS head FROM documents), b AS (SELECT *, greatest("
    + ", ".join(f"CASE WHEN strpos(reverse(head), {m}) > 0 THEN length(head) - strpos(reverse(head), {m}) ELSE -1 END" for m in ("chr(10)", "'.'", "'!'", "'?'"))
    + ") AS last FROM h) SELECT doc_id, CASE WHEN length(text) <= 1500 THEN text WHEN last > 900 THEN left(text, last + 1) ELSE head END AS cut FROM b"
)
def txt_truncate(spark, d):
    return _docs(spark, d).select("doc_id", T.truncate_at_boundary(F.coalesce("text", F.lit("")), 1500, _MARKS).alias("cut"))


_NAME = r"regexp_replace(url, '([^./])\.[^./]*$', '\1')"
for _p in MIRROR_SITES:
    _NAME = f"regexp_replace({_NAME}, '{_p}', '', 'gi')"
_NAME = f"regexp_replace({_strip(_NAME)}, '[-_]{{2,}}', '-', 'g')"
_NAME_SQL = f"n0 AS (SELECT page_id, url, {_NAME} AS c FROM pages)"
for _i, _m in enumerate("（(【["):
    _NAME_SQL += f", n{_i + 1} AS (SELECT page_id, url, CASE WHEN instr(c, '{_m}') > 3 THEN left(c, instr(c, '{_m}') - 1) ELSE c END AS c FROM n{_i})"


@_query(f"WITH {_NAME_SQL} SELECT page_id, coalesce(nullif(regexp_replace(c, '^[-_ ]+|[-_ ]+$', '', 'g'), ''), url) AS name FROM n4")
def txt_doc_name(spark, d):
    return _t(spark, d, "pages").select("page_id", lines.clean_doc_name(F.col("url")).alias("name"))


_EXT = "(['.md', '.txt', '.docx', '.pdf', '.doc'])[1 + p_size % 5]"


@_query(
    f"""WITH f AS (SELECT p_partkey, regexp_replace(p_type, ' ', '-', 'g') || '-' || p_brand || {_EXT} AS filename, regexp_replace(p_type, ' ', '-', 'g') || '-' || p_brand AS doc_name,
             list_position(['.md', '.txt', '.docx', '.pdf'], {_EXT}) AS p FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY p, filename, p_partkey) AS r FROM f WHERE p IS NOT NULL AND p > 0)
    SELECT doc_name, filename FROM r WHERE r = 1"""
)
def src_pick_variants(spark, d):
    kinds = F.array(*map(F.lit, (".md", ".txt", ".docx", ".pdf", ".doc")))
    name = F.concat_ws("-", F.regexp_replace("p_type", " ", "-"), "p_brand")
    files = _t(spark, d, "part").select(F.concat(name, kinds[F.col("p_size") % 5]).alias("filename"))
    stem = F.regexp_replace("filename", r"\.[a-z]+$", "")
    return lines.pick_variants(files, name=stem).select("doc_name", "filename")


# -- refinement ----------------------------------------------------------------------------------------------


@_query()
def ref_budget_extract(spark, d):
    return refine.refine(_docs(spark, d), P, 3000)


# -- chunking ------------------------------------------------------------------------------------------------


def _windows(size: int, step: int, text: str = "text") -> str:
    return f"(SELECT doc_id, unnest(generate_series(0, length({text}) - 1, {step})) AS pos, {text} AS t FROM documents WHERE length({text}) > 0)"


@_query(f"SELECT doc_id, (pos // 500)::INT AS window_no, substr(t, pos + 1, 600) AS content FROM {_windows(600, 500)}")
def chk_windows(spark, d):
    return chunk.fixed_windows(_docs(spark, d), 600, 500)


@_query(
    f"WITH c AS (SELECT doc_id, {_clean('text')} AS t FROM documents) SELECT doc_id, (pos // 1900)::INT AS parent_idx, substr(t, pos + 1, 2000) AS parent_content "
    "FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 1900)) AS pos FROM c WHERE length(t) > 0)"
)
def chk_parents(spark, d):
    clean = _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))
    return chunk.parents(clean, 100)


@_query(f"SELECT doc_id, md5({_clean('text')}) AS whole, length({_clean('text')})::BIGINT AS n_chars FROM documents WHERE length({_clean('text')}) > 0")
def chk_lossless(spark, d):
    """Chunks put together again by position: the cleaned text of every document."""
    rows = chunk.chunks(_docs(spark, d), 600, P)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), "")
    return rows.groupBy("doc_id").agg(F.md5(joined).alias("whole"), F.sum(F.length("content")).cast("long").alias("n_chars"))


def _packed(pieces: str, size: int) -> str:
    """The pieces of a list put together while a pack has at most `size` characters, as a list."""
    last = "CASE WHEN strpos(a, chr(1)) = 0 THEN length(a) ELSE strpos(reverse(a), chr(1)) - 1 END"
    return f"string_split(list_reduce({pieces}, lambda a, p: CASE WHEN {last} + length(p) <= {size} THEN a || p ELSE a || chr(1) || p END), chr(1))"


def _chunks_sql(size: int, name: str, profile=P) -> str:
    """Relations {name}f (fragments, cut again while they are longer than size) and {name} (doc_id, chunk_index, position, content), from cl (doc_id, text)."""
    marks = [m.replace("\n", "' || chr(10) || '") for m in profile.separators if m]
    marks = [f"('{m}')" for m in marks]
    none = len(marks) + 1
    coarsest = " ".join(f"WHEN level <= {i} AND contains(t, {m}) THEN {i}" for i, m in enumerate(marks, 1))
    cut = " ".join(f"WHEN {i} THEN list_transform(string_split(t, {m}), lambda x, i: CASE WHEN i < len(string_split(t, {m})) THEN x || {m} ELSE x END)" for i, m in enumerate(marks, 1))
    windows = f"list_transform(generate_series(0, length(t) - 1, {size}), lambda i: substr(t, i + 1, {size}))"
    packs = _packed("list_filter(pieces, lambda x: x <> '')", size)
    return f"""{name}f AS (
        SELECT doc_id, []::BIGINT[] AS path, text AS t, 1 AS level, true AS open FROM cl WHERE text <> ''
        UNION ALL
        SELECT doc_id, list_append(path, k), pack, mark + 1, length(pack) > {size}
        FROM (SELECT doc_id, path, mark, unnest(packs) AS pack, generate_subscripts(packs, 1) AS k
              FROM (SELECT doc_id, path, mark, {packs} AS packs
                    FROM (SELECT doc_id, path, mark, CASE mark {cut} ELSE {windows} END AS pieces
                          FROM (SELECT *, CASE {coarsest} ELSE {none} END AS mark FROM {name}f WHERE open))))),
    {name} AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS chunk_index, (sum(length(t)) OVER w - length(t))::BIGINT AS position, t AS content
        FROM {name}f WHERE NOT open WINDOW w AS (PARTITION BY doc_id ORDER BY path))"""


_CLEANED = f"cl AS MATERIALIZED (SELECT doc_id, source, {_clean('text')} AS text FROM documents)"


@_query(f"WITH RECURSIVE {_CLEANED}, {_chunks_sql(600, 'ck')} SELECT * FROM ck")
def chk_recursive(spark, d):
    return chunk.chunks(_docs(spark, d), 600, P)


def _with_parents_sql(granularity: str, name: str) -> str:
    size, overlap = chunk.SIZES[granularity]
    step = chunk.PARENT - overlap
    low = rf"""(s = '' OR {_count('s', P.script)} / greatest(length(s), 1) < 0.2 OR {_count('s', '[0-9]')} / greatest(length(s), 1) > 0.6
        OR (length(s) > 20 AND len(list_distinct(string_split(s, ''))) / greatest(length(s), 1) < {P.distinct_share}))"""
    return f"""SELECT concat_ws('_', source, k.doc_id, '{granularity}', 'chunk', chunk_index) AS chunk_id, k.doc_id, '{granularity}' AS granularity, chunk_index, position, coalesce(title, '') AS chapter,
            md5(substr(text, 1 + {step} * least((position + greatest(length(content) // 2, 1)) // {step}, (greatest(length(text), 1) - 1) // {step}), {chunk.PARENT})) AS parent
        FROM (SELECT *, {_strip('content')} AS s FROM {name}) k JOIN cl USING (doc_id) ASOF LEFT JOIN ch ON k.doc_id = ch.doc_id AND k.position >= ch.start
        WHERE length(s) >= {chunk.LEAST_CHUNK} AND NOT {low}"""


@_query(
    f"""WITH RECURSIVE {_CLEANED}, {_LINES.replace('documents', 'cl')}, {_CHAPTERS}, {_chunks_sql(chunk.SIZES['small'][0], 'cs')}, {_chunks_sql(chunk.SIZES['large'][0], 'cg')}
    {_with_parents_sql('small', 'cs')} UNION ALL {_with_parents_sql('large', 'cg')}"""
)
def chk_with_parents(spark, d):
    return chunk.both_granularities(_docs(spark, d), P).select("chunk_id", "doc_id", "granularity", "chunk_index", "position", "chapter", F.md5("parent_content").alias("parent"))


@_query(
    f"""WITH {_LINES}, {_CHAPTERS}, w AS (SELECT doc_id, pos AS position FROM {_windows(500, 500)})
    SELECT w.doc_id, w.position::BIGINT AS position, coalesce(ch.title, '') AS chapter FROM w ASOF LEFT JOIN ch ON w.doc_id = ch.doc_id AND w.position >= ch.start"""
)
def chk_asof_chapter(spark, d):
    docs = _docs(spark, d)
    rows = chunk.fixed_windows(docs, 500, 500).select("doc_id", (F.col("window_no") * 500).cast("long").alias("position"))
    return chunk.with_chapter(rows, lines.chapters(docs, P)).select("doc_id", "position", "chapter")


# -- filters and selection -----------------------------------------------------------------------------------

_LOW = rf"""(c = '' OR (length(s) > 0 AND {_count('c', P.script)} / greatest(length(s), 1) < 0.2) OR {_count('c', '[0-9]')} / greatest(length(s), 1) > 0.6
    OR (length(s) > 20 AND len(list_distinct(string_split(c, ''))) / greatest(length(s), 1) < {P.distinct_share}))"""
_PIECES = f"(SELECT doc_id, (pos // 500)::INT AS window_no, substr(t, pos + 1, 500) AS c FROM {_windows(500, 500)})"


@_query(f"SELECT doc_id, window_no, {_LOW} AS low FROM (SELECT *, {_strip('c')} AS s FROM {_PIECES})")
def flt_low_quality(spark, d):
    return chunk.fixed_windows(_docs(spark, d), 500, 500).select("doc_id", "window_no", filters.is_low_quality(F.col("content"), P).alias("low"))


_THEORY = f"(regexp_matches(c, '{P.filter_definition}') OR regexp_matches(c, '{P.filter_framework}') OR regexp_matches(c, '{P.filter_conclusion}'))"


@_query(
    rf"""WITH p AS (SELECT *, {_strip('c')} AS s, list_filter(list_transform(string_split(c, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls FROM {_PIECES}),
    q AS (SELECT *, {_THEORY} AS theory, greatest(len(ls), 1) AS n, len(list_filter(ls, lambda x: regexp_matches(x, '{P.noise}'))) AS noisy, len(list_filter(ls, lambda x: length(x) < 22)) AS short FROM p),
    r AS (SELECT *, regexp_matches(s, '{P.case}') AND NOT theory AS pure FROM q WHERE NOT (length(s) < 30 OR noisy / n > 0.35 OR (short >= 8 AND short / n > 0.55)))
    SELECT doc_id, window_no, CASE WHEN pure THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS quality_weight FROM r
    WHERE pure OR ((theory OR {_terms('c', P.filter_terms)} / greatest(length(c) / 100.0, 1.0) >= 0.005)
      AND ({_count('c', P.sentence)} >= 2 OR {_count('c', P.script)} / greatest(length(c), 1) >= 0.3))"""
)
def flt_chunk_quality(spark, d):
    rows = chunk.fixed_windows(_docs(spark, d), 500, 500)
    return filters.filter_chunks(rows, P).select("doc_id", "window_no", "quality_weight")


@_query(
    """WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM documents),
    b AS (SELECT *, greatest(1, (300 * n / total)::DOUBLE)::DOUBLE AS bd, min(pos) OVER (PARTITION BY source, lang) AS f FROM a),
    c AS (SELECT *, floor(greatest(1, 300 * n / total)) AS b, dense_rank() OVER (PARTITION BY source ORDER BY f) - 1 AS gi, count(*) OVER (PARTITION BY source, lang) AS m,
             row_number() OVER (PARTITION BY source, lang ORDER BY pos) - 1 AS r FROM b),
    e AS (SELECT *, max(gi) OVER (PARTITION BY source) + 1 AS g FROM c),
    s AS (SELECT *, greatest(1, floor(b / g)) + CASE WHEN gi < b - greatest(1, floor(b / g)) * g THEN 1 ELSE 0 END AS share FROM e)
    SELECT doc_id, source, lang FROM s WHERE n <= b OR m <= share
      OR list_contains(list_transform(generate_series(0, share::BIGINT - 1), lambda j: floor(j * (m / share))::BIGINT), r)"""
)
def jon_stratified_sample(spark, d):
    return filters.stratified(_docs(spark, d).select("doc_id", "source", "lang"), 300, "source", "lang", ["doc_id"])


# -- vectors -------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "embedding")


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NEAR = f"""n AS (SELECT a.vec_id, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE {_DOT} END AS s FROM embeddings a, embeddings b),
    nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS r FROM n)"""
_UNIQ = f"{_NEAR}, u AS (SELECT vec_id, 1 - 0.5 * avg(s) - 0.5 * max(s) AS uniqueness FROM nn WHERE r <= 20 GROUP BY vec_id)"
_DENS = """m AS (SELECT d, avg(x) AS x FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d),
    c AS (SELECT list(x / (norm + 1e-8) ORDER BY d) AS c FROM m, (SELECT sqrt(sum(x * x)) AS norm FROM m)),
    de AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], c) AS density FROM embeddings, c)"""


@_query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
    SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 50"""
)
def vec_topk(spark, d):
    v = _vectors(spark, d)
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.top_k(q, v, 50).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@_query(SQL["vec_topk"])
def vec_topk_clustered(spark, d):
    """vec_topk from a stored table in blocks by direction, of which a query opens those that its bounds allow."""
    v = _vectors(spark, d)
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found, _ = clustered.Clustered.write(v, scratch_path(spark, "clustered")).top_k(q, 50)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@_query(f"WITH {_UNIQ} SELECT vec_id, round(uniqueness, 6) AS uniqueness FROM u")
def vec_uniqueness(spark, d):
    return vectors.uniqueness(_vectors(spark, d)).select("vec_id", F.round("uniqueness", 6).alias("uniqueness"))


@_query(f"WITH {_DENS} SELECT vec_id, round(density, 6) AS density FROM de")
def vec_density(spark, d):
    return vectors.density(_vectors(spark, d)).select("vec_id", vectors.rounded(F.col("density")).alias("density"))


@_query(
    f"""WITH {_UNIQ}, {_DENS}, q AS (SELECT vec_id, 0.4 * uniqueness / max(uniqueness) OVER () + 0.3 * density / max(density) OVER () + 0.3 AS q FROM u JOIN de USING (vec_id)),
    r AS (SELECT vec_id, row_number() OVER (ORDER BY round(q, 9), vec_id) AS r, count(*) OVER () AS n FROM q)
    SELECT vec_id FROM r WHERE r > greatest(1, floor(n * 0.08))"""
)
def vec_quality_filter(spark, d):
    return vectors.quality_filter(_vectors(spark, d), text_col=None).select("vec_id")


@_query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_DOT} > 0.4")
def vec_similar_pairs(spark, d):
    return vectors.similar_vectors(_vectors(spark, d), 0.4).withColumn("similarity", F.round("similarity", 6))


@_query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def vec_normalize(spark, d):
    return _vectors(spark, d).select("vec_id", F.transform(vectors.normalized(F.col("embedding")), lambda x: vectors.rounded(x)).alias("unit"))


_STOP = ", ".join(f"'{w}'" for w in P.stop_words)
_TOKENS = rf"unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: NOT list_contains([{_STOP}], w)))"


@_query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS d, count(*) AS n FROM t GROUP BY ALL)
    SELECT doc_id, d, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM b"""
)
def vec_hash_embed(spark, d):
    v = _docs(spark, d).select("doc_id", vectors.hash_embedding(lexical.tokenizer(P)(F.col("text"))).alias("v"))
    rows = v.select("doc_id", F.posexplode("v").alias("d", "x")).where("x > 0")
    return rows.select("doc_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("value"))


# -- lexical -------------------------------------------------------------------------------------------------

_POST = f"p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TOKENS} AS term FROM documents) GROUP BY ALL)"
_STATS = f"""{_POST}, dl AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains([{_STOP}], w))) AS dl FROM documents),
    nd AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), f AS (SELECT term, count(*) AS df, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p, nd GROUP BY term, n),
    i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM f)"""
_BM25 = f"""{_STATS}, q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, {_TOKENS} AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM q JOIN i USING (term) JOIN p USING (term) JOIN dl USING (doc_id), nd GROUP BY ALL),
    z AS (SELECT query_id, doc_id, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE raw END AS score FROM s)"""
_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)"


def _index(spark, d):
    docs = _docs(spark, d)
    tokens = lexical.tokenizer(P)
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.build_index(docs, tokens(F.col("text"))), queries, tokens


@_query(f"WITH {_POST} SELECT * FROM p")
def lex_tokens(spark, d):
    return lexical.term_counts(_docs(spark, d), lexical.tokenizer(P)(F.col("text")), "doc_id")


@_query(f"WITH {_STATS} SELECT term, df, round(idf, 6) AS idf FROM i")
def lex_term_stats(spark, d):
    return _index(spark, d)[0].terms.withColumn("idf", F.round("idf", 6))


@_query(f"WITH {_BM25} SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, {_BEST} AS rank FROM z WHERE score > 0) WHERE rank <= 50")
def lex_bm25_topk(spark, d):
    index, queries, tokens = _index(spark, d)
    found = lexical.search(index, queries, tokens(F.col("query")), ["query_id"])
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@_query(
    f"""WITH {_BM25}, qs AS (SELECT DISTINCT query_id, term FROM q),
    nm AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(substr(text, 1, strpos(text || ' ', ' '))), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
    nk AS (SELECT * FROM nm WHERE NOT list_contains([{_STOP}], term)), nn AS (SELECT doc_id, count(*) AS n FROM nk GROUP BY ALL),
    bo AS (SELECT query_id, doc_id, 0.3 * count(*) / max(n) AS boost FROM qs JOIN nk USING (term) JOIN nn USING (doc_id) GROUP BY ALL),
    y AS (SELECT coalesce(z.query_id, bo.query_id) AS query_id, coalesce(z.doc_id, bo.doc_id) AS doc_id,
             CASE WHEN boost IS NULL THEN score ELSE least(coalesce(score, 0) + boost, 1.5) END AS score FROM z FULL JOIN bo ON z.query_id = bo.query_id AND z.doc_id = bo.doc_id)
    SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, {_BEST} AS rank FROM y WHERE score > 0) WHERE rank <= 50"""
)
def lex_boosted(spark, d):
    """The first word stands for a document's name."""
    index, queries, tokens = _index(spark, d)
    names = _docs(spark, d).select("doc_id", F.substring_index("text", " ", 1).alias("name"))
    found = lexical.search(index, queries, tokens(F.col("query")), ["query_id"], names=names, name_tokens=tokens(F.col("name")))
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


# -- queries -------------------------------------------------------------------------------------------------

_has = lambda words: "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"
_QTYPE = "CASE " + " ".join(f"WHEN {_has(ws)} THEN '{n}'" for n, ws in P.question_types.items()) + " END"
_ENT = f"""list_filter(list_transform(string_split_regex({_strip(f"regexp_replace(text, '{P.comparison_tail}', '')")}, '{P.comparison_split}'),
    lambda p: {_strip(f"regexp_replace({_strip('p')}, '{P.question_lead}', '')")}), lambda p: length(p) >= 2)[1:2]"""


@_query(
    f"""SELECT conv_id, turn, {_QTYPE} AS query_type, {_has(P.question_types['comparison'])} AS is_comparison, {_ENT} AS entities,
    CASE WHEN {_has(P.question_types['comparison'])} THEN 0.30::DOUBLE WHEN {_has(P.question_types['definition'])} THEN 0.60::DOUBLE ELSE 0.45::DOUBLE END AS mmr_lambda FROM conversations"""
)
def qry_understand(spark, d):
    rows = _t(spark, d, "conversations").withColumnRenamed("text", "query")
    return query.understand(rows, P).select("conv_id", "turn", "query_type", "is_comparison", "entities", "mmr_lambda")


@_query()
def qry_variants(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return query.variants(rows, P, ("conv_id", "turn"))


# -- fusion and ranking --------------------------------------------------------------------------------------

_HITS = """h AS (SELECT user_id AS query_id, (['small', 'large', 'bm25', 'qa'])[1 + event_id % 4] AS arm, extract(hour FROM ts)::INT AS variant_no, 'c' || (event_id % 37)::VARCHAR AS chunk_id, value AS score, event_id FROM events),
    hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm, variant_no ORDER BY score DESC, event_id) AS rank FROM h),
    mv AS (SELECT query_id, arm, chunk_id, max(score) AS score, min((variant_no, rank)) AS seen FROM hr GROUP BY ALL),
    mr AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY seen, chunk_id) AS rank FROM mv)"""


def _hits(spark, d):
    """Events as hits: a user's events are the hits of a query, by arm and hour."""
    arms = F.array(*map(F.lit, rank.ARMS))
    rows = _t(spark, d, "events").select(
        F.col("user_id").alias("query_id"), arms[(F.col("event_id") % 4).cast("int")].alias("arm"), F.hour("ts").alias("variant_no"),
        F.concat(F.lit("c"), (F.col("event_id") % 37).cast("string")).alias("chunk_id"), F.col("value").alias("score"), "event_id",
    )
    order = rank.Window.partitionBy("query_id", "arm", "variant_no").orderBy(F.desc("score"), "event_id")
    return rows.withColumn("rank", F.row_number().over(order))


@_query(f"WITH {_HITS} SELECT query_id, arm, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM mr")
def rnk_merge_variants(spark, d):
    return rank.merge_variants(_hits(spark, d)).select("query_id", "arm", "chunk_id", F.round("score", 6).alias("score"), "rank")


_RRF = f"""{_HITS}, w AS (SELECT *, (CASE arm WHEN 'small' THEN 1.5 WHEN 'large' THEN 1.2 WHEN 'bm25' THEN 1.0 ELSE 1.3 END)::DOUBLE / (60 + rank) AS w, list_position(['small', 'large', 'bm25', 'qa'], arm) - 1 AS a FROM mr),
    g AS (SELECT query_id, chunk_id, sum(w) AS rrf, coalesce(max(score) FILTER (arm = 'small'), 0) AS ds, coalesce(max(score) FILTER (arm = 'large'), 0) AS dl, coalesce(max(score) FILTER (arm = 'bm25'), 0) AS bm25,
            string_agg(arm, '+' ORDER BY a) AS match_type, min((a, rank)) AS first FROM w GROUP BY ALL),
    fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first, chunk_id) AS place FROM g)"""


@_query(f"WITH {_RRF} SELECT query_id, chunk_id, round(rrf, 9) AS rrf, round(ds, 6) AS ds, round(dl, 6) AS dl, round(bm25, 6) AS bm25, match_type, place::INT AS place FROM fu")
def rnk_rrf(spark, d):
    out = rank.rrf(rank.merge_variants(_hits(spark, d)))
    return out.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), *[F.round(c, 6).alias(c) for c in ("ds", "dl", "bm25")], "match_type", "place")


_SRC = "(substr(chunk_id, 2)::INT % 5)"


@_query(f"WITH {_RRF}, c AS (SELECT *, {_SRC} AS source_doc FROM fu) SELECT query_id, chunk_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_doc ORDER BY place) AS r FROM c) WHERE r <= 3")
def rnk_source_cap(spark, d):
    fused = rank.rrf(rank.merge_variants(_hits(spark, d))).withColumn("source_doc", F.substring("chunk_id", 2, 9).cast("int") % 5)
    return rank.cap_by_source(fused, 3).select("query_id", "chunk_id", "place")


@_query(
    f"""WITH {_RRF}, f AS (SELECT query_id, chunk_id, place, 0.35 * rrf / max(rrf) OVER (PARTITION BY query_id) + 0.65 * (ds / 997) AS final FROM fu)
    SELECT query_id, chunk_id, round(final, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, place, chunk_id)::INT AS final_rank FROM f"""
)
def rnk_final(spark, d):
    out = rank.final_scores(rank.rrf(rank.merge_variants(_hits(spark, d))), F.col("ds") / 997)
    return out.select("query_id", "chunk_id", F.round("final", 6).alias("final"), "final_rank")


@_query(
    f"""WITH {_RRF}, b AS (SELECT query_id, {_SRC} AS source_doc, substr(chunk_id, 2)::INT AS chunk_index, place, chunk_id FROM fu),
    s AS (SELECT *, min(place) OVER (PARTITION BY query_id, source_doc) AS seen, coalesce(chunk_index - lag(chunk_index) OVER w > 10, true)::INT AS new FROM b WINDOW w AS (PARTITION BY query_id, source_doc ORDER BY chunk_index, place)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY query_id, source_doc ORDER BY chunk_index, place) AS run FROM s),
    o AS (SELECT query_id, source_doc, run, min(seen) AS seen, arg_min(chunk_id, (chunk_index, place)) AS chunk_id, string_agg(chunk_id, chr(10) ORDER BY chunk_index, place) AS content, count(*) AS merged_count FROM r GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, source_doc, run)::INT AS final_place, chunk_id, content, merged_count::INT AS merged_count FROM o"""
)
def rnk_islands(spark, d):
    rows = rank.rrf(rank.merge_variants(_hits(spark, d)))
    index = F.substring("chunk_id", 2, 9).cast("int")
    rows = rows.withColumns({"source_doc": index % 5, "chunk_index": index, "content": F.col("chunk_id"), "parent_content": F.col("chunk_id")})
    return rank.merge_adjacent(rows, "place", 10).select("query_id", "final_place", "chunk_id", "content", "merged_count")


def _pairs(spark, d):
    return qa.pairs_of_turns(_t(spark, d, "conversations"))


@_query(
    """SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS qa_id, text AS question, n AS answer FROM
    (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'"""
)
def rnk_qa_pairs(spark, d):
    return _pairs(spark, d)


def _base(spark, d):
    docs = _docs(spark, d)
    queries = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return engine.build(docs, P, pairs=materialize(_pairs(spark, d), "pairs")), queries


@_query()
def rnk_hybrid(spark, d):
    """Build a knowledge base of all documents and search it with every benchmark item."""
    found = engine.search(*_base(spark, d))
    return found.select("query_id", "rank", "chunk_id", "source_doc", "chapter", "merged_count", "match_type", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"))


@_query()
def fmt_context(spark, d):
    return engine.answer(*_base(spark, d))


@_query()
def jdg_evaluate(spark, d):
    kb, queries = _base(spark, d)
    found = engine.search(kb, queries)
    queries = queries.withColumn("query_type", F.coalesce(query.query_type(F.col("query"), P), F.lit("framework"))).withColumn("difficulty", F.lit("easy"))
    return engine.evaluate(found, queries, P).select("query_id", "query_type", "context_relevance_score", "is_sufficient", F.size("chunks").alias("n_chunks"))


# -- metrics -------------------------------------------------------------------------------------------------

_EVALS = """j AS (SELECT d.source AS query_id, d.lang AS query_type, d.doc_id, l.quality = 1 AS rel, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    e AS (SELECT query_id || '-' || query_type AS query_id, query_type, CASE WHEN count(*) > 5 THEN 'hard' ELSE 'easy' END AS difficulty, (1 + sum(rel::INT) % 5)::INT AS crs, sum(toxic) = 0 AS suff, list(rel ORDER BY doc_id) AS ch FROM j GROUP BY j.query_id, query_type),
    x AS (SELECT *, len(list_filter(ch, lambda c: c)) AS nrel, CASE WHEN list_position(ch, true) > 0 THEN list_position(ch, true) END AS first FROM e)"""


def _evaluations(spark, d):
    """Labels as judgments: the labelled documents of a source and language are the chunks of one query."""
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    item = F.struct(F.col("doc_id").alias("rank"), (F.col("quality") == 1).alias("is_relevant"))
    g = rows.groupBy(F.concat_ws("-", "source", "lang").alias("query_id"), F.col("lang").alias("query_type")).agg(
        F.sort_array(F.collect_list(item)).alias("chunks"), F.sum((F.col("quality") == 1).cast("int")).alias("r"), F.sum("toxic").alias("t")
    )
    return g.select(
        "query_id", F.col("query_id").alias("query"), "query_type", F.when(F.size("chunks") > 5, "hard").otherwise("easy").alias("difficulty"),
        (1 + F.col("r") % 5).cast("int").alias("context_relevance_score"), (F.col("t") == 0).alias("is_sufficient"), "chunks",
    )


_four = lambda x: f"round(round(({x})::DOUBLE, 9) + 1e-10, 4)"
_prec = lambda k: f"(len(list_filter(ch[1:{k}], lambda c: c)) / len(ch[1:{k}]))"
_METRIC = {f"context_precision@{k}": f"avg({_prec(k)})" for k in metrics.KS}
_METRIC |= {f"ranking_quality@{k}": f"avg(CASE WHEN first <= {k} THEN 1.0 / first ELSE 0 END)" for k in metrics.KS}
_METRIC |= {
    "hit_rate@10": "avg((coalesce(first, 99) <= 10)::INT)", "context_relevance": "avg(crs / 5)", "context_sufficiency": "avg(suff::INT)", "context_utilization": "avg(nrel / len(ch))",
}


@_query(f"WITH {_EVALS} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {_four(x)} AS value FROM x" for n, x in _METRIC.items()))
def agg_metrics(spark, d):
    return metrics.metrics(_evaluations(spark, d))


def _group(col: str, quality: str) -> str:
    return f"""SELECT '{col}' AS "grouping", {col} AS value, count(*) AS n, {_four(f'avg({_prec(10)})')} AS context_precision, {_four('avg(crs / 5)')} AS context_relevance,
    {_four('avg(suff::INT)')} AS context_sufficiency, {quality} AS ranking_quality FROM x GROUP BY {col}"""


_GROUPS = f"{_group('query_type', _four('avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END)'))} UNION ALL {_group('difficulty', 'NULL')}"


@_query(f"WITH {_EVALS} {_GROUPS}")
def agg_groups(spark, d):
    return metrics.group_metrics(_evaluations(spark, d))


_FAIL = ("nrel = 0", "nrel > 0 AND nrel / len(ch) < 0.3", "nrel > 0 AND NOT suff", "nrel > 0 AND first > 5", "nrel > 0 AND crs < 3")


@_query(f"WITH {_EVALS} " + " UNION ALL ".join(f"SELECT '{n}' AS failure, count(*) FILTER ({t}) AS n FROM x" for n, t in zip(metrics.FAILURES, _FAIL, strict=True)))
def agg_failures(spark, d):
    return metrics.failures(_evaluations(spark, d))


@_query(
    f"""WITH {_EVALS} SELECT query_id, query_id AS query, query_type, difficulty, len(ch)::INT AS total_chunks, nrel::INT AS relevant_chunks, round(nrel / len(ch), 4) AS precision,
    crs AS context_relevance_score, suff AS is_sufficient, first::BIGINT AS first_relevant_rank FROM x"""
)
def agg_details(spark, d):
    return metrics.details(_evaluations(spark, d))


def _report_sql(share: float | None) -> str:
    none, short = "f1 > n * 0.1", f"f3 > n * {share}" if share is not None else "false"
    p, r, s = '"context_precision@10"', "context_relevance", "context_sufficiency"
    grade = " ".join(f"WHEN {p} >= {a} AND {r} >= {b} AND {s} >= {c} THEN '{g}'" for g, a, b, c in metrics.GRADES)
    return f"""WITH {_EVALS}, g AS ({_GROUPS}), w AS (SELECT coalesce(string_agg(value, ',' ORDER BY value), '') AS weak FROM g WHERE "grouping" = 'query_type' AND context_precision < 0.5),
    m AS (SELECT count(*) AS n, count(*) FILTER (nrel = 0) AS f1, count(*) FILTER (nrel > 0 AND NOT suff) AS f3, {", ".join(f'{_four(x)} AS "{n}"' for n, x in _METRIC.items())} FROM x)
    SELECT m.* EXCLUDE (f1, f3), CASE {grade} ELSE 'C' END AS grade,
      CASE WHEN {none} THEN 'no relevant chunk' WHEN {short} THEN 'insufficient context' WHEN weak <> '' THEN 'low precision: ' || weak ELSE 'none' END AS bottleneck,
      CASE WHEN {none} THEN 'widen recall' WHEN {short} THEN 'raise top-k or chunk size' WHEN weak <> '' THEN 'improve expansion and reranking' ELSE 'none' END AS suggestion FROM m, w"""


@_query(_report_sql(0.3))
def agg_report(spark, d):
    return metrics.report(materialize(_evaluations(spark, d), "evaluations"))


@_query(_report_sql(None))
def agg_report_quick(spark, d):
    return metrics.report(materialize(_evaluations(spark, d), "evaluations"), None)


@_query(
    """SELECT * FROM (SELECT 'qa_type' AS "grouping", lang AS value, count(*) AS n FROM documents GROUP BY lang
    UNION ALL SELECT 'source_doc', source, count(*) FROM documents GROUP BY source)"""
)
def agg_qa_statistics(spark, d):
    return metrics.qa_statistics(_docs(spark, d).select(F.col("lang").alias("qa_type"), F.col("source").alias("source_doc")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return rnk_hybrid(spark, d)


