"""More registered queries: ranking, question-answer matching, formatting, chunking and files, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions.profiles import LATIN as P
from .operators import chunk, dedup, filters, formatting, lexical, lines, metrics, qa, query, rank, refine, vectors
from .plans import engine
from .plans import score_cache
from .plans.scratch import materialize, scratch_path
from .queries import _BEST, _BM25, _CHAPTERS, _DENS, _DOT, _LINES, _NEAR, _STOP, _UNIQ, _clean, _count, _docs, _index, _packed, _pairs, _query, _strip, _t, _terms, _vectors, _windows
from .sources import files

_toks = lambda x, least=1: rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda w: NOT list_contains([{_STOP}], w) AND length(w) >= {least})"
_quote = lambda p: p.replace("'", "''")


# -- refinement and chunking: the same SQL for both profiles ----------------------------------------------------


def _sentences(x: str, marks: str) -> str:
    return rf"regexp_extract_all({x}, '[^{marks}]*[{marks}]|[^{marks}]+')"


def re2(pattern: str) -> str:
    """A profile's pattern without lookahead, where only whether it matches counts."""
    nxt = r"(?![\p{L}\p{N}_])"
    for low, high in ((2, 8), (0, 5)):  # the first of the characters that follow a cue is none of a word
        pattern = pattern.replace(f"{nxt}.{{{low},{high}}}", rf"[^\p{{L}}\p{{N}}_\n].{{{max(low - 1, 0)},{high - 1}}}")
    return _quote(pattern.replace(nxt, r"(?:[^\p{L}\p{N}_]|$)"))


def _heading(x: str, p) -> str:
    return f"(length({_strip(x)}) <= 60 AND regexp_matches({_strip(x)}, '{re2(p.chapter)}|{re2(p.section)}'))"


def paragraphs_sql(table: str, p) -> str:
    """doc_id, para_no from 0, c, h (whether the paragraph before is a heading)."""
    marks = p.sentence[1:-1]
    long = f"list_transform({_packed(_sentences('x', marks), refine.PACKED)}, lambda y: {_strip('y')})"
    cut = f"CASE WHEN length(x) > {refine.LONG_PARAGRAPH} THEN {long} ELSE [x] END"
    blocks = f"list_filter(list_transform(string_split_regex(coalesce(text, ''), '{p.paragraph}'), lambda x: {_strip('x')}), lambda x: length(x) >= {refine.LEAST_PARAGRAPH})"
    return f"""pb AS (SELECT doc_id, unnest({blocks}) AS x, generate_subscripts({blocks}, 1) AS b FROM {table}), pc AS (SELECT doc_id, b, {cut} AS cs FROM pb),
    pe AS (SELECT doc_id, b, unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM pc), pn AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS para_no, c, coalesce(lag({_heading('c', p)}) OVER w, false) AS h
    FROM pe WINDOW w AS (PARTITION BY doc_id ORDER BY b, j))"""


def score_sql(p) -> str:
    add = lambda cond, x: f"CASE WHEN {cond} THEN {x} ELSE 0 END"
    has = lambda pattern: f"regexp_matches(c, '{re2(pattern)}')"
    return f"""greatest(0.0, least(1.0, 0.3::DOUBLE + {add('h', 0.30)} + {add(has(p.definition), 0.35)} + {add(has(p.framework), 0.25)} + {add(has(p.conclusion), 0.20)}
      + least(0.20, {_terms('c', p.terms)} / greatest(length(c) / 100.0, 1.0) * 0.05) + {add(_heading('c', p), 0.15)} - {add(has(p.lead_in), 0.15)} - {add('length(c) < 30', 0.10)}
      - {add(f"length(c) > 0 AND {_count('c', '[0-9]')} / greatest(length(c), 1) > 0.3", 0.15)}))"""


def scored_sql(table: str, p, before: str = "") -> str:
    return f"WITH {before}{paragraphs_sql(table, p)} SELECT doc_id, para_no, length(c) AS n_chars, round(({score_sql(p)})::DOUBLE, 6) AS score FROM pn"


def parts_sql(table: str, p, before: str = "") -> str:
    """Chapters, sections or windows of every text."""

    def split(name: str, source: str, text: str, pattern: str) -> str:
        line = _strip("raw")
        return f"""{name}l AS (SELECT doc_id, unnest(string_split({text}, chr(10))) AS raw, generate_subscripts(string_split({text}, chr(10)), 1) AS line_no FROM {source}),
        {name}h AS (SELECT *, {line} AS line, length({line}) < 80 AND regexp_matches({line}, '{re2(pattern)}') AS head FROM {name}l),
        {name}n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part_no FROM {name}h),
        {name} AS (SELECT doc_id, part_no, coalesce(max(line) FILTER (head), '') AS title, string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT head) AS content
          FROM {name}n GROUP BY doc_id, part_no HAVING count(*) FILTER (NOT head) > 0)"""

    return f"""WITH {before}{split('pa', table, "coalesce(text, '')", p.chapter)}, pk AS (SELECT *, count(*) OVER (PARTITION BY doc_id) = 1 AND title = '' AS plain FROM pa),
    pl AS (SELECT doc_id, content FROM pk WHERE plain), {split('se', 'pl', 'content', p.section)},
    wi AS (SELECT doc_id, unnest(generate_series(0, length(content) - 1, {refine.SECTION_WINDOW})) AS pos, content FROM pl WHERE doc_id NOT IN (SELECT doc_id FROM se))
    SELECT doc_id, part_no::BIGINT AS part_no, title, content FROM pk WHERE NOT plain UNION ALL SELECT doc_id, part_no::BIGINT, title, content FROM se
    UNION ALL SELECT doc_id, (pos // {refine.SECTION_WINDOW})::BIGINT, '', substr(content, pos + 1, {refine.SECTION_WINDOW}) FROM wi"""


@_query(scored_sql("documents", P))
def ref_score_paragraphs(spark, d):
    return refine.score_paragraphs(_docs(spark, d), P)


@_query(parts_sql("documents", P))
def ref_chapters(spark, d):
    return refine.split_chapters(_docs(spark, d), P).withColumn("part_no", F.col("part_no").cast("long"))


@_query(rf"""SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?s)[^.]*\.|[^.]+')) AS piece, generate_subscripts(regexp_extract_all(coalesce(text, ''), '(?s)[^.]*\.|[^.]+'), 1) - 1 AS piece_no FROM documents""")
def chk_by_separator(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(chunk.by_separator(F.coalesce("text", F.lit("")), ".")).alias("piece_no", "piece"))
    return rows.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), "piece")


_PACKS = _packed(_sentences("coalesce(text, '')", P.sentence[1:-1]), 600)


@_query(f"SELECT doc_id, unnest({_PACKS}) AS pack, generate_subscripts({_PACKS}, 1) - 1 AS pack_no FROM documents WHERE coalesce(text, '') <> ''")
def chk_packed_sentences(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(chunk.packed_sentences(F.coalesce("text", F.lit("")), 600, P)).alias("pack_no", "pack"))
    return rows.select("doc_id", F.col("pack_no").cast("long").alias("pack_no"), "pack")


@_query(f"SELECT doc_id, (pos // 500)::INT AS chunk_index, pos::BIGINT AS position FROM {_windows(500, 500)}")
def chk_positions(spark, d):
    rows = chunk.fixed_windows(_docs(spark, d), 500, 500).withColumnRenamed("window_no", "chunk_index")
    return chunk.positions(rows).select("doc_id", "chunk_index", "position")


_PREPROCESSED = rf"""a AS (SELECT *, lag(line, 1, '') OVER w AS b, lead(line, 1, '') OVER w AS n FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    k AS (SELECT * FROM a WHERE line = '' OR NOT (NOISE OR length(line) = 1 OR (length(line) = 2 AND NOT regexp_matches(line, 'SHORT'))
          OR (regexp_matches(line, '^\d{{1,4}}$') AND b = '' AND n = ''))),
    p AS (SELECT *, last_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k),
    q AS (SELECT * FROM p WHERE line = '' OR line IS DISTINCT FROM prev),
    r AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM q),
    j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM r WHERE NOT (line = '' AND coalesce(before = '', false)) GROUP BY doc_id),
    pre AS (SELECT d.doc_id, {_strip("regexp_replace(coalesce(t, ''), ' {2,}', ' ', 'g')")} AS text FROM TABLE_ d LEFT JOIN j USING (doc_id))"""


def noise_sql(p) -> str:
    headers = ", ".join(f"'{h}'" for h in p.headers)
    return f"(regexp_matches(line, '{_quote(p.noise)}')" + (f" OR rtrim(line) IN ({headers}))" if headers else ")")


def preprocessed_sql(table: str, p) -> str:
    """Steps up to pre: doc_id and the cleaned text."""
    steps = _PREPROCESSED.replace("NOISE", noise_sql(p)).replace("SHORT", p.short_line).replace("TABLE_", table)
    return f"{_LINES.replace('FROM documents', f'FROM {table}')}, {steps}"


def content_sql(table: str, p, most: int, marks: tuple[str, ...], before: str = "") -> str:
    """Short texts as they are; others cleaned, from the first chapter on, cut at a boundary."""
    split = "string_split(coalesce(text, ''), chr(10))"
    at = ", ".join(f"CASE WHEN strpos(reverse(head), {m}) > 0 THEN length(head) - strpos(reverse(head), {m}) ELSE -1 END" for m in marks)
    noise, head = noise_sql(p), f"length(line) < 80 AND regexp_matches(line, '{re2(p.chapter_in_text)}')"
    return f"""WITH {before}{preprocessed_sql(table, p)},
    fl AS (SELECT doc_id, unnest({split}) AS raw, generate_subscripts({split}, 1) - 1 AS line_no FROM pre), fs AS (SELECT *, {_strip('raw')} AS line FROM fl),
    fh AS (SELECT *, {head} AS head, {noise} AS noise FROM fs), fg AS (SELECT *, (length(line) > 50 AND NOT noise) OR (length(line) > 30 AND NOT head AND NOT noise) AS solid FROM fh),
    fn AS (SELECT *, bool_or(solid) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS near FROM fg),
    fc AS (SELECT doc_id, coalesce(min(line_no) FILTER (head AND near), min(line_no) FILTER (length(line) > 20 AND NOT noise), 0) AS start FROM fn GROUP BY doc_id),
    fb AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS body FROM fl JOIN fc USING (doc_id) WHERE line_no >= start GROUP BY doc_id),
    ft AS (SELECT d.doc_id, coalesce(d.text, '') AS text, coalesce(body, '') AS body, left(coalesce(body, ''), {most}) AS head FROM {table} d LEFT JOIN fb USING (doc_id)),
    fz AS (SELECT *, greatest({at}) AS last FROM ft)
    SELECT doc_id, CASE WHEN length(text) <= {most} THEN text WHEN length(body) <= {most} THEN body WHEN last > {most} * 0.6 THEN left(body, last + 1) ELSE head END AS content FROM fz"""


_LINE_MARKS = ("chr(10)", "'。'", "'；'", "'！'", "'？'")


@_query(content_sql("documents", P, 1500, _LINE_MARKS))
def txt_extract_content(spark, d):
    return lines.extract_content(_docs(spark, d), 1500, P)


# -- filters and vectors -----------------------------------------------------------------------------------------


def _numbered(rows, key):
    """rows with _n, their place in the order of key: places in a range of keys, after the rows of the ranges before."""
    placed = materialize(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    part, offset, before = F.shiftrightunsigned("_i", 33), 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):  # one row for each range
        before += [F.lit(p).cast("long"), F.lit(offset).cast("long")]
        offset += n
    place = (F.create_map(*before)[part] if before else F.lit(0).cast("long")) + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_n", place).drop("_i")


@_query(
    f"""WITH t AS (SELECT doc_id, list_distinct({_toks("coalesce(text, '')")}) AS t FROM documents), p AS (SELECT doc_id, t AS b, lag(t) OVER (ORDER BY doc_id) AS a FROM t WHERE true)
    SELECT doc_id, round(CASE WHEN a IS NULL OR len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6)::DOUBLE AS similarity FROM p"""
)
def flt_jaccard(spark, d):
    """Each document with the one whose id comes before it."""
    tokens = F.array_distinct(lexical.tokenizer(P)(F.col("text")))
    rows = _numbered(_docs(spark, d).select("doc_id", tokens.alias("b")), "doc_id")
    before = rows.select((F.col("_n") + 1).alias("_n"), F.col("b").alias("a"))
    return rows.join(before, "_n", "left").select("doc_id", F.round(F.coalesce(filters.jaccard(F.col("a"), F.col("b")), F.lit(0.0)), 6).alias("similarity"))


@_query(f"SELECT doc_id FROM documents WHERE length(coalesce(text, '')) >= {filters.LEAST_DOCUMENT}")
def flt_long_enough(spark, d):
    return filters.long_enough(_docs(spark, d)).select("doc_id")


_TEXTQ = f"""(0.3 * least(CASE WHEN c = '' THEN 0 ELSE {_count('c', P.script)} / length(c) END * 2, 1.0) + 0.3 * least({_count('c', P.sentence)} / 5.0, 1.0) + 0.2 + 0.2 * least(length(c) / 300.0, 1.0))"""


@_query(
    f"""WITH {_UNIQ}, {_DENS}, x AS (SELECT vec_id, {_TEXTQ} AS t FROM (SELECT vec_id, left(coalesce(text, ''), 600) AS c FROM embeddings JOIN documents ON vec_id = doc_id)),
    q AS (SELECT vec_id, 0.4 * uniqueness / max(uniqueness) OVER () + 0.3 * density / max(density) OVER () + 0.3 * t / max(t) OVER () AS q FROM u JOIN de USING (vec_id) JOIN x USING (vec_id)),
    r AS (SELECT vec_id, row_number() OVER (ORDER BY round(q, 9), vec_id) AS r, (SELECT count(*) FROM embeddings JOIN documents ON vec_id = doc_id) AS n FROM q)
    SELECT vec_id FROM r WHERE r > greatest(1, floor(n * 0.08))""".replace("FROM embeddings a, embeddings b", "FROM ev a, ev b").replace("FROM embeddings)", "FROM ev)").replace("FROM embeddings, c", "FROM ev, c")
    .replace("WITH n AS", "WITH ev AS (SELECT e.* FROM embeddings e JOIN documents ON vec_id = doc_id), n AS", 1)
)
def vec_text_quality(spark, d):
    """Vectors with the first 600 characters of the document of the same number as their chunk."""
    text = _docs(spark, d).select(F.col("doc_id").alias("vec_id"), F.left(F.coalesce("text", F.lit("")), F.lit(600)).alias("content"))
    rows = materialize(_vectors(spark, d).join(text, "vec_id"), "vectors-with-text")
    return vectors.quality_filter(rows, profile=P).select("vec_id")


def _greedy_sql(order: str, edges: str, key: str) -> str:
    """Rows of `order` (id, pos from 1) that a greedy pass keeps; edges: (a, b) of ids in any order."""
    return f"""gn AS (SELECT x.pos, list(y.pos) FILTER (y.pos < x.pos) AS ns FROM ({order}) x LEFT JOIN ({edges}) e ON x.id = e.a OR x.id = e.b
      LEFT JOIN ({order}) y ON (y.id = e.a OR y.id = e.b) AND y.id <> x.id GROUP BY x.pos),
    gr AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
      SELECT gn.pos, CASE WHEN list_has_any(gr.kept, coalesce(gn.ns, [])) THEN gr.kept ELSE list_append(gr.kept, gn.pos) END FROM gr JOIN gn ON gn.pos = gr.i + 1),
    gk AS (SELECT unnest(kept) AS pos FROM gr WHERE i = (SELECT max(pos) FROM gn)) SELECT o.id AS {key} FROM ({order}) o JOIN gk USING (pos)"""


_VEC_PAIRS = f"vp AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_DOT} > 0.4)"
_VEC_ORDER = f"vo AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY round(max(s), 9) DESC, vec_id) AS pos FROM n GROUP BY vec_id)"


@_query(f"WITH RECURSIVE {_NEAR}, {_VEC_PAIRS}, {_VEC_ORDER}, {_greedy_sql('SELECT * FROM vo', 'SELECT * FROM vp', 'vec_id')}")
def vec_dedup(spark, d):
    return vectors.dedup(_vectors(spark, d), 0.4).select("vec_id")


_GRAMS = """gc AS (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) >= 3),
    gs AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS g FROM gc),
    gm AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS rep, len(g) AS n, g FROM gs),
    ge AS MATERIALIZED (SELECT doc_id, n, hash(unnest(g)) AS x FROM gm WHERE doc_id = rep),
    gp AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM ge a JOIN ge b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    gv AS MATERIALIZED (SELECT a, b, CASE WHEN sh / least(na, nb) > 0.8 THEN 0.85 ELSE sh / (na + nb - sh) END::DOUBLE AS similarity FROM gp)"""


@_query(f"WITH {_GRAMS} SELECT a, b, round(similarity, 6) AS similarity FROM gv WHERE similarity > 0.7 UNION ALL SELECT rep, doc_id, 0.85 FROM gm WHERE doc_id <> rep")
def jon_ngram_similarity(spark, d):
    """Similar representatives, and each representative with its equals."""
    return dedup.similar_pairs(_docs(spark, d)).withColumn("similarity", F.round("similarity", 6))


_DOC_ORDER = "SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gm WHERE doc_id <> rep)"


@_query(f"WITH RECURSIVE {_GRAMS}, do_ AS MATERIALIZED ({_DOC_ORDER}), dp AS MATERIALIZED (SELECT a, b FROM gv WHERE similarity > 0.7), {_greedy_sql('SELECT * FROM do_', 'SELECT * FROM dp', 'doc_id')}")
def jon_content_dedup(spark, d):
    return dedup.content_dedup(_docs(spark, d)).select("doc_id")


# -- lexical -----------------------------------------------------------------------------------------------------

_CHAPTER_OF = "left(coalesce(d.text, ''), 60)"
_SHARE = f"(len(list_intersect(list_distinct({_toks(_CHAPTER_OF)}), {_toks('b.text')})) / greatest(len(list_distinct({_toks(_CHAPTER_OF)})), 1))"


@_query(
    f"""WITH {_BM25}, t AS (SELECT query_id, doc_id, score, {_BEST} AS rank FROM z WHERE score > 0), c AS (SELECT t.*, {_SHARE} AS share FROM t JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = t.query_id WHERE rank <= 50)
    SELECT query_id, doc_id, rank::INT AS rank, round(CASE WHEN share > 0 THEN least(score * (1 + 0.2 * share), 1.5) ELSE score END, 6) AS score FROM c"""
)
def lex_chapter_boost(spark, d):
    """The first 60 characters stand for a document's chapter."""
    index, queries, tokens = _index(spark, d)
    found = lexical.search(index, queries, tokens(F.col("query")), ["query_id"]).join(queries, "query_id")
    rows = found.join(_docs(spark, d).select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(60)).alias("chapter")), "doc_id")
    score = lexical.chapter_boost(F.col("score"), tokens(F.col("query")), tokens(F.col("chapter")))
    return rows.select("query_id", "doc_id", "rank", F.round(score, 6).alias("score"))


# -- ranking -----------------------------------------------------------------------------------------------------


def _turns(spark, d):
    """A conversation's turns as the candidates of its first turn."""
    rows = _t(spark, d, "conversations")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    rows = rows.join(first, "conv_id")
    return rows.select(F.col("conv_id").alias("query_id"), "query", F.col("turn").cast("string").alias("chunk_id"), (F.col("turn") + 1).cast("int").alias("final_rank"), "text")


_OVERLAP = f"len(list_intersect(list_distinct({_toks('query')}), {_toks('text')})) / greatest(len(list_distinct({_toks('query')})), 1)"
_TURNS = f"""f AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations GROUP BY conv_id),
    tu AS (SELECT c.conv_id AS query_id, query, turn::VARCHAR AS chunk_id, (turn + 1)::INT AS final_rank, c.text FROM conversations c JOIN f USING (conv_id)),
    sc AS (SELECT *, ({_OVERLAP})::DOUBLE AS ce_score FROM tu), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ce_score, 9) DESC, final_rank, chunk_id) AS r FROM sc)"""


def _overlap(tokens):
    return rank.overlap_scorer(tokens(F.col("query")), tokens(F.col("text")))


@_query(f"WITH {_TURNS} SELECT query_id, chunk_id, round(ce_score, 6) AS ce_score, r::INT AS ce_rank FROM rk WHERE r <= 15")
def rnk_rerank(spark, d):
    out = rank.rerank(_turns(spark, d), _overlap(lexical.tokenizer(P)))
    return out.select("query_id", "chunk_id", F.round("ce_score", 6).alias("ce_score"), "ce_rank")


@_query(f"WITH {_TURNS} SELECT query_id, chunk_id, round(ce_score, 6) AS ce_score, r::INT AS ce_rank, (SELECT count(*) FROM f WHERE conv_id % 2 = 0) AS hits, (SELECT count(*) FROM f WHERE conv_id % 2 = 1) AS misses FROM rk WHERE r <= 15")
def rnk_rerank_cached(spark, d):
    """Scores of even conversations come from a cache that an earlier pass made."""
    # a turn's number alone would give conversations that begin alike one key
    rows = _turns(spark, d).withColumn("chunk_id", F.concat_ws("-", "query_id", "chunk_id"))
    rows, score = materialize(rows, "turns"), _overlap(lexical.tokenizer(P))
    none = spark.createDataFrame([], "cache_key string, chunk_id string, ce_score double")
    path = scratch_path(spark, "cache")
    score_cache.append(rank.rerank_cached(rows.where("query_id % 2 = 0"), score, none)[1], path)
    ranked, _, stats = rank.rerank_cached(rows, score, lambda keys: score_cache.lookup(keys, path))
    turn = F.element_at(F.split("chunk_id", "-"), -1).alias("chunk_id")
    return ranked.join(stats).select("query_id", turn, F.round("ce_score", 6).alias("ce_score"), "ce_rank", "hits", "misses")


@_query(
    f"""WITH RECURSIVE q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, b.vec_id AS chunk_id, list_inner_product(qv, b.embedding::DOUBLE[]) AS score, b.embedding::DOUBLE[] AS v, qv FROM q, embeddings b),
    c AS MATERIALIZED (SELECT query_id, chunk_id, place, list_transform(v, lambda x: x / norm) AS u, list_inner_product(list_transform(v, lambda x: x / norm), qv) AS sim FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place, sqrt(list_inner_product(v, v)) AS norm FROM s WHERE score > 0) WHERE place <= 50),
    few AS (SELECT query_id FROM c GROUP BY query_id HAVING count(*) <= 15),
    r AS (SELECT query_id, 0 AS i, []::BIGINT[] AS picked, []::DOUBLE[][] AS us FROM q UNION ALL
      SELECT query_id, i + 1, list_append(picked, best.chunk_id), list_append(us, best.u) FROM
      (SELECT r.query_id, r.i, any_value(r.picked) AS picked, any_value(r.us) AS us, arg_max({{'chunk_id': c.chunk_id, 'u': c.u}},
         (round(0.45 * c.sim - 0.55 * CASE WHEN len(r.us) = 0 THEN 0 ELSE list_max(list_transform(r.us, lambda w: list_inner_product(w, c.u))) END, 12), -c.place)) AS best
       FROM r JOIN c USING (query_id) WHERE r.i < 15 AND NOT list_contains(r.picked, c.chunk_id) GROUP BY r.query_id, r.i)),
    f AS (SELECT query_id, picked FROM r WHERE i = 15)
    SELECT query_id, unnest(picked) AS chunk_id, generate_subscripts(picked, 1)::INT AS mmr_rank FROM f WHERE query_id NOT IN (SELECT query_id FROM few)
    UNION ALL SELECT query_id, chunk_id, place::INT FROM c WHERE query_id IN (SELECT query_id FROM few)"""
)
def rnk_mmr(spark, d):
    """Every hundredth vector as a query: its 50 nearest in order of marginal relevance."""
    v = _vectors(spark, d)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = vectors.top_k(q.withColumnRenamed("query_vector", "embedding"), v, 50)
    rows = near.join(v, "vec_id").join(q, "query_id").select("query_id", F.col("vec_id").alias("chunk_id"), F.col("rank").alias("place"), "embedding", "query_vector")
    return rank.mmr(rows, 15)


# -- question-answer matching ------------------------------------------------------------------------------------

_PAIR = """qp AS MATERIALIZED (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS qa_id, text AS question, n AS answer FROM
    (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"""


def _buckets(name: str, key: str, source: str, text: str) -> str:
    """The built-in encoder's vectors as rows (key, d, x)."""
    return f"""{name}0 AS (SELECT {key}, ('0x' || substr(md5(unnest({_toks(text)})), 1, 8))::BIGINT % 64 AS d FROM {source}), {name}1 AS (SELECT {key}, d, count(*) AS n FROM {name}0 GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT {key}, d, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM {name}1)"""


_MATCH = f"""{_PAIR}, tp AS MATERIALIZED (SELECT qa_id, term, count(*) AS tf FROM (SELECT qa_id, unnest({_toks('question', 2)}) AS term FROM qp) GROUP BY ALL),
    tl AS (SELECT qa_id, len({_toks('question', 2)}) AS dl FROM qp), nd AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tl),
    tf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tp, nd GROUP BY term, n), ti AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM tf),
    tq AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_toks('text', 2)}) AS term FROM benchmark) GROUP BY ALL),
    lr AS (SELECT item_id, qa_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM tq JOIN ti USING (term) JOIN tp USING (term) JOIN tl USING (qa_id), nd GROUP BY ALL),
    lx AS (SELECT item_id, qa_id, CASE WHEN max(raw) OVER (PARTITION BY item_id) > 0 THEN raw / max(raw) OVER (PARTITION BY item_id) ELSE raw END AS lex FROM lr),
    {_buckets('vp', 'qa_id', 'qp', 'question')}, {_buckets('vq', 'item_id', 'benchmark', 'text')},
    sr AS (SELECT item_id, qa_id, sum(vp.x * vq.x) AS s FROM vp JOIN vq USING (d) GROUP BY ALL), sx AS (SELECT item_id, qa_id, s / max(s) OVER (PARTITION BY item_id) AS sem FROM sr),
    ma AS (SELECT coalesce(sx.item_id, lx.item_id) AS item_id, coalesce(sx.qa_id, lx.qa_id) AS qa_id, 0.7 * coalesce(sem, 0) + 0.3 * coalesce(lex, 0) AS score
      FROM sx FULL JOIN lx ON sx.item_id = lx.item_id AND sx.qa_id = lx.qa_id)"""
_FIRST = "SELECT item_id AS query_id, qa_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, qa_id) AS rank FROM {} WHERE score > 0) WHERE rank <= 15"


def _asked(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@_query(f"WITH {_MATCH} {_FIRST.format('ma')}")
def rnk_qa(spark, d):
    pairs = materialize(_pairs(spark, d), "pairs")
    return qa.search(pairs, _asked(spark, d), lexical.tokenizer(P, 2), engine.default_embed(P)).withColumn("score", F.round("score", 6))


_KINDS = ("definition", "comparison", "framework", "principle", "case")
_has = lambda words, x="text": "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def understood(p, x: str = "text") -> tuple[str, str]:
    """(query type, entities) of a column in SQL."""
    kind = "CASE " + " ".join(f"WHEN {_has(ws, x)} THEN '{n}'" for n, ws in p.question_types.items()) + " END"
    tail = f"regexp_replace({x}, '{p.comparison_tail}', '')"
    one = f"regexp_replace({_strip('p')}, '{p.question_lead}', '')"
    entities = f"list_filter(list_transform(string_split_regex({_strip(tail)}, '{p.comparison_split}'), lambda p: {_strip(one)}), lambda p: length(p) >= 2)[1:2]"
    return kind, entities


# every second query is one that compares, of its first two words
_QTYPE, _QENT = understood(P, "asked")
_ASKED = "CASE WHEN item_id % 2 = 0 THEN string_split(text, ' ')[1] || ' and ' || string_split(text, ' ')[2] ELSE text END"
_TYPED = f"""qq AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'comparison' ELSE {_QTYPE} END AS kind, {_QENT} AS entities FROM (SELECT *, {_ASKED} AS asked FROM benchmark)),
    qt AS (SELECT *, ([{', '.join(f"'{k}'" for k in _KINDS)}])[1 + length(question) % 5] AS t, coalesce(question, '') || coalesce(answer, '') AS body FROM qp),
    mb AS (SELECT item_id, qa_id, score * CASE WHEN kind = 'comparison' AND len(entities) >= 2 THEN
        (CASE WHEN len(list_filter(entities, lambda e: contains(body, e))) >= 2 THEN 1.6 WHEN len(list_filter(entities, lambda e: contains(body, e))) = 1 THEN 1.15 ELSE 1.0 END)
        * CASE WHEN t = 'comparison' THEN 1.25 ELSE 1.0 END
      ELSE CASE WHEN t = CASE kind WHEN 'method' THEN 'framework' WHEN 'cause' THEN 'principle' ELSE kind END THEN 1.2 ELSE 1.0 END END AS score FROM ma JOIN qq USING (item_id) JOIN qt USING (qa_id))"""


@_query(f"WITH {_MATCH}, {_TYPED} {_FIRST.format('mb')}")
def rnk_qa_typed(spark, d):
    """Pairs of five types and queries of which every second one compares its first two words."""
    kinds = F.array(*map(F.lit, _KINDS))
    pairs = materialize(_pairs(spark, d).withColumn("qa_type", kinds[F.length("question") % 5]), "pairs")
    words = F.split("query", " ")
    asked = F.when(F.col("query_id") % 2 == 0, F.concat(F.get(words, 0), F.lit(" and "), F.get(words, 1))).otherwise(F.col("query"))
    queries = _asked(spark, d).withColumn("asked", asked)
    queries = query.understand(queries, P, "asked").withColumn("query_type", F.when(F.col("query_id") % 2 == 0, "comparison").otherwise(F.col("query_type")))
    found = qa.search(pairs, materialize(queries, "queries"), lexical.tokenizer(P, 2), engine.default_embed(P), type_col="qa_type")
    return found.withColumn("score", F.round("score", 6))


# -- formatting --------------------------------------------------------------------------------------------------

_MARK = f"left(regexp_replace(coalesce(text, ''), '{chr(92)}s|[{chr(92)}x0b{chr(92)}x{{85}}{chr(92)}x{{a0}}{chr(92)}x{{3000}}]', '', 'g'), 200)"
_SHOWN = f"re AS (SELECT conv_id::VARCHAR AS query_id, turn AS rank, conv_id::VARCHAR || '-' || turn::VARCHAR AS chunk_id, role AS source_doc, text FROM conversations), di AS (SELECT *, row_number() OVER (PARTITION BY query_id, {_MARK} ORDER BY rank, chunk_id) AS r FROM re)"


def _shown(spark, d):
    """Turns as the results of their conversation."""
    return _t(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("source_doc"),
        F.col("text").alias("content"), F.col("text").alias("parent_content"),
    )


@_query(f"WITH {_SHOWN} SELECT query_id, chunk_id FROM di WHERE r = 1")
def fmt_distinct(spark, d):
    return formatting.distinct_content(_shown(spark, d)).select("query_id", "chunk_id")


def _context_sql(most: int) -> str:
    left, right = formatting.SOURCE.split("{}")
    return f"""WITH {_SHOWN}, bo AS (SELECT *, {_strip("coalesce(text, '')")} AS b FROM di WHERE r = 1),
    so AS (SELECT query_id, source_doc, '{left}' || source_doc || '{right}' || coalesce(string_agg(chr(10) || b || chr(10), '' ORDER BY rank, chunk_id) FILTER (b <> ''), '') AS t FROM bo GROUP BY query_id, source_doc),
    te AS (SELECT query_id, '{formatting.HEAD.strip()}' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY source_doc) AS t, list(source_doc ORDER BY source_doc) AS source_docs FROM so GROUP BY query_id)
    SELECT query_id, CASE WHEN length(t) > {most} THEN left(t, {most - formatting.NOTICE_ROOM}) || chr(10) || chr(10) || '{formatting.NOTICE.strip()}' ELSE t END AS merged_context, source_docs FROM te"""


@_query(_context_sql(1200))
def fmt_conversations(spark, d):
    """The turns of each conversation as its context, cut at 1200 characters."""
    shown = _shown(spark, d)
    return formatting.contexts(shown, shown.select("query_id").distinct(), most=1200)


# -- metrics and files -------------------------------------------------------------------------------------------


@_query("SELECT count(*) AS documents, min(n) AS least, max(n) AS most FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def agg_qa_documents(spark, d):
    return metrics.qa_documents(_docs(spark, d), "source")


def _collected(spark, d):
    """Conversations as collected results."""
    item = F.struct(F.col("turn").cast("int").alias("rank"), F.col("role").alias("source_doc"))
    rows = _t(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("query_id")).agg(F.sort_array(F.collect_list(item)).alias("retrieved_chunks"))
    return rows.withColumn("retrieval_time_ms", F.size("retrieved_chunks").cast("double"))


@_query("SELECT count(*) AS queries, sum(n)::BIGINT AS chunks, round(avg(n), 1) AS chunks_per_query, round(avg(n), 0) AS mean_ms FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def agg_collection(spark, d):
    return metrics.collection(_collected(spark, d))


@_query("SELECT conv_id::VARCHAR AS query_id, count(*)::INT AS chunks, count(DISTINCT role)::INT AS documents FROM conversations GROUP BY conv_id")
def agg_collected(spark, d):
    return metrics.collected(_collected(spark, d))


@_query("SELECT qa_id, question, answer, gold_source FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS qa_id, text AS question, n AS answer, conv_id::VARCHAR AS gold_source, role, r FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) WHERE role = 'user' AND r = 'assistant'")
def src_qa_pairs(spark, d):
    """Pairs written as JSON lines and read again."""
    path = scratch_path(spark, "pairs")
    pairs = _pairs(spark, d).withColumns({"qa_type": F.lit("case"), "source_doc": F.substring_index("qa_id", "-", 1)})
    files.save_qa_pairs(pairs, path)
    return files.load_qa_pairs(spark, path).select("qa_id", "question", "answer", "gold_source")


@_query("SELECT ['small', 'large'][1 + vec_id % 2] AS granularity, count(*) AS n FROM embeddings GROUP BY 1")
def src_vectors(spark, d):
    """Vectors stored by granularity in two appends, then counted."""
    path = scratch_path(spark, "vectors")
    rows = _vectors(spark, d).withColumn("granularity", F.when(F.col("vec_id") % 2 == 0, "small").otherwise("large"))
    files.save_vectors(rows.where("vec_id % 3 = 0"), path)
    files.save_vectors(rows.where("vec_id % 3 <> 0"), path, append=True)
    return files.count_vectors(spark, path)


@_query("SELECT conv_id::VARCHAR AS query_id, arg_min(text, turn) AS query, CASE WHEN count(*) > 3 THEN 'hard' ELSE 'easy' END AS difficulty, count(*)::INT AS n_chunks FROM conversations GROUP BY conv_id HAVING count(*) > 3")
def src_results(spark, d):
    """Results written as one document, read again, those of one difficulty picked."""
    path = scratch_path(spark, "results")
    rows = _t(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("query_id")).agg(
        F.min_by("text", "turn").alias("query"), F.lit("case").alias("query_type"), F.when(F.count("*") > 3, "hard").otherwise("easy").alias("difficulty"),
        F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("rank"), F.col("text").alias("content")))).alias("retrieved_chunks"),
    )
    files.save_results_envelope(rows, path)
    return files.pick(files.envelope_results(spark, path), difficulty="hard").select("query_id", "query", "difficulty", F.size("retrieved_chunks").alias("n_chunks"))


__all__ = ["T", "_CHAPTERS", "_clean", "_quote", "content_sql", "parts_sql", "preprocessed_sql", "re2", "scored_sql", "understood"]
