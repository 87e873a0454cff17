"""Lexical retrieval: postings, term statistics, Okapi BM25 and its boosts, for a table of queries at once.

Texts are cut once, into a table of postings that also holds each document's length; statistics come from that
table. Queries reach postings by a broadcast of their terms where these are at most BROADCAST_TERMS rows, so postings
are not shuffled; above that by a shuffled join in which common terms are spread over several tasks.

The best k documents are found by block maxima. Documents with the same most frequent term stand together in blocks of
BLOCK_DOCUMENTS, and a row of the block table holds the postings of one block. A task keeps the k best of each query so far.
The largest impacts of a query's terms in a block bound the score of any document there; a block whose bounds are all
under the k-th scores so far is skipped, and others are scored for the queries that need them, by a product of matrices. Only the
best k of each task are shuffled. Results are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import ZH, Profile
from ..plans.scratch import materialize
from . import segment, vectors

BROADCAST_TERMS, SALTS, HOT_TERM = 300_000, 32, 100_000
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP_K = 50
BOOST_CAP = 1.5
BLOCK_DOCUMENTS, RANGE_DOCUMENTS, CHUNK_BLOCKS, QUERY_ROWS = 64, 1 << 13, 8, 1024
ROUNDING = 1e-8  # documents that tie when rounded are kept


def tokenizer(profile: Profile = ZH, least: int = 1, dictionary: tuple[str, ...] = (), words: DataFrame | None = None):
    """The built-in tokenizer of a profile, as a function of columns; a plug-in is any such function.

    For Chinese: words (of segment.learn) are found by the path of largest probability; without them, pairs of characters,
    and words of the dictionary whole.
    """
    if profile.name == "zh":
        if words is not None:
            return segment.segmenter(words, profile.stop_words, least)
        return lambda c: T.han_tokens(c, profile.stop_words, least, dictionary)
    return lambda c: T.tokens(c, profile.stop_words, least)


@dataclass
class Index:
    postings: DataFrame  # key, dl, term, tf
    terms: DataFrame  # term, df, idf
    documents: int
    average: float
    key: str
    stored_blocks: DataFrame | None = None
    by_document: DataFrame | None = None  # key, dl, terms, tfs (numbers, top): the postings of a document in one row, where these are known

    def impact(self, tf: Column, dl: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(self.average or 1.0)))

    @property
    def blocks(self) -> DataFrame:
        """(keys, places, terms, impacts, seed): the postings of each block of documents, made when first asked for."""
        if self.stored_blocks is None:
            self.stored_blocks = block_postings(self)
        return self.stored_blocks


def term_counts(df: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, term, tf): counted for each row where it is read; rows of one key are added up."""
    posting = F.explode(F.arrays_zip("_c.terms", "_c.tfs")).alias("_p")
    rows = df.select(key, _counted(tokens).alias("_c")).select(key, posting)
    return rows.groupBy(key, F.col("_p.terms").alias("term")).agg(F.sum("_p.tfs").alias("tf"))


def build_index(df: DataFrame, tokens: Column, key: str = "doc_id", dim: int = 0, carried: tuple[str, ...] = ()) -> Index:
    """Inverted index of a table (one row a key): every term that is in over half of the documents gets a quarter of the mean idf.

    A document's terms are counted where it is read, so postings are not shuffled. dim: by_document also has the embedding of the
    built-in encoder for the same tokens, and the carried columns, so that texts are cut into tokens once for both.
    """
    own = [key, *carried]
    rows = df.select(*own, _counted(tokens, dim).alias("_c")).select(*own, "_c.dl", "_c.terms", "_c.tfs", *(["_c.embedding"] if dim else []))
    rows = rows.withColumns({"numbers": _numbers(0), "top": _top()})
    rows = materialize(rows, "documents-terms")
    posting = F.explode(F.arrays_zip("terms", "tfs")).alias("_p")
    postings = rows.select(key, "dl", posting).select(key, "dl", F.col("_p.terms").alias("term"), F.col("_p.tfs").alias("tf"))
    index = index_of(postings, df.count(), key)
    index.by_document = rows
    return index


def _counted(tokens: Column, dim: int = 0) -> Column:
    """(dl, terms, tfs): how many tokens a text has, its different ones, and how often each is there; with dim also its embedding."""

    @F.arrow_udf("dl int, terms array<string>, tfs array<bigint>" + (", embedding array<double>" if dim else ""))
    def count(lists: pa.Array) -> pa.Array:
        full = lists.fill_null([])
        cut = full.flatten().dictionary_encode()
        sizes = np.diff(full.offsets.to_numpy())
        width = max(1, len(cut.dictionary))
        at, tf = np.unique(np.repeat(np.arange(len(full)), sizes) * width + cut.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(at, np.arange(len(full) + 1) * width), pa.int32())
        terms = pa.ListArray.from_arrays(ends, cut.dictionary.take(pa.array(at % width)))
        cols = [pa.array(sizes, pa.int32()), terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))]
        more = [vectors.counted_vectors(len(full), at // width, at % width, cut.dictionary, tf, dim)] if dim else []
        return pa.StructArray.from_arrays(cols + more, ["dl", "terms", "tfs", "embedding"][: 3 + len(more)])

    return count(tokens)


def index_of(postings: DataFrame, documents: int, key: str = "doc_id") -> Index:
    """The index of stored postings of so many documents (those without a term have no posting)."""
    return index_from(postings, term_totals(postings), documents, key)


def term_totals(postings: DataFrame) -> DataFrame:
    """(term, df, tf): in how many documents a term is, and how often. Totals of parts of a collection add up."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def index_from(postings: DataFrame, totals: DataFrame, documents: int, key: str = "doc_id") -> Index:
    """The index of postings whose totals are known."""
    raw = F.log((F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = materialize(totals.withColumn("raw", raw), "terms")
    mean, total = terms.agg(F.coalesce(F.avg("raw"), F.lit(0.0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    terms = terms.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, terms, documents, total / documents if documents else 0.0, key)


def bm25(index: Index, queries: DataFrame, tokens: Column, query_cols: list[str]) -> DataFrame:
    """(query_cols, key, score) of the documents that share a term with the query; a term counts as often as the query has it."""
    q = queries.select(*query_cols, F.explode(tokens).alias("term")).groupBy(*query_cols, "term").agg(F.count("*").alias("qtf"))
    q = materialize(q, "query-terms")
    asked = q.select("term").distinct()
    few = q.count() <= BROADCAST_TERMS
    known = index.terms.join(F.broadcast(asked) if few else asked, "term", "left_semi")
    q = q.join(known, "term")
    if few:
        hits = index.postings.join(F.broadcast(q), "term")
    else:
        hot = F.col("df") >= HOT_TERM
        spread = q.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        common = [r[0] for r in index.terms.where(hot).orderBy(F.desc("df")).limit(1000).select("term").collect()]
        salt = F.when(F.col("term").isin(common), F.pmod(F.xxhash64(index.key), F.lit(SALTS)).cast("int")).otherwise(0)
        spread = spread.where((F.col("_salt") == 0) | F.col("term").isin(common))
        hits = index.postings.withColumn("_salt", salt).join(spread, ["term", "_salt"])
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(index.average or 1.0)))
    return hits.groupBy(*query_cols, index.key).agg(F.sum(part).alias("score"))


def _term_number(seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), "term")


def _numbers(seed: int) -> Column:
    return F.transform("terms", lambda t: F.xxhash64(F.lit(seed), t))


def _top() -> Column:
    """The most frequent term of a document."""
    return F.array_max(F.arrays_zip("tfs", "terms"))["terms"]


def block_postings(index: Index) -> DataFrame:
    """The postings of an index by blocks: documents in the order of their most frequent term, then key, BLOCK_DOCUMENTS in each.

    A posting is the place of its document among the block's keys, the number of its term (a hash; no two terms of the
    index share one) and its impact.
    """
    seed = 0
    while index.terms.groupBy(_term_number(seed).alias("t")).count().where("count > 1").count():
        seed += 1
    rows = index.by_document
    if rows is None:
        posting = F.struct("term", "tf")
        rows = index.postings.groupBy(index.key).agg(F.first("dl").alias("dl"), F.collect_list(posting).alias("p")).select(index.key, "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
        rows = materialize(rows, "documents-terms")
    rows = rows.where(F.size("tfs") > 0)
    first = F.col("top") if "top" in rows.columns else _top()
    numbers = F.col("numbers") if "numbers" in rows.columns and not seed else _numbers(seed)  # the range sampler reads these rows as well
    # one shuffle of the postings, as two arrays of numbers a document
    rows = rows.select(F.col(index.key).alias("k"), first.alias("_top"), "dl", numbers.alias("t"), F.transform("tfs", lambda x: x.cast("int")).alias("tfs"))
    rows = rows.repartitionByRange(max(1, math.ceil(index.documents / RANGE_DOCUMENTS)), "_top", "k").sortWithinPartitions("_top", "k")
    rows = rows.select("k", "t", F.transform("tfs", lambda x: index.impact(x, F.col("dl"))).alias("i"))
    size = BLOCK_DOCUMENTS

    def blocks(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                t, i = part.column("t"), part.column("i")
                n = np.diff(t.offsets.to_numpy())
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                cols = [one(part.column("k")), one(pa.array(np.repeat(np.arange(len(part)), n), pa.int32())), one(t.flatten()), one(i.flatten()), pa.array([seed], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["keys", "places", "terms", "impacts", "seed"])

    kind = dict(rows.dtypes)["k"]
    return materialize(rows.mapInArrow(blocks, f"keys array<{kind}>, places array<int>, terms array<bigint>, impacts array<double>, seed int"), "block-postings")


def bm25_top(index: Index, queries: DataFrame, tokens: Column, query_cols: list[str], k: int = TOP_K, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_cols, key, score) of the best k documents and of those of `also`, (blocks, skipped, postings, postings_read) by task).

    also: (query_cols, key) of documents whose scores are wanted whatever they are (no row if they share no term).
    Queries are gone through QUERY_ROWS at a time.
    """
    q = queries.select(*query_cols, F.explode(tokens).alias("term")).groupBy(*query_cols, "term").agg(F.count("*").alias("qtf"))
    q = materialize(q.join(index.terms, "term").select(*query_cols, "term", (F.col("qtf") * F.col("idf")).alias("w")), "query-terms")
    head = index.blocks.select("seed").first()
    kind = dict(index.postings.dtypes)[index.key]
    number = F.xxhash64(*query_cols)
    parts = max(1, math.ceil(q.select(*query_cols).distinct().count() / QUERY_ROWS))
    found = stats = None
    for part in range(parts):
        some = q.where(F.pmod(number, F.lit(parts)) == part) if parts > 1 else q
        asked = some.withColumn("t", _term_number(head.seed if head else 0)).groupBy(*query_cols).agg(F.collect_list("t").alias("t"), F.collect_list("w").alias("w"))
        asked = asked.orderBy(*query_cols).toPandas()  # at most about QUERY_ROWS rows
        got = materialize(index.blocks.mapInArrow(_best_of_blocks(asked["t"].tolist(), asked["w"].tolist(), k), f"q int, k {kind}, score double, blocks long, skipped long, postings long, postings_read long"), "bm25-best")
        names = queries.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(asked[query_cols].itertuples(index=False, name=None))], "q int, " + ", ".join(f"{c} {dict(q.dtypes)[c]}" for c in query_cols))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "k"))
        best = got.where("q is not null").withColumn("_place", place).where(F.col("_place") <= k).join(F.broadcast(names), "q").select(*query_cols, F.col("k").alias(index.key), "score")
        seen = got.where("q is null").select("blocks", "skipped", "postings", "postings_read")
        found, stats = (best, seen) if found is None else (found.unionByName(best), stats.unionByName(seen))
    if also is not None:
        part = F.col("w") * index.impact(F.col("tf"), F.col("dl"))
        wanted = index.postings.join(also.select(*query_cols, index.key), index.key).join(q, [*query_cols, "term"])
        more = wanted.groupBy(*query_cols, index.key).agg(F.sum(part).alias("score"))
        found = found.join(more.select(*query_cols, index.key), [*query_cols, index.key], "left_anti").unionByName(more)
    return found, stats


def _best_of_blocks(terms: list, weights: list, k: int):
    """Of batches of block rows: the best k of each query (by its place in terms), and a row of counts."""
    sizes = [len(t) for t in terms]
    known, column = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(t, np.int64) for t in terms)]), return_inverse=True)
    row, weight = np.repeat(np.arange(len(terms)), sizes), np.concatenate([np.zeros(0), *(np.asarray(w, np.float64) for w in weights)])
    order = np.argsort(column, kind="stable")
    column, row, weight = column[order], row[order], weight[order]
    first = np.searchsorted(column, np.arange(len(known) + 1))  # where the entries of a column of the query matrix begin

    def run(batches):
        best_s, best_k = np.zeros((len(terms), 0)), np.zeros((len(terms), 0), np.int64)
        names, counts, kind = [], np.zeros(4, np.int64), None
        for b in batches:
            kind = b.column("keys").type.value_type
            for low in range(0, b.num_rows, CHUNK_BLOCKS):
                part = b.slice(low, CHUNK_BLOCKS)
                lists = {c: part.column(c) for c in ("keys", "places", "terms", "impacts")}
                keys = lists["keys"].flatten()
                held = np.diff(lists["keys"].offsets.to_numpy()) if len(part) else np.zeros(0, np.int64)
                n = np.diff(lists["places"].offsets.to_numpy())
                block = np.repeat(np.arange(len(n)), n)
                doc = lists["places"].flatten().to_numpy() + np.repeat(np.cumsum(held) - held, n)
                t, impact = lists["terms"].flatten().to_numpy(), lists["impacts"].flatten().to_numpy()
                counts += [len(n), 0, 0, 0]
                at = np.minimum(np.searchsorted(known, t), max(len(known) - 1, 0))
                mine = known[at] == t if len(known) else np.zeros(len(t), bool)
                if not mine.any():
                    counts[1] += len(n)
                    continue
                block, doc, impact = block[mine], doc[mine], impact[mine]
                present, col = np.unique(at[mine], return_inverse=True)
                counts[2] += len(col)
                w = np.zeros((len(terms), len(present)))
                entries = np.concatenate([np.arange(first[c], first[c + 1]) for c in present])
                w[row[entries], np.repeat(np.arange(len(present)), first[present + 1] - first[present])] = weight[entries]
                most = np.zeros((len(present), len(n)))
                np.maximum.at(most, (col, block), impact)
                bound = np.maximum(w, 0) @ most
                least = best_s[:, k - 1] if best_s.shape[1] >= k else np.zeros(len(terms))
                need = (bound > 0) & (bound >= (least * (1 - ROUNDING))[:, None])
                asks, reads = need.any(1), need.any(0)
                counts[1] += int((~reads).sum())
                inside = reads[block]
                counts[3] += int(inside.sum())
                if not asks.any():
                    continue
                docs, place = np.unique(doc[inside], return_inverse=True)
                x = np.zeros((len(present), len(docs)))
                x[col[inside], place] = impact[inside]
                scores = np.zeros((len(terms), len(docs)))
                scores[asks] = w[asks] @ x
                # keys are kept once, by number
                base = sum(map(len, names))
                names.append(keys.take(pa.array(docs)))
                best_s, best_k = np.hstack([best_s, scores]), np.hstack([best_k, np.broadcast_to(base + np.arange(len(docs)), scores.shape)])
                if best_s.shape[1] > k:
                    # what ties with the k-th when rounded stays, since ties go by key
                    edge = -np.partition(-best_s, k - 1, axis=1)[:, k - 1]
                    best_s = np.where(best_s >= (edge * (1 - ROUNDING) - 1e-300)[:, None], best_s, 0.0)
                    order = np.argsort(-best_s, axis=1, kind="stable")[:, : max(k, int((best_s > 0).sum(1).max(initial=0)))]
                    best_s, best_k = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_k, order, 1)
        if kind is not None:
            q, c = np.nonzero(best_s > 0)
            ids = pa.chunked_array(names, kind).combine_chunks().take(pa.array(best_k[q, c])) if names else pa.array([], kind)
            none = pa.nulls(len(q), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids, pa.array(best_s[q, c]), none, none, none, none], _FOUND)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, kind), pa.nulls(1, pa.float64()), *(pa.array([c]) for c in counts)], _FOUND)

    return run


_FOUND = ["q", "k", "score", "blocks", "skipped", "postings", "postings_read"]


def overlap_share(a: Column, b: Column) -> Column:
    """How much of the set b is in a (0 for an empty b)."""
    bs = F.array_distinct(b)
    return F.size(F.array_intersect(a, bs)) / F.greatest(F.size(bs), F.lit(1))


def search(index: Index, queries: DataFrame, query_tokens: Column, query_cols: list[str], k: int = TOP_K, names: DataFrame | None = None, name_tokens: Column | None = None) -> DataFrame:
    """(query_cols, key, score, rank): BM25 over the query's largest, with the document-name boost, best k above 0.

    names: (key, ...) rows whose name_tokens are compared with the query; a name that shares a token with a query
    reaches it through a join by token, so documents without any query term are boosted too.
    """
    boost = None
    if names is not None:
        # rows of one source share a name, so each different name is compared once
        named = materialize(names.select(index.key, F.array_distinct(name_tokens).alias("_name")), "names")
        sets = named.select("_name").distinct().select("_name", F.explode("_name").alias("term"), F.size("_name").alias("n"))
        q = queries.select(*query_cols, F.explode(F.array_distinct(query_tokens)).alias("term"))
        boost = materialize(q.join(sets, "term").groupBy(*query_cols, "_name").agg((0.3 * F.count("*") / F.max("n")).alias("boost")), "name-boosts")
        few = boost.count() <= BROADCAST_TERMS
        boost = materialize(named.join(F.broadcast(boost) if few else boost, "_name").drop("_name"), "boosts")  # a skewed join is split where it is shuffled
    # a document without a boost is in the result only if it is among the best k
    scores = materialize(bm25_top(index, queries, query_tokens, query_cols, k, boost)[0], "bm25")
    most = scores.groupBy(*query_cols).agg(F.max("score").alias("_most"))  # combined in the tasks, then one row a query
    scores = scores.join(most, query_cols)
    scores = scores.withColumn("score", F.when(F.col("_most") > 0, F.col("score") / F.col("_most")).otherwise(F.col("score"))).drop("_most")
    if boost is not None:
        scores = scores.join(boost, [*query_cols, index.key], "full_outer")
        base = F.coalesce("score", F.lit(0.0))
        scores = scores.withColumn("score", F.when(F.col("boost").isNotNull(), F.least(base + F.col("boost"), F.lit(BOOST_CAP))).otherwise(base)).drop("boost")
    scores = scores.where("score > 0")
    best = Window.partitionBy(*query_cols).orderBy(F.desc(F.round("score", 9)), index.key)  # tasks keep their own best k first
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def chapter_boost(score: Column, query_tokens: Column, chapter_tokens: Column) -> Column:
    """score times 1 + 0.2 of the share of the chapter's terms that the query has, at most 1.5."""
    share = overlap_share(query_tokens, chapter_tokens)
    return F.when(share > 0, F.least(score * (1 + 0.2 * share), F.lit(BOOST_CAP))).otherwise(score)
